"""Every operator's query against brute force or SQL over the given tables."""

import os
import sys
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import oracle  # noqa: E402

import corpus_pipeline  # noqa: E402
from tramline.llm import queries, token_counts  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas()


def rows(spark, sf_dir, name, *columns):
    df = queries.QUERIES[name](spark, sf_dir)
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert oracle.compare(oracle.connect(sf_dir), queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name]) == []


def test_contamination(spark, sf_dir, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(spark, sf_dir, "op1_decontaminate") == sorted(brute.contamination(list(zip(docs.doc_id, docs.text)), items))


def test_quality(spark, sf_dir, docs):
    expected = brute.quality(list(zip(docs.doc_id, docs.source, docs.text)))
    assert rows(spark, sf_dir, "op2_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "n_common_words", "n_common_lines", "base_failed", "kept") == sorted(expected)


def test_similar_lines(spark, sf_dir, docs):
    removed = brute.similar_lines(list(zip(docs.doc_id, docs.text)))
    expected = sorted((d, len(r), ",".join(map(str, r))) for d, r in zip(docs.doc_id, removed))
    assert rows(spark, sf_dir, "op3_line_dedup", "doc_id", "n_removed", "removed_lines") == expected


def test_token_counts(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    lengths = np.array([len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in docs.text])
    expected = [(int(x), int((lengths == x).sum()), int((lengths >= x).sum()), int(lengths[lengths >= x].sum()), int((lengths <= x).sum()), int(np.minimum(lengths, x).sum()))
                for x in np.unique(lengths)]
    assert rows(spark, sf_dir, "op4_token_counts", "length", "docs", "docs_from", "tokens_from", "docs_fit", "tokens_truncated") == expected
    sums = token_counts.suffix_sums(token_counts.length_histogram(queries.documents(spark, sf_dir), queries.tokenizer_path()))
    limits = [1, 100, 2048, 10**7]
    assert sorted(map(tuple, token_counts.at_limits(sums, limits).collect())) == [(x, int((lengths > x).sum()), int(np.minimum(lengths, x).sum())) for x in limits]
    shares = [0.25, 0.5, 1.0]
    ordered = np.sort(lengths)
    assert sorted(map(tuple, token_counts.quantiles(sums, shares).collect())) == [(s, int(ordered[int(np.ceil(s * len(ordered))) - 1])) for s in shares]


def test_simhash(spark, sf_dir, docs):
    prints = {int(d): brute.fingerprint(t) for d, t in zip(docs.doc_id, docs.text)}
    components = brute.groups(prints)
    assert rows(spark, sf_dir, "op5_simhash_dedup") == sorted((d, f"{p:016x}", components[d]) for d, p in prints.items())


def test_suffixes(spark, sf_dir, docs):
    assert rows(spark, sf_dir, "op6_suffix_dedup") == sorted(brute.kept_bytes(list(zip(docs.doc_id, docs.text))))


def check_pieces(pieces, encoded, capacity=2048):
    """Every id in one piece, windows gapless and within capacity; gives the share of padding."""
    by_doc, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = encoded[p.doc_id]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == brute.crc(ids[p.start : p.start + p.length])
        by_doc[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length))
    for doc, ids in encoded.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    used = padded = 0
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else capacity)
    return 1 - used / padded


def test_packing(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    encoded = {d: [*whole.encode(t, add_special_tokens=False).ids, 1] for d, t in zip(docs.doc_id, docs.text)}
    assert check_pieces(queries.op7_packing(spark, sf_dir).collect(), encoded) < 0.05


def test_classifier_on_held_out_labels(spark, sf_dir):
    scored = queries.op8_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    right = scored.filter((F.col("quality") == 1) == F.col("kept")).count()
    assert right >= 0.95 * scored.count()
    assert scored.filter("quality = 1 and not kept").count() <= 0.02 * scored.filter("quality = 1").count()


def test_private_spans(spark, sf_dir, docs):
    expected = []
    for d, t in zip(docs.doc_id, docs.text):
        spans = brute.private(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((d, *(sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")), brute.sha(said)))
    assert rows(spark, sf_dir, "op9_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected)


def test_shards(spark, sf_dir, docs):
    import zlib

    found = queries.op10_sharding(spark, sf_dir).toPandas()
    expected = {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in zip(docs.doc_id, docs.text)}
    assert sorted((int(a), int(b), int(c)) for a, b, c in zip(found.doc_id, found["size"], found.text_crc32)) == sorted((d, *x) for d, x in expected.items())
    counts = found.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(counts) == min(40, len(docs)) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all() and (counts["min"] == 0).all()
    again = queries.op10_sharding(spark, sf_dir).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert found[key].sort_values("doc_id").reset_index(drop=True).equals(again[key].sort_values("doc_id").reset_index(drop=True))
    order = found.sort_values(["slot", "shard"]).doc_id.to_numpy()
    assert np.corrcoef(order, np.arange(len(order)))[0, 1] < 0.3


def test_pipeline(spark, sf_dir, docs):
    """The whole run against the stages done one after the other in plain Python."""
    from tokenizers import Tokenizer

    import pipeline_brute

    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = pipeline_brute.run(list(zip(docs.doc_id, docs.source, docs.text)), items)
    whole = Tokenizer.from_file(queries.tokenizer_path())
    encoded = {d: [*whole.encode(t, add_special_tokens=False).ids, 1] for d, t in kept.items()}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(encoded)
    check_pieces(pieces, encoded)
