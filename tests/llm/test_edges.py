"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tramline.llm import classifier, decontaminate, line_join, pack, pii, quality_rules, queries, shards, simhash, suffixes  # noqa: E402

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS)
PASSAGE = " ".join(WORDS[:60])
ROWS = [
    (1, None, None), (None, "", "h"), (2, " \n\t ", None), (3, PASSAGE, "h"), (3, PASSAGE, "h"), (None, PASSAGE + " x", "h"),
    (4, LONG + "\n" + LONG, "h"), (5, "a@b.cc 1.2.3.4 +1 (375) 555-4393, 4111 1111 1111 1111 é😀 z@y.org", "h"), (6, "é " * 30, ""),
    (7, "ab " * 20_000, "h"), (8, "one two three", "h"), (9, "one two three", "g"),
]
SCHEMA = "doc_id bigint, text string, source string, n_words string, `row` int, `key` int, shard int, fp string, kept string, `a.b` int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "f", "k", 4) for r in ROWS], SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, "one two three"), (None, None), (2, ""), (3, PASSAGE[:40])], "item_id bigint, text string")


def key(row):
    return tuple((x is None, x) for x in row)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)


def test_contamination(docs, items, nothing):
    found = decontaminate.find_contamination(docs, items, out="n_words").select(
        "doc_id", "n_words.n_words", "n_words.n_hit", F.size("n_words.items"), F.sha2(F.array_join("n_words.items", ","), 256), decontaminate.is_contaminated("n_words"))
    expected = brute.contamination([(d, t) for d, t, _ in ROWS], [(1, PASSAGE), (1, "one two three"), (3, PASSAGE[:40])])
    same(found.collect(), expected)
    blocks = decontaminate.find_contamination(docs, items, block_bytes=200).select("doc_id", "found.n_words", "found.n_hit").collect()
    same(blocks, [r[:3] for r in expected])
    assert decontaminate.decontaminate(nothing, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == len(ROWS)
    assert decontaminate.decontaminate(docs, items).columns == docs.columns


def test_decontamination_calls_each_pass_once(docs, items):
    """Its filter reads what the pass found; two calls would hold two workers a task."""
    plan = decontaminate.decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_quality(docs, nothing):
    found = quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "n_common_lines", "base_failed", "kept")
    same(found.collect(), brute.quality([(d, h, t) for d, t, h in ROWS]))
    common = quality_rules.without_common_lines(docs, min_docs=0, share=0.0, min_words=0, max_lost=2.0)
    assert common.columns == docs.columns
    assert quality_rules.quality_rules(nothing).count() == 0


def test_lines(docs, nothing):
    found = line_join.find_repeated_lines(docs).select(F.size("removed"), "removed").collect()
    expected = brute.similar_lines([(d, t) for d, t, _ in ROWS])
    same([(n, tuple(r)) for n, r in found], [(len(r), tuple(r)) for r in expected])
    assert line_join.dedup_lines(docs).columns == docs.columns
    assert line_join.dedup_lines(nothing).count() == 0


def test_crowded_words(spark, monkeypatch):
    """More similar lines at a word than are held against each other."""
    monkeypatch.setattr(line_join, "HOT", 40)
    monkeypatch.setattr(line_join, "MEETING_ROWS", 64)
    rows = [(i, " ".join(WORDS[:20] + [f"v{i // 2}", f"u{i % 7}"])) for i in range(300)] + [(1000 + i, " ".join([*WORDS[:2], *(f"z{i}q{j}" for j in range(6))])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = line_join.find_repeated_lines(docs).orderBy("doc_id").collect()
    assert [r.removed for r in found] == brute.similar_lines(rows)


def test_simhash(docs, nothing):
    found = simhash.group(docs).select("fp", "component_id").collect()
    assert {f"{r.fp & (1 << 64) - 1:016x}" for r in found} == {f"{brute.fingerprint(t):016x}" for _, t, _ in ROWS}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8]
    assert simhash.keep_one(nothing).count() == 0


def test_shards_of_one_hot_part_are_dealt_again(spark):
    prints = [(1 << 63) - 1 - (i * 0x10001) for i in range(60)]
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    from tramline.llm.components import components

    roots = {r.node: r.root for r in components(simhash.links(df, shard_limit=3)).collect()}
    groups = brute.groups({p: p for p in sorted(prints)})
    for p in prints:
        for q in prints:
            assert (groups[p] == groups[q]) == (roots.get(p, p) == roots.get(q, q))


@pytest.mark.parametrize("hot", [1, 2000])
def test_suffixes(docs, nothing, hot):
    found = suffixes.without_repeats(docs, hot=hot).select("doc_id", "n_bytes", F.coalesce(F.size("spans"), F.lit(0)), F.sha2("kept", 256)).collect()
    order = sorted(range(len(ROWS)), key=lambda i: (ROWS[i][0] is not None, ROWS[i][0] or 0, i))
    expected = brute.kept_bytes([ROWS[i][:2] for i in order])
    same(found, [(d, n, s, h) for d, n, _, s, h in expected])
    assert suffixes.without_repeats(nothing).count() == 0


def test_packing_and_counts(docs, nothing):
    pieces = pack.pack(docs, queries.tokenizer_path()).collect()
    assert len({p.sequence_id for p in pieces}) and all(p.offset + p.length <= 2048 for p in pieces)
    assert pack.pack(nothing, queries.tokenizer_path()).count() == 0
    from tramline.llm import token_counts

    empty = token_counts.suffix_sums(token_counts.length_histogram(nothing, queries.tokenizer_path()))
    assert token_counts.limit_table(empty).count() == 0
    assert token_counts.at_limits(empty, [5]).first().asDict() == {"context_limit": 5, "docs_over": 0, "tokens_truncated": 0}


def test_classifier(docs, nothing):
    assert classifier.classify(docs, sample=5).count() == len(ROWS)
    assert classifier.classify(nothing).count() == 0


def test_private(docs, nothing):
    found = pii.find_private(docs).select("doc_id", F.expr("filter(spans, s -> s.kind <> 'term')").alias("s")).collect()
    same([(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.s)) for r in found], [(d, tuple(brute.private(t))) for d, t, _ in ROWS])
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert clean.filter("doc_id = 5").first().text == "[EMAIL] [IP] [PHONE], [CARD] é😀 [EMAIL]"
    assert pii.sanitise(nothing).count() == 0


def test_shard_law(docs, nothing):
    rows = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    dealt = shards.to_shards(rows, 5, size="size").collect()
    assert sorted((r.shard, r.slot) for r in dealt) == [(i % 5, i // 5) for i in sorted(range(len(ROWS)), key=lambda i: (i % 5, i))]
    assert shards.to_shards(rows.limit(0), 5, size="size").count() == 0


def test_stages_on_nothing(spark, nothing, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain, sf_dir).count() == 0
