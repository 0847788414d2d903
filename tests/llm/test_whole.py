"""Operators do their whole job: fixtures where a cut would show."""

import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tramline.llm import classifier, line_join, pii, queries, shards, suffixes  # noqa: E402

TERM = re.compile(r"(?<![^\s(\[\"'])[^\W\d_]{3,}(?=[.,;:!?\"')\]]*(?:\s|$))")


def told_spans(rows, share=0.5, min_chance=0.5, z=1.96, level=0.01):
    """Per row: (start, end, chance) of every place of a told term, from counts of whole documents."""
    said = [{(k, text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])) for k, a, b in brute.private(text)} for _, text in rows]
    held = [{m.group().lower() for m in TERM.finditer(text or "")} for _, text in rows]
    n_t, n_e, n_et = Counter(t for h in held for t in h), Counter(e for s in said for e in s), Counter((e, t) for s, h in zip(said, held) for e in s for t in h)
    texts = {text: (s, h) for (_, text), s, h in zip(rows, said, held) if s}
    seen = Counter((e, t) for s, h in texts.values() for e in s for t in h)
    needed = math.log((sum(len(s) * len(h) for s, h in texts.values()) or 1) / level)
    chances = defaultdict(float)
    for (e, t), n in n_et.items():
        base, p = n_e[e] / len(rows), n / n_t[t]
        draws = seen[e, t] / p
        sure = (p + z * z / (2 * draws) - z * math.sqrt(p * (1 - p) / draws + z * z / (4 * draws * draws))) / (1 + z * z / draws)
        if base == 1 or p <= base or sure < min_chance:
            continue
        unlikely = draws * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0))
        if unlikely >= needed and math.log2(sure / base) >= share * math.log2(1 / base):
            chances[t] = max(chances[t], p)
    return [[(*m.span(), chances[m.group().lower()]) for m in TERM.finditer(text or "") if m.group().lower() in chances] for _, text in rows]


def test_terms_of_shared_entities(spark):
    rows = [(i, f"common words here\nplumber Accra\nwrite to ann@x.org now {letters(i)}\n{'x' * 200} red house") for i in range(12)]
    rows += [(20 + i, f"mail bob@y.org é😀 about violins {letters(90 + i)} {'tuesday' if i < 6 else 'common words'}") for i in range(9)]
    rows += [(30, "violins and plumber, tuesday\nred"), (31, "one +1 (375) 555-4393 lonely"), (31, "one +1 (375) 555-4393 lonely"), (None, None), (33, "")]
    rows += [(70 + i, "copies of carl@z.org repeated") for i in range(20)]
    rows += [(100 + i, "common words and nothing else") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_private(docs).select("doc_id", F.expr("filter(spans, s -> s.kind = 'term')").alias("s")).collect()
    expected = told_spans(rows)
    same = lambda x: sorted(x, key=str)
    assert same((r.doc_id, [(s.start, s.end, s.label) for s in r.s]) for r in found) == same(
        (d, [(a, b, "" if c >= 0.9 else "[TERM]") for a, b, c in spans]) for (d, _), spans in zip(rows, expected))
    told = {rows[i][1][a:b].lower() for i, spans in enumerate(expected) for a, b, _ in spans}
    # A word on another line than the entity and one that also stands without it; a text without the entity.
    assert {"plumber", "house", "violins"} <= told and expected[21]
    # Words of one text, whatever its copies, and words that stand everywhere.
    assert not told & {"lonely", "repeated", "copies", "common", letters(3)}


def letters(number):
    return "w" + "".join(chr(97 + int(d)) for d in str(number)) + "q"


def test_terms_that_reveal_and_rare_words(spark):
    """Planted names beside their owners' addresses are told; rare words beside them, or hit by chance, are not."""
    draw = random.Random(5)
    rows, planted = [], set()
    for owner in range(40):
        name = f"name{letters(owner)}".replace("w", "v")
        planted.add(name)
        # The name stands once without the address, and each text has rare words of its own.
        for i in range(8):
            address = f"owner{owner}@mail.org" if i else "no address"
            rare = " ".join(f"rare{letters(draw.randrange(4000))}" for _ in range(12))
            rows.append((len(rows), f"letter from {name} to {address}\nabout {rare}"))
    rows += [(len(rows) + i, " ".join(f"rare{letters(draw.randrange(4000))}" for _ in range(12))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_private(docs)
    text = dict(rows)
    told = {text[r.doc_id][s.start : s.end] for r in found.collect() for s in r.spans if s.kind == "term"}
    assert len(told & planted) >= 0.9 * len(planted)
    assert told <= planted
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(name in t for name in told for t in clean.values())


def test_terms_of_the_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: r.s for r in pii.find_private(docs).select("doc_id", F.expr("transform(filter(spans, s -> s.kind = 'term'), s -> struct(s.start, s.end))").alias("s")).collect()}
    expected = {d: [(a, b) for a, b, _ in spans] for (d, _), spans in zip(rows, told_spans(rows))}
    assert {d: [tuple(s) for s in x] for d, x in found.items()} == expected


def test_shards_hold_the_texts(spark, sf_dir, tmp_path, monkeypatch):
    rows = [(i, f"text {i} é", f"s{i % 3}") for i in range(100)] + [(None, None, "s"), (5, "", None), (5, "", None)]
    records = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    shards.write_shards(records, str(tmp_path / "out"), 7, size=F.coalesce(F.octet_length("text"), F.lit(0)), min_buckets=4)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.source) for r in found.filter("text is not null").collect() if r.source) == sorted(r for r in rows if r[1] is not None and r[2])
    assert sorted((r.shard, r.slot) for r in found.collect()) == sorted((i % 7, i // 7) for i in range(len(rows)))
    # The digest tells what was written: a text swapped in the operator shows.
    real = shards.external_shuffle
    monkeypatch.setattr(shards, "external_shuffle", lambda records, **options: real(records, **options).withColumn("text", F.lit("swapped")))
    assert {r.size for r in queries.op10_sharding(spark, sf_dir).collect()} == {len("swapped") + 16}


def test_windows_hold_the_ids(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = {r.doc_id: [*whole.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    windows = defaultdict(list)
    for p in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        ids = [int.from_bytes(p.ids[i : i + 4], "little") for i in range(0, len(p.ids), 4)]
        assert ids == encoded[p.doc_id][p.start : p.start + p.length] and p.ids_crc32 == brute.crc(ids)
        windows[p.sequence_id].append((p.offset, ids))
    assert sum(len(ids) for w in windows.values() for _, ids in w) == sum(map(len, encoded.values()))
    assert all(len([x for _, ids in sorted(w) for x in ids]) <= 2048 for w in windows.values())


@pytest.fixture
def resplit(spark, tmp_path, monkeypatch):
    """A table whose files are cut into other partitions once ``after`` of a module has run."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    line = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"own{i} text{i * 7} of{i * 11}\n{line} v{i % 2}") for i in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/t/part={part}")

    def table(module, after):
        real = getattr(module, after)

        def then_split(*args, **options):
            out = real(*args, **options)
            spark.conf.set(key, "64")
            return out

        monkeypatch.setattr(module, after, then_split)
        return spark.read.parquet(f"{tmp_path}/t").select("doc_id", "text"), rows

    yield table
    spark.conf.set(key, before)


def test_lines_when_files_are_cut_anew(resplit):
    docs, rows = resplit(line_join, "_verified")
    found = line_join.find_repeated_lines(docs).collect()
    assert {r.doc_id: r.removed for r in found} == dict(zip((d for d, _ in rows), brute.similar_lines(rows)))


def test_dedup_lines_when_files_are_cut_anew(resplit):
    docs, rows = resplit(line_join, "_verified")
    kept = {r.doc_id: r.text for r in line_join.dedup_lines(docs).collect()}
    assert kept == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) for (d, t), gone in zip(rows, brute.similar_lines(rows))}


def test_suffixes_when_files_are_cut_anew(resplit):
    docs, rows = resplit(suffixes, "materialise")
    found = suffixes.without_repeats(docs).select("doc_id", "n_bytes", F.sha2("kept", 256).alias("h")).collect()
    assert sorted(map(tuple, found)) == sorted((d, n, h) for d, n, _, _, h in brute.kept_bytes(rows))


def test_sample_of_different_texts(spark, sf_dir):
    """Copies of the text with the least hash do not crowd others out of the sample."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    first = docs.orderBy(F.xxhash64(F.col("text").cast("binary"))).limit(1)
    crowded = docs.unionByName(first.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n"))
    _, label_of = classifier.fit_labels(docs)
    weights, bias = classifier.fit_scorer(crowded, label_of, sample=100, rounds=5)
    expected, expected_bias = classifier.fit_scorer(docs, label_of, sample=100, rounds=5)
    assert abs(bias - expected_bias) < 1e-9 and abs(weights - expected).max() < 1e-9
