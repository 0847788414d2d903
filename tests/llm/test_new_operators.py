"""Whitening, collocations and best-fit packing against plain versions, and their edge rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import best_fit, collocations, queries, whitening

# Whitening


def integer_rows(vectors):
    kept = [(i, [float(c) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    return [(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in kept]


def check_white(rows, vectors, k=4):
    kept = integer_rows(vectors)
    fit_list = np.array(sorted({x for _, x in kept}), object)
    n, sums = len(fit_list), fit_list.sum(axis=0)
    centred = (fit_list - np.array([s / n for s in sums])).astype(float)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    k = min(k, len(values))
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    assert len(rows) == len(kept) * k
    by_component = defaultdict(list)
    for row in rows:
        by_component[row["component"]].append(row)
    exact = Counter((i, int(((n * np.array(x, object) - sums) ** 2).sum())) for i, x in kept)
    for c in range(1, k + 1):
        found = by_component[c]
        assert Counter((r["vec_id"], r["deviation"]) for r in found) == exact
        assert {r["n"] for r in found} == {n}
        assert np.allclose([r["explained"] for r in found], values[c - 1] / np.trace(centred.T @ centred / n), rtol=1e-9)
        expected = {i: (np.array(x, float) - np.array([s / n for s in sums])) @ vecs[:, c - 1] / np.sqrt(values[c - 1]) for i, x in kept}
        ours, theirs = np.array([r["whitened"] for r in found]), np.array([expected[r["vec_id"]] for r in found])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-6
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-4


def test_whitening_of_the_table(spark, sf_dir):
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_white(queries.op11_whitening(spark, sf_dir).collect(), vectors)


def test_whitening_edges(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5) * [5, 4, 3, 2, 1]]) for i in range(200)]
    rows += [(900 + i, rows[0][1]) for i in range(500)]
    rows += [(None, rows[1][1]), (1, None), (2, [1.0, None, 1.0, 1.0, 1.0]), (3, [float("nan")] * 5), (4, [float("inf")] * 5), (99999, [-0.0, 0.0, -1e-9, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, x string, `a.b` int")
    frame.repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    check_white(queries.op11_whitening(spark, str(tmp_path)).collect(), rows)
    model = whitening.fit(frame)
    assert model.apply(frame, out="x").columns == ["vec_id", "embedding", "a.b", "x"]
    ragged = frame.unionByName(spark.createDataFrame([(7, [1.0, 2.0], "x", 1), (8, [], "x", 1)], frame.schema))
    assert whitening.fit(ragged).n == model.n and model.apply(ragged).count() == model.apply(frame).count()


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    model = whitening.fit(same)
    assert (model.n, model.explained, model.identity_error) == (1, [0.0, 0.0], 1.0)
    assert {tuple(r[0]) for r in model.apply(same).select("white.whitened").collect()} == {(0.0, 0.0)}
    for rows in (same.limit(0), spark.createDataFrame([(1, [])], same.schema), spark.createDataFrame([(1, None)], same.schema)):
        assert whitening.fit(rows).n == 0 and whitening.fit(rows).explained == []


def test_deviation_beyond_64_bits(spark):
    rows = spark.createDataFrame([(1, [2.0**40, 0.0]), (2, [-(2.0**40), 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(rows)
    found = {r["vec_id"]: int(r["d"]) for r in model.apply(rows).select("vec_id", F.col("white.deviation").alias("d")).collect()}
    x = {1: (2**48, 0), 2: (-(2**48), 256), 3: (0, 0)}
    sums = [sum(v[i] for v in x.values()) for i in range(2)]
    assert found == {k: sum((3 * v[i] - sums[i]) ** 2 for i in range(2)) for k, v in x.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 6, 40])
@pytest.mark.parametrize("kind", ["spread", "equal", "close", "steep", "split"])
def test_leading_components(n, kind):
    rng = np.random.default_rng(n)
    turn, _ = np.linalg.qr(rng.normal(size=(n, n)))
    values = {
        "spread": rng.uniform(1, 2, n), "equal": np.ones(n), "close": 1 + np.arange(n) * 1e-13, "steep": 10.0 ** -np.arange(n),
        "split": np.repeat([3.0, 2.0], [n // 2, n - n // 2]),
    }[kind]
    matrix = np.diag(values) if kind == "split" else (turn * values) @ turn.T
    matrix = (matrix + matrix.T) * 500
    found, vectors = whitening.leading_components(matrix, 4)
    top = np.abs(matrix).max()
    assert np.abs(found - np.sort(np.linalg.eigvalsh(matrix))[::-1][:4]).max() < 1e-13 * top * n
    assert np.abs(matrix @ vectors.T - vectors.T * found).max() < 1e-13 * top * n
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12


# Collocations


def brute_phrases(rows, limit=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in 1, 2, 3:
                counts[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for i in range(len(p) - 1):
                if len(p) == 3:
                    inside[p[i : i + 2]] = max(inside[p[i : i + 2]], a)
        scores = []
        for p, a in candidates.items():
            if p in inside and 100 * inside[p] >= 50 * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scores.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out)


def found_phrases(frame, **options):
    return sorted(map(tuple, collocations.collocations(frame, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_phrases_with_edges(spark):
    random.seed(5)
    words = "a b c of the The New york york's é É 北京 😀 x\x1fy � \U0001f600z".split(" ")
    text = lambda n: "".join(random.choice(words) + random.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "\x0b", "! "]) for _ in range(n))
    rows = [(random.choice(["en", "de", None, "und", ""]), text(random.randint(0, 120))) for _ in range(150)]
    rows += [("en", None), (None, None), ("en", ""), ("en", " .,\n"), ("solo", "one"), *[("hot", "of the new york")] * 400, ("long", text(30_000))]
    frame = spark.createDataFrame([(i, b, a, 1, 2, "p") for i, (a, b) in enumerate(rows)], "doc_id long, text string, lang string, words int, `a` int, phrase string")
    expected = brute_phrases(rows)
    assert found_phrases(frame.repartition(5)) == expected
    assert found_phrases(frame, limit=3) == brute_phrases(rows, 3)
    for size in 3, 50:
        small = collocations.phrase_counts(frame, block_words=size)
        assert Counter(map(tuple, small.collect())) == Counter(map(tuple, collocations.phrase_counts(frame).collect()))
    assert found_phrases(frame.limit(0)) == []


def test_chunks_end_at_separators(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 10)
    text = "aaaa bbbb cccc dddd. eeee ffff, gggg hhhh iiii jjjj".encode()
    parts = list(collocations.chunks(text))
    assert b"".join(parts) == text and parts[0].endswith(b".") and len(parts) == 3 and list(collocations.chunks(b"")) == [b""]


def test_scores_are_exact(spark):
    big = 9 * 10**15
    rows = [("x", 1, "a", big), ("x", 1, "b", big - 1), ("x", 2, "a b", big - 2), ("x", 1, "c", 10), ("x", 2, "b c", 10)]
    found = {r["phrase"]: r["score"] for r in collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, a long")).collect()}
    assert found == {"a b": 10**6 * (big - 2) ** 2 // (big * (big - 1)), "b c": 10**6 * 100 // ((big - 1) * 10)}


def test_longer_phrases(spark):
    rows = [("en", "w1 w2 w3 w4 w5")] * 12 + [("en", "w2 w3 x")] * 30
    found = {r["phrase"]: (r["words"], r["a"]) for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), max_words=5).collect()}
    assert found == {"w1 w2 w3 w4 w5": (5, 12), "w2 w3 x": (3, 30)}


# Best-fit packing


def check_sequences(rows, encoded, capacity):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(encoded)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        ids = encoded[doc]
        assert [(p["piece"], p["start"]) for p in pieces] == [(i, i * capacity) for i in range(-(-len(ids) // capacity))]
        for p in pieces:
            part = ids[p["start"] : p["start"] + capacity]
            assert p["length"] == len(part) and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_sequences_of_the_table(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    encoded = {r["doc_id"]: whole.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs}
    count = check_sequences(queries.op13_best_fit(spark, sf_dir).collect(), encoded, 4096)
    assert count <= -(-sum(map(len, encoded.values())) // 4096) * 1.01 + 1


def test_sequences_of_edge_rows(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    texts = [None, "", " \n", "one", "one", "ab " * 63, "ab " * 64, "ab " * 65, "ab " * 2000, "é😀 <|endoftext|> \x00 x" * 9]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece int, ids string")
    encoded = {i: whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for pool in 100, 1 << 22:
        rows = best_fit.pack_whole(frame, path, capacity=64, pool_tokens=pool).withColumn("ids_crc32", F.crc32("ids")).collect()
        check_sequences(rows, encoded, 64)
    assert best_fit.pack_whole(frame.limit(0), path).count() == 0
    text_ids = best_fit.pack_whole(frame.select(F.lit(None).cast("string").alias("doc_id"), "text"), path, capacity=64)
    assert text_ids.count() == len(rows) and dict(text_ids.dtypes)["doc_id"] == "string"


def least_bins(sizes, capacity):
    """Fewest bins by trying everything."""
    best = [len(sizes)]

    def place(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[at] <= capacity and bins[i] not in bins[:i]:
                place(at + 1, [*bins[:i], bins[i] + sizes[at], *bins[i + 1 :]])
        place(at + 1, [*bins, sizes[at]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_few_sequences(seed):
    random.seed(seed)
    capacity = 30
    large = [random.randint(11, 30) for _ in range(random.randint(0, 9))]
    found = best_fit.best_fit(large, capacity)
    assert len(found) == least_bins(sorted(large, reverse=True), capacity)
    sizes = large + [random.randint(1, 10) for _ in range(random.randint(0, 6))]
    found = best_fit.best_fit(sizes, capacity)
    assert sorted(i for b in found for i in b) == list(range(len(sizes))) and all(0 < sum(sizes[i] for i in b) <= capacity for b in found)
    assert all(sum(3 * sizes[i] > capacity for i in b) <= 2 for b in found)
    assert len(found) <= least_bins(sorted(sizes, reverse=True), capacity) + 1
