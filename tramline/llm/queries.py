"""One query per operator over the given tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import (
    best_fit, classifier, collocations, decontaminate, line_join, pack, pii, quality_rules, shards, simhash, suffixes, token_counts, whitening,
)
from tramline.session import new_folder

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_decontaminate(spark, d):
    """Hit words, hit items and the verdict of every document."""
    docs = documents(spark, d).select("doc_id", "text")
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet"), window=13, out="found")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.is_contaminated("found", 20).alias("contaminated"))


def op2_quality_rules(spark, d):
    """Base counts, common words and lines, and the verdict of every document."""
    return quality_rules.quality_rules(documents(spark, d), min_docs=20, share=0.005, min_words=20, max_repeated=30, max_lost=0.5)


def op3_line_dedup(spark, d):
    """Which lines of each document an earlier line resembles (Jaccard 0.8 or more)."""
    found = line_join.find_repeated_lines(documents(spark, d), similarity=line_join.SIMILAR)
    return found.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op4_token_counts(spark, d):
    """For every length that occurs: documents, and totals with that length as context limit."""
    histogram = token_counts.length_histogram(documents(spark, d), tokenizer_path())
    return token_counts.limit_table(token_counts.suffix_sums(histogram))


def op5_simhash_dedup(spark, d):
    """Fingerprint and component of every document."""
    grouped = simhash.group(documents(spark, d), width=3, radius=2)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark, d):
    """What stays of every document's bytes."""
    settled = suffixes.without_repeats(documents(spark, d), length=100)
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    return settled.select(
        "doc_id", "n_bytes", F.coalesce(F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark, d):
    """Every document's pieces in windows of 2,048 ids."""
    pieces = pack.with_digest(pack.pack(documents(spark, d), tokenizer_path(), capacity=2048, end_id=1))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_quality_classifier(spark, d):
    """Score and verdict of every document."""
    return classifier.classify(documents(spark, d).select("doc_id", "text"), sample=6000).select("doc_id", F.round("score", 9).alias("score"), "kept")


def op9_pii(spark, d):
    """Private spans of every document: counts of the base kinds and all places."""
    found = pii.find_private(documents(spark, d))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "term")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, place), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", place), ",").alias("spans"))


def op10_sharding(spark, d):
    """Shard and slot of every document in 40 written shards with row counts one apart at most."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = (F.octet_length(text) + 16).cast("bigint")
    written = shards.write_shards(documents(spark, d), new_folder(spark, "shards"), 40, size=size)
    return written.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark, d):
    """Whitened values of every usable vector, one row for each component."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=4, scale=256)
    shares = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    white = model.apply(vectors, out="white").select("vec_id", "white.*")
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), F.col("deviation").cast("bigint").alias("deviation"),
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op12_collocations(spark, d):
    """The first 2,000 phrases of two or three words in every language."""
    found = collocations.collocations(documents(spark, d), max_words=3, min_count=10, share=50, limit=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_best_fit(spark, d):
    """Whole documents in sequences of 4,096 ids."""
    pieces = best_fit.pack_whole(documents(spark, d), tokenizer_path(), capacity=4096, end_id=1)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_quality_rules, op3_line_dedup, op4_token_counts, op5_simhash_dedup, op6_suffix_dedup, op7_packing,
    op8_quality_classifier, op9_pii, op10_sharding, op11_whitening, op12_collocations, op13_best_fit,
)}

OP1_SQL = r"""
WITH item_words AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS run
    FROM item_words, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i)
    WHERE len(w) > 0
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), doc_windows AS (
    SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS run
    FROM docs, (SELECT DISTINCT size FROM item_windows) s, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)
    WHERE len(w) >= size
), hits AS (
    SELECT r, i, d.size, item FROM doc_windows d JOIN item_windows t ON d.size = t.size AND d.run = t.run
), hit_words AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + size)) AS p) GROUP BY r
), hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP2_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(w[i:i + 7], ' ') AS run FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT r, count(DISTINCT p) AS n FROM again, LATERAL (SELECT unnest(range(i, i + 8)) AS p) GROUP BY r
), lines AS (
    SELECT r, host, t, line, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS normal,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), doubled AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), hosts AS (
    SELECT host, count(DISTINCT t) AS n FROM docs GROUP BY host
), common AS (
    SELECT host, normal FROM (SELECT host, normal, count(DISTINCT t) AS n FROM lines GROUP BY host, normal) c JOIN hosts h USING (host)
    WHERE c.n > 20 AND c.n > h.n * 0.005
), lost AS (
    SELECT r, sum(n)::BIGINT AS words, count(*) AS lines FROM lines SEMI JOIN common USING (host, normal) GROUP BY r
), counted AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(doubled.n, 0)::BIGINT AS n_dup_lines,
        coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.words, 0)::BIGINT AS n_common_words, coalesce(lost.lines, 0)::BIGINT AS n_common_lines
    FROM docs LEFT JOIN doubled USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND NOT (n_common_words > 0 AND (n_words - n_common_words < 20 OR n_common_words > n_words * 0.5)) AS kept FROM judged
"""

OP12_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), words AS (
    SELECT p, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces
), suffixes AS (
    SELECT lang, w1, lead(w1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3 FROM words WINDOW piece AS (PARTITION BY p ORDER BY i)
), singles AS (
    SELECT lang, w1, count(*) AS f FROM suffixes GROUP BY ALL
), pairs AS (
    SELECT lang, w1, w2, count(*) AS f FROM suffixes WHERE w2 IS NOT NULL GROUP BY ALL
), triples AS (
    SELECT lang, w1, w2, w3, count(*) AS f FROM suffixes WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM singles GROUP BY lang
), cuts AS (
    SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r
    FROM pairs c JOIN singles x ON x.lang = c.lang AND x.w1 = c.w1 JOIN singles y ON y.lang = c.lang AND y.w1 = c.w2 WHERE c.f >= 10
    UNION ALL
    SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, x.f, y.f
    FROM triples c JOIN singles x ON x.lang = c.lang AND x.w1 = c.w1 JOIN pairs y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
    UNION ALL
    SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f
    FROM triples c JOIN pairs x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN singles y ON y.lang = c.lang AND y.w1 = c.w3
), best AS (
    SELECT *, (a::HUGEINT * a * 1000000 // (l::HUGEINT * r))::BIGINT AS score FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY a::HUGEINT * a * 1000000 // (l::HUGEINT * r), k) = 1
), longer AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, w1 || ' ' || w2 AS phrase, f FROM triples UNION ALL SELECT lang, w2 || ' ' || w3, f FROM triples) GROUP BY ALL
), ranked AS (
    SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM best LEFT JOIN longer USING (lang, phrase) WHERE f IS NULL OR 100 * f < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op1_decontaminate": OP1_SQL, "op2_quality_rules": OP2_SQL, "op12_collocations": OP12_SQL}
