"""Quality rules: base counts of a text, and lines that many documents of a host share.

Lines are normalised (lowered, white space folded) and hashed; per host the documents that
hold a line are counted; lines over the limit are removed, and documents left with too
little are rejected.  A line is over the limit when more than ``min_docs`` documents and
more than ``share`` of the host's documents hold it.  Texts that are equal count as one
document of a host, so copies alone make no line common.

Scale: one pass over the texts gives a narrow table (counts, line hashes), which is
checkpointed; all shuffles move hashes.  A line counts once per document before the
shuffle; (host, line) spreads a hot host over all tasks; a hot line's rows meet the short
list of common lines in a semi join that adaptive execution can split.  Two different
lines or windows taken for equal need a collision of 64 bits.

Defined cases: a null text has no words and fails the base rule; a null host is the host
``''``; repeated rows are judged each and give the same result; an empty table gives no
rows; other columns are ignored here and kept by ``without_common_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import doc_key, let, text_or_empty
from tramline.session import materialise

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside runs of ``width`` words that the text holds twice or more."""
    none = F.array().cast("array<bigint>")
    hashes = F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))),
    ).otherwise(none)

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-width).cast("bigint").alias("last"))
        return F.aggregate(
            places, start,
            lambda a, p: F.struct((a["total"] + F.least(F.lit(width).cast("bigint"), p - a["last"])).alias("total"), p.alias("last")),
            lambda a: a["total"],
        )

    def places(ordered: Column) -> Column:
        same = F.filter(ordered, lambda e, i: F.coalesce(F.get(ordered, i - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(ordered, i + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, lambda o: covered(places(o)))).otherwise(F.lit(0).cast("bigint"))

    return let(hashes, count)


def base_counts(text: Column) -> Column:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text as a struct."""
    filled = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(filled, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    ))


def hashed_lines(text: Column) -> Column:
    """Per line with a word: its place, the hash of its normal form and its words."""
    normal = F.transform(F.split(text, "\n"), lambda line: F.trim(F.lower(F.regexp_replace(line, BLANKS, " "))))
    parts = F.transform(normal, lambda n, i: F.struct(
        i.alias("place"), F.xxhash64(n).alias("h"), (F.char_length(n) - F.char_length(F.translate(n, " ", "")) + 1).alias("w"), (n != "").alias("filled"),
    ))
    return F.filter(parts, lambda p: p["filled"])


def measure(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """The narrow table of counts and line hashes, one row per document row, checkpointed."""
    value = text_or_empty(text)
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), doc_key(host, text).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(value).alias("copy"), base_counts(value).alias("base"), hashed_lines(value).alias("lines"),
    )
    return materialise(narrow.withColumn("row", F.monotonically_increasing_id()))


def common_lines(measured: DataFrame, *, min_docs: int = 20, share: float = 0.005) -> DataFrame:
    """``host, h`` of the lines over the limit."""
    held = measured.select("host", "copy", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = held.groupBy("host", "h").agg(F.count_distinct("copy").alias("n")).filter(F.col("n") > min_docs)
    hosts = measured.groupBy("host").agg(F.count_distinct("copy").alias("docs"))
    return counts.join(hosts, "host").filter(F.col("n") > F.col("docs") * F.lit(share)).select("host", "h")


def removed_lines(measured: DataFrame, **limits) -> DataFrame:
    """Every line of every document that is over its host's limit: ``row, doc_id, key, place, w``."""
    lines = measured.select("row", "doc_id", "key", "host", F.explode("lines").alias("x")).select("row", "doc_id", "key", "host", "x.h", "x.place", "x.w")
    return lines.join(common_lines(measured, **limits), ["host", "h"], "left_semi")


def judge(measured: DataFrame, removed: DataFrame, *, min_words: int = 20, max_repeated: int = 30, max_lost: float = 0.5) -> DataFrame:
    """Base counts with ``base_failed``, words in removed lines and ``kept``."""
    lost = removed.groupBy("row").agg(F.sum("w").cast("bigint").alias("n_common_words"), F.count("*").alias("n_common_lines"))
    judged = measured.drop("lines").join(lost, "row", "left").fillna(0, ["n_common_words", "n_common_lines"]).select("doc_id", "key", "base.*", "n_common_words", "n_common_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("n_common_words")
    depleted = (F.col("n_common_words") > 0) & ((left < min_words) | (F.col("n_common_words") > F.col("n_words") * F.lit(max_lost)))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def quality_rules(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source", min_docs: int = 20, share: float = 0.005, **verdict) -> DataFrame:
    """Per document: id, base counts, ``base_failed``, words and lines removed, ``kept``."""
    measured = measure(docs, text=text, doc_id=doc_id, host=host)
    return judge(measured, removed_lines(measured, min_docs=min_docs, share=share), **verdict).drop("key").withColumnRenamed("doc_id", doc_id)


def without_common_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source", min_docs: int = 20, share: float = 0.005, **verdict) -> DataFrame:
    """The kept documents without their common lines; all columns stay."""
    measured = measure(docs, text=text, doc_id=doc_id, host=host)
    removed = removed_lines(measured, min_docs=min_docs, share=share)
    # Repeated rows share doc_id and key; they hold the same lines and get the same verdict.
    verdicts = judge(measured, removed, **verdict).groupBy("doc_id", "key").agg(F.max("kept").alias("__kept"))
    places = removed.groupBy("doc_id", "key").agg(F.collect_set("place").alias("__places"))
    told = verdicts.filter("__kept").join(places, [verdicts["doc_id"].eqNullSafe(places["doc_id"]), verdicts["key"] == places["key"]], "left").select(
        verdicts["doc_id"].alias("__id"), verdicts["key"].alias("__key"), "__places")
    lines = F.split(F.col(text), "\n")
    rest = let(lines, lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__places")), lambda p: F.get(x, p)), "\n"))
    keyed = docs.withColumn("__doc_key", doc_key(host, text))
    joined = keyed.join(told, [F.col(doc_id).eqNullSafe(F.col("__id")), F.col("__doc_key") == F.col("__key")], "inner")
    return joined.withColumn(text, F.when(F.size("__places") > 0, rest).otherwise(F.col(text))).drop("__id", "__key", "__doc_key", "__places")
