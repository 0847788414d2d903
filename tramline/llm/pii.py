"""Personal data: base patterns, and terms that reveal whose data it is.

Base spans (email, ip, card, phone) come from patterns, per kind, leftmost and without
overlap, in code points.  What a span says (its normal form) is a protected entity.  Terms
disclose an entity as far as the corpus lets one conclude from the term to the entity:
with ``n(e,t)`` documents that hold both ``e`` and ``t``, on whatever lines, ``n(t)``
documents with ``t``, ``n(e)`` with ``e`` and ``n`` in all, the disclosure is
``log2(n(e,t) n / (n(e) n(t)))`` bits of the ``log2(n / n(e))`` bits that the entity has,
and ``n(e,t) / n(t)`` is the chance to be right.  Only evidence counts: with ``u`` different
texts that hold both, the chance is taken at its lower bound (Wilson's, at ``z``) for
``u`` co-occurrences, and the pair has to be unlikely by coincidence: ``u / chance`` draws
at the rate ``n(e) / n`` give as many hits with probability ``level`` at most, over all pairs
looked at (Chernoff's bound, which holds for draws without replacement, divided by the pairs).
So copies are no evidence, and neither is one coincidence.  Terms whose lower bound is
``min_chance`` or more and discloses at least ``share`` of an entity's bits are spans of kind
``term`` wherever they stand, in documents without the entity too: removed from a chance of
``remove_from`` on, generalised below it.

Scale: patterns run only on lines with a digit or ``@`` and no match crosses a line;
documents with spans are few and checkpointed with their terms.  The terms of all texts are
found once and written.  Pairs of entity and term grow with the documents that hold an
entity and are folded per task before the shuffle; those that could not pass with the best
chance go first, and document frequencies are counted for the terms of the others, found by
a bit table of fixed size.  So are the words that meet the told terms.  All joins are plain
ones that adaptive execution can split.

Defined cases: a null or empty text has no spans; every row counts as a document, rows that
agree in id and text too, and such rows get the same spans; documents without an id are told
apart by text; an entity in all documents has no bits to disclose; an empty table gives no
rows; other columns are ignored here and kept by ``sanitise``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import discard, doc_key, flagged, let, running, running_sums, stored, text_or_empty
from tramline.session import materialise

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: Equal in matches to the plain forms; runs are taken whole, so no text makes them slow.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
#: A word of letters between blanks, with marks around it at most; so never inside a span.
TERM = r"(?<![^\s(\[\"'])\p{L}{3,}(?=[.,;:!?\"')\]]*(?:\s|$))"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start, end, value>>``, in code points from 0, end exclusive."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def placed(found: Column) -> Column:
        before = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(before, 1, F.size(found)), found, lambda b, m: (F.char_length(b) + F.char_length(m)).cast("bigint"))
        return let(running_sums(steps), lambda ends: F.transform(
            found, lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value")),
        ))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the check sum: every second one from the right counts double."""
    def total(back: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.char_length(back)), lambda i: let(
            F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    return let(F.reverse(digits(value)), total) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def spans_of(kind: str, line: Column) -> Column:
    """Valid spans of one kind in a line: ``array<struct<kind, start, end, value>>``."""
    valid = F.filter(matches(line, PATTERNS[kind]), lambda s: is_valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(line: Column) -> Column:
    return F.flatten(F.array(*[spans_of(kind, line) for kind in KINDS]))


def entity(kind: Column, value: Column) -> Column:
    """The normal form of what a span says."""
    said = F.when(kind.isin("card", "phone"), digits(value)).otherwise(F.lower(value))
    return F.concat(kind, F.lit(":"), said)


def terms_of(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def holders(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, key, copies, spans, terms`` of every different document with a base span; ``copies`` are its rows."""
    value = text_or_empty(text)
    lines = F.split(value, "\n")
    placed = let(lines, lambda x: let(
        running_sums(F.transform(x, lambda line: (F.char_length(line) + 1).cast("bigint"))),
        lambda ends: F.filter(
            F.transform(x, lambda line, i: F.struct(line.alias("line"), (F.get(ends, i) - F.char_length(line) - 1).alias("at"))),
            lambda e: e["line"].rlike("[0-9@]")),
    ))
    spans = F.flatten(F.transform(placed, lambda e: F.transform(base_spans(e["line"]), lambda s: F.struct(
        s["kind"].alias("kind"), (e["at"] + s["start"]).alias("start"), (e["at"] + s["end"]).alias("end"), s["value"].alias("value")))))
    # Exploding the one array keeps the optimiser from finding the spans twice.
    some = docs.filter(value.rlike("[0-9@]")).select(F.col(doc_id).alias("doc_id"), doc_key(text).alias("key"), value.alias("text"), F.explode(F.array(spans)).alias("spans"))
    found = some.filter(F.size("spans") > 0).select("doc_id", "key", "spans", terms_of(F.col("text")).alias("terms"))
    return materialise(found.groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.first("spans").alias("spans"), F.first("terms").alias("terms")))


def all_terms(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, key, terms`` of every row, as a table that the later passes read."""
    return stored(docs.select(F.col(doc_id).alias("doc_id"), doc_key(text).alias("key"), terms_of(text_or_empty(text)).alias("terms")), "terms")


def lower_bound(hits: Column, chance: Column, z: float) -> Column:
    """Wilson's lower bound of a chance seen in ``hits / chance`` draws."""
    n = hits / chance
    return (chance + z * z / (2 * n) - z * F.sqrt(chance * (1 - chance) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def surprise(hits: Column, chance: Column, base: Column) -> Column:
    """A lower bound of ``-ln`` of the probability that ``hits / chance`` draws at the rate ``base`` hit that often."""
    missed = F.when(chance < 1, (1 - chance) * F.ln((1 - chance) / (1 - base))).otherwise(0.0)
    return F.when(chance > base, hits / chance * (chance * F.ln(chance / base) + missed)).otherwise(0.0)


def disclosures(
    terms: DataFrame, held: DataFrame, *, share: float = 0.5, min_chance: float = 0.5, z: float = 1.96, level: float = 0.01,
) -> DataFrame:
    """``entity, term, bits, chance`` of the pairs over the thresholds; ``entity`` is the hash of its normal form.

    ``terms`` are those of all rows, ``held`` the documents with spans.
    """
    said = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(entity(s["kind"], s["value"]))))
    texts = held.groupBy("key").agg(F.sum("copies").alias("copies"), F.first(said).alias("said"), F.first("terms").alias("terms"))
    named = texts.select("copies", "terms", F.explode("said").alias("entity"))
    entities = named.groupBy("entity").agg(F.sum("copies").alias("n_e"))
    total = terms.count()
    looked_at = texts.agg(F.sum(F.size("said").cast("double") * F.size("terms"))).first()[0] or 0.0
    if not looked_at:
        return named.limit(0).select("entity", F.lit("").alias("term"), F.lit(0.0).alias("bits"), F.lit(0.0).alias("chance"))
    needed = math.log(looked_at / level)
    base, one = F.col("n_e") / F.lit(total), F.lit(1.0)
    pairs = named.select("entity", "copies", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("u"))
    # Whatever n(t) is, a pair that fails at a chance of one fails.
    open_pairs = pairs.filter(lower_bound(F.col("u"), one, z) >= min_chance).join(entities, "entity")
    open_pairs = materialise(open_pairs.filter((base < 1) & (surprise(F.col("u"), one, base) >= needed)))
    words = terms.select(F.explode("terms").alias("term"))
    frequency = flagged(words, open_pairs, ["term"], "asked").filter("asked").groupBy("term").agg(F.count("*").alias("n_t"))
    rated = open_pairs.join(frequency, "term").withColumn("chance", F.col("n_et") / F.col("n_t")).withColumn("sure", lower_bound(F.col("u"), F.col("chance"), z))
    bits, own = F.log2(F.col("sure") / base), F.log2(1 / base)
    told = rated.filter((F.col("sure") >= min_chance) & (surprise(F.col("u"), F.col("chance"), base) >= needed) & (bits >= share * own))
    return told.select("entity", "term", bits.alias("bits"), "chance")


SPANS = "array<struct<rank:int,kind:string,start:bigint,end:bigint,label:string>>"


def span(rank: Column, kind: Column, found: Column, label: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), kind.alias("kind"), found["start"].alias("start"), found["end"].alias("end"), label.alias("label"))


def term_spans(
    docs: DataFrame, every: DataFrame, told: DataFrame, *, text: str = "text", doc_id: str = "doc_id", remove_from: float = 0.9,
) -> DataFrame:
    """``doc_id, key, spans`` of every different document with a ``told`` term; ``every`` (of ``all_terms``) is deleted."""
    # Only documents with a told term have their words placed, which costs the most.
    some = flagged(every.select("doc_id", "key", F.explode("terms").alias("term")), told, ["term"], "asked").filter("asked")
    held = some.join(told, "term").groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("term", "chance"))).alias("told"))
    held = stored(held.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "told"), "term_holders")
    discard(every)
    named = docs.select(F.col(doc_id).alias("__id"), doc_key(text).alias("__key"), text_or_empty(text).alias("text"))
    asked = flagged(named, held, ["__id", "__key"], "asked").filter("asked").select(F.col("__id").alias("doc_id"), F.col("__key").alias("key"), "text")
    both = asked.join(held, [F.col("doc_id").eqNullSafe(F.col("__id")), F.col("key") == F.col("__key")])
    chance = lambda w: F.try_element_at("told", F.lower(w["value"]))
    places = F.filter(matches(F.col("text"), TERM), lambda w: chance(w).isNotNull())
    spans = F.transform(places, lambda w: span(F.lit(len(KINDS)), F.lit("term"), w, F.when(chance(w) >= remove_from, F.lit("")).otherwise(F.lit("[TERM]"))))
    return both.select("doc_id", "key", spans.alias("spans")).dropDuplicates(["doc_id", "key"])


def find_private(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", share: float = 0.5, min_chance: float = 0.5, remove_from: float = 0.9,
    z: float = 1.96, level: float = 0.01,
) -> DataFrame:
    """``doc_id, key, spans`` per different document; spans by kind as listed, terms last, then by start."""
    held, every = holders(docs, text=text, doc_id=doc_id), all_terms(docs, text=text, doc_id=doc_id)
    # One term may be told by several entities: the strictest treatment holds.
    pairs = disclosures(every, held, share=share, min_chance=min_chance, z=z, level=level)
    told = materialise(pairs.groupBy("term").agg(F.max("chance").alias("chance")))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    base = held.select("doc_id", "key", F.transform("spans", lambda s: span(
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]) - 1, s["kind"], s, F.element_at(label, s["kind"]))).alias("spans"))
    terms = term_spans(docs, every, told, text=text, doc_id=doc_id, remove_from=remove_from)
    spans = base.unionByName(terms).groupBy("doc_id", "key").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), doc_key(text).alias("key"))
    joined = rows.join(spans.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "spans"), [F.col("doc_id").eqNullSafe(F.col("__id")), F.col("key") == F.col("__key")], "left")
    return joined.select("doc_id", "key", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")).withColumnRenamed("doc_id", doc_id)


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its label; a span inside or across an earlier one goes with it."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))

    def pieces(s: Column) -> Column:
        return let(running(F.transform(s, lambda x: x["end"]), F.greatest), lambda ends: F.concat(
            F.array_join(F.transform(s, lambda x, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint")), lambda before: F.when(
                x["start"] >= before, F.concat(F.substr(text, (before + 1).cast("int"), (x["start"] - before).cast("int")), x["label"])).otherwise(F.lit("")))), ""),
            F.substr(text, (F.get(ends, F.size(ends) - 1) + 1).cast("int"))))

    return F.when(F.size(spans) > 0, let(ordered, pieces)).otherwise(text)


def sanitise(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """All documents with their private spans replaced; all columns stay."""
    found = find_private(docs, text=text, doc_id=doc_id, **options).dropDuplicates([doc_id, "key"])
    told = found.select(F.col(doc_id).alias("__id"), F.col("key").alias("__key"), F.col("spans").alias("__spans")).filter(F.size("__spans") > 0)
    joined = docs.withColumn("__doc_key", doc_key(text)).join(told, [F.col(doc_id).eqNullSafe(F.col("__id")), F.col("__doc_key") == F.col("__key")], "left")
    return joined.withColumn(text, F.when(F.col("__spans").isNotNull(), replaced(F.col(text), F.col("__spans"))).otherwise(F.col(text))).drop("__id", "__key", "__doc_key", "__spans")
