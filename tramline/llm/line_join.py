"""Line dedup by an exact set-similarity join.

A line is its set of words (A-Z lowered).  Words are ordered by rarity, rarest first; two
sets with Jaccard similarity of ``similarity`` or more share a word among the first few of
both (the prefix).  Lines meet by prefix words; the length filter, the positional filter
and a parity sketch (each word on one side only flips one bit, so the bits that differ are
a lower bound of such words) drop pairs that cannot reach the similarity; the rest is
verified on the lines' whole words.  A line goes if an earlier line (by ``doc_id``, line, row) is similar.

Equal sets are folded before the join: all but the first go at once, and only first lines
join.  Rarity is read from a table of ``2 ** BUCKET_BITS`` levels of corpus counts by word
hash, of fixed size; it only orders words, so a shared bucket costs time and never a pair.
All prefix words are sent, also rare ones: the share that crosses is the same at every size.

Scale: per line about a fifth of its words cross the network as rows of eight numbers.
Lines that meet at a word are compared as a stream; where ``HOT`` lines or more meet, each
is held against the nearest earlier ones only, and lines not settled by those meet all
others in a join that adaptive execution can split.  Only lines with a candidate that the
sketch lets through cross the network for verification, as their distinct words, compressed.

Defined cases: lines without a word are no lines and stay; a null text stays null; ids sort by
their own type, documents without one come first; rows with equal ids are ordered by line,
then by their files and places in them; an empty table gives no rows;
other columns stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.llm.common import discard, flagged, in_order, let, numbered, stored, text_or_empty, utf8, worker_store
from tramline.llm.suffixes import mix

BUCKET_BITS = 23
HOT = 1024
LEADERS = 2
MEETING_ROWS = 1 << 16
SKETCH = [f"bits_{i}" for i in range(4)]
#: Up to this many words the halves of a sketch are folded, which leaves two numbers of zeros to send.
SHORT = 100
#: Up to this many words they are folded to one.
TINY = 40
GROUP_BYTES = 1 << 18
COUNTS_SENT = 1 << 20
#: Levels of rarity, and where line and level stand in the number by which words are sorted.
LEVELS, LEVEL_AT, LINE_AT = 1024, 32, 42
BASE = 0x9E3779B97F4A7C15
SIMILAR = Fraction(4, 5)


def _tables(size: int) -> tuple:
    """Random letters and powers for word hashes of up to ``size`` bytes of text."""
    store = worker_store("line tables")
    if store.get("size", 0) < size:
        letters = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        powers, inverse = np.ones(size + 1, np.uint64), np.ones(size + 1, np.uint64)
        powers[1:], inverse[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        store.update(size=size, all=(letters, np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)))
    return store["all"]


IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line number of every word."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(text.lower(), np.uint8)
    letters, powers, inverse = _tables(len(data))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(np.flatnonzero(data == 0x0A), start)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at line ends into pieces of ``GROUP_BYTES`` or, to the end of a line, more."""
    at = 0
    while (cut := text.find(b"\n", at + GROUP_BYTES)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _groups(texts) -> Iterator[tuple[bytes, np.ndarray]]:
    """Pieces of texts joined by line ends up to about ``GROUP_BYTES``; per piece its text's number, first line and lines."""
    held, told, size = [], [], 0
    for number, text in enumerate(texts):
        base = 0
        for piece in _pieces(text):
            lines = piece.count(b"\n") + 1
            held.append(piece)
            told.append((number, base, lines))
            base, size = base + lines, size + len(piece)
            if size >= GROUP_BYTES:
                yield b"\n".join(held), np.array(told)
                held, told, size = [], [], 0
    if held:
        yield b"\n".join(held), np.array(told)


def rarity_levels(docs: DataFrame, text: str) -> np.ndarray:
    """How often words of each hash bucket stand in the corpus, in 32 levels for each doubling; ``2 ** BUCKET_BITS`` numbers."""
    size = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int32)
        for batch in batches:
            for joined, _ in _groups(t.as_py() for t in batch.column(0)):
                np.add.at(counts, (words(joined)[0] & np.uint64(size - 1)).astype(np.int64), np.int32(1))
        for at in range(0, size, COUNTS_SENT):
            used = np.flatnonzero(counts[at : at + COUNTS_SENT]) + at
            yield pa.record_batch({"bucket": pa.array(used.astype(np.int32)), "n": pa.array(counts[used].astype(np.int64))})

    summed = docs.select(utf8(text)).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    level = F.least(F.floor(F.log2("n") * 32), F.lit(LEVELS - 1)).cast("short")
    told = summed.select("bucket", level.alias("level")).toArrow()
    levels = np.zeros(size, np.uint16)
    levels[told["bucket"].to_numpy()] = told["level"].to_numpy()
    return levels


def prefix_size(size: np.ndarray, similarity: Fraction) -> np.ndarray:
    """How many first words of a set hold a word of every similar set."""
    return size + (-size * similarity.numerator // similarity.denominator) + 1


def _line_sets(levels, similarity: Fraction):
    """One row per line with a word: name of the set, size, prefix words.

    Within a batch equal sets fold into their first line; the others are marked ``again``
    and get a name of their own, since nothing more is asked of them.
    """

    def sets(joined: bytes, told: np.ndarray, doc, row, rarity):
        number, base, lines = told.T
        ends = np.cumsum(lines)
        if ends[-1] >> (64 - LINE_AT):
            raise ValueError("too many lines in a group")
        hashes, line = words(joined)
        level = rarity[(hashes & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64)
        key = (line.astype(np.uint64) << np.uint64(LINE_AT)) | (level << np.uint64(LEVEL_AT)) | (hashes >> np.uint64(32))
        order = np.argsort(key)
        if ((key[order[1:]] == key[order[:-1]]) & (hashes[order[1:]] != hashes[order[:-1]])).any():
            # Words of a line that share their first 32 bits: equal ones must stand together.
            order = np.lexsort((hashes, key))
        hashes, line = hashes[order], line[order]
        new = np.ones(len(line), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
        hashes, line = hashes[new], line[new]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])[: len(line)])
        size = np.diff(np.concatenate([first, [len(line)]]))
        name = mix(np.add.reduceat(mix(hashes), first) + size.astype(np.uint64)) if len(first) else np.empty(0, np.uint64)
        bit = np.uint64(1) << (hashes & np.uint64(63))
        part = (hashes >> np.uint64(6)) & np.uint64(len(SKETCH) - 1)
        sketch = [np.bitwise_xor.reduceat(np.where(part == i, bit, np.uint64(0)), first).astype(np.int64) if len(first) else name.astype(np.int64) for i in range(len(SKETCH))]
        for most, parts in ((SHORT, 2), (TINY, 1)):
            for i in range(parts):
                sketch[i] = np.where(size <= most, sketch[i] ^ sketch[i + parts], sketch[i])
                sketch[i + parts] = np.where(size <= most, 0, sketch[i + parts])
        piece = np.searchsorted(ends, line[first], side="right")
        owner = number[piece]
        # Sets of up to three words are similar to equal ones only.
        take = np.where(size > 3, prefix_size(size, similarity), 0)
        at = np.repeat(first - np.cumsum(take) + take, take) + np.arange(take.sum())
        prefix = (hashes[at] >> np.uint64(32)).astype(np.uint32).astype(np.int32)
        return name.astype(np.int64), doc[owner], row[owner], line[first] - (ends - lines - base)[piece], size, take, prefix, *sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = levels.value
        for batch in batches:
            ids, numbers, texts = batch.columns
            ids, numbers = ids.to_numpy(), numbers.to_numpy()
            parts = [sets(joined, told, ids, numbers, rarity) for joined, told in _groups(t.as_py() for t in texts)]
            if not parts:
                continue
            name, doc, row, line, size, take, prefix, *sketch = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((row, line, doc, name))
            again = np.zeros(len(name), bool)
            again[order[1:]] = name[order[1:]] == name[order[:-1]]
            alone = mix(row.astype(np.uint64) * np.uint64(BASE) + line.astype(np.uint64)).astype(np.int64)
            prefix = prefix[np.repeat(~again, take)]
            offsets = np.concatenate([[0], np.cumsum(np.where(again, 0, take))]).astype(np.int32)
            yield pa.record_batch({
                "name": pa.array(np.where(again, alone, name)), "doc": pa.array(doc), "row": pa.array(row), "line": pa.array(line.astype(np.int32)),
                "size": pa.array(size.astype(np.int32)), "again": pa.array(again), "prefix": pa.ListArray.from_arrays(offsets, pa.array(prefix)),
                **{c: pa.array(np.where(again, 0, x)) for c, x in zip(SKETCH, sketch)},
            })

    return run


def _differing(parts: list[np.ndarray], smaller: np.ndarray) -> np.ndarray:
    """Bits that differ between the sketches of two lines, from their parts' difference and the smaller size."""
    halves = [parts[i] ^ parts[i + 2] for i in (0, 1)]
    bits = np.bitwise_count(halves[0] ^ halves[1]).astype(np.int64)
    for least, kept in ((TINY, halves), (SHORT, parts)):
        at = np.flatnonzero(smaller > least)
        bits[at] = sum(np.bitwise_count(x[at]).astype(np.int64) for x in kept)
    return bits


MEETINGS = "row bigint, line int, row_b bigint, line_b int, word int"


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of as many batches at a time as have ``rows`` rows together."""
    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def _meet(similarity: Fraction):
    """For lines at a word: the nearest earlier ones (``row_b, line_b``) that may be similar.

    Rows come sorted by word and order.  A line is held against up to ``HOT`` lines before it
    at a word and takes up to ``LEADERS`` partners there.  If there are earlier lines that it
    was not held against, one more row tells the word.  Comparing goes by distance in the
    sorted rows, for many rows at once.
    """
    up, down = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, cut = None, 0
        for word_place, row, line_size, *sketch in _gathered(batches, MEETING_ROWS):
            high, low = (lambda x: (x >> 32).astype(np.int32)), (lambda x: (x & 0xFFFFFFFF).astype(np.int32))
            columns = [high(word_place), row, high(line_size), low(line_size), low(word_place), *sketch]
            old = 0
            if carry is not None:
                old = len(carry[0])
                columns = [np.concatenate(c) for c in zip(carry, columns)]
            word, row, line, size, place, *sketch = columns
            # Counting bits takes the absolute value of signed numbers.
            sketch = [x.view(np.uint64) for x in sketch]
            new_word = np.concatenate([[True], word[1:] != word[:-1]])
            start = np.flatnonzero(new_word)[np.cumsum(new_word) - 1]
            at = np.arange(len(word))
            before = at - start
            in_run = before + np.where(start == 0, cut, 0)
            size, rest = size.astype(np.int64), (size - place).astype(np.int64)
            partners, reached = np.zeros(len(word), np.int8), np.full(len(word), HOT)
            active, later, earlier = at[old:], [], []
            for distance in range(1, HOT + 1):
                active = active[before[active] >= distance]
                if not len(active):
                    break
                other = active - distance
                both = size[active] + size[other]
                needed = -(-up * both // (up + down))
                # If this is the first word they share, no more are shared than go on from here in both.
                near = np.flatnonzero((needed <= np.minimum(rest[active], rest[other])) & ((row[active] != row[other]) | (line[active] != line[other])))
                one, two = active[near], other[near]
                differ = [x[one] ^ x[two] for x in sketch]
                fits = _differing(differ, np.minimum(size[one], size[two])) <= (both - 2 * needed)[near]
                one, two = one[fits], two[fits]
                later.append(one)
                earlier.append(two)
                partners[one] += 1
                full = one[partners[one] == LEADERS]
                if len(full):
                    reached[full] = distance
                    active = active[partners[active] < LEADERS]
            more = at[old:][in_run[old:] > reached[old:]]
            later, earlier = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (later, earlier))
            told = np.concatenate([later, more])
            yield pa.record_batch({
                "row": pa.array(row[told]), "line": pa.array(line[told]),
                "row_b": pa.concat_arrays([pa.array(row[earlier]), pa.nulls(len(more), pa.int64())]),
                "line_b": pa.concat_arrays([pa.array(line[earlier]), pa.nulls(len(more), pa.int32())]),
                "word": pa.concat_arrays([pa.nulls(len(later), pa.int32()), pa.array(word[more])]),
            })
            last = start[-1]
            first = max(last, len(word) - HOT)
            cut = (cut if last == 0 else 0) + first - last
            carry = [c[first:] for c in columns]

    return run


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines as their words, each once and in order, compressed: a shuffle's own compression finds nothing to fold in them."""
    for batch in batches:
        rows, lines, said = batch.columns
        folded = [zlib.compress(b" ".join(sorted(set(s.as_py().lower().split()))), 1) for s in said]
        yield pa.record_batch({"row": rows, "line": lines, "said": pa.array(folded, pa.binary())})


def _similar(similarity: Fraction):
    """``row, line`` of the pairs ``row, line, said, said_b`` (of ``_said``) whose words are similar."""
    up, down = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines, said, said_b = batch.columns
            right = []
            for a, b in zip(said, said_b):
                a, b = (set(zlib.decompress(x.as_py()).split()) for x in (a, b))
                right.append(len(a & b) * (up + down) >= up * (len(a) + len(b)))
            right = pa.array(right, pa.bool_())
            yield pa.record_batch({"row": rows.filter(right), "line": lines.filter(right)})

    return run


def _pack(high: str, low: str) -> Column:
    return F.shiftleft(F.col(high).cast("bigint"), 32).bitwiseOR(F.col(low).cast("bigint"))


def _alike(similarity: Fraction) -> Column:
    """Whether sizes and whole sketches of two lines leave it open that they are similar."""
    both = F.col("size") + F.col("size_b")
    needed = F.ceil(both * similarity.numerator / (similarity.numerator + similarity.denominator))
    parts = [F.col(c).bitwiseXOR(F.col(f"{c}_b")) for c in SKETCH]
    halves = [parts[i].bitwiseXOR(parts[i + 2]) for i in (0, 1)]
    smaller = F.least("size", "size_b")
    differ = (
        F.when(smaller <= TINY, F.bit_count(halves[0].bitwiseXOR(halves[1])))
        .when(smaller <= SHORT, F.bit_count(halves[0]) + F.bit_count(halves[1]))
        .otherwise(sum((F.bit_count(p) for p in parts), F.lit(0)))
    )
    return (needed <= smaller) & (differ <= both - 2 * needed)


def _second(df: DataFrame, *shared: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in shared else f"{c}_b") for c in df.columns])


def _verified(likely: DataFrame, texts: DataFrame, similarity: Fraction) -> DataFrame:
    """``row, line`` of lines of which an earlier one is similar; ``likely`` are stored pairs ``row, line, row_b, line_b``, deleted here."""
    asked = likely.select("row", "line").unionByName(likely.select(F.col("row_b").alias("row"), F.col("line_b").alias("line")))
    # What gets through by chance finds no partner.
    asked_rows = flagged(texts.select("row", "text"), asked, ["row"], "asked").filter("asked")
    lines = asked_rows.select("row", F.posexplode(F.split(text_or_empty("text"), "\n")).alias("line", "said"))
    said = flagged(lines, asked, ["row", "line"], "asked").filter("asked")
    said = stored(said.select("row", "line", F.col("said").cast("binary")).mapInArrow(_said, "row bigint, line int, said binary"), "asked_lines")
    both = likely.join(said, ["row", "line"]).join(_second(said), ["row_b", "line_b"]).select("row", "line", "said", "said_b")
    right = stored(both.mapInArrow(_similar(similarity), "row bigint, line int").distinct(), "similar")
    discard(likely, said)
    return right


def removed_lines(texts: DataFrame, similarity: Fraction) -> DataFrame:
    """``row, line`` of every line that goes, of ``texts (doc, row, text)``."""
    levels = texts.sparkSession.sparkContext.broadcast(rarity_levels(texts, "text"))
    schema = "name bigint, doc bigint, row bigint, line int, size int, again boolean, prefix array<int>, " + ", ".join(f"{c} bigint" for c in SKETCH)
    sets = texts.select("doc", "row", utf8("text")).mapInArrow(_line_sets(levels, similarity), schema)
    order = W.partitionBy("name").orderBy("doc", "line", "row")
    ranked = sets.withColumn("again", F.col("again") | (F.row_number().over(order) > 1))
    first = lambda c: F.when(~F.col("again"), F.col(c)).alias(c)
    known = ranked.select("doc", "row", "line", "size", "again", first("prefix"), *map(first, SKETCH))
    # Neighbours of one document compress better, here and in the shuffle that reads them.
    known = stored(known.sortWithinPartitions("doc", "row", "line"), "line_sets")
    lines = known.filter("not again")
    place_of = F.posexplode("prefix").alias("place", "word")
    entries = lines.select("doc", "row", "line", "size", *SKETCH, place_of)
    # Two numbers of 32 bits in one field: half of the bytes that would cross are heads of fields.
    packed = lines.select("doc", "row", _pack("line", "size").alias("line_size"), *SKETCH, place_of).select(
        _pack("word", "place").alias("word_place"), "doc", "row", "line_size", *SKETCH)
    word = F.shiftright("word_place", 32)
    sorted_entries = packed.repartition(word).sortWithinPartitions(word, "doc", "line_size", "row").drop("doc")
    met = stored(sorted_entries.mapInArrow(_meet(similarity), MEETINGS), "meetings")
    pair = ["row", "line", "row_b", "line_b"]
    pairs = stored(met.filter("word is null").select(*pair).distinct(), "pairs")
    close = _verified(pairs, texts, similarity)
    # Not all partners of these lines were looked at, at these words.
    late_places = stored(met.filter("word is not null").select("row", "line", "word").join(close, ["row", "line"], "left_anti"), "late_places")
    discard(met)
    if not late_places.isEmpty():
        hot = stored(flagged(entries, late_places, ["word"], "asked").filter("asked").drop("asked"), "hot_entries")
        # Only the lines asked for cross the network to learn their size and sketch.
        late = flagged(hot, late_places, ["row", "line", "word"], "asked").filter("asked").drop("asked").join(late_places, ["row", "line", "word"], "left_semi")
        before = F.struct("doc_b", "line_b", "row_b") < F.struct("doc", "line", "row")
        rest = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
        both = F.col("size") + F.col("size_b")
        reachable = rest * (similarity.numerator + similarity.denominator) >= both * similarity.numerator
        held = late.join(_second(hot, "word"), "word").filter(before & reachable & _alike(similarity)).select(*pair).distinct()
        late_pairs = stored(held, "late_pairs")
        discard(hot)
        close = close.unionByName(_verified(late_pairs, texts, similarity))
    return known.filter("again").select("row", "line").unionByName(close)


def find_repeated_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", similarity: Fraction = SIMILAR) -> DataFrame:
    """Per document: id, ``n_lines`` (lines with a word) and the numbers of the ``removed`` ones."""
    texts = in_order(numbered(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))))
    gone = _gone(texts.select("doc", "row", "text"), similarity)
    filled = F.size(F.filter(F.split(text_or_empty("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counted = texts.select(F.col("id").alias(doc_id), "row", filled.cast("bigint").alias("n_lines"))
    return counted.join(gone, "row", "left").select(f"`{doc_id}`", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def _gone(texts: DataFrame, similarity: Fraction) -> DataFrame:
    lines = removed_lines(texts, similarity)
    return lines.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", similarity: Fraction = SIMILAR) -> DataFrame:
    """All documents without the lines that an earlier one resembles; all columns stay."""
    carried = numbered(docs.select(F.struct("*").alias("record")))
    texts = in_order(carried.select(F.col(f"record.`{doc_id}`").alias("id"), "row", F.col(f"record.`{text}`").alias("text")))
    gone = stored(_gone(texts, similarity), "gone_lines")
    told = flagged(carried, gone, ["row"], "loses")
    # Documents that lose nothing stay where they are.
    joined = told.filter("loses").join(gone, "row", "left")
    value = F.col(f"record.`{text}`")
    rest = let(F.split(value, "\n"), lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)), "\n"))
    cut = F.when(F.col("removed").isNotNull(), rest).otherwise(value)
    changed = joined.select(*[(cut if c == text else F.col(f"record.`{c}`")).alias(c) for c in docs.columns])
    whole = told.filter("not loses").select(*[F.col(f"record.`{c}`").alias(c) for c in docs.columns])
    return changed.unionByName(whole)
