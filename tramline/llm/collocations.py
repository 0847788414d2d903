"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are cut into pieces at punctuation and line ends, pieces into words.  Every word starts
a suffix of at most ``max_words`` words that ends with its piece.  A task collects a block of
words as numbers, folds equal suffixes and sends them on by their leading words: all suffixes
of one leading word meet in one task.  There pointers to the suffixes are sorted by multikey
quicksort, from the leading word's partition on: a partition is split into smaller, equal and
larger ones by the word at its depth, the equal one goes one word deeper, down to the maximum
depth.  An equal partition holds just the occurrences of one phrase, so its size is the
phrase's count; a partition of less than ``min_count`` is abandoned at once, whatever is in it.
All partitions of a round are split together, as arrays.

Scale: a first narrow pass finds the very common words and pairs, those that hold at least one
in ``HOT_SHARE`` of all words: their number is bounded by that, and only balance depends on it.
Their suffixes are dealt to as many parts as they hold such shares, by the next word, so that
each phrase is still in one part; the lead's own count travels apart.  One shuffle moves the
suffixes, a row for each leading word of a block.  Both sides hold a block at a time; leading
words arrive in order, so that a block ends between two of them.  Should one alone exceed a
block, its counts are passed on piece by piece, none abandoned, and the final sum by phrase
completes them.  All later steps see frequent phrases only, since no part of a frequent
phrase is less frequent.  Cuts find their parts by equi-joins, which adaptive execution splits
where one word is in many phrases.  The first phrases of a language are found per slice of its
phrases and then among the slices' firsts.

Defined cases: a null text is empty and a null language is ``und``; empty and repeated rows,
null and repeated ids are rows like others; an empty table gives no phrases.  Other columns are
not needed and dropped.  Letters beyond A-Z keep their case.  ``max_words`` is 2 or more.  One piece is held by one task as
a whole, however long.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.llm.common import stored, utf8

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
#: Lower case, blanks as spaces, and a byte that no text holds for the separators.
LETTERS = bytes.maketrans(UPPER + b"\t" + SEPARATORS, UPPER.lower() + b" " + b"\xff" * len(SEPARATORS))
NEXT_SEPARATOR = re.compile(b"[" + re.escape(SEPARATORS) + b"]")
CHUNK_BYTES = 4 << 20
#: Words and pairs that make up one in so many of all words are routed in parts.
HOT_SHARE = 8192
#: Slices per language when the first phrases are sought.
SLICES = 256
OUT_ROWS = 1 << 16


def chunks(text: bytes) -> Iterator[bytes]:
    """The text in parts of some megabytes, cut at separators."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        found = NEXT_SEPARATOR.search(text, at + CHUNK_BYTES)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def equal_partitions(keys: np.ndarray, weights: np.ndarray, lengths: np.ndarray, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort; gives (depth, one pointer each, sizes) of equal partitions.

    ``keys[d, p]`` is the key of pointer ``p`` at depth ``d``; 0 is the end, behind which a
    pointer has no more keys.  The first ``lengths[0]`` pointers are one partition to begin with,
    the next ``lengths[1]`` another.  Depth ``d`` stands for equal keys 0 to ``d``.  A size is a
    sum of weights; partitions below ``least`` are abandoned.
    """
    deepest, width = len(keys) - 1, keys.shape[1]
    flat, pointers, depths = keys.reshape(-1), np.arange(width), np.zeros(len(lengths), np.int64)
    while len(pointers):
        starts = np.cumsum(lengths) - lengths
        part = np.repeat(np.arange(len(lengths)), lengths)
        key = flat[np.repeat(depths * width, lengths) + pointers]
        pivots = np.sort([key[starts], key[starts + lengths // 2], key[starts + lengths - 1]], axis=0)[1]
        pivot, ended = pivots[part], pivots == 0
        rounds = []
        for mask, more in ((key < pivot, 0), (key > pivot, 0), (key == pivot, 1)):
            members = np.bincount(part[mask], minlength=len(lengths))
            some = pointers[mask]
            after = np.cumsum(members)
            sizes = _ranges(weights[some], after - members, after)
            kept = (members > 0) & (sizes >= least)
            if more:
                kept &= ~ended
                for depth in np.unique(depths[kept]):
                    here = kept & (depths == depth)
                    yield int(depth), some[(after - members)[here]], sizes[here]
                kept &= depths < deepest
            rounds.append((some[np.repeat(kept, members)], members[kept], depths[kept] + more))
        pointers, lengths, depths = (np.concatenate(x) for x in zip(*rounds))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[start:end]``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[ends] - sums[starts]


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where a column differs from the one before."""
    return np.flatnonzero(np.any(np.diff(rows, axis=1, prepend=-1) != 0, axis=0))


class _Block:
    """Words of many texts as numbers; 0 ends a piece."""

    def __init__(self, max_words: int):
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.numbers = defaultdict(count(1).__next__, {b"\xff": 0})
        self.langs = defaultdict(count(1).__next__)
        self.ids: list[np.ndarray] = []
        self.lang_ids: list[tuple[int, int]] = []
        self.words = 0

    def add(self, lang: str, chunk: bytes) -> None:
        words = chunk.translate(LETTERS).replace(b"\xff", b" \xff ").split()
        words.append(b"\xff")
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.lang_ids.append((self.langs[lang], len(words)))
        self.words += len(words)

    def suffixes(self, longest: int) -> np.ndarray:
        """Languages (row 0) and up to ``longest`` words of every suffix, 0 behind its end."""
        ids = np.concatenate([*self.ids, np.zeros(longest, np.int64)])
        keys = np.zeros((longest + 1, self.words), np.int64)
        keys[0] = np.repeat(*np.array(self.lang_ids).T)
        keys[1] = ids[: self.words]
        for d in range(2, longest + 1):
            keys[d] = np.where(keys[d - 1] == 0, 0, ids[d - 1 : self.words + d - 1])
        return keys[:, keys[1] > 0]

    def spelled(self) -> pa.Array:
        """The word of every number; the end of a piece, number 0, spells nothing."""
        return pa.array([b"", *list(self.numbers)[1:]], pa.binary()).view(pa.string())

    def names(self) -> pa.Array:
        return pa.array(["", *self.langs], pa.string())


def _folded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different columns in order, and how often each occurs."""
    code, span = keys[0], int(keys[0].max(initial=0)) + 1
    for row in keys[1:]:
        width = int(row.max(initial=0)) + 1
        if span * width >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            span = len(found)
        code, span = code * width + row, span * width
    _, firsts, counts = np.unique(code, return_index=True, return_counts=True)
    return keys[:, firsts], counts


def _phrases(spelled: pa.Array, rows: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*[spelled.take(pa.array(r)) for r in rows], " ")


def _blocks(batches: Iterator[pa.RecordBatch], max_words: int, block_words: int) -> Iterator[_Block]:
    block = _Block(max_words)
    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            for chunk in chunks(value.as_py()):
                block.add(name, chunk)
                if block.words >= block_words:
                    yield block
                    block.clear()
    if block.words:
        yield block


def _survey(named: DataFrame, max_words: int, block_words: int) -> DataFrame:
    """``lang, words, phrase, a``: all words of a language (no phrase), and words and pairs that are common in a block."""
    def run(batches):
        for block in _blocks(batches, max_words, block_words):
            keys, spelled, names = block.suffixes(2), block.spelled(), block.names()
            least = max(2, keys.shape[1] // (2 * HOT_SHARE))
            totals = np.bincount(keys[0], minlength=len(names))[1:]
            yield pa.record_batch({"lang": names[1:], "words": pa.array([0] * len(totals), pa.int32()), "phrase": pa.array([""] * len(totals)), "a": pa.array(totals)})
            times = np.bincount(keys[1])
            pairs = keys[1:, (times[keys[1]] >= least) & (keys[2] > 0)]
            for size, found, counts in ((1, np.arange(len(times))[None], times), (2, *_folded(pairs))):
                found, counts = found[:, counts >= least], counts[counts >= least]
                yield pa.record_batch({
                    "lang": pa.nulls(len(counts), pa.string()), "words": pa.array(np.full(len(counts), size, np.int32)),
                    "phrase": _phrases(spelled, found), "a": pa.array(counts),
                })

    return named.mapInArrow(run, "lang string, words int, phrase string, a bigint").groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))


Hot = dict[tuple[bytes, ...], int]


def _led(block: _Block, hot: Hot) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words in the lead, folded suffixes, counts, parts): those of a very common lead in parts from 1 on, its count in part 0."""
    keys, counts = _folded(block.suffixes(block.max_words))
    order = np.fromiter(map(crc32, block.numbers), np.int64, len(block.numbers))
    parts = np.zeros(keys.shape[1], np.int64)
    for size in (1, 2):
        shares = np.zeros(keys.shape[1], np.int64)
        if size < block.max_words and len(counts):
            width = int(keys[1:].max()) + 1
            lead = keys[1] if size == 1 else keys[1] * width + keys[2]
            known = {}
            for phrase, share in hot.items():
                numbers = [block.numbers.get(w, 0) for w in phrase]
                if len(phrase) == size and all(numbers):
                    known[numbers[0] if size == 1 else numbers[0] * width + numbers[1]] = share
            codes = np.array(sorted(known), np.int64)
            at = np.searchsorted(codes, lead)
            if len(codes):
                at = np.minimum(at, len(codes) - 1)
                shares = np.where(codes[at] == lead, np.array([known[c] for c in codes.tolist()])[at], 0)
        split = shares > 0
        # What the lead before was dealt into parts stays there, unless this longer one is split too.
        again = np.lexsort((parts[~split], *keys[size - 1 : 0 : -1, ~split], keys[0, ~split])) if size > 1 else slice(None)
        yield max(1, size - 1), keys[:, ~split][:, again], counts[~split][again], parts[~split][again]
        keys, counts, shares = keys[:, split], counts[split], shares[split]
        firsts = _starts(keys[: size + 1])
        if len(firsts):
            alone = keys[:, firsts]
            alone[size + 1 :] = 0
            yield size, alone, np.add.reduceat(counts, firsts), np.zeros(len(firsts), np.int64)
        follows = keys[min(size + 1, len(keys) - 1)] > 0
        keys, counts = keys[:, follows], counts[follows]
        parts = 1 + order[keys[min(size + 1, len(keys) - 1)]] % np.maximum(shares[follows], 1)
    if len(counts):
        again = np.lexsort((parts, keys[2], keys[1], keys[0]))
        yield 2, keys[:, again], counts[again], parts[again]


ROUTED = "lang string, lead string, part bigint, words int, tails binary, weights binary"


def _routed(named: DataFrame, hot: Hot, max_words: int, block_words: int) -> DataFrame:
    """Folded suffixes by lead and part: ``tails`` holds ``max_words - 1`` words of each, and a blank behind every one; ``weights`` the counts."""
    def run(batches):
        for block in _blocks(batches, max_words, block_words):
            spelled, names = block.spelled(), block.names()
            for size, keys, counts, parts in _led(block, hot):
                if not len(counts):
                    continue
                starts = _starts(np.concatenate([keys[: size + 1], parts[None]]))
                ends = np.append(starts[1:], len(counts))
                behind = np.zeros((max_words - 1, len(counts)), np.int64)
                behind[: max_words - size] = keys[size + 1 :]
                weights = counts.astype("<i4").tobytes()
                for at in range(0, len(starts), OUT_ROWS):
                    first, last = starts[at : at + OUT_ROWS], ends[at : at + OUT_ROWS]
                    words = spelled.take(pa.array(behind[:, first[0] : last[-1]].T.reshape(-1)))
                    offsets = pa.array((np.append(first, last[-1]) - first[0]) * len(behind), pa.int32())
                    tails = pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")
                    yield pa.record_batch({
                        "lang": names.take(pa.array(keys[0][first])), "lead": _phrases(spelled, keys[1 : size + 1, first]),
                        "part": pa.array(parts[first]), "words": pa.array(np.full(len(first), size, np.int32)),
                        "tails": pc.binary_join_element_wise(tails, "", " ").cast(pa.binary()),
                        "weights": pa.array([weights[4 * x : 4 * y] for x, y in zip(first.tolist(), last.tolist())], pa.binary()),
                    })

    return named.mapInArrow(run, ROUTED)


def _content(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a binary column and the length of each value."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes(), np.diff(offsets)


def _changes(rows: pa.RecordBatch) -> np.ndarray:
    """Where another lead or part begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in ("lang", "lead", "part"):
        column = rows[name]
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _sorted_counts(rows: pa.RecordBatch, max_words: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of all phrases that begin with the given leads."""
    if not rows.num_rows:
        return
    numbers = defaultdict(count(1).__next__, {b"": 0})
    firsts = _changes(rows)
    words = _content(rows["tails"])[0].split(b" ")[:-1]
    keys = np.ascontiguousarray(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)).reshape(-1, max_words - 1).T)
    raw, lengths = _content(rows["weights"])
    weights = np.frombuffer(raw, "<i4").astype(np.int64)
    ends = np.cumsum(np.add.reduceat(lengths // 4, firsts))
    starts = np.concatenate([[0], ends[:-1]])
    sizes = _ranges(weights, starts, ends)
    spelled = pa.array(list(numbers), pa.binary()).view(pa.string())

    def out(leads: np.ndarray, tails: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(leads), OUT_ROWS):
            some = pa.array(firsts[leads[at : at + OUT_ROWS]])
            spans = [spelled.take(pa.array(t[at : at + OUT_ROWS])) for t in tails]
            yield pa.record_batch({
                "lang": rows["lang"].take(some), "words": pc.add(rows["words"].take(some), pa.scalar(len(tails), pa.int32())),
                "phrase": pc.binary_join_element_wise(rows["lead"].take(some), *spans, " "), "a": pa.array(counts[at : at + OUT_ROWS]),
            })

    kept = sizes >= least
    whole = np.flatnonzero(kept & (rows["part"].to_numpy()[firsts] == 0))
    yield from out(whole, np.empty((0, len(whole)), np.int64), sizes[whole])
    held = np.repeat(kept, ends - starts)
    lead_of = np.repeat(np.arange(len(firsts)), ends - starts)[held]
    keys = keys[:, held]
    for depth, some, counts in equal_partitions(keys, weights[held], (ends - starts)[kept], least):
        yield from out(lead_of[some], keys[: depth + 1, some], counts)


def _counted(routed: DataFrame, max_words: int, min_count: int, block_words: int) -> DataFrame:
    """Counts by lead from leads in order; one that exceeds a block is counted piece by piece, none abandoned."""
    def run(batches):
        held, size, open_lead = [], 0, None

        def settle(last: bool):
            nonlocal held, size, open_lead
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            firsts = _changes(rows)
            key = lambda at: tuple(rows[c][int(at)].as_py() for c in ("lang", "lead", "part"))
            begun = (firsts[1] if len(firsts) > 1 else rows.num_rows) if key(0) == open_lead else 0
            yield from _sorted_counts(rows.slice(0, begun), max_words, 1)
            done = rows.num_rows if last else max(begun, int(firsts[-1]))
            yield from _sorted_counts(rows.slice(begun, done - begun), max_words, min_count)
            rest = rows.slice(done)
            size = len(_content(rest["weights"])[0]) // 4
            if size >= block_words:
                open_lead = key(done)
                yield from _sorted_counts(rest, max_words, 1)
            held, size = ([rest], size) if 0 < size < block_words else ([], 0)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(_content(batch.column(5))[0]) // 4
                if size >= block_words:
                    yield from settle(False)
        if held:
            yield from settle(True)

    return routed.mapInArrow(run, "lang string, words int, phrase string, a bigint")


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 3, min_count: int = 10, block_words: int = 1 << 20) -> DataFrame:
    """``lang, words, phrase, a``: frequent phrases of up to ``max_words`` words; zero words: all occurrences."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), utf8(text).alias("text"))
    survey = stored(_survey(named, max_words, block_words), "survey")
    totals = survey.filter("words = 0")
    every = totals.agg(F.sum("a")).first()[0] or 0
    # At most HOT_SHARE words and as many pairs reach the bound.
    common = survey.filter((F.col("words") > 0) & (F.col("a") * HOT_SHARE >= every)).select("phrase", "a").collect()
    hot = {tuple(r["phrase"].encode().split(b" ")): -(-r["a"] * HOT_SHARE // every) for r in common}
    key = ["lang", "lead", "part"]
    routed = _routed(named, hot, max_words, block_words).repartition(*key).sortWithinPartitions(*key)
    counted = _counted(routed, max_words, min_count, block_words).groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a"))
    return counted.filter(F.col("a") >= min_count).unionByName(totals.select("lang", "words", "phrase", "a"))


def _span(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut: ``l``, ``r``, ``score``."""
    words = F.split("phrase", " ")
    cuts = frequent.filter("words > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _span(words, F.lit(1), F.col("k")).alias("first"), _span(words, F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    part = lambda name, size: frequent.select("lang", F.col("phrase").alias(name), F.col("a").alias(size))
    joined = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # 38 digits hold the products of counts up to 10^16; whole division is exact.
    wide = {c: f"cast({c} as decimal(16,0))" for c in "alr"}
    joined = joined.withColumn("score", F.expr("{a} * {a} * 1000000 div ({l} * {r})".format(**wide)))
    least = F.min(F.struct("score", "k", "l", "r"))
    return joined.groupBy("lang", "words", "phrase", "a").agg(least.alias("cut")).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def without_contained(phrases: DataFrame, frequent: DataFrame, share: int = 50) -> DataFrame:
    """Drops phrases that stand inside a longer one with at least ``share`` percent of their count."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: _span(words, start, size)),
    ))
    inner = frequent.filter("words > 2").select("lang", F.explode(spans).alias("phrase"), "a")
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(longest, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")


def first_of_each(phrases: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` phrases of every language with their ``rank``."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = phrases.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    some = sliced.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= limit)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= limit).drop("slice")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", max_words: int = 3, min_count: int = 10, share: int = 50, limit: int = 2000,
) -> DataFrame:
    """``lang, rank, phrase, words, a, l, r, n, score``: the best phrases of every language."""
    frequent = stored(phrase_counts(docs, text=text, lang=lang, max_words=max_words, min_count=min_count), "phrases")
    best = first_of_each(without_contained(scored(frequent), frequent, share), limit)
    totals = frequent.filter("words = 0").select("lang", F.col("a").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "n", "score")
