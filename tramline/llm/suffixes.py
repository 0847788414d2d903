"""Repeated byte strings across a corpus, by names of sampled positions.

Every byte covered by a string of ``length`` bytes that also starts earlier goes.  As in a
difference cover, only a sample of positions is sorted, chosen so that two equal strings
always hold sampled positions at the same distance from their starts.  The sample here is
set by content (the least hash of the ``unit`` byte strings inside each window), which
takes 3 % of all positions where periodic covers take 12 to 67 %.

1. A sampled position stands for the run of windows it is least in.  Its triple is the name
   of its unit, the name of the whole run, and its place.  Triples are sorted.
2. Neighbours with equal run names: all windows of the later one repeat.  They are marked.
3. Names of units that go on with different runs are the only open cases.  Their first
   places recurse: the windows of these runs, still grouped by the unit's name, are compared
   in order and the ones that occurred before are marked.
4. Marks of a document are merged and its remaining bytes kept.

Order is (``doc_id``, row, place); matches never cross documents.

Scale: one row of five numbers per 34 bytes crosses the network, once.  Equal triples in a
block of a task meet there already (a hot passage sends one row per block).  Texts cross only
where they have open cases, which send their runs of about 135 bytes, or lose something.
A unit with more than ``hot`` open runs is spread by window instead.  Names have 64 bits.

Defined cases: a null text is empty; ids sort by their own type, documents without one come
first; rows with equal ids follow their files and their places in them (a frame that is not read
from files: as it was numbered and written);
an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.llm.common import flagged, in_order, numbered, stored, utf8, worker_store
from tramline.session import materialise

BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 19
BLOCK_ROWS = 1 << 19
PLACE_BITS = 7
CUT = "struct<spans:array<struct<start:bigint,end:bigint>>,kept:binary>"


def _tables() -> tuple:
    store = worker_store("suffix tables")
    if not store:
        size = SEGMENT + 512
        letters = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        powers, inverse = np.ones(size, np.uint64), np.ones(size, np.uint64)
        powers[1:], inverse[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        store["all"] = letters, np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    return store["all"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sample(data: np.ndarray, length: int, unit: int) -> tuple | None:
    """Names of units and runs, first windows and numbers of further windows of the sampled positions."""
    n = len(data)
    if n < length:
        return None
    letters, powers, inverse = _tables()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[data] * powers[:n], out=sums[1:])
    names = mix((sums[unit:] - sums[:-unit]) * inverse[: n - unit + 1])
    # The place in the low bits makes the leftmost of equal names the least.
    least = (names & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(names), dtype=np.uint64)
    width, done = length - unit + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: -(width - done)], least[width - done :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    more = last - first
    runs = mix((sums[last + length] - sums[first]) * inverse[first] + mix(more.astype(np.uint64) + np.uint64(1)))
    return names[at[first]].astype(np.int64), runs.astype(np.int64), first, more


def _sampler(length: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def out() -> pa.RecordBatch:
            unit_name, run_name, doc, row, place = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((place, row, doc, run_name))
            unit_name, run_name, doc, row, place = (c[order] for c in (unit_name, run_name, doc, row, place))
            again = np.concatenate([[False], run_name[1:] == run_name[:-1]])
            # What is known to repeat needs no company: it gets a name of its own.
            alone = mix(row.astype(np.uint64) * np.uint64(BASE) + place.astype(np.uint64)).astype(np.int64)
            unit_name = np.where(again, alone, unit_name)
            return pa.record_batch({n: pa.array(c) for n, c in zip(("unit", "run", "doc", "row", "place", "again"), (unit_name, run_name, doc, row, place, again))})

        for batch in batches:
            docs, numbers, texts = batch.columns
            for doc, number, text in zip(docs.to_pylist(), numbers.to_pylist(), texts):
                raw = text.as_buffer()
                data = np.frombuffer(raw, np.uint8) if raw.size else np.empty(0, np.uint8)
                for start in range(0, max(1, len(data) - length + 1), SEGMENT):
                    found = sample(data[start : start + SEGMENT + length - 1], length, unit)
                    if found is None:
                        continue
                    unit_name, run_name, first, more = found
                    size = len(first)
                    held.append((unit_name, run_name, np.full(size, doc), np.full(size, number), (first + start) << PLACE_BITS | more))
                    rows += size
                    if rows >= BLOCK_ROWS:
                        yield out()
                        held, rows = [], 0
        if held:
            yield out()

    return run


def _compare(length: int):
    """Windows of open runs, grouped by unit and in order, that an earlier one of the group equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, set()
        for batch in batches:
            marks = []
            for unit, row, place, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if unit != now:
                    now, seen = unit, set()
                first = place >> PLACE_BITS
                for i in range((place & ((1 << PLACE_BITS) - 1)) + 1):
                    window = piece[i : i + length]
                    if window in seen:
                        marks.append((row, first + i, first + i + length))
                    else:
                        seen.add(window)
            columns = list(zip(*marks)) or [[], [], []]
            yield pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(("row", "start", "end"), columns)})

    return run


def _repeats(found: DataFrame, texts: DataFrame, length: int, hot: int) -> DataFrame:
    """Marks ``row, start, end`` of the windows in open runs."""
    first, more = F.shiftright("place", PLACE_BITS), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    open_runs = found.filter("open")
    large = materialise(open_runs.groupBy("unit").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("unit"))
    with_open = flagged(texts, open_runs, ["row"], "asked").filter("asked")
    pieces = in_order(open_runs.select("row", "unit", "place").join(with_open, "row")).select(
        "unit", "doc", "row", "place", F.substring(F.col("text"), (first + 1).cast("int"), (more + length).cast("int")).alias("piece"))
    ordered = pieces.join(large, "unit", "left_anti") if not large.isEmpty() else pieces
    compared = ordered.repartition("unit").sortWithinPartitions("unit", "doc", "row", "place").select("unit", "row", "place", "piece").mapInArrow(
        _compare(length), "row bigint, start bigint, end bigint")
    if large.isEmpty():
        return compared
    windows = pieces.join(large, "unit", "left_semi").select("doc", "row", first.alias("first"), "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), more)).alias("i")).select(
        F.xxhash64(F.substring(F.col("piece"), (F.col("i") + 1).cast("int"), F.lit(length))).alias("name"), "doc", "row", (F.col("first") + F.col("i")).alias("start"))
    firsts = windows.groupBy("name").agg(F.min(F.struct("doc", "row", "start")).alias("earliest"))
    spread = windows.join(firsts, "name").filter(F.struct("doc", "row", "start") != F.col("earliest")).select("row", "start", (F.col("start") + length).alias("end"))
    return compared.unionByName(spread)


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _settle(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = []
    for text, start, end in zip(texts.to_pylist(), starts, ends):
        if text is None:
            rows.append(None)
            continue
        spans = merged(list(zip(start.as_py(), end.as_py())))
        edges = [0, *(x for s in spans for x in s), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        rows.append({"spans": [{"start": a, "end": b} for a, b in spans], "kept": kept})
    return pa.array(rows, pa.struct([("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))


def without_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = 100, unit: int = 32, hot: int = 2_000) -> DataFrame:
    """Per document: id, ``n_bytes``, removed ``spans`` in bytes (null where none) and the ``kept`` bytes."""
    texts = numbered(docs.select(F.col(doc_id).alias("id"), utf8(text).alias("text")))
    triples = in_order(texts).select("doc", "row", "text").mapInArrow(_sampler(length, unit), "unit bigint, run bigint, doc bigint, row bigint, place bigint, again boolean")
    order = W.partitionBy("unit").orderBy("run", "doc", "row", "place")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sorted_triples = triples.repartition("unit").select(
        "unit", "doc", "row", "place", "again", F.lag("run").over(order).eqNullSafe(F.col("run")).alias("same"),
        (F.first("run").over(whole) != F.last("run").over(whole)).alias("several"))
    marked = F.col("again") | F.col("same")
    found = stored(sorted_triples.filter(marked | F.col("several")).select("unit", "doc", "row", "place", (~marked).alias("open")), "triples")
    first = F.shiftright("place", PLACE_BITS)
    direct = found.filter("not open").select(
        "row", first.alias("start"), (first + F.col("place").bitwiseAND((1 << PLACE_BITS) - 1) + length).alias("end"))
    marks = stored(direct.unionByName(_repeats(found, texts, length, hot)), "marks")
    per_doc = marks.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    # Documents that lose nothing stay where they are.
    told = flagged(texts, marks, ["row"], "loses")
    settle = F.arrow_udf(_settle, CUT)
    cut = told.filter("loses").join(per_doc, "row", "left").select("id", "text", settle(F.when(F.col("starts").isNotNull(), F.col("text")), "starts", "ends").alias("cut"))
    settled = cut.unionByName(told.filter("not loses").select("id", "text", F.lit(None).cast(CUT).alias("cut")))
    return settled.select(
        F.col("id").alias(doc_id), F.octet_length("text").cast("bigint").alias("n_bytes"), F.col("cut.spans").alias("spans"),
        F.coalesce("cut.kept", "text").alias("kept"))
