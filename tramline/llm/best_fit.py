"""Best-fit packing of whole documents with large-item matching.

A document's ids (with the end id) are one item; only a document longer than a sequence is
cut, into full sequences and a rest.  Items are collected into pools of bounded size.  In a
pool no more than two items above one third of the capacity fit into one sequence, so these
are matched first: the largest takes the largest other one that fits beside it, which needs
the fewest sequences for such items.  The smaller items then go, largest first, each into the
fullest sequence that still holds it, and open a new one only when none does.

Scale: one narrow pass, no shuffle; a task holds one pool (``pool_tokens`` ids and one entry
an item) and the pieces it hands on, whatever its partition holds.  Matching and gaps are kept
by size, so an item costs one look at a bit set of ``capacity`` bits and never a walk over the
open sequences.  All items are packed; what a pool loses against one pool for everything is
at most its last sequences, which is why pools are large.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; null
and repeated ids are ids like others; an empty table gives no pieces; other columns of the
documents are not needed and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import utf8
from tramline.llm.encode import encoder

PIECES = "piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"
#: A task hands rows on at this many bytes of ids.
OUT_BYTES = 4 << 20


class _BySize:
    """Things by an integer size, with the sizes in use as the bits of one number."""

    def __init__(self, largest: int):
        self.held: list[list] = [[] for _ in range(largest + 1)]
        self.used = 0

    def put(self, size: int, thing) -> None:
        self.held[size].append(thing)
        self.used |= 1 << size

    def take(self, size: int):
        found = self.held[size].pop()
        if not self.held[size]:
            self.used ^= 1 << size
        return found

    def largest_to(self, limit: int) -> int:
        """The largest size in use up to ``limit``, or -1."""
        return (self.used & ((2 << limit) - 1)).bit_length() - 1 if limit >= 0 else -1

    def least_from(self, limit: int) -> int:
        """The least size in use from ``limit`` on, or -1."""
        above = self.used >> limit
        return limit + (above & -above).bit_length() - 1 if above else -1


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """The item numbers of each sequence; every size is 1 to ``capacity``."""
    large, gaps, small, bins = _BySize(capacity), _BySize(capacity), _BySize(capacity), []
    for number in range(len(sizes) - 1, -1, -1):
        (large if 3 * sizes[number] > capacity else small).put(sizes[number], number)
    while large.used:
        first = large.used.bit_length() - 1
        content, gap = [large.take(first)], capacity - first
        second = large.largest_to(gap)
        if second >= 0:
            content.append(large.take(second))
            gap -= second
        gaps.put(gap, len(bins))
        bins.append(content)
    while small.used:
        size = small.used.bit_length() - 1
        number, gap = small.take(size), gaps.least_from(size)
        if gap < 0:
            at, gap = len(bins), capacity
            bins.append([])
        else:
            at = gaps.take(gap)
        bins[at].append(number)
        gaps.put(gap - size, at)
    return bins


class _Pool:
    def __init__(self, path: str, capacity: int, end_id: int, pool_tokens: int, part: int):
        self.encoder, self.capacity, self.pool_tokens = encoder(path), capacity, pool_tokens
        self.end = end_id.to_bytes(4, "little")
        self.next_id = part << 40
        self.items: list[tuple] = []
        self.held = 0

    def add(self, doc, text: bytes) -> Iterator[tuple]:
        """Collects a document; gives the pieces that are settled by it."""
        ids = self.encoder.encode(text) + self.end
        step = 4 * self.capacity
        for piece, at in enumerate(range(0, len(ids), step)):
            part = ids[at : at + step]
            if len(part) == step:
                yield doc, piece, at // 4, self.capacity, part, self.next_id, 0
                self.next_id += 1
            else:
                self.items.append((doc, piece, at // 4, len(part) // 4, part))
                self.held += len(part) // 4
        if self.held >= self.pool_tokens:
            yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        items, self.items, self.held = self.items, [], 0
        for content in best_fit([i[3] for i in items], self.capacity):
            offset = 0
            for number in content:
                yield *items[number], self.next_id, offset
                offset += items[number][3]
            self.next_id += 1


def pack_whole(
    docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", capacity: int = 4096, end_id: int = 1,
    pool_tokens: int = 1 << 22,
) -> DataFrame:
    """Documents (or the pieces of longer ones) with their ``ids``, sequence and place in it.

    ``ids`` holds four bytes per id, lowest first; a sequence is its pieces' ids by ``offset``.
    ``sequence_id`` holds the task's partition and a running number: unique, and the same
    when a lost task runs again.
    """
    kind = docs.select(doc_id).schema[0].dataType
    named = docs.select(F.col(doc_id).alias("doc"), utf8(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, rows, size, doc_type = _Pool(tokenizer, capacity, end_id, pool_tokens, TaskContext.get().partitionId()), [], 0, None

        def out() -> pa.RecordBatch:
            names = ["doc_id", *(p.split()[0] for p in PIECES.split(", "))]
            kinds = [doc_type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

        def settled():
            nonlocal doc_type
            for batch in batches:
                doc_type = batch.column(0).type
                for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from pool.add(doc, value.as_py())
            yield from pool.settle()

        for row in settled():
            rows.append(row)
            size += len(row[4])
            if size >= OUT_BYTES:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return named.mapInArrow(run, f"doc_id {kind.simpleString()}, {PIECES}").withColumnRenamed("doc_id", doc_id)
