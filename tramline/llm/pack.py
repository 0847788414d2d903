"""Packing into training windows by Karmarkar-Karp multiway differencing.

A document's ids (with the end id) are cut into full windows and a rest.  Rests are
collected into pools of bounded size; a pool is spread over ``k`` windows by the multiway
largest differencing method: partial partitions wait in a heap by their spread, the two
with the largest spreads merge with opposing imbalances, until one is left.  ``k`` starts
at the least number that could hold the pool and rises while any window is over capacity.
A share of every pool is cut into small pieces first: they even out the large ones, so
that the rise ends soon and little padding is left.

Scale: one narrow pass, no shuffle; a task holds one pool (``pool_tokens`` ids) and the
pieces it hands on besides the text at hand.  A pool's last window is the only one that can be far from full.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each;
an empty table gives no pieces; other columns of the documents are not needed and dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import utf8
from tramline.llm.encode import encoder

PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
#: A task hands rows on at this many bytes of ids.
OUT_BYTES = 4 << 20
#: Every n-th rest of a pool is cut into small pieces of this share of a window.
FINE_EVERY, FINE_SHARE = 4, 16
#: Nodes of a differencing stand in the low bits; there are fewer than items times subsets.
NODE_BITS = 40
NODE = (1 << NODE_BITS) - 1


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Spreads items over ``k`` subsets of near-equal sums; gives the item numbers of each.

    A partial partition is kept as its non-empty subsets (sum and node), largest first, each sum
    relative to the smallest of the ``k``; missing ones are empty and equal to that smallest
    one.  Nodes below ``len(sizes)`` are items, the others pairs of nodes.
    """
    if k == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    pairs: list[tuple[int, int]] = []
    count = len(sizes)
    # A subset is one number, its sum above its node.
    heap: list[tuple] = [(-size, at, [size << NODE_BITS | at]) for at, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, a = heapq.heappop(heap)
        b = heap[0][2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            # The largest of b meet the empty places of a, the others its smallest.
            keep = len(b) - over
            new = count + len(pairs)
            met = a[: -over - 1 : -1]
            pairs += [(x & NODE, y & NODE) for x, y in zip(met, b[keep:])]
            merged = a[: len(a) - over] + b[:keep]
            merged += [((x >> NODE_BITS) + (y >> NODE_BITS) << NODE_BITS) | node for node, (x, y) in enumerate(zip(met, b[keep:]), new)]
        merged.sort(reverse=True)
        if len(merged) == k and (low := merged[-1] >> NODE_BITS << NODE_BITS):
            merged = [x - low for x in merged]
        heapq.heapreplace(heap, (-(merged[0] >> NODE_BITS), order, merged))
    subsets = []
    for root in heap[0][2]:
        found, todo = [], [root & NODE]
        while todo:
            node = todo.pop()
            if node < count:
                found.append(node)
            else:
                todo += pairs[node - count]
        subsets.append(sorted(found))
    return subsets + [[] for _ in range(k - len(subsets))]


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Differencing with as few windows as hold every subset; over capacity, the count rises."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        subsets = difference(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in s) - capacity) for s in subsets)
        if not over:
            return [s for s in subsets if s]
        k += -(-over // capacity)


class _Packer:
    def __init__(self, path: str, capacity: int, end_id: int, pool_tokens: int, part: int):
        self.encoder, self.capacity, self.pool_tokens = encoder(path), capacity, pool_tokens
        self.end = end_id.to_bytes(4, "little")
        self.next_id = part << 40
        self.pool: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def _sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _piece(self, doc, start, ids, total, sequence, offset):
        self.rows.append((doc, start, len(ids) // 4, ids, total, sequence, offset))
        self.bytes += len(ids)

    def add(self, doc, text: bytes) -> None:
        ids = self.encoder.encode(text) + self.end
        total = len(ids) // 4
        full = total // self.capacity * self.capacity
        for start in range(0, full, self.capacity):
            self._piece(doc, start, ids[4 * start : 4 * (start + self.capacity)], total, self._sequence(), 0)
        if full < total:
            self.pool.append((doc, full, ids[4 * full :], total))
            self.held += total - full
            if self.held >= self.pool_tokens:
                self.flush()

    def flush(self) -> None:
        step = max(1, self.capacity // FINE_SHARE)
        pieces = []
        for number, (doc, start, ids, total) in enumerate(self.pool):
            size = len(ids) // 4
            cut = step if number % FINE_EVERY == 0 else size
            pieces += [(doc, start + at, ids[4 * at : 4 * (at + cut)], total) for at in range(0, size, cut)]
        for subset in fill([len(p[2]) // 4 for p in pieces], self.capacity):
            sequence, offset = self._sequence(), 0
            for i in subset:
                doc, start, ids, total = pieces[i]
                self._piece(doc, start, ids, total, sequence, offset)
                offset += len(ids) // 4
        self.pool, self.held = [], 0


def pack(
    docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 1,
    pool_tokens: int = 1 << 19,
) -> DataFrame:
    """Pieces of documents with their ``ids``, window (``sequence_id``) and place in it (``offset``).

    ``ids`` holds four bytes per id, lowest first; a window is its pieces' ids by ``offset``.
    ``sequence_id`` holds the task's partition and a running number: unique, and the same
    when a lost task runs again.
    """
    kind = docs.select(doc_id).schema[0].dataType
    named = docs.select(F.col(doc_id).alias("doc"), utf8(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(tokenizer, capacity, end_id, pool_tokens, TaskContext.get().partitionId())
        doc_type = None

        def out():
            columns = list(zip(*packer.rows)) or [[]] * 7
            names = ["doc_id", *(p.split()[0] for p in PIECES.split(", "))]
            kinds = [doc_type, *(pa.binary() if n == "ids" else pa.int64() for n in names[1:])]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            packer.rows, packer.bytes = [], 0
            return pa.record_batch(dict(zip(names, arrays)))

        for batch in batches:
            doc_type = batch.column(0).type
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, value.as_py())
                if len(packer.rows) >= 10_000 or packer.bytes >= OUT_BYTES:
                    yield out()
        if doc_type is not None:
            packer.flush()
            yield out()

    return named.mapInArrow(run, f"doc_id {kind.simpleString()}, {PIECES}").withColumnRenamed("doc_id", doc_id)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` of their ``ids``."""
    return pieces.withColumn("ids_crc32", F.crc32("ids"))
