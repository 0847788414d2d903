"""SimHash near-duplicates with BK-trees over sharded fingerprints.

A fingerprint has a bit where more than half of a text's shingle hashes have it.  Equal
fingerprints are folded first.  Different ones within ``radius`` bits agree on at least
one of ``radius + 1`` parts of their bits; a shard is the set of fingerprints with one
value of one part.  Each shard becomes a BK-tree (children keyed by their integer Hamming
distance to the parent); a fingerprint looks for its neighbours along the edges within the
radius of its own distance, then joins the tree.  Links become a spanning forest inside
the shard, never all pairs, and distributed components join the forests.

A shard with more than ``shard_limit`` fingerprints is dealt again by the parts of its
other bits, as often as needed; that loses no link, since what agrees on a part still
differs by at most ``radius`` bits elsewhere.  So trees stay bounded, and a tree meets its
own shard's fingerprints only.

Scale: one pass over the texts; then rows of 8 to 24 bytes, three per different
fingerprint.  The table of fingerprints is checkpointed once.

Defined cases: a text without words (null, empty) has fingerprint zero and links like any
other; documents without an id join groups but never name them (a group of them alone has
a null id); repeated rows appear each; an empty table gives no rows; other columns are
kept by ``keep_one`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import doc_key, utf8
from tramline.llm.components import components
from tramline.session import materialise

SEED = 42
#: Bits of every byte value, highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
LANES = (np.arange(8) * 256)[None, :]
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned 64 bits; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        total = len(words) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        size = min(CHUNK, total - at)
        digests = b"".join(xxhash.xxh64_digest(next(shingles), SEED) for _ in range(size))
        lanes = np.frombuffer(digests, dtype=np.uint8).reshape(size, 8) + LANES
        tally = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
        counts += (tally @ BITS).ravel()
    return int(np.packbits(2 * counts > total).view(">u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    @F.arrow_udf("bigint")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64).astype(np.int64))

    return docs.withColumn(out, compute(utf8(text)))


class BKTree:
    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Joins the tree; gives the numbers of the earlier values within ``radius``."""
        values, children = self.values, self.children
        new = len(values)
        values.append(value)
        children.append({})
        if not new:
            return []
        near, todo = [], [0]
        while todo:
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                near.append(at)
            below = children[at]
            if len(below) <= 2 * radius + 1:
                todo += [child for d, child in below.items() if -radius <= d - distance <= radius]
            else:
                todo += [below[d] for d in range(distance - radius, distance + radius + 1) if d in below]
        at = 0
        while True:
            distance = (values[at] ^ value).bit_count()
            step = children[at].get(distance)
            if step is None:
                children[at][distance] = new
                return near
            at = step


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links value to group leader, one per value beyond a group's first."""
    tree, leader = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    for i, value in enumerate(values):
        for j in tree.add(value, radius):
            a, b = top(i), top(j)
            if a != b:
                leader[max(a, b)] = min(a, b)
    return [(values[i], values[top(i)]) for i in range(len(values)) if top(i) != i]


def _parts(mask: int, count: int) -> list[int]:
    """``mask`` with each of ``count`` runs of its unset bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(len(free) * i / count) for i in range(count + 1)]
    return sorted({mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])})


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _trees(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values = None, []

        def links():
            found = forest(values, radius) if len(values) > 1 else []
            u, v = zip(*found) if found else ((), ())
            return pa.record_batch({n: pa.array(np.array(x, dtype=np.uint64).astype(np.int64)) for n, x in (("u", u), ("v", v))})

        for batch in batches:
            masks, parts, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for mask, part, fp in zip(masks.tolist(), parts.tolist(), fps.astype(np.uint64).tolist()):
                if (mask, part) != shard:
                    if len(values) > 1 and (out := links()).num_rows:
                        yield out
                    shard, values = (mask, part), []
                values.append(fp)
        yield links()

    return run


def links(prints: DataFrame, *, fp: str = "fp", radius: int = 2, shard_limit: int = 20_000) -> DataFrame:
    """A spanning forest ``u, v`` of the links between different fingerprints, shard by shard."""
    spark = prints.sparkSession
    known = {0}
    entries = prints.select(F.col(fp).alias("fp"), F.lit(0).cast("bigint").alias("mask"))
    found = None
    while True:
        finer = spark.createDataFrame([(_signed(m), [_signed(x) for x in _parts(m, radius + 1)]) for m in sorted(known)], "mask bigint, finer array<bigint>")
        known = {x for m in known for x in _parts(m, radius + 1)}
        # One row per mask in use: three, nine, ... ; a fixed table, whatever the data.
        dealt = entries.join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        sizes = dealt.groupBy("mask", "part").agg(F.count("*").alias("n"))
        large = materialise(sizes.filter(F.col("n") > shard_limit).select("mask", "part"))
        again = not large.isEmpty() and (1 << 64) - 1 not in known
        shards = dealt.join(large, ["mask", "part"], "left_anti") if again else dealt
        ordered = shards.select("mask", "part", "fp").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        forests = ordered.mapInArrow(_trees(radius), "u bigint, v bigint")
        found = forests if found is None else found.unionByName(forests)
        if not again:
            return found
        entries = dealt.join(large, ["mask", "part"], "left_semi").select("fp", "mask")


def group(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 2) -> DataFrame:
    """Per document: id, content key, ``fp`` and ``component_id``."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), doc_key(text).alias("key"), F.col(text).alias("text"))
    prints = materialise(fingerprints(keyed, text="text", width=width).select("doc_id", "key", "fp"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct, radius=radius)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    named = linked.groupBy("root").agg(F.min("first").alias("least"))
    lower = linked.join(named, "root").select("fp", "least")
    ids = distinct.join(lower, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", "key", "fp", "component_id").withColumnRenamed("doc_id", doc_id)


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 2) -> DataFrame:
    """One document of each group: the one that names it; all columns stay.

    A group without any id keeps the row with the least content key per fingerprint.
    """
    grouped = group(docs, text=text, doc_id=doc_id, width=width, radius=radius)
    name = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp:"), F.col("fp").cast("string")))
    rows = grouped.groupBy(name.alias("name"), F.col(doc_id).alias("__id"), "key").agg(F.count("*").alias("__n"))
    first = F.min(F.struct(F.col("__id").isNull().alias("nameless"), F.col("__id").alias("__id"), F.col("key").alias("__key"), F.col("__n").alias("__n"))).alias("first")
    winners = rows.groupBy("name").agg(first).select("first.__id", "first.__key", "first.__n")
    keyed = docs.withColumn("__doc_key", doc_key(text))
    kept = keyed.join(winners, [F.col(doc_id).eqNullSafe(F.col("__id")), F.col("__doc_key") == F.col("__key")], "inner")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = kept.filter("__n = 1").select(*columns)
    # Rows that agree in id and text: one of them, whichever; few rows reach this shuffle.
    repeated = kept.filter("__n > 1").dropDuplicates(["__id", "__key"]).select(*columns)
    return single.unionByName(repeated)
