"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly over buckets by a seeded hash; a bucket is small
enough for one task's memory.  Pass two shuffles each bucket (Fisher-Yates, Spark's
``shuffle``) and writes it, whole records with their text, into the folders of its shards.  A
record's place in the whole order is its bucket's offset plus its place in the bucket; shards
take the places in turn, so their row counts differ by one at most, whatever the keys.

Scale: the records cross the network once and are written once.  The hash is of the record's
number in the input, so equal keys and copies spread like all others and no bucket is hot.  The
number of buckets follows the bytes and is the number of tasks, so that a task holds a few
buckets at most, at any size.  Offsets are counted beforehand from the numbers alone, a row per
bucket.  The result depends on the seed and on the input's files, not on how they are split; a
repeated task gives records the same places.

Defined cases: a null text has no bytes; null and repeated ids, repeated rows and ties are
records like others; an empty table gives no rows; all columns are carried, but for
ones named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tramline.llm.common import numbered

SEED = 42


def external_shuffle(records: DataFrame, *, size: str | Column, seed: int = SEED, bucket_bytes: int = 16 << 20, min_buckets: int = 64) -> DataFrame:
    """The records with ``__position``, their place in a uniformly random order (from 0)."""
    bytes_of = F.col(size) if isinstance(size, str) else size
    total = records.agg(F.sum(bytes_of.cast("bigint"))).first()[0] or 0
    buckets = max(min_buckets, -(-total // bucket_bytes))
    scattered = numbered(records.select(F.struct("*").alias("record")), "number").withColumn("bucket", F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(buckets)))
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("rows"))
    offsets = counts.select("bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    gathered = scattered.repartition(buckets, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("number", "record"))).alias("records"))
    # The order of buckets in a task fixes the random numbers each of them gets.
    shuffled = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("records", seed).alias("records"))
    placed = shuffled.join(F.broadcast(offsets), "bucket").select("offset", F.posexplode("records").alias("place", "entry"))
    return placed.select("entry.record.*", (F.col("offset") + F.col("place")).alias("__position"))


def to_shards(records: DataFrame, shards: int, *, size: str | Column, **options) -> DataFrame:
    """The records with ``shard`` and ``slot`` (gapless in the shard)."""
    placed = external_shuffle(records, size=size, **options)
    return placed.select(
        *[F.col(f"`{c}`") for c in records.columns if c.lower() not in ("shard", "slot")], F.pmod("__position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__position") / shards).cast("bigint").alias("slot"),
    )


def write_shards(records: DataFrame, path: str, shards: int, *, size: str | Column, **options) -> DataFrame:
    """Writes the shuffled buckets into one folder of Parquet files per shard; gives what was written."""
    dealt = to_shards(records, shards, size=size, **options)
    dealt.write.partitionBy("shard").parquet(path)
    return records.sparkSession.read.schema(dealt.schema).parquet(path)
