"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types as _types

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.session import new_folder


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` needs it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, or until another one is asked for.

    Functions travel to workers by value, so a module's own globals are new in every
    task; this entry of ``sys.modules`` is not.  Workers go on from stage to stage: what one
    operator's tasks kept would stand beside the next one's tables.
    """
    stores = sys.modules.setdefault("tramline_worker_store", _types.ModuleType("tramline_worker_store")).__dict__.setdefault("stores", {})
    if name not in stores:
        stores.clear()
        pa.default_memory_pool().release_unused()
        stores[name] = {}
    return stores[name]


def text_or_empty(name: str = "text") -> Column:
    """The text as a string; null is an empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(name: str = "text") -> Column:
    return text_or_empty(name).cast("binary")


def doc_key(*names: str) -> Column:
    """64 bits that tell rows of one ``doc_id`` apart by their content; nulls count as values."""
    parts = []
    for n in names:
        parts += [F.col(n).isNull(), F.col(n)]
    return F.xxhash64(*parts)


def stored(df: DataFrame, label: str) -> DataFrame:
    """A wide frame as a Parquet table in the shared folder: smaller than a checkpoint, read by column."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    # Spark deletes the shuffle files behind it when the driver collects its garbage.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` whose last reader has run."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a number per row that is the same whenever the rows are read again.

    Rows of Parquet files are told by their file and their place in it, however the files are
    split into tasks; only the files' names are written.  A frame that is no whole file table
    is written with its numbers.
    """
    try:
        place = {"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")}
        placed = df.select("*", *[c.alias(n) for n, c in place.items()])
        if "_metadata" in (c.lower() for c in df.columns):
            raise ValueError
    except (AnalysisException, ValueError):
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    at = F.col("__at").cast("decimal(19,0)")
    files = placed.groupBy("__file").agg(F.count("*").alias("n"), F.max("__at").alias("last"), F.sum(at).alias("sum"), F.sum(at * at).alias("squares"))
    n = F.col("n").cast("decimal(12,0)")
    # Every row of the file is there, once.
    whole = (F.col("last") + 1 == F.col("n")) & (F.col("sum") * 2 == n * (n - 1)) & (F.col("squares") * 6 == n * (n - 1) * (2 * n - 1))
    named = files.select("__file", F.coalesce(whole, F.lit(False)).alias("whole"), F.row_number().over(W.orderBy("__file")).cast("bigint").alias("__number"))
    named = stored(named, "files")
    if not named.filter("not whole").isEmpty():
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    number = F.shiftleft("__number", 40).bitwiseOR(F.col("__at"))
    # One row a file: what the driver lists anyway to plan the scan.
    return placed.join(F.broadcast(named.select("__file", "__number")), "__file").select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))


#: Bits of a table of asked keys; with 32,768 in a row, 2,048 rows and 8 MB at most.
KEY_BITS, ROW_BITS = 1 << 26, 1 << 15


def flagged(df: DataFrame, asked: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a flag: false where its ``keys`` are not among ``asked``, true where they are or share a bit.

    The bit table is broadcast and has a fixed size, whatever is asked.
    """
    position = F.xxhash64(*keys).bitwiseAND(F.lit(KEY_BITS - 1))
    row, bit = F.shiftright(position, ROW_BITS.bit_length() - 1).cast("int"), position.bitwiseAND(F.lit(ROW_BITS - 1)).cast("int")
    bits = asked.select(row.alias("__row"), bit.cast("bigint").alias("__bit")).repartition("__row").groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    # Numbers of 32 bits, highest byte first: hexadecimal text is read once for each of them and not for every row of df.
    number = lambda at: F.conv(F.hex(F.substring(F.col("__bits"), at * 4 + 1, F.lit(4))), 16, 10).cast("bigint")
    signed = lambda n: (n - F.when(n > (1 << 31) - 1, F.lit(1 << 32)).otherwise(F.lit(0))).cast("int")
    words = F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 32 - 1)), lambda at: let(number(at), signed))
    bits = bits.select("__row", words.alias("__words"))
    placed = df.select("*", row.alias("__row"), bit.alias("__bit")).join(F.broadcast(bits), "__row", "left")
    told = F.expr("shiftright(get(__words, shiftright(__bit, 5)), (__bit & 31) ^ 24) & 1 = 1")
    return placed.withColumn(name, F.coalesce(told, F.lit(False))).drop("__row", "__bit", "__words")


#: Documents without an id come first.
NO_ID = -(1 << 63)


def in_order(df: DataFrame, doc_id: str = "id", name: str = "doc") -> DataFrame:
    """``df`` with a number that sorts like the id: a whole number is its own, others are ranked."""
    if isinstance(df.schema[doc_id].dataType, T.IntegralType):
        return df.withColumn(name, F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)))
    ids = df.select(F.col(doc_id).alias("__id")).filter("__id is not null").distinct().orderBy("__id")
    ranked = stored(ids.select("__id", F.monotonically_increasing_id().alias("__rank")), "ids")
    return df.join(ranked, F.col(doc_id) == F.col("__id"), "left").withColumn(name, F.coalesce("__rank", F.lit(NO_ID))).drop("__id", "__rank")


BLOCK = 64


def running(values: Column, combine, zero: int = 0) -> Column:
    """Inclusive running result of ``combine`` (sum, greatest) over an array<bigint>.

    It runs within blocks and over the blocks' results, so that an array of ``n`` numbers
    costs about ``n * 32`` steps and not the square of ``n``.
    """
    start, none = F.lit(zero).cast("bigint"), F.array().cast("array<bigint>")

    def within(block: Column) -> Column:
        return F.aggregate(
            block, none, lambda done, x: F.concat(done, F.array(combine(F.coalesce(F.get(done, F.size(done) - 1), start), x))),
        )

    def run(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(BLOCK)), lambda at: within(F.slice(v, at, BLOCK)))

        def joined(parts: Column) -> Column:
            totals = within(F.transform(parts, lambda p: F.element_at(p, -1)))
            return let(totals, lambda t: F.flatten(F.transform(
                parts, lambda p, i: F.transform(p, lambda x: combine(x, F.coalesce(F.get(t, i - 1), start))),
            )))

        return F.when(F.size(v) > 0, let(blocks, joined)).otherwise(none)

    return let(values, run)


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)
