"""Table snapshots, landed API dumps and their freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.schemas import SYNC_LOG, TABLES
from tramline.sources import claims


def read_snapshot(
    spark: SparkSession, directory: str, table: str, columns: Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """Chosen columns of a parquet table, or of the last committed version of one, sorted when asked."""
    df = spark.read.parquet(current_path(spark, directory, table)).select(*columns)
    return df.orderBy(*order_by) if order_by else df


def _versions(directory: str, table: str) -> str:
    return f"{directory.rstrip('/')}/{table}.versions"


def current_path(spark: SparkSession, directory: str, table: str) -> str:
    """Where the rows of a table are: its last committed version, or its one folder if it has none."""
    versions = _versions(directory, table)
    committed = claims.names(spark, f"{versions}/commits")
    return f"{versions}/data/{committed[-1]}" if committed else f"{directory.rstrip('/')}/{table}.parquet"


def commit_snapshot(df: DataFrame, directory: str, table: str, keep: int = 2) -> str:
    """Writes the rows as the next version of a table; returns the version.

    A version is claimed, written in a folder of its own and committed by one empty file, the
    last thing done: readers see all of the old rows or all of the new ones, and a write that
    fails leaves nothing to be read.  Versions before the last ``keep`` committed ones go, so
    that a reader that has begun can end.
    """
    spark, versions = df.sparkSession, _versions(directory, table)
    while True:
        taken = claims.names(spark, f"{versions}/claims")
        version = f"{int(taken[-1]) + 1 if taken else 1:012d}"
        if claims.claim(spark, f"{versions}/claims", version):
            break
    df.write.parquet(f"{versions}/data/{version}")
    claims.claim(spark, f"{versions}/commits", version)
    oldest = claims.names(spark, f"{versions}/commits")[-keep:][0]
    for name in claims.names(spark, f"{versions}/data"):
        if name < oldest:
            claims.remove(spark, f"{versions}/data/{name}")
    return version


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Snapshot bucketed and sorted by its join key.

    Trips and stop times bucketed by trip alike join and group without a shuffle.
    """
    (
        df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        .option("path", path).format("parquet").saveAsTable(table)
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, columns: Sequence[str], key: str,
    bounds: tuple[int, int], partitions: int, properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read in parallel key ranges; filters and columns reach the database."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1],
        numPartitions=partitions, properties=properties or {},
    ).select(*columns)


def read_json_dump(
    spark: SparkSession, path: str, schema: T.StructType | str, date_column: str | None = None,
    date: str | None = None,
) -> DataFrame:
    """Landed JSON records of one API table, optionally of one service date."""
    df = spark.read.schema(schema).json(path)
    if date_column and date:
        df = df.filter(F.to_date(date_column) == F.to_date(F.lit(date)))
    return df


def read_all_dumps(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Every named table of a landing folder."""
    return {name: read_json_dump(spark, f"{directory}/{name}", schema) for name, schema in TABLES.items()}


def live_feed(spark: SparkSession, directory: str, schema: T.StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of JSON snapshots as they land."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(directory)
    )


def refresh_status(
    log: DataFrame, now: str, datasets: DataFrame | None = None, max_age_hours: int = 24, force: bool = False
) -> DataFrame:
    """Per dataset: last sync, and whether it is stale (never synced or too old)."""
    last = log.groupBy("dataset").agg(F.max("synced_at").alias("last_synced"))
    if datasets is not None:
        last = datasets.select("dataset").distinct().join(last, "dataset", "left")
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_synced").cast("timestamp"))
    stale = F.lit(force) | F.col("last_synced").isNull() | (age > max_age_hours * 3_600_000_000)
    return last.withColumns({
        "stale": stale, "status": F.when(stale, "refresh").otherwise("cached"),
    })


def refresh_snapshots(
    spark: SparkSession, readers: dict, target: str, log_path: str, now: str, max_age_hours: int = 24,
    force: bool = False,
) -> dict[str, str]:
    """Rewrite stale snapshots: ``success``, ``failed`` or ``cached`` per dataset.

    ``readers`` maps a dataset to a function that returns its current rows.  A failing
    dataset leaves the others and its own old snapshot alone, also when it fails while writing.
    """
    names = spark.createDataFrame([(n,) for n in readers], "dataset string")
    spark.createDataFrame([], SYNC_LOG).write.mode("append").parquet(log_path)
    log = spark.read.schema(SYNC_LOG).parquet(log_path)
    status = {r.dataset: r.status for r in refresh_status(log, now, names, max_age_hours, force).collect()}
    result = {}
    for name, reader in readers.items():
        if status[name] == "cached":
            result[name] = "cached"
            continue
        try:
            commit_snapshot(reader(), target, name)
        except Exception:
            result[name] = "failed"
            continue
        entry = spark.createDataFrame([(name,)], "dataset string").withColumn(
            "synced_at", F.lit(now).cast("timestamp")
        )
        entry.write.mode("append").parquet(log_path)
        result[name] = "success"
    return result
