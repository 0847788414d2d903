"""Lines that cross the network to be verified, and the bit table of asked keys."""

from __future__ import annotations

import random
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import functions as F

from tramline.llm import common, line_join


def test_asked_lines_cross_as_their_words_and_are_judged_by_them():
    rng = random.Random(5)
    lines = [" ".join(rng.choices(["Wagon", "wagon", "tram", "straße", "Ligne", "stop", "x1", " ", "🚋"], k=rng.randrange(1, 40))).encode() for _ in range(200)]
    lines += [b"", b"\t \r", b"a\x0bb \x0c a"]
    at = pa.array(range(len(lines)), pa.int64())
    (said,) = line_join._said(iter([pa.record_batch({"row": at, "line": at.cast("int32"), "said": pa.array(lines, pa.binary())})]))
    assert sum(len(x.as_py()) for x in said["said"]) < 0.6 * sum(map(len, lines))
    one, two = zip(*[(i, j) for i in range(0, len(lines), 3) for j in range(i + 1, len(lines), 5)])
    pairs = pa.record_batch({
        "row": pa.array(one, pa.int64()), "line": pa.array(two, pa.int32()), "said": said["said"].take(pa.array(one)), "said_b": said["said"].take(pa.array(two))})
    (found,) = line_join._similar(Fraction(4, 5))(iter([pairs]))
    sets = [set(x.lower().split()) for x in lines]
    alike = [(i, j) for i, j in zip(one, two) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert list(zip(found["row"].to_pylist(), found["line"].to_pylist())) == alike


def test_flags_miss_no_asked_key_and_read_no_text_per_row(spark):
    asked = spark.range(0, 40_000, 7).select((F.col("id") * 31).alias("word"))
    every = spark.range(40_000).select(F.col("id").alias("word")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS word"))
    told = common.flagged(every, asked, ["word"], "asked")
    wanted = {i * 31 for i in range(0, 40_000, 7) if i * 31 < 40_000}
    found = {r.word for r in told.filter("asked").collect()}
    assert wanted <= found and len(found - wanted) < 40
    assert not common.flagged(every, asked.limit(0), ["word"], "asked").filter("asked").count()
    above = told._jdf.queryExecution().analyzed().toString().split("Join")[0]
    assert "hex(" not in above
