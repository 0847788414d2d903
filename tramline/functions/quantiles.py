"""Exact quantiles without gathering a whole column in one task.

``percentile`` keeps every distinct value of a column in one aggregation buffer.  Here each
wanted rank has a bracket of values, at first everything.  A round counts exactly how many
values lie below and in the bracket and sketches those in it; the sketch's ranks around the
wanted one are the next bracket, some twentieth of the rows whatever their distribution.
Rounds go on until a bracket holds ``ENOUGH`` values or a single one; these are folded by
value and counted off.  The sketch only steers: a rank outside its bracket is seen by the
counts and looked for where it is, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import is_broadcast_size, materialise

SKETCH_SIZE = 200
RANK_MARGIN = 0.03
#: A sketch is kept as its values at so many equal steps of rank.
STEPS = 64
#: So many values of a bracket are sorted in one task.
ENOUGH = 1 << 18


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Long frame ``(column, p, value)``; linear interpolation, nulls ignored."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "column", "value")
    return group_quantiles(long, ["column"], probs)


def group_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float], enough: int = ENOUGH) -> DataFrame:
    """``(*keys, p, value)``: quantiles of the doubles in ``value`` per group; nulls and NaN are ignored.

    Every round is one pass over the rows, for all groups and quantiles together; their number
    grows with the logarithm of the largest group.  What is kept of a round, and joined to the
    rows of the next, is one line per group and quantile; if these lines measure small the rows
    stay where they are, since a group may hold most of them.
    """
    keys = list(keys)
    values = long.select(*keys, "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    rank = F.floor(F.col("p") * (F.col("n") - 1))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    first = values.groupBy(*keys).agg(F.count("*").alias("n"), _steps(F.kll_sketch_agg_double("value", SKETCH_SIZE)).alias("steps"))
    everything = [F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside")]
    targets = first.select(*keys, "n", "steps", *everything, wanted).withColumn("rank", rank)
    while True:
        targets = materialise(targets)
        large = (F.col("inside") > enough) & (F.col("lo") < F.col("hi"))
        if targets.filter(large).isEmpty():
            break
        targets = _narrowed(values, targets.withColumn("large", large), keys)
    return _picked(values, targets, keys)


def _to_all(lines: DataFrame) -> DataFrame:
    """Lines for a join with the rows; Spark cannot tell the size of a checkpoint."""
    return F.broadcast(lines) if is_broadcast_size(lines) else lines


def _steps(sketch: Column) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit([i / STEPS for i in range(STEPS + 1)]))


def _narrowed(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The next bracket of every large target, with what lies below and in it counted.

    Rows at the edges are counted apart: an edge that holds the rank is the answer, any other
    takes no part in the next sketch, so that common values cannot keep a bracket large.
    """
    share = (F.col("rank") - F.col("below")) / F.col("inside")
    step = lambda at: F.get("steps", F.least(F.greatest(at, F.lit(0)), F.lit(STEPS)).cast("int"))
    tried = targets.filter("large").withColumns({
        "lo_next": F.coalesce(step(F.floor((share - RANK_MARGIN) * STEPS)), "lo"), "hi_next": F.coalesce(step(F.ceil((share + RANK_MARGIN) * STEPS)), "hi")})
    value, lo, hi = F.col("value"), F.col("lo_next"), F.col("hi_next")
    between = (value > lo) & (value < hi)
    counted = values.join(_to_all(tried.select(*keys, "p", "lo_next", "hi_next")), keys).groupBy(*keys, "p").agg(
        F.count_if(value < lo).alias("under"), F.count_if(value == lo).alias("at_lo"), F.count_if(between).alias("mid"),
        F.count_if((value == hi) & (hi > lo)).alias("at_hi"), F.kll_sketch_agg_double(F.when(between, value), SKETCH_SIZE).alias("sketch"))
    known = tried.join(counted, [*keys, "p"])
    rank = F.col("rank")
    first, last = F.col("under") + F.col("at_lo"), F.col("under") + F.col("at_lo") + F.col("mid")
    past = last + F.col("at_hi")
    none = F.lit(None).cast("array<double>")
    bracket = lambda low, high, below, inside, steps=none: F.struct(low.alias("lo"), high.alias("hi"), below.alias("below"), inside.alias("inside"), steps.alias("steps"))
    found = (
        # Outside both edges: the sketch was wrong, a new one is made of the part that has the rank.
        F.when(rank < F.col("under"), bracket(F.col("lo"), lo, F.col("below"), F.col("under") - F.col("below")))
        .when(rank >= past, bracket(hi, F.col("hi"), past, F.col("below") + F.col("inside") - past))
        .when(rank < first, bracket(lo, lo, F.col("under"), F.col("at_lo")))
        .when(rank >= last, bracket(hi, hi, last, F.col("at_hi")))
        .otherwise(bracket(lo, hi, first, F.col("mid"), _steps(F.col("sketch"))))
    )
    settled = known.select(*keys, "n", "p", "rank", found.alias("found")).select(*keys, "n", "p", "rank", "found.*")
    return settled.unionByName(targets.filter("not large").select(*settled.columns))


def _picked(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts off the wanted rank, and the one after it, in the folded values of each bracket."""
    value, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    bracket = [*keys, "lo", "hi"]
    # Several quantiles may still share a bracket, which is folded once.
    brackets = targets.select(*bracket).distinct()
    place = F.when(value < lo, -1).when(value > hi, 1).otherwise(0).alias("place")
    folded = values.join(_to_all(brackets), keys).groupBy(*bracket, place, F.when(value.between(lo, hi), value).alias("at")).agg(
        F.count("*").alias("rows"), F.min("value").alias("least"))
    upto = F.sum("rows").over(Window.partitionBy(*bracket).orderBy("place", "at"))
    ranks = F.collect_list(F.struct("p", "rank", "n")).alias("ranks")
    counted = folded.withColumn("upto", upto).join(targets.groupBy(*bracket).agg(ranks), bracket)
    # A folded value answers the ranks from the one before it to its own.
    before = F.col("upto") - F.col("rows")
    near = F.filter("ranks", lambda r: (r["rank"] < F.col("upto")) & (r["rank"] + 1 >= before))
    hit = counted.select(*keys, "upto", "least", F.explode(near).alias("r")).select(*keys, "r.*", "upto", "least")
    picked = hit.groupBy(*keys, "p", "rank", "n").agg(
        F.min(F.when(F.col("upto") > F.col("rank"), F.col("least"))).alias("a"),
        F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("least"))).alias("b"),
    )
    fraction = F.col("p") * (F.col("n") - 1) - F.col("rank")
    between = F.col("a") + fraction * (F.coalesce("b", "a") - F.col("a"))
    return picked.select(*keys, "p", F.when(fraction > 0, between).otherwise(F.col("a")).alias("value"))


def quantile_lookup(df: DataFrame, columns: Sequence[str], probs: Sequence[float]):
    """Scalar subquery: map from ``column@p`` to the quantile (one entry per column and p)."""
    entries = exact_quantiles(df, columns, probs).select(
        F.struct(F.concat_ws("@", "column", F.col("p").cast("string")), "value").alias("entry")
    )
    lookup = entries.agg(F.map_from_entries(F.collect_list("entry")).alias("lookup")).scalar()
    return lambda column, p: F.try_element_at(lookup, F.lit(f"{column}@{float(p)}"))
