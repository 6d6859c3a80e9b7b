"""Exact quantiles of groups of any size.

A small group's values meet in one task, where Spark's ``percentile`` sorts them. In
a large one each wanted order statistic has a bracket, at first from the group's
least to its greatest value. A round counts the values of all brackets of all groups
in histograms, which sum up before the shuffle, and narrows each bracket to the bin
that holds its rank, as far as values reach in it; bins are of equal width in turn on
a linear and on a logarithmic scale, so that outliers do not keep a bracket wide.
What is left is few values, counted by value, so that ties are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A group or bracket of up to so many values is finished in one task.
LIMIT = 1 << 17
BINS = 2048


def _symlog(x: Column) -> Column:
    """Monotone, and about logarithmic on both sides of 0."""
    a = F.abs(x)
    return F.signum(x) * F.when(a < 1e300, F.log1p(a * 1e6)).otherwise(F.log(a) + F.log(F.lit(1e6)))


def quantiles(df: DataFrame, by: list[str], value: Column, points: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """For each group of ``by`` its quantiles (a column for each of ``points``,
    name to share) of the values that are not null, between order statistics by
    linear interpolation. Groups without values have no row; null keys are a group."""
    x = df.select(*by, value.cast("double").alias("_x")).where("_x IS NOT NULL")
    sizes = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    large = sizes.where(F.col("_n") > limit)
    exact = lambda rows: rows.groupBy(*by).agg(*(F.percentile("_x", F.lit(p)).alias(n) for n, p in points.items()))
    n_large = large.count()
    if not n_large:
        return exact(x)
    from ..plans.scratch import materialise

    large = materialise(large, "large-groups")
    if not by:
        return _bracketed(x, large, by, points, limit)
    return exact(_beside(x, large, by, "left_anti")).unionByName(_bracketed(_beside(x, large, by, "left_semi"), large, by, points, limit))


def with_quantiles(df: DataFrame, by: list[str], value: Column, summary: DataFrame, points: dict[str, float], limit: int = LIMIT) -> DataFrame:
    """``summary`` (a row a group) and the group's quantiles; null without values."""
    q = quantiles(df, by, value, points, limit)
    keys = q.select(*(F.col(c).alias(f"_k_{c}") for c in by), *points)
    on = F.lit(True)
    for c in by:
        on = on & summary[c].eqNullSafe(F.col(f"_k_{c}"))
    return summary.join(keys, on, "left").select(*summary.columns, *points)


def _beside(x: DataFrame, table: DataFrame, by: list[str], how: str) -> DataFrame:
    """``x`` joined by group, null keys too. A row of ``table`` stands for many of
    ``x``: Spark broadcasts it where it is small, and splits large groups otherwise."""
    keys = table.select(*(F.col(c).alias(f"_k_{c}") for c in by), *(c for c in table.columns if c not in by))
    on = F.lit(True)
    for c in by:
        on = on & x[c].eqNullSafe(F.col(f"_k_{c}"))
    return x.join(keys if by else F.broadcast(keys), on, how).drop(*(f"_k_{c}" for c in by))


def _bracketed(x: DataFrame, groups: DataFrame, by: list[str], points: dict[str, float], limit: int) -> DataFrame:
    from ..plans.scratch import materialise

    at = F.array(*(F.lit(p) for p in points.values()))
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor(p * (F.col("_n") - 1)), F.ceil(p * (F.col("_n") - 1))))))
    open_ = groups.select(*by, F.explode(ranks).alias("_k"), F.col("_a"), F.col("_b"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"))
    done, turn = None, 0
    while True:
        open_ = materialise(open_, "brackets")
        ready = open_.where((F.col("_in") <= limit) | (F.col("_a") == F.col("_b")))
        done = ready if done is None else done.unionByName(ready)
        open_ = open_.where((F.col("_in") > limit) & (F.col("_a") < F.col("_b")))
        if open_.isEmpty():
            break
        open_ = _narrowed(x, open_, by, turn % 2 == 1)
        turn += 1
    values = _values(x, done, by)
    n = groups.select(*by, "_n")
    wide = _beside(values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_v")), n, by, "inner")
    rank = lambda p: p * (F.col("_n") - 1)
    stat = lambda k: F.element_at("_v", k.cast("long"))
    one = lambda p: stat(F.floor(rank(p))) + (stat(F.ceil(rank(p))) - stat(F.floor(rank(p)))) * (rank(p) - F.floor(rank(p)))
    return wide.select(*by, *(one(F.lit(p)).alias(name) for name, p in points.items()))


def _narrowed(x: DataFrame, open_: DataFrame, by: list[str], logarithmic: bool) -> DataFrame:
    """One round: brackets that are the same for several ranks are counted once."""
    f = _symlog if logarithmic else (lambda c: c / 2)  # half: the width of all doubles is no double
    brackets = open_.select(*by, "_a", "_b", "_below").distinct()
    inside = _beside(x, brackets, by, "inner").where((F.col("_x") >= F.col("_a")) & (F.col("_x") <= F.col("_b")))
    place = (f(F.col("_x")) - f(F.col("_a"))) / (f(F.col("_b")) - f(F.col("_a")))
    place = F.when(f(F.col("_b")) > f(F.col("_a")), F.least(F.floor(place * BINS), F.lit(BINS - 1))).otherwise(F.when(F.col("_x") < F.col("_b"), 0).otherwise(1))
    bins = inside.groupBy(*by, "_a", "_b", "_below", place.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    w = W.partitionBy(*by, "_a", "_b", "_below").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(w), F.lit(0)))
    bins = bins.select(*by, F.col("_a").alias("_oa"), F.col("_b").alias("_ob"), "_lo", "_hi", "_before", "_c")
    met = _beside(open_.select(*by, "_k", F.col("_a").alias("_pa"), F.col("_b").alias("_pb")), bins, by, "inner")
    met = met.where((F.col("_pa") == F.col("_oa")) & (F.col("_pb") == F.col("_ob")) & (F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_c")))
    return met.select(*by, "_k", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), F.col("_before").alias("_below"), F.col("_c").alias("_in"))


def _values(x: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """The order statistic of each finished bracket."""
    same = done.where(F.col("_a") == F.col("_b")).select(*by, "_k", F.col("_a").alias("_x"))
    rest = done.where(F.col("_a") < F.col("_b"))
    inside = _beside(x, rest, by, "inner").where((F.col("_x") >= F.col("_a")) & (F.col("_x") <= F.col("_b")))
    counted = inside.groupBy(*by, "_k", "_below", "_x").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by, "_k").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("_below") + F.sum("_c").over(w)
    found = counted.withColumn("_upto", upto).where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
    return same.unionByName(found.select(*by, "_k", "_x"))
