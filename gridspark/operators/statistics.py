"""Descriptive statistics, trends, ensembles, verification and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import finite
from .quantiles import LIMIT, with_quantiles

PERCENTILES = (10, 25, 50, 75, 90)
LEVELS = (0.68, 0.9, 0.95)


def percentile(x: Column, p: float) -> Column:
    """For groups of few values, as the members of a cell are: all of them meet in one task."""
    return F.percentile(x, F.lit(p))


def describe(df: DataFrame, by: list[str], value: str = "value", percentiles=PERCENTILES, limit: int = LIMIT) -> DataFrame:
    """Mean, population deviation, ends and exact percentiles of the finite values.
    No task holds more than ``limit`` values of a group."""
    x = finite(F.col(value))
    parts = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    return with_quantiles(df, by, x, df.groupBy(*by).agg(*parts), {f"p{p}": p / 100 for p in percentiles}, limit)


def trend(df: DataFrame, by: list[str], axis: str, value: str = "value") -> DataFrame:
    """Least-squares slope over the axis; 0 with fewer than two values."""
    return df.groupBy(*by).agg(F.coalesce(F.regr_slope(value, axis), F.lit(0.0)).alias("slope"), F.count(value).alias("n"))


def centre_of_mass(df: DataFrame, by: list[str], lat: str, lon: str, value: str = "value") -> DataFrame:
    v = F.col(value)
    total = df.groupBy(*by).agg(F.sum(v).alias("total"), F.sum(v * F.col(lat)).alias("a"), F.sum(v * F.col(lon)).alias("o"))
    return total.where("total > 0").select(*by, (F.col("a") / F.col("total")).alias("lat"), (F.col("o") / F.col("total")).alias("lon"), "total")


def vertical_integral(df: DataFrame, by: list[str], depth: str, value: str = "value") -> DataFrame:
    """Trapezoids between neighbouring depths."""
    w = W.partitionBy(*by).orderBy(depth)
    area = (F.lead(depth).over(w) - F.col(depth)) * (F.lead(value).over(w) + F.col(value)) / 2
    return df.withColumn("_a", area).groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("integral"))


# Ensembles: cells (cell..., member, value)


def ensemble_statistics(df: DataFrame, cell: list[str], percentiles=PERCENTILES, levels=LEVELS) -> DataFrame:
    """Mean, deviation, percentiles and central intervals over the members of
    each cell; null for a cell with a missing member."""
    x = F.col("value")
    whole = F.count(x) == F.count(F.lit(1))
    ends = [(f"ci{round(100 * c)}_{side}", (1 + s * c) / 2) for c in levels for side, s in (("low", -1), ("high", 1))]
    parts = {"mean": F.avg(x), "std": F.stddev_pop(x)} | {f"p{p}": percentile(x, p / 100) for p in percentiles} | {n: percentile(x, p) for n, p in ends}
    return df.groupBy(*cell).agg(F.count(x).alias("members"), *(F.when(whole, c).alias(n) for n, c in parts.items()))


def probability(df: DataFrame, cell: list[str], above: float | None = None, below: float | None = None, strict: bool = True) -> DataFrame:
    """Share of members above, below or (inclusive) between the thresholds."""
    x = F.col("value")
    if above is not None and below is not None:
        hit = x.between(above, below)
    else:
        hit = x > above if above is not None else x < below
    return df.groupBy(*cell).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("probability"))


def crps(members: DataFrame, observed: DataFrame, cell: list[str], compat: bool = False) -> DataFrame:
    """Continuous ranked probability score of each cell. The members' mean
    difference comes from their ranks, not from all pairs. ``compat`` has the
    opposite sign."""
    both = members.join(observed.select(*cell, F.col("value").alias("y")), cell)
    rank = F.row_number().over(W.partitionBy(*cell).orderBy("value", "member"))
    both = both.withColumns({"r": rank, "n": F.count(F.lit(1)).over(W.partitionBy(*cell))})
    spread = F.sum((2 * F.col("r") - F.col("n") - 1) * F.col("value")) / (F.max("n") * F.max("n"))
    score = F.avg(F.abs(F.col("value") - F.col("y"))) - spread
    return both.groupBy(*cell).agg((-score if compat else score).alias("crps"))


def brier(members: DataFrame, observed: DataFrame, cell: list[str], threshold: float) -> DataFrame:
    p = probability(members, cell, above=threshold)
    both = p.join(observed.select(*cell, F.col("value").alias("y")), cell)
    return both.select(*cell, F.pow(F.col("probability") - F.when(F.col("y") > threshold, 1.0).otherwise(0.0), 2.0).alias("brier"))


def spread_skill(members: DataFrame, observed: DataFrame, cell: list[str]) -> DataFrame:
    """Root mean variance over root mean squared error of the mean; infinite without error."""
    one = members.groupBy(*cell).agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    both = one.join(observed.select(*cell, F.col("value").alias("y")), cell)
    both = both.agg(F.sqrt(F.avg("v")).alias("spread"), F.sqrt(F.avg(F.pow(F.col("m") - F.col("y"), 2.0))).alias("error"))
    return both.withColumn("ratio", F.when(F.col("error") == 0, float("inf")).otherwise(F.col("spread") / F.col("error")))


def roc_curve(members: DataFrame, observed: DataFrame, cell: list[str], threshold: float, points: int = 100) -> DataFrame:
    """True and false positive rates for ``points`` probability thresholds. The
    cells are summed by how many points their probability reaches, then the
    sums run from above: no cell meets all points. A rate of no cells is 0, the
    true positive one without a hit, the false positive one without a miss."""
    p = probability(members, cell, above=threshold).join(observed.select(*cell, F.col("value").alias("y")), cell)
    reached = F.floor(F.col("probability") * (points - 1) + 1e-9).cast("int")
    hit = F.col("y") > threshold
    by = p.groupBy(reached.alias("k")).agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    grid = p.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    run = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    every = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = grid.join(by, "k", "left").na.fill(0, ["pos", "neg"])
    rate = lambda c: F.when(F.sum(c).over(every) > 0, F.sum(c).over(run) / F.sum(c).over(every)).otherwise(0.0)
    return out.select("k", (F.col("k") / (points - 1)).alias("threshold"), rate("pos").alias("tpr"), rate("neg").alias("fpr"))


def effective_size(df: DataFrame, cell: list[str]) -> DataFrame:
    """Members in effect, by their mean correlation over the cells. The sum of
    the covariance matrix is the variance of the members' sum, its trace the sum
    of their variances: two sums instead of a matrix."""
    total = df.groupBy(*cell).agg(F.sum("value").alias("s")).agg(F.var_samp("s").alias("all"))
    own = df.groupBy("member").agg(F.var_samp("value").alias("v")).agg(F.sum("v").alias("trace"), F.count(F.lit(1)).alias("n"))
    both = total.crossJoin(own)  # one row each
    n = F.col("n")
    rho = (F.col("all") - F.col("trace")) / (n * (n - 1)) / (F.col("trace") / n)
    return both.select(n.alias("members"), (n / (1 + (n - 1) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), rho)))).alias("effective"))


def bayesian_calibration(forecast: DataFrame, observed: DataFrame) -> DataFrame:
    """Forecast (mean, std) drawn to the mean of the observations by w =
    variance / (variance + observed variance)."""
    o = observed.agg(F.var_pop("value").alias("_v"), F.avg("value").alias("_m"))
    out = forecast.crossJoin(F.broadcast(o))  # one row
    v = F.col("std") * F.col("std")
    w = v / (v + F.when(F.col("_v") == 0, 1.0).otherwise(F.col("_v")))
    return out.withColumns({"mean": w * F.col("mean") + (1 - w) * F.col("_m"), "std": F.sqrt(v * (1 - w))}).drop("_v", "_m")


def root_mean_square(df: DataFrame) -> DataFrame:
    x = finite(F.col("value"))
    return df.agg(F.sqrt(F.avg(x * x)).alias("norm"))
