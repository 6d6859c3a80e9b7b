"""Quality checks on cells: flags, cleaning, summaries.

Cells are rows (keys..., variable, value); a check adds a boolean ``failed`` and
its name, so that the flags of all checks are one long table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import finite, range_of
from . import scan

# Limits of the gradient's magnitude by what the variable's name contains.
GRADIENT_LIMITS = {"temperature": 15.0, "pressure": 500.0, "wind": 30.0, "humidity": 50.0}
Check = Callable[[DataFrame], DataFrame]


def flagged(df: DataFrame, name: str, failed: Column) -> DataFrame:
    return df.withColumns({"check": F.lit(name), "failed": F.coalesce(failed, F.lit(False))})


def range_check(df: DataFrame, low: float | None = None, high: float | None = None, rule: str = "first", ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Finite values outside the variable's physical range by the rule (see
    ``range_of``), or outside the given one."""
    lo, hi = (F.lit(low), F.lit(high)) if low is not None else range_of(F.col("variable"), rule, ranges)
    x = finite(F.col("value"))
    return flagged(df, "range", (x < lo) | (x > hi))


def outlier_check(df: DataFrame, by: list[str], limit: float = 6.0, least: int = 1) -> DataFrame:
    """Values more than ``limit`` population deviations from the mean of their group.
    The group's moments are one row each, summed up before the shuffle."""
    x = finite(F.col("value"))
    moments = df.groupBy(*by).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std"), F.count(x).alias("_n"))
    out = df.join(moments, by)
    failed = (F.col("_n") >= least) & (F.col("_std") > 0) & (F.abs(finite(F.col("value")) - F.col("_mean")) > limit * F.col("_std"))
    return flagged(out, "outlier", failed).drop("_mean", "_std", "_n")


def difference(by: list[str], axis: str, value: Column) -> Column:
    """Central difference along an axis of unit spacing, one-sided at its ends."""
    w = W.partitionBy(*by).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    steps = F.when(before.isNull() | after.isNull(), 1).otherwise(2)
    return (F.coalesce(after, value) - F.coalesce(before, value)) / steps


def gradient_check(grid: DataFrame, by: list[str], lat: str = "lat_idx", lon: str = "lon_idx", limit: float | None = None) -> DataFrame:
    """Cells of a complete grid whose gradient magnitude exceeds the limit; it
    shows on the neighbours of a spike, not on the spike."""
    x = F.col("value")
    out = grid.withColumn("_gy", difference([*by, lon], lat, x)).withColumn("_gx", difference([*by, lat], lon, x))
    size = F.sqrt(F.col("_gy") * F.col("_gy") + F.col("_gx") * F.col("_gx"))
    threshold = F.lit(limit)
    if limit is None:
        threshold = F.lit(5.0)
        for key, value in reversed(GRADIENT_LIMITS.items()):
            threshold = F.when(F.lower("variable").contains(key), value).otherwise(threshold)
    return flagged(out.withColumn("gradient", size), "gradient", F.col("gradient") > threshold).drop("_gy", "_gx")


def spike_check(df: DataFrame, by: list[str], order: list[str], limit: float = 5.0, least: int = 3, compat: bool = False) -> DataFrame:
    """Points whose second difference exceeds ``limit`` deviations of all second
    differences of the series' variable. The middle point is flagged, with
    ``compat`` the first."""
    w = W.partitionBy(*by).orderBy(*order)
    x = F.col("value")
    at = F.lead(x, 2).over(w) - 2 * F.lead(x, 1).over(w) + x if compat else F.lead(x, 1).over(w) - 2 * x + F.lag(x, 1).over(w)
    out = df.withColumn("_d2", at)
    spread = out.groupBy("variable").agg(F.stddev_pop("_d2").alias("_s"), F.count("_d2").alias("_n"))
    out = out.join(spread, "variable")
    s = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return flagged(out, "temporal", (F.col("_n") >= least - 2) & (F.abs("_d2") > limit * s)).drop("_d2", "_s", "_n")


def buddy_check(grid: DataFrame, by: list[str], lat: str = "lat_idx", lon: str = "lon_idx", limit: float = 3.0, least: int = 3) -> DataFrame:
    """Cells that lie more than ``limit`` deviations from the mean of their eight
    neighbours; without deviation, that differ from it by 1e-6. Two windows
    gather the neighbours of a complete grid: a row of three, then the rows
    above and below."""
    along = W.partitionBy(*by, lat).orderBy(lon)
    left, right = F.lag("value").over(along), F.lead("value").over(along)
    out = grid.withColumns({"_row": F.array_compact(F.array(left, F.col("value"), right)), "_side": F.array_compact(F.array(left, right))})
    across = W.partitionBy(*by, lon).orderBy(lat)
    up, down = F.lag("_row").over(across), F.lead("_row").over(across)
    none = F.array().cast("array<double>")
    out = out.withColumn("_near", F.concat("_side", F.coalesce(up, none), F.coalesce(down, none)))
    n = F.size("_near")
    mean = F.aggregate("_near", F.lit(0.0), lambda s, x: s + x) / F.when(n > 0, n)
    out = out.withColumn("_mean", mean)
    var = F.aggregate("_near", F.lit(0.0), lambda s, x: s + x * x) / F.when(n > 0, n) - F.col("_mean") * F.col("_mean")
    out = out.withColumn("_std", F.sqrt(F.greatest(var, F.lit(0.0))))
    away = F.abs(F.col("value") - F.col("_mean"))
    failed = (n >= least) & F.when(F.col("_std") > 1e-9, away > limit * F.col("_std")).otherwise(away >= 1e-6)
    return flagged(out, "buddy", failed).drop("_row", "_side", "_near", "_mean", "_std")


def run_checks(df: DataFrame, keys: list[str], checks: list[Check]) -> DataFrame:
    """The flags of all checks, one row for a cell and check."""
    parts = [check(df).select(*keys, "variable", "value", "check", "failed") for check in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quality_by_variable(flags: DataFrame) -> DataFrame:
    """Of each variable: cells, failures of all checks, quality (1 less the part
    that failed, a cell counting once for each check, 0 at least)."""
    one = flags.groupBy("variable", "check").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("bad"))
    total = one.groupBy("variable").agg(F.max("n").alias("total"), F.sum("bad").alias("n_failed"))
    return total.withColumn("quality", F.greatest(F.lit(0.0), 1 - F.col("n_failed") / F.col("total")))


def quality_rollup(flags: DataFrame) -> DataFrame:
    """Points and failures by variable and check, by variable, and overall."""
    out = flags.rollup("variable", "check").agg(F.count(F.lit(1)).alias("points"), F.count_if("failed").alias("n_failed"))
    return out.withColumn("pass_rate", 1 - F.col("n_failed") / F.col("points"))


def null_failures(df: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """``value`` null where any check failed, of variables that have failures;
    ``original`` keeps what was there."""
    bad = flags.where("failed").select(*keys, "variable").distinct().withColumn("_bad", F.lit(True))
    out = df.join(bad, [*keys, "variable"], "left")
    return out.withColumns({"original": F.col("value"), "value": F.when(F.col("_bad").isNull(), F.col("value"))}).drop("_bad")


def fill_in_time(df: DataFrame, by: list[str], axis: str) -> DataFrame:
    """Nulls by linear interpolation over the axis; the nearest value beyond either
    end. What is known before and after a row comes from a scan: a long series is many tasks."""
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("v"), F.col(axis).alias("t")))
    out = scan.scan(scan.chunked(df, by, [axis]), by, [axis], {"_p": scan.last_known(known), "_n": scan.next_known(known)})
    p, n = F.col("_p.v"), F.col("_n.v")
    between = p + (n - p) * (F.col(axis) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    value = F.when(p.isNull(), n).when(n.isNull(), p).when(F.col("_n.t") == F.col("_p.t"), F.col("value"))
    return out.withColumn("value", value.otherwise(between)).select(*df.columns)


def fill_around(grid: DataFrame, by: list[str], axis: str) -> DataFrame:
    """One pass along a periodic axis: a null becomes the mean of the values
    before and after it, or the one there is."""
    return grid.withColumn("value", F.coalesce("value", _beside(by, axis)))


def _beside(by: list[str], axis: str) -> Column:
    """Mean of the two neighbours on a periodic axis, or the one there is."""
    w = W.partitionBy(*by).orderBy(axis)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.when(F.lag(axis).over(w).isNull(), F.last("value").over(whole)).otherwise(F.lag("value").over(w))
    after = F.when(F.lead(axis).over(w).isNull(), F.first("value").over(whole)).otherwise(F.lead("value").over(w))
    return (F.coalesce(before, after) + F.coalesce(after, before)) / 2


def fill_spatially(grid: DataFrame, by: list[str], lat: str = "lat_idx", lon: str = "lon_idx", passes: int = 10) -> DataFrame:
    """Nulls from the neighbours on either axis, latitude first, again and again
    until none is left or ``passes`` are over. A pass reads the field of the pass
    before only; each is written to the shared folder, so no plan grows."""
    from ..plans.scratch import materialise

    for _ in range(passes):
        if grid.where("value IS NULL").isEmpty():
            break
        near = grid.withColumns({"_a": _beside([*by, lon], lat), "_b": _beside([*by, lat], lon)})
        grid = materialise(near.withColumn("value", F.coalesce("value", "_a", "_b")).drop("_a", "_b"), "filled")
    return grid


def fill_with_mean(df: DataFrame, by: list[str]) -> DataFrame:
    """Nulls by their group's mean, which is summed up before the shuffle: one row a group."""
    means = df.groupBy(*by).agg(F.avg("value").alias("_mean"))
    return df.join(means, by, "left").withColumn("value", F.coalesce("value", "_mean")).drop("_mean").select(*df.columns)


def clean(df: DataFrame, flags: DataFrame, keys: list[str], time: str | None = None, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """The whole cleaning of a long table (keys..., variable, value): what failed
    becomes null, and the variables with failures are filled, in time along
    ``time``, then over the grid, then by their mean. Variables without failures
    stay as they are, with their gaps. ``original`` keeps what was there."""
    failing = flags.where("failed").select("variable").distinct()
    nulled = null_failures(df, flags, keys)
    todo, rest = nulled.join(failing, "variable", "left_semi"), nulled.join(failing, "variable", "left_anti")
    if time:
        todo = fill_in_time(todo, ["variable", *(k for k in keys if k != time)], time)
    if lat and lon:
        todo = fill_spatially(todo, ["variable", *(k for k in keys if k not in (lat, lon))], lat, lon)
    return fill_with_mean(todo, ["variable"]).select(*nulled.columns).unionByName(rest.select(*nulled.columns))


def cleaning_summary(df: DataFrame) -> DataFrame:
    """Of each variable before (``original``) and after (``value``): missing,
    interpolated, modified, final pass rate."""
    before, after = F.col("original"), F.col("value")
    out = df.groupBy("variable").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(before.isNull()).alias("missing_before"),
        F.count_if(after.isNull()).alias("missing_after"),
        F.count_if(before.isNull() & after.isNotNull()).alias("interpolated"),
        F.count_if(before != after).alias("modified"),
    )
    return out.withColumn("pass_rate", 1 - F.col("missing_after") / F.col("total"))


def validation_issues(df: DataFrame) -> DataFrame:
    """Variables that have no values at all."""
    n = df.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.count(finite(F.col("value"))).alias("n_finite"))
    return n.where("n_finite = 0").select("variable", F.concat(F.lit("all values missing: "), "variable").alias("issue"))
