"""Time series by cubic splines, where two neighbours are not enough."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (x, y), x ascending, at least four points, whose
    third derivative does not jump at the second and the last but one; beyond the
    ends it goes on. A polynomial of third degree is met exactly."""
    n, h = len(x), np.diff(x)
    d = np.diff(y) / h
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (d[i] - d[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    left, right = at - x[k], x[k + 1] - at
    inner = (m[k] * right**3 + m[k + 1] * left**3) / (6 * h[k])
    return inner + (y[k] / h[k] - m[k] * h[k] / 6) * right + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * left


def cubic(known: DataFrame, wanted: DataFrame, by: list[str], axis: str = "t", value: str = "value", segment: int = 512, overlap: int = 32) -> DataFrame:
    """The series ``known`` (by..., axis, value) at the places ``wanted`` (by...,
    axis): by..., axis, value. Of fewer than four finite values a line through the
    two ends, a constant of one, null of none.

    A series is cut into stretches of ``segment`` points that overlap, so a task
    holds one stretch whatever the series' length: what a point adds to a spline
    falls by more than half with every point between, so ``overlap`` points on
    either side leave nothing of the cut.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(*by).orderBy(axis)
    numbered = known.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_r", F.row_number().over(order) - 1)
    numbered = numbered.withColumn("_end", F.max("_r").over(W.partitionBy(*by)))
    last = F.floor(F.greatest(F.col("_end") - 3, F.lit(0)) / segment)
    own = F.least(F.floor(F.col("_r") / segment), last)
    near = F.sequence(F.greatest(F.floor((F.col("_r") - overlap) / segment), F.lit(0)), F.least(F.floor((F.col("_r") + overlap) / segment), last))
    starts = numbered.withColumn("_s", own).groupBy(*by, "_s").agg(F.min(axis).alias("_from"))
    stretches = numbered.select(*by, axis, value, F.explode(F.array_distinct(F.concat(near, F.array(own)))).alias("_s"))
    marks = starts.select(*by, F.col("_from").alias(axis), F.col("_s"), F.lit(False).alias("_asked"))
    # Both sides may come from one table: under new names their columns stay apart.
    asked = wanted.select(*(F.col(c).alias(c) for c in [*by, axis]), F.lit(None).cast("long").alias("_s"), F.lit(True).alias("_asked")).unionByName(marks)
    whole = W.partitionBy(*by).orderBy(axis, F.col("_asked")).rowsBetween(W.unboundedPreceding, 0)
    asked = asked.withColumn("_s", F.coalesce(F.last("_s", True).over(whole), F.lit(0))).where("_asked").drop("_asked")

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame(columns=[*by, axis, value])
        left = left.sort_values(axis).drop_duplicates(axis)
        x, y, at = left[axis].to_numpy(float), left[value].to_numpy(float), right[axis].to_numpy(float)
        if len(x) >= 4:
            found = spline(x, y, at)
        elif len(x) > 1:
            found = y[0] + (y[-1] - y[0]) / (x[-1] - x[0]) * (at - x[0])
        else:
            found = np.full(len(at), y[0] if len(x) else np.nan)
        return right[[*by, axis]].assign(**{value: found})

    kinds = ", ".join(f"{c} {t}" for c, t in wanted.select(*by, axis).dtypes)
    return stretches.groupBy(*by, "_s").cogroup(asked.groupBy(*by, "_s")).applyInPandas(one, f"{kinds}, {value} double")
