"""Regridding and interpolation as joins on axis tables.

An axis is a small table (idx, pos). How target positions fall between source
positions is worked out once for each axis, and the field meets those tables in
equi joins; no cell is compared with all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import finite


def brackets(source: DataFrame, target: DataFrame, extrapolate: bool = False) -> DataFrame:
    """For each target (t_idx, t_pos): the source positions on either side, i0
    and i1, and the weight w of the upper one. Positions are (idx, pos).

    Source and target are laid on one axis and filled forward and backward. A
    target outside the source has no row, or with ``extrapolate`` the nearest
    pair and a weight outside [0, 1]."""
    s = source.select(F.col("idx").alias("i"), F.col("pos").alias("p"), F.lit(None).cast("int").alias("t"))
    t = target.select(F.lit(None).cast("int").alias("i"), F.col("pos").alias("p"), F.col("idx").cast("int").alias("t"))
    both = s.withColumn("i", F.col("i").cast("int")).unionByName(t)
    known = F.when(F.col("i").isNotNull(), F.struct("p", "i"))
    before = W.orderBy("p", F.col("i").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    after = W.orderBy("p", F.col("i").asc_nulls_first()).rowsBetween(0, W.unboundedFollowing)
    found = both.withColumns({"lo": F.last(known, True).over(before), "hi": F.first(known, True).over(after)}).where("t IS NOT NULL")
    if extrapolate:
        order = W.orderBy("p")
        ends = s.select("p", F.col("i").cast("int").alias("i")).withColumns({"r": F.row_number().over(order), "b": F.row_number().over(W.orderBy(F.desc("p")))})
        pick = lambda c, n: F.max(F.when(F.col(c) == n, F.struct("p", "i")))
        edge = ends.agg(pick("r", 1).alias("f1"), pick("r", 2).alias("f2"), pick("b", 1).alias("l1"), pick("b", 2).alias("l2"))
        found = found.crossJoin(F.broadcast(edge))  # the axis' four ends: one row
        lo = F.when(F.col("lo").isNull(), F.col("f1")).when(F.col("hi").isNull(), F.col("l2")).otherwise(F.col("lo"))
        hi = F.when(F.col("lo").isNull(), F.col("f2")).when(F.col("hi").isNull(), F.col("l1")).otherwise(F.col("hi"))
        found = found.select("t", "p", lo.alias("lo"), hi.alias("hi"))
    found = found.where("lo IS NOT NULL AND hi IS NOT NULL")
    w = F.when(F.col("hi.p") == F.col("lo.p"), 0.0).otherwise((F.col("p") - F.col("lo.p")) / (F.col("hi.p") - F.col("lo.p")))
    return found.select(F.col("t").alias("t_idx"), F.col("p").alias("t_pos"), F.col("lo.i").alias("i0"), F.col("hi.i").alias("i1"), w.alias("w"))


def nearest(source: DataFrame, target: DataFrame) -> DataFrame:
    """For each target the nearest source position, the lower of two equally near."""
    near = brackets(source, target, extrapolate=True)
    pick = F.when(F.col("w") <= 0.5, F.col("i0")).otherwise(F.col("i1"))
    return near.select("t_idx", "t_pos", pick.alias("i"))


def _corners(axis: DataFrame) -> DataFrame:
    """Both ends of each bracket as rows (t_idx, i, w); one row where they meet."""
    ends = F.array(F.struct(F.col("i0").alias("i"), (1 - F.col("w")).alias("w")), F.struct(F.col("i1").alias("i"), F.col("w").alias("w")))
    return axis.select("t_idx", F.explode(ends).alias("e")).where("e.w <> 0").groupBy("t_idx", F.col("e.i").alias("i")).agg(F.sum("e.w").alias("w"))


def bilinear(field: DataFrame, lat: DataFrame, lon: DataFrame, by: list[str] = [], fill_missing: bool = True) -> DataFrame:  # noqa: B006
    """Of a field (by..., lat_idx, lon_idx, value) on the axes' brackets
    ``lat`` and ``lon``: (by..., lat_t, lon_t, value). Missing values count as
    their slice's mean, as long as ``fill_missing``."""
    if fill_missing:
        mean = field.groupBy(*by).agg(F.avg("value").alias("_mean"))
        field = (field.join(mean, by) if by else field.crossJoin(F.broadcast(mean))).withColumn("value", F.coalesce("value", "_mean"))
    a = _corners(lat).select(F.col("t_idx").alias("lat_t"), F.col("i").alias("lat_idx"), F.col("w").alias("wa"))
    o = _corners(lon).select(F.col("t_idx").alias("lon_t"), F.col("i").alias("lon_idx"), F.col("w").alias("wo"))
    out = field.join(a, "lat_idx").join(o, "lon_idx").groupBy(*by, "lat_t", "lon_t")
    return out.agg(F.sum(F.col("value") * F.col("wa") * F.col("wo")).alias("value"))


def regrid_nearest(field: DataFrame, lat: DataFrame, lon: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    a = lat.select(F.col("t_idx").alias("lat_t"), F.col("i").alias("lat_idx"))
    o = lon.select(F.col("t_idx").alias("lon_t"), F.col("i").alias("lon_idx"))
    return field.join(a, "lat_idx").join(o, "lon_idx").select(*by, "lat_t", "lon_t", "value")


#: Targets go to the tasks in blocks of so many, each one pass over the field; a kernel holds so many weights at once.
TARGET_BLOCK = 1 << 16
KERNEL = 1 << 22


def idw(field: DataFrame, targets: DataFrame, by: list[str] = [], power: float = 2.0, block: int = TARGET_BLOCK) -> DataFrame:  # noqa: B006
    """Inverse distance weights of *all* finite points of the field (lat, lon,
    value) for each target (t_id, t_lat, t_lon): an all-points kernel by
    definition. Arrow batches of the field meet blocks of targets as matrices; what
    a task has summed up for a group and target is one row, and these are merged, so
    no pair of point and target is ever a row. Targets that occur twice count once."""
    numbered = targets.select("t_id", F.col("t_lat").cast("double").alias("t_lat"), F.col("t_lon").cast("double").alias("t_lon")).distinct()
    n_blocks = max(1, -(-numbered.count() // block))
    numbered = numbered.withColumn("_block", F.pmod(F.xxhash64("t_id", "t_lat", "t_lon"), F.lit(n_blocks)))
    points = field.where(finite(F.col("value")).isNotNull()).select(*by, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("value").cast("double").alias("value"))
    kinds = [f"`{c}` {t}" for c, t in points.select(*by).dtypes]
    out = None
    for b in range(n_blocks):
        some = numbered.where(F.col("_block") == b).drop("_block").toPandas()  # a block of bounded size
        sums = points.mapInArrow(_kernel(some["t_lat"].to_numpy(float), some["t_lon"].to_numpy(float), len(by), power), ", ".join([*kinds, "_t int, _wv double, _w double"]))
        merged = sums.groupBy(*by, "_t").agg((F.sum("_wv") / F.sum("_w")).alias("value"))
        names = field.sparkSession.createDataFrame(some.reset_index(names="_t"), f"_t int, t_id {dict(targets.dtypes)['t_id']}, t_lat double, t_lon double")
        part = merged.join(names, "_t").select(*by, "t_id", "t_lat", "t_lon", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _kernel(t_lat: np.ndarray, t_lon: np.ndarray, n_by: int, power: float):
    """Sums of weight times value and of weights for each group and target of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        schema = None
        for some in batches:
            schema = some.schema
            lat, lon, value = (some.column(n_by + i).to_numpy() for i in range(3))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(some.column(k).to_pylist() for k in range(n_by))) if n_by else [()] * some.num_rows):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                total = sums.setdefault(key, np.zeros((2, len(t_lat))))
                step = max(1, KERNEL // max(1, len(t_lat)))
                for a in range(0, len(rows), step):
                    at = np.array(rows[a : a + step])
                    far = np.hypot(lat[at][:, None] - t_lat, lon[at][:, None] - t_lon)
                    w = 1 / np.maximum(far, 1e-10) ** power
                    total[0] += value[at] @ w
                    total[1] += w.sum(0)
            if len(sums) * max(1, len(t_lat)) > KERNEL:
                yield from _emit(sums, schema, n_by)
                sums = {}
        if sums:
            yield from _emit(sums, schema, n_by)

    return run


def _emit(sums: dict, schema: pa.Schema, n_by: int) -> Iterator[pa.RecordBatch]:
    for key, (wv, w) in sums.items():
        n = len(w)
        if n:
            columns = [pa.array([k] * n, schema.field(i).type) for i, k in enumerate(key)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n, dtype=np.int32)), pa.array(wv), pa.array(w)], [*schema.names[:n_by], "_t", "_wv", "_w"])


def cell_edges(axis: DataFrame) -> DataFrame:
    """Edges (idx, lo, hi) of the cells around the positions: the midpoints, at
    the ends half the mean spacing beyond."""
    w = W.orderBy("pos")
    before, after = F.lag("pos").over(w), F.lead("pos").over(w)
    n = axis.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    half = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / (F.col("n") - 1) / 2).otherwise(0.5)
    out = axis.select("idx", "pos", before.alias("_p"), after.alias("_q")).crossJoin(F.broadcast(n.select(half.alias("_h"))))  # one row
    lo = F.coalesce((F.col("pos") + F.col("_p")) / 2, F.col("pos") - F.col("_h"))
    return out.select("idx", lo.alias("lo"), F.coalesce((F.col("pos") + F.col("_q")) / 2, F.col("pos") + F.col("_h")).alias("hi"))


def overlaps(source: DataFrame, target: DataFrame, cell: float) -> DataFrame:
    """Overlap lengths (s, t, w) of intervals (idx, lo, hi): both sides are dealt
    to buckets of width ``cell``, so the range join is an equi join."""
    bucket = lambda a: F.explode(F.sequence(F.floor(F.col("lo") / cell), F.ceil(F.col("hi") / cell) - 1)).alias(a)
    s = source.select(F.col("idx").alias("s"), F.col("lo").alias("sl"), F.col("hi").alias("sh"), bucket("b"))
    t = target.select(F.col("idx").alias("t"), F.col("lo").alias("tl"), F.col("hi").alias("th"), bucket("b"))
    w = F.least("sh", "th") - F.greatest("sl", "tl")
    return s.join(t, "b").where((F.col("sl") < F.col("th")) & (F.col("tl") < F.col("sh"))).select("s", "t", w.alias("w")).distinct()


def conservative(field: DataFrame, lat: DataFrame, lon: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Area-weighted means over the overlaps (s, t, w) of both axes; a missing
    value counts as 0 with its full weight."""
    a = lat.select(F.col("s").alias("lat_idx"), F.col("t").alias("lat_t"), F.col("w").alias("wa"))
    o = lon.select(F.col("s").alias("lon_idx"), F.col("t").alias("lon_t"), F.col("w").alias("wo"))
    w = F.col("wa") * F.col("wo")
    out = field.join(a, "lat_idx").join(o, "lon_idx").groupBy(*by, "lat_t", "lon_t")
    return out.agg((F.sum(F.coalesce("value", F.lit(0.0)) * w) / F.sum(w)).alias("value"))


def interpolate_series(series: DataFrame, wanted: DataFrame, by: list[str], axis: str = "t", method: str = "linear") -> DataFrame:
    """Series (by..., axis, value) at the wanted points (by..., axis), linear
    with extrapolation from the two nearest points, or nearest. One point is a
    constant, none gives null. Windows over the union of both, one shuffle."""
    s = series.where(F.col("value").isNotNull()).select(*by, axis, "value", F.lit(False).alias("wanted"))
    both = s.unionByName(wanted.select(*by, axis, F.lit(None).cast("double").alias("value"), F.lit(True).alias("wanted")))
    at = F.when(~F.col("wanted"), F.struct(F.col(axis).cast("double").alias("x"), F.col("value").alias("y")))
    order = W.partitionBy(*by).orderBy(axis, "wanted")
    back, ahead = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by).orderBy(axis, F.desc("wanted")).rowsBetween(0, W.unboundedFollowing)
    out = both.withColumns({"p": F.last(at, True).over(back), "n": F.first(at, True).over(ahead)})
    known = s.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(axis))).withColumn("b", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(axis))))
    pair = F.struct(F.col(axis).cast("double").alias("x"), F.col("value").alias("y"))
    ends = known.groupBy(*by).agg(*(F.max(F.when(F.col(c) == k, pair)).alias(f"{c}{k}") for c in ("r", "b") for k in (1, 2)))
    out = out.where("wanted").join(ends, by, "left")
    lo = F.when(F.col("p").isNull(), F.col("r1")).when(F.col("n").isNull(), F.coalesce("b2", "b1")).otherwise(F.col("p"))
    hi = F.when(F.col("p").isNull(), F.coalesce("r2", "r1")).when(F.col("n").isNull(), F.col("b1")).otherwise(F.col("n"))
    out = out.withColumns({"lo": lo, "hi": hi, "x": F.col(axis).cast("double")})
    if method == "nearest":
        value = F.when(F.abs(F.col("x") - F.col("lo.x")) <= F.abs(F.col("hi.x") - F.col("x")), F.col("lo.y")).otherwise(F.col("hi.y"))
    else:
        slope = (F.col("hi.y") - F.col("lo.y")) / (F.col("hi.x") - F.col("lo.x"))
        value = F.when(F.col("hi.x") == F.col("lo.x"), F.col("lo.y")).otherwise(F.col("lo.y") + slope * (F.col("x") - F.col("lo.x")))
    return out.select(*by, axis, value.alias("value"))


def error_metrics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """MAE, RMSE and largest error over rows where both are there."""
    d = F.col(a) - F.col(b)
    return pairs.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_error"))


def cubic_slices(field: DataFrame, targets: tuple[list[float], list[float]], by: list[str]) -> DataFrame:
    """Bicubic regridding (not-a-knot spline on either axis) of complete slices
    (by..., lat, lon, value); a slice with an axis under four positions is left
    out. One slice is one group: the spline needs it whole."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="lat", columns="lon", values="value").sort_index().sort_index(axis=1)
        grid = grid.fillna(float(np.nanmean(grid.to_numpy())))
        if min(grid.shape) < 4:
            return pd.DataFrame(columns=[*by, "lat", "lon", "value"])
        z = spline(grid.index.to_numpy(float), grid.to_numpy(float), np.asarray(targets[0], float))
        z = spline(grid.columns.to_numpy(float), z.T, np.asarray(targets[1], float)).T
        out = pd.DataFrame([(a, o, z[i, j]) for i, a in enumerate(targets[0]) for j, o in enumerate(targets[1])], columns=["lat", "lon", "value"])
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    kinds = [f"{c} {dict(field.dtypes)[c]}" for c in by]
    return field.groupBy(*by).applyInPandas(one, ", ".join([*kinds, "lat double", "lon double", "value double"]))


def spline(x, y, at):
    """Not-a-knot cubic spline through rows of ``y`` at ``x``, clamped to its ends."""
    import numpy as np

    n, h = len(x), np.diff(x)
    a, r = np.zeros((n, n)), np.zeros((n, *y.shape[1:]))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, r)
    at = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    shape = (-1,) + (1,) * (y.ndim - 1)
    t, u, w = (at - x[k]).reshape(shape), (x[k + 1] - at).reshape(shape), h[k].reshape(shape)
    return (m[k] * u**3 + m[k + 1] * t**3) / (6 * w) + (y[k] / w - m[k] * w / 6) * u + (y[k + 1] / w - m[k + 1] * w / 6) * t
