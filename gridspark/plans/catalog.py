"""Every registered query of the grid engine and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import assimilation, causality, coupled, fingerprint, mesh, orchestration, quality, regrid, spectra, statistics, tenancy
from ..sources import readers, sinks
from ..streaming import ingest
from . import virtual as v

Query = Callable[..., DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = v.as_oracle(sql)
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r(c: Column | str, n: int = 6) -> Column:
    return v.rounded(F.col(c) if isinstance(c, str) else c, n)


# Quality control

_CELL = ["id", "station", "ts"]


def _flags(spark, d) -> DataFrame:
    obs = v.observations(spark, d)
    checks = [
        lambda df: quality.range_check(df, 0.0, 150.0),
        lambda df: quality.outlier_check(df, ["variable"]),
        lambda df: quality.spike_check(df, ["station", "variable"], ["ts", "id"]),
    ]
    return quality.run_checks(obs, _CELL, checks)


_FLAGS = f"""{v.OBS},
  m AS (SELECT variable, avg(value) AS mu, stddev_pop(value) AS sd FROM obs GROUP BY 1),
  d2 AS (SELECT *, lead(value) OVER w - 2 * value + lag(value) OVER w AS d FROM obs WINDOW w AS (PARTITION BY station, variable ORDER BY ts, id)),
  s AS (SELECT variable, stddev_pop(d) AS sd, count(d) AS n FROM d2 GROUP BY 1),
  flags AS (
    SELECT id, variable, value, 'range' AS "check", value < 0 OR value > 150 AS failed FROM obs
    UNION ALL SELECT id, variable, value, 'outlier', sd > 0 AND abs(value - mu) > 6 * sd FROM obs JOIN m USING (variable)
    UNION ALL SELECT id, variable, value, 'temporal', coalesce(n >= 1 AND abs(d) > 5 * CASE WHEN sd > 0 THEN sd ELSE 1 END, false) FROM d2 JOIN s USING (variable))"""


@query(f"WITH {_FLAGS} SELECT variable, max(n) AS total, CAST(sum(bad) AS BIGINT) AS n_failed, round(greatest(0, 1 - sum(bad) / max(n)), 6) AS quality, greatest(0, 1 - sum(bad) / max(n)) >= 0.85 AS passed FROM (SELECT variable, \"check\", count(*) AS n, count_if(failed) AS bad FROM flags GROUP BY 1, 2) GROUP BY 1")
def qc_summary(spark, d):
    q = quality.quality_by_variable(_flags(spark, d))
    return q.select("variable", "total", "n_failed", r("quality").alias("quality"), (F.col("quality") >= 0.85).alias("passed"))


def flagship(spark, sf_dir: str) -> DataFrame:
    return qc_summary(spark, sf_dir)


@query(f"WITH {_FLAGS} SELECT coalesce(variable, 'all') AS variable, coalesce(\"check\", 'all') AS check_name, count(*) AS points, count_if(failed) AS n_failed, round(1 - count_if(failed) / count(*), 6) AS pass_rate FROM flags GROUP BY ROLLUP (variable, \"check\")")
def qc_summary_rollup(spark, d):
    q = quality.quality_rollup(_flags(spark, d))
    return q.select(F.coalesce("variable", F.lit("all")).alias("variable"), F.coalesce("check", F.lit("all")).alias("check_name"), "points", "n_failed", r("pass_rate").alias("pass_rate"))


@query(f"WITH {v.OBS} SELECT id, variable, value FROM obs WHERE value < 0 OR value > 150")
def qc_range_flags(spark, d):
    return quality.range_check(v.observations(spark, d), 0.0, 150.0).where("failed").select("id", "variable", "value")


@query(f"WITH {v.OBS} SELECT id, variable, value FROM obs JOIN (SELECT variable, avg(value) AS mu, stddev_pop(value) AS sd FROM obs GROUP BY 1) USING (variable) WHERE abs(value - mu) > 4 * sd")
def qc_zscore_outliers(spark, d):
    return quality.outlier_check(v.observations(spark, d), ["variable"], 4.0).where("failed").select("id", "variable", "value")


@query(f"WITH {_FLAGS} SELECT id, variable, value FROM flags WHERE \"check\" = 'temporal' AND failed")
def qc_temporal_spikes(spark, d):
    return quality.spike_check(v.observations(spark, d), ["station", "variable"], ["ts", "id"]).where("failed").select("id", "variable", "value")


_GRADIENT = f"""{v.GRID}, g AS (SELECT *,
  (coalesce(lead(value) OVER y, value) - coalesce(lag(value) OVER y, value)) / (CASE WHEN lag(value) OVER y IS NULL OR lead(value) OVER y IS NULL THEN 1 ELSE 2 END) AS gy,
  (coalesce(lead(value) OVER x, value) - coalesce(lag(value) OVER x, value)) / (CASE WHEN lag(value) OVER x IS NULL OR lead(value) OVER x IS NULL THEN 1 ELSE 2 END) AS gx
  FROM grid WINDOW y AS (PARTITION BY lon_idx ORDER BY lat_idx), x AS (PARTITION BY lat_idx ORDER BY lon_idx))"""


@query(f"WITH {_GRADIENT} SELECT lat_idx, lon_idx, round(sqrt(gx * gx + gy * gy), 4) AS gradient, sqrt(gx * gx + gy * gy) > 3000 AS failed FROM g")
def qc_gradient(spark, d):
    return quality.gradient_check(v.cells(spark, d), [], limit=3000.0).select("lat_idx", "lon_idx", r("gradient", 4).alias("gradient"), "failed")


@query(f"""WITH {v.GRID}, o AS (SELECT *, lag(value) OVER x AS l, lead(value) OVER x AS r FROM grid WINDOW x AS (PARTITION BY lat_idx ORDER BY lon_idx)),
  n AS (SELECT *, list_concat(list_filter([l, r], lambda e: e IS NOT NULL), coalesce(lag(list_filter([l, value, r], lambda e: e IS NOT NULL)) OVER y, []), coalesce(lead(list_filter([l, value, r], lambda e: e IS NOT NULL)) OVER y, [])) AS near FROM o WINDOW y AS (PARTITION BY lon_idx ORDER BY lat_idx))
  SELECT lat_idx, lon_idx, len(near) >= 3 AND abs(value - list_avg(near)) > 3 * list_stddev_pop(near) AS failed FROM n""")
def qc_buddy(spark, d):
    return quality.buddy_check(v.cells(spark, d), []).select("lat_idx", "lon_idx", "failed")


@query(f"WITH {v.OBS} SELECT variable, count(*) AS total, count_if(value > 150) AS missing_before, 0::BIGINT AS missing_after, count_if(value > 150) AS interpolated FROM obs GROUP BY 1")
def qc_clean_summary(spark, d):
    obs = v.observations(spark, d)
    flags = quality.run_checks(obs, _CELL, [lambda df: quality.range_check(df, 0.0, 150.0)])
    nulled = quality.null_failures(obs, flags, _CELL)
    seen = F.when(F.col("value").isNotNull(), F.col("original"))
    filled = quality.fill_with_mean(quality.fill_in_time(nulled.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("original", seen), ["station", "variable"], "t"), ["variable"])
    return quality.cleaning_summary(filled).select("variable", "total", "missing_before", "missing_after", "interpolated")


_GAPS = f"""{v.DAILY}, days AS (SELECT variable, unnest(generate_series(lo, hi)) AS t FROM (SELECT variable, min(t) AS lo, max(t) AS hi FROM daily GROUP BY 1)),
  f AS (SELECT days.variable, CAST(days.t AS INTEGER) AS t, value FROM days LEFT JOIN daily ON days.variable = daily.variable AND days.t = daily.t),
  b AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS vp, first_value(value IGNORE NULLS) OVER n AS vn,
    last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER p AS tp, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER n AS tn
    FROM f WINDOW p AS (PARTITION BY variable ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY variable ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {_GAPS} SELECT variable, t, round(CASE WHEN tn = tp THEN value ELSE vp + (vn - vp) * (t - tp) / (tn - tp) END, 4) AS value FROM b")
def gap_fill_linear(spark, d):
    daily = v.daily(spark, d)
    days = daily.groupBy("variable").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("variable", F.explode(F.sequence("lo", "hi")).alias("t"))
    return quality.fill_in_time(days.join(daily, ["variable", "t"], "left"), ["variable"], "t").select("variable", "t", r("value", 4).alias("value"))


@query(f"""WITH {v.GRID}, h AS (SELECT lat_idx, lon_idx, CASE WHEN (lat_idx + lon_idx) % 7 = 0 THEN NULL ELSE value END AS value FROM grid),
  w AS (SELECT *, coalesce(lag(value) OVER x, CASE WHEN lag(lon_idx) OVER x IS NULL THEN last_value(value) OVER a END) AS p, coalesce(lead(value) OVER x, CASE WHEN lead(lon_idx) OVER x IS NULL THEN first_value(value) OVER a END) AS n
    FROM h WINDOW x AS (PARTITION BY lat_idx ORDER BY lon_idx), a AS (PARTITION BY lat_idx ORDER BY lon_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  SELECT lat_idx, lon_idx, round(coalesce(value, (coalesce(p, n) + coalesce(n, p)) / 2), 4) AS value FROM w""")
def fill_periodic(spark, d):
    holes = v.cells(spark, d).withColumn("value", F.when((F.col("lat_idx") + F.col("lon_idx")) % 7 != 0, F.col("value")))
    return quality.fill_around(holes, ["lat_idx"], "lon_idx").select("lat_idx", "lon_idx", r("value", 4).alias("value"))


@query(f"WITH {v.OBS} SELECT variable, count(*) AS n FROM obs WHERE value IS NOT NULL AND variable IN ('click', 'view', 'purchase') GROUP BY 1")
def projected_variables(spark, d):
    return v.observations(spark, d).where(F.col("variable").isin("click", "view", "purchase")).groupBy("variable").agg(F.count("value").alias("n"))


@query(f"WITH {_FLAGS} SELECT id, variable FROM flags WHERE failed GROUP BY 1, 2 ORDER BY id DESC LIMIT 100")
def qc_history_latest(spark, d):
    return _flags(spark, d).where("failed").select("id", "variable").distinct().orderBy(F.desc("id")).limit(100)


# Interpolation

_LATS, _LONS = [1.5 + 2 * i for i in range(24)], [0.5 + i for i in range(23)]


def _axis(spark, positions) -> DataFrame:
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(positions)], "idx int, pos double")


def _own_axis(grid: DataFrame, c: str) -> DataFrame:
    return grid.select(F.col(c).alias("idx"), F.col(c).cast("double").alias("pos")).distinct()


_AXES = """a AS (SELECT i AS t, 1.5 + 2 * i AS pos FROM generate_series(0, 23) g(i)), o AS (SELECT i AS t, 0.5 + i AS pos FROM generate_series(0, 22) g(i)),
  sa AS (SELECT DISTINCT lat_idx AS i FROM grid), so AS (SELECT DISTINCT lon_idx AS i FROM grid),
  ba AS (SELECT t, pos, (SELECT max(i) FROM sa WHERE i <= pos) AS i0, (SELECT min(i) FROM sa WHERE i >= pos) AS i1 FROM a),
  bo AS (SELECT t, pos, (SELECT max(i) FROM so WHERE i <= pos) AS i0, (SELECT min(i) FROM so WHERE i >= pos) AS i1 FROM o)"""


@query(f"""WITH {v.GRID}, {_AXES},
  ca AS (SELECT t, i0 AS i, CASE WHEN i1 = i0 THEN 1.0 ELSE (i1 - pos) / CAST(i1 - i0 AS DOUBLE) END AS w FROM ba WHERE i0 IS NOT NULL AND i1 IS NOT NULL UNION ALL SELECT t, i1, (pos - i0) / CAST(i1 - i0 AS DOUBLE) FROM ba WHERE i1 <> i0),
  co AS (SELECT t, i0 AS i, CASE WHEN i1 = i0 THEN 1.0 ELSE (i1 - pos) / CAST(i1 - i0 AS DOUBLE) END AS w FROM bo WHERE i0 IS NOT NULL AND i1 IS NOT NULL UNION ALL SELECT t, i1, (pos - i0) / CAST(i1 - i0 AS DOUBLE) FROM bo WHERE i1 <> i0)
  SELECT CAST(ca.t AS INTEGER) AS lat_t, CAST(co.t AS INTEGER) AS lon_t, round(sum(value * ca.w * co.w), 4) AS value FROM grid JOIN ca ON lat_idx = ca.i JOIN co ON lon_idx = co.i GROUP BY 1, 2""")
def regrid_bilinear(spark, d):
    grid = v.cells(spark, d)
    lat, lon = regrid.brackets(_own_axis(grid, "lat_idx"), _axis(spark, _LATS)), regrid.brackets(_own_axis(grid, "lon_idx"), _axis(spark, _LONS))
    return regrid.bilinear(grid, lat, lon).select("lat_t", "lon_t", r("value", 4).alias("value"))


@query(f"""WITH {v.GRID}, {_AXES},
  na AS (SELECT t, (SELECT min_by(i, (abs(i - pos), i)) FROM sa) AS i FROM a), no AS (SELECT t, (SELECT min_by(i, (abs(i - pos), i)) FROM so) AS i FROM o)
  SELECT CAST(na.t AS INTEGER) AS lat_t, CAST(no.t AS INTEGER) AS lon_t, round(value, 4) AS value FROM grid JOIN na ON lat_idx = na.i JOIN no ON lon_idx = no.i""")
def regrid_nearest(spark, d):
    grid = v.cells(spark, d)
    lat, lon = regrid.nearest(_own_axis(grid, "lat_idx"), _axis(spark, _LATS)), regrid.nearest(_own_axis(grid, "lon_idx"), _axis(spark, _LONS))
    return regrid.regrid_nearest(grid, lat, lon).select("lat_t", "lon_t", r("value", 4).alias("value"))


@query(f"""WITH {v.GRID}, {v.GEO}, t AS (SELECT n_nationkey AS t_id, (lat + 60) / 2.5 + 0.3 AS t_lat, lon / 15 + 0.4 AS t_lon FROM geo)
  SELECT t_id, round(sum(value / pow(greatest(1e-10, sqrt(pow(lat_idx - t_lat, 2) + pow(lon_idx - t_lon, 2))), 2)) / sum(1 / pow(greatest(1e-10, sqrt(pow(lat_idx - t_lat, 2) + pow(lon_idx - t_lon, 2))), 2)), 4) AS value FROM grid, t GROUP BY 1""")
def regrid_idw(spark, d):
    field = v.cells(spark, d).select(F.col("lat_idx").cast("double").alias("lat"), F.col("lon_idx").cast("double").alias("lon"), "value")
    targets = v.places(spark, d).select(F.col("n_nationkey").alias("t_id"), ((F.col("lat") + 60) / 2.5 + 0.3).alias("t_lat"), (F.col("lon") / 15 + 0.4).alias("t_lon"))
    return regrid.idw(field, targets).select("t_id", r("value", 4).alias("value"))


@query(f"""WITH {v.GRID}, {_AXES},
  ea AS (SELECT i, i - 0.5 AS lo, i + 0.5 AS hi FROM generate_series(1, 50) g(i)), eo AS (SELECT i, i - 0.5 AS lo, i + 0.5 AS hi FROM generate_series(0, 24) g(i)),
  la AS (SELECT i, t, least(hi, pos + 1) - greatest(lo, pos - 1) AS w FROM ea JOIN a ON lo < pos + 1 AND pos - 1 < hi),
  lo AS (SELECT i, t, least(hi, pos + 0.5) - greatest(lo, pos - 0.5) AS w FROM eo JOIN o ON lo < pos + 0.5 AND pos - 0.5 < hi)
  SELECT CAST(la.t AS INTEGER) AS lat_t, CAST(lo.t AS INTEGER) AS lon_t, round(sum(value * la.w * lo.w) / sum(la.w * lo.w), 4) AS value FROM grid JOIN la ON lat_idx = la.i JOIN lo ON lon_idx = lo.i GROUP BY 1, 2""")
def regrid_conservative(spark, d):
    grid = v.cells(spark, d)
    lat = regrid.overlaps(regrid.cell_edges(_axis(spark, range(1, 51)).withColumn("idx", F.col("idx") + 1)), regrid.cell_edges(_axis(spark, _LATS)), 2.0)
    lon = regrid.overlaps(regrid.cell_edges(_axis(spark, range(25))), regrid.cell_edges(_axis(spark, _LONS)), 1.0)
    return regrid.conservative(grid, lat, lon).select("lat_t", "lon_t", r("value", 4).alias("value"))


@query()
def regrid_bicubic(spark, d):
    grid = v.cells(spark, d).select("variable", F.col("lat_idx").cast("double").alias("lat"), F.col("lon_idx").cast("double").alias("lon"), "value")
    return regrid.cubic_slices(grid, (_LATS, _LONS), ["variable"])


_WANTED = "wanted AS (SELECT variable, CAST(i * 30 - 15 AS INTEGER) AS t FROM (SELECT DISTINCT variable FROM daily), generate_series(0, 90) g(i))"


@query(f"""WITH {v.DAILY}, {_WANTED}, e AS (SELECT variable, min(t) AS lo, max(t) AS hi FROM daily GROUP BY 1),
  n AS (SELECT w.variable, w.t, (SELECT max(d.t) FROM daily d WHERE d.variable = w.variable AND d.t <= w.t) AS p, (SELECT min(d.t) FROM daily d WHERE d.variable = w.variable AND d.t >= w.t) AS q FROM wanted w),
  b AS (SELECT n.variable, n.t, CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN (SELECT max(d.t) FROM daily d WHERE d.variable = n.variable AND d.t < p) ELSE p END AS t0,
    CASE WHEN p IS NULL THEN (SELECT min(d.t) FROM daily d WHERE d.variable = n.variable AND d.t > q) WHEN q IS NULL THEN p ELSE q END AS t1 FROM n)
  SELECT b.variable, b.t, round(CASE WHEN t0 = t1 THEN x.value ELSE x.value + (y.value - x.value) / (t1 - t0) * (b.t - t0) END, 4) AS value
  FROM b JOIN daily x ON x.variable = b.variable AND x.t = t0 JOIN daily y ON y.variable = b.variable AND y.t = t1""")
def temporal_interp_linear(spark, d):
    daily = v.daily(spark, d)
    wanted = daily.select("variable").distinct().select("variable", F.explode(F.transform(F.sequence(F.lit(0), F.lit(90)), lambda i: i * 30 - 15)).alias("t"))
    return regrid.interpolate_series(daily, wanted, ["variable"]).select("variable", "t", r("value", 4).alias("value"))


@query(f"""WITH {v.GRID}, h AS (SELECT value, lag(value) OVER (PARTITION BY lat_idx ORDER BY lon_idx) AS b FROM grid)
  SELECT round(avg(abs(value - b)), 4) AS mae, round(sqrt(avg((value - b) * (value - b))), 4) AS rmse, round(max(abs(value - b)), 4) AS max_error FROM h""")
def interpolation_errors(spark, d):
    pairs = v.cells(spark, d).withColumn("b", F.lag("value").over(W.partitionBy("lat_idx").orderBy("lon_idx")))
    return regrid.error_metrics(pairs, "value", "b").select(*(r(c, 4).alias(c) for c in ("mae", "rmse", "max_error")))


# Statistics and ensembles


@query(f"""WITH {v.OBS} SELECT variable, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
  {", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))} FROM obs GROUP BY 1""")
def stats_descriptive(spark, d):
    s = statistics.describe(v.observations(spark, d), ["variable"])
    return s.select("variable", "n", "min", "max", *(r(c).alias(c) for c in ("mean", "std", "p10", "p25", "p50", "p75", "p90")))


@query(f"WITH {v.DAILY} SELECT variable, round(coalesce(regr_slope(value, t), 0), 6) AS slope, count(value) AS n FROM daily GROUP BY 1")
def trend_slope(spark, d):
    return statistics.trend(v.daily(spark, d), ["variable"], "t").select("variable", r("slope").alias("slope"), "n")


@query(f"WITH {v.GRID} SELECT round(sum(value * lat_idx) / sum(value), 6) AS lat, round(sum(value * lon_idx) / sum(value), 6) AS lon FROM grid")
def center_of_mass(spark, d):
    return statistics.centre_of_mass(v.cells(spark, d), [], "lat_idx", "lon_idx").select(r("lat").alias("lat"), r("lon").alias("lon"))


@query(f"WITH {v.GRID}, a AS (SELECT lon_idx, (lead(lat_idx) OVER w - lat_idx) * (lead(value) OVER w + value) / 2 AS area FROM grid WINDOW w AS (PARTITION BY lon_idx ORDER BY lat_idx)) SELECT lon_idx, round(coalesce(sum(area), 0), 4) AS integral FROM a GROUP BY 1")
def vertical_integral(spark, d):
    return statistics.vertical_integral(v.cells(spark, d), ["lon_idx"], "lat_idx").select("lon_idx", r("integral", 4).alias("integral"))


_CI = [(f"ci{round(100 * c)}_{s}", (1 + k * c) / 2) for c in statistics.LEVELS for s, k in (("low", -1), ("high", 1))]
_CELLKEY = ["lat_idx", "lon_idx"]


@query(f"""WITH {v.ENS} SELECT lat_idx, lon_idx, count(value) AS members, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std,
  {", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}" for p in statistics.PERCENTILES)}, {", ".join(f"round(quantile_cont(value, {p!r}), 4) AS {n}" for n, p in _CI)} FROM ens GROUP BY 1, 2""")
def ensemble_stats(spark, d):
    s = statistics.ensemble_statistics(v.cells(spark, d, True), _CELLKEY)
    return s.select(*_CELLKEY, "members", *(r(c, 4).alias(c) for c in s.columns if c not in (*_CELLKEY, "members")))


for _name, _test, _args in (
    ("ensemble_prob_above", "value > 40000", {"above": 40000.0}),
    ("ensemble_prob_below", "value < 30000", {"below": 30000.0}),
    ("ensemble_prob_between", "value BETWEEN 30000 AND 40000", {"above": 30000.0, "below": 40000.0}),
):

    @query(f"WITH {v.ENS} SELECT lat_idx, lon_idx, round(avg(CASE WHEN {_test} THEN 1.0 ELSE 0.0 END), 6) AS probability FROM ens GROUP BY 1, 2", _name)
    def _probability(spark, d, args=_args):
        return statistics.probability(v.cells(spark, d, True), _CELLKEY, **args).select(*_CELLKEY, r("probability").alias("probability"))


_BOTH = f"{v.ENS}, {v.GRID}"


@query(f"""WITH {_BOTH}, b AS (SELECT ens.*, grid.value AS y, row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY ens.value, member) AS rn, count(*) OVER (PARTITION BY lat_idx, lon_idx) AS n FROM ens JOIN grid USING (lat_idx, lon_idx))
  SELECT lat_idx, lon_idx, round(avg(abs(value - y)) - CAST(sum((2 * rn - n - 1) * value) AS DOUBLE) / (max(n) * max(n)), 4) AS crps FROM b GROUP BY 1, 2""")
def crps(spark, d):
    return statistics.crps(v.cells(spark, d, True), v.cells(spark, d), _CELLKEY).select(*_CELLKEY, r("crps", 4).alias("crps"))


@query(f"WITH {_BOTH}, p AS (SELECT lat_idx, lon_idx, avg(CASE WHEN value > 36000 THEN 1.0 ELSE 0.0 END) AS p FROM ens GROUP BY 1, 2) SELECT lat_idx, lon_idx, round(pow(p - CASE WHEN value > 36000 THEN 1 ELSE 0 END, 2), 6) AS brier FROM p JOIN grid USING (lat_idx, lon_idx)")
def brier(spark, d):
    return statistics.brier(v.cells(spark, d, True), v.cells(spark, d), _CELLKEY, 36000.0).select(*_CELLKEY, r("brier").alias("brier"))


@query(f"WITH {_BOTH}, m AS (SELECT lat_idx, lon_idx, avg(value) AS m, var_pop(value) AS v FROM ens GROUP BY 1, 2) SELECT round(sqrt(avg(v)), 4) AS spread, round(sqrt(avg(pow(m - value, 2))), 4) AS error, round(sqrt(avg(v)) / sqrt(avg(pow(m - value, 2))), 6) AS ratio FROM m JOIN grid USING (lat_idx, lon_idx)")
def spread_skill(spark, d):
    s = statistics.spread_skill(v.cells(spark, d, True), v.cells(spark, d), _CELLKEY)
    return s.select(r("spread", 4).alias("spread"), r("error", 4).alias("error"), r("ratio").alias("ratio"))


@query(f"""WITH {_BOTH}, p AS (SELECT lat_idx, lon_idx, avg(CASE WHEN value > 36000 THEN 1.0 ELSE 0.0 END) AS p FROM ens GROUP BY 1, 2), b AS (SELECT p, value > 36000 AS hit FROM p JOIN grid USING (lat_idx, lon_idx)),
  t AS (SELECT i AS k, i / 99.0 AS threshold FROM generate_series(0, 99) g(i))
  SELECT CAST(k AS INTEGER) AS k, round(coalesce(count_if(hit AND p * 99 + 1e-9 >= k) / nullif(count_if(hit), 0), 0), 6) AS tpr, round(coalesce(count_if(NOT hit AND p * 99 + 1e-9 >= k) / nullif(count_if(NOT hit), 0), 0), 6) AS fpr FROM t, b GROUP BY 1""")
def roc_curve(spark, d):
    s = statistics.roc_curve(v.cells(spark, d, True), v.cells(spark, d), _CELLKEY, 36000.0)
    return s.select("k", r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query(f"""WITH {v.ENS}, t AS (SELECT var_samp(s) AS a FROM (SELECT sum(value) AS s FROM ens GROUP BY lat_idx, lon_idx)), o AS (SELECT sum(x) AS tr, count(*) AS n FROM (SELECT var_samp(value) AS x FROM ens GROUP BY member))
  SELECT n AS members, round(n / (1 + (n - 1) * greatest(0, least(1, (a - tr) / (n * (n - 1)) / (tr / n)))), 6) AS effective FROM t, o""")
def effective_size(spark, d):
    return statistics.effective_size(v.cells(spark, d, True), _CELLKEY).select("members", r("effective").alias("effective"))


@query(f"""WITH {_BOTH}, f AS (SELECT lat_idx, lon_idx, avg(value) AS mean, stddev_pop(value) AS std FROM ens GROUP BY 1, 2), o AS (SELECT var_pop(value) AS v, avg(value) AS m FROM grid)
  SELECT lat_idx, lon_idx, round(std * std / (std * std + v) * mean + (1 - std * std / (std * std + v)) * m, 4) AS mean, round(sqrt(std * std * (1 - std * std / (std * std + v))), 4) AS std FROM f, o""")
def bayes_calibration(spark, d):
    forecast = statistics.ensemble_statistics(v.cells(spark, d, True), _CELLKEY).select(*_CELLKEY, "mean", "std")
    return statistics.bayesian_calibration(forecast, v.cells(spark, d)).select(*_CELLKEY, r("mean", 4).alias("mean"), r("std", 4).alias("std"))


@query(f"WITH {v.OBS} SELECT round(sqrt(avg(value * value)), 6) AS norm FROM obs")
def dataset_norm(spark, d):
    return statistics.root_mean_square(v.observations(spark, d)).select(r("norm").alias("norm"))


# Fingerprints


@query(f"""WITH {v.OBS}, c AS (SELECT *, avg(value) OVER (PARTITION BY variable) AS mu FROM obs)
  SELECT variable, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
  round(avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5), 6) AS skew, round(kurtosis_pop(value), 6) AS kurt FROM c GROUP BY 1""")
def fingerprint_vector(spark, d):
    f = fingerprint.fingerprint(v.observations(spark, d), ["variable"])
    return f.select("variable", "n", "min", "max", *(r(c).alias(c) for c in ("mean", "std", "p25", "p50", "p75", "skew", "kurt")))


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS event_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
  SELECT query_id, event_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rank FROM p) WHERE rank <= 20""")
def similarity_topk(spark, d):
    events = v.vectors(spark, d)
    wanted = events.where("event_id % 20 = 0").select(F.col("event_id").alias("query_id"), F.col("vector").alias("query"))
    return fingerprint.most_similar(events, wanted).select("query_id", "event_id", r("score").alias("score"), "rank")


@query(f"""WITH {v.OBS}, s AS (SELECT variable, avg(value) FILTER (station % 10 = 0) AS me, avg(value) FILTER (station % 10 <> 0) AS mb, var_samp(value) FILTER (station % 10 = 0) / count(*) FILTER (station % 10 = 0) AS a,
  var_samp(value) FILTER (station % 10 <> 0) / count(*) FILTER (station % 10 <> 0) AS b, count(*) FILTER (station % 10 = 0) AS ne, count(*) FILTER (station % 10 <> 0) AS nb, stddev_pop(value) FILTER (station % 10 <> 0) AS sd FROM obs GROUP BY 1)
  SELECT variable, ne AS n_event, nb AS n_background, round(me - mb, 6) AS delta, round(100 * (me - mb) / mb, 6) AS percent, round((me - mb) / sd, 6) AS sigma, round((me - mb) / sqrt(a + b), 6) AS t, round(pow(a + b, 2) / (a * a / (ne - 1) + b * b / (nb - 1)), 4) AS dof FROM s""")
def attribution_delta(spark, d):
    a = fingerprint.attribution(v.observations(spark, d), "variable", F.col("station") % 10 == 0)
    return a.select("variable", "n_event", "n_background", *(r(c).alias(c) for c in ("delta", "percent", "sigma", "t")), r("dof", 4).alias("dof"))


@query()
def attribution_p_value(spark, d):
    return fingerprint.with_p_value(fingerprint.attribution(v.observations(spark, d), "variable", F.col("station") % 10 == 0)).select("variable", "t", "p_value", "significant")


def _pair(spark, d) -> DataFrame:
    daily = v.daily(spark, d).where(F.col("variable").isin("F", "O"))
    return daily.groupBy("t").agg(F.max(F.when(F.col("variable") == "O", F.col("value"))).alias("cause"), F.max(F.when(F.col("variable") == "F", F.col("value"))).alias("effect")).where("cause IS NOT NULL AND effect IS NOT NULL")


_PAIR = f"{v.DAILY}, pr AS (SELECT * FROM (SELECT t, max(CASE WHEN variable = 'O' THEN value END) AS cause, max(CASE WHEN variable = 'F' THEN value END) AS effect FROM daily GROUP BY 1) WHERE cause IS NOT NULL AND effect IS NOT NULL)"


@query(f"""WITH {_PAIR}, e AS (SELECT min(cause) AS c0, (max(cause) - min(cause)) / 10 AS cs, min(effect) AS e0, (max(effect) - min(effect)) / 10 AS es FROM pr),
  b AS (SELECT t, CAST(floor((cause - c0) / cs) AS INTEGER) AS xp, CAST(floor((effect - e0) / es) AS INTEGER) AS yp FROM pr, e), f AS (SELECT *, lead(yp) OVER (ORDER BY t) AS yf FROM b),
  k AS (SELECT yf, yp, xp, CAST(count(*) AS DOUBLE) AS k FROM f WHERE yf IS NOT NULL GROUP BY 1, 2, 3),
  s AS (SELECT *, sum(k) OVER () AS n, sum(k) OVER (PARTITION BY yp, xp) AS kp, sum(k) OVER (PARTITION BY yf, yp) AS kq, sum(k) OVER (PARTITION BY yp) AS ky FROM k)
  SELECT round(sum(k / n * log2((k / kp) / (kq / ky))), 6) AS transfer_entropy FROM s""")
def transfer_entropy(spark, d):
    return causality.transfer_entropy(_pair(spark, d), "cause", "effect", ["t"]).select(r("transfer_entropy").alias("transfer_entropy"))


@query(f"""WITH {_PAIR}, l AS (SELECT effect AS y, lag(effect) OVER w AS a, lag(cause) OVER w AS b FROM pr WINDOW w AS (ORDER BY t)),
  s AS (SELECT count(*) AS n, sum(y * y) AS yy, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS cy FROM l WHERE a IS NOT NULL),
  c AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS u, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS v FROM s)
  SELECT n, round(greatest(0, (yy - ay * ay / aa) - (yy - u * ay - v * cy)) / ((yy - u * ay - v * cy) / (n - 2)), 4) AS f_statistic FROM c""")
def granger_lag1(spark, d):
    return causality.granger_lag1(_pair(spark, d), "cause", "effect", ["t"]).select("n", r("f_statistic", 4).alias("f_statistic"))


_NAMES = ["cause_name", "effect_name"]


def _granger_sql(max_lag: int, last: str) -> str:
    """Each lag's normal equations, eliminated column by column: what is left of the
    effect's squares after its own lags, then after the cause's. The p value is an
    integral of the beta density over an angle, by Simpson's rule. ``last`` selects from p."""
    steps, tables = [], []
    for lag in range(1, max_lag + 1):
        columns = [f"y{i}" for i in range(1, lag + 1)] + [f"x{i}" for i in range(1, lag + 1)] + ["y"]
        m = len(columns)
        entries = [(i, j) for i in range(m) for j in range(i, m)]
        steps.append(f"g{lag}_0 AS (SELECT cause_name, effect_name, count(*) AS n, CAST(0 AS DOUBLE) AS own, {', '.join(f'sum({columns[i]} * {columns[j]}) AS m{i}_{j}' for i, j in entries)} FROM z WHERE k > {lag} AND total >= {2 * lag + 5} GROUP BY 1, 2)")
        for s in range(2 * lag):
            entries = [(i, j) for i, j in entries if i > s]
            own = f"m{m - 1}_{m - 1} - m{s}_{m - 1} * m{s}_{m - 1} / m{s}_{s}" if s == lag - 1 else "own"
            steps.append(f"g{lag}_{s + 1} AS (SELECT cause_name, effect_name, n, {own} AS own, {', '.join(f'm{i}_{j} - m{s}_{i} * m{s}_{j} / m{s}_{s} AS m{i}_{j}' for i, j in entries)} FROM g{lag}_{s})")
        tables.append(f"SELECT cause_name, effect_name, {lag} AS lag, n, n - {2 * lag} AS dof, greatest(own - m{m - 1}_{m - 1}, 0) / {lag} / (m{m - 1}_{m - 1} / (n - {2 * lag})) AS f FROM g{lag}_{2 * lag}")
    lags = ", ".join(f"lag({c}, {i}) OVER w AS {c}{i}" for c in "xy" for i in range(1, max_lag + 1))
    density = "exp((dof - 1) * ln(sin(top * j / 4000)) + (lag - 1) * ln(cos(top * j / 4000)) + lgamma((dof + lag) / 2.0) - lgamma(dof / 2.0) - lgamma(lag / 2.0))"
    return f"""WITH {v.DAILY}, q AS (SELECT a.variable AS cause_name, b.variable AS effect_name, a.t, a.value AS x, b.value AS y FROM daily a JOIN daily b ON a.t = b.t WHERE a.variable <> b.variable),
      z AS (SELECT *, {lags}, row_number() OVER w AS k, count(*) OVER (PARTITION BY cause_name, effect_name) AS total FROM q WINDOW w AS (PARTITION BY cause_name, effect_name ORDER BY t)),
      {", ".join(steps)}, f AS ({" UNION ALL ".join(tables)}), i AS (SELECT *, asin(sqrt(dof / (dof + lag * f))) AS top FROM f),
      p AS (SELECT cause_name, effect_name, lag, n, f, CASE WHEN f <= 0 THEN 1 ELSE 2 * top / 4000 / 3 * list_sum(list_transform(range(1, 4001), lambda j: {density} * CASE WHEN j = 4000 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END)) END AS p FROM i
        UNION ALL SELECT DISTINCT cause_name, effect_name, 0, total, 0, 1 FROM z) {last}"""


@query(_granger_sql(5, "SELECT cause_name, effect_name, CAST(lag AS INTEGER) AS lag, n, round(f, 4) AS f_statistic, round(p, 6) AS p_value FROM p"))
def granger_lags(spark, d):
    out = causality.granger_table(causality.paired(v.daily(spark, d), "t"), _NAMES, "t", both=True)
    return out.select(*_NAMES, "lag", "n", r("f_statistic", 4).alias("f_statistic"), r("p_value").alias("p_value"))


@query(_granger_sql(5, "SELECT cause_name, effect_name, CAST(arg_min(lag, (p, lag)) AS INTEGER) AS lag, round(arg_min(f, (p, lag)), 4) AS f_statistic, round(min(p), 6) AS p_value, min(p) < 0.05 AS significant FROM p GROUP BY 1, 2"))
def granger_pairs(spark, d):
    out = causality.all_pairs(v.daily(spark, d), "t")
    return out.select(*_NAMES, "lag", r("f_statistic", 4).alias("f_statistic"), r("p_value").alias("p_value"), "significant")


def _stft_sql(samples: str) -> str:
    """Each bin of each frame as a sum over its samples. ``samples``: CTEs up to s(variable, t, value)."""
    return f"""WITH {samples}, a AS (SELECT variable, avg(value) AS m, count(*) AS n, least(256, count(*)) AS size, 1.0 / (min(t) FILTER (k = 1) - min(t) FILTER (k = 0)) AS fs FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY t) - 1 AS k FROM s) GROUP BY 1 HAVING count(*) > 1),
  x AS (SELECT variable, row_number() OVER (PARTITION BY variable ORDER BY t) - 1 + size // 2 AS j, coalesce(value - m, 0) AS x, n, size, size - size // 2 AS step, fs FROM s JOIN a USING (variable)),
  f AS (SELECT *, unnest(range(greatest(0, CAST(ceil((j - size + 1) / step) AS BIGINT)), least(j // step, CAST(ceil((n + 2 * (size // 2) - size) / step) AS BIGINT)) + 1)) AS frame FROM x),
  w AS (SELECT variable, frame, fs, size, j - frame * step AS i, x * (0.5 - 0.5 * cos(2 * pi() * (j - frame * step) / size)) AS y, size / 2.0 AS total FROM f),
  b AS (SELECT variable, frame, fs, size, k, pow(sum(y * cos(2 * pi() * k * i / size)) / any_value(total), 2) + pow(sum(y * sin(2 * pi() * k * i / size)) / any_value(total), 2) AS power FROM (SELECT *, unnest(range(0, size // 2 + 1)) AS k FROM w) GROUP BY ALL)
  SELECT variable, round(k * fs / size, 9) AS frequency, round(avg(power), 3) AS power FROM b GROUP BY 1, 2"""


def _mean_power(s: DataFrame) -> DataFrame:
    return s.groupBy("variable", r("frequency", 9).alias("frequency")).agg(r(F.avg("power"), 3).alias("power"))


@query(_stft_sql(f"{v.DAILY}, s AS (SELECT variable, CAST(t AS DOUBLE) AS t, value / 1e5 AS value FROM daily)"))
def spectrum_stft(spark, d):
    return _mean_power(spectra.analyse(v.daily(spark, d).withColumn("value", F.col("value") / 1e5), "variable", "t", ["stft"]))


@query(_stft_sql("s AS (SELECT 'price' AS variable, epoch_us(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) / 1e6 AS t, avg(cell) AS value FROM (SELECT l_shipdate, s_nationkey, round(avg(l_extendedprice), 4) / 1000 AS cell FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY CAST(l_shipdate AS DATE))"))
def dataset_spectra(spark, d):
    lines, supplier = v.table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice"), v.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    cells = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).groupBy("l_shipdate", "s_nationkey").agg((v.rounded(F.avg("l_extendedprice"), 4) / 1000).alias("value"))
    cells = cells.select(F.lit("price").alias("variable"), F.to_date("l_shipdate").alias("time"), "value").unionByName(cells.select(F.lit("other").alias("variable"), F.to_date("l_shipdate").alias("time"), "value"))
    return _mean_power(spectra.dataset_spectra(cells, variables=["price"]))


for _method in ("wavelet", "hht"):

    @query(name=f"spectrum_{_method}")
    def _spectrum(spark, d, method=_method):
        s = fingerprint.spectrum(v.daily(spark, d), "variable", "t", method)
        return s.groupBy("variable", "frequency").agg(F.avg("power").alias("power"))


# Assimilation


@query(f"""WITH {v.GEO} SELECT a.n_nationkey AS p, b.n_nationkey AS q, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 4) AS distance
  FROM geo a, geo b WHERE 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 3000""")
def haversine_band_join(spark, d):
    geo = v.places(spark, d)
    points = geo.select(F.col("n_nationkey").alias("p"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return assimilation.within(points, geo.withColumnRenamed("n_nationkey", "q"), 3000.0).select("p", "q", r("distance", 4).alias("distance"))


def _globe(spark, d) -> DataFrame:
    grid = v.cells(spark, d)
    return grid.select("lat_idx", "lon_idx", (F.lit(-75.0) + 3 * F.col("lat_idx")).alias("lat"), (15.0 * F.col("lon_idx")).alias("lon"), "value")


def _innovations(spark, d) -> DataFrame:
    c = v.table(spark, d, "customer").groupBy("c_nationkey").agg(v.rounded(F.avg("c_acctbal"), 4).alias("innovation"), (F.count(F.lit(1)) * 10.0).alias("error"))
    geo = v.places(spark, d)
    return c.join(geo, c.c_nationkey == geo.n_nationkey).select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "innovation", "error")


_DIST = "2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - i.p_lat) / 2), 2) + cos(radians(i.p_lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - i.p_lon) / 2), 2))))"


@query(f"""WITH {v.GRID}, {v.GEO}, b AS (SELECT lat_idx, lon_idx, -75.0 + 3 * CAST(lat_idx AS DOUBLE) AS lat, 15.0 * CAST(lon_idx AS DOUBLE) AS lon FROM grid),
  i AS (SELECT lat AS p_lat, lon AS p_lon, innovation, error FROM (SELECT c_nationkey, round(avg(c_acctbal), 4) AS innovation, count(*) * 10.0 AS error FROM customer GROUP BY 1) JOIN geo ON c_nationkey = n_nationkey),
  p AS (SELECT lat_idx, lon_idx, innovation, CAST(error AS DOUBLE) AS error, {_DIST} / 1000 AS c FROM b, i WHERE {_DIST} <= 2000),
  w AS (SELECT *, CASE WHEN c <= 1 THEN 1 - 5.0 / 3 * c * c + 0.625 * pow(c, 3) + pow(c, 4) / 2 - pow(c, 5) / 4 WHEN c < 2 THEN greatest(0, 4 - 5 * c + 5.0 / 3 * c * c + 0.625 * pow(c, 3) - pow(c, 4) / 2 + pow(c, 5) / 12 - 2.0 / 3 / c) ELSE 0 END AS rho FROM p)
  SELECT lat_idx, lon_idx, round(sum(250000 / (250000 + error * error) * innovation * rho) / sum(rho), 4) AS increment, count(*) AS n_obs FROM w WHERE rho > 1e-6 GROUP BY 1, 2""")
def threedvar_increment(spark, d):
    out = assimilation.three_d_var(_globe(spark, d), _innovations(spark, d), _CELLKEY, 1000.0, 500.0, kind="gaspari_cohn_cut")
    return out.select(*_CELLKEY, r("increment", 4).alias("increment"), "n_obs")


@query(f"WITH {v.OBS} SELECT variable, count(*) AS n, round(avg(value), 6) AS mean FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 36 HOUR AND TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 36 HOUR GROUP BY 1")
def fourdvar_window(spark, d):
    inside = assimilation.in_window(v.observations(spark, d), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 72.0)
    return inside.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query(f"WITH {v.GEO} SELECT n_nationkey, (SELECT CAST(min_by(i, (abs(-75.0 + 3 * i - lat), i)) AS INTEGER) FROM generate_series(1, 50) g(i)) AS lat_idx, (SELECT CAST(min_by(i, (abs(15.0 * i - lon - 4), i)) AS INTEGER) FROM generate_series(0, 24) g(i)) AS lon_idx FROM geo")
def obs_nearest_grid(spark, d):
    lats = spark.range(1, 51).select((F.lit(-75.0) + 3 * F.col("id")).alias("pos"), F.col("id").cast("int").alias("idx"))
    lons = spark.range(25).select((15.0 * F.col("id")).alias("pos"), F.col("id").cast("int").alias("idx"))
    obs = v.places(spark, d).withColumn("lon", F.col("lon") + 4)
    return assimilation.nearest_cells(obs, lats, lons).select("n_nationkey", "lat_idx", "lon_idx")


@query(f"WITH {v.GRID} SELECT count(*) AS n, round(sum(value), 2) AS total FROM (SELECT value FROM grid WHERE value IS NOT NULL UNION ALL SELECT value / 2 FROM grid)")
def unpivot_observations(spark, d):
    wide = v.cells(spark, d).select("lat_idx", "lon_idx", F.col("value").alias("price"), (F.col("value") / 2).alias("half"))
    obs = assimilation.observations_from_cells(wide, ["price", "half"], _CELLKEY)
    return obs.agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query(f"WITH {v.OBS} SELECT coalesce(CASE WHEN value > 400 THEN NULL END, CASE WHEN id % 50 = 0 THEN 'error not positive' ELSE 'none' END) AS why, count(*) AS n FROM obs GROUP BY 1")
def rejections(spark, d):
    obs = v.observations(spark, d).withColumn("error", F.when(F.col("id") % 50 == 0, 0.0).otherwise(1.0))
    return assimilation.rejected(obs).groupBy(F.coalesce("rejected", F.lit("none")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query()
def ensemble_perturbed(spark, d):
    return coupled.perturbed(v.cells(spark, d), 5, _CELLKEY).groupBy("member").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@query(f"""WITH {v.DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY t) AS step FROM daily), l AS (SELECT *, lag(value, 6) OVER w AS b, lead(step) OVER w IS NULL AS last FROM n WINDOW w AS (PARTITION BY variable ORDER BY step))
  SELECT variable, m AS member, round(CASE WHEN m = 0 THEN value ELSE (value + coalesce(b, value)) / 2 END, 4) AS value FROM l, (VALUES (0), (1)) v(m) WHERE last""")
def lagged_ensemble(spark, d):
    steps = v.daily(spark, d).withColumn("step", F.row_number().over(W.partitionBy("variable").orderBy("t")))
    return coupled.lagged(steps, ["variable"], 2).select("variable", "member", r("value", 4).alias("value"))


# Mesh and events


@query(f"""WITH {v.GRID}, w AS (SELECT lat_idx AS lat, lon_idx AS lon, value / 1000 AS wind_speed, value * 3 AS pressure FROM grid)
  SELECT * FROM (SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, 'typhoon' AS event_type, round(abs(pressure) / 99000 / 2 + abs(wind_speed) / 17 / 2, 6) AS intensity, CAST(row_number() OVER (ORDER BY abs(pressure) / 99000 / 2 + abs(wind_speed) / 17 / 2 DESC, lat, lon) AS INTEGER) AS rank FROM w WHERE pressure > 99000 AND wind_speed > 17) WHERE rank <= 20""")
def extreme_candidates_top20(spark, d):
    grid = v.cells(spark, d).select(F.col("lat_idx").cast("double").alias("lat"), F.col("lon_idx").cast("double").alias("lon"), (F.col("value") / 1000).alias("wind_speed"), (F.col("value") * 3).alias("pressure"))
    return mesh.event_candidates(grid).select("lat", "lon", "event_type", r("intensity").alias("intensity"), "rank")


_NEAR = "e.n = rest[1].n OR 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(e.lat - rest[1].lat) / 2), 2) + cos(radians(e.lat)) * cos(radians(rest[1].lat)) * pow(sin(radians(e.lon - rest[1].lon) / 2), 2)))) < 500"


@query(f"""WITH RECURSIVE {v.GRID}, w AS (SELECT CAST(lat_idx AS DOUBLE) AS lat, CAST(lon_idx AS DOUBLE) AS lon, abs(value * 3) / 99000 / 2 + abs(value / 1000) / 17 / 2 AS i FROM grid WHERE value * 3 > 99000 AND value / 1000 > 17),
  o AS (SELECT *, row_number() OVER (ORDER BY i DESC, lat, lon) AS n FROM w QUALIFY n <= 20), r AS (
    SELECT list(o ORDER BY n) AS rest, list(o) FILTER (n < 0) AS own, 0 AS k FROM o
    UNION ALL SELECT list_filter(rest, lambda e: NOT ({_NEAR})), list_filter(rest, lambda e: {_NEAR}), k + 1 FROM r WHERE len(rest) > 0)
  SELECT 'typhoon' AS event_type, round(list_avg(list_transform(own, lambda e: e.lat)), 6) AS lat, round(list_avg(list_transform(own, lambda e: e.lon)), 6) AS lon, round(list_max(list_transform(own, lambda e: e.i)), 6) AS intensity,
    round(list_max(list_transform(own, lambda e: least(1.0, e.i))), 6) AS confidence, len(own) AS members FROM r WHERE k > 0""")
def event_clusters(spark, d):
    grid = v.cells(spark, d).select(F.col("lat_idx").cast("double").alias("lat"), F.col("lon_idx").cast("double").alias("lon"), (F.col("value") / 1000).alias("wind_speed"), (F.col("value") * 3).alias("pressure"))
    found = mesh.cluster_events(mesh.event_candidates(grid))
    return found.select("event_type", *(r(c).alias(c) for c in ("lat", "lon", "intensity", "confidence")), "members")


@query(f"WITH {v.GEO} SELECT n_nationkey, CAST(floor((lat + 90) / 10) * 36 + floor(lon / 10) AS BIGINT) AS cell_id FROM geo WHERE lat < 90 AND lon < 360")
def mesh_point_lookup(spark, d):
    return mesh.locate(v.places(spark, d), mesh.base_mesh(spark, 10.0), 10.0).select("n_nationkey", "cell_id")


@query(f"WITH {v.GEO}, hit AS (SELECT DISTINCT CAST(floor((lat + 90) / 10) * 36 + floor(lon / 10) AS BIGINT) AS id FROM geo WHERE lon < 360) SELECT 0 AS level, 648 - count(*) AS cells FROM hit UNION ALL SELECT 1, 4 * count(*) FROM hit")
def mesh_refine(spark, d):
    base = mesh.base_mesh(spark, 10.0)
    hit = mesh.locate(v.places(spark, d), base, 10.0).select("cell_id")
    return mesh.mesh_statistics(mesh.refine(base, hit)).select("level", "cells")


@query(f"WITH {v.GRID} SELECT CAST(floor((lat_idx * 3 - 75 + 90) / 10) * 36 + floor(lon_idx * 14 / 10.0) AS BIGINT) AS cell_id, round(max(value), 4) AS top FROM grid GROUP BY 1 HAVING max(value) > 40000")
def mesh_criteria(spark, d):
    cells = v.cells(spark, d).select((F.col("lat_idx") * 3.0 - 75).alias("lat"), (F.col("lon_idx") * 14.0).alias("lon"), "value")
    return mesh.cells_to_refine(mesh.locate(cells, mesh.base_mesh(spark, 10.0), 10.0), "value", ">", 40000.0).select("cell_id", r("top", 4).alias("top"))


# Ingestion


def _chunks(spark, d) -> DataFrame:
    return v.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), "ts", (F.col("event_id") % 1000 + 1).alias("bytes"))


@query("""SELECT event_id AS id, CAST(sum(event_id % 1000 + 1) OVER w AS BIGINT) AS window_bytes, count(*) OVER w AS window_chunks FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 10 SECONDS PRECEDING AND CURRENT ROW)""")
def ingest_rate_10s(spark, d):
    return ingest.rate_10s(_chunks(spark, d), ["source"]).select("id", "window_bytes", "window_chunks")


def _records(spark, d) -> DataFrame:
    n = F.row_number().over(W.partitionBy("source").orderBy("ts", "id"))
    kind = F.when(F.col("n") % 100 == 60, "stop").when(F.col("n") % 100 == 80, "start").otherwise("data")
    return _chunks(spark, d).withColumn("n", n).withColumn("kind", kind).drop("n")


@query("""WITH n AS (SELECT event_type AS source, event_id % 1000 + 1 AS bytes, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events), s AS (SELECT *, n % 100 >= 60 AND n % 100 < 80 AS stopped, n % 100 IN (60, 80) AND n >= 60 AS control, (n + 20) // 100 AS session FROM n), m AS (SELECT source, max(session) AS last FROM s GROUP BY 1)
  SELECT source, last AS session, count_if(session = last AND NOT stopped AND NOT control) AS session_chunks, count_if(NOT stopped AND NOT control) AS total_chunks, CAST(sum(CASE WHEN NOT stopped AND NOT control THEN bytes ELSE 0 END) AS BIGINT) AS total_bytes, count_if(stopped AND NOT control) AS rejected FROM s JOIN m USING (source) GROUP BY 1, 2""")
def session_counters(spark, d):
    return ingest.dashboard(ingest.sessions(_records(spark, d))).select("source", "session", "session_chunks", "total_chunks", "total_bytes", "rejected")


@query("SELECT event_type AS source, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS GROUP BY 1")
def retention_filter(spark, d):
    kept = readers.retained(v.table(spark, d, "events"), 7, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), "ts")
    return kept.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2")
def windows_hourly(spark, d):
    out = ingest.windowed(v.table(spark, d, "events"), ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("event_type").alias("source"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def activity_sessions(spark, d):
    return ingest.gaps(v.table(spark, d, "events"), ["user_id"], gap="6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


# Tenancy, lineage, versions


def _tenant_events(spark, d) -> DataFrame:
    e = v.table(spark, d, "events")
    sign = F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0)
    return e.select("event_id", F.concat(F.lit("t"), F.col("user_id") % 10).alias("tenant_id"), (sign * v.rounded(F.col("value"), 2)).alias("amount"))


_TENANT = "te AS (SELECT event_id, 't' || (user_id % 10) AS tenant_id, (CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE 1.0 END) * round(value, 2) AS amount FROM events)"


@query(f"WITH {_TENANT}, s AS (SELECT *, sum(amount) OVER w AS s FROM te WINDOW w AS (PARTITION BY tenant_id ORDER BY event_id)), c AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY tenant_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS used FROM s) SELECT event_id, tenant_id, round(used, 2) AS used FROM c")
def tenant_usage_fold(spark, d):
    return tenancy.usage(_tenant_events(spark, d)).select("event_id", "tenant_id", r("used", 2).alias("used"))


@query(f"WITH {_TENANT}, s AS (SELECT *, sum(amount) OVER w AS s FROM te WINDOW w AS (PARTITION BY tenant_id ORDER BY event_id)), c AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY tenant_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS used FROM s), l AS (SELECT tenant_id, max_by(used, event_id) AS used FROM c GROUP BY 1) SELECT tenant_id, round(used, 2) AS used, round(20000 - used, 2) AS remaining, round(least(100, used / 20000 * 100), 4) AS percent, used > 20000 AS over_quota FROM l")
def quota_utilization(spark, d):
    events = _tenant_events(spark, d)
    quotas = events.select("tenant_id").distinct().withColumn("quota", F.lit(20000.0))
    s = tenancy.summary(events, quotas)
    return s.select("tenant_id", r("used", 2).alias("used"), r("remaining", 2).alias("remaining"), r("percent", 4).alias("percent"), "over_quota")


@query("""WITH q AS (SELECT o_orderkey AS request_id, 'r' || (o_orderkey % 20) AS resource_id, 'u' || (o_custkey % 30) AS user_id, 'n' || (o_custkey % 5) AS tenant_id, CASE WHEN o_custkey % 97 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'write' END AS permission FROM orders)
  SELECT request_id, CASE WHEN CAST(substr(user_id, 2) AS INT) % 3 = 0 AND CAST(substr(resource_id, 2) AS INT) % 4 = CAST(substr(user_id, 2) AS INT) % 4 AND permission = 'write' THEN 'user' WHEN role = 'admin' THEN 'admin'
    WHEN CAST(substr(tenant_id, 2) AS INT) = CAST(substr(resource_id, 2) AS INT) % 5 AND permission = 'read' THEN 'tenant' WHEN permission = 'read' AND CAST(substr(resource_id, 2) AS INT) % 10 = 1 THEN 'public' ELSE 'none' END AS via FROM q""")
def acl_check(spark, d):
    o = v.table(spark, d, "orders")
    requests = o.select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("r"), F.col("o_orderkey") % 20).alias("resource_id"), F.concat(F.lit("u"), F.col("o_custkey") % 30).alias("user_id"), F.concat(F.lit("n"), F.col("o_custkey") % 5).alias("tenant_id"),
                        F.when(F.col("o_custkey") % 97 == 0, "admin").otherwise("user").alias("role"), F.when(F.col("o_orderkey") % 2 == 0, "read").otherwise("write").alias("permission"))
    rows = [(f"r{i}", "user", f"u{j}", ["write"], None, 1) for i in range(20) for j in range(0, 30, 3) if i % 4 == j % 4]
    rows += [(f"r{i}", "user", f"u{j}", ["read", "write"], 5, 2) for i in range(20) for j in range(1, 30, 3)]
    rows += [(f"r{i}", "tenant", f"n{i % 5}", ["read"], None, 1) for i in range(20)] + [(f"r{i}", "public", "*", ["read"], 100, 1) for i in range(1, 20, 10)]
    acl = spark.createDataFrame(rows, "resource_id string, grantee_kind string, grantee string, permissions array<string>, expires_at int, granted_at int")
    return tenancy.access(requests, acl, F.lit(10)).select("request_id", F.coalesce("via", F.lit("none")).alias("via"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS target, (o_orderkey * 7 + o_custkey) // 10 AS source FROM orders), r(node, steps) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.source, steps + 1 FROM r JOIN e ON e.target = r.node WHERE steps < 100)
  SELECT node, min(steps) AS steps FROM r GROUP BY node""")
def lineage_upstream(spark, d):
    o = v.table(spark, d, "orders")
    edges = o.select(F.col("o_orderkey").alias("target"), F.expr("(o_orderkey * 7 + o_custkey) div 10").alias("source"))
    start = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node"))
    return tenancy.lineage(spark, edges, start)


@query("WITH RECURSIVE l(task, level) AS (SELECT 0, 0 UNION ALL SELECT task + 1, level + 1 FROM l WHERE task < 24) SELECT n_name AS task, CAST(n_nationkey // 5 AS INTEGER) AS level FROM nation")
def dag_levels(spark, d):
    rows = v.table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 tasks
    names = {x.n_nationkey: x.n_name for x in rows}
    flow = orchestration.Workflow(orchestration.Task(n, int, [names[k - 5]] if k >= 5 else []) for k, n in names.items())
    return flow.levels(spark)


@query("""WITH c AS (SELECT o_custkey % 50 AS dataset, o_orderkey AS created_at, CASE o_orderkey % 7 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' WHEN 2 THEN 'minor' ELSE 'patch' END AS kind FROM orders),
  n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY created_at) AS rn FROM c), a AS (SELECT *, 1 + sum(CASE WHEN kind = 'major' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset ORDER BY created_at) AS major FROM n),
  b AS (SELECT *, sum(CASE WHEN kind = 'minor' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, major ORDER BY created_at) AS minor FROM a), p AS (SELECT *, sum(CASE WHEN kind = 'patch' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, major, minor ORDER BY created_at) AS patch FROM b)
  SELECT created_at, major || '.' || minor || '.' || patch AS version FROM p""")
def version_bump(spark, d):
    kind = F.when(F.col("o_orderkey") % 7 == 0, "major").when((F.col("o_orderkey") % 7).isin(1, 2), "minor").otherwise("patch")
    changes = v.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("dataset"), F.col("o_orderkey").alias("created_at"), kind.alias("change_type"))
    return tenancy.versions(changes).select("created_at", "version")


@query("""WITH s AS (SELECT s_nationkey AS k, list_sort(list_distinct(list(s_suppkey % 7) FILTER (s_suppkey % 2 = 0))) AS a, list_sort(list_distinct(list(s_suppkey % 7) FILTER (s_suppkey % 2 = 1))) AS b FROM supplier GROUP BY 1)
  SELECT k, CAST(list_filter(coalesce(b, []), lambda e: NOT list_contains(coalesce(a, []), e)) AS VARCHAR) AS added, CAST(list_filter(coalesce(a, []), lambda e: NOT list_contains(coalesce(b, []), e)) AS VARCHAR) AS removed FROM s""")
def version_diff(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 7).alias("x"), (F.col("s_suppkey") % 2).alias("h"))
    s = s.groupBy("k").agg(F.collect_set(F.when(F.col("h") == 0, F.col("x"))).alias("a"), F.collect_set(F.when(F.col("h") == 1, F.col("x"))).alias("b"))
    added, removed = tenancy.version_diff(F.col("a"), F.col("b"))
    return s.select("k", added.cast("string").alias("added"), removed.cast("string").alias("removed"))


@query()
def table_checksums(spark, d):
    return tenancy.checksum(v.cells(spark, d), ["lat_idx"])


@query("""SELECT event_id, ['>', '>=', '<', '<=', '==', '?'][1 + event_id % 6] AS op, CASE event_id % 6 WHEN 1 THEN value >= 250 WHEN 2 THEN value < 250 WHEN 3 THEN value <= 250 WHEN 4 THEN abs(value - 250) < 1e-10 ELSE value > 250 END AS ok FROM events""")
def compare_operators(spark, d):
    op = F.get(F.array(*map(F.lit, (">", ">=", "<", "<=", "==", "?"))), (F.col("event_id") % 6).cast("int"))
    e = v.table(spark, d, "events").withColumn("op", op)
    return e.select("event_id", "op", expr.compare(F.col("value"), F.col("op"), F.lit(250.0)).alias("ok"))


# Orchestration, coupled model, payloads


@query()
def bayesian_optimum(spark, d):
    best, value, _ = orchestration.bayesian(lambda p: -((p["x"] - 0.3) ** 2), [orchestration.Range("x")], 15, 5)
    return spark.createDataFrame([(best["x"], value)], "x double, value double")


@query()
def coupled_run(spark, d):
    state = coupled.run(spark, 6.0, 10800.0, 15.0)
    out = coupled.combined(state)
    return out.agg(*(F.avg(c).alias(c) for c in out.columns if c not in ("lat", "lon")))


@query(f"WITH {_GRADIENT} SELECT count(*) AS n, round(avg(value), 4) AS mean FROM grid")
def matrix_ingest(spark, d):
    rows = v.cells(spark, d).groupBy("lat_idx").agg(F.sort_array(F.collect_list(F.struct("lon_idx", "value"))).alias("row"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("lat_idx", "row"))).alias("m"))
    matrix = one.select(F.transform("m", lambda x: F.transform(x["row"], lambda y: y["value"])).alias("values"), F.transform("m", lambda x: x["lat_idx"].cast("double")).alias("lats"), F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: i.cast("double")).alias("lons"))
    return readers.matrix_cells(matrix, "values", "lats", "lons").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


@query("""WITH p AS (SELECT s_nationkey AS station, s_suppkey AS depth, s_acctbal AS t, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal / 10 END AS s FROM supplier) SELECT station, CAST(depth AS DOUBLE) AS depth, t AS water_temperature, s AS salinity FROM p""")
def buoy_profiles(spark, d):
    s = v.table(spark, d, "supplier")
    entry = lambda c, when: F.map_from_entries(F.array_compact(F.collect_list(F.when(when, F.struct(F.col("s_suppkey").cast("double"), c)))))
    maps = s.groupBy(F.col("s_nationkey").alias("station")).agg(entry(F.col("s_acctbal"), F.lit(True)).alias("water_temperature"), entry(F.col("s_acctbal") / 10, F.col("s_suppkey") % 3 > 0).alias("salinity"))
    return readers.buoy_profile(maps).select("station", "depth", "water_temperature", "salinity")


@query(f"WITH {v.OBS}, s AS (SELECT variable, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM obs GROUP BY 1) UNPIVOT s ON mean, std, min, max INTO NAME statistic VALUE value")
def report_rows(spark, d):
    s = statistics.describe(v.observations(spark, d), ["variable"])
    return sinks.report_rows(s.select("variable", r("mean").alias("mean"), r("std").alias("std"), "min", "max"))


@query()
def field_payloads(spark, d):
    return sinks.field_payload(v.cells(spark, d), ["variable"])


@query(f"WITH {v.DAILY} SELECT variable, t, value AS min, value AS max FROM daily")
def animation_frames(spark, d):
    return sinks.frames(v.daily(spark, d), "t", ["variable"]).select("variable", "t", "min", "max")


from . import catalog_assimilation, catalog_calibration, catalog_more, catalog_platform, catalog_sources, catalog_streams  # noqa: E402, F401  they register their queries with these
