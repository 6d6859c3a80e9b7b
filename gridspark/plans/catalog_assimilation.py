"""Queries of assimilation by every method, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import assimilation
from . import virtual as v
from .catalog import _CELLKEY, _DIST, _globe, _innovations, query, r

CENTRE = "2024-01-13 00:00:00"
RADIUS, TILE = 1000.0, 8000.0
_GLOBE = "b AS (SELECT lat_idx, lon_idx, -75.0 + 3 * CAST(lat_idx AS DOUBLE) AS lat, 15.0 * CAST(lon_idx AS DOUBLE) AS lon, value FROM grid)"
_INNOVATIONS = "SELECT n_nationkey AS obs_id, lat AS p_lat, lon AS p_lon, innovation, error FROM (SELECT c_nationkey, round(avg(c_acctbal), 4) AS innovation, CAST(count(*) * 10 AS DOUBLE) AS error FROM customer GROUP BY 1) JOIN geo ON c_nationkey = n_nationkey"
_RHO = "CASE WHEN c <= 1 THEN 1 - 5.0 / 3 * c * c + 0.625 * pow(c, 3) + pow(c, 4) / 2 - pow(c, 5) / 4 WHEN c < 2 THEN greatest(0, 4 - 5 * c + 5.0 / 3 * c * c + 0.625 * pow(c, 3) - pow(c, 4) / 2 + pow(c, 5) / 12 - 2.0 / 3 / c) ELSE 0 END"


def _observed(spark, d) -> DataFrame:
    """The innovations with times, of which every seventh has none, and one that is to be refused."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast((p_lat + 60) / 5 as int))")
    number = ((F.col("p_lat") + 60) / 5).cast("int")
    out = _innovations(spark, d).withColumns({"obs_id": number, "ts": F.when(number % 7 > 0, at), "value": F.col("innovation")})
    return out.withColumn("error", F.when(number == 3, -1.0).otherwise(F.col("error")))


def _by_sql(inside: str) -> str:
    return f"""WITH {v.GRID}, {v.GEO}, {_GLOBE}, i AS (SELECT * FROM ({_INNOVATIONS}) WHERE obs_id <> 3 AND {inside}),
      p AS (SELECT lat_idx, lon_idx, innovation, error, {_DIST} / {RADIUS} AS c FROM b, i WHERE {_DIST} <= {2 * RADIUS}), w AS (SELECT *, {_RHO} AS rho FROM p),
      x AS (SELECT lat_idx, lon_idx, sum(250000 / (250000 + error * error) * innovation * rho) / sum(rho) AS x FROM w WHERE rho > 1e-6 GROUP BY 1, 2)
      SELECT lat_idx, lon_idx, round(coalesce(x, 0), 3) AS increment, round(value + coalesce(x, 0), 3) AS analysis FROM b LEFT JOIN x USING (lat_idx, lon_idx)"""


def _assimilated(spark, d, method: str) -> DataFrame:
    background = _globe(spark, d).select(*_CELLKEY, "lat", "lon", "value")
    out = assimilation.assimilate(method, background, _observed(spark, d), _CELLKEY, F.lit(CENTRE).cast("timestamp_ntz"), RADIUS, 500.0, 8 * 24.0, kind="gaspari_cohn_cut")
    return out.select(*_CELLKEY, r("increment", 3).alias("increment"), r("analysis", 3).alias("analysis"))


_INSIDE = "(obs_id % 7 = 0 OR obs_id BETWEEN 8 AND 16)"


@query(_by_sql("TRUE"))
def assimilate_3dvar(spark, d) -> DataFrame:
    return _assimilated(spark, d, "3dvar")


@query(_by_sql(_INSIDE))
def assimilate_4dvar(spark, d) -> DataFrame:
    return _assimilated(spark, d, "4dvar")


@query(_by_sql(_INSIDE))
def assimilate_hybrid(spark, d) -> DataFrame:
    return _assimilated(spark, d, "hybrid")


@query(f"""WITH {v.GRID}, {v.GEO}, {_GLOBE}, i AS (SELECT * FROM ({_INNOVATIONS}) WHERE obs_id BETWEEN 8 AND 16),
  p AS (SELECT lat_idx, lon_idx, innovation, error, {_DIST} / {RADIUS} AS c FROM b, i WHERE {_DIST} <= {2 * RADIUS}), w AS (SELECT *, {_RHO} AS rho FROM p)
  SELECT lat_idx, lon_idx, round(sum(250000 / (250000 + error * error) * innovation * rho) / sum(rho), 3) AS increment, count(*) AS n_obs FROM w WHERE rho > 1e-6 GROUP BY 1, 2""")
def fourdvar_analysis(spark, d) -> DataFrame:
    obs = _innovations(spark, d).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast((p_lat + 60) / 5 as int))"))
    background = _globe(spark, d).select(*_CELLKEY, "lat", "lon")
    out = assimilation.four_d_var(background, obs, _CELLKEY, F.lit(CENTRE).cast("timestamp_ntz"), 8 * 24.0, RADIUS, 500.0, kind="gaspari_cohn_cut")
    return out.select(*_CELLKEY, r("increment", 3).alias("increment"), "n_obs")


# The ensemble filter: three fields, each with all observations

_H, _S = f"({TILE} / 111.0)", repr(math.sin(TILE / (2 * 6371.0)))
_DIGITS = "CAST('0x' || substr(md5('0:' || obs_id || ':' || j), {}, 13) AS BIGINT)"
_DEV = "list_sum(list_transform(range(1, 5), lambda j: ({0}[j] - list_avg({0})) * (h[j] - list_avg(h)))) / 4"
_ENKF = f"""WITH RECURSIVE {v.GEO},
  m AS (SELECT l_returnflag AS field, l_linenumber % 4 AS member, -75.0 + 15 * (p_size // 5) AS lat, 15.0 * s_nationkey AS lon, avg(l_extendedprice) / 1000 AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
  c AS (SELECT field, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, list(value ORDER BY member) AS e FROM m GROUP BY ALL HAVING count(*) = 4),
  i AS (SELECT obs_id, p_lat, p_lon, 38 + innovation / 1000 AS value, 1.0 + error / 10000 AS error, floor((p_lat + 90) / {_H}) AS band FROM ({_INNOVATIONS})),
  t AS (SELECT *, cos(radians(least(greatest(abs(band * {_H} - 90), abs((band + 1) * {_H} - 90)), 90))) AS narrow FROM i),
  n AS (SELECT *, CASE WHEN narrow <= {_S} THEN 1 ELSE floor(360 / degrees(2 * asin(least(1, {_S} / greatest(narrow, 1e-9))))) END AS n FROM t),
  o AS (SELECT *, row_number() OVER (ORDER BY 2 * (band % 2) + floor(p_lon / 360 * greatest(n - n % 2, 1)) % 2, obs_id) AS k,
    list_transform(range(0, 4), lambda j: error * sqrt(-2 * ln(({_DIGITS.format(1)} + 0.5) / pow(16.0, 13))) * cos(2 * pi() * (({_DIGITS.format(14)} + 0.5) / pow(16.0, 13)))) AS noise FROM n),
  s AS (
    SELECT field, lat, lon, e, CAST(0 AS BIGINT) AS k FROM c
    UNION ALL
    SELECT field, lat, lon, CASE WHEN rho > 0 THEN list_transform(range(1, 5), lambda j: e[j] + {_DEV.format('e').replace('j:', 'q:').replace('[j]', '[q]')} * rho / ({_DEV.format('h').replace('j:', 'q:').replace('[j]', '[q]')} + error * error) * (value + noise[j] - h[j])) ELSE e END, k FROM (
      SELECT *, {_RHO} AS rho FROM (
        SELECT b.field, b.lat, b.lon, b.e, i.k, i.error, i.value, i.noise, {_DIST} / {RADIUS} AS c, first_value(b.e) OVER (PARTITION BY b.field ORDER BY abs(b.lat - i.p_lat) + abs(b.lon - i.p_lon), b.lat, b.lon) AS h FROM s b JOIN o i ON i.k = b.k + 1)))
  SELECT field AS "group", lat, lon, round(list_avg(e), 5) AS mean, round(list_stddev_pop(e), 5) AS spread FROM s WHERE k = (SELECT max(k) FROM o)"""


@query(_ENKF)
def enkf_analysis(spark, d) -> DataFrame:
    lines = v.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    part, supplier = v.table(spark, d, "part").select("p_partkey", "p_size"), v.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    both = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    lat, lon = (-75 + 15.0 * F.expr("p_size div 5")).alias("lat"), (15.0 * F.col("s_nationkey")).alias("lon")
    members = both.groupBy(F.col("l_returnflag").alias("field"), (F.col("l_linenumber") % 4).alias("member"), lat, lon).agg((F.avg("l_extendedprice") / 1000).alias("value"))
    members = members.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("field", "lat", "lon"))).where("n = 4").drop("n")  # cells that all members have
    obs = _innovations(spark, d).select(((F.col("p_lat") + 60) / 5).cast("int").alias("obs_id"), "p_lat", "p_lon", (38 + F.col("innovation") / 1000).alias("value"), (1 + F.col("error") / 10000).alias("error"))
    obs = obs.withColumn("field", F.explode(F.array(*map(F.lit, "ANR"))))
    out = assimilation.enkf(members, obs, "field", RADIUS, tile_km=TILE)
    return out.select("group", "lat", "lon", r("mean", 5).alias("mean"), r("spread", 5).alias("spread"))


@query("""WITH e AS (SELECT ['enkf', '3DVar', 'hybrid', 'unheard of', 'LETKF', '4dvar', 'etkf'][1 + event_id % 7] AS method FROM events)
  SELECT method, CASE WHEN lower(method) = '3dvar' THEN 'three_d_var' WHEN lower(method) IN ('4dvar', 'hybrid') THEN 'four_d_var' ELSE 'enkf' END AS procedure, count(*) AS n FROM e GROUP BY 1, 2""")
def assimilation_methods(spark, d) -> DataFrame:
    """Requests by the method they name, and the procedure that it means."""
    names = F.array(*map(F.lit, ("enkf", "3DVar", "hybrid", "unheard of", "LETKF", "4dvar", "etkf")))
    asked = v.table(spark, d, "events").select(F.get(names, (F.col("event_id") % 7).cast("int")).alias("method"))
    return asked.withColumn("procedure", assimilation.procedure_of(F.col("method"))).groupBy("method", "procedure").agg(F.count(F.lit(1)).alias("n"))
