"""Queries over events' likeness, ensembles, tenants and versions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import coupled, fingerprint, regrid, similar, tenancy
from ..sources import sinks
from . import virtual as v
from .catalog import _CELLKEY, _own_axis, query, r

# Search by combined likeness

_LIKENESS = """t AS (SELECT *, CASE WHEN len(v) > 0 AND len(v) = len(qv) THEN 0.5 * (1 - least(abs(d - qd) / greatest(d, qd, 1), 1)) + 0.5 * greatest(0, least(1, coalesce(list_cosine_similarity(v, qv), 0))) ELSE 0 END AS temporal FROM pairs),
  s AS (SELECT query_id, event_id, temporal, spatial, round(0.6 * temporal + 0.4 * spatial, 9) AS score FROM t),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, event_id, rank, round(score, 6) AS score, round(temporal, 6) AS temporal, round(spatial, 6) AS spatial FROM k WHERE rank <= 10"""


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "event_id", "rank", *(r(c).alias(c) for c in ("score", "temporal", "spatial")))


@query(f"""WITH e AS (SELECT vec_id AS event_id, coalesce(label, 0) * 3.0 AS d, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CASE WHEN vec_id % 3 > 0 THEN CAST(embedding[1] AS DOUBLE) END AS a, CASE WHEN vec_id % 5 > 0 THEN CAST(embedding[2] AS DOUBLE) END AS b FROM embeddings),
  q AS (SELECT event_id AS query_id, d AS qd, v AS qv, a AS qa, b AS qb FROM e WHERE event_id % 20 = 0),
  m AS (SELECT *, 1 - abs(a - qa) / greatest(abs(a), abs(qa), 1e-10) AS sa, 1 - abs(b - qb) / greatest(abs(b), abs(qb), 1e-10) AS sb FROM e, q WHERE event_id <> query_id),
  pairs AS (SELECT *, CASE WHEN a + qa IS NULL AND b + qb IS NULL THEN 0.0 WHEN a + qa IS NULL THEN sb WHEN b + qb IS NULL THEN sa ELSE (sa + sb) / 2 END AS spatial FROM m),
  {_LIKENESS}""")
def similar_events(spark, d):
    """Embeddings as events of two variables, of which some lack one."""
    x = lambda i: F.col("vector")[i].cast("double")
    means = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.when(F.col("event_id") % 3 > 0, x(0)), F.when(F.col("event_id") % 5 > 0, x(1))))
    e = v.vectors(spark, d).select("event_id", (F.coalesce("label", F.lit(0)) * 3.0).alias("duration"), "vector", means.alias("means"))
    return _found(similar.find(e, e.where("event_id % 20 = 0").withColumnRenamed("event_id", "query_id"), 10))


def _features(source: str, event: str) -> str:
    return f"""(SELECT {event} AS event, epoch(max(ts)) / 86400 - epoch(min(ts)) / 86400 AS d, [avg(value), stddev_pop(value), min(value), max(value), quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75),
    CASE WHEN stddev_pop(value) > 0 AND count(value) > 2 THEN avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) ELSE 0 END, CASE WHEN stddev_pop(value) > 0 AND count(value) > 3 THEN avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 ELSE 0 END] AS v
    FROM (SELECT *, avg(value) OVER (PARTITION BY {event}) AS mu FROM {source}) GROUP BY 1)"""


@query(f"""WITH {v.OBS}, o AS (SELECT *, station % 40 AS event FROM obs), p AS (SELECT *, 'query' AS event FROM obs WHERE id % 4 = 0),
  e AS {_features('o', 'event')}, q AS {_features('p', 'event')}, em AS (SELECT event, variable, avg(value) AS m FROM o GROUP BY 1, 2), qm AS (SELECT variable, avg(value) AS qm FROM p GROUP BY 1),
  sp AS (SELECT event, avg(1 - abs(m - qm) / greatest(abs(m), abs(qm), 1e-10)) AS spatial FROM em JOIN qm USING (variable) GROUP BY 1),
  pairs AS (SELECT 'query' AS query_id, e.event AS event_id, e.d, e.v, q.d AS qd, q.v AS qv, coalesce(spatial, 0) AS spatial FROM e LEFT JOIN sp ON sp.event = e.event, q),
  {_LIKENESS}""")
def similar_to_pattern(spark, d):
    """Events made of forty parts of the stations, and a quarter of all rows as the pattern."""
    obs = v.observations(spark, d)
    days = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400e6
    events = similar.described(obs.withColumn("event_id", F.col("station") % 40), ["event_id"], days)
    return _found(similar.by_pattern(events, obs.where("id % 4 = 0"), days, 10))


@query("""WITH a AS (SELECT o_orderpriority AS variable, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'), b AS (SELECT o_orderpriority AS variable, o_totalprice AS value FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'),
  x AS (SELECT variable, count(value) AS n_event, avg(value) AS me, var_samp(value) AS ve FROM a GROUP BY 1), y AS (SELECT variable, count(value) AS n_background, avg(value) AS mb, var_samp(value) AS vb, stddev_pop(value) AS sd FROM b GROUP BY 1)
  SELECT variable, n_event, n_background, round(me - mb, 4) AS delta, round(100 * (me - mb) / mb, 4) AS percent, round((me - mb) / sd, 6) AS sigma, round((me - mb) / sqrt(ve / n_event + vb / n_background), 6) AS t FROM x JOIN y USING (variable) WHERE n_event > 1 AND n_background > 1""")
def attribution_datasets(spark, d):
    """Two datasets of which each has a variable that the other lacks."""
    orders = v.table(spark, d, "orders").select(F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    target, background = orders.where("o_orderstatus = 'F' AND variable <> '1-URGENT'"), orders.where("o_orderstatus = 'O' AND variable <> '5-LOW'")
    out = fingerprint.attribution_between(target, background)
    return out.select("variable", "n_event", "n_background", r("delta", 4).alias("delta"), r("percent", 4).alias("percent"), r("sigma").alias("sigma"), r("t").alias("t"))


# Ensembles whose noise any engine can work out

_UNIFORM = "((CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _normal(seed: int, key: str) -> str:
    u, w = (_UNIFORM.format(f"'{s}:' || {key}") for s in (2 * seed, 2 * seed + 1))
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {w}))"


_Z = f"m AS (SELECT CAST(i AS INTEGER) AS member FROM generate_series(0, 2) g(i)), z AS (SELECT lat_idx, lon_idx, member, value, {_normal(42, '''member || ':' || lat_idx || ':' || lon_idx || ':price' ''')} AS z FROM grid, m)"


@query(f"WITH {v.GRID}, {_Z}, s AS (SELECT stddev_pop(value) AS s FROM grid) SELECT lat_idx, lon_idx, member, round(value + 0.05 * s * z, 4) AS value FROM z, s")
def ensemble_random_members(spark, d):
    out = coupled.perturbed(v.cells(spark, d), 3, _CELLKEY, noise=expr.digest_normal)
    return out.select(*_CELLKEY, "member", r("value", 4).alias("value"))


@query(f"WITH {v.GRID}, {_Z} SELECT lat_idx, lon_idx, member, round(value + 2 * z / sqrt(avg(z * z) OVER (PARTITION BY member)), 4) AS value FROM z")
def ensemble_bred_members(spark, d):
    out = coupled.perturbed(v.cells(spark, d), 3, _CELLKEY, "bred", 2.0, noise=expr.digest_normal)
    return out.select(*_CELLKEY, "member", r("value", 4).alias("value"))


@query(f"""WITH {v.GRID}, n AS (SELECT CAST(max(lat_idx) + 1 AS BIGINT) AS n, CAST(max(lon_idx) + 1 AS BIGINT) AS m, stddev_pop(value) AS s FROM grid), mm AS (SELECT CAST(i AS INTEGER) AS member FROM generate_series(0, 1) g(i)),
  z AS (SELECT member, a.i AS i, b.j AS j, {_normal(200, "'price:' || member || ':' || a.i || ':' || b.j")} AS z FROM n, mm, generate_series(0, n - 1) a(i), generate_series(0, m - 1) b(j)),
  k AS (SELECT o, exp(-0.5 * o * o) AS w FROM generate_series(-4, 4) g(o)), kn AS (SELECT o, w / (SELECT sum(w) FROM k) AS w FROM k),
  c AS (SELECT lat_idx, lon_idx, value, member, a.w * b.w AS w, ((lat_idx + a.o) % (2 * n) + 2 * n) % (2 * n) AS i, ((lon_idx + b.o) % (2 * m) + 2 * m) % (2 * m) AS j, n, m, s FROM grid, n, mm, kn a, kn b)
  SELECT lat_idx, lon_idx, c.member, round(any_value(value) + 0.05 * any_value(s) * sum(w * z), 4) AS value FROM c JOIN z ON z.member = c.member AND z.i = CASE WHEN c.i < n THEN c.i ELSE 2 * n - 1 - c.i END AND z.j = CASE WHEN c.j < m THEN c.j ELSE 2 * m - 1 - c.j END GROUP BY 1, 2, 3""")
def ensemble_smooth_members(spark, d):
    out = coupled.generated(v.cells(spark, d), 2, _CELLKEY, "stochastic", sigma=1.0, noise=expr.digest_normal)
    return out.select(*_CELLKEY, "member", r("value", 4).alias("value"))


# Regridding between components

_SPOTS = ([-1.5, 1.0, 7.25, 25.0, 49.5, 53.0], [-0.5, 0.25, 12.0, 23.75, 26.5])


def _clipped(name: str, column: str, spots: list[float]) -> str:
    return f"""{name}s AS (SELECT DISTINCT {column} AS i FROM grid), {name}t AS (SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS t, p FROM (SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in spots)}]) AS p)),
  {name}b AS (SELECT t, p, greatest((SELECT min(i) FROM {name}s), least((SELECT max(i) FROM {name}s WHERE i < (SELECT max(i) FROM {name}s)), coalesce((SELECT max(i) FROM {name}s WHERE i < p), (SELECT min(i) FROM {name}s)))) AS i0 FROM {name}t),
  {name}c AS (SELECT *, (SELECT min(i) FROM {name}s WHERE i > i0) AS i1 FROM {name}b),
  {name} AS (SELECT t, i0 AS i, 1 - (p - i0) / (i1 - i0) AS w FROM {name}c WHERE p <> i1 UNION ALL SELECT t, i1, (p - i0) / (i1 - i0) FROM {name}c WHERE p <> i0)"""


@query(f"""WITH {v.GRID}, {_clipped('la', 'lat_idx', _SPOTS[0])}, {_clipped('lo', 'lon_idx', _SPOTS[1])}
  SELECT la.t AS lat_t, lo.t AS lon_t, round(sum(value * la.w * lo.w), 4) AS value FROM grid JOIN la ON lat_idx = la.i JOIN lo ON lon_idx = lo.i GROUP BY 1, 2""")
def regrid_coupled(spark, d):
    """As components exchange fields: bilinear, going on in a straight line beyond the grid."""
    grid = v.cells(spark, d)
    axis = lambda c, spots: regrid.brackets(_own_axis(grid, c), spark.createDataFrame(list(enumerate(spots)), "idx int, pos double"), extrapolate=True)
    out = regrid.bilinear(grid, axis("lat_idx", _SPOTS[0]), axis("lon_idx", _SPOTS[1]), fill_missing=False)
    return out.select("lat_t", "lon_t", r("value", 4).alias("value"))


# Payloads


@query(f"""WITH {v.OBS}, s AS (SELECT variable, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_pop(value) AS sd FROM obs GROUP BY 1)
  SELECT variable, CAST(i AS INTEGER) AS position, round(lo + (hi - lo) * i / 9, 4) AS level, round(mean, 4) AS mean, round(sd, 4) AS std FROM s, generate_series(0, 9) g(i)""")
def payload_levels(spark, d):
    """What a renderer reads from the JSON payloads of each variable."""
    fields = sinks.field_payload(v.observations(spark, d), ["variable"])
    kept = fields.select("variable", F.from_json("payload", "min double, max double, mean double, std double, levels array<double>").alias("p"))
    out = kept.select("variable", F.posexplode("p.levels").alias("position", "level"), F.col("p.mean").alias("mean"), F.col("p.std").alias("std"))
    return out.select("variable", "position", r("level", 4).alias("level"), r("mean", 4).alias("mean"), r("std", 4).alias("std"))


# Tenants and versions

_KINDS = ("storage_tb", "compute_hours", "jobs")
_EVENTS = f"""ev AS (SELECT c_nationkey AS tenant_id, ['{"', '".join(_KINDS)}'][1 + o_orderkey % 3] AS resource, o_orderkey AS event_id, CAST((CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END) * (o_custkey % 50) AS DOUBLE) AS amount FROM orders JOIN customer ON o_custkey = c_custkey),
  rs AS (SELECT *, sum(amount) OVER w AS s FROM ev WINDOW w AS (PARTITION BY tenant_id, resource ORDER BY event_id)),
  us AS (SELECT tenant_id, resource, max_by(s, event_id) - least(0, min(s)) AS used FROM rs GROUP BY 1, 2)"""


@query(f"""WITH {_EVENTS}, q AS (SELECT n_nationkey AS tenant_id, n_name AS name, 1000.0 + 100 * n_regionkey AS q1, 900.0 AS q2, CASE WHEN n_nationkey % 2 = 0 THEN 800.0 ELSE 0.0 END AS q3 FROM nation),
  w AS (SELECT q.*, {', '.join(f"coalesce((SELECT used FROM us WHERE us.tenant_id = q.tenant_id AND resource = '{k}'), 0) AS u{i}" for i, k in enumerate(_KINDS, 1))} FROM q)
  SELECT tenant_id, name, {', '.join(f"round(least(100, u{i} / greatest(q{i}, 1e-9) * 100), 4) AS {k}" for i, k in enumerate(_KINDS, 1))}, u1 > q1 OR u2 > q2 OR u3 > q3 AS over_quota, CAST((u1 > q1)::INT + (u2 > q2)::INT + (u3 > q3)::INT AS INTEGER) AS n_issues,
    (SELECT count(*) FROM customer WHERE c_nationkey = tenant_id) AS users, (SELECT count(*) FROM supplier WHERE s_nationkey = tenant_id) AS sandboxes FROM w""")
def tenant_status(spark, d):
    customers, orders = v.table(spark, d, "customer"), v.table(spark, d, "orders")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 3).cast("int"))
    amount = F.when(F.col("o_orderkey") % 4 == 0, -1.0).otherwise(1.0) * (F.col("o_custkey") % 50)
    events = orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("c_nationkey").alias("tenant_id"), kind.alias("resource"), F.col("o_orderkey").alias("event_id"), amount.alias("amount"))
    quotas = {"quota_storage_tb": 1000.0 + 100 * F.col("n_regionkey"), "quota_compute_hours": F.lit(900.0), "quota_jobs": F.when(F.col("n_nationkey") % 2 == 0, 800.0).otherwise(0.0)}
    tenants = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"), *(c.alias(n) for n, c in quotas.items()))
    parts = {"users": customers.select(F.col("c_nationkey").alias("tenant_id")), "sandboxes": v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("tenant_id"))}
    out = tenancy.system_status(tenants, events, parts, _KINDS)
    return out.select("tenant_id", "name", *(r(F.col("utilization")[k], 4).alias(k) for k in _KINDS), "over_quota", F.size("issues").alias("n_issues"), *parts)


@query("""WITH q AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 11 > 0 THEN 't' || c_custkey % 200 ELSE md5(c_custkey::VARCHAR) END AS tenant_id, CASE c_custkey % 4 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'nobody' WHEN 2 THEN 'viewer' END AS role, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS asked FROM customer),
  k AS (SELECT *, coalesce(lower(role), 'research') AS r, coalesce(lower(role), 'research') <> 'nobody' AS good FROM q), f AS (SELECT tenant_id, min(request) AS first FROM k WHERE good GROUP BY 1)
  SELECT request, k.tenant_id, r AS role, coalesce(asked, 10.0) AS quota_storage_tb, 1000.0::DOUBLE AS quota_compute_hours, CASE WHEN NOT good THEN 'unknown role' WHEN k.tenant_id IN (SELECT 't' || n_nationkey FROM nation) OR first <> request THEN 'exists' END AS error FROM k LEFT JOIN f ON f.tenant_id = k.tenant_id""")
def tenants_created(spark, d):
    c = F.col("c_custkey")
    requests = v.table(spark, d, "customer").select(
        c.alias("request"), F.when(c % 11 > 0, F.concat(F.lit("t"), (c % 200).cast("string"))).alias("tenant_id"), F.concat(F.lit("n"), c.cast("string")).alias("name"),
        F.when(c % 4 == 0, "ADMIN").when(c % 4 == 1, "nobody").when(c % 4 == 2, "viewer").alias("role"), F.when(c % 5 == 0, F.col("c_acctbal")).alias("quota_storage_tb"),
    )
    known = v.table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("tenant_id"))
    return tenancy.new_tenants(requests, known, ["request"]).select("request", "tenant_id", "role", "quota_storage_tb", "quota_compute_hours", "error")


@query("""WITH c AS (SELECT o_custkey AS dataset, o_orderkey AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN 'major' WHEN o_orderkey % 7 IN (1, 2) THEN 'minor' ELSE 'patch' END AS kind FROM orders),
  f AS (SELECT dataset, min(created_at) AS f, max(created_at) AS created_at, count(*) AS n_versions FROM c GROUP BY 1), l AS (SELECT c.* FROM c JOIN f ON f.dataset = c.dataset AND c.created_at > f.f),
  a AS (SELECT f.*, (SELECT count(*) FROM l WHERE l.dataset = f.dataset AND kind = 'major') AS major, coalesce((SELECT max(created_at) FROM l WHERE l.dataset = f.dataset AND kind = 'major'), -1) AS am FROM f),
  b AS (SELECT a.*, (SELECT count(*) FROM l WHERE l.dataset = a.dataset AND kind = 'minor' AND l.created_at > am) AS minor, coalesce((SELECT max(created_at) FROM l WHERE l.dataset = a.dataset AND kind = 'minor'), -1) AS an FROM a)
  SELECT dataset, created_at, n_versions, (major + 1) || '.' || minor || '.' || (SELECT count(*) FROM l WHERE l.dataset = b.dataset AND kind = 'patch' AND l.created_at > greatest(am, an)) AS version FROM b""")
def latest_versions(spark, d):
    kind = F.when(F.col("o_orderkey") % 7 == 0, "major").when((F.col("o_orderkey") % 7).isin(1, 2), "minor").otherwise("patch")
    changes = v.table(spark, d, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("created_at"), kind.alias("change_type"))
    return tenancy.latest_versions(changes)


@query("""WITH h AS (SELECT o_orderstatus, md5('=' || o_orderkey || '|=' || o_custkey || '|=' || o_orderstatus || '|' || CASE WHEN o_orderkey % 5 > 0 THEN '=' || o_orderpriority ELSE '' END) AS m FROM orders),
  s AS (SELECT o_orderstatus, count(*) AS n, sum(CAST('0x' || substr(m, 1, 8) AS BIGINT)) AS a, sum(CAST('0x' || substr(m, 9, 8) AS BIGINT)) AS b FROM h GROUP BY 1)
  SELECT o_orderstatus, n, sha256(n || ':' || a || ':' || b) AS checksum FROM s""")
def order_checksums(spark, d):
    priority = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority"))
    orders = v.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", priority.alias("priority"))
    return tenancy.checksum(orders, ["o_orderstatus"], portable=True)
