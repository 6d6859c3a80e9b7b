"""Further queries of the grid engine and their SQL, registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import assimilation, coupled, fingerprint, mesh, orchestration, quality, series, tenancy
from ..sources import readers, sinks
from ..streaming import ingest
from . import facade
from . import virtual as v
from .catalog import _CELLKEY, _DIST, _globe, _innovations, query, r

# Ranges and cleaning

NAMES = ["temperature", "sea_surface_temperature", "temperature_2m", "wind_speed_10m", "ocean_salinity", "vorticity", "surface_pressure", "cloud_cover", "Wind_Speed", "nothing known"]
_NAMED = "n AS (SELECT n_nationkey, [{}][1 + n_nationkey % 10] AS name FROM nation)".format(", ".join(f"'{x}'" for x in NAMES))
_TABLE = lambda name, ranges: f"{name}(pos, key, lo, hi) AS (VALUES {', '.join(f'''({i}, '{k}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))''' for i, (k, (lo, hi)) in enumerate(ranges.items()))})"
_RANGES = f"{_TABLE('cr', expr.CLEANER_RANGES)}, {_TABLE('er', expr.ENGINE_RANGES)}"


def _named(spark, d, key: str = "n_nationkey", table: str = "nation") -> DataFrame:
    return v.table(spark, d, table).withColumn("variable", F.get(F.array(*map(F.lit, NAMES)), (F.col(key) % 10).cast("int")))


@query(f"""WITH {_NAMED}, {_RANGES} SELECT n_nationkey, (SELECT lo FROM cr WHERE key = name) AS exact_low, (SELECT hi FROM cr WHERE key = name) AS exact_high,
  (SELECT min_by(lo, pos) FROM er WHERE contains(lower(name), key)) AS first_low, (SELECT min_by(hi, pos) FROM er WHERE contains(lower(name), key)) AS first_high,
  (SELECT max_by(hi, length(key)) FROM er WHERE contains(lower(name), key)) AS longest_high FROM n""")
def range_rules(spark, d):
    out = _named(spark, d)
    columns = {}
    for rule in ("exact", "first", "longest"):
        columns[f"{rule}_low"], columns[f"{rule}_high"] = expr.range_of(F.col("variable"), rule)
    return out.withColumns(columns).select("n_nationkey", "exact_low", "exact_high", "first_low", "first_high", "longest_high")


@query(f"""WITH {_RANGES}, e AS (SELECT [{', '.join(f"'{x}'" for x in NAMES)}][1 + event_id % 10] AS variable, value FROM events)
  SELECT variable, count_if(coalesce(value < lo OR value > hi, false)) AS n_exact, count_if(coalesce(value < flo OR value > fhi, false)) AS n_first FROM e LEFT JOIN cr ON key = variable
  LEFT JOIN (SELECT DISTINCT variable, (SELECT min_by(lo, pos) FROM er WHERE contains(lower(variable), key)) AS flo, (SELECT min_by(hi, pos) FROM er WHERE contains(lower(variable), key)) AS fhi FROM e) USING (variable) GROUP BY 1""")
def qc_ranges_by_table(spark, d):
    cells = _named(spark, d, "event_id", "events").select("event_id", "variable", "value")
    exact, first = (quality.range_check(cells, rule=rule).groupBy("variable").agg(F.count_if("failed").alias(f"n_{rule}")) for rule in ("exact", "first"))
    return exact.join(first, "variable")


@query(f"""WITH {v.GRID}, c AS (SELECT lat_idx, lon_idx, (lat_idx * 7 + lon_idx * 3) % 11 = 0 AS bad, value FROM grid),
  n AS (SELECT lat_idx, lon_idx, bad, CASE WHEN NOT bad THEN value END AS x FROM c),
  w AS (SELECT *, CASE WHEN lag(lat_idx) OVER y IS NULL THEN last_value(x) OVER a ELSE lag(x) OVER y END AS p, CASE WHEN lead(lat_idx) OVER y IS NULL THEN first_value(x) OVER a ELSE lead(x) OVER y END AS q
    FROM n WINDOW y AS (PARTITION BY lon_idx ORDER BY lat_idx), a AS (PARTITION BY lon_idx ORDER BY lat_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  f AS (SELECT lat_idx, lon_idx, coalesce(x, (coalesce(p, q) + coalesce(q, p)) / 2) AS y FROM w)
  SELECT 'price' AS variable, lat_idx, lon_idx, round(y, 4) AS value FROM f
  UNION ALL SELECT 'gappy', lat_idx, lon_idx, round(CASE WHEN (lat_idx + lon_idx) % 5 > 0 THEN value END, 4) FROM grid""")
def clean_grid(spark, d):
    price = v.cells(spark, d).select("variable", *_CELLKEY, "value")
    gappy = price.select(F.lit("gappy").alias("variable"), *_CELLKEY, F.when((F.col("lat_idx") + F.col("lon_idx")) % 5 > 0, F.col("value")).alias("value"))
    bad = (F.col("variable") == "price") & ((F.col("lat_idx") * 7 + F.col("lon_idx") * 3) % 11 == 0)
    cells = price.unionByName(gappy)
    out = quality.clean(cells, quality.flagged(cells, "given", bad), _CELLKEY, lat="lat_idx", lon="lon_idx")
    return out.select("variable", *_CELLKEY, r("value", 4).alias("value"))


@query(f"""WITH {v.GRID}, h AS (SELECT lat_idx, lon_idx, CASE WHEN lat_idx % 10 <> 0 THEN value END AS value FROM grid WHERE lat_idx < 30)
  SELECT lat_idx, lon_idx, round(coalesce(value, avg(value) OVER ()), 4) AS value FROM h""")
def fill_mean(spark, d):
    holes = v.cells(spark, d).where("lat_idx < 30").withColumn("value", F.when(F.col("lat_idx") % 10 != 0, F.col("value")))
    return quality.fill_with_mean(holes, ["variable"]).select(*_CELLKEY, r("value", 4).alias("value"))


@query(f"""WITH {v.OBS}, d2 AS (SELECT *, lead(value, 2) OVER w - 2 * lead(value) OVER w + value AS d FROM obs WINDOW w AS (PARTITION BY station, variable ORDER BY ts, id)),
  s AS (SELECT variable, stddev_pop(d) AS sd, count(d) AS n FROM d2 GROUP BY 1)
  SELECT id FROM d2 JOIN s USING (variable) WHERE n >= 1 AND abs(d) > 3 * CASE WHEN sd > 0 THEN sd ELSE 1 END""")
def qc_spikes_first_point(spark, d):
    return quality.spike_check(v.observations(spark, d), ["station", "variable"], ["ts", "id"], limit=3.0, compat=True).where("failed").select("id")


# Series


@query(f"""WITH {v.DAILY} SELECT variable, t, round(pow(t / 1000.0, 3) - 2 * pow(t / 1000.0, 2) + t / 1000.0, 4) AS value FROM daily""")
def cubic_series(spark, d):
    """The spline through every third day of a cubic polynomial is that polynomial."""
    x = F.col("t") / 1000.0
    days = v.daily(spark, d).select("variable", "t", (F.pow(x, 3) - 2 * F.pow(x, 2) + x).alias("value"))
    known = days.where("t % 3 = 0")
    return series.cubic(known, days.select("variable", "t"), ["variable"]).select("variable", "t", r("value", 4).alias("value"))


# Assimilation


@query(f"""WITH {v.GRID}, {v.ENS}, m AS (SELECT lat_idx, lon_idx, avg(value) AS a FROM ens GROUP BY 1, 2) SELECT lat_idx, lon_idx, round(a - value, 4) + 0.0 AS increment FROM m JOIN grid USING (lat_idx, lon_idx)""")
def analysis_increment(spark, d):
    analysis = v.cells(spark, d, True).groupBy(*_CELLKEY).agg(F.avg("value").alias("value"))
    return assimilation.increments(analysis, v.cells(spark, d), _CELLKEY).select(*_CELLKEY, (r("increment", 4) + 0.0).alias("increment"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal IS NULL THEN 0 ELSE (SELECT CAST(min_by(i, (abs(i * i * 100.0 - s_acctbal), i)) AS INTEGER) FROM generate_series(0, 9) g(i)) END AS lev_idx FROM supplier""")
def obs_nearest_level(spark, d):
    levels = spark.range(10).select(F.col("id").cast("int").alias("idx"), (F.col("id") * F.col("id") * 100.0).alias("pos"))
    return assimilation.nearest_levels(v.table(spark, d, "supplier"), levels, "s_acctbal").select("s_suppkey", "lev_idx")


@query(f"""WITH {v.ENS}, m AS (SELECT lat_idx, lon_idx, avg(value) AS mu FROM ens GROUP BY 1, 2) SELECT lat_idx, lon_idx, member, round(mu + 1.5 * (value - mu), 4) AS value FROM ens JOIN m USING (lat_idx, lon_idx)""")
def ensemble_inflated(spark, d):
    return assimilation.inflate(v.cells(spark, d, True), _CELLKEY, 1.5).select(*_CELLKEY, "member", r("value", 4).alias("value"))


@query("""WITH c AS (SELECT s_suppkey, s_suppkey / 40.0 AS c FROM supplier) SELECT s_suppkey, round(exp(-c * c), 6) AS gaussian, round(greatest(0, 1 - c), 6) AS linear,
  round(CASE WHEN c <= 1 THEN 1 - 5.0 / 3 * c * c + 0.625 * pow(c, 3) + pow(c, 4) / 2 - pow(c, 5) / 4 WHEN c < 2 THEN greatest(0, 4 - 5 * c + 5.0 / 3 * c * c + 0.625 * pow(c, 3) - pow(c, 4) / 2 + pow(c, 5) / 12 - 2.0 / 3 / c) ELSE 0 END, 6) AS gaspari_cohn FROM c""")
def tapers(spark, d):
    c = F.col("s_suppkey") / 40.0
    return v.table(spark, d, "supplier").select("s_suppkey", *(r(expr.taper(k, c)).alias(k) for k in ("gaussian", "linear", "gaspari_cohn")))


# Mesh

_HIT = "hit AS (SELECT DISTINCT CAST(floor((lat + 90) / 10) * 36 + floor(lon / 10) AS BIGINT) AS id FROM geo WHERE lon < 360)"


@query(f"""WITH {v.GEO}, {_HIT}, c AS (SELECT (1::BIGINT << 52) + id * 4 + k AS cell_id, -90.0 + 10 * (id // 36) + 5 * (k // 2) AS lat_min, 10.0 * (id % 36) + 5 * (k % 2) AS lon_min FROM hit, (VALUES (0), (1), (2), (3)) q(k))
  SELECT cell_id, round(lat_min, 4) AS lat_min, round(lon_min, 4) AS lon_min FROM c""")
def mesh_refined_cells(spark, d):
    base = mesh.base_mesh(spark, 10.0)
    hit = mesh.locate(v.places(spark, d), base, 10.0).select("cell_id")
    return mesh.refine(base, hit).where("level = 1").select("cell_id", r("lat_min", 4).alias("lat_min"), r("lon_min", 4).alias("lon_min"))


@query(f"""WITH {v.GEO}, {_HIT}, n AS (SELECT count(*) AS n FROM hit) SELECT level, CASE level WHEN 0 THEN 648 - n WHEN 3 THEN 4 * n ELSE 3 * n END AS cells, CASE level WHEN 0 THEN 648 - n WHEN 3 THEN 4 * n ELSE 3 * n END AS ids FROM n, (VALUES (0), (1), (2), (3)) l(level)""")
def mesh_refined_to_level(spark, d):
    fine = mesh.refine_to(mesh.base_mesh(spark, 10.0), v.places(spark, d), 3, 10.0)
    return fine.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("cell_id").alias("ids"))


@query("SELECT CAST(c AS BIGINT) AS cell_id, CAST(-75.0 + 30 * (c // 12) AS DOUBLE) AS lat, CAST(15.0 + 30 * (c % 12) AS DOUBLE) AS lon, CAST(900.0 AS DOUBLE) AS area, round(least(30 * 111.0, 30 * 111.0 * cos(radians(-75.0 + 30 * (c // 12)))), 4) AS km FROM generate_series(0, 71) g(c)")
def mesh_cell_centres(spark, d):
    cells = mesh.centres(mesh.base_mesh(spark, 30.0))
    km = expr.cell_size_km(*(F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")))
    return cells.select("cell_id", "lat", "lon", "area", r(km, 4).alias("km"))


@query("""WITH p AS (SELECT c_custkey, -89.95 + (c_custkey % 1799) / 10.0 AS lat, (c_custkey % 3599) / 10.0 + 0.05 AS lon FROM customer)
  SELECT c_custkey, CAST(floor(round((lat + 90) / 0.3, 6)) * 1200 + floor(round(lon / 0.3, 6)) AS BIGINT) AS cell_id FROM p""")
def mesh_fine_lookup(spark, d):
    p = v.table(spark, d, "customer").select("c_custkey", (-89.95 + (F.col("c_custkey") % 1799) / 10.0).alias("lat"), ((F.col("c_custkey") % 3599) / 10.0 + 0.05).alias("lon"))
    return mesh.locate(p, mesh.base_mesh(spark, 0.3), 0.3).select("c_custkey", "cell_id")


@query(f"""WITH {v.GRID}, c AS (SELECT CAST(floor((lat_idx * 3 - 75 + 90) / 30) * 12 + floor(lon_idx * 14 / 30.0) AS BIGINT) AS cell_id, lat_idx, lon_idx, value FROM grid),
  g AS (SELECT cell_id, lead(value) OVER (PARTITION BY cell_id, lon_idx ORDER BY lat_idx) - value AS dy, lead(value) OVER (PARTITION BY cell_id, lat_idx ORDER BY lon_idx) - value AS dx FROM c)
  SELECT cell_id, round(max(sqrt(dy * dy + dx * dx)), 4) AS gradient FROM g GROUP BY 1""")
def mesh_gradients(spark, d):
    cells = v.cells(spark, d).select(*_CELLKEY, (F.col("lat_idx") * 3.0 - 75).alias("lat"), (F.col("lon_idx") * 14.0).alias("lon"), "value")
    return mesh.cells_by_gradient(mesh.locate(cells, mesh.base_mesh(spark, 30.0), 30.0)).select("cell_id", r("gradient", 4).alias("gradient"))


@query(f"""WITH {v.GEO}, {_HIT} SELECT id AS parent FROM hit""")
def mesh_coarsenable(spark, d):
    base = mesh.base_mesh(spark, 10.0).withColumn("parent", F.lit(None).cast("long"))
    hit = mesh.locate(v.places(spark, d), base, 10.0).select("cell_id")
    return mesh.coarsen(mesh.refine(base, hit))


@query(f"""WITH {v.GRID}, c AS (SELECT CAST(floor((lat_idx * 3 - 75 + 90) / 10) * 36 + floor(lon_idx * 14 / 10.0) AS BIGINT) AS id, max(value) AS top FROM grid GROUP BY 1), n AS (SELECT count(*) AS n FROM c WHERE top > 40000)
  SELECT 0 AS level, 648 - n AS cells FROM n UNION ALL SELECT 1, 4 * n FROM n WHERE n > 0""")
def mesh_refiner(spark, d):
    cells = v.cells(spark, d).select((F.col("lat_idx") * 3.0 - 75).alias("lat"), (F.col("lon_idx") * 14.0).alias("lon"), F.col("value").alias("flux"))
    out = mesh.refined_by(mesh.base_mesh(spark, 10.0), cells, [("flux", ">", 40000.0)], 10.0)
    return mesh.mesh_statistics(out).select("level", "cells")


# Similarity and events


@query("""WITH e AS (SELECT vec_id AS event_id, label + 1.0 AS d, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT d AS qd, v AS qv FROM e WHERE event_id = 0),
  s AS (SELECT event_id, 1 - least(abs(d - qd) / greatest(d, qd, 1), 1) AS l, greatest(0, least(1, list_cosine_similarity(v, qv))) AS a, v, qv, abs(v[1] - qv[1]) AS m1, abs(v[2] - qv[2]) AS m2,
    1 - abs(v[1] - qv[1]) / greatest(abs(v[1]), abs(qv[1]), 1e-10) AS s1, 1 - abs(v[2] - qv[2]) / greatest(abs(v[2]), abs(qv[2]), 1e-10) AS s2 FROM e, q)
  SELECT event_id, round(0.6 * (0.5 * l + 0.5 * a) + 0.4 * (s1 + s2) / 2, 6) AS score, round((s1 + s2) / 2, 6) AS spatial, round(m1, 6) AS first_difference FROM s""")
def similarity_combined(spark, d):
    means = F.create_map(F.lit("a"), F.col("vector")[0].cast("double"), F.lit("b"), F.col("vector")[1].cast("double"))
    e = v.vectors(spark, d).select("event_id", (F.col("label") + 1.0).alias("d"), "vector", means.alias("m"))
    q = e.where("event_id = 0").select(F.col("d").alias("qd"), F.col("vector").alias("qv"), F.col("m").alias("qm"))
    found = fingerprint.combined_similarity(F.col("d"), F.col("qd"), F.col("vector"), F.col("qv"), F.col("m"), F.col("qm"))
    out = e.crossJoin(F.broadcast(q))  # one query
    return out.select("event_id", r(found["score"]).alias("score"), r(found["spatial"]).alias("spatial"), r(found["matched_variables"]["a"]).alias("first_difference"))


@query(f"""WITH {v.OBS} SELECT station % 10 AS event, variable, round(avg(value), 6) AS mean, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY station % 10) AS n FROM obs) GROUP BY 1, 2""")
def event_database(spark, d):
    db = fingerprint.event_database(v.observations(spark, d).withColumn("event", F.col("station") % 10), ["event"])
    return db.select("event", "n", F.explode("means").alias("variable", "mean")).select("event", "variable", r("mean").alias("mean"), "n")


# Tenants, versions, provenance


@query("""WITH g AS (SELECT o_custkey % 40 AS resource, o_custkey % 7 AS grantee, o_orderkey AS granted_at, CASE WHEN o_orderkey % 3 > 0 THEN 'u' || o_custkey % 9 END AS owner FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY resource, grantee ORDER BY granted_at DESC) AS n FROM g WHERE owner IS NULL OR owner IN ('u0', 'u3', 'u4', 'u8'))
  SELECT 'r' || resource AS resource_id, 't' || grantee AS grantee, granted_at, owner FROM k WHERE n = 1""")
def acl_granted_by_owners(spark, d):
    o = v.table(spark, d, "orders")
    owner = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("u"), F.col("o_custkey") % 9))
    grants = o.select(F.concat(F.lit("r"), F.col("o_custkey") % 40).alias("resource_id"), F.lit("tenant").alias("grantee_kind"), F.concat(F.lit("t"), F.col("o_custkey") % 7).alias("grantee"), F.array(F.lit("read")).alias("permissions"), F.col("o_orderkey").alias("granted_at"), owner.alias("owner"))
    roles = ["admin", "viewer", "viewer", "Operational", "ADMIN", "user", "user", "viewer", "operational"]
    users = spark.createDataFrame([(f"u{i}", x) for i, x in enumerate(roles)], "user_id string, role string")
    return tenancy.granted_by_owners(grants, users).select("resource_id", "grantee", "granted_at", "owner")


@query("SELECT 't' || s_nationkey AS tenant_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS DOUBLE) ELSE 10.0 + s_nationkey END AS storage_quota_tb, CASE WHEN s_suppkey % 5 = 0 THEN false ELSE true END AS is_isolated, 'sandboxes/t' || s_nationkey || '/' || s_name AS path FROM supplier")
def sandbox_records(spark, d):
    s = v.table(spark, d, "supplier")
    tenant = F.concat(F.lit("t"), F.col("s_nationkey"))
    requests = s.select(tenant.alias("tenant_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("double")).alias("storage_quota_tb"), F.when(F.col("s_suppkey") % 5 == 0, False).alias("is_isolated"))
    tenants = v.table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey")).alias("tenant_id"), (F.col("n_nationkey") + 10.0).alias("quota_storage_tb"))
    return tenancy.sandboxes(requests, tenants)


@query("SELECT c_name AS username, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'admin' END, 'viewer') AS role, 0 AS n_permissions, 'w' || c_nationkey AS workspace, '' AS description, 't' || c_nationkey AS first_member FROM customer")
def user_and_workspace_records(spark, d):
    c = v.table(spark, d, "customer")
    users = tenancy.users(c.select("c_nationkey", F.col("c_name").alias("username"), F.when(F.col("c_custkey") % 4 == 0, "admin").alias("role"), F.lit(None).cast("array<string>").alias("permissions")))
    asked = c.select("c_nationkey").distinct().select("c_nationkey", F.concat(F.lit("t"), F.col("c_nationkey")).alias("owner_tenant_id"), F.concat(F.lit("w"), F.col("c_nationkey")).alias("workspace"), F.lit(None).cast("string").alias("description"))
    spaces = tenancy.workspaces(asked)
    return users.join(spaces, "c_nationkey").select("username", "role", F.size("permissions").alias("n_permissions"), "workspace", "description", F.get("members", F.lit(0)).alias("first_member"))


@query("SELECT 't' || n_nationkey AS tenant_id, CAST(n_nationkey * 1.5 AS DOUBLE) AS quota_storage_tb, CAST(n_regionkey AS DOUBLE) AS quota_jobs FROM nation")
def usage_as_quota(spark, d):
    n = v.table(spark, d, "nation")
    return tenancy.usage_to_quota(n.select(F.concat(F.lit("t"), F.col("n_nationkey")).alias("tenant_id"), (F.col("n_nationkey") * 1.5).alias("used_storage_tb"), F.col("n_regionkey").cast("double").alias("used_jobs")))


@query("""SELECT 't' || n_nationkey AS tenant_id, CASE WHEN n_nationkey > 12 THEN 'jobs: ' || printf('%.2f', CAST(n_nationkey AS DOUBLE)) || ' > 12.00' ELSE '' END || CASE WHEN n_regionkey * 4 > 10 THEN CASE WHEN n_nationkey > 12 THEN '; ' ELSE '' END || 'gpu: ' || printf('%.2f', n_regionkey * 4.0) || ' > 10.00' ELSE '' END AS reasons,
  CASE WHEN n_nationkey % 6 = 5 THEN false ELSE n_nationkey + 3 <= 12 END AS granted FROM nation""")
def quota_reasons(spark, d):
    n = v.table(spark, d, "nation")
    state = n.select(F.concat(F.lit("t"), F.col("n_nationkey")).alias("tenant_id"), (F.col("n_nationkey") % 6 != 5).alias("active"), F.col("n_nationkey").cast("double").alias("used_jobs"), F.lit(12.0).alias("quota_jobs"), (F.col("n_regionkey") * 4.0).alias("used_gpu"), F.lit(10.0).alias("quota_gpu"))
    over = tenancy.exceeded(("jobs", "gpu"))
    asked = tenancy.available(state.select("tenant_id", F.lit(3.0).alias("request_jobs")), state).select("tenant_id", "granted")
    return state.select("tenant_id", F.array_join(over, "; ").alias("reasons")).join(asked, "tenant_id")


@query("""WITH s AS (SELECT 's' || o_orderkey AS step, ['d' || o_custkey % 50, 'd' || o_orderkey % 60] AS inputs, 'o' || o_orderkey AS output FROM orders)
  SELECT i AS source, step AS target, 'input_to' AS relation FROM (SELECT step, unnest(inputs) AS i FROM s) WHERE CAST(substr(i, 2) AS INT) < 40 UNION ALL SELECT step, output, 'produced' FROM s""")
def provenance_steps(spark, d):
    o = v.table(spark, d, "orders")
    text = lambda p, c: F.concat(F.lit(p), c)
    steps = o.select(text("s", F.col("o_orderkey")).alias("step"), F.array(text("d", F.col("o_custkey") % 50), text("d", F.col("o_orderkey") % 60)).alias("inputs"), text("o", F.col("o_orderkey")).alias("output"))
    return tenancy.track_steps(steps, spark.range(40).select(text("d", F.col("id")).alias("node")))


@query("SELECT 'node' AS kind, 'n' || n_nationkey AS node, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * n_nationkey AS created_at, NULL AS source FROM nation UNION ALL SELECT 'edge', NULL, NULL, 'n' || n_regionkey FROM nation")
def provenance_round_trip(spark, d):
    n = v.table(spark, d, "nation")
    nodes = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), expr.iso(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, n_nationkey)")).alias("created_at"))
    edges = n.select(F.concat(F.lit("n"), F.col("n_regionkey")).alias("source"))
    back = sinks.provenance_load(sinks.provenance_json(nodes, edges), "kind string, node string, created_at string, source string")
    return back.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT o_custkey % 50 AS dataset, o_orderkey AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN 'minor' ELSE 'patch' END AS kind FROM orders),
  n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY created_at) AS rn FROM c), b AS (SELECT *, sum(CASE WHEN kind = 'minor' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset ORDER BY created_at) AS minor FROM n),
  p AS (SELECT *, sum(CASE WHEN kind = 'patch' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, minor ORDER BY created_at) AS patch FROM b),
  z AS (SELECT o_custkey % 50 AS dataset, count(*) * 8 AS size_bytes, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS variables FROM orders GROUP BY 1)
  SELECT dataset, min(created_at) AS created_at, any_value(size_bytes) AS size_bytes, any_value(variables) AS variables FROM p JOIN z USING (dataset) WHERE minor = 1 AND patch = 1 GROUP BY 1""")
def version_lookup(spark, d):
    o = v.table(spark, d, "orders").withColumn("dataset", F.col("o_custkey") % 50)
    changes = o.select("dataset", F.col("o_orderkey").alias("created_at"), F.when(F.col("o_orderkey") % 7 == 0, "minor").otherwise("patch").alias("change_type"))
    data = o.select("dataset", F.col("o_orderstatus").alias("variable"), F.col("o_totalprice").alias("value"))
    found = tenancy.version_at(tenancy.version_records(data, changes), "1.1.1")
    return found.select("dataset", "created_at", "size_bytes", F.array_join("variables", ",").alias("variables"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE n_nationkey END AS major, CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE n_regionkey END AS minor, CASE WHEN n_nationkey % 4 = 0 THEN 7 ELSE 0 END AS patch FROM nation")
def version_parts(spark, d):
    n = v.table(spark, d, "nation")
    two = F.concat_ws(".", "n_nationkey", "n_regionkey")
    text = F.when(F.col("n_nationkey") % 4 == 0, F.concat(two, F.lit(".7"))).when(F.col("n_nationkey") % 4 == 3, F.concat(two, F.lit("-beta"))).otherwise(two)
    return n.select("n_nationkey", expr.semver(text).alias("s")).select("n_nationkey", "s.major", "s.minor", "s.patch")


# Times, maps, arrays


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ordered, true AS same, round((epoch(l_shipdate) - epoch(o_orderdate)) / 3600, 4) AS lead_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lead_times(spark, d):
    lines = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = v.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    text = expr.iso(F.col("o_orderdate"))
    same = expr.from_iso(text) == F.date_trunc("second", F.col("o_orderdate").cast("timestamp"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("ordered"), same.alias("same"), r(expr.lead_seconds(F.col("o_orderdate"), F.col("l_shipdate")) / 3600, 4).alias("lead_hours"))


@query("SELECT s_nationkey AS cluster, s_suppkey % 3 AS variable, max_by(s_acctbal, s_suppkey) AS value FROM supplier GROUP BY 1, 2")
def map_merge(spark, d):
    s = v.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("cluster")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", (F.col("s_suppkey") % 3).alias("key"), F.col("s_acctbal").alias("value")))).alias("e"))
    return s.select("cluster", F.explode(expr.merged(F.col("e"))).alias("variable", "value"))


@query("SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_min(e), 6) AS min, round(list_max(e), 6) AS max, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def array_reductions(spark, d):
    found = expr.array_reductions(F.col("embedding"))
    return v.table(spark, d, "embeddings").select("vec_id", *(r(c).alias(k) for k, c in found.items()))


@query(f"WITH {v.ENS} SELECT lat_idx, lon_idx, round(value, 4) AS value FROM ens WHERE member = (SELECT max(member) FROM ens)")
def last_slice(spark, d):
    return sinks.last_slice(v.cells(spark, d, True).withColumn("lev_idx", F.lit(0)), "member").select(*_CELLKEY, r("value", 4).alias("value"))


# Payloads


@query(f"WITH {v.ENS} SELECT member, count(*) AS points, round(avg(sqrt(value * value + 1e6)), 4) AS mean_speed, round(max(sqrt(value * value + 1e6)), 4) AS max_speed, round(degrees(atan2(1000.0, avg(value))), 6) AS direction FROM ens GROUP BY 1")
def wind_payload(spark, d):
    wind = v.cells(spark, d, True).select("member", F.col("value").alias("u_wind"), F.lit(1000.0).alias("v_wind"))
    return sinks.wind_payload(wind, ["member"]).select("member", "points", r("mean_speed", 4).alias("mean_speed"), r("max_speed", 4).alias("max_speed"), r("direction").alias("direction"))


@query(f"WITH {v.OBS}, s AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1) SELECT variable, CAST(l AS INTEGER) AS level, round(lo + (hi - lo) * l / 9, 6) AS at FROM s, generate_series(0, 9) g(l)")
def contour_levels(spark, d):
    return sinks.contours(v.observations(spark, d), ["variable"]).select("variable", "level", r("at").alias("at"))


@query(f"WITH {v.DAILY} SELECT variable, t // 30 AS month, round(min(value), 2) AS min, round(max(value), 2) AS max, round(avg(value), 4) AS mean FROM daily GROUP BY 1, 2")
def monthly_frames(spark, d):
    months = v.daily(spark, d).withColumn("month", F.expr("cast(floor(t / 30) as int)"))
    return sinks.frames(months, "month", ["variable"]).select("variable", "month", r("min", 2).alias("min"), r("max", 2).alias("max"), r("mean", 4).alias("mean"))


@query(f"WITH {v.OBS} SELECT string_agg(DISTINCT variable, ',' ORDER BY variable) AS variables FROM obs")
def frame_variables(spark, d):
    return sinks.frame_variables(v.observations(spark, d)).select(F.array_join("variables", ",").alias("variables"))


@query(f"WITH {v.OBS}, k AS (SELECT DISTINCT variable FROM obs ORDER BY 1 LIMIT 3) SELECT variable, round(min(value), 4) AS min, round(max(value), 4) AS max FROM obs SEMI JOIN k USING (variable) GROUP BY 1")
def rendered_variables(spark, d):
    out = sinks.render_all(v.observations(spark, d))
    number = lambda k: r(F.get_json_object("payload", f"$.{k}").cast("double"), 4).alias(k)
    return out.select("variable", number("min"), number("max"))


# Executions


def _executions(spark, d) -> DataFrame:
    o = v.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("execution_id"), status.alias("status"), F.col("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("make_dt_interval(cast(o_custkey % 3 - 1 as int))")).alias("end"), (F.col("o_custkey") % 5).alias("checksum"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5).alias("expected"))


_EXECUTIONS = "x AS (SELECT o_orderkey AS execution_id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, o_orderdate AS s, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY * (o_custkey % 3 - 1) END AS e, o_custkey % 5 AS checksum, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS expected FROM orders)"


@query(f"WITH {_EXECUTIONS} SELECT execution_id, coalesce(status = 'completed' AND (expected IS NULL OR checksum = expected) AND e >= s, false) AS valid FROM x")
def result_validation(spark, d):
    return orchestration.validated(_executions(spark, d)).select("execution_id", "valid")


@query(f"WITH {_EXECUTIONS} SELECT execution_id, CASE WHEN status = 'running' AND execution_id % 3 = 0 THEN 'cancelled' ELSE status END AS status FROM x WHERE e IS NULL OR e >= TIMESTAMP '1996-01-01 00:00:00'")
def executions_cleaned(spark, d):
    x = _executions(spark, d)
    out = orchestration.cancelled(x, x.where("execution_id % 3 = 0"))
    return orchestration.cleaned(out, F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).select("execution_id", "status")


@query(f"WITH {_EXECUTIONS} SELECT execution_id % 100 AS flow, round(avg(CASE WHEN status = 'completed' THEN 100.0 ELSE 0 END), 4) AS percent, bool_and(status = 'completed') AS valid FROM x GROUP BY 1")
def completion_percent(spark, d):
    from .facade import completion

    return completion(_executions(spark, d).withColumn("flow", F.col("execution_id") % 100), "flow").select("flow", r("percent", 4).alias("percent"), "valid")


@query("SELECT i // 6 AS a, i % 6 AS b FROM generate_series(0, 35) g(i)")
def grid_sweep(spark, d):
    points = orchestration.grid([orchestration.Range("a", 0, 5), orchestration.Range("b", 0, 5)], 36)
    return spark.createDataFrame([(round(p["a"]), round(p["b"])) for p in points], "a long, b long")


@query("SELECT 'a' AS name, i AS stratum, 1::BIGINT AS n FROM generate_series(0, 63) g(i) UNION ALL SELECT 'b', i, 1 FROM generate_series(0, 63) g(i)")
def lhs_strata(spark, d):
    """Of a Latin hypercube every stratum of every parameter holds one point."""
    import math

    points = orchestration.latin_hypercube([orchestration.Range("a"), orchestration.Range("b", 1.0, 100.0, "loguniform")], 64, 1)
    rows = [(k, int(64 * (p[k] if k == "a" else math.log(p[k]) / math.log(100)))) for p in points for k in ("a", "b")]
    return spark.createDataFrame(rows, "name string, stratum long").groupBy("name", "stratum").count().withColumnRenamed("count", "n")


@query("SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS DOUBLE) AS place, ['low', 'mid', 'high'][1 + least(greatest(p_size - 20, 0), 2)] AS chosen, CAST(least(greatest(p_size, 10), 40) AS DOUBLE) AS clipped FROM part")
def optimiser_codes(spark, d):
    kinds = orchestration.Range("kind", kind="values", values=("low", "mid", "high"))
    size = orchestration.Range("size", 10, 40, "discrete")
    p = v.table(spark, d, "part").select("p_partkey", "p_size", F.get(F.array(*map(F.lit, ("low", "mid", "high", "none"))), F.col("p_size") % 4).alias("kind"))
    out = orchestration.encoded(p, [kinds]).withColumnRenamed("kind", "place")
    back = orchestration.decoded(out.withColumns({"kind": F.col("p_size") - 20.0, "size": F.col("p_size") + 0.2}), [kinds, size])
    return back.select("p_partkey", "place", F.col("kind").alias("chosen"), F.col("size").alias("clipped"))


@query("SELECT 'parameter_sweep-' || lpad(CAST(i AS VARCHAR), 5, '0') AS task, CASE WHEN i = 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN i <> 3 THEN CAST(-(i - 5) * (i - 5) AS DOUBLE) END AS value, i = 5 AS best FROM generate_series(0, 8) g(i)")
def sweep_workflow(spark, d):
    return orchestration.sweep_tasks(spark, [{"x": i} for i in range(9)], lambda p: -((p["x"] - 5) ** 2) / (p["x"] != 3)).drop("parameters")


# Coupled model


@query("""SELECT * FROM (VALUES ('atmosphere', 'ocean', 5, 1, 4, 0), ('ocean', 'atmosphere', 1, 1, 0, 0), ('atmosphere', 'land', 3, 1, 2, 0), ('land', 'atmosphere', 3, 1, 1, 1), ('ocean', 'sea_ice', 3, 1, 0, 2), ('sea_ice', 'ocean', 1, 0, 1, 0), ('atmosphere', 'sea_ice', 3, 1, 2, 0), ('sea_ice', 'atmosphere', 1, 0, 1, 0)) t(source, target, maps, relaxations, fluxes, directs)""")
def coupling_interfaces(spark, d):
    kind = lambda m: F.count_if(F.col("method") == m).cast("int")
    return coupled.coupling_table(spark).groupBy("source", "target").agg(F.count(F.lit(1)).cast("int").alias("maps"), kind("relaxation").alias("relaxations"), kind("flux").alias("fluxes"), kind("direct").alias("directs"))


@query(f"""WITH {v.GRID}, t AS (SELECT lat_idx, lon_idx, value FROM grid), g AS (SELECT lat_idx, lon_idx, value / 2 AS given FROM grid WHERE lon_idx < 20)
  SELECT lat_idx, lon_idx, round(coalesce(value + 0.25 * (given - value), value), 4) AS relaxed, round(coalesce(value + given * 0.001 * 21600, value), 3) AS fed, round(coalesce(given * 0.5, value), 4) AS replaced FROM t LEFT JOIN g USING (lat_idx, lon_idx)""")
def coupling_methods(spark, d):
    state = v.cells(spark, d).select(*_CELLKEY, F.col("lat_idx").cast("double").alias("lat"), F.col("lon_idx").cast("double").alias("lon"), F.lit(0).alias("lev_idx"), *(F.col("value").alias(c) for c in ("relaxed", "fed", "replaced")))
    source = state.where("lon_idx < 20").select("lat", "lon", "lev_idx", (F.col("relaxed") / 2).alias("given"))
    for c in (coupled.Coupling("s", "t", "given", "relaxed", "relaxation", tau=86400.0), coupled.Coupling("s", "t", "given", "fed", "flux", scale=0.001), coupled.Coupling("s", "t", "given", "replaced", "direct", scale=0.5), coupled.Coupling("s", "t", "absent", "fed")):
        state = coupled.couple(state, source, c, 21600.0)
    return state.select(*_CELLKEY, r("relaxed", 4).alias("relaxed"), r("fed", 3).alias("fed"), r("replaced", 4).alias("replaced"))


@query()
def ensemble_stochastic(spark, d):
    return coupled.generated(v.cells(spark, d), 4, _CELLKEY, "stochastic").groupBy("member").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


# Ingestion


@query("""WITH c AS (SELECT event_type AS source, floor(epoch(ts) / 5) * 5 AS tick, sum(event_id % 1000 + 1) AS b, min(epoch(ts)) AS t FROM events GROUP BY 1, 2)
  SELECT source, CAST(tick AS BIGINT) AS tick, CAST(sum(b) OVER w AS BIGINT) AS bytes, round(sum(b) OVER w * 8 / (tick + 5 - min(t) OVER (PARTITION BY source)), 4) AS bps FROM c WINDOW w AS (PARTITION BY source ORDER BY tick)""")
def ingest_rate_since_start(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_type").alias("source"), "ts", (F.col("event_id") % 1000 + 1).alias("bytes"))
    return ingest.rate_stats(e, ["source"]).select("source", F.col("tick").cast("long").alias("tick"), "bytes", r("bps", 4).alias("bps"))


@query("SELECT event_id FROM events WHERE (SELECT min(ts) FROM events) >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3650 DAY")
def station_batch(spark, d):
    e = v.table(spark, d, "events").select("event_id", "ts")
    return ingest.batch_retained(e, 3650, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), ["ts", "event_id"]).select("event_id")


# Records, listings and small tables


def _records(spark, d) -> DataFrame:
    e = v.table(spark, d, "events")
    names = F.array(F.concat(F.lit("v"), F.col("event_id") % 3), F.concat(F.lit("v"), F.col("event_id") % 7))
    return e.select("event_id", F.col("event_type").alias("data_source"), names.alias("variables"), (F.col("value") < 250).alias("passed"), "ts")


@query("SELECT event_id FROM events WHERE (event_id % 3 = 2 OR event_id % 7 = 2) AND value < 250 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 00:00:00'")
def validation_history(spark, d):
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")
    return facade.history(_records(spark, d), variable="v2", passed=True, since=at("05"), until=at("25"), limit=1 << 30).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 20")
def latest_executions(spark, d):
    return facade.latest(v.table(spark, d, "orders"), 20, "o_orderkey", o_orderstatus="F").select("o_orderkey")


@query(f"WITH {v.OBS} SELECT coalesce(variable, 'all') AS variable, count(*) AS points, count_if(value > 400) AS n_failed, count_if(value > 400) <= 0.05 * count(*) AS passed FROM obs GROUP BY ROLLUP (variable)")
def dataset_validation(spark, d):
    out = facade.validate(v.observations(spark, d), ["id"], [lambda df: quality.range_check(df, 0.0, 400.0)])
    return out.select(F.coalesce("variable", F.lit("all")).alias("variable"), "points", "n_failed", "passed")


@query("SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def platform_status(spark, d):
    found = facade.status({n: v.table(spark, d, n) for n in ("events", "orders", "nation")})
    return spark.createDataFrame(list(found.items()), "name string, n long")


@query("SELECT event_id AS id, value AS temperature_2m, value / 2 AS wind_speed FROM events")
def station_columns(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("temperature_2m"), (F.col("value") / 2).alias("wind_speed"), F.lit(1).alias("of_no_use"))
    return readers.station_observations(e, ["id"])


@query(f"WITH {v.OBS} SELECT variable, count(value) * 8 AS bytes FROM obs GROUP BY 1")
def estimated_sizes(spark, d):
    return readers.estimated_bytes(v.observations(spark, d), ["variable"])


@query("SELECT n_nationkey, base64(encode(n_name)) AS n_name FROM nation")
def encoded_payloads(spark, d):
    return sinks.encoded(v.table(spark, d, "nation").select("n_nationkey", F.col("n_name").cast("binary").alias("n_name")), "n_name")


@query("SELECT s_suppkey, round(sqrt(s_acctbal * s_acctbal + s_suppkey * s_suppkey), 4) AS speed, round(1e5 * 2 * 7.2921e-5 * sin(radians(s_nationkey * 3.0)), 6) AS coriolis, round(degrees(atan2(CAST(s_suppkey AS DOUBLE), s_acctbal)), 4) AS angle FROM supplier")
def wind_and_coriolis(spark, d):
    s = v.table(spark, d, "supplier")
    u, w = F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    return s.select("s_suppkey", r(expr.wind_speed(u, w), 4).alias("speed"), r(1e5 * expr.coriolis(F.col("s_nationkey") * 3.0)).alias("coriolis"), r(coupled.angle(u, w), 4).alias("angle"))


@query("SELECT 'r' || s_suppkey AS resource_id, 't' || c AS grantee FROM (SELECT s_suppkey, s_nationkey FROM supplier) JOIN (SELECT DISTINCT c_nationkey AS n, c_custkey % 5 AS c FROM customer) ON n = s_nationkey")
def workspace_shares(spark, d):
    resources = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("workspace_id"), F.concat(F.lit("r"), F.col("s_suppkey")).alias("resource_id"), F.array(F.lit("read")).alias("permissions"))
    members = v.table(spark, d, "customer").select(F.col("c_nationkey").alias("workspace_id"), F.concat(F.lit("t"), F.col("c_custkey") % 5).alias("tenant_id")).distinct()
    return tenancy.share_with_members(resources, members).select("resource_id", "grantee")


@query("SELECT c_custkey, c_custkey % 25 = c_nationkey OR c_custkey % 7 IN (c_nationkey, c_nationkey + 1) AS member FROM customer")
def workspace_membership(spark, d):
    c = v.table(spark, d, "customer")
    own = c.select("c_custkey", (F.col("c_custkey") % 25).alias("who"), F.col("c_nationkey").cast("long").alias("owner"), F.array(F.col("c_nationkey").cast("long"), (F.col("c_nationkey") + 1).cast("long")).alias("members"), (F.col("c_custkey") % 7).alias("other"))
    return own.select("c_custkey", (tenancy.is_member(F.col("owner"), F.col("members").cast("array<long>"), F.col("other")) | (F.col("owner") == F.col("who"))).alias("member"))


@query("SELECT i AS step, CAST(16 + 8 * (i + 1) AS BIGINT) AS workers FROM generate_series(0, 49) g(i)")
def scaled_workers(spark, d):
    found = tenancy.scaled_workers([(300.0 * i, 0.9) for i in range(50)])
    return spark.createDataFrame(list(enumerate(found)), "step long, workers long")


@query("""WITH e AS (SELECT o_custkey % 10 AS tenant_id, ['compute_hours', 'jobs', 'storage_tb'][1 + o_orderkey % 3] AS resource, round(o_totalprice, 2) AS amount FROM orders)
  SELECT tenant_id, resource, CASE WHEN resource = 'storage_tb' THEN round(sum(amount), 2) ELSE 0.0 END AS amount, count(*) + CASE WHEN resource = 'storage_tb' THEN 0 ELSE 1 END AS n FROM e GROUP BY 1, 2""")
def monthly_reset(spark, d):
    kinds = F.get(F.array(*map(F.lit, ("compute_hours", "jobs", "storage_tb"))), (F.col("o_orderkey") % 3).cast("int"))
    e = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 10).alias("tenant_id"), kinds.alias("resource"), v.rounded(F.col("o_totalprice"), 2).alias("amount"))
    out = tenancy.monthly_reset(e, 1 << 40).groupBy("tenant_id", "resource").agg(F.sum("amount").alias("a"), F.count(F.lit(1)).alias("n"))
    return out.select("tenant_id", "resource", (F.when(F.abs("a") < 1e-3, 0.0).otherwise(r("a", 2)) + 0.0).alias("amount"), "n")


@query("SELECT 'r' || s_suppkey AS resource_id FROM supplier WHERE s_suppkey % 4 > 0 AND s_nationkey <> 7")
def acl_revoked(spark, d):
    s = v.table(spark, d, "supplier")
    acl = s.select(F.concat(F.lit("r"), F.col("s_suppkey")).alias("resource_id"), F.lit("tenant").alias("grantee_kind"), F.lit("t1").alias("grantee"), F.col("s_nationkey").alias("tenant_id"), "s_suppkey")
    left = tenancy.revoke(acl, acl.where("s_suppkey % 4 = 0").select("resource_id", "grantee_kind", "grantee"))
    return tenancy.without_tenant(left.withColumn("tenant_id", F.col("tenant_id").cast("string")), "7").select("resource_id")


@query("SELECT o_orderkey % 60 AS source, o_custkey % 60 AS target, count(*) AS n FROM orders WHERE o_orderkey % 60 < 25 AND o_custkey % 60 < 25 GROUP BY 1, 2")
def lineage_connected(spark, d):
    edges = v.table(spark, d, "orders").select((F.col("o_orderkey") % 60).alias("source"), (F.col("o_custkey") % 60).alias("target"))
    nodes = v.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return tenancy.connect(edges, nodes).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'storage_tb' AS resource, 10.0::DOUBLE AS quota UNION ALL SELECT 'compute_hours', 1000.0 UNION ALL SELECT 'jobs', 10.0 UNION ALL SELECT 'memory_gb', 128.0 UNION ALL SELECT 'gpu', 0.0 UNION ALL SELECT 'bandwidth_gbps', 1.0")
def research_quota(spark, d):
    return spark.createDataFrame(list(tenancy.RESEARCH_QUOTA.items()), "resource string, quota double")


@query("SELECT n_name AS task, row_number() OVER (ORDER BY n_nationkey) AS place, CAST(n_nationkey AS BIGINT) * n_nationkey AS value, sha256(CAST(n_nationkey * n_nationkey AS VARCHAR)) AS checksum, 'completed' AS status FROM nation")
def workflow_results(spark, d):
    rows = v.table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 tasks
    tasks = [orchestration.Task(x.n_name, lambda *_, k=x.n_nationkey: k * k, priority=-x.n_nationkey) for x in rows]
    done = orchestration.Workflow(tasks).execute()
    return spark.createDataFrame([(n, i + 1, o["value"], o["checksum"], o["status"]) for i, (n, o) in enumerate(done.items())], "task string, place long, value long, checksum string, status string")


@query("SELECT i, CAST(round(i * 2.3, 0) AS DOUBLE) AS d, round(exp(ln(2.0) + i / 10.0 * ln(50.0)), 6) AS l, ['a', 'b', 'c'][1 + least(CAST(floor(i / 10.0 * 3) AS BIGINT), 2)] AS k FROM generate_series(0, 10) g(i) WHERE i <> 5")
def parameter_samples(spark, d):
    import numpy as np

    u = np.arange(11) / 10
    ranges = [orchestration.Range("d", 0, 23, "discrete"), orchestration.Range("l", 2.0, 100.0, "loguniform"), orchestration.Range("k", kind="values", values=("a", "b", "c"))]
    found = [x.at(u) for x in ranges]
    out = spark.createDataFrame([(i, float(found[0][i]), float(found[1][i]), str(found[2][i])) for i in range(11) if i != 5], "i long, d double, l double, k string")
    return out.withColumn("l", r("l"))


@query("SELECT i AS member, 1.0::DOUBLE AS norm FROM generate_series(0, 3) g(i)")
def bred_vectors(spark, d):
    """Vectors of one norm, whatever the noise."""
    control = v.cells(spark, d)
    members = coupled.generated(control, 4, _CELLKEY, "bred", amplitude=2.0)
    both = members.join(control.select(*_CELLKEY, F.col("value").alias("c")), _CELLKEY)
    out = both.groupBy("member").agg(F.sqrt(F.avg(F.pow((F.col("value") - F.col("c")) / 2.0, 2))).alias("norm"))
    return out.select(F.col("member").cast("long").alias("member"), r("norm", 4).alias("norm"))
