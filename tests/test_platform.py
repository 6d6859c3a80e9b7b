"""Likeness of events, ensembles' noise, tenants and versions against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import expr
from gridspark.operators import coupled, fingerprint, mesh, orchestration, similar, tenancy

EVENT = "event_id long, duration double, vector array<double>, means map<string,double>"


def likeness(q, e):
    d = 1 - min(abs((q[1] or 0) - (e[1] or 0)) / max(q[1] or 0, e[1] or 0, 1.0), 1.0)
    a, b = np.array(q[2] or []), np.array(e[2] or [])
    temporal = 0.0
    if len(a) and len(a) == len(b):
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        temporal = 0.5 * d + 0.5 * max(0.0, min(1.0, float(a @ b) / norm if norm else 0.0))
    known = lambda m: {k: x for k, x in (m or {}).items() if x is not None and not math.isnan(x)}
    m, n = known(q[3]), known(e[3])
    both = sorted(set(m) & set(n))
    spatial = sum(1 - abs(m[k] - n[k]) / max(abs(m[k]), abs(n[k]), 1e-10) for k in both) / len(both) if both else 0.0
    return round(0.6 * temporal + 0.4 * spatial, 9), temporal, spatial


def some_events():
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 9)), rng.normal(size=4).tolist(), {k: float(rng.normal()) for k in "abc" if rng.random() < 0.6}) for i in range(60)]
    rows += [(60, None, [1.0, 2.0, 3.0, 4.0], {"a": float("nan"), "b": None}), (61, 2.0, None, None), (62, 2.0, [], {}), (63, 2.0, [1.0], {"a": 1.0}), (64, 1.0, [0.0] * 4, {"z": 0.0})]
    return rows + [(65 + i, *rows[3][1:]) for i in range(6)]  # ties


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_combined_search_equals_brute_force(spark, block_bytes):
    rows = some_events()
    events = spark.createDataFrame([*rows, (None, 1.0, [1.0] * 4, {"a": 1.0})], EVENT).repartition(5)
    asked = [r for r in rows if r[0] % 3 == 0 or r[0] >= 60]
    queries = spark.createDataFrame(asked, EVENT).withColumnRenamed("event_id", "query_id")
    got = {}
    for r in similar.find(events, queries, 5, block_bytes=block_bytes).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.event_id, r.score, r.temporal, r.spatial)
    for q in asked:
        best = sorted(((-s, e[0], s, t, p) for e in rows if e[0] != q[0] for s, t, p in [likeness(q, e)]))[:5]
        assert [got[q[0]][k + 1][0] for k in range(5)] == [b[1] for b in best]
        for k, b in enumerate(best):
            assert got[q[0]][k + 1][1:] == pytest.approx(b[2:], abs=1e-8)


def test_combined_search_of_nothing(spark):
    events = spark.createDataFrame(some_events(), EVENT)
    queries = events.withColumnRenamed("event_id", "query_id")
    assert similar.find(events, queries.limit(0)).columns == ["query_id", "event_id", "score", "temporal", "spatial", "rank"]
    assert similar.find(events, queries.limit(0)).count() == similar.find(events.limit(0), queries).count() == 0


def test_a_pattern_finds_its_own_event(spark):
    rng = np.random.default_rng(2)
    rows = [(e, "ab"[i % 2], float(i), float(rng.normal(e, 1 + e))) for e in range(6) for i in range(40)] + [(9, "a", 0.0, float("nan")), (0, "c", 0.0, None)]
    df = spark.createDataFrame(rows, "event_id int, variable string, t double, value double")
    events = similar.described(df, ["event_id"], F.col("t"))
    assert {r.event_id for r in events.collect()} == set(range(6))
    top = similar.by_pattern(events, df.where("event_id = 4"), F.col("t"), 2).where("rank = 1").first()
    assert (top.query_id, top.event_id) == ("query", 4) and top.score == pytest.approx(1.0)


def test_attribution_of_variables_that_both_datasets_have(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 1.0), ("y", 2.0)], "variable string, value double")
    b = spark.createDataFrame([("x", 0.0), ("x", 1.0), ("z", 1.0), ("z", 2.0)], "variable string, value double")
    (row,) = fingerprint.attribution_between(a, b).collect()
    assert (row.variable, row.delta, row.n_event, row.n_background) == ("x", 1.5, 2, 2)
    assert fingerprint.attribution_between(a.limit(0), b).count() == 0


def normal(seed, *keys):
    u, v = ((int(hashlib.md5(":".join(map(str, (s, *keys))).encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in (2 * seed, 2 * seed + 1))
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


@pytest.mark.parametrize(("n", "m", "sigma"), [(6, 5, 0.7), (2, 3, 1.0), (1, 1, 0.5)])
def test_smooth_noise_equals_a_reflected_convolution(spark, n, m, sigma):
    """The kernel may be wider than the grid."""
    rows = [(k, i, j, 0.0) for k in ("p", "q") for i in range(n) for j in range(m)]
    grid = spark.createDataFrame(rows, "variable string, lat_idx int, lon_idx int, value double")
    r = max(1, int(4 * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for row in coupled.smoothed_noise(grid, ["variable"], sigma, 7, expr.digest_normal).collect():
        wide = np.pad([[normal(7, row.variable, i, j) for j in range(m)] for i in range(n)], r, mode="symmetric")
        assert row.noise == pytest.approx(w @ wide[row.lat_idx : row.lat_idx + 2 * r + 1, row.lon_idx : row.lon_idx + 2 * r + 1] @ w)


def test_noise_without_groups_and_of_null_groups(spark):
    grid = spark.createDataFrame([(None, 0, 0), (None, 0, 1)], "k string, lat_idx int, lon_idx int")
    assert coupled.smoothed_noise(grid, ["k"], 1.0).count() == 2
    assert coupled.smoothed_noise(grid, [], 1.0).where("noise IS NOT NULL").count() == 2


def test_outputs_are_states_of_one_run(spark):
    rows = coupled.outputs(spark, 9.0, 3.0, 10800.0, 30.0).collect()
    assert sorted({r.hours for r in rows}) == [3.0, 6.0, 9.0]
    last = coupled.combined(coupled.run(spark, 6.0, 10800.0, 30.0))
    names = [c for c in last.columns if c not in ("lat", "lon")]
    want = last.agg(*(F.avg(c).alias(c) for c in names)).first()
    got = {r.field: r["mean"] for r in rows if r.hours == 6.0}
    assert got == {c: pytest.approx(want[c], rel=1e-9, nan_ok=True) if want[c] is not None else None for c in names}


def test_clusters_join_the_strongest_seed(spark):
    events = [("typhoon", 10.0, 100.0, 3.0, 500.0), ("typhoon", 11.0, 101.0, 2.0, 500.0), ("typhoon", 30.0, 100.0, 2.5, 500.0), ("heatwave", 10.0, 100.0, 1.0, 300.0)]
    df = spark.createDataFrame(events, "event_type string, lat double, lon double, intensity double, radius_km double").withColumn("confidence", F.lit(0.5))
    got = sorted((r.event_type, r.members, r.intensity, r.lat) for r in mesh.cluster_events(df).collect())
    assert got == [("heatwave", 1, 1.0, 10.0), ("typhoon", 1, 2.5, 30.0), ("typhoon", 2, 3.0, 10.5)]


def test_tenants_status(spark):
    tenants = spark.createDataFrame([("a", "A", 10.0, 5.0), ("b", "B", None, 5.0), ("c", "C", 1.0, 1.0)], "tenant_id string, name string, quota_jobs double, quota_gpu double")
    events = spark.createDataFrame([(1, "a", "jobs", -3.0), (2, "a", "jobs", 8.0), (3, "a", "jobs", 4.0), (4, "a", "gpu", 2.0), (5, "b", "jobs", 1.0), (6, "b", "other", 9.0), (7, "nobody", "jobs", 1.0)], "event_id int, tenant_id string, resource string, amount double")
    users = spark.createDataFrame([("a",), ("a",), (None,)], "tenant_id string")
    got = {r.tenant_id: r for r in tenancy.system_status(tenants, events, {"users": users, "sandboxes": users.limit(0)}, ("jobs", "gpu")).collect()}
    assert (got["a"].over_quota, got["a"].issues, got["a"].users, got["a"].sandboxes) == (True, ["jobs: 12.00 > 10.00"], 2, 0)
    assert got["a"].utilization == {"jobs": 100.0, "gpu": 40.0} and got["b"].over_quota and got["b"].users == 0
    assert (got["c"].over_quota, got["c"].issues, got["c"].utilization["jobs"]) == (False, [], 0.0)


def test_new_tenants(spark):
    asked = [(1, "x", "X", None, None), (2, "x", "again", "admin", 7.0), (3, "old", "O", "viewer", None), (4, "y", "Y", "king", None), (5, "y", "Y2", "ACADEMIC", 3.0), (6, None, "N", None, None)]
    requests = spark.createDataFrame(asked, "n int, tenant_id string, name string, role string, quota_jobs double")
    known = spark.createDataFrame([("old",), ("old",)], "tenant_id string")
    got = {r.n: r for r in tenancy.new_tenants(requests, known, ["n"]).collect()}
    assert [got[i].error for i in range(1, 7)] == [None, "exists", "exists", "unknown role", None, None]
    assert (got[1].role, got[1].quota_jobs, got[1].quota_storage_tb, got[1].sandbox) == ("research", 10.0, 10.0, "X_default")
    assert (got[5].role, got[5].quota_jobs) == ("academic", 3.0) and got[6].tenant_id == hashlib.md5(b"6").hexdigest()


def test_latest_versions_are_the_last_of_all(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d), i, str(rng.choice(["major", "minor", "patch"], p=[0.1, 0.3, 0.6]))) for i, d in enumerate(rng.integers(0, 30, 400))]
    changes = spark.createDataFrame([*rows, (99, 0, "major")], "dataset int, created_at int, change_type string")
    last = tenancy.versions(changes).groupBy("dataset").agg(F.max_by("version", "created_at").alias("version"), F.count("version").alias("n"))
    got = {r.dataset: (r.version, r.n_versions) for r in tenancy.latest_versions(changes).collect()}
    assert got == {r.dataset: (r.version, r.n) for r in last.collect()} and got[99] == ("1.0.0", 1)


def test_portable_checksum(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, None), ("l", 2, "")], "k string, n int, s string")
    digests = [hashlib.md5(t).hexdigest() for t in (b"=k|=1|=x", b"=k|=2|")]
    a, b = (sum(int(d[i : i + 8], 16) for d in digests) for i in (0, 8))
    got = {r.k: r.checksum for r in tenancy.checksum(df.repartition(3), ["k"], portable=True).collect()}
    assert got["k"] == hashlib.sha256(f"2:{a}:{b}".encode()).hexdigest()
    null = {r.k: r.checksum for r in tenancy.checksum(df.withColumn("s", F.when(F.col("k") != "l", F.col("s"))), ["k"], portable=True).collect()}
    assert null["k"] == got["k"] and null["l"] != got["l"]


def test_lineage_of_many_levels(spark):
    """Levels are folded into one table on the way; a cycle ends."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(19)] + [(0, 19)], "source int, target int")
    got = {r.node: r.steps for r in tenancy.lineage(spark, edges, spark.createDataFrame([(0,)], "node int")).collect()}
    assert got == {i: i for i in range(20)}


def test_best_of_a_sweep(spark):
    points = [{"x": x} for x in (3, 1, 2, 1)]
    for maximise, best in ((False, 1), (True, 0)):
        rows = orchestration.sweep(spark, points, lambda p: float(p["x"]), maximise).collect()
        assert len(rows) == 4 and [r.i for r in rows if r.best] == [best]
