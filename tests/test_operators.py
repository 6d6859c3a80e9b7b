"""Operators against NumPy, closed forms and known facts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import expr, special
from gridspark.operators import causality, assimilation, coupled, fingerprint, mesh, orchestration, quality, regrid, statistics, tenancy
from gridspark.sources import readers, sinks
from gridspark.streaming import ingest


def spiked(spark):
    """A smooth field with two spikes: 37 by 72 cells."""
    lat, lon = np.linspace(-90, 90, 37), np.linspace(0, 359, 72)
    field = np.repeat((288 - 30 * np.abs(np.sin(np.radians(lat))))[:, None], 72, 1)
    field[10, 20], field[20, 40] = 500, 150
    cells = [(i, j, "temperature", float(field[i, j])) for i in range(37) for j in range(72)]
    return field, spark.createDataFrame(cells, "lat_idx int, lon_idx int, variable string, value double")


def test_checks_on_two_spikes(spark):
    field, df = spiked(spark)
    assert quality.range_check(df).where("failed").count() == 2
    bad = {(r.lat_idx, r.lon_idx) for r in quality.gradient_check(df, []).where("failed").collect()}
    assert bad == {(9, 20), (10, 19), (10, 21), (11, 20), (19, 40), (20, 39), (20, 41), (21, 40)}
    assert quality.outlier_check(df, ["variable"]).where("failed").count() == 2
    flags = quality.run_checks(df, ["lat_idx", "lon_idx"], [quality.range_check, lambda d: quality.gradient_check(d, []), lambda d: quality.outlier_check(d, ["variable"])])
    q = quality.quality_by_variable(flags).first()
    assert q.n_failed == 12 and q.quality == pytest.approx(1 - 12 / 2664)
    nulled = quality.null_failures(df, flags, ["lat_idx", "lon_idx"])
    filled = quality.fill_with_mean(quality.fill_around(quality.fill_around(nulled, ["lat_idx"], "lon_idx"), ["lon_idx"], "lat_idx"), ["variable"])
    s = quality.cleaning_summary(filled).first()
    assert (s.missing_after, s.modified, s.pass_rate) == (0, 2, 1.0)  # the field does not vary along longitude: the others regain their value


def test_gradient_equals_numpy(spark):
    field, df = spiked(spark)
    gy, gx = np.gradient(field)
    got = {(r.lat_idx, r.lon_idx): r.gradient for r in quality.gradient_check(df, []).collect()}
    assert all(got[i, j] == pytest.approx(math.hypot(gy[i, j], gx[i, j])) for i in range(37) for j in range(72))


def test_fill_in_time_holds_ends(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (4, 4.0), (5, None)], "t int, value double").withColumn("k", F.lit(1))
    got = [r.value for r in quality.fill_in_time(df, ["k"], "t").orderBy("t").collect()]
    assert got == [1.0, 1.0, 2.0, 4.0, 4.0]


def test_tapers_and_distances(spark):
    c = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0]
    df = spark.createDataFrame([(x,) for x in c], "c double")
    got = [r[0] for r in df.select(expr.gaspari_cohn(F.col("c"))).collect()]
    assert got == pytest.approx([1, 0.684896, 0.208333, 0.016493, 0, 0], abs=1e-6)
    assert df.select(expr.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0] == pytest.approx(math.pi * 6371)
    sv = spark.createDataFrame([("1.2.3",), ("4.5",), ("x",), (None,)], "v string").select(expr.semver(F.col("v")).alias("s")).collect()
    assert [tuple(r.s) for r in sv] == [(1, 2, 3), (4, 5, 0), (0, 0, 0), (0, 0, 0)]


def test_special_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.f_tail(4.0, 2, 10) == pytest.approx(0.0528, abs=1e-3)
    assert special.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)


def test_regridding_is_exact_on_linear_fields(spark):
    f = lambda a, o: 2 * a - 3 * o + 1
    grid = spark.createDataFrame([(i, j, float(f(i, j))) for i in range(6) for j in range(7)], "lat_idx int, lon_idx int, value double")
    axis = lambda n: spark.createDataFrame([(i, float(i)) for i in range(n)], "idx int, pos double")
    ta, to = [0.5, 2.25, 5.0, 6.0], [0.0, 3.5]
    target = lambda t: spark.createDataFrame(list(enumerate(t)), "idx int, pos double")
    got = {(r.lat_t, r.lon_t): r.value for r in regrid.bilinear(grid, regrid.brackets(axis(6), target(ta)), regrid.brackets(axis(7), target(to))).collect()}
    assert got == {(i, j): pytest.approx(f(ta[i], to[j])) for i in range(3) for j in range(2)}
    lat, lon = (regrid.overlaps(regrid.cell_edges(axis(n)), regrid.cell_edges(axis(n)), 1.0) for n in (6, 7))
    same = {(r.lat_t, r.lon_t): r.value for r in regrid.conservative(grid, lat, lon).collect()}
    assert same == {(i, j): pytest.approx(f(i, j)) for i in range(6) for j in range(7)}
    x = np.arange(6.0)
    assert regrid.spline(x, x**3, np.array([0.5, 2.2, 4.9])) == pytest.approx(np.array([0.5, 2.2, 4.9]) ** 3)


def test_series_extrapolate(spark):
    s = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 5, 7.0)], "k int, t int, value double")
    wanted = spark.createDataFrame([(k, t) for k in (1, 2, 3) for t in (0, 2, 4)], "k int, t int")
    got = {(r.k, r.t): r.value for r in regrid.interpolate_series(s, wanted, ["k"]).collect()}
    assert got == {(1, 0): -1.0, (1, 2): 3.0, (1, 4): 7.0, **{(2, t): 7.0 for t in (0, 2, 4)}, **{(3, t): None for t in (0, 2, 4)}}


def test_crps_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 8)), rng.normal(size=5)
    members = spark.createDataFrame([(c, m, float(x[c, m])) for c in range(5) for m in range(8)], "c int, member int, value double")
    seen = spark.createDataFrame([(c, float(y[c])) for c in range(5)], "c int, value double")
    got = {r.c: r.crps for r in statistics.crps(members, seen, ["c"]).collect()}
    for c in range(5):
        want = np.abs(x[c] - y[c]).mean() - np.abs(x[c][:, None] - x[c]).mean() / 2
        assert got[c] == pytest.approx(want)


def test_effective_size_equals_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4, 30)) + rng.normal(size=30)
    df = spark.createDataFrame([(m, c, float(x[m, c])) for m in range(4) for c in range(30)], "member int, c int, value double")
    cov = np.cov(x)
    rho = (cov.sum() - np.trace(cov)) / 12 / (np.trace(cov) / 4)
    assert statistics.effective_size(df, ["c"]).first().effective == pytest.approx(4 / (1 + 3 * max(0, min(1, rho))))


def test_missing_member_makes_no_statistics(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 0, 1.0), (2, 1, 3.0)], "c int, member int, value double")
    got = {r.c: r["mean"] for r in statistics.ensemble_statistics(df, ["c"]).collect()}
    assert got == {1: None, 2: 2.0}


def test_granger_finds_the_driver(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = np.concatenate(([0], 0.8 * x[:-1])) + 0.1 * rng.normal(size=300)
    rows = [("x", i, float(x[i])) for i in range(300)] + [("y", i, float(y[i])) for i in range(300)]
    found = causality.causal_pairs(spark.createDataFrame(rows, "variable string, t int, value double"), "t", 3).collect()
    assert ("x", "y") in {(r.cause_name, r.effect_name) for r in found}


def test_spectra_find_the_period(spark):
    t = np.arange(512)
    df = spark.createDataFrame([("s", int(i), float(np.sin(2 * np.pi * i / 16))) for i in t], "series string, t int, value double")
    for method in ("stft", "wavelet", "hht"):
        top = fingerprint.spectrum(df, "series", "t", method).groupBy("frequency").agg(F.sum("power").alias("p")).orderBy(F.desc("p")).first()
        assert top.frequency == pytest.approx(1 / 16, rel=0.2), method


def test_similarity(spark):
    df = spark.createDataFrame([(2.0, 2.0, [1.0, 0.0], [1.0, 0.0], {"a": 1.0}, {"a": 1.0}), (1.0, 4.0, [1.0, 0.0], [0.0, 1.0], {"a": 1.0}, {"b": 1.0})], "d double, e double, v array<double>, w array<double>, m map<string,double>, n map<string,double>")
    got = df.select(fingerprint.temporal_similarity(F.col("d"), F.col("e"), F.col("v"), F.col("w")).alias("t"), fingerprint.spatial_similarity(F.col("m"), F.col("n")).alias("s")).collect()
    assert [(r.t, r.s) for r in got] == [(1.0, 1.0), (pytest.approx(0.125), 0.0)]


def test_filter_moves_to_the_observation(spark):
    rng = np.random.default_rng(0)
    members = spark.createDataFrame([("g", m, float(a), float(o), float(10 + z)) for m in range(30) for z in [rng.normal()] for a in (0, 10) for o in (0, 10)], "g string, member int, lat double, lon double, value double")
    obs = spark.createDataFrame([("g", 1, 0.0, 0.0, 12.0, 0.1)], "g string, obs_id int, p_lat double, p_lon double, value double, error double")
    got = {(r.lat, r.lon): r["mean"] for r in assimilation.enkf(members, obs, "g", 3000.0).collect()}
    assert got[0.0, 0.0] == pytest.approx(12, abs=0.3) and abs(got[10.0, 10.0] - 12) > abs(got[0.0, 0.0] - 12)


def test_mesh(spark):
    base = mesh.base_mesh(spark, 10.0)
    assert base.count() == 648
    finer = mesh.refine(base.withColumn("parent", F.lit(None).cast("long")), base.where("cell_id < 2"))
    assert finer.count() == 648 - 2 + 8 and mesh.coarsen(finer).count() == 2
    at = mesh.locate(spark.createDataFrame([(-89.0, 1.0)], "lat double, lon double"), finer, 10.0)
    assert at.first().level == 1
    stats = {r.level: r.cells for r in mesh.mesh_statistics(finer).collect()}
    assert stats == {0: 646, 1: 8}


def test_workflow_and_checkpoints(spark, tmp_path):
    W, T = orchestration.Workflow, orchestration.Task
    flow = W([T("a", lambda: 2, checkpoint=True), T("b", lambda x: x * 5, ["a"])])
    flow.depend("b", "a")
    store = orchestration.Checkpoints(spark, str(tmp_path / "c"))
    out = flow.execute(store)
    assert out["b"]["value"] == 10 and store.latest("a") == 2 and store.list("a").count() == 1
    bad = W([T("a", int, ["b"]), T("b", int, ["a"])])
    assert bad.problems()
    failing = W([T("a", lambda: 1 / 0, retries=1), T("b", int, ["a"])]).execute()
    assert failing["a"]["status"] == "failed" and "b" not in failing


def test_sweep_and_optimum(spark):
    points = orchestration.latin_hypercube([orchestration.Range("x"), orchestration.Range("k", values=("a", "b"), kind="values")], 20, 0)
    best = orchestration.sweep(spark, points, lambda p: -abs(p["x"] - 0.5) if p["k"] == "a" else 1 / 0).where("best").collect()
    assert len(best) == 1 and best[0].value > -0.1
    found, value, history = orchestration.bayesian(lambda p: -((p["x"] - 0.3) ** 2), [orchestration.Range("x")], 20, 6)
    assert abs(found["x"] - 0.3) < 0.05 and len(history) == 20


def test_coupled_run_changes_and_stays_physical(spark):
    state = coupled.run(spark, 6.0, 10800.0, 30.0)
    atmosphere = state["atmosphere"].agg(F.min("relative_humidity").alias("a"), F.max("relative_humidity").alias("b"), F.avg("temperature").alias("t")).first()
    assert atmosphere.a >= 0.01 and atmosphere.b <= 0.99
    assert coupled.combined(state).count() == state["atmosphere"].where("lev_idx = 0").count()


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(100).select(expr.hash_normal(1, F.col("id")).alias("z"), "id")
    one, other = ({r.id: r.z for r in d.collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert one == other and abs(np.mean(list(one.values()))) < 0.4


def test_tenancy(spark):
    events = spark.createDataFrame([(1, "a", 5.0), (2, "a", -9.0), (3, "a", 2.0)], "event_id int, tenant_id string, amount double")
    assert [r.used for r in tenancy.usage(events).orderBy("event_id").collect()] == [5.0, 0.0, 2.0]
    assert tenancy.scaled_workers([(0, 0.9), (10, 0.9), (400, 0.9), (800, 0.1)]) == [24, 24, 32, 28]
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "target string, source string")
    got = {r.node: r.steps for r in tenancy.lineage(spark, edges, spark.createDataFrame([("b",)], "node string")).collect()}
    assert got == {"b": 0, "a": 1, "c": 2}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0)], "latitude double, x double")
    assert readers.normalised(df).columns == ["lat", "lon"]
    m = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [0.0, 1.0], [5.0, 6.0])], "v array<array<double>>, a array<double>, o array<double>")
    assert {(r.lat, r.lon): r.value for r in readers.matrix_cells(m, "v", "a", "o").collect()} == {(0.0, 5.0): 1.0, (0.0, 6.0): 2.0, (1.0, 5.0): 3.0, (1.0, 6.0): 4.0}
    assert readers.from_mapping(readers.StreamConfig, {"workers": 2, "other": 1}).workers == 2
    stats = spark.createDataFrame([("t", 1.0, 2.0, 0.0, 3.0)], "variable string, mean double, std double, min double, max double")
    sinks.write_report(stats, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 4
    sinks.write_results(stats.withColumn("tenant_id", F.lit("x")), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).first().tenant_id == "x"


RECORDS = "id int, source string, ts timestamp, kind string, bytes long"


def records(spark):
    from datetime import datetime

    kinds = ["data", "stop", "data", "start", "data"]
    return [(i, "s", datetime(2024, 1, 1, 0, i), k, 10) for i, k in enumerate(kinds)]


def test_sessions_replayed(spark):
    last = ingest.dashboard(ingest.sessions(spark.createDataFrame(records(spark), RECORDS))).first()
    assert (last.session, last.session_chunks, last.total_chunks, last.rejected, last.total_bytes) == (1, 1, 2, 1, 20)


def test_sessions_streamed(spark, tmp_path):
    spark.createDataFrame(records(spark), RECORDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORDS).parquet(str(tmp_path / "in"))
    q = ingest.session_stream(stream).writeStream.outputMode("update").format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("sessions_out").first()
    assert (last.session, last.session_chunks, last.total_chunks, last.rejected) == (1, 1, 2, 1)


def test_each_batch_and_windows(spark, tmp_path, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ingest.each_batch(stream, lambda b: quality.range_check(b.withColumnRenamed("event_type", "variable"), 0.0, 150.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_facade_and_rights(spark):
    from gridspark.plans import facade

    _, df = spiked(spark)
    v = {r.variable: r for r in facade.validate(df, ["lat_idx", "lon_idx"], [quality.range_check]).collect()}
    assert v[None].n_failed == 2 and v["temperature"].passed
    rec = spark.createDataFrame([("a", ["t"], True, 1), ("a", ["u"], False, 2), ("b", ["t"], True, 3)], "data_source string, variables array<string>, passed boolean, ts int")
    assert [r.ts for r in facade.history(rec, source="a").collect()] == [2, 1]
    assert [r.ts for r in facade.history(rec, variable="t", passed=True, since=F.lit(2)).collect()] == [3]
    assert [r.ts for r in facade.latest(rec, 2).collect()] == [2, 3]
    done = spark.createDataFrame([(1, "completed"), (1, "failed")], "execution_id int, status string")
    assert facade.completion(done).first().percent == 50.0
    state = spark.createDataFrame([("a", True, 2.0, 3.0)], "tenant_id string, active boolean, used_jobs double, quota_jobs double")
    req = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("z", 1.0)], "tenant_id string, request_jobs double")
    got = {(r.tenant_id, r.request_jobs): (r.granted, list(r.reasons)) for r in tenancy.available(req, state, ("jobs",)).collect()}
    assert got[("a", 1.0)][0] and got[("a", 2.0)] == (False, ["jobs would exceed its quota"]) and got[("z", 1.0)] == (False, ["no such tenant"])
    acl = spark.createDataFrame([("r", "user", "u", ["read"], None, 1)], "resource_id string, grantee_kind string, grantee string, permissions array<string>, expires_at int, granted_at int")
    gone = spark.createDataFrame([("r", "user", "u")], "resource_id string, grantee_kind string, grantee string")
    assert tenancy.grant(acl, acl).count() == 2 and tenancy.revoke(acl, gone).count() == 0
