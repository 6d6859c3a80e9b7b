"""Exact quantiles by brackets, and the blocked kernel of inverse distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import fingerprint, quantiles, regrid, statistics

POINTS = {"p0": 0.0, "p10": 0.1, "p33": 1 / 3, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def check(spark, groups, limit):
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("empty", None)]
    got = quantiles.quantiles(spark.createDataFrame(rows, "k string, x double").repartition(4), ["k"], F.col("x"), POINTS, limit).collect()
    assert {r.k for r in got} == {k for k, xs in groups.items() if len(xs)}
    for r in got:
        want = np.quantile(np.array(groups[r.k], float), list(POINTS.values()))
        assert [r[n] for n in POINTS] == pytest.approx(want, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("limit", [3, 100])
def test_quantiles_of_all_kinds_of_groups(spark, limit):
    rng = np.random.default_rng(limit)
    groups = {
        "normal": rng.normal(size=700), None: rng.random(300), "ties": [5.0] * 300 + [6.0] * 300, "equal": [2.5] * 100, "one": [7.0], "two": [1.0, 2.0],
        "tails": np.concatenate([10.0 ** rng.uniform(-300, 300, 200) * rng.choice([-1, 1], 200), [1.7e308, -1.7e308]]), "clusters": np.concatenate([rng.random(200) * 1e-9, 1 + rng.random(200) * 1e-9]),
        "powers": [1000.0**k for k in range(60)], "negative": -rng.exponential(size=200), "none": [],
    }
    check(spark, groups, limit)


def test_no_task_holds_more_than_the_limit(spark):
    """Of a large group only what is left of a bracket is counted by value."""
    x = spark.range(200_000).select(F.lit(1).alias("k"), (F.hash("id") / 7.0).alias("_x"))
    sizes = x.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    open_ = sizes.select("k", F.lit(1000).cast("long").alias("_k"), "_a", "_b", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"))
    one = quantiles._narrowed(x, open_, ["k"], False)
    r = one.collect()[0]
    assert r["_in"] < 1000 and r["_below"] <= 1000 < r["_below"] + r["_in"]


def test_statistics_are_the_same_with_small_limits(spark, sf):
    obs = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("variable"), F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("value"))
    for f in (statistics.describe, fingerprint.fingerprint):
        a, b = (sorted(map(str, f(obs, ["variable"], limit=limit).select("variable", "n", *(F.round(c, 9).alias(c) for c in ("mean", "min", "p25", "p50", "p75"))).collect())) for limit in (20, 1 << 17))
        assert a == b
    whole = statistics.describe(obs, [], limit=20).collect()
    assert len(whole) == 1 and whole[0].p50 == pytest.approx(np.quantile([r.value for r in obs.collect() if r.value is not None], 0.5))
    assert statistics.describe(obs.where("false"), ["variable"]).count() == 0
    nothing = statistics.describe(obs.where("value IS NULL"), ["variable"]).collect()
    assert nothing and all(r.n == 0 and r.p50 is None for r in nothing)


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_inverse_distances_equal_all_pairs(spark, block, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(str(v) if v < 2 else None, float(a), float(o), float(x)) for v in range(3) for a, o, x in zip(rng.uniform(-90, 90, 50), rng.uniform(0, 360, 50), rng.normal(size=50))]
    rows += [("0", 0.0, 0.0, None), ("0", 0.0, 0.0, float("nan"))]
    targets = [(i, float(a), float(o)) for i, (a, o) in enumerate(rng.uniform(0, 90, (7, 2)))] + [(7, rows[0][1], rows[0][2])]
    field = spark.createDataFrame(rows, "variable string, lat double, lon double, value double").repartition(3)
    got = {(r.variable, r.t_id): r.value for r in regrid.idw(field, spark.createDataFrame(targets + targets[:2], "t_id int, t_lat double, t_lon double"), ["variable"], block=block).collect()}
    assert len(got) == 24
    for v in ("0", "1", None):
        mine = np.array([r[1:] for r in rows if r[0] == v and r[3] is not None and r[3] == r[3]], float)
        for i, a, o in targets:
            w = 1 / np.maximum(np.hypot(mine[:, 0] - a, mine[:, 1] - o), 1e-10) ** 2
            assert got[v, i] == pytest.approx((w * mine[:, 2]).sum() / w.sum(), rel=1e-9)
    assert regrid.idw(field.drop("variable"), spark.createDataFrame([], "t_id int, t_lat double, t_lon double")).count() == 0
    plan = regrid.idw(field, spark.createDataFrame(targets, "t_id int, t_lat double, t_lon double"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
