"""The filter by areas against the sequential one, and assimilation by every method."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import assimilation, enkf


def sequential(cells, e, obs, radius, kind, seed):
    """One observation after the other over all cells, with loops."""
    e = e.copy()
    for _, k, p_lat, p_lon, value, error in obs:
        if value is None or not np.isfinite(value):
            continue
        error = error if error > 0 else 1.0
        near = min(range(len(cells)), key=lambda i: (abs(cells[i][0] - p_lat) + abs(cells[i][1] - p_lon), cells[i]))
        h = e[:, near].copy()
        noise = np.array([error * enkf.normal(seed, k, m) for m in range(len(h))])
        for i, (lat, lon) in enumerate(cells):
            rho = float(enkf.taper(kind, np.array(enkf.distance(np.array(lat), np.array(lon), p_lat, p_lon) / radius)))
            if rho > 0:
                x = e[:, i]
                gain = ((x - x.mean()) * (h - h.mean())).mean() * rho / (h.var() + error**2)
                e[:, i] = x + gain * (value + noise - h)
    return e


def setting(seed, step, n_obs):
    rng = np.random.default_rng(seed)
    cells = [(float(a), float(o)) for a in np.arange(-90, 91, step) for o in np.arange(0, 360, step)]
    e = 280 + rng.normal(size=(5, len(cells)))
    obs = [("g", k, float(rng.uniform(-90, 90)), float(rng.uniform(0, 360)), float(280 + rng.normal()), float(rng.choice([0.5, 1.0, 0.0]))) for k in range(n_obs)]
    return cells, e, obs + [("g", n_obs, 89.9, 10.0, 281.0, 1.0), ("g", n_obs + 1, 89.9, 190.0, 279.0, 1.0), ("g", n_obs + 2, 0.0, 0.1, None, 1.0), ("g", n_obs + 3, 0.0, 359.9, 282.0, 0.7)]


@pytest.mark.parametrize("kind,radius,step,n_obs", [("gaspari_cohn", 700.0, 15, 60), ("linear", 900.0, 20, 40), ("gaspari_cohn", 9000.0, 30, 10)])
def test_areas_in_parallel_equal_the_sequential_filter(spark, kind, radius, step, n_obs):
    cells, e, obs = setting(n_obs, step, n_obs)
    members = spark.createDataFrame([("g", m, a, o, float(e[m, i])) for i, (a, o) in enumerate(cells) for m in range(5)], "g string, member int, lat double, lon double, value double")
    frame = spark.createDataFrame(obs, "g string, obs_id int, p_lat double, p_lon double, value double, error double")
    got = {(r.lat, r.lon): r for r in enkf.filtered(members, frame, "g", radius, seed=7, kind=kind).collect()}
    offset = max(min(float(enkf.distance(np.array(a), np.array(o), p[2], p[3])) for a, o in cells if abs(a - p[2]) + abs(o - p[3]) == min(abs(c[0] - p[2]) + abs(c[1] - p[3]) for c in cells)) for p in obs if p[4] is not None)
    reach = enkf.REACH[kind] * radius
    colours = {r.obs_id: (r.colour, r.tile) for r in enkf.coloured(frame, max(2 * reach, reach + offset) * 1.001).collect()}
    ordered = sorted(obs, key=lambda o: (colours[o[1]][0], o[1]))
    want = sequential(cells, e, ordered, radius, kind, 7)
    for i, c in enumerate(cells):
        assert got[c].e == pytest.approx(want[:, i], abs=1e-9) and got[c]["mean"] == pytest.approx(want[:, i].mean(), abs=1e-9) and got[c].spread == pytest.approx(want[:, i].std(), abs=1e-9)
    if radius < 1000:
        assert len({c for c, _ in colours.values()}) == 4 and len(set(colours.values())) > 8


def test_tiles_of_a_colour_lie_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 700))), rng.uniform(0, 360, 700)))] + [(700, 90.0, 0.0), (701, -90.0, 180.0), (702, 89.0, 180.0)]
    for width in (1500.0, 4000.0, 12000.0):
        got = enkf.coloured(spark.createDataFrame(rows, "obs_id int, p_lat double, p_lon double"), width).collect()
        for k in range(4):
            mine = [r for r in got if r.colour == k]
            for a in mine[:60]:
                for b in mine:
                    if (a.band, a.tile) != (b.band, b.tile):
                        assert enkf.distance(np.array(a.p_lat), np.array(a.p_lon), b.p_lat, b.p_lon) >= width * 0.999


def test_missing_values_and_no_observations(spark):
    members = spark.createDataFrame([("a", m, lat, 0.0, None if (m, lat) == (1, 10.0) else 1.0 + m) for m in range(3) for lat in (0.0, 10.0)] + [("b", 0, 0.0, 0.0, 1.0)], "g string, member int, lat double, lon double, value double")
    obs = spark.createDataFrame([("a", 1, 0.0, 0.0, None, 1.0), ("c", 2, 0.0, 0.0, 1.0, 1.0)], "g string, obs_id int, p_lat double, p_lon double, value double, error double")
    got = {(r.group, r.lat): r for r in enkf.filtered(members, obs, "g", 100.0).collect()}
    assert set(got) == {("a", 0.0), ("a", 10.0), ("b", 0.0)} and got["a", 0.0].e == [1, 2, 3] and np.isnan(got["a", 10.0].e[1])
    with pytest.raises(ValueError, match="wide"):
        enkf.filtered(members, obs.withColumn("value", F.lit(2.0)), "g", 100.0, tile_km=50.0)


@pytest.mark.parametrize("method", sorted(assimilation.METHODS))
def test_every_method_moves_towards_the_observations(spark, method):
    background = spark.createDataFrame([(i, j, -60.0 + 20 * i, 30.0 * j, 280.0) for i in range(7) for j in range(12)], "lat_idx int, lon_idx int, lat double, lon double, value double")
    rows = [(1, 0.0, 30.0, "2024-01-01 00:00:00", 283.0, 3.0, 0.5), (2, 0.0, 90.0, "2024-01-01 01:00:00", 283.0, 3.0, -1.0), (3, 40.0, 150.0, "2024-02-01 00:00:00", 283.0, 3.0, 0.5), (4, 0.0, 210.0, None, float("nan"), float("nan"), 0.5)]
    obs = spark.createDataFrame(rows, "obs_id int, p_lat double, p_lon double, ts string, value double, innovation double, error double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    centre, keys = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), ["lat_idx", "lon_idx"]
    members = assimilation.initial_ensemble(background.withColumn("variable", F.lit("t")), 60, keys)
    members = members.withColumn("value", 280 + 2000 * (F.col("value") - 280))  # a constant field's noise is a thousandth
    out = assimilation.assimilate(method, background, obs, keys, centre, 1500.0, 2.0, 6.0, members)
    assert assimilation.assimilate(method, background, obs, keys, centre, 1500.0).count() == 84
    got = {(r.lat_idx, r.lon_idx): r for r in out.collect()}
    assert len(got) == 84 and all(r.analysis == pytest.approx(280 + r.increment) for r in got.values())
    assert got[3, 1].increment > 1 and abs(got[3, 3].increment) < 0.5 and got[3, 7].increment == 0 and got[0, 11].increment == 0
    late = got[5, 5].increment
    assert late == 0 if assimilation.METHODS[method] == "four_d_var" else late > 1
