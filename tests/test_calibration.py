"""Monotone fits and reliability against fits by hand."""

import numpy as np
import pytest

from gridspark.operators import calibration


def fit(p, y):
    """The largest of the smallest means, for each distinct probability."""
    at = np.unique(p)
    n, s = np.array([(p == v).sum() for v in at]), np.array([y[p == v].sum() for v in at])
    n, s = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(s)))
    mean = lambda a, b: (s[b + 1] - s[a]) / (n[b + 1] - n[a])
    return {v: max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i, v in enumerate(at)}


def rows(seed, n=120, distinct=60):
    rng = np.random.default_rng(seed)
    p = rng.integers(0, distinct, n) / distinct
    return p, (rng.random(n) < p * p).astype(float)


@pytest.mark.parametrize("width", [4, 16, 100_000])
def test_blocks_equal_a_fit_by_hand(spark, width):
    groups = {"a": rows(1), "b": rows(2), None: (np.linspace(0.9, 0, 40), np.linspace(0, 1, 40))}  # the last falls all along
    df = spark.createDataFrame([(g, float(a), float(b)) for g, (p, y) in groups.items() for a, b in zip(p, y)], "g string, probability double, y double")
    got = calibration.isotonic_blocks(df, ["g"], width=width).collect()
    for g, (p, y) in groups.items():
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.lo)
        assert sum(r.n for r in mine) == len(p)
        assert all(a.mean < b.mean and a.hi < b.lo for a, b in zip(mine, mine[1:]))
        for v, want in fit(p, y).items():
            (block,) = [r for r in mine if r.lo <= v <= r.hi]
            assert block.mean == pytest.approx(want, abs=1e-12)
    assert len([r for r in got if r.g is None]) == 1


def test_apply_between_and_beyond_blocks(spark):
    pairs = spark.createDataFrame([(0.2, 0.0), (0.4, 1.0), (0.4, 0.0), (0.6, 1.0), (None, 1.0), (0.5, float("nan"))], "probability double, y double")
    asked = spark.createDataFrame([(i, p) for i, p in enumerate((0.0, 0.2, 0.3, 0.4, 0.5, 0.9, None, float("nan"), 0.3))], "id int, probability double")
    got = {r.id: r.calibrated for r in calibration.apply_isotonic(asked, calibration.isotonic_blocks(pairs)).collect()}
    assert [got[i] for i in range(9)] == [0.0, 0.0, pytest.approx(0.25), 0.5, pytest.approx(0.75), 1.0, None, None, pytest.approx(0.25)]


def test_no_pairs_leave_the_probability(spark):
    none = spark.createDataFrame([], "probability double, y double")
    asked = spark.createDataFrame([(0.3,), (None,)], "probability double")
    for method in ("isotonic", "reliability"):
        assert sorted((r.calibrated for r in calibration.calibrate(asked, none, method).collect()), key=str) == [0.3, None]


def test_reliability_by_group(spark):
    p, y = rows(7)
    df = spark.createDataFrame([(g, float(a), float(b)) for g in ("a", None) for a, b in zip(p, y)] + [("a", 1.0, 1.0)], "g string, probability double, y double")
    table = calibration.reliability_bins(df, 5, ["g"])
    at = np.minimum((p * 5).astype(int), 4)
    for r in (r for r in table.collect() if r.g is None):
        assert r.n == (at == r.bin).sum() and r.observed == pytest.approx(y[at == r.bin].mean()) and r.forecast == pytest.approx(p[at == r.bin].mean())
    for r in calibration.apply_reliability(df, table, 5, ["g"]).where("g IS NULL").collect():
        assert r.calibrated == pytest.approx(y[at == min(int(r.probability * 5), 4)].mean())
    parts = [r for r in calibration.reliability_parts(table, ["g"]).collect() if r.g is None][0]
    assert parts.uncertainty == pytest.approx(y.mean() * (1 - y.mean())) and 0 <= parts.resolution <= parts.uncertainty


def test_dispatch(spark):
    forecast = spark.createDataFrame([(1.0, 2.0)], "mean double, std double")
    seen = spark.createDataFrame([(1.0,), (5.0,)], "value double")
    assert calibration.calibrate(forecast, None, "isotonic") is forecast
    assert calibration.calibrate(forecast, seen, "unheard of").first().asDict() == {"mean": 1.0, "std": 2.0, "calibration_method": "unheard of"}
    got = calibration.calibrate(forecast, seen).first()
    assert (got["mean"], got["std"], got.calibration_method) == (2.0, pytest.approx(2**0.5), "bayesian")
