"""Causality against whole series in numpy."""

import numpy as np
import pytest

from gridspark.functions.special import f_tail
from gridspark.operators import causality


def by_hand(x, y, lag):
    """F statistic of the lag by least squares over the whole series."""
    past = lambda s: np.stack([s[lag - i : len(s) - i] for i in range(1, lag + 1)], axis=1)
    left = []
    for m in (past(y), np.hstack((past(y), past(x)))):
        left.append(float(((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum()))
    return (left[0] - left[1]) / lag / (left[1] / (len(y) - 3 * lag))


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    y = np.zeros(200)
    for t in range(3, 200):
        y[t] = 0.4 * y[t - 1] + 0.6 * x[t - 3] + rng.normal()
    return x + 3, y + 5


def test_lags_by_stretches_equal_a_window(spark):
    df = spark.createDataFrame([(k, t, float(t * t + (k or 0))) for k in (0, 1, None) for t in range(50)], "k int, t int, v double")
    got = causality.lagged(df, ["k"], ["t"], {"a": ("v", 1), "b": ("v", 3)}, width=7).collect()
    assert len(got) == 150
    for r in got:
        k = r.k or 0
        assert r._at == r.t + 1
        assert r.a == (None if r.t < 1 else float((r.t - 1) ** 2 + k)) and r.b == (None if r.t < 3 else float((r.t - 3) ** 2 + k))


@pytest.mark.parametrize("width", [8, 4096])
def test_granger_equals_least_squares(spark, series, width):
    x, y = series
    df = spark.createDataFrame([("x", "y", t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))], "a string, b string, t int, cause double, effect double")
    got = {(r.a, r.lag): r for r in causality.granger_table(df, ["a", "b"], "t", 5, both=True, width=width).collect()}
    assert len(got) == 12
    for lag in range(1, 6):
        for name, f in (("x", by_hand(x, y, lag)), ("y", by_hand(y, x, lag))):
            r = got[name, lag]
            assert r.n == 200 - lag and r.f_statistic == pytest.approx(f, rel=1e-8)
            assert r.p_value == pytest.approx(f_tail(f, lag, 200 - 3 * lag), rel=1e-6, abs=1e-300)


def test_least_p_value_names_the_lag(spark, series):
    rows = [(n, t, float(v)) for n, s in zip("xy", series) for t, v in enumerate(s)]
    got = {r.cause_name: r for r in causality.all_pairs(spark.createDataFrame(rows, "variable string, t int, value double"), "t").collect()}
    assert got["x"].lag == 3 and got["x"].significant and got["x"].p_value < 1e-6
    assert got["y"].effect_name == "x"


def test_short_constant_exact_and_missing(spark):
    nan = float("nan")
    rows = [("short", "s", t, 1.0 * t, 2.0 * t) for t in range(4)]
    rows += [("constant", "c", t, float(t % 3), 7.0) for t in range(40)]
    rows += [("exact", "e", t, float(t * t % 11), float((t - 1) ** 2 % 11)) for t in range(60)]
    rows += [("none", "n", 0, None, 1.0), ("none", "n", 1, nan, 1.0)]
    rows += [("zero", "z", t, 1.0, 0.0) for t in range(40)]
    df = spark.createDataFrame(rows, "a string, b string, t int, cause double, effect double")
    got = {r.a: r for r in causality.granger(df, ["a", "b"], "t").collect()}
    assert set(got) == {"short", "constant", "exact", "zero"}
    assert (got["short"].lag, got["short"].p_value, got["short"].significant) == (0, 1.0, False)
    assert got["constant"].f_statistic == pytest.approx(0, abs=1e-3) and got["zero"].p_value == 1.0
    assert got["exact"].significant and got["exact"].p_value < 1e-12
    assert causality.granger(df.where("false"), ["a", "b"], "t").count() == 0


def test_transfer_entropy_by_group(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, 400)
    rows = [("led", t, float(x[t]), float(x[t - 1])) for t in range(400)] + [("apart", t, float(x[t]), float(rng.integers(0, 2))) for t in range(400)]
    df = spark.createDataFrame(rows, "g string, t int, cause double, effect double")
    got = {r.g: r.transfer_entropy for r in causality.transfer_entropy(df, "cause", "effect", ["t"], ["g"]).collect()}
    assert got["led"] > 0.9 and 0 <= got["apart"] < 0.1
