"""Spectra by frames and stretches against whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import spectra


def whole_stft(x, fs):
    """One series at once."""
    n = min(256, len(x))
    step, window = n - n // 2, np.hanning(n + 1)[:-1]
    x = np.concatenate((np.zeros(n // 2), x, np.zeros(n // 2)))
    x = np.append(x, np.zeros(-(len(x) - n) % step))
    z = np.stack([np.fft.rfft(x[i : i + n] * window) / window.sum() for i in range(0, len(x) - n + 1, step)], axis=1)
    return np.fft.rfftfreq(n, 1 / fs), np.arange(z.shape[1]) * step / fs, np.abs(z) ** 2


def made(spark, seed=1):
    rng = np.random.default_rng(seed)
    series = {"long": rng.normal(size=1500).cumsum(), "exact": rng.normal(size=256), "odd": rng.normal(size=383), "short": rng.normal(size=37), "two": np.array([1.0, 4.0]), "one": np.array([3.0])}
    gaps = series["odd"].copy()
    gaps[::7] = np.nan
    series["gaps"] = gaps
    rows = [(k, 0.5 * i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return series, spark.createDataFrame(rows, "name string, t double, value double").repartition(5)


def test_frames_equal_whole_series(spark):
    series, df = made(spark)
    got = {}
    for r in spectra.analyse(df, "name", "t", ["stft"]).collect():
        got.setdefault(r.name, {})[round(r.frequency, 9), round(r.time, 9)] = r.power
    assert set(got) == set(series) - {"one"}
    for name, found in got.items():
        x = series[name]
        f, t, p = whole_stft(np.where(np.isfinite(x), x - np.nanmean(x), 0), 2.0)
        want = {(round(a, 9), round(b, 9)): p[i, j] for i, a in enumerate(f) for j, b in enumerate(t)}
        assert set(found) == set(want)
        assert all(found[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_stretches_equal_whole_series(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=1000)
    df = spark.createDataFrame([(None, i, float(v)) for i, v in enumerate(x)], "name string, t int, value double")
    samples = spectra.numbered(df, "name", "t")
    cut = {(round(r.frequency, 9), r.time): r.power for r in spectra.wavelet(samples, block=128).collect()}
    scales = spectra.scales_of(1000, 128)
    want = spectra._morlet(x - x.mean(), scales, 5.0)
    assert len(cut) == len(scales) * 1000
    for k, s in enumerate(scales):
        f = round(5.0 / (2 * np.pi * s), 9)
        assert [cut[f, float(i)] for i in range(1000)] == pytest.approx(want[k], rel=1e-6, abs=1e-8)
    assert {r.series for r in spectra.wavelet(samples, block=128).select("series").distinct().collect()} == {None}


def test_wavelets_equal_direct_sums():
    x, scales = np.random.default_rng(6).normal(size=90), np.array([2.0, 3.7, 11.0])
    got = spectra._morlet(x, scales, 5.0)
    for k, s in enumerate(scales):
        for at in range(0, 90, 7):
            t = at - np.arange(90)
            want = abs((x * np.pi**-0.25 / np.sqrt(s) * np.exp(5j * t / s - 0.5 * (t / s) ** 2)).sum()) ** 2
            assert got[k, at] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_several_methods_in_one_table(spark):
    _, df = made(spark)
    out = spectra.analyse(df.where("name = 'odd'"), "name", "t", ["wavelet", "no such thing", "STFT", "hht"])
    assert {r.method for r in out.select("method").distinct().collect()} == {"wavelet", "STFT", "hht"}
    assert spectra.analyse(df, "name", "t", ["no such thing"]).count() == 0
    assert spectra.analyse(df.where("false"), "name", "t").count() == 0


def test_a_dataset_is_averaged_over_its_cells(spark):
    t = np.arange(512)
    rows = [("wave", f"2024-01-01 {i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}", c, float(np.sin(2 * np.pi * i / 16) + c) if (i + c) % 9 else None) for i in t for c in (0.0, 1.0)]
    cells = spark.createDataFrame(rows, "variable string, time string, cell double, value double").withColumn("time", F.col("time").cast("timestamp_ntz"))
    top = spectra.dataset_spectra(cells, variables=["wave"]).groupBy("frequency").agg(F.sum("power").alias("p")).orderBy(F.desc("p")).first()
    assert top.frequency == pytest.approx(1 / 16)
