"""Time-frequency spectra of series of any length.

A series' values are numbered by a scan, dealt to frames (each value to the few that
cover it), and batches of frames are transformed together: a task holds frames, not
series. The Hilbert spectrum alone needs a whole series, for its envelopes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.expr import finite
from . import scan

SEGMENT = 256
#: Samples of a stretch that wavelets are applied to, and how many scales they reach (their tail is below 1e-16 there).
BLOCK = 1 << 16
TAIL = 8.6


def numbered(df: DataFrame, series: str, order: str, value: str = "value", fs: float | None = None) -> DataFrame:
    """Samples (series, i from 0, x) with the series' n and fs: x is the value less
    the series' mean, 0 where it is missing; fs, if it is not given, the reciprocal
    of the first step of ``order`` (in seconds for times). Rows of one place are
    taken as they come in the order of their values."""
    at = F.unix_micros(F.col(order).cast("timestamp")) / 1e6 if dict(df.dtypes)[order].startswith(("timestamp", "date")) else F.col(order).cast("double")
    rows = df.select(F.col(series).alias("series"), at.alias("at"), finite(F.col(value)).cast("double").alias("v")).where("at IS NOT NULL")
    cut = scan.scan(scan.chunked(rows, ["series"], ["at", "v"]), ["series"], ["at", "v"], {"i": scan.total(F.lit(1))})
    cut = cut.withColumn("i", F.col("i") - 1)
    step = F.max(F.when(F.col("i") == 1, F.col("at"))) - F.max(F.when(F.col("i") == 0, F.col("at")))
    one = cut.groupBy(F.col("series").alias("_s")).agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"), F.when(step > 0, 1 / step).otherwise(1.0).alias("fs"))
    out = cut.join(one, cut["series"].eqNullSafe(F.col("_s")))
    return out.select("series", "i", F.coalesce(F.col("v") - F.col("m"), F.lit(0.0)).alias("x"), "n", (F.lit(float(fs)) if fs else F.col("fs")).alias("fs"))


def stft(samples: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Power (series, frequency, time, power) by Hann windows of ``segment`` samples
    (the whole of a shorter series) that overlap by half, the series continued by
    zeros on both sides; a window's weights sum to 1. Series of one sample have none."""
    size = F.least(F.lit(segment).cast("long"), F.col("n"))
    half = F.expr("size div 2")
    rows = samples.where("n >= 2").withColumn("size", size).withColumn("half", half).withColumn("step", F.col("size") - F.col("half")).withColumn("j", F.col("i") + F.col("half"))
    last = F.ceil((F.col("n") + 2 * F.col("half") - F.col("size")) / F.col("step")).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("j") - F.col("size") + 1) / F.col("step")).cast("long"))
    rows = rows.withColumn("frame", F.explode(F.sequence(first, F.least(F.expr("j div step"), last))))
    frames = rows.groupBy("series", "frame", "size", "step", "fs").agg(F.collect_list(F.struct((F.col("j") - F.col("frame") * F.col("step")).cast("int").alias("at"), "x")).alias("s"))
    kind, arrow = dict(samples.dtypes)["series"], to_arrow_type(samples.schema["series"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            frame, sizes, steps, fs = (some.column(i).to_numpy() for i in range(1, 5))
            lists = some.column(5)
            owner, values = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
            place, x = values.field(0).to_numpy(), values.field(1).to_numpy()
            for n in np.unique(sizes):  # one transform for all frames of a length
                mine = np.flatnonzero(sizes == n)
                row = np.full(some.num_rows, -1)
                row[mine] = np.arange(len(mine))
                grid, ours = np.zeros((len(mine), n)), row[owner] >= 0
                grid[row[owner[ours]], place[ours]] = x[ours]
                window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
                power = np.abs(np.fft.rfft(grid * window, axis=1) / window.sum()) ** 2
                k = power.shape[1]
                f = np.arange(k)[None, :] * (fs[mine] / n)[:, None]
                t = np.repeat(frame[mine] * steps[mine] / fs[mine], k)
                keys = some.column(0).take(pa.array(np.repeat(mine, k))).cast(arrow)
                yield pa.RecordBatch.from_arrays([keys, pa.array(f.ravel()), pa.array(t), pa.array(power.ravel())], ["series", "frequency", "time", "power"])

    return frames.mapInArrow(run, f"series {kind}, frequency double, time double, power double")


def scales_of(n: int, block: int = BLOCK) -> np.ndarray:
    """Twelve an octave from 2 samples to an eighth of the series (of a block, where that is shorter)."""
    longest = max(4.0, min(n, block) / 8)
    return 2 * 2 ** (np.arange(0, max(1, int(12 * np.log2(longest / 2)) + 1)) / 12)


def _morlet(x: np.ndarray, scales: np.ndarray, omega: float) -> np.ndarray:
    """Power of the sums of x with sampled wavelets exp(i omega t / s - t^2 / 2s^2) / (pi^(1/4) sqrt(s)), zeros beyond the ends."""
    widest = int(np.ceil(TAIL * scales.max()))
    size = 1 << (len(x) + widest).bit_length()
    z = np.fft.fft(x, size)
    out = np.empty((len(scales), len(x)))
    for k, s in enumerate(scales):
        t = np.arange(-int(np.ceil(TAIL * s)), int(np.ceil(TAIL * s)) + 1)
        kernel = np.zeros(size, complex)
        np.add.at(kernel, t % size, np.pi**-0.25 / np.sqrt(s) * np.exp(1j * omega * t / s - 0.5 * (t / s) ** 2))
        out[k] = np.abs(np.fft.ifft(z * np.fft.fft(kernel))[: len(x)]) ** 2
    return out


def wavelet(samples: DataFrame, omega: float = 5.0, block: int = BLOCK) -> DataFrame:
    """Morlet power (series, frequency, time, power) at ``scales_of`` the series. A
    series longer than ``block`` is cut into stretches, each with as much of the
    series on either side as its widest wavelet reaches, which is then dropped."""
    margin = int(np.ceil(TAIL * block / 8))
    top = F.floor((F.col("n") - 1) / block)
    lo, hi = F.greatest(F.floor((F.col("i") - margin) / block), F.lit(0)), F.least(F.floor((F.col("i") + margin) / block), top)
    dealt = samples.where("n >= 8").withColumn("stretch", F.explode(F.sequence(lo, hi)))
    kind, arrow = dict(samples.dtypes)["series"], to_arrow_type(samples.schema["series"].dataType)

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        i, x = rows.column("i").to_numpy(), rows.column("x").to_numpy()
        n, fs, stretch = rows.column("n")[0].as_py(), rows.column("fs")[0].as_py(), rows.column("stretch")[0].as_py()
        scales = scales_of(n, block)
        own = (i >= stretch * block) & (i < (stretch + 1) * block)
        power = _morlet(x, scales, omega)[:, own]
        m = int(own.sum())
        keys = pa.array([rows.column("series")[0].as_py()], arrow).take(pa.array(np.zeros(power.size, int)))
        return pa.table({"series": keys, "frequency": np.repeat(omega * fs / (2 * np.pi * scales), m), "time": np.tile(i[own] / fs, len(scales)), "power": power.ravel()})

    return dealt.groupBy("series", "stretch").applyInArrow(one, f"series {kind}, frequency double, time double, power double")


def hilbert(samples: DataFrame) -> DataFrame:
    """The Hilbert spectrum of empirical modes: a series is one task, for the
    envelopes of a mode run over all of it."""
    from .fingerprint import hilbert_huang

    kind, arrow = dict(samples.dtypes)["series"], to_arrow_type(samples.schema["series"].dataType)

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        f, t, p = hilbert_huang(rows.column("x").to_numpy(), rows.column("fs")[0].as_py())
        i, j = np.indices(p.shape)
        keys = pa.array([rows.column("series")[0].as_py()], arrow).take(pa.array(np.zeros(p.size, int)))
        return pa.table({"series": keys, "frequency": np.asarray(f, float)[i.ravel()], "time": np.asarray(t, float)[j.ravel()], "power": np.asarray(p, float).ravel()})

    return samples.groupBy("series").applyInArrow(one, f"series {kind}, frequency double, time double, power double")


METHODS = {"stft": stft, "fft": stft, "wavelet": wavelet, "hht": hilbert, "hilbert": hilbert}


def analyse(df: DataFrame, series: str, order: str, methods: list[str] = ["wavelet", "stft", "hht"], value: str = "value", fs: float | None = None) -> DataFrame:  # noqa: B006
    """One table (method, series, frequency, time, power) of several methods;
    methods that nobody knows are passed over."""
    samples = numbered(df, series, order, value, fs)
    parts = [METHODS[m.lower()](samples).select(F.lit(m).alias("method"), F.col("series").alias(series), "frequency", "time", "power") for m in methods if m.lower() in METHODS]
    if not parts:
        return samples.select(F.lit("").alias("method"), F.col("series").alias(series), *(F.lit(0.0).alias(c) for c in ("frequency", "time", "power"))).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_spectra(cells: DataFrame, time: str = "time", variables: list[str] | None = None, methods: list[str] = ["stft"]) -> DataFrame:  # noqa: B006
    """Spectra of a dataset: of each variable the mean over the cells that have a
    value, by time; the sampling rate follows from the first step."""
    some = cells if variables is None else cells.where(F.col("variable").isin(variables))
    means = some.groupBy("variable", time).agg(F.avg(finite(F.col("value"))).alias("value"))
    return analyse(means, "variable", time, methods)
