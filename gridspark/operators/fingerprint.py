"""Fingerprints, similarity, attribution and spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.expr import cosine, finite, safe_ratio
from .quantiles import LIMIT, with_quantiles


def fingerprint(df: DataFrame, by: list[str], value: str = "value", limit: int = LIMIT) -> DataFrame:
    """Nine features of the finite values: mean, deviation, ends, quartiles,
    skewness and excess kurtosis (biased; 0 for few or equal values). Quartiles are
    exact, and no task holds more than ``limit`` values of a group."""
    x = finite(F.col(value))
    varied = (F.stddev_pop(x) > 0).alias("v")
    out = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"), varied,
    )
    out = with_quantiles(df, by, x, out, {f"p{p}": p / 100 for p in (25, 50, 75)}, limit)
    skew = F.when(F.col("v") & (F.col("n") > 2), F.col("skew")).otherwise(0.0)
    kurt = F.when(F.col("v") & (F.col("n") > 3), F.col("kurt")).otherwise(0.0)
    return out.where("n > 0").withColumns({"skew": skew, "kurt": kurt}).drop("v")


def temporal_similarity(d1: Column, d2: Column, v1: Column, v2: Column) -> Column:
    """Half by durations, half by the cosine of the vectors; 0 without a common length."""
    length = 1 - F.least(F.abs(d1 - d2) / F.greatest(d1, d2, F.lit(1.0)), F.lit(1.0))
    angle = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(v1, v2)))
    return F.when((F.size(v1) == 0) | (F.size(v1) != F.size(v2)), 0.0).otherwise(0.5 * length + 0.5 * angle)


def spatial_similarity(m1: Column, m2: Column) -> Column:
    """Mean agreement over the variables that both maps have."""
    common = F.array_intersect(F.map_keys(m1), F.map_keys(m2))
    one = lambda k: 1 - F.abs(m1[k] - m2[k]) / F.greatest(F.abs(m1[k]), F.abs(m2[k]), F.lit(1e-10))
    return F.when(F.size(common) == 0, 0.0).otherwise(F.aggregate(F.transform(common, one), F.lit(0.0), lambda s, v: s + v) / F.size(common))


#: Queries go to the tasks in blocks of so many bytes of vectors and results; each block is one pass over the events.
QUERY_BYTES = 32 << 20
#: So many queries of a block meet so many events at a time: what a task holds beside its block are matrices of this size.
QUERIES_AT_ONCE, EVENTS_AT_ONCE = 256, 2048


def most_similar(events: DataFrame, queries: DataFrame, top: int = 20, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each query (query_id, query) the most similar events (event_id,
    vector) by cosine, itself left out; ties by id. A zero vector, none, or one of
    another length is 0 alike.

    The queries are a stated set, held against all events: a block of them at a
    time, as a matrix product for each Arrow batch. A task keeps the top of what
    it has seen, so a row for each query, place and task is shuffled, no pair.
    """
    width = queries.agg(F.coalesce(F.max(F.size("query")), F.lit(0)), F.count(F.lit(1))).first()
    room = max(1, block_bytes // max(1, 8 * (width[0] + 2 * top)))
    n_blocks = max(1, -(-width[1] // room))
    dealt = queries.select("query_id", F.transform("query", lambda x: x.cast("double")).alias("query"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    kinds = dict(events.dtypes)["event_id"], dict(queries.dtypes)["query_id"]
    arrow = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(events.schema["event_id"].dataType)
    own = events.select("event_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    found = None
    for block in range(n_blocks):
        rows = dealt.where(F.col("_block") == block).select("query_id", "query").collect()  # one block of bounded size
        by_length: dict[int, list] = {}
        for r in rows:
            by_length.setdefault(len(r.query or ()), []).append(r)
        for length, some in by_length.items():
            matrix = _unit(np.array([r.query for r in some], float).reshape(len(some), length))
            part = own.mapInArrow(_top_of([r.query_id for r in some], matrix, top, arrow), f"query_id {kinds[1]}, event_id {kinds[0]}, score double")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = own.crossJoin(queries.select("query_id").limit(0)).select("query_id", "event_id", F.lit(0.0).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "event_id"))
    return found.select("query_id", "event_id", "score", rank.alias("rank")).where(F.col("rank") <= top)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class _Top:
    """The best that a task has seen of each query's events, by score and then by
    id: scores, ids and what goes with them. What cannot reach the last place is
    left out a matrix at a time."""

    def __init__(self, names: list, top: int, more: int = 0):
        self.names, self.top = names, top
        self.least = np.full(len(names), -np.inf)
        self.kept: list[tuple] = [(np.zeros(0), np.zeros(0, object), *(np.zeros(0) for _ in range(more)))] * len(names)

    def take(self, first: int, ids: np.ndarray, scores: np.ndarray, *more: np.ndarray) -> None:
        """Scores of the queries from ``first`` on, a row each, and of the events ``ids``, a column each."""
        near = ~(scores < self.least[first : first + len(scores), None])
        for row in np.flatnonzero(near.any(axis=1)):
            q, at = first + row, np.flatnonzero(near[row])
            at = at[ids[at] != self.names[q]]
            kept = [np.concatenate(pair) for pair in zip(self.kept[q], (scores[row, at], ids[at], *(x[row, at] for x in more)))]
            s, i = kept[:2]
            if len(s) > self.top:  # all that is as good as the last place, then in order
                best = np.flatnonzero(s >= np.partition(s, len(s) - self.top)[len(s) - self.top])
                best = best[np.lexsort((i[best], -s[best]))][: self.top]
                kept = [x[best] for x in kept]
            if len(kept[0]) == self.top:
                self.least[q] = kept[0].min()
            self.kept[q] = tuple(kept)


def _top_of(names: list, matrix: np.ndarray, top: int, kinds: tuple, at_once: int = EVENTS_AT_ONCE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length = matrix.shape
        found = _Top(names, top)
        for whole in batches:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                ids = np.array(batch.column(0).to_pylist(), object)
                vectors = batch.column(1).to_pylist()
                fits = np.array([v is not None and len(v) == length for v in vectors], bool)
                units = _unit(np.array([v for v, ok in zip(vectors, fits) if ok], float).reshape(int(fits.sum()), length)).T
                for first in range(0, n, QUERIES_AT_ONCE):
                    some = matrix[first : first + QUERIES_AT_ONCE]
                    scores = np.zeros((len(some), len(ids)))
                    if fits.any():
                        scores[:, fits] = some @ units
                    found.take(first, ids, scores)
        for start in range(0, n, QUERIES_AT_ONCE):
            columns = [(name, i, s) for name, (scores, ids) in zip(names[start : start + QUERIES_AT_ONCE], found.kept[start : start + QUERIES_AT_ONCE]) for s, i in zip(scores.tolist(), ids.tolist())]
            if columns:
                q, i, s = zip(*columns)
                yield pa.RecordBatch.from_arrays([pa.array(q, kinds[0]), pa.array(i, kinds[1]), pa.array(s, pa.float64())], ["query_id", "event_id", "score"])

    return run


def attribution(df: DataFrame, by: str, event: Column) -> DataFrame:
    """Of each variable, event against background: means, change, change in
    background deviations, Welch's t and its degrees of freedom and p value."""
    side = lambda c, name: [F.count(F.when(c, F.col("value"))).alias(f"n_{name}"), F.avg(F.when(c, F.col("value"))).alias(f"mean_{name}"), F.var_samp(F.when(c, F.col("value"))).alias(f"var_{name}")]
    out = df.groupBy(by).agg(*side(event, "event"), *side(~event, "background"), F.stddev_pop(F.when(~event, F.col("value"))).alias("std"))
    delta = F.col("mean_event") - F.col("mean_background")
    a, b = F.col("var_event") / F.col("n_event"), F.col("var_background") / F.col("n_background")
    out = out.withColumns({"delta": delta, "percent": safe_ratio(100 * delta, F.col("mean_background"), 0.0)})
    out = out.withColumns({"sigma": F.col("delta") / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0), "t": safe_ratio(F.col("delta"), F.sqrt(a + b))})
    dof = safe_ratio((a + b) * (a + b), a * a / (F.col("n_event") - 1) + b * b / (F.col("n_background") - 1))
    return out.where("n_event > 1 AND n_background > 1").withColumn("dof", dof).drop("std", "var_event", "var_background")


def attribution_between(target: DataFrame, background: DataFrame, by: str = "variable") -> DataFrame:
    """``attribution`` of one dataset against another, of the variables (by, value)
    that both have; the two may lie anywhere and share no key but the variable's name."""
    both = target.select(by, "value", F.lit(True).alias("_event")).unionByName(background.select(by, "value", F.lit(False).alias("_event")))
    return attribution(both, by, F.col("_event"))


def with_p_value(df: DataFrame, t: str = "t", dof: str = "dof") -> DataFrame:
    from ..functions.special import t_two_sided

    @F.pandas_udf("double")
    def p(ts: pd.Series, ds: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) or pd.isna(d) else t_two_sided(t, d) for t, d in zip(ts, ds)], dtype="float64")

    return df.withColumn("p_value", p(t, dof)).withColumn("significant", F.col("p_value") < 0.05)


def spectrum(df: DataFrame, series: str, order: str, method: str = "stft", fs: float = 1.0) -> DataFrame:
    """Time-frequency power of each series: ``stft`` with a Hann window, ``wavelet``
    (Morlet) or ``hht`` (empirical modes). Long rows: series, frequency, time, power."""
    from . import spectra

    return spectra.analyse(df, series, order, [method], fs=fs).drop("method")


def modes(x, most: int = 10, sifts: int = 100):
    """Empirical modes: what stays after subtracting the mean of both envelopes."""
    import numpy as np

    out, rest, at = [], x.astype(float), np.arange(len(x))
    for _ in range(most):
        h = rest.copy()
        for _ in range(sifts):
            d = np.sign(np.diff(h))
            top, low = np.flatnonzero((d[:-1] > 0) & (d[1:] < 0)) + 1, np.flatnonzero((d[:-1] < 0) & (d[1:] > 0)) + 1
            if len(top) < 2 or len(low) < 2:
                break
            mean = (np.interp(at, top, h[top]) + np.interp(at, low, h[low])) / 2
            h = h - mean
            if (mean**2).sum() < 1e-6 * (h**2).sum():
                break
        out.append(h)
        rest = rest - h
        if rest.std() < 1e-10 * max(x.std(), 1e-300) or len(np.flatnonzero(np.diff(np.sign(np.diff(rest))))) < 2:
            break
    return out, rest


def hilbert_huang(x, fs, bins: int = 100):
    import numpy as np

    n = len(x)
    if n < 8:
        return np.zeros(0), np.zeros(0), np.zeros((0, 0))
    power = np.zeros((bins, n))
    keep = np.zeros(n)
    keep[0], keep[1 : (n + 1) // 2] = 1, 2
    if n % 2 == 0:
        keep[n // 2] = 1
    for mode in modes(x)[0]:
        z = np.fft.ifft(np.fft.fft(mode) * keep)
        f = np.gradient(np.unwrap(np.angle(z))) * fs / (2 * np.pi)
        k = np.clip((f / (fs / 2) * bins).astype(int), 0, bins - 1)
        np.add.at(power, (k, np.arange(n)), np.abs(z) ** 2)
    return (np.arange(bins) + 0.5) * fs / 2 / bins, np.arange(n) / fs, power


def combined_similarity(d1: Column, d2: Column, v1: Column, v2: Column, m1: Column, m2: Column) -> dict[str, Column]:
    """score (six parts in ten by time, four by space), temporal, spatial, and the
    absolute differences of the variables that both have."""
    t, s = temporal_similarity(d1, d2, v1, v2), spatial_similarity(m1, m2)
    common = F.array_sort(F.array_intersect(F.map_keys(m1), F.map_keys(m2)))
    matched = F.map_from_arrays(common, F.transform(common, lambda k: F.abs(m1[k] - m2[k])))
    return {"score": 0.6 * t + 0.4 * s, "temporal": t, "spatial": s, "matched_variables": matched}


def event_database(df: DataFrame, event: list[str], variable: str = "variable") -> DataFrame:
    """A row for each event: the fingerprint of all its values, and its means by variable."""
    means = df.groupBy(*event, variable).agg(F.avg(finite(F.col("value"))).alias("_m"))
    means = means.groupBy(*event).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(variable, "_m")))).alias("means"))
    return fingerprint(df, event).join(means, event)
