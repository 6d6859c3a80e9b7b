"""Causality between series: transfer entropy and Granger's test.

No series is a group: rows get their place in it by a prefix scan, stretches of
consecutive rows are dealt out with the last rows of the stretch before, and each
gives sums that add up over the series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import finite, safe_ratio
from ..functions.special import f_tail
from . import scan

#: Rows of a stretch.
WIDTH = 4096
#: An exact fit counts as an error of this share of the effect's squares.
EXACT = 1e-13


def stretches(df: DataFrame, by: list[str], order: list[str], reach: int, width: int = WIDTH) -> DataFrame:
    """The rows with their place ``_at`` in their series (from 1), dealt to
    ``_stretch``; the last ``reach`` rows before a stretch are lent to it
    (``_own`` false). Rows of one order have places in any order."""
    placed = scan.scan(scan.chunked(df, by, order), by, order, {"_at": scan.total(F.lit(1))}).drop(scan.CHUNK)
    return scan.neighbours(placed, by, F.col("_at"), reach, width)


def lagged(df: DataFrame, by: list[str], order: list[str], lags: dict[str, tuple[str, int]], width: int = WIDTH) -> DataFrame:
    """The rows with ``_at`` and, for each name, a column's value so many rows
    earlier; null at the start of a series."""
    w = W.partitionBy(*by, "_stretch").orderBy("_at")
    parts = stretches(df, by, order, max(k for _, k in lags.values()), width)
    return parts.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in lags.items()}).where("_own").drop("_stretch", "_own")


def _known(df: DataFrame, cause: str, effect: str) -> DataFrame:
    return df.where(finite(F.col(cause)).isNotNull() & finite(F.col(effect)).isNotNull())


def transfer_entropy(df: DataFrame, cause: str, effect: str, order: list[str], by: list[str] = [], bins: int = 10) -> DataFrame:  # noqa: B006
    """Bits that the cause's past adds to the effect's future, from counts of
    equal-width bins at lag 1. Rows that lack either value take no part."""
    df = _known(df, cause, effect)
    ends = df.groupBy(*by).agg(*(f(c).alias(f"_{n}_{c}") for c in (cause, effect) for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))  # one row
    place = lambda c: F.coalesce(F.floor(safe_ratio(F.col(c) - F.col(f"_lo_{c}"), (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / bins)), F.lit(0)).cast("int")
    out = out.select(*by, *order, place(cause).alias("x"), place(effect).alias("yf"))
    out = lagged(out, by, order, {"xp": ("x", 1), "yp": ("yf", 1)}).where("_at > 1")
    k = out.groupBy(*by, "yf", "yp", "xp").agg(F.count(F.lit(1)).cast("double").alias("k"))
    total = lambda *c: F.sum("k").over(W.partitionBy(*by, *c))
    k = k.withColumns({"n": total(), "kp": total("yp", "xp"), "kq": total("yf", "yp"), "ky": total("yp")})
    bits = F.col("k") / F.col("n") * F.log2((F.col("k") / F.col("kp")) / (F.col("kq") / F.col("ky")))
    return k.groupBy(*by).agg(F.sum(bits).alias("transfer_entropy"))


def granger_lag1(df: DataFrame, cause: str, effect: str, order: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """F statistic of the cause's last value in predicting the effect from its
    own last value (no intercept), from sums in closed form."""
    s = _known(df, cause, effect).select(*by, *order, F.col(effect).alias("y"), F.col(cause).alias("x"))
    s = lagged(s, by, order, {"a": ("y", 1), "b": ("x", 1)}).where("_at > 1")
    pair = {"yy": ("y", "y"), "aa": ("a", "a"), "bb": ("b", "b"), "ab": ("a", "b"), "ay": ("a", "y"), "by": ("b", "y")}
    out = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(p) * F.col(q)).alias(k) for k, (p, q) in pair.items()))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    u = (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det
    v = (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det
    full = F.col("yy") - u * F.col("ay") - v * F.col("by")
    own = F.col("yy") - F.col("ay") * F.col("ay") / F.col("aa")
    return out.where(det > 0).select(*by, "n", (F.greatest(own - full, F.lit(0.0)) / (full / (F.col("n") - 2))).alias("f_statistic"))


def _normal_sums(df: DataFrame, pair: list[str], order: str, max_lag: int, width: int) -> DataFrame:
    """For each pair and lag, the sums of products of both series' values up to
    the lag: pair, lag, n (rows with so many before them), sums (a square matrix
    by rows: effect at lags 0 to ``lag``, cause at lags 0 to ``lag``). Lag 0 has
    no sums: it stands for a pair of any length."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        x, y = pdf["cause"].to_numpy(float), pdf["effect"].to_numpy(float)
        own, at = pdf["_own"].to_numpy(bool), pdf["_at"].to_numpy()
        key, found = [pdf[c].iloc[0] for c in pair], []
        for lag in range(max_lag + 1):
            rows = np.flatnonzero(own & (at > lag))
            z = np.stack([s[rows - i] for s in (y, x) for i in range(lag + 1)])
            found.append([*key, lag, len(rows), (z @ z.T).ravel() if lag else np.zeros(1)])
        return pd.DataFrame(found, columns=[*pair, "lag", "n", "sums"])

    series = _known(df.withColumns({c: F.col(c).cast("double") for c in ("cause", "effect")}), "cause", "effect")
    parts = stretches(series.select(*pair, order, "cause", "effect"), pair, [order], max_lag, width)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*pair).schema)
    sums = parts.groupBy(*pair, "_stretch").applyInPandas(one, f"{kinds}, lag int, n long, sums array<double>")
    sums = sums.select(*pair, "lag", "n", F.posexplode("sums").alias("k", "s"))
    sums = sums.groupBy(*pair, "lag", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    entries = F.sort_array(F.collect_list(F.struct("k", "s")))  # (2 lag + 2)^2 of them
    return sums.groupBy(*pair, "lag").agg(F.max("n").alias("n"), F.transform(entries, lambda e: e["s"]).alias("sums"))


def _rest(g: np.ndarray, target: int, known: list[int]) -> float:
    """The share of the target's squares that the known columns leave."""
    b = g[known, target]
    fit = np.linalg.lstsq(g[np.ix_(known, known)], b, rcond=1e-13)[0]
    return max(1.0 - float(fit @ b), EXACT)


def f_statistic(sums: np.ndarray, lag: int, n: int, swapped: bool = False) -> float:
    """From the normal equations: what the other series' lags add to the own ones.
    0 where nothing is left to explain, or no degree of freedom."""
    g = np.asarray(sums, float).reshape(2 * lag + 2, -1)
    first, second = list(range(lag + 1)), list(range(lag + 1, 2 * lag + 2))
    own, other = (second, first) if swapped else (first, second)
    size = np.sqrt(np.diag(g))
    if n <= 2 * lag or size[own[0]] == 0:
        return 0.0
    g = g / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1))
    before, after = _rest(g, own[0], own[1:]), _rest(g, own[0], own[1:] + other[1:])
    return max(before - after, 0.0) / lag / (after / (n - 2 * lag))


def granger_table(df: DataFrame, pair: list[str], order: str, max_lag: int = 5, both: bool = False, width: int = WIDTH) -> DataFrame:
    """Granger's test for every lag: pair, lag, n, f_statistic, p_value. ``df`` has
    columns cause and effect; ``both`` adds the opposite direction, its pair's two
    names swapped, from the same sums. No intercept; a lag is left out where the
    series has fewer than 2 lag + 5 rows; lag 0 (p value 1) is there for each pair.
    Rows that lack either value take no part."""
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*pair).schema}
    sums = _normal_sums(df, pair, order, max_lag, width)

    def solve(batches):
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                *key, lag, n, entries = row
                if n + lag < 2 * lag + 5 and lag:
                    continue
                for swapped in (False, True) if both else (False,):
                    f = f_statistic(entries, lag, n, swapped) if lag else 0.0
                    found.append([*(key[::-1] if swapped else key), lag, n, f, f_tail(f, lag, n - 2 * lag) if f > 0 else 1.0])
            yield pd.DataFrame(found, columns=[*pair, "lag", "n", "f_statistic", "p_value"])

    return sums.mapInPandas(solve, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", lag int, n long, f_statistic double, p_value double")


def _least(table: DataFrame, pair: list[str]) -> DataFrame:
    best = table.groupBy(*pair).agg(F.min_by(F.struct("f_statistic", "p_value", "lag"), F.struct("p_value", "lag")).alias("_best"))
    return best.select(*pair, "_best.*").withColumn("significant", F.col("p_value") < 0.05)


def granger(df: DataFrame, pair: list[str], order: str, max_lag: int = 5, both: bool = False) -> DataFrame:
    """The lag of the least p value (the smallest of equal ones) for each pair's
    series (cause, effect): f_statistic, p_value, lag, significant. A pair without
    a lag to test has lag 0 and p value 1."""
    return _least(granger_table(df, pair, order, max_lag, both), pair)


def paired(series: DataFrame, order: str, name: str = "variable", value: str = "value") -> DataFrame:
    """Each two variables once (the smaller name as cause), joined on the order."""
    side = lambda n: series.select(F.col(name).alias(f"{n}_name"), order, F.col(value).alias(n))
    return side("cause").join(side("effect"), order).where("cause_name < effect_name")


def all_pairs(series: DataFrame, order: str, max_lag: int = 5) -> DataFrame:
    """Granger's test for all ordered pairs of variables (variable, order, value)."""
    return granger(paired(series, order), ["cause_name", "effect_name"], order, max_lag, both=True)


def causal_pairs(series: DataFrame, order: str, max_lag: int = 5) -> DataFrame:
    """The significant ones of ``all_pairs``."""
    return all_pairs(series, order, max_lag).where("significant")
