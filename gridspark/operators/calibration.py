"""Calibration of forecasts by what was observed.

The monotone fit pools adjacent violators. Pooling may go in any order, so the
blocks of a stretch of probabilities can be pooled on their own, and stretches of
pooled blocks again with other borders, until no round pools anything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..plans.scratch import materialise
from . import scan, statistics

#: Blocks that are pooled in one task.
WIDTH = 100_000


def pool(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, total: np.ndarray) -> list[tuple[float, float, int, float]]:
    """Blocks (lowest and highest probability, weight, sum) in their order, pooled
    until their means rise strictly."""
    done: list[tuple[float, float, int, float]] = []
    for block in zip(lo.tolist(), hi.tolist(), n.tolist(), total.tolist()):
        while done and done[-1][3] * block[2] >= block[3] * done[-1][2]:
            a = done.pop()
            block = (a[0], block[1], a[2] + block[2], a[3] + block[3])
        done.append(block)
    return done


def isotonic_blocks(pairs: DataFrame, by: list[str] = [], p: str = "probability", y: str = "y", width: int = WIDTH) -> DataFrame:  # noqa: B006
    """The monotone least-squares fit of ``y`` to ``p`` for each group: one row for
    each level, with the probabilities from ``lo`` to ``hi``, ``n`` rows and their
    ``mean``. Equal probabilities are one block from the start. Rows that lack
    either value take no part; without rows there are no blocks. A task pools
    ``width`` blocks at most."""
    known = pairs.select(*by, finite(F.col(p).cast("double")).alias("lo"), finite(F.col(y).cast("double")).alias("y")).where("lo IS NOT NULL AND y IS NOT NULL")
    blocks = known.groupBy(*by, "lo").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")).select(*by, "lo", F.col("lo").alias("hi"), "n", "total")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        out = pd.DataFrame(pool(*(pdf[c].to_numpy() for c in ("lo", "hi", "n", "total"))), columns=["lo", "hi", "n", "total"])
        for c in by:
            out[c] = pdf[c].iloc[0] if len(pdf) else None
        return out[list(kinds)]

    still, shift, before = 0, 0, None
    while still < 2:
        placed = scan.scan(scan.chunked(blocks, by, ["lo"]), by, ["lo"], {"_at": scan.total(F.lit(1))}).drop(scan.CHUNK)
        placed = placed.withColumn("_stretch", F.floor((F.col("_at") - 1 + shift) / width))
        blocks = materialise(placed.groupBy(*by, "_stretch").applyInPandas(one, ", ".join(f"`{c}` {t}" for c, t in kinds.items())), "blocks")
        longest = placed.agg(F.max("_at")).first()[0] or 0
        if shift == 0 and longest <= width:
            break  # no group had a border
        # What neither these borders nor those half a stretch away let pool is the fit.
        size = blocks.count()
        still, shift, before = still + 1 if size == before else 0, width // 2 - shift, size
    return blocks.select(*by, "lo", "hi", "n", (F.col("total") / F.col("n")).alias("mean"))


def apply_isotonic(forecast: DataFrame, blocks: DataFrame, by: list[str] = [], p: str = "probability") -> DataFrame:  # noqa: B006
    """``calibrated``: the level of the block that holds the probability, between two
    blocks the straight line from the one's ``hi`` to the other's ``lo``, beyond all
    blocks the outermost level; null where the probability is missing, the
    probability itself where its group has no blocks."""
    x = finite(F.col(p).cast("double"))
    edges = blocks.select(*by, F.explode(F.array(F.struct(F.col("lo").alias("_x"), "mean"), F.struct(F.col("hi").alias("_x"), "mean"))).alias("_e"))
    edges = edges.select(*by, "_e._x", F.lit(0).alias("_kind"), F.col("_e.mean").alias("_level"))
    asked = forecast.select(*by, x.alias("_x")).where("_x IS NOT NULL").distinct().withColumns({"_kind": F.lit(1), "_level": F.lit(None).cast("double")})
    both = scan.chunked(edges.unionByName(asked), by, ["_x", "_kind"])
    at = F.when(F.col("_kind") == 0, F.struct("_x", "_level"))
    both = scan.scan(both, by, ["_x", "_kind"], {"_a": scan.last_known(at), "_b": scan.next_known(at)}).where("_kind = 1")
    a, b, v = F.col("_a"), F.col("_b"), F.col("_x")
    line = a["_level"] + (b["_level"] - a["_level"]) * (v - a["_x"]) / (b["_x"] - a["_x"])
    level = F.when(a["_x"] == v, a["_level"]).when(a.isNotNull() & b.isNotNull(), line).otherwise(F.coalesce(a["_level"], b["_level"], v))
    found = both.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_x", level.alias("calibrated"))
    on = x.eqNullSafe(found["_x"])
    for i, c in enumerate(by):
        on = on & forecast[c].eqNullSafe(found[f"_k{i}"])
    return forecast.join(found, on, "left").select(*forecast.columns, "calibrated")


def _bin(p: str, bins: int):
    x = finite(F.col(p).cast("double"))
    return F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def reliability_bins(pairs: DataFrame, bins: int = 10, by: list[str] = [], p: str = "probability", y: str = "y") -> DataFrame:  # noqa: B006
    """For each group and equal-width bin that holds something: ``bin``, ``n``, the
    mean ``forecast`` and the ``observed`` frequency. 1 belongs to the last bin."""
    known = pairs.select(*by, _bin(p, bins).alias("bin"), F.col(p).alias("p"), finite(F.col(y).cast("double")).alias("y")).where("bin IS NOT NULL AND y IS NOT NULL")
    return known.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("forecast"), F.avg("y").alias("observed"))


def reliability_parts(table: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``reliability``, ``resolution`` and ``uncertainty`` of a table of bins."""
    n, f, o = F.col("n"), F.col("forecast"), F.col("observed")
    s = table.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(n * o).alias("o"), F.sum(n * o * o).alias("oo"), F.sum(n * (f - o) * (f - o)).alias("d"))
    rate = F.col("o") / F.col("n")
    return s.where("n > 0").select(*by, "n", (F.col("d") / F.col("n")).alias("reliability"), (F.col("oo") / F.col("n") - rate * rate).alias("resolution"), (rate * (1 - rate)).alias("uncertainty"))


def apply_reliability(forecast: DataFrame, table: DataFrame, bins: int = 10, by: list[str] = [], p: str = "probability") -> DataFrame:  # noqa: B006
    """``calibrated``: the frequency observed in the probability's bin; the
    probability itself where nothing was."""
    found = table.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("bin").alias("_bin"), F.col("observed").alias("_o"))
    on = _bin(p, bins).eqNullSafe(found["_bin"])
    for i, c in enumerate(by):
        on = on & forecast[c].eqNullSafe(found[f"_k{i}"])
    return forecast.join(found, on, "left").select(*forecast.columns, F.coalesce("_o", finite(F.col(p).cast("double"))).alias("calibrated"))


def calibrate(forecast: DataFrame, observed: DataFrame | None, method: str = "bayesian", by: list[str] = [], bins: int = 10) -> DataFrame:  # noqa: B006
    """The forecast by the method named, which ``calibration_method`` tells.

    ``bayesian`` draws mean and std to the observations' (``value``); the others
    learn from ``observed`` (probability, y) and add ``calibrated``. Without
    observations the forecast is unchanged, whatever the method; an unknown method
    leaves it unchanged but for its name."""
    if observed is None:
        return forecast
    if method == "bayesian":
        out = statistics.bayesian_calibration(forecast, observed)
    elif method == "isotonic":
        out = apply_isotonic(forecast, isotonic_blocks(observed, by), by)
    elif method == "reliability":
        out = apply_reliability(forecast, reliability_bins(observed, bins, by), bins, by)
    else:
        out = forecast
    return out.withColumn("calibration_method", F.lit(method))
