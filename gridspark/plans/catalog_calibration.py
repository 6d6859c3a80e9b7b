"""Queries of calibration, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, statistics
from . import virtual as v
from .catalog import _BOTH, _CELLKEY, query, r

ABOVE = 38000.0
_PAIRS = f"{_BOTH}, pairs AS (SELECT lat_idx, lon_idx, probability, CASE WHEN value > {ABOVE} THEN 1.0 ELSE 0.0 END AS y FROM (SELECT lat_idx, lon_idx, CAST(avg(CASE WHEN value > {ABOVE} THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS probability FROM ens GROUP BY 1, 2) JOIN grid USING (lat_idx, lon_idx))"
# The fit at each probability: of all blocks up to it the largest of the smallest means.
_FIT = """c AS (SELECT probability AS p, count(*) AS n, CAST(sum(y) AS DOUBLE) AS s FROM pairs GROUP BY 1), k AS (SELECT p, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER w - n AS n0, sum(s) OVER w - s AS s0 FROM c WINDOW w AS (ORDER BY p)),
  i AS (SELECT p, max(m) AS fit FROM (SELECT i.p, a.p AS first, min((b.s1 - a.s0) / (b.n1 - a.n0)) AS m FROM k i JOIN k a ON a.p <= i.p JOIN k b ON b.p >= i.p GROUP BY 1, 2) GROUP BY 1)"""


def _pairs(spark, d) -> DataFrame:
    """Each cell's share of members above, and whether the field is."""
    p = statistics.probability(v.cells(spark, d, True), _CELLKEY, above=ABOVE)
    y = F.when(F.col("value") > ABOVE, 1.0).otherwise(0.0).alias("y")
    return p.join(v.cells(spark, d), _CELLKEY).select(*_CELLKEY, "probability", y)


@query(f"WITH {_PAIRS}, {_FIT} SELECT lat_idx, lon_idx, round(probability, 6) AS probability, round(fit, 6) AS calibrated, 'isotonic' AS calibration_method FROM pairs JOIN i ON probability = p")
def calibrated_isotonic(spark, d) -> DataFrame:
    pairs = _pairs(spark, d)
    out = calibration.calibrate(pairs.drop("y"), pairs.select("probability", "y"), "isotonic")
    return out.select(*_CELLKEY, r("probability").alias("probability"), r("calibrated").alias("calibrated"), "calibration_method")


@query(f"WITH {_PAIRS}, {_FIT} SELECT round(fit, 6) AS mean, round(min(p), 6) AS lo, round(max(p), 6) AS hi, CAST(sum(n) AS BIGINT) AS n FROM i JOIN c USING (p) GROUP BY 1")
def isotonic_levels(spark, d) -> DataFrame:
    return calibration.isotonic_blocks(_pairs(spark, d)).select(r("mean").alias("mean"), r("lo").alias("lo"), r("hi").alias("hi"), "n")


_BINS = "bins AS (SELECT least(CAST(floor(probability * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(probability) AS forecast, avg(y) AS observed FROM pairs GROUP BY 1)"


@query(f"WITH {_PAIRS}, {_BINS} SELECT bin, n, round(forecast, 6) AS forecast, round(observed, 6) AS observed FROM bins")
def reliability_bins(spark, d) -> DataFrame:
    return calibration.reliability_bins(_pairs(spark, d)).select("bin", "n", r("forecast").alias("forecast"), r("observed").alias("observed"))


@query(f"WITH {_PAIRS}, {_BINS}, t AS (SELECT avg(y) AS rate FROM pairs) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * pow(forecast - observed, 2)) / sum(n), 6) AS reliability, round(sum(n * pow(observed - rate, 2)) / sum(n), 6) AS resolution, round(any_value(rate * (1 - rate)), 6) AS uncertainty FROM bins, t")
def reliability_parts(spark, d) -> DataFrame:
    parts = calibration.reliability_parts(calibration.reliability_bins(_pairs(spark, d)))
    return parts.select("n", *(r(c).alias(c) for c in ("reliability", "resolution", "uncertainty")))


@query(f"WITH {_PAIRS}, {_BINS} SELECT lat_idx, lon_idx, round(observed, 6) AS calibrated, 'reliability' AS calibration_method FROM pairs JOIN bins ON bin = least(CAST(floor(probability * 10) AS INTEGER), 9)")
def calibrated_reliability(spark, d) -> DataFrame:
    pairs = _pairs(spark, d)
    out = calibration.calibrate(pairs.drop("y"), pairs.select("probability", "y"), "reliability")
    return out.select(*_CELLKEY, r("calibrated").alias("calibrated"), "calibration_method")
