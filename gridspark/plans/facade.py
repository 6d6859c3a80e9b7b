"""The platform's questions, one function each, answered by DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fingerprint, quality, statistics


def validate(cells: DataFrame, keys: list[str], checks: list[quality.Check], least: float = 0.95) -> DataFrame:
    """Pass rate of a dataset over all its checks, and by variable."""
    flags = quality.run_checks(cells, keys, checks)
    out = flags.rollup("variable").agg(F.count(F.lit(1)).alias("points"), F.count_if("failed").alias("n_failed"))
    rate = 1 - F.col("n_failed") / F.col("points")
    return out.withColumns({"pass_rate": rate, "passed": rate >= least})


def history(records: DataFrame, source: str | None = None, variable: str | None = None, passed: bool | None = None, since: Column | None = None, until: Column | None = None, limit: int = 100) -> DataFrame:
    """Validation records (data_source, variables, passed, ts) that meet every
    condition given, the latest first."""
    for given, test in ((source, F.col("data_source") == source), (variable, F.array_contains("variables", variable) if variable else None), (passed, F.col("passed") == passed)):
        if given is not None:
            records = records.where(test)
    records = records.where(F.col("ts") >= since) if since is not None else records
    records = records.where(F.col("ts") <= until) if until is not None else records
    return records.orderBy(F.desc("ts")).limit(limit)


def latest(records: DataFrame, limit: int, order: str = "ts", **equal: str) -> DataFrame:
    """The last records in their order, as executions, summaries or events are listed."""
    for k, v in equal.items():
        records = records.where(F.col(k) == v)
    return records.orderBy(F.desc(order)).limit(limit).orderBy(order)


def search(events: DataFrame, query: DataFrame, top: int = 20) -> DataFrame:
    """Events whose fingerprints are most like the query's."""
    return fingerprint.most_similar(events, query, top)


def report(cells: DataFrame, by: list[str]) -> DataFrame:
    return statistics.describe(cells, by)


def completion(results: DataFrame, by: str = "execution_id") -> DataFrame:
    done = F.avg(F.when(F.col("status") == "completed", 100.0).otherwise(0.0))
    return results.groupBy(by).agg(done.alias("percent"), F.bool_and(F.col("status") == "completed").alias("valid"))


def status(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each of the platform's tables."""
    return {name: df.count() for name, df in tables.items()}
