"""Queries of files and result files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import netcdf_source, readers, sinks
from . import virtual as v
from .catalog import query
from .scratch import scratch_path


def _satellite(spark, d) -> str:
    """Files of five swaths: two variables over time, lat and lon, begun a day apart."""
    swath = F.col("lon_idx") % 5
    cells = v.cells(spark, d, member=True).select(
        F.concat(F.lit("swath"), swath).alias("swath"), "variable", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("member"))).alias("time"),
        F.col("lat_idx").cast("double").alias("lat"), F.col("lon_idx").cast("double").alias("lon"), "value", F.concat(F.lit("2024-01-0"), swath + 1, F.lit("T00:00:00Z")).alias("time_coverage_start"),
    )
    other = cells.withColumns({"variable": F.lit("half"), "value": F.col("value") / 2})
    path = scratch_path(spark, "satellite")
    sinks.write_fields(cells.unionByName(other), path, "swath")
    return path


@query(f"WITH {v.ENS} SELECT lon_idx % 5 AS swath, 'price' AS variable, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * member AS time, CAST(lat_idx AS DOUBLE) AS lat, CAST(lon_idx AS DOUBLE) AS lon, value FROM ens WHERE lon_idx % 5 >= 2 AND member <= 4")
def satellite_scan(spark, d) -> DataFrame:
    cells = readers.read_cells(spark, _satellite(spark, d), "netcdf", retentionDays=30, asOf="2024-02-02")
    some = cells.where(F.col("variable") == "price").where("value IS NOT NULL AND time <= TIMESTAMP_NTZ '2024-01-01 04:00:00'")
    swath = F.regexp_extract("file", r"swath(\d)/", 1).cast("int")
    return some.select(swath.alias("swath"), "variable", "time", "lat", "lon", "value")


@query(f"WITH {v.ENS} SELECT lon_idx % 5 AS swath, CASE WHEN lon_idx % 5 < 2 THEN 'expired' ELSE 'read' END AS status, count(DISTINCT member) AS records, 'half,price' AS variables, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (lon_idx % 5) AS coverage_start FROM ens GROUP BY lon_idx % 5")
def satellite_files(spark, d) -> DataFrame:
    path = _satellite(spark, d)
    netcdf_source.register(spark)
    listed = spark.read.format("netcdf").options(layout="files", retentionDays=30, asOf="2024-02-02").load(path)
    return listed.select(F.regexp_extract("file", r"swath(\d)/", 1).cast("int").alias("swath"), "status", "records", F.concat_ws(",", "variables").alias("variables"), "coverage_start")


@query("SELECT user_id AS station, event_type AS variable, ts AS time, value AS lat, value / 2 AS lon FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY")
def satellite_memory(spark, d) -> DataFrame:
    """A dataset that is there already, under other coordinate names."""
    e = v.table(spark, d, "events").select(F.col("user_id").alias("station"), F.col("event_type").alias("variable"), F.col("ts").alias("timestamp"), F.col("value").alias("latitude"), (F.col("value") / 2).alias("x"))
    return readers.retained(readers.normalised(e), 10, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("station", "variable", "time", "lat", "lon")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority AS tenant_id, 'simulation_1996' AS run FROM orders WHERE year(o_orderdate) = 1996")
def results_by_tenant(spark, d) -> DataFrame:
    """Results of two runs by tenant, one of them read back from its files."""
    orders = v.table(spark, d, "orders").withColumn("tenant_id", F.col("o_orderpriority"))
    path = scratch_path(spark, "results")
    for year in (1995, 1996):
        sinks.write_results(orders.where(F.year("o_orderdate") == year), path, run=str(year), rows=1 << 17)
    runs = [sinks.read_results(spark, path, run) for run in ("1995", "1996")]
    back = runs[1].join(runs[0].select("o_orderkey"), "o_orderkey", "left_anti")  # the runs have no row in common
    return back.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "tenant_id", F.lit("simulation_1996").alias("run"))


@query("SELECT o_orderpriority AS tenant_id, count(*) AS n FROM orders GROUP BY 1")
def result_listing(spark, d) -> DataFrame:
    orders = v.table(spark, d, "orders").select(F.col("o_orderpriority").alias("tenant_id"), "o_orderkey", "o_totalprice")
    path = scratch_path(spark, "results")
    sinks.write_results(orders, path, run="all", rows=1 << 17)
    return sinks.runs(spark, path).groupBy(F.col("by").alias("tenant_id")).agg(F.sum("rows").alias("n"))
