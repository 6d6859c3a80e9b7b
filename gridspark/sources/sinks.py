"""Sinks: results by tenant, reports, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .netcdf_source import ROWS_PER_FILE, register


def write_results(df: DataFrame, path: str, tenant: str = "tenant_id", run: str | None = None, mode: str = "append", rows: int = ROWS_PER_FILE) -> None:
    """Parquet by tenant; with ``run`` a NetCDF file for each tenant and run, in
    parts of about ``rows`` rows where a tenant has more: such tenants, of which
    there is one for ``rows`` rows of the table at most, are dealt to several tasks."""
    if run is None:
        df.write.partitionBy(tenant).mode(mode).parquet(path)
        return
    register(df.sparkSession)
    large = df.groupBy(F.col(tenant).alias("_t")).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts")).where("_parts > 1")
    dealt = df.join(F.broadcast(large), df[tenant].eqNullSafe(F.col("_t")), "left")
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.coalesce("_parts", F.lit(1))))
    dealt = dealt.repartition(tenant, "_part").sortWithinPartitions(tenant, "_part").select(*df.columns)
    dealt.write.format("netcdf").options(by=tenant, run=run, rowsPerFile=rows + rows // 4).mode(mode).save(path)


def runs(spark, path: str) -> DataFrame:
    """What the runs below ``path`` have written: run, file, by (the tenant), rows."""
    listed = spark.read.schema("run string, files array<struct<file: string, by: string, rows: long>>").json(f"{path}/_runs/*.json")
    return listed.select("run", F.explode("files").alias("f")).select("run", "f.*")


def read_results(spark, path: str, run: str, schema: str | None = None) -> DataFrame:
    """The rows of one run, from the files whose names are the run's."""
    register(spark)
    reader = spark.read.format("netcdf").options(layout="table", run=run)
    return (reader.schema(schema) if schema else reader).load(path)


def write_fields(df: DataFrame, path: str, by: str, run: str = "run", mode: str = "append") -> None:
    """Cells (variable, value, any of time, level, lat, lon, and time_coverage_start
    for the file's attribute) as a gridded NetCDF file for each value of ``by``. A
    file is put together in one task."""
    register(df.sparkSession)
    df.repartition(by).sortWithinPartitions(by).write.format("netcdf").options(by=by, run=run, layout="grid").mode(mode).save(path)


def report_rows(stats: DataFrame, by: str = "variable", names=("mean", "std", "min", "max")) -> DataFrame:
    """variable, statistic, value."""
    return stats.select(F.col(by).alias("variable"), *names).unpivot(["variable"], list(names), "statistic", "value")


def write_report(stats: DataFrame, path: str, kind: str = "csv", by: str = "variable") -> None:
    writer = report_rows(stats, by).write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def provenance_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A line of JSON for each node and edge."""
    a = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("line"))
    return a.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), *edges.columns)).alias("line")))


def field_payload(df: DataFrame, by: list[str], levels: int = 10) -> DataFrame:
    """Of each field its ends, mean, deviation and contour levels, as JSON: what a
    renderer needs, worked out for each field anew."""
    s = df.groupBy(*by).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    step = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.col("min") + (F.col("max") - F.col("min")) * i / (levels - 1))
    return s.select(*by, F.to_json(F.struct("min", "max", "mean", "std", step.alias("levels"))).alias("payload"))


def frames(df: DataFrame, time: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """A frame's summary for each time, in order of time."""
    return df.groupBy(*by, time).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")).orderBy(*by, time)


def encoded(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.base64(F.col(c)))


def provenance_load(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """What ``provenance_json`` wrote, with times parsed; lines that are no JSON are left out."""
    parsed = lines.select(F.from_json(line, schema).alias("_p")).where("_p IS NOT NULL AND _p.kind IS NOT NULL").select("_p.*")
    for c in ("timestamp", "created_at"):
        if c in parsed.columns:
            parsed = parsed.withColumn(c, F.try_to_timestamp(c))
    return parsed


def storage_used_tb(spark, path: str) -> DataFrame:
    """Bytes of all files below a folder, in TB: one number, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / float(1 << 40)).alias("storage_tb"))


def last_slice(df: DataFrame, time: str | None = "time_idx", level: str | None = "lev_idx", level_idx: int = 0) -> DataFrame:
    """The field of the last time at one level: a number is looked up, then it is a filter."""
    if time and time in df.columns:
        last = df.agg(F.max(time).alias("_t"))
        df = df.join(F.broadcast(last), df[time] == last["_t"]).drop("_t")  # one row
    return df.where(F.col(level) == level_idx) if level and level in df.columns else df


def wind_payload(df: DataFrame, by: list[str], u: str = "u_wind", v: str = "v_wind") -> DataFrame:
    """Of each wind field the number of points, the mean and largest speed and the mean direction."""
    speed = F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))
    s = df.groupBy(*by).agg(F.count(speed).alias("points"), F.avg(speed).alias("mean_speed"), F.max(speed).alias("max_speed"), F.avg(u).alias("_u"), F.avg(v).alias("_v"))
    return s.withColumn("direction", F.degrees(F.atan2("_v", "_u"))).drop("_u", "_v")


def contours(df: DataFrame, by: list[str], levels: int = 10) -> DataFrame:
    """A row for each contour level of each field, evenly from its least to its largest value."""
    s = df.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    out = s.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return out.select(*by, "level", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("level") / (levels - 1)).alias("at"))


def render_all(df: DataFrame, variables: list[str] | None = None, most: int = 3) -> DataFrame:
    """Payloads of the first variables by name, or of the given ones."""
    names = variables or [r.variable for r in df.select("variable").distinct().orderBy("variable").limit(most).collect()]
    return field_payload(df.where(F.col("variable").isin(names[:most])), ["variable"])


def frame_variables(df: DataFrame) -> DataFrame:
    """The variables that any frame shows."""
    return df.agg(F.array_sort(F.collect_set("variable")).alias("variables"))
