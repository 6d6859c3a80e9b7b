"""The test tables seen as the engine's kinds of data, as plans and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rounded(c, n: int):
    """Rounded with halves up, a hair above: both engines then agree on them."""
    return F.round(c + 10.0 ** -(n + 3), n)


def as_oracle(sql: str) -> str:
    """The SQL with every round() a hair above like ``rounded``, and counts as BIGINT."""
    return _calls(_calls(sql, "round", lambda a: "round(({}) + 1e-{}, {})".format(a.rpartition(",")[0], int(a.rpartition(",")[2]) + 3, a.rpartition(",")[2].strip())), "count_if", lambda a: f"CAST(count_if({a}) AS BIGINT)")


def _calls(sql: str, name: str, change) -> str:
    out, at = [], 0
    while (start := sql.find(f"{name}(", at)) >= 0:
        end, depth = start + len(name) + 1, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:start], change(_calls(sql[start + len(name) + 1 : end - 1], name, change))]
        at = end
    return "".join(out) + sql[at:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark, d) -> DataFrame:
    """Station series: station, variable, ts, id, value."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("station"), F.col("event_type").alias("variable"), "ts", "value")


def cells(spark, d, member: bool = False) -> DataFrame:
    """A field over part size and supplier nation, of members by line number."""
    keys = [F.col("p_size").alias("lat_idx"), F.col("s_nationkey").alias("lon_idx")] + ([F.col("l_linenumber").alias("member")] if member else [])
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    part, supplier = table(spark, d, "part").select("p_partkey", "p_size"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    both = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    return both.groupBy(*keys).agg(rounded(F.avg("l_extendedprice"), 4).alias("value")).withColumn("variable", F.lit("price"))


def daily(spark, d) -> DataFrame:
    """Daily order totals of each status, with the day's number."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01"))
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("variable"), day.alias("t")).agg(rounded(F.sum("o_totalprice"), 2).alias("value"))


def places(spark, d) -> DataFrame:
    """Nations as points on the globe."""
    return table(spark, d, "nation").select("n_nationkey", (F.lit(-60.0) + 5 * F.col("n_nationkey")).alias("lat"), (15.0 * F.col("n_nationkey")).alias("lon"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("vector"), "label")


OBS = "obs AS (SELECT event_id AS id, user_id AS station, event_type AS variable, ts, value FROM events)"
_JOINED = "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
GRID = f"grid AS (SELECT p_size AS lat_idx, s_nationkey AS lon_idx, round(avg(l_extendedprice), 4) AS value {_JOINED} GROUP BY 1, 2)"
ENS = f"ens AS (SELECT p_size AS lat_idx, s_nationkey AS lon_idx, l_linenumber AS member, round(avg(l_extendedprice), 4) AS value {_JOINED} GROUP BY 1, 2, 3)"
DAILY = "daily AS (SELECT o_orderstatus AS variable, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS t, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"
GEO = "geo AS (SELECT n_nationkey, -60.0 + 5 * CAST(n_nationkey AS DOUBLE) AS lat, 15.0 * CAST(n_nationkey AS DOUBLE) AS lon FROM nation)"
