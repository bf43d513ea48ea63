"""Queries over the event log and the star schema: windows, sessions, latest states, aggregates, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoweave.runtime import Rounds
from chronoweave.sources.tables import COLUMNS, table
from chronoweave.streaming.incremental import PartedState, run_into_parts, upsert_latest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def money(c):
    return F.sum(c.cast("decimal(18,4)")).cast("decimal(28,4)")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events GROUP BY 1, 2")
def tumbling_hours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "ts", "value").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), money(F.col("value")).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM k GROUP BY user_id, n""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "user_id", "event_type", "event_id", "ts").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def streamed_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest event per user and type, kept as parted state by a stream over the file."""
    schema = StructType.fromDDL("user_id long, event_type string, ts timestamp_ntz, event_id long")
    base = Rounds(spark, "streamed").base
    state = PartedState(spark, f"{base}/state", schema, ["user_id", "event_type"], parts=8)
    stream = spark.readStream.schema(COLUMNS["events"]).parquet(f"{d}/event[s].parquet").select(*schema.names)  # a stream takes folders and patterns, no single file
    run_into_parts(stream, state, lambda old, batch: upsert_latest(old, batch, ["user_id", "event_type"], ["ts", "event_id"]), f"{base}/checkpoint").awaitTermination()
    return state.read()


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_type", "props").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS price, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate").where(F.col("l_shipdate") <= F.lit("1998-09-02 00:00:00").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(money(F.col("l_quantity")).alias("quantity"), money(F.col("l_extendedprice")).alias("price"), F.count("*").alias("n"))


@query("""SELECT n_name, count(DISTINCT o_orderkey) AS orders, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice").groupBy("l_orderkey").agg(money(F.col("l_extendedprice")).alias("p"))
    # items come as one row per order, so the joined rows are the orders
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    nation = F.broadcast(table(spark, d, "nation", "n_nationkey", "n_name"))  # 25 rows
    customers = table(spark, d, "customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.sum("p").cast("decimal(28,4)").alias("revenue"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey").join(table(spark, d, "lineitem", F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders""")
def order_versions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS dearest, count(*) AS parts FROM part GROUP BY 1")
def dearest_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", "p_brand", "p_partkey", "p_retailprice").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.count("*").alias("parts"))
