"""Derived tables the queries run on, each in Spark and as a DuckDB common table expression."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import melt
from ..operators.order import hash_uniform
from ..operators.sampling import stratified_split
from ..session import materialize

FEATURES = ["n_orders", "gross", "qty", "avg_disc", "return_rate"]
COPY_OFFSET = 1_000_000_000
AS_OF_DATE = "2024-01-20"
AS_OF_YEAR = 2024

_stored: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Build a derived table once per application and reuse the written copy."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        _stored[key] = materialize(build(spark, sf), name)
    return _stored[key]


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def firm_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer with order-history ratios and a distress label."""
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(money("l_extendedprice")).alias("price"),
            F.sum(money("l_quantity")).alias("qty"),
            F.sum(money("l_discount")).alias("disc"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.count("*").alias("n"),
        )
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_customer = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        .groupBy("o_custkey")
        .agg(
            F.count("*").cast("double").alias("n_orders"),
            F.sum("price").cast("double").alias("gross"),
            F.sum("qty").cast("double").alias("qty"),
            (F.sum("disc").cast("double") / F.sum("n")).alias("avg_disc"),
            (F.sum("returned").cast("double") / F.sum("n")).alias("return_rate"),
        )
    )
    customer = table(spark, sf, "customer")
    return per_customer.join(customer, per_customer.o_custkey == customer.c_custkey).select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_mktsegment").alias("segment"),
        *FEATURES,
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("target"),
    )


FIRM = """firm AS (
  SELECT c.c_custkey AS entity_id, c.c_mktsegment AS segment,
    CAST(COUNT(DISTINCT o.o_orderkey) AS DOUBLE) AS n_orders,
    CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross,
    CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
    CAST(SUM(CAST(l.l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_disc,
    CAST(SUM(CASE WHEN l.l_returnflag='R' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS return_rate,
    CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS target
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY c.c_custkey, c.c_mktsegment, c.c_acctbal)"""


def firms(spark: SparkSession, sf: str) -> DataFrame:
    """firm_features with its stratified train / val / test column."""
    return stored(spark, sf, "firms", lambda s, d: stratified_split(firm_features(s, d), "target", "entity_id"))


FIRMS = (
    FIRM
    + """, firms AS (
  SELECT entity_id, segment, n_orders, gross, qty, avg_disc, return_rate, target,
    CASE WHEN rn <= floor(n * 0.15 + 0.5) THEN 'test'
         WHEN rn <= 2 * floor(n * 0.15 + 0.5) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY target) AS n,
          ROW_NUMBER() OVER (PARTITION BY target ORDER BY
            CAST('0x' || substr(md5('42:' || CAST(entity_id AS VARCHAR)), 1, 8) AS BIGINT), entity_id) AS rn
        FROM firm))"""
)


def gappy_firms(spark: SparkSession, sf: str) -> DataFrame:
    """firms with values knocked out by key, for the imputers."""
    k = F.col("entity_id")
    return (
        firms(spark, sf)
        .withColumn("gross", F.when(k % 7 != 0, F.col("gross")))
        .withColumn("avg_disc", F.when(k % 5 != 0, F.col("avg_disc")))
        .withColumn("segment", F.when(k % 11 != 0, F.col("segment")))
    )


GAPPY = (
    FIRMS
    + """, gappy AS (
  SELECT entity_id, CASE WHEN entity_id % 11 <> 0 THEN segment END AS segment, n_orders,
    CASE WHEN entity_id % 7 <> 0 THEN gross END AS gross, qty,
    CASE WHEN entity_id % 5 <> 0 THEN avg_disc END AS avg_disc, return_rate, target, split
  FROM firms)"""
)


def price_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily open/high/low/close/volume per event type."""
    order = F.struct("ts", "event_id")
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("entity_id"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count("*").alias("volume"),
        )
    )


BARS = """bars AS (
  SELECT event_type AS entity_id, CAST(ts AS DATE) AS date,
    arg_min(value, ROW(ts, event_id)) AS open, MAX(value) AS high, MIN(value) AS low,
    arg_max(value, ROW(ts, event_id)) AS close, COUNT(*) AS volume
  FROM events GROUP BY event_type, CAST(ts AS DATE))"""


def macro_long(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue and order count per nation and year as long series."""
    # per customer and year first: a customer with a third of all orders shuffles a few rows
    orders = (
        table(spark, sf, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(F.sum(money("o_totalprice")).alias("revenue"), F.count("*").alias("n"))
    )
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    wide = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_nationkey", "year")
        .agg(F.sum("revenue").cast("double").alias("Revenue"), F.sum("n").cast("double").alias("Orders"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("entity_id"), "year", "Revenue", "Orders")
    )
    return melt(wide, ["Revenue", "Orders"], keep=["entity_id", "year"], name="series")


MACRO = """macro AS (
  SELECT n.n_name AS entity_id, CAST(year(o.o_orderdate) AS INTEGER) AS year, s.series,
    CASE WHEN s.series = 'Revenue' THEN CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE)
         ELSE CAST(COUNT(*) AS DOUBLE) END AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    CROSS JOIN (VALUES ('Revenue'), ('Orders')) s(series)
  GROUP BY n.n_name, year(o.o_orderdate), s.series)"""


def facts_long(spark: SparkSession, sf: str) -> DataFrame:
    """Revenues per supplier and ship year, and one Assets fact per supplier."""
    revenue = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("fy"))
        .agg(F.sum(money("l_extendedprice")).cast("double").alias("value"))
        .select("entity_id", "fy", F.lit("Revenues").alias("concept"), "value")
    )
    assets = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity_id"),
        (F.lit(1960) + F.col("s_suppkey") % 150).cast("int").alias("fy"),
        F.lit("Assets").alias("concept"),
        F.col("s_acctbal").alias("value"),
    )
    return revenue.unionByName(assets)


FACTS = """facts AS (
  SELECT l_suppkey AS entity_id, CAST(year(l_shipdate) AS INTEGER) AS fy, 'Revenues' AS concept,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate)
  UNION ALL
  SELECT s_suppkey, CAST(1960 + s_suppkey % 150 AS INTEGER), 'Assets', s_acctbal FROM supplier)"""


def dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    """events with faults injected by key: nulls, null-like text, bad numbers and dates,
    infinities and repeated rows.  ``seq`` is the ingest order."""
    k = F.col("event_id")
    base = table(spark, sf, "events").select(
        k.alias("seq"),
        F.col("user_id").alias("entity_id"),
        F.col("ts").alias("date"),
        F.when(k % 17 != 0, F.col("value")).alias("v"),
        F.when(k % 23 == 0, " N/A ").when(k % 29 == 0, "  Big   Co ").otherwise(F.col("event_type")).alias("cat"),
        F.when(k % 31 == 0, "abc")
        .otherwise(F.floor(F.col("value") * 100.0 + F.lit(0.5)).cast("bigint").cast("string"))
        .alias("v_text"),
        F.when(k % 43 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date_text"),
        F.when(k % 37 == 0, F.lit(float("inf"))).when(k % 53 == 0, F.lit(float("-inf"))).otherwise(F.col("value")).alias("v_inf"),
    )
    copies = base.filter(F.col("seq") % 41 == 0).withColumn("seq", F.col("seq") + F.lit(COPY_OFFSET))
    return base.unionByName(copies)


DIRTY = f"""dirty0 AS (
  SELECT event_id AS seq, user_id AS entity_id, ts AS date,
    CASE WHEN event_id % 17 <> 0 THEN value END AS v,
    CASE WHEN event_id % 23 = 0 THEN ' N/A ' WHEN event_id % 29 = 0 THEN '  Big   Co ' ELSE event_type END AS cat,
    CASE WHEN event_id % 31 = 0 THEN 'abc'
         ELSE CAST(CAST(floor(value * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) END AS v_text,
    CASE WHEN event_id % 43 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date_text,
    CASE WHEN event_id % 37 = 0 THEN 'inf'::DOUBLE WHEN event_id % 53 = 0 THEN '-inf'::DOUBLE ELSE value END AS v_inf
  FROM events),
dirty AS (SELECT * FROM dirty0 UNION ALL
  SELECT seq + {COPY_OFFSET}, entity_id, date, v, cat, v_text, date_text, v_inf FROM dirty0 WHERE seq % 41 = 0)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A label and a fixed pseudo-probability per embedding: input for the metric operators."""
    h = hash_uniform("vec_id", seed=7)
    base = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") == 0, 1).otherwise(0).alias("y"), h.alias("h")
    )
    p = F.when(F.col("y") == 1, F.lit(400) + F.col("h") % 600).otherwise(F.col("h") % 700) / F.lit(1000.0)
    return base.select("id", "y", p.alias("p"))


SCORES = """scores AS (
  SELECT vec_id AS id, y, CASE WHEN y = 1 THEN 400 + h % 600 ELSE h % 700 END / 1000.0::DOUBLE AS p
  FROM (SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y,
          CAST('0x' || substr(md5('7:' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM embeddings))"""


def sql_with(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def r(expr: str, digits: int = 6) -> str:
    """DuckDB spelling of functions.scalars.rounded."""
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5::DOUBLE) / {scale})"
