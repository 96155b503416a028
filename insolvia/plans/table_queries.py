"""Joins, panels, ordered series, splits, folds, samples and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import order as o
from ..operators import sampling as s
from ..operators import series as se
from ..operators.prepare import align_columns
from . import tables as t
from .registry import query
from .tables import BARS, DIRTY, FEATURES, FIRM, FIRMS, MACRO, r, sql_with, table

H = "CAST('0x' || substr(md5('42:' || CAST({0} AS VARCHAR)), 1, 8) AS BIGINT)"

GAPPY_BARS = "gappy AS (SELECT entity_id, date, CASE WHEN day(date) % 7 <> 3 THEN close END AS close FROM bars)"
FILLED = "filled AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY date) AS f FROM gappy)"
RETURNS = "returns AS (SELECT entity_id, date, f / LAG(f) OVER (PARTITION BY entity_id ORDER BY date) - 1 AS daily_return FROM filled)"


def _gappy_bars(spark, sf):
    return t.price_bars(spark, sf).select("entity_id", "date", F.when(F.dayofmonth("date") % 7 != 3, F.col("close")).alias("close"))


@query("price_bars", sql_with(BARS, body="SELECT entity_id, date, open, high, low, close, volume FROM bars"))
def _bars(spark, sf):
    return t.price_bars(spark, sf)


@query("period_returns", sql_with(BARS, GAPPY_BARS, FILLED, RETURNS, body=f"SELECT entity_id, date, {r('daily_return')} AS daily_return FROM returns"))
def _returns(spark, sf):
    return se.period_returns(_gappy_bars(spark, sf), "entity_id", "date", "close").select("entity_id", "date", rounded("daily_return").alias("daily_return"))


@query(
    "rolling_volatility",
    sql_with(
        BARS, GAPPY_BARS, FILLED, RETURNS,
        body=f"""SELECT entity_id, date, CASE WHEN COUNT(daily_return) OVER w = 21 THEN {r('stddev_samp(daily_return) OVER w * sqrt(252)')} END AS volatility FROM returns
        WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    ),
)
def _volatility(spark, sf):
    returns = se.period_returns(_gappy_bars(spark, sf), "entity_id", "date", "close")
    return se.rolling_volatility(returns, "entity_id", "date", "daily_return").select("entity_id", "date", rounded("volatility").alias("volatility"))


@query(
    "rolling_statistics",
    sql_with(
        BARS,
        body=f"""SELECT entity_id, date, {r('AVG(close) OVER w')} AS roll3_mean__close, {r('stddev_samp(close) OVER w')} AS roll3_std__close,
          {r('AVG(volume) OVER w')} AS roll3_mean__volume, {r('stddev_samp(volume) OVER w')} AS roll3_std__volume FROM bars
        WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    ),
)
def _rolling(spark, sf):
    out = se.rolling_statistics(t.price_bars(spark, sf), "entity_id", ["date"], ["close", "volume"], 3)
    cols = [c for c in out.columns if c.startswith("roll3")]
    return out.select("entity_id", "date", *[rounded(c).alias(c) for c in cols])


@query(
    "entity_aggregates",
    sql_with(
        BARS,
        body=f"SELECT entity_id, date, {r('AVG(close) OVER w')} AS ent_mean__close, {r('stddev_samp(close) OVER w')} AS ent_std__close FROM bars WINDOW w AS (PARTITION BY entity_id)",
    ),
)
def _entity(spark, sf):
    out = se.entity_aggregates(t.price_bars(spark, sf), "entity_id", ["close"])
    return out.select("entity_id", "date", *[rounded(c).alias(c) for c in ("ent_mean__close", "ent_std__close")])


def _daily(spark, sf, kind):
    ev = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return ev.groupBy(F.to_date("ts").alias("date")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


def _series_sql(kind):
    return f"(SELECT CAST(ts AS DATE) AS date, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS {kind} FROM events WHERE event_type = '{kind}' GROUP BY 1)"


@query(
    "macro_outer_join",
    f"""SELECT date, signup, error, click FROM {_series_sql('signup')} FULL OUTER JOIN {_series_sql('error')} USING (date)
    FULL OUTER JOIN {_series_sql('click')} USING (date) WHERE date >= DATE '2024-01-05' ORDER BY date""",
)
def _macro_join(spark, sf):
    parts = [(k, _daily(spark, sf, k)) for k in ("signup", "error", "click")]
    return se.outer_join_panel(parts, ["date"], start="2024-01-05").orderBy("date")


@query(
    "entity_year_outer_join",
    sql_with(
        MACRO,
        body="""SELECT entity_id, year, a.value AS "Revenue", b.value AS "Orders" FROM (SELECT * FROM macro WHERE series = 'Revenue' AND year % 2 = 0) a
        FULL OUTER JOIN (SELECT * FROM macro WHERE series = 'Orders') b USING (entity_id, year)""",
    ),
)
def _entity_join(spark, sf):
    macro = t.macro_long(spark, sf)
    revenue = macro.filter((F.col("series") == "Revenue") & (F.col("year") % 2 == 0))
    orders = macro.filter(F.col("series") == "Orders")
    return se.outer_join_panel([("Revenue", revenue), ("Orders", orders)], ["entity_id", "year"])


@query(
    "coded_key_lookup",
    """SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def _lookup(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("ridx"))
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("ridx"), F.col("r_name").alias("region"))
    coded = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("idx"))
    return se.lookup_join(se.lookup_join(coded, nation, ["idx"]), region, ["ridx"]).select("s_suppkey", "nation", "region")


@query(
    "row_aligned_columns",
    sql_with(FIRM, body="SELECT entity_id, " + ", ".join(f"CAST(segment = '{x}' AS INTEGER) AS \"segment={x}\"" for x in ("AUTOMOBILE", "BUILDING")) + ", qty FROM firm"),
)
def _aligned(spark, sf):
    dummies = {f"segment={x}": (F.col("segment") == x).cast("int") for x in ("AUTOMOBILE", "BUILDING")}
    return t.firms(spark, sf).withColumns(dummies).select("entity_id", *[F.col(f"`{c}`") for c in dummies], "qty")


@query(
    "broadcast_statistics",
    sql_with(FIRMS, body=f"SELECT entity_id, {r('gross - (SELECT AVG(gross) FROM firms)', 3)} AS centred FROM firms"),
)
def _stats(spark, sf):
    firms = t.firms(spark, sf)
    mean = firms.agg(F.avg("gross")).first()[0]
    return firms.select("entity_id", rounded(F.col("gross") - F.lit(mean), 3).alias("centred"))


@query("date_lower_bound", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def _lower(spark, sf):
    orders = table(spark, sf, "orders")
    bound = F.lit("1997-01-01").cast(orders.schema["o_orderdate"].dataType)
    return orders.filter(F.col("o_orderdate") >= bound).select("o_orderkey", "o_orderdate")


@query("align_columns", sql_with(FIRMS, body="SELECT qty, 0 AS absent, gross FROM firms WHERE split = 'val'"))
def _align(spark, sf):
    return align_columns(t.firms(spark, sf).filter(F.col("split") == "val"), ["qty", "absent", "gross"])


# ---------------------------------------------------------------- order, samples, splits
@query("sort_by_key", sql_with(MACRO, body="SELECT entity_id, year, series, value FROM macro ORDER BY entity_id, year, series"))
def _sort(spark, sf):
    return s.sort_by(t.macro_long(spark, sf), "entity_id", "year", "series")


@query("random_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {H.format('o_orderkey')}, o_orderkey LIMIT 500")
def _sample(spark, sf):
    return o.sample_rows(table(spark, sf, "orders"), 500, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("stratified_split", sql_with(FIRMS, body="SELECT entity_id, target, split FROM firms"))
def _split(spark, sf):
    return s.stratified_split(t.firm_features(spark, sf), "target", "entity_id").select("entity_id", "target", "split")


@query(
    "time_split",
    """SELECT o_orderkey, CASE WHEN rn <= floor(floor(n * 0.85::DOUBLE) * 0.85::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, COUNT(*) OVER () AS n FROM orders)""",
)
def _time_split(spark, sf):
    return s.time_split(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


@query(
    "stratified_folds",
    sql_with(
        FIRM,
        body=f"""SELECT entity_id, target, CASE WHEN rn <= n // 5 THEN 0 WHEN rn <= n * 2 // 5 THEN 1 WHEN rn <= n * 3 // 5 THEN 2 WHEN rn <= n * 4 // 5 THEN 3 ELSE 4 END AS fold
        FROM (SELECT entity_id, target, ROW_NUMBER() OVER (PARTITION BY target ORDER BY {H.format('entity_id')}, entity_id) AS rn, COUNT(*) OVER (PARTITION BY target) AS n FROM firm)""",
    ),
)
def _folds(spark, sf):
    return s.stratified_folds(t.firms(spark, sf), "target", "entity_id", 5).select("entity_id", "target", "fold")


@query(
    "expanding_time_folds",
    """SELECT o_orderkey, CAST(greatest(0, (rn - (n - 5 * (n // 6)) + (n // 6) - 1) // (n // 6)) AS INTEGER) AS block
    FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, COUNT(*) OVER () AS n FROM orders)""",
)
def _time_folds(spark, sf):
    return s.expanding_time_folds(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "block")


@query("distinct_rows", sql_with(DIRTY, body="SELECT DISTINCT entity_id, date, v, cat, v_text, date_text, v_inf FROM dirty"))
def _distinct(spark, sf):
    return s.drop_duplicate_rows(t.dirty_events(spark, sf).drop("seq"))


for _keep, _dir in (("last", "DESC"), ("first", "ASC")):

    @query(
        f"deduplicate_keep_{_keep}",
        sql_with(DIRTY, body=f"SELECT seq, entity_id, date, v, cat, v_text, date_text, v_inf FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, date ORDER BY seq {_dir}) AS rn FROM dirty) WHERE rn = 1"),
    )
    def _dedupe(spark, sf, keep=_keep):
        return s.drop_duplicates_by_contract(t.dirty_events(spark, sf), "seq", "entity_id", ["date"], keep)


@query(
    "union_all",
    "SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier",
)
def _union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    p = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return s.union_all([c, p])
