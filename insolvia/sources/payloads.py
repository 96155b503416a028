"""Flattening of landed JSON payloads into long facts and panels.

Each function takes a DataFrame with one document per row in ``payload``; documents are
parsed and exploded where they are read, so nothing is gathered.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_number, to_time
from ..operators.series import outer_join_panel, period_returns, rolling_volatility

FACT = "array<struct<val:double,fy:int,fp:string,form:string,end:string,filed:string>>"
SERIES_DOC = (
    "struct<data:struct<dataSets:array<struct<series:map<string,struct<observations:map<string,array<string>>>>>>,"
    "structure:struct<dimensions:struct<series:array<struct<id:string,values:array<struct<id:string>>>>,"
    "observation:array<struct<values:array<struct<id:string>>>>>>>>"
)
PANEL_RECORDS = "array<struct<countryiso3code:string,country:struct<value:string>,date:string,value:double>>"


def read_payloads(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """One document per line, or one per file."""
    return spark.read.option("wholetext", whole_file).text(path).select(F.col("value").alias("payload"), F.col("_metadata.file_name").alias("file"))


def company_facts(docs: DataFrame) -> DataFrame:
    """(cik, concept, payload with entityName and units{unit:[fact]}) to one row per fact."""
    parsed = docs.withColumn("d", F.from_json("payload", f"struct<entityName:string,units:map<string,{FACT}>>"))
    units = parsed.select("cik", "concept", F.col("d.entityName").alias("entity_name"), F.explode("d.units").alias("unit", "facts"))
    rows = units.select("cik", "concept", "entity_name", "unit", F.explode("facts").alias("f"))
    cik = F.lpad(F.col("cik").cast("string"), 10, "0")
    return rows.select(
        cik.alias("cik"), cik.alias("entity_id"), "entity_name", "concept", "unit", F.col("f.val").alias("value"), F.col("f.fy").alias("fy"),
        F.col("f.fp").alias("fp"), F.col("f.form").alias("form"), to_time(F.col("f.end")).alias("date"), F.col("f.filed").alias("filed"),
    )


def indicator_map(docs: DataFrame, start: str | None = None) -> DataFrame:
    """{values:{indicator:{area:{year:value}}}} to (entity_id, indicator, date, value) in order."""
    parsed = F.from_json("payload", "struct<values:map<string,map<string,map<string,string>>>>")
    by_indicator = docs.select(F.explode(parsed["values"]).alias("indicator", "areas"))
    by_area = by_indicator.select("indicator", F.explode("areas").alias("entity_id", "years"))
    rows = by_area.select("entity_id", "indicator", F.explode("years").alias("year", "v"))
    if start is not None:
        rows = rows.filter(F.col("year") >= F.lit(str(start)))
    return rows.select("entity_id", "indicator", to_number("year").cast("int").alias("date"), to_number("v").alias("value")).orderBy("entity_id", "date")


def coded_series(docs: DataFrame, subject: str, area_ids: Sequence[str] = ("REF_AREA", "LOCATION")) -> DataFrame:
    """Decode "i:j:k" series keys against the dimension lists and explode the observations."""
    d = F.from_json("payload", SERIES_DOC)["data"]
    parsed = docs.select(d["dataSets"][0]["series"].alias("series"), d["structure"]["dimensions"]["series"].alias("dims"), d["structure"]["dimensions"]["observation"][0]["values"].alias("periods"))
    rows = parsed.select("dims", "periods", F.explode("series").alias("key", "s"))
    index = F.split("key", ":")
    labels = F.zip_with("dims", index, lambda dim, i: F.struct(dim["id"].alias("id"), F.get(dim["values"], i.cast("int"))["id"].alias("v")))

    def label(dimension: str):
        return F.get(F.filter("labels", lambda x: x["id"] == dimension), F.lit(0))["v"]

    area = F.coalesce(*[label(a) for a in area_ids])
    obs = rows.withColumn("labels", labels).select(area.alias("entity_id"), "periods", F.explode("s.observations").alias("t", "o"))
    return obs.select("entity_id", F.lit(subject).alias("subject"), F.get("periods", F.col("t").cast("int"))["id"].alias("date"), to_number(F.get("o", F.lit(0))).alias("value"))


# Keys of a throttling or error reply, and of the quote fields.
REFUSALS = ("Note", "Information", "Error Message")
QUOTE_FIELDS = ("open", "high", "low", "close", "volume")


def daily_quotes(docs: DataFrame) -> DataFrame:
    """(symbol, payload with "Time Series …"{date:{"1. open":…}}) to one row per bar; values
    stay text.  Refused requests give no rows."""
    top = docs.select("symbol", F.from_json("payload", "map<string,string>").alias("m"))
    good = top.filter(~F.arrays_overlap(F.map_keys("m"), F.array(*[F.lit(x) for x in REFUSALS])))
    body = F.get(F.filter(F.map_entries("m"), lambda e: e["key"].contains("Time Series")), F.lit(0))["value"]
    days = good.select("symbol", F.explode(F.from_json(body, "map<string,map<string,string>>")).alias("day", "q"))
    q = days.withColumn("q", F.transform_keys("q", lambda k, _: F.element_at(F.split(k, r"\. "), -1)))
    symbol = F.upper("symbol")
    return q.select(to_time("day").alias("date"), *[F.col("q")[f].alias(f) for f in QUOTE_FIELDS], symbol.alias("symbol"), symbol.alias("entity_id"))


def indicator_panel(docs: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """(indicator, payload "[meta, [record…]]") to one wide row per entity, country and date."""
    second = F.get(F.from_json("payload", "array<string>"), F.lit(1))
    rec = docs.select("indicator", F.explode(F.from_json(second, PANEL_RECORDS)).alias("r"))
    rows = rec.select("indicator", F.col("r.countryiso3code").alias("entity_id"), F.col("r.country.value").alias("country"), to_number("r.date").cast("int").alias("date"), F.col("r.value").alias("value"))
    parts = [(i, rows.filter(F.col("indicator") == i).drop("indicator")) for i in indicators]
    return outer_join_panel(parts, ["entity_id", "country", "date"])


def price_history(df: DataFrame, ticker: str, date: str = "Date", close: str = "Close") -> DataFrame:
    """Tag bars with their upper-cased entity, rename the date, add return and volatility."""
    tagged = df.withColumn("entity_id", F.upper(F.col(ticker))).withColumn("ticker", F.upper(F.col(ticker))).withColumnRenamed(date, "date")
    return rolling_volatility(period_returns(tagged, "entity_id", "date", close), "entity_id", "date", "daily_return", out="volatility_21d")
