"""Sources, payload flattening, sinks, stores and landing, each fed from the given tables.

Payload and CSV inputs are written from the tables into the shared folder first, then
read back through the operator under test.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import models as md
from ..session import new_path
from ..sources import files as sf_
from ..sources import landing as ld
from ..sources import payloads as pl
from ..store import files
from ..store import tables as st
from . import tables as t
from .model_queries import scaled_firms, train_of
from .registry import query
from .tables import BARS, DIRTY, FEATURES, FIRMS, MACRO, r, sql_with, table


# ---------------------------------------------------------------- CSV scans
def _written_csv(df, spark, label, parts=None):
    path = new_path(spark, label)
    (df if parts is None else df.repartition(parts)).write.option("header", True).csv(path)
    return path


@query("csv_scan", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _csv(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias(" o_orderkey "), F.col("o_totalprice").alias(" o_totalprice"), F.col("o_orderstatus").alias("o_orderstatus "))
    return sf_.read_csv(spark, _written_csv(df, spark, "csv"), {"o_orderkey": "bigint", "o_totalprice": "double"})


@query("labelled_csv_scan", sql_with(DIRTY, body="SELECT DISTINCT entity_id, cat, CAST(seq % 2 AS INTEGER) AS label FROM dirty"))
def _labelled(spark, sf):
    df = t.dirty_events(spark, sf).select("entity_id", F.col("cat").alias(" cat"), (F.col("seq") % 2).cast("string").alias("label "))
    path = new_path(spark, "labelled")
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return sf_.read_labelled_csv(spark, path, "label", {"entity_id": "bigint"})


@query(
    "drifting_csv_union",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, NULL::VARCHAR AS city, 'a.csv' AS _source_file FROM customer
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, s_name, 'b.csv' FROM supplier""",
)
def _drift(spark, sf):
    folder = new_path(spark, "drift")
    c = table(spark, sf, "customer").select(F.concat_ws(",", "c_custkey", "c_mktsegment").alias("line"))
    extra = table(spark, sf, "customer").select(F.concat_ws(",", "c_custkey", "c_mktsegment", F.lit("too"), F.lit("many")).alias("line"))
    s = table(spark, sf, "supplier").select(F.concat_ws(",", "s_suppkey", "s_name").alias("line"))
    _lines_as_csv(c.union(extra), f"{folder}/a.csv", "id, segment ")
    _lines_as_csv(s, f"{folder}/b.csv", "id,city")
    return sf_.read_drifting_csvs(spark, folder)


def _lines_as_csv(lines, path, header):
    """Whole lines under a raw header line, a part file a task; the separator stands in no line, so nothing is quoted."""
    raw = lines.toDF(header).write.option("header", True).option("sep", "\u0001")
    raw.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@query(
    "entity_csv_scan",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS \"Date\", o_totalprice AS \"Close\", 'ORD' || coalesce(upper(o_orderstatus), 'NONE') AS ticker FROM orders",
)
def _entity_files(spark, sf):
    folder = new_path(spark, "tickers")
    name = F.concat(F.lit("ord"), F.coalesce(F.lower("o_orderstatus"), F.lit("none")), F.lit(".us.csv"))
    lines = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.col("o_totalprice").alias("Close"), name.alias("file"))
    lines.write.partitionBy("file").option("header", True).csv(folder)
    return sf_.read_entity_csvs(spark, folder, types={"Close": "double"})


@query("dataset_by_name", "SELECT n_nationkey, n_name FROM nation")
def _by_name(spark, sf):
    folder = new_path(spark, "interim")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    n.write.parquet(f"{folder}/nation.parquet")
    n.limit(0).write.option("header", True).csv(f"{folder}/nation.csv")
    return sf_.read_dataset(spark, folder, "nation")


@query("split_scan", sql_with(FIRMS, body="SELECT entity_id, target FROM firms WHERE split = 'val'"))
def _split_scan(spark, sf):
    folder = new_path(spark, "splits")
    f = t.firms(spark, sf)
    f.filter(F.col("split") == "train").drop("split").write.parquet(f"{folder}/train.parquet")
    f.filter(F.col("split") == "val").drop("split").write.parquet(f"{folder}/val.parquet")
    return sf_.read_split(spark, folder, "val").select("entity_id", "target")


# ---------------------------------------------------------------- payloads
@query(
    "company_facts",
    """SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS entity_id, 'supplier ' || l_suppkey AS entity_name, concept, unit, value,
      CAST(year(l_shipdate) AS INTEGER) AS fy, 'FY' AS fp, '10-K' AS form, strftime(l_shipdate, '%Y-%m-%d') AS date, strftime(l_shipdate, '%Y-%m-%d') AS filed
    FROM (SELECT *, 'Revenues' AS concept, 'USD' AS unit, l_extendedprice AS value FROM lineitem UNION ALL SELECT *, 'Revenues', 'shares', l_quantity FROM lineitem)""",
)
def _facts(spark, sf):
    l = table(spark, sf, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    fact = lambda v: F.array(F.struct(F.col(v).alias("val"), F.year("l_shipdate").alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), day.alias("end"), day.alias("filed")))
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("supplier "), F.col("l_suppkey")).alias("entityName"),
            F.create_map(F.lit("USD"), fact("l_extendedprice"), F.lit("shares"), fact("l_quantity")).alias("units"),
        )
    )
    out = pl.company_facts(l.select(F.col("l_suppkey").alias("cik"), F.lit("Revenues").alias("concept"), doc.alias("payload")))
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("indicator_map", sql_with(MACRO, body="SELECT entity_id, series AS indicator, year AS date, CASE WHEN year % 5 <> 0 THEN value END AS value FROM macro WHERE year >= 1994"))
def _indicator(spark, sf):
    m = t.macro_long(spark, sf)
    value = F.when(F.col("year") % 5 != 0, F.col("value").cast("string")).otherwise("n/a")
    doc = F.to_json(F.struct(F.create_map("series", F.create_map("entity_id", F.create_map(F.col("year").cast("string"), value))).alias("values")))
    return pl.indicator_map(m.select(doc.alias("payload")), "1994")


@query(
    "coded_series",
    sql_with(MACRO, body="SELECT entity_id, 'CLI' AS subject, CAST(year AS VARCHAR) AS date, value FROM macro UNION ALL SELECT entity_id, 'CLI', CAST(year AS VARCHAR) || '-Q4', value FROM macro"),
)
def _coded(spark, sf):
    m = t.macro_long(spark, sf)
    ids = lambda *xs: F.array(*[F.struct(x.cast("string").alias("id")) for x in xs])
    obs = lambda: F.array(F.col("value").cast("string"))
    dims = F.array(
        F.struct(F.lit("SUBJECT").alias("id"), ids(F.lit("x"), F.lit("y"), F.col("series")).alias("values")),
        F.struct(F.lit("REF_AREA").alias("id"), ids(F.lit("none"), F.col("entity_id")).alias("values")),
    )
    doc = F.to_json(
        F.struct(
            F.struct(
                F.array(F.struct(F.create_map(F.lit("2:1"), F.struct(F.create_map(F.lit("1"), obs(), F.lit("0"), obs()).alias("observations"))).alias("series"))).alias("dataSets"),
                F.struct(
                    F.struct(dims.alias("series"), F.array(F.struct(ids(F.concat("year", F.lit("-Q4")), F.col("year")).alias("values"))).alias("observation")).alias("dimensions")
                ).alias("structure"),
            ).alias("data")
        )
    )
    return pl.coded_series(m.select(doc.alias("payload")), "CLI")


@query(
    "daily_quotes",
    sql_with(BARS, body="SELECT strftime(date, '%Y-%m-%d') AS date, CAST(CAST(volume AS BIGINT) AS VARCHAR) AS volume, CAST(CAST(round(high * 100) AS BIGINT) AS VARCHAR) AS high, CAST(CAST(round(low * 100) AS BIGINT) AS VARCHAR) AS low, CAST(CAST(round(open * 100) AS BIGINT) AS VARCHAR) AS open, CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR) AS close, upper(entity_id) AS symbol, upper(entity_id) AS entity_id FROM bars WHERE day(date) <> 13"),
)
def _quotes(spark, sf):
    b = t.price_bars(spark, sf)
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").cast("string")
    quote = F.create_map(
        F.lit("1. open"), cents("open"), F.lit("2. high"), cents("high"), F.lit("3. low"), cents("low"), F.lit("4. close"), cents("close"),
        F.lit("5. volume"), F.col("volume").cast("string"),
    )
    good = F.to_json(F.create_map(F.lit("Time Series (Daily)"), F.create_map(F.col("date").cast("string"), quote)))
    doc = F.when(F.dayofmonth("date") == 13, F.lit('{"Note": "call frequency"}')).otherwise(good)
    out = pl.daily_quotes(b.select(F.col("entity_id").alias("symbol"), doc.alias("payload")))
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "volume", "high", "low", "open", "close", "symbol", "entity_id")


@query(
    "indicator_panel",
    sql_with(MACRO, body="SELECT upper(entity_id) AS entity_id, entity_id AS country, year AS date, MAX(CASE WHEN series = 'Revenue' THEN value END) AS \"Revenue\", MAX(CASE WHEN series = 'Orders' THEN value END) AS \"Orders\" FROM macro GROUP BY entity_id, year"),
)
def _panel(spark, sf):
    m = t.macro_long(spark, sf)
    rec = F.to_json(F.array(F.struct(F.upper("entity_id").alias("countryiso3code"), F.struct(F.col("entity_id").alias("value")).alias("country"), F.col("year").cast("string").alias("date"), "value")))
    doc = F.concat(F.lit('[{"page": 1}, '), rec, F.lit("]"))
    path = new_path(spark, "payload")
    m.select(F.col("series").alias("indicator"), doc.alias("payload")).write.partitionBy("indicator").text(path)
    docs = spark.read.text(path).select("indicator", F.col("value").alias("payload"))
    return pl.indicator_panel(docs, ["Revenue", "Orders"])


@query(
    "price_history",
    sql_with(
        BARS, "ret AS (SELECT upper(entity_id) AS entity_id, date, close, close / LAG(close) OVER (PARTITION BY entity_id ORDER BY date) - 1 AS d FROM bars)",
        body=f"""SELECT entity_id, date, {r('d')} AS daily_return, CASE WHEN COUNT(d) OVER w = 21 THEN {r('stddev_samp(d) OVER w * sqrt(252)')} END AS volatility_21d FROM ret
        WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    ),
)
def _history(spark, sf):
    bars = t.price_bars(spark, sf).select(F.col("entity_id").alias("symbol"), F.col("date").alias("Date"), F.col("close").alias("Close"))
    out = pl.price_history(bars, "symbol")
    return out.select("entity_id", "date", rounded("daily_return").alias("daily_return"), rounded("volatility_21d").alias("volatility_21d"))


# ---------------------------------------------------------------- sinks and stores
@query("raw_csv_sink", "SELECT p_partkey, p_name FROM part")
def _raw(spark, sf):
    path = st.write_raw_csv(table(spark, sf, "part").select("p_partkey", "p_name"), new_path(spark, "raw"))
    return sf_.read_csv(spark, path, {"p_partkey": "bigint"})


@query("interim_sink", "SELECT COUNT(*) AS observed, SUM(p_size)::BIGINT AS total_size FROM part")
def _interim(spark, sf):
    path, n = st.write_interim(table(spark, sf, "part"), new_path(spark, "interim"))
    return spark.read.parquet(path).agg(F.lit(n).cast("bigint").alias("observed"), F.sum("p_size").alias("total_size"))


@query(
    "column_sidecar",
    sql_with(
        DIRTY,
        body=" UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{ty}' AS dtype, COUNT({c}) AS non_null, COUNT(*) AS n_rows FROM dirty"
            for i, (c, ty) in enumerate([("seq", "bigint"), ("entity_id", "bigint"), ("date", "timestamp_ntz"), ("v", "double"), ("cat", "string"), ("v_text", "string"), ("date_text", "string"), ("v_inf", "double")])
        ),
    ),
)
def _sidecar(spark, sf):
    return st.column_sidecar(t.dirty_events(spark, sf))


@query("file_checksums")
def _checksums(spark, sf):
    path, _ = st.write_interim(table(spark, sf, "supplier"), new_path(spark, "sums"))
    return st.file_checksums(spark, f"{path}/*.parquet").select("length", "sha256")


@query("partitioned_splits", sql_with(FIRMS, body="SELECT split, COUNT(*) AS n_rows, SUM(target)::BIGINT AS positives FROM firms GROUP BY split"))
def _splits(spark, sf):
    path = st.write_splits(t.firms(spark, sf), new_path(spark, "splits"))
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("target").alias("positives"))


@query(
    "feature_store_versions",
    sql_with(FIRMS, body="SELECT v.version, split, COUNT(*) AS n_rows, TRUE AS verified, v.version = 'v002' AS latest FROM firms, (VALUES ('v001'), ('v002')) v(version) GROUP BY v.version, split"),
)
def _feature_store(spark, sf):
    store = st.FeatureStore(spark, new_path(spark, "features"))
    for _ in range(2):
        store.save(t.firms(spark, sf), {"features": FEATURES})
    rows = []
    for v in store.versions():
        _, record = store.load(v)
        ok = store.verify(v)
        rows += [(v, s, info["rows"], ok[s], v == store.latest()) for s, info in record["splits"].items()]
    return spark.createDataFrame(rows, "version string, split string, n_rows bigint, verified boolean, latest boolean")


@query("content_hash", sql_with(FIRMS, body="SELECT COUNT(*) AS n_rows, TRUE AS order_free, TRUE AS sees_a_lost_row, TRUE AS sees_a_changed_value FROM firms"))
def _hash(spark, sf):
    df = t.firms(spark, sf)
    h = st.content_hash(df)
    last = df.agg(F.max("entity_id")).first()[0]
    changed = df.withColumn("qty", F.when(F.col("entity_id") == last, F.col("qty") + 1).otherwise(F.col("qty")))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(st.content_hash(df.orderBy(F.desc("gross"))) == h).alias("order_free"),
        F.lit(st.content_hash(df.filter(F.col("entity_id") != last)) != h).alias("sees_a_lost_row"),
        F.lit(st.content_hash(changed) != h).alias("sees_a_changed_value"),
    )


@query("report_tables", sql_with(FIRMS, body="SELECT CAST(target AS VARCHAR) AS class, CAST(COUNT(*) AS VARCHAR) AS count FROM firms GROUP BY target"))
def _reports(spark, sf):
    from ..operators.profile import target_distribution

    paths = st.write_report_tables({"target": target_distribution(t.firms(spark, sf), "target")}, new_path(spark, "report"))
    return sf_.read_csv(spark, paths[0]).select("class", "count")


@query("findings_sink", sql_with(FIRMS, body="SELECT 'avg_disc' AS feature, COUNT(*) FILTER (avg_disc < 0.03) AS below, COUNT(*) FILTER (avg_disc > 0.07) AS above FROM firms"))
def _findings(spark, sf):
    from ..operators.quality import range_violations

    path = st.write_findings(range_violations(t.firms(spark, sf), {"avg_disc": (0.03, 0.07)}).select("feature", "below", "above"), new_path(spark, "findings"))
    return spark.read.schema("feature string, below bigint, above bigint").json(path)


@query("model_registry")
def _registry(spark, sf):
    reg = st.ModelRegistry(spark, new_path(spark, "models"))
    df = scaled_firms(spark, sf)
    for name in ("logistic_regression", "naive_bayes"):
        fitted = md.fit(name, train_of(df), FEATURES, "target")
        threshold, _, ev = md.evaluate_splits(fitted, df, "target", "entity_id")
        entry = reg.register(fitted, threshold, ev["test"], "v001", "target")
    reg.register_best(max(reg.entries(), key=lambda e: e["metrics"]["roc_auc"]))
    return reg.table()


@query("best_model_scoring")
def _best(spark, sf):
    reg = st.ModelRegistry(spark, new_path(spark, "models"))
    df = scaled_firms(spark, sf)
    entry = reg.register(md.fit("logistic_regression", train_of(df), FEATURES, "target"), 0.5, {"roc_auc": 0.5}, "v001", "target")
    reg.register_best(entry)
    fitted, meta = reg.load_best()
    return md.predict(fitted, df).select("entity_id", F.lit(meta["model_version"]).alias("model_version"), rounded("p").alias("p"))


@query(
    "representation_export",
    "SELECT 'all' AS split, CAST(label AS INTEGER) AS target, " + ", ".join(f"floor(embedding[{i + 1}]::DOUBLE * 1e6 + 0.5) / 1e6 AS z_{i:03d}" for i in range(64)) + " FROM embeddings",
)
def _export(spark, sf):
    df = table(spark, sf, "embeddings").select("embedding", F.col("label").alias("target"), F.lit("all").alias("split"))
    path = st.export_representation(df, "embedding", "target", new_path(spark, "export"))
    out = spark.read.parquet(path)
    return out.select("split", "target", *[rounded(c).alias(c) for c in out.columns if c.startswith("z_")])


@query(
    "landing_run",
    """SELECT 'orders' AS source, 'success' AS status, COUNT(*) AS n_rows, TRUE AS intact FROM orders UNION ALL SELECT 'supplier', 'success', COUNT(*), TRUE FROM supplier
    UNION ALL SELECT 'absent', 'failed', 0, FALSE FROM nation WHERE n_nationkey = 0""",
)
def _landing(spark, sf):
    root = new_path(spark, "landing")
    sources = [
        ld.Source("orders", lambda s: table(s, sf, "orders"), ["o_orderkey"]),
        ld.Source("supplier", lambda s: table(s, sf, "supplier"), ["s_suppkey"]),
        ld.Source("absent", lambda s: s.read.parquet(f"{root}/nowhere")),
    ]
    manifest = ld.land_all(spark, sources, root)
    intact = [(n, st.verify_sidecar(spark, f"{root}/metadata", n)) for n in ("orders", "supplier", "absent")]
    checked = spark.createDataFrame(intact, "source string, intact boolean")
    return manifest.join(checked, "source").select("source", "status", "n_rows", "intact")
