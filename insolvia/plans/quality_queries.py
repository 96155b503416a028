"""Data-quality queries over the fault-injected events, supplier facts, macro series and bars."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.contracts import Contract, contract_for
from ..functions.scalars import rounded, to_number, to_time
from ..operators import quality as q
from ..operators import sampling
from . import tables as t
from .registry import query
from .tables import AS_OF_DATE, AS_OF_YEAR, BARS, DIRTY, FACTS, FIRMS, MACRO, r, sql_with, table

EVENTS = Contract(
    "events", required={"seq": "integer", "entity_id": "integer", "date": "datetime", "v": "numeric", "region": "string"},
    optional={"cat": "string", "v_text": "numeric", "date_text": "datetime", "note": "string"},
    entity="entity_id", dates=("date",), series_keys=("entity_id",), nonneg=("v",), positive=("v_text",),
    ratio_bounds={"v": (0.0, 20.0)},
)
FACT_RULES = contract_for("sec_edgar").with_changes(dates=(), years=("fy",))
PAYLOAD_FEATURES = ["gross", "qty", "avg_disc"]


def dup_sql(cte: str, keys: str) -> str:
    return f"(SELECT COALESCE(SUM(c - 1), 0)::BIGINT FROM (SELECT COUNT(*) AS c FROM {cte} GROUP BY {keys}))"


EVENT_KEYS = "entity_id, date, v, cat, v_text, date_text, v_inf"


@query(
    "dirty_events_table",
    sql_with(DIRTY, body="SELECT seq, entity_id, date, v, cat, v_text, date_text, v_inf FROM dirty"),
)
def _dirty(spark, sf):
    return t.dirty_events(spark, sf)


@query(
    "landing_gate",
    sql_with(
        DIRTY,
        body=f"""SELECT 'events' AS source, n_rows, 8::BIGINT AS n_cols, 'region' AS missing_columns, {r('missing / (n_rows * 8)')} AS missing_total_pct,
          0::BIGINT AS duplicate_rows, FALSE AS schema_ok, 1::BIGINT AS n_errors, 1::BIGINT AS n_warnings, FALSE AS is_valid
        FROM (SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (v IS NULL) AS missing FROM dirty)""",
    ),
)
def _landing(spark, sf):
    out = q.landing_gate(t.dirty_events(spark, sf), "events", ["seq", "date", "region"])
    return out.withColumn("missing_total_pct", rounded("missing_total_pct"))


@query(
    "schema_contract",
    sql_with(
        DIRTY,
        body="""SELECT 5::BIGINT AS n_required, 'region' AS missing_required, 'note' AS missing_optional, 'v_inf' AS unexpected,
          'warn' AS unexpected_level, 'v_text' || CASE WHEN share < 0.9 THEN ',date_text' ELSE '' END AS dtype_mismatch,
          floor((1.0 - 1.0 / 5 - 0.25 * (1 + CASE WHEN share < 0.9 THEN 1 ELSE 0 END) / 9)::DOUBLE * 1e6 + 0.5) / 1e6 AS schema_score
        FROM (SELECT AVG(CASE WHEN try_cast(date_text AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM dirty)""",
    ),
)
def _schema(spark, sf):
    return q.schema_metrics(t.dirty_events(spark, sf), EVENTS).withColumn("schema_score", rounded("schema_score"))


@query(
    "column_kind_match",
    sql_with(
        DIRTY,
        body="""SELECT k.column_name, k.kind, k.fixed OR (k.column_name = 'date_text' AND share >= 0.9) AS matches
        FROM (SELECT AVG(CASE WHEN try_cast(date_text AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM dirty),
          (VALUES ('seq', 'integer', TRUE), ('entity_id', 'integer', TRUE), ('date', 'datetime', TRUE), ('v', 'numeric', TRUE),
                  ('cat', 'string', TRUE), ('v_text', 'numeric', FALSE), ('date_text', 'datetime', FALSE)) k(column_name, kind, fixed)""",
    ),
)
def _kinds(spark, sf):
    df = t.dirty_events(spark, sf)
    rows = [(c, EVENTS.known[c], ok) for c, ok in q.kind_matches(df, EVENTS).items()]
    return spark.createDataFrame(rows, "column_name string, kind string, matches boolean")


@query(
    "missing_by_column",
    sql_with(
        DIRTY,
        body=" UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", COUNT(*) FILTER ({c} IS NULL) AS missing, round_even(COUNT(*) FILTER ({c} IS NULL)::DOUBLE / COUNT(*) * 1e4, 0) / 1e4 AS pct, COUNT(*) AS n FROM dirty"
            for c in ["seq", "entity_id", "date", "v", "cat", "v_text", "date_text", "v_inf"]
        ),
    ),
)
def _missing(spark, sf):
    return q.missing_counts(t.dirty_events(spark, sf))


@query(
    "completeness",
    sql_with(
        DIRTY,
        body="""SELECT m AS total_missing, 1::BIGINT AS columns_with_missing, 0::BIGINT AS required_mostly_missing, 0::BIGINT AS heavy_columns,
          round_even(m::DOUBLE / (n * 8) * 1e4, 0) / 1e4 AS overall_missing_pct, round_even((1 - m::DOUBLE / (n * 8)) * 1e4, 0) / 1e4 AS completeness_score
        FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (v IS NULL) AS m FROM dirty)""",
    ),
)
def _completeness(spark, sf):
    return q.missing_metrics(t.dirty_events(spark, sf), required=["v"])


@query(
    "duplicate_rows",
    sql_with(
        DIRTY,
        body=f"""SELECT n AS n_rows, d AS duplicate_rows, round_even(d::DOUBLE / n * 1e4, 0) / 1e4 AS duplicate_row_pct,
          round_even((1 - d::DOUBLE / n) * 1e4, 0) / 1e4 AS uniqueness_score
        FROM (SELECT (SELECT COUNT(*) FROM dirty) AS n, {dup_sql('dirty', EVENT_KEYS)} AS d)""",
    ),
)
def _duplicates(spark, sf):
    return q.duplicate_rows(t.dirty_events(spark, sf).drop("seq"))


@query(
    "natural_key_duplicates",
    sql_with(
        DIRTY, BARS,
        body=f"""SELECT 'duplicate_entity_timestamps' AS code, 'entity_id,date' AS key, {dup_sql('dirty', 'entity_id, date')} AS count
        UNION ALL SELECT 'duplicate_entity_records', 'entity_id', {dup_sql('dirty', 'entity_id')}
        UNION ALL SELECT 'duplicate_timestamps', 'date', {dup_sql('bars', 'date')}""",
    ),
)
def _natural(spark, sf):
    df = t.dirty_events(spark, sf)
    panel = q.natural_key_duplicates(df, EVENTS)
    entity_only = q.natural_key_duplicates(df, Contract("x", entity="entity_id"))
    single = q.natural_key_duplicates(t.price_bars(spark, sf), Contract("x", dates=("date",)))
    return sampling.union_all([panel, entity_only, single])


def _fence_sql(cte: str, cols, mult: float) -> str:
    parts = [
        f"""SELECT '{c}' AS feature, round_even(AVG(CASE WHEN x < q1 - {mult} * (q3 - q1) OR x > q3 + {mult} * (q3 - q1) THEN 1.0 ELSE 0.0 END)::DOUBLE * 1e4, 0) / 1e4 AS pct
        FROM (SELECT CASE WHEN isfinite({c}) THEN {c} END AS x FROM {cte}), (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT CASE WHEN isfinite({c}) THEN {c} END AS x FROM {cte}))
        WHERE x IS NOT NULL"""
        for c in cols
    ]
    return " UNION ALL ".join(parts)


@query("iqr_outlier_share", sql_with(DIRTY, body=_fence_sql("dirty", ["v", "v_inf"], 1.5)))
def _iqr(spark, sf):
    df = t.dirty_events(spark, sf).drop("seq")
    return q.iqr_outliers(df, q.outlier_columns(df, EVENTS), 1.5)


@query(
    "zscore_outlier_share",
    sql_with(
        DIRTY,
        body=" UNION ALL ".join(
            f"""SELECT '{c}' AS feature, round_even(AVG(CASE WHEN abs(x - m) / s > 3.0 THEN 1.0 ELSE 0.0 END)::DOUBLE * 1e4, 0) / 1e4 AS pct
            FROM (SELECT CASE WHEN isfinite({c}) THEN {c} END AS x FROM dirty), (SELECT AVG(x) AS m, stddev_pop(x) AS s FROM (SELECT CASE WHEN isfinite({c}) THEN {c} END AS x FROM dirty))
            WHERE x IS NOT NULL"""
            for c in ["v", "v_inf"]
        ),
    ),
)
def _z(spark, sf):
    df = t.dirty_events(spark, sf).drop("seq")
    return q.zscore_outliers(df, q.outlier_columns(df, EVENTS), 3.0)


@query(
    "far_out_columns",
    sql_with(FIRMS, body=f"SELECT feature, pct, pct > 0.2 AS flagged FROM ({_fence_sql('firms', t.FEATURES, 3.0)})"),
)
def _far(spark, sf):
    return q.far_out_columns(t.firms(spark, sf), t.FEATURES, 0.20)


@query(
    "value_rules",
    sql_with(
        DIRTY,
        body=f"""SELECT code, "column", level, counted, count, (SELECT COUNT(*) FROM dirty) AS n_rows FROM (
          SELECT 'negative_value' AS code, 'v' AS "column", 'error' AS level, TRUE AS counted, COUNT(*) FILTER (v < 0) AS count FROM dirty
          UNION ALL SELECT 'nonpositive_value', 'v_text', 'error', TRUE, COUNT(*) FILTER (try_cast(v_text AS DOUBLE) <= 0) FROM dirty
          UNION ALL SELECT 'impossible_ratio', 'v', 'warn', TRUE, COUNT(*) FILTER (v < 0 OR v > 20) FROM dirty
          UNION ALL SELECT 'future_date', 'date', 'error', TRUE, COUNT(*) FILTER (date > TIMESTAMP '{AS_OF_DATE}' + INTERVAL 2 DAY) FROM dirty)""",
    ),
)
def _rules(spark, sf):
    return q.value_rules(t.dirty_events(spark, sf), EVENTS, AS_OF_DATE, AS_OF_YEAR)


@query(
    "sign_rules",
    sql_with(
        FACTS,
        body="""SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (value < 0) AS negative, COUNT(*) FILTER (value <= 0) AS nonpositive FROM facts""",
    ),
)
def _signs(spark, sf):
    x = to_number("value")
    return t.facts_long(spark, sf).agg(F.count("*").alias("n_rows"), F.count_if(x < 0).alias("negative"), F.count_if(x <= 0).alias("nonpositive"))


@query(
    "ratio_bounds",
    sql_with(FIRMS, body="SELECT 'avg_disc' AS feature, COUNT(*) FILTER (avg_disc < 0.03) AS below, COUNT(*) FILTER (avg_disc > 0.07) AS above FROM firms"),
)
def _bounds(spark, sf):
    return q.range_violations(t.firms(spark, sf), {"avg_disc": (0.03, 0.07)}).select("feature", "below", "above")


@query(
    "concept_rules",
    sql_with(
        FACTS,
        body="""SELECT concept, COUNT(*) AS n_rows, COUNT(*) FILTER (CASE WHEN concept = 'Assets' THEN value <= 0 ELSE value < 0 END) AS invalid
        FROM facts WHERE concept IN ('Assets', 'Revenues') GROUP BY concept""",
    ),
)
def _concepts(spark, sf):
    return q.concept_rule_counts(t.facts_long(spark, sf), "concept", "value", FACT_RULES.concept_rules)


@query(
    "fiscal_year_bounds",
    sql_with(
        FACTS,
        body=f"""SELECT code, "column", level, counted, count, n_rows FROM (
          SELECT 'invalid_concept_value' AS code, 'Assets' AS "column", 'error' AS level, TRUE AS counted, COUNT(*) FILTER (concept = 'Assets' AND value <= 0) AS count, COUNT(*) AS n_rows FROM facts
          UNION ALL SELECT 'invalid_concept_value', 'Liabilities', 'error', TRUE, COUNT(*) FILTER (concept = 'Liabilities' AND value < 0), COUNT(*) FROM facts
          UNION ALL SELECT 'invalid_concept_value', 'Revenues', 'error', TRUE, COUNT(*) FILTER (concept = 'Revenues' AND value < 0), COUNT(*) FROM facts
          UNION ALL SELECT 'invalid_concept_value', 'CashAndCashEquivalentsAtCarryingValue', 'error', TRUE, COUNT(*) FILTER (concept = 'CashAndCashEquivalentsAtCarryingValue' AND value < 0), COUNT(*) FROM facts
          UNION ALL SELECT 'invalid_fiscal_year', 'fy', 'warn', FALSE, COUNT(*) FILTER (fy < 1970 OR fy > {AS_OF_YEAR + 1}), COUNT(*) FROM facts
          UNION ALL SELECT 'future_year', 'fy', 'warn', FALSE, COUNT(*) FILTER (fy > {AS_OF_YEAR + 1}), COUNT(*) FROM facts)""",
    ),
)
def _fiscal(spark, sf):
    return q.value_rules(t.facts_long(spark, sf), FACT_RULES, AS_OF_DATE, AS_OF_YEAR)


@query(
    "validity_score",
    sql_with(
        DIRTY,
        body=f"""SELECT bad AS invalid_rows, round_even(bad::DOUBLE / n * 1e4, 0) / 1e4 AS invalid_pct,
          round_even(greatest(0.0::DOUBLE, 1 - bad::DOUBLE / n) * 1e4, 0) / 1e4 AS validity_score
        FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (v < 0) + COUNT(*) FILTER (try_cast(v_text AS DOUBLE) <= 0) + COUNT(*) FILTER (v < 0 OR v > 20)
          + COUNT(*) FILTER (date > TIMESTAMP '{AS_OF_DATE}' + INTERVAL 2 DAY) AS bad FROM dirty)""",
    ),
)
def _validity(spark, sf):
    return q.validity_metrics(q.value_rules(t.dirty_events(spark, sf), EVENTS, AS_OF_DATE, AS_OF_YEAR))


@query(
    "unparseable_timestamps",
    sql_with(DIRTY, body="SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (try_cast(date_text AS TIMESTAMP) IS NULL) AS unparseable FROM dirty"),
)
def _unparseable(spark, sf):
    return q.unparseable_times(t.dirty_events(spark, sf), "date_text")


@query(
    "series_not_chronological",
    sql_with(
        DIRTY,
        body="""SELECT entity_id AS entity, bool_or(coalesce(date < prev, FALSE)) AS unordered, COUNT(*) AS n
        FROM (SELECT entity_id, date, LAG(date) OVER (PARTITION BY entity_id ORDER BY seq) AS prev FROM dirty) GROUP BY entity_id""",
    ),
)
def _unordered(spark, sf):
    return q.unordered_series(t.dirty_events(spark, sf), "entity_id", "date", "seq", width=1000)


@query(
    "duplicate_timestamps_in_series",
    sql_with(DIRTY, body="SELECT entity_id AS entity, (COUNT(date) - COUNT(DISTINCT date))::BIGINT AS duplicate_timestamps FROM dirty GROUP BY entity_id"),
)
def _dup_times(spark, sf):
    return q.duplicate_times(t.dirty_events(spark, sf), "entity_id", "date")


GAPS = """steps AS (SELECT entity_id AS entity, round((epoch_us(date) - epoch_us(LAG(date) OVER (PARTITION BY entity_id ORDER BY date))) / 1e6, 6) AS step
  FROM (SELECT DISTINCT entity_id, date FROM dirty)),
med AS (SELECT entity, quantile_cont(step, 0.5) AS m, COUNT(*) AS k FROM steps WHERE step IS NOT NULL GROUP BY entity)"""


@query(
    "series_gaps",
    sql_with(
        DIRTY, GAPS,
        body=f"""SELECT s.entity, {r('MAX(m)', 3)} AS median_step, COUNT(*) FILTER (step > 3 * m) AS n_gaps
        FROM steps s JOIN med USING (entity) WHERE step IS NOT NULL AND m > 0 AND k >= 2 GROUP BY s.entity""",
    ),
)
def _gaps(spark, sf):
    return q.series_gaps(t.dirty_events(spark, sf), "entity_id", "date").withColumn("median_step", rounded("median_step", 3))


@query(
    "timeliness_score",
    sql_with(
        DIRTY,
        body="""SELECT COUNT(*) AS n_series, COUNT(*) FILTER (u) AS unordered_series, round_even((1 - COUNT(*) FILTER (u)::DOUBLE / COUNT(*)) * 1e4, 0) / 1e4 AS timeliness_score
        FROM (SELECT bool_or(coalesce(date < prev, FALSE)) AS u FROM (SELECT entity_id, date, LAG(date) OVER (PARTITION BY entity_id ORDER BY seq) AS prev FROM dirty) GROUP BY entity_id)""",
    ),
)
def _timeliness(spark, sf):
    return q.timeliness(t.dirty_events(spark, sf), "entity_id", "date", "seq")


@query(
    "quality_score_by_source",
    sql_with(
        DIRTY,
        body=f"""SELECT source, {r('score', 4)} AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
        FROM (SELECT cat AS source, 100 * (0.2 + 0.25 * (1 - AVG(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) / 8) + 0.15 * (1 - dup / COUNT(*))
            + 0.25 * greatest(0.0, (1 - AVG(CASE WHEN coalesce(v, 0) > 20 THEN 1.0 ELSE 0.0 END)) - 0.5 * 0.1) + 0.15)::DOUBLE AS score
          FROM dirty JOIN (SELECT cat, SUM(c - 1)::DOUBLE AS dup FROM (SELECT cat, COUNT(*) AS c FROM dirty GROUP BY {EVENT_KEYS}) GROUP BY cat) USING (cat) GROUP BY cat, dup)""",
    ),
)
def _score(spark, sf):
    df = t.dirty_events(spark, sf)
    keys = [c for c in df.columns if c != "seq"]
    parts = df.groupBy(*keys).agg(F.count("*").alias("c")).groupBy(F.col("cat").alias("source")).agg(
        (1 - F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)) / F.sum("c") / 8).alias("completeness"),
        (1 - F.sum(F.col("c") - 1) / F.sum("c")).alias("uniqueness"),
        (1 - F.sum(F.when(F.col("v") > 20, F.col("c")).otherwise(0)) / F.sum("c")).alias("validity"),
        F.lit(0.1).alias("mean_iqr_pct"),
    )
    out = q.quality_score(parts)
    return out.select("source", rounded("score", 4).alias("score"), "grade")


@query(
    "modelling_gate",
    sql_with(
        t.GAPPY,
        body=f"""SELECT level, code, "column", {r('value')} AS value FROM (
          SELECT 'warn' AS level, 'some_missing' AS code, '' AS "column", (COUNT(*) FILTER (gross IS NULL) + COUNT(*) FILTER (avg_disc IS NULL) + COUNT(*) FILTER (segment IS NULL))::DOUBLE / (COUNT(*) * 9) AS value FROM gappy
          UNION ALL SELECT 'warn', 'non_numeric', 'segment', 1.0 UNION ALL SELECT 'warn', 'non_numeric', 'split', 1.0
          UNION ALL SELECT 'warn', 'class_imbalance', 'target', AVG(target) FROM gappy WHERE (SELECT AVG(target) FROM gappy) < 0.10)""",
    ),
)
def _modelling(spark, sf):
    return q.modelling_gate(t.gappy_firms(spark, sf), "target", min_minority=0.10).withColumn("value", rounded("value"))


@query(
    "corpus_coverage",
    """SELECT source, n IS NOT NULL AS present, CASE WHEN n IS NOT NULL THEN 'PASS' WHEN status = 'success' THEN 'FAIL' ELSE 'WARN' END AS level,
      CASE WHEN n IS NOT NULL THEN 'stored' WHEN status = 'success' THEN 'reported success but nothing stored' WHEN status IS NOT NULL THEN 'last run: ' || status ELSE 'never run' END AS reason
    FROM (VALUES ('orders', 'success'), ('events', 'success'), ('filings', 'success'), ('news', 'failed'), ('macro', NULL)) m(source, status)
    LEFT JOIN (SELECT 'orders' AS source, COUNT(*) AS n FROM orders UNION ALL SELECT 'events', COUNT(*) FROM events) USING (source)""",
)
def _coverage(spark, sf):
    expected = spark.createDataFrame([("orders",), ("events",), ("macro",)], "source string")
    manifest = spark.createDataFrame(
        [("orders", "success"), ("events", "success"), ("filings", "success"), ("news", "failed")], "source string, status string"
    )
    present = sampling.union_all(
        [table(spark, sf, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("source"), "n_rows") for n in ("orders", "events")]
    )
    return q.corpus_coverage(expected, present, manifest)


@query(
    "row_floor_and_columns",
    "SELECT COUNT(*) AS n_rows, CASE WHEN COUNT(*) < 1000000000 THEN 'FAIL' ELSE 'PASS' END AS row_count_level, 'cik,concept' AS missing_columns, 'FAIL' AS schema_level FROM lineitem",
)
def _floor(spark, sf):
    return q.floor_and_columns(table(spark, sf, "lineitem"), 1_000_000_000, ["l_orderkey", "cik", "concept"])


@query(
    "key_health",
    sql_with(
        DIRTY,
        body=f"""SELECT nk AS null_keys, d AS duplicate_keys, CASE WHEN nk > 0 THEN 'FAIL' ELSE 'PASS' END AS null_level, CASE WHEN d > 0 THEN 'WARN' ELSE 'PASS' END AS duplicate_level
        FROM (SELECT (SELECT COUNT(*) FILTER (v IS NULL) FROM dirty) AS nk, {dup_sql('dirty', 'entity_id, date, v')} AS d)""",
    ),
)
def _keys(spark, sf):
    return q.key_health(t.dirty_events(spark, sf), ["entity_id", "date", "v"])


@query(
    "value_ranges",
    """SELECT 'l_quantity' AS feature, COUNT(*) FILTER (l_quantity < 5) AS below, 0::BIGINT AS above, MIN(l_quantity) AS observed_min, MAX(l_quantity) AS observed_max FROM lineitem
    UNION ALL SELECT 'l_discount', COUNT(*) FILTER (l_discount < 0.02), COUNT(*) FILTER (l_discount > 0.08), MIN(l_discount), MAX(l_discount) FROM lineitem
    UNION ALL SELECT 'l_tax', 0, COUNT(*) FILTER (l_tax > 0.05), MIN(l_tax), MAX(l_tax) FROM lineitem""",
)
def _ranges(spark, sf):
    return q.range_violations(table(spark, sf, "lineitem"), {"l_quantity": (5, None), "l_discount": (0.02, 0.08), "l_tax": (None, 0.05)})


@query(
    "infinite_columns",
    sql_with(
        DIRTY,
        body=" UNION ALL ".join(f"SELECT '{c}' AS feature, COUNT(*) FILTER (isinf({c}::DOUBLE)) AS n_infinite FROM dirty" for c in ["seq", "entity_id", "v", "v_inf"]),
    ),
)
def _inf(spark, sf):
    return q.infinite_columns(t.dirty_events(spark, sf))


@query(
    "freshness",
    """SELECT strftime(MAX(o_orderdate), '%Y-%m-%d') AS newest, floor((epoch(TIMESTAMP '2024-01-20') - epoch(MAX(o_orderdate))) / 86400)::BIGINT AS age_days,
      CASE WHEN floor((epoch(TIMESTAMP '2024-01-20') - epoch(MAX(o_orderdate))) / 86400) > 400 THEN 'WARN' ELSE 'PASS' END AS level FROM orders""",
)
def _fresh(spark, sf):
    return q.freshness(table(spark, sf, "orders"), "o_orderdate", 400, AS_OF_DATE)


@query(
    "ready_to_train",
    sql_with(
        t.GAPPY,
        body="""SELECT split, COUNT(*) AS n_rows, 0::BIGINT AS bad_labels,
          (COUNT(*) FILTER (gross IS NULL) + COUNT(*) FILTER (avg_disc IS NULL) + COUNT(*) FILTER (segment IS NULL))::BIGINT AS bad_cells,
          COUNT(*) FILTER (gross IS NULL) + COUNT(*) FILTER (avg_disc IS NULL) + COUNT(*) FILTER (segment IS NULL) = 0 AS ready
        FROM gappy GROUP BY split""",
    ),
)
def _ready(spark, sf):
    return q.ready_to_train(t.gappy_firms(spark, sf), "target")


@query(
    "payload_validation",
    sql_with(
        FIRMS,
        body="""SELECT entity_id AS id, feature, severity, issue FROM (
          SELECT entity_id, 'gross' AS feature, 'error' AS severity, 'no value for this feature' AS issue FROM firms WHERE entity_id % 7 = 0
          UNION ALL SELECT entity_id, 'colour', 'warning', 'not a feature of the model, left aside' FROM firms WHERE entity_id % 5 = 0
          UNION ALL SELECT entity_id, 'qty', 'error', 'not a finite number' FROM firms WHERE entity_id % 11 = 0
          UNION ALL SELECT entity_id, 'avg_disc', 'error', 'text where a number belongs' FROM firms WHERE entity_id % 13 = 0)""",
    ),
)
def _payload(spark, sf):
    k = F.col("entity_id")
    entries = F.array_compact(
        F.array(
            F.when(k % 7 != 0, F.struct(F.lit("gross").alias("key"), F.col("gross").cast("string").alias("value"))),
            F.struct(F.lit("qty").alias("key"), F.when(k % 11 == 0, "NaN").otherwise(F.col("qty").cast("string")).alias("value")),
            F.struct(F.lit("avg_disc").alias("key"), F.when(k % 13 == 0, "high").otherwise(F.col("avg_disc").cast("string")).alias("value")),
            F.when(k % 5 == 0, F.struct(F.lit("colour").alias("key"), F.lit("red").alias("value"))),
        )
    )
    payloads = t.firms(spark, sf).select(k.alias("id"), F.map_from_entries(entries).alias("features"))
    return q.payload_issues(payloads, PAYLOAD_FEATURES)


@query(
    "shared_entities",
    sql_with(
        MACRO, FIRMS,
        body="""SELECT source, COUNT(*) AS n_entities, (SELECT COUNT(*) FROM (SELECT CAST(o_custkey AS VARCHAR) AS e FROM orders INTERSECT SELECT CAST(entity_id AS VARCHAR) FROM firms INTERSECT SELECT CAST(user_id AS VARCHAR) FROM events)) AS n_common
        FROM (SELECT DISTINCT 'orders' AS source, CAST(o_custkey AS VARCHAR) AS e FROM orders UNION SELECT 'firms', CAST(entity_id AS VARCHAR) FROM firms UNION SELECT 'events', CAST(user_id AS VARCHAR) FROM events) GROUP BY source""",
    ),
)
def _shared(spark, sf):
    return sampling.shared_entities(
        {"orders": (table(spark, sf, "orders"), "o_custkey"), "firms": (t.firms(spark, sf), "entity_id"), "events": (table(spark, sf, "events"), "user_id")}
    )


@query("coerced_numbers", sql_with(DIRTY, body="SELECT seq, try_cast(v_text AS DOUBLE) AS number FROM dirty"))
def _numbers(spark, sf):
    return t.dirty_events(spark, sf).select("seq", to_number("v_text").alias("number"))


@query("coerced_dates", sql_with(DIRTY, body="SELECT seq, strftime(try_cast(date_text AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed FROM dirty"))
def _dates(spark, sf):
    return t.dirty_events(spark, sf).select("seq", F.date_format(to_time("date_text"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))
