"""Whole runs: validation, preparation, exploration, feature engineering, streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.contracts import Contract
from ..functions.scalars import melt, rounded, signed_log
from ..operators import profile as pf
from ..operators import relations as rel
from ..operators import scoring
from ..session import new_path
from ..store import files
from ..store.tables import FeatureStore, content_hash
from ..streaming import scoring as stream
from . import crosscheck, exploration, featurerun, flows, validation
from . import tables as t
from .metric_queries import BAND, RISK
from .model_queries import scaled_firms, train_of
from .profile_queries import COHEN, FENCE, LONG, PAIRS, SHAPE
from .quality_queries import EVENTS, _fence_sql, dup_sql
from .registry import query
from .tables import AS_OF_DATE, AS_OF_YEAR, DIRTY, FEATURES, FIRMS, GAPPY, r, sql_with, table


def messy_firms(spark, sf):
    """gappy_firms with an ingest sequence, lost labels, one infinity class and repeats."""
    base = t.gappy_firms(spark, sf).drop("split").withColumn("seq", F.col("entity_id"))
    k = F.col("entity_id")
    base = base.withColumn("target", F.when(k % 61 != 0, F.col("target"))).withColumn("qty", F.when(k % 97 == 0, F.lit(float("inf"))).otherwise(F.col("qty")))
    return base.unionByName(base.filter(k % 41 == 0).withColumn("seq", F.col("seq") + F.lit(t.COPY_OFFSET)))


MESSY = GAPPY + ", messy AS (SELECT * FROM gappy UNION ALL SELECT * FROM gappy WHERE entity_id % 41 = 0), kept AS (SELECT * FROM messy WHERE entity_id % 61 <> 0 AND entity_id % 97 <> 0)"
KEPT_TRAIN = "(SELECT SUM(n - 2 * floor(n * 0.15 + 0.5))::BIGINT FROM (SELECT COUNT(DISTINCT entity_id) AS n FROM kept GROUP BY target))"


@query(
    "preparation_lineage",
    sql_with(
        MESSY,
        f"c AS (SELECT (SELECT COUNT(*) FROM messy) AS n, (SELECT COUNT(*) FROM kept) AS m, (SELECT COUNT(DISTINCT entity_id) FROM kept) AS u, {KEPT_TRAIN} AS k)",
        body="""SELECT step_order, step, rows_before, rows_after, rows_after - rows_before AS rows_delta, cols_delta FROM (
          SELECT 1 AS step_order, 'cleaning' AS step, n AS rows_before, m AS rows_after, 0 AS cols_delta FROM c UNION ALL SELECT 2, 'duplicates', m, u, 0 FROM c
          UNION ALL SELECT 3, 'imputation', k, k, 0 FROM c UNION ALL SELECT 4, 'outliers', k, k, 0 FROM c UNION ALL SELECT 5, 'encoding', k, k, 4 FROM c UNION ALL SELECT 6, 'scaling', k, k, 0 FROM c)""",
    ),
)
def _lineage(spark, sf):
    _, trail, _ = flows.prepare(messy_firms(spark, sf), "target", "entity_id", "seq")
    return trail.table(spark).select("step_order", "step", "rows_before", "rows_after", "rows_delta", "cols_delta")


@query(
    "preparation_totals",
    sql_with(MESSY, body="SELECT 6::BIGINT AS n_steps, 6::BIGINT AS n_applied, (SELECT COUNT(*) FROM messy) - (SELECT COUNT(DISTINCT entity_id) FROM kept) AS rows_removed, 4::BIGINT AS cols_added, 0::BIGINT AS cols_removed"),
)
def _totals(spark, sf):
    _, trail, _ = flows.prepare(messy_firms(spark, sf), "target", "entity_id", "seq")
    return flows.lineage_totals(trail.table(spark))


def _chain(step: str, source: str, expr) -> str:
    """One fitted step over all feature columns: statistics from the train rows of ``source``."""
    return f"{step} AS MATERIALIZED (SELECT entity_id, split, segment, {', '.join(f'{expr(c)} AS {c}' for c in FEATURES)} FROM {source})"


def _train(fn: str, source: str) -> str:
    return f"(SELECT {fn} FROM {source} WHERE split = 'train')"


PREPARED = [
    MESSY,
    """uniq AS (SELECT DISTINCT entity_id, segment, n_orders, gross, qty, avg_disc, return_rate, target FROM kept)""",
    """cut AS MATERIALIZED (SELECT *, CASE WHEN rn <= floor(n * 0.15 + 0.5) THEN 'test' WHEN rn <= 2 * floor(n * 0.15 + 0.5) THEN 'val' ELSE 'train' END AS split FROM (
      SELECT *, COUNT(*) OVER (PARTITION BY target) AS n, ROW_NUMBER() OVER (PARTITION BY target ORDER BY CAST('0x' || substr(md5('42:' || CAST(entity_id AS VARCHAR)), 1, 8) AS BIGINT), entity_id) AS rn FROM uniq))""",
    _chain("filled", "cut", lambda c: f"coalesce({c}, {_train(f'quantile_cont({c}, 0.5)', 'cut')})"),
    _chain("bounded", "filled", lambda c: f"least(greatest({c}, {_train(f'quantile_cont({c}, 0.01)', 'filled')}), {_train(f'quantile_cont({c}, 0.99)', 'filled')})"),
    """coded AS MATERIALIZED (SELECT b.*, CAST(coalesce(v.code, -1) AS DOUBLE) AS seg FROM (SELECT *, coalesce(segment, (SELECT segment FROM cut WHERE split = 'train' AND segment IS NOT NULL GROUP BY segment ORDER BY COUNT(*) DESC, segment LIMIT 1)) AS s FROM bounded) b
      LEFT JOIN (SELECT segment, ROW_NUMBER() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM cut WHERE split = 'train' AND segment IS NOT NULL)) v ON b.s = v.segment)""",
]


def _robust(c: str, out: str) -> str:
    q = lambda p: _train(f"quantile_cont({c}, {p})", "coded")
    spread = f"CASE WHEN {q(0.75)} = {q(0.25)} THEN 1 ELSE {q(0.75)} - {q(0.25)} END"
    return f"{r(f'({c} - {q(0.5)}) / ({spread})')} AS {out}"


@query(
    "prepared_table",
    sql_with(*PREPARED, body=f"SELECT entity_id, split, {', '.join(_robust(c, c) for c in FEATURES)}, {_robust('seg', 'segment')} FROM coded"),
)
def _prepared(spark, sf):
    out, _, _ = flows.prepare(messy_firms(spark, sf), "target", "entity_id", "seq", encode="ordinal", scale="robust")
    return out.select("entity_id", "split", *[rounded(c).alias(c) for c in FEATURES + ["segment"]])


@query(
    "prepared_rows_kept",
    sql_with(
        *PREPARED[:4],
        body="SELECT entity_id, split FROM filled WHERE NOT (split = 'train' AND ("
        + " OR ".join(f"abs({c} - {_train(f'AVG({c})', 'filled')}) / {_train(f'stddev_pop({c})', 'filled')} > 5" for c in FEATURES) + "))",
    ),
)
def _rows_kept(spark, sf):
    out, _, _ = flows.prepare(messy_firms(spark, sf), "target", "entity_id", "seq", clip="zscore_rows")
    return out.select("entity_id", "split")


@query("prepared_by_neighbours_and_forest")
def _by_neighbours(spark, sf):
    _, trail, _ = flows.prepare(messy_firms(spark, sf), "target", "entity_id", "seq", impute="nearest", clip="isolation_forest")
    return trail.table(spark)


@query(
    "stored_splits_check",
    sql_with(
        FIRMS,
        body="""SELECT split, COUNT(*) FILTER (split <> 'val' OR entity_id % 9 <> 0) AS n_rows, 0::BIGINT AS bad_labels, 0::BIGINT AS bad_cells, split <> 'test' AS same_columns, split <> 'val' AS same_hash, split = 'train' AS ready
        FROM firms GROUP BY split""",
    ),
)
def _stored_splits(spark, sf):
    """Rows of val are lost after its hash was noted, and test is written without a column."""
    folder, noted = new_path(spark, "splits"), {}
    for name in ("train", "val", "test"):
        df = t.firms(spark, sf).filter(F.col("split") == name).drop("split")
        df = df.drop("return_rate") if name == "test" else df
        noted[name] = content_hash(df)
        (df.filter("entity_id % 9 <> 0") if name == "val" else df).write.parquet(f"{folder}/{name}.parquet")
    return flows.check_stored_splits(spark, folder, "target", noted)


def _explored(spark, sf):
    df = t.firms(spark, sf)
    return (
        pf.distribution_shape(df, FEATURES, 0.3, 0.5), rel.correlation_pairs(df, FEATURES), rel.variance_inflation(df, FEATURES), rel.cohens_d(df, "target", FEATURES),
    )


@query(
    "exploration_hints",
    sql_with(
        FIRMS, LONG, SHAPE, COHEN, PAIRS,
        body="""SELECT 'skewed' AS kind, feature AS value FROM shape WHERE abs(sk) >= 0.3 UNION ALL SELECT 'discriminative', feature FROM cohen
        UNION ALL SELECT 'pair', feature_a || '~' || feature_b FROM pairs WHERE abs(r) >= 0.8""",
    ),
)
def _hints(spark, sf):
    h = flows.hints_from_tables(*_explored(spark, sf))
    rows = [("skewed", c) for c in h["skewed_features"]] + [("discriminative", c) for c in h["top_discriminative"]]
    rows += [("pair", f"{a}~{b}") for a, b, _ in h["high_correlation_pairs"]]
    return spark.createDataFrame(rows, "kind string, value string")


@query(
    "insights",
    sql_with(
        GAPPY, "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM gappy WHERE {c} IS NOT NULL" for c in FEATURES) + ")", SHAPE, PAIRS,
        "s AS (SELECT round_even(greatest(p, n - p)::DOUBLE / least(p, n - p) * 1e3, 0) / 1e3 AS ratio, miss * 100.0 / (n * 9) AS pct FROM (SELECT COUNT(*) AS n, SUM(target) AS p, COUNT(*) FILTER (gross IS NULL) + COUNT(*) FILTER (avg_disc IS NULL) + COUNT(*) FILTER (segment IS NULL) AS miss FROM gappy))",
        "f AS (SELECT COUNT(*) FILTER (abs(sk) >= 0.3) AS sk, COUNT(*) FILTER (ku >= 0.5) AS ku FROM shape)",
        "p AS (SELECT COUNT(*) FILTER (abs(r) >= 0.8) AS n FROM pairs)",
        body="""SELECT rule, severity, category, message FROM (
          SELECT 0 AS rule, 'critical' AS severity, 'class_imbalance' AS category, 'severe class imbalance ' || ratio || ':1' AS message FROM s WHERE ratio >= 5
          UNION ALL SELECT 1, 'warning', 'class_imbalance', 'moderate class imbalance ' || ratio || ':1' FROM s WHERE ratio >= 2 AND ratio < 5
          UNION ALL SELECT 3, 'warning', 'data_quality', '3 features have missing values' FROM s WHERE pct >= 5
          UNION ALL SELECT 4, 'warning', 'feature_distribution', sk || ' features highly skewed, ' || ku || ' heavy-tailed' FROM f WHERE sk > 0
          UNION ALL SELECT 5, 'warning', 'multicollinearity', n || ' correlated pairs, 0 features with high inflation' FROM p WHERE n > 0)""",
    ),
)
def _insights(spark, sf):
    df = t.gappy_firms(spark, sf)
    shape = pf.distribution_shape(df, FEATURES, 0.3, 0.5).agg(F.count_if("highly_skewed").alias("s"), F.count_if("heavy_tailed").alias("h")).first()
    pairs = rel.high_pairs(rel.correlation_pairs(t.firms(spark, sf), FEATURES), 0.8).count()
    missing = pf.missing_counts(df).agg(F.count_if(F.col("missing") > 0).alias("f"), (F.sum("missing") * 100.0 / F.sum("n")).alias("p")).first()
    summary = pf.target_summary(df, "target").select("imbalance_ratio").withColumns(
        {
            "n_features_with_missing": F.lit(missing["f"]), "overall_missing_pct": F.lit(missing["p"]),
            "n_highly_skewed": F.lit(shape["s"]), "n_heavy_tailed": F.lit(shape["h"]), "n_high_pairs": F.lit(pairs),
        }
    )
    return flows.insights(summary)


@query("exploration_run")
def _explore(spark, sf):
    """All analyzers; their status, and the table each wrote, read back from the report."""
    folder = new_path(spark, "exploration")
    exploration.write_report(t.firms(spark, sf).drop("split"), "target", "entity_id", folder)
    rows = exploration.load_report(spark, folder)["analyzers"]
    return spark.createDataFrame([(a["analyzer"], a["status"], a["error"], a["table"] is not None) for a in rows], "analyzer string, status string, error string, written boolean")


# Analyzers whose part of the report SQL can tell; inflation, components and anomalies it cannot.
REPORTED = ["target", "missing", "outliers", "distributions", "correlation", "ratios", "relationships"]
AUC = """auc AS (SELECT feature, abs((SUM(CASE WHEN target = 1 THEN rk END) - p * (p + 1) / 2.0) / (p * (n - p)::DOUBLE) - 0.5) * 2 AS sep FROM (
  SELECT feature, target, rank() OVER (PARTITION BY feature ORDER BY value) + (COUNT(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk,
    SUM(target) OVER (PARTITION BY feature) AS p, COUNT(*) OVER (PARTITION BY feature) AS n FROM long) GROUP BY feature, p, n)"""


@query(
    "exploration_insights",
    sql_with(
        FIRMS, LONG, SHAPE, PAIRS, COHEN, AUC, FENCE,
        """found AS (
          SELECT 0 AS rule, 'critical' AS severity, 'class_imbalance' AS category, 'severe class imbalance ' || q || ':1' AS message FROM (SELECT round_even(greatest(p, n - p)::DOUBLE / least(p, n - p) * 1e3, 0) / 1e3 AS q FROM (SELECT COUNT(*) AS n, SUM(target) AS p FROM firms)) WHERE q >= 5
          UNION ALL SELECT 1, 'warning', 'class_imbalance', 'moderate class imbalance ' || q || ':1' FROM (SELECT round_even(greatest(p, n - p)::DOUBLE / least(p, n - p) * 1e3, 0) / 1e3 AS q FROM (SELECT COUNT(*) AS n, SUM(target) AS p FROM firms)) WHERE q >= 2 AND q < 5
          UNION ALL SELECT 2, 'info', 'data_quality', 'no missing values'
          UNION ALL SELECT 4, 'warning', 'feature_distribution', s || ' features highly skewed, ' || h || ' heavy-tailed' FROM (SELECT COUNT(*) FILTER (abs(sk) >= 1) AS s, COUNT(*) FILTER (ku >= 3) AS h FROM shape) WHERE s > 0
          UNION ALL SELECT 5, 'warning', 'multicollinearity', n || ' correlated pairs, 0 features with high inflation' FROM (SELECT COUNT(*) AS n FROM pairs WHERE abs(r) >= 0.8) WHERE n > 0
          UNION ALL SELECT 6, 'warning', 'outliers', 'mean outlier share ' || printf('%.1f', m) || ' %' FROM (SELECT AVG(pct) AS m FROM (SELECT round_even(COUNT(*) FILTER (value < lo OR value > hi) * 100.0::DOUBLE / COUNT(*) * 1e4, 0) / 1e4 AS pct FROM long JOIN fence USING (feature) GROUP BY feature)) WHERE m >= 5
          UNION ALL SELECT 8, 'info', 'financial_signal', 'most discriminative: ' || (SELECT feature FROM cohen ORDER BY abs(d) DESC, feature LIMIT 1)
          UNION ALL SELECT 9, 'info', 'financial_signal', 'strongest category: ' || (SELECT category FROM cohen GROUP BY category ORDER BY AVG(abs(d)) DESC, category LIMIT 1)
          UNION ALL SELECT 10, 'info', 'predictive_power', 'strongest predictor: ' || (SELECT feature FROM auc ORDER BY sep DESC, feature LIMIT 1)
          UNION ALL SELECT 11, 'warning', 'predictive_power', 'features separate the classes only weakly' FROM (SELECT AVG(sep) AS s FROM auc) WHERE s < 0.05)""",
        body="""SELECT rule, severity, category, message, message = coalesce((SELECT message FROM found WHERE severity <> 'info' ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, rule LIMIT 1), '') AS headline FROM found""",
    ),
)
def _report(spark, sf):
    folder = new_path(spark, "exploration")
    exploration.write_report(t.firms(spark, sf).drop("split"), "target", "entity_id", folder, only=REPORTED)
    said = exploration.load_report(spark, folder)["insights"]
    rows = [(i["rule"], i["severity"], i["category"], i["message"], i["message"] == said["headline"]) for i in said["items"]]
    return spark.createDataFrame(rows, "rule int, severity string, category string, message string, headline boolean")


_runs: dict[tuple, tuple] = {}


def feature_run(spark, sf):
    """The whole feature run over the scaled firms, all stages and defaults, once per application: rows, record, store."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _runs:
        folder = new_path(spark, "explored")
        exploration.write_report(t.firms(spark, sf).drop("split"), "target", "entity_id", folder, only=["distributions", "correlation", "inflation", "ratios"])
        store = FeatureStore(spark, new_path(spark, "features"))
        _runs[key] = (*featurerun.run_features(scaled_firms(spark, sf), "target", ["entity_id"], store, exploration.load_hints(spark, folder)), store)
    return _runs[key]


@query("feature_lineage")
def _features(spark, sf):
    return featurerun.lineage(spark, feature_run(spark, sf)[1]["state"])


@query("feature_importance")
def _feature_importance(spark, sf):
    return featurerun.importance(spark, feature_run(spark, sf)[1]["state"])


@query("replayed_features", sql_with(FIRMS, body="SELECT split, COUNT(*) AS n_rows, COUNT(*) AS n_equal, 0::BIGINT AS n_gaps FROM firms GROUP BY split"))
def _replayed(spark, sf):
    """The stored version's document applied to the firms again, held against the rows stored with it."""
    rows, record, store = feature_run(spark, sf)
    names = record["features"]
    again = featurerun.replay_version(scaled_firms(spark, sf), store)
    both = rows.alias("a").join(again.alias("b"), "entity_id")
    equal = F.forall(F.array(*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in names]), lambda x: x)
    gap = F.exists(F.array(*[F.col(f"b.{c}") for c in names]), lambda x: x.isNull() | F.isnan(x))
    return both.groupBy(F.col("a.split").alias("split")).agg(F.count("*").alias("n_rows"), F.count_if(equal).alias("n_equal"), F.count_if(gap).alias("n_gaps"))


# Every generated column in SQL, in the order of the plan.
_COMBINED = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
GENERATED = (
    {f"log__{c}": f"sign({c}) * ln(1 + abs({c}))" for c in FEATURES}
    | {f"ratio__{a}__over__{b}": f"{a} / (CASE WHEN {b} <> 0 THEN {b} END + 1e-9::DOUBLE)" for a, b in _COMBINED}
    | {f"mul__{a}__x__{b}": f"{a} * {b}" for a, b in _COMBINED}
    | {f"diff__{a}__minus__{b}": f"{a} - {b}" for a, b in _COMBINED}
    | {f"poly__{c}__pow2": f"{c} * {c}" for c in FEATURES}
)
RELEVANCE = 0.02


@query(
    "engineered_features",
    sql_with(
        FIRMS,
        "made AS MATERIALIZED (SELECT entity_id, split, target, " + ", ".join([*FEATURES, *[f"{e} AS {c}" for c, e in GENERATED.items()]]) + " FROM firms)",
        "mid AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in GENERATED) + " FROM made WHERE split = 'train')",
        "filled AS MATERIALIZED (SELECT made.entity_id, made.split, made.target, " + ", ".join([*[f"made.{c} AS {c}" for c in FEATURES], *[f"coalesce(made.{c}, mid.{c}) AS {c}" for c in GENERATED]]) + " FROM made, mid)",
        "cells AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT entity_id, split, target, '{c}' AS feature, {c} AS value FROM filled" for c in [*FEATURES, *GENERATED]) + ")",
        "worth AS (SELECT feature, coalesce(abs(corr(value, target)), 0) AS r FROM cells WHERE split = 'train' GROUP BY feature HAVING var_samp(value) > 1e-8)",
        f"kept AS (SELECT feature FROM worth QUALIFY CASE WHEN COUNT(*) FILTER (r >= {RELEVANCE}) OVER () > 0 THEN r >= {RELEVANCE} ELSE ROW_NUMBER() OVER (ORDER BY r DESC, feature DESC) <= 5 END)",
        body=f"SELECT entity_id, split, feature, {r('sign(value) * ln(1 + abs(value))')} AS value FROM cells JOIN kept USING (feature)",
    ),
)
def _engineered(spark, sf):
    """Rows of a run by variance and relevance, a row per feature that stayed; values on a logarithmic scale."""
    hints = {"top_discriminative": FEATURES, "skewed_features": FEATURES}
    settings = featurerun.Settings(correlation=None, inflation=None, relevance=RELEVANCE, min_votes=None, eliminate_to=None, forest_trees=None, reduction=None, importance_trees=None)
    out, record = featurerun.run_features(t.firms(spark, sf), "target", ["entity_id"], FeatureStore(spark, new_path(spark, "features")), hints, settings)
    cells = melt(out, record["features"], ["entity_id", "split"])
    return cells.select("entity_id", "split", "feature", rounded(signed_log("value")).alias("value"))


@query("corpus_validation")
def _corpus(spark, sf):
    folder = new_path(spark, "corpus")
    t.dirty_events(spark, sf).write.parquet(f"{folder}/events.parquet")
    t.facts_long(spark, sf).write.parquet(f"{folder}/sec_edgar.parquet")
    spark.createDataFrame([("not parquet",)], "value string").write.text(f"{folder}/broken.parquet")
    out = flows.validate_corpus(spark, folder, AS_OF_DATE, AS_OF_YEAR, contracts={"events": EVENTS})
    return out.select("source", "n_rows", rounded("score", 2).alias("score"), "grade", F.col("load_error").isNotNull().alias("failed"))


CROSSED = {
    c.source: c
    for c in (
        Contract(
            "events", required={"entity_id": "integer", "date": "datetime", "v": "numeric", "region": "string"}, optional={"v_text": "numeric"},
            entity="entity_id", dates=("date",), series_keys=("entity_id",), keys=("entity_id", "date", "v"), ranges={"v": (0.5, 20.0), "v_inf": (None, 1e9)}, freshness_days=400,
        ),
        Contract("orders", required={"o_orderkey": "integer"}, dates=("o_orderdate",), keys=("o_custkey",), min_rows=10**9, ranges={"o_totalprice": (2000.0, None)}, freshness_days=400),
        Contract("customer", required={"c_custkey": "integer"}, keys=("c_custkey",), ranges={"c_acctbal": (-1e9, 1e9)}),
        Contract("prices"),
        Contract("rates"),
        Contract("unread"),
    )
}
MANIFEST = {"prices": "success", "rates": "failed", "events": "success"}

_AGE = "floor((epoch(TIMESTAMP '{as_of}') - epoch(MAX({date}))) / 86400)"
CROSS = (
    DIRTY,
    "cross0 AS ("
    + " UNION ALL ".join(
        f"SELECT '{source}' AS source, '{check}' AS check_name, '{level}' AS level, '{column}' AS col, ({value})::DOUBLE AS value"
        for source, check, level, column, value in (
            ("events", "kind", "WARN", "v_text", "1"),
            ("events", "schema", "FAIL", "region", "1"),
            ("events", "key_nulls", "FAIL", "v", "SELECT COUNT(*) FILTER (v IS NULL) FROM dirty"),
            ("events", "key_uniqueness", "WARN", "entity_id,date,v", f"SELECT {dup_sql('dirty', 'entity_id, date, v')}"),
            ("events", "value_range", "FAIL", "v", "SELECT COUNT(*) FILTER (v < 0.5 OR v > 20) FROM dirty"),
            ("events", "value_range", "FAIL", "v_inf", "SELECT COUNT(*) FILTER (v_inf > 1e9) FROM dirty"),
            ("events", "infinities", "FAIL", "v_inf", "SELECT COUNT(*) FILTER (isinf(v_inf)) FROM dirty"),
            ("events", "freshness", "WARN", "date", f"SELECT CASE WHEN age > 400 THEN age ELSE 0 END FROM (SELECT {_AGE.format(as_of=AS_OF_DATE, date='date')} AS age FROM dirty)"),
            ("events", "time_order", "WARN", "date", "SELECT COUNT(DISTINCT entity_id) FROM (SELECT entity_id, date < LAG(date) OVER (PARTITION BY entity_id ORDER BY seq) AS back FROM dirty) WHERE back"),
            ("orders", "row_count", "FAIL", "", "SELECT COUNT(*) FROM orders"),
            ("orders", "key_uniqueness", "WARN", "o_custkey", "SELECT COUNT(*) - COUNT(DISTINCT o_custkey) FROM orders"),
            ("orders", "value_range", "FAIL", "o_totalprice", "SELECT COUNT(*) FILTER (o_totalprice < 2000) FROM orders"),
            ("orders", "freshness", "WARN", "o_orderdate", f"SELECT CASE WHEN age > 400 THEN age ELSE 0 END FROM (SELECT {_AGE.format(as_of=AS_OF_DATE, date='o_orderdate')} AS age FROM orders)"),
            ("customer", "key_uniqueness", "WARN", "c_custkey", "SELECT COUNT(*) - COUNT(DISTINCT c_custkey) FROM customer"),
        )
    )
    + "".join(
        f" UNION ALL SELECT '{source}', 'far_out', 'WARN', feature, pct FROM ({_fence_sql(cte, columns, 3.0)}) WHERE pct > 0.2"
        for source, cte, columns in (("events", "dirty", ["v_inf"]), ("orders", "orders", ["o_orderkey", "o_totalprice"]), ("customer", "customer", ["c_nationkey", "c_acctbal"]))
    )
    + ")",
    """crossed AS (SELECT source, check_name, level, col, CASE WHEN check_name NOT IN ('schema', 'kind') THEN value END AS value FROM cross0 WHERE value > 0
      UNION ALL SELECT s, 'summary', 'PASS', '', NULL FROM (VALUES ('events'), ('orders'), ('customer')) x(s) WHERE s NOT IN (SELECT source FROM cross0 WHERE value > 0)
      UNION ALL SELECT * FROM (VALUES ('prices', 'coverage', 'FAIL', '', NULL), ('rates', 'coverage', 'WARN', '', NULL), ('unread', 'readable', 'FAIL', '', NULL)))""",
)


def _cross(spark, sf):
    folder = new_path(spark, "crossed")
    t.dirty_events(spark, sf).write.parquet(f"{folder}/events.parquet")
    table(spark, sf, "orders").write.parquet(f"{folder}/orders.parquet")
    table(spark, sf, "customer").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([("not parquet",)], "value string").write.text(f"{folder}/unread.parquet")
    return crosscheck.cross_check(spark, folder, AS_OF_DATE, CROSSED, MANIFEST, {"events": "seq"})


@query("corpus_cross_check", sql_with(*CROSS, body='SELECT source, check_name AS "check", level, col AS "column", value FROM crossed'))
def _cross_findings(spark, sf):
    return _cross(spark, sf)


@query(
    "corpus_cross_summary",
    sql_with(
        *CROSS,
        body="""SELECT source, COUNT(*) FILTER (level = 'FAIL') AS n_fail, COUNT(*) FILTER (level = 'WARN') AS n_warn,
          CASE WHEN bool_or(level = 'FAIL') THEN 'FAIL' WHEN bool_or(level = 'WARN') THEN 'WARN' ELSE 'PASS' END AS worst FROM crossed GROUP BY source""",
    ),
)
def _cross_worst(spark, sf):
    return crosscheck.cross_summary(_cross(spark, sf))


@query(
    "corpus_entity_overlap",
    """WITH u AS (SELECT DISTINCT 'events' AS source, user_id AS e FROM events UNION ALL SELECT DISTINCT 'orders', o_custkey FROM orders UNION ALL SELECT DISTINCT 'customer', c_custkey FROM customer)
    SELECT 'entity_size' AS "check", 'PASS' AS level, source, COUNT(*) AS value FROM u GROUP BY source
    UNION ALL SELECT 'entity_overlap', CASE WHEN COUNT(*) > 0 THEN 'PASS' ELSE 'WARN' END, 'customer,events,orders', COUNT(*) FROM (SELECT e FROM u GROUP BY e HAVING COUNT(*) = 3)
    UNION ALL SELECT 'corpus', 'PASS', '', 3""",
)
def _overlap(spark, sf):
    folder = new_path(spark, "overlap")
    for name in ("events", "orders", "customer"):
        table(spark, sf, name).write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([("not parquet",)], "value string").write.text(f"{folder}/unread.parquet")
    keys = {"events": "user_id", "orders": "o_custkey", "customer": "c_custkey"}
    return crosscheck.corpus_checks(spark, folder, {s: Contract(s, entity=k) for s, k in keys.items()})


WATCHED = {
    c.source: c
    for c in (
        Contract(
            "events", required={"entity_id": "integer", "date": "datetime", "v": "numeric", "region": "string"}, optional={"v_text": "numeric", "note": "string", "cat": "string"},
            entity="entity_id", dates=("date",), series_keys=("entity_id",), positive=("v_text",), nonneg=("v",), ratio_bounds={"v": (0.0, 20.0)},
        ),
        Contract("customer", required={"c_custkey": "integer"}, dynamic=True),
        Contract("rates"),
    )
}
_MISSED = "SELECT '{s}' AS source, 'missing' AS check_name, CASE WHEN m >= 0.9 * n AND {required} THEN 'required_column_mostly_missing' WHEN m >= 0.3 * n THEN 'columns_with_high_missingness' ELSE 'some_missing' END AS code, CASE WHEN m >= 0.9 * n AND {required} THEN 'error' WHEN m >= 0.3 * n THEN 'warn' ELSE 'info' END AS level, '{c}' AS col, m::DOUBLE AS value FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER ({c} IS NULL) AS m FROM {t}) WHERE m > 0"
_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
WATCH = (
    DIRTY,
    f"""steps AS (SELECT entity_id, (epoch(date) - epoch(LAG(date) OVER (PARTITION BY entity_id ORDER BY date))) AS step FROM (SELECT DISTINCT entity_id, date FROM dirty WHERE date IS NOT NULL)),
  gaps AS (SELECT entity_id FROM (SELECT entity_id, step, quantile_cont(step, 0.5) OVER (PARTITION BY entity_id) AS med, COUNT(step) OVER (PARTITION BY entity_id) AS n FROM steps WHERE step IS NOT NULL) WHERE n >= 2 AND med > 0 AND step > 3 * med GROUP BY entity_id)""",
    "watch0 AS ("
    + " UNION ALL ".join(
        [
            f"SELECT 'events' AS source, '{check}' AS check_name, '{code}' AS code, '{level}' AS level, '{column}' AS col, ({value})::DOUBLE AS value"
            for check, code, level, column, value in (
                ("financial", "negative_value", "error", "v", "SELECT COUNT(*) FILTER (v < 0) FROM dirty"),
                ("financial", "nonpositive_value", "error", "v_text", "SELECT COUNT(*) FILTER (TRY_CAST(v_text AS DOUBLE) <= 0) FROM dirty"),
                ("financial", "impossible_ratio", "warn", "v", "SELECT COUNT(*) FILTER (v < 0 OR v > 20) FROM dirty"),
                ("financial", "future_date", "error", "date", f"SELECT COUNT(*) FILTER (date > TIMESTAMP '{AS_OF_DATE}' + INTERVAL 2 DAY) FROM dirty"),
                ("duplicates", "duplicate_rows", "warn", "", f"SELECT {dup_sql('dirty', 'entity_id, date, v, cat, v_text, date_text, v_inf')}"),
                ("duplicates", "duplicate_entity_timestamps", "warn", "entity_id,date", f"SELECT {dup_sql('dirty', 'entity_id, date')}"),
                ("timeseries", "unparseable_timestamps", "warn", "date", "SELECT COUNT(*) FILTER (date IS NULL) FROM dirty"),
                ("timeseries", "not_chronological", "warn", "date", "SELECT COUNT(DISTINCT entity_id) FROM (SELECT entity_id, date < LAG(date) OVER (PARTITION BY entity_id ORDER BY seq) AS back FROM dirty) WHERE back"),
                ("timeseries", "duplicate_timestamps", "warn", "date", "SELECT COUNT(*) - COUNT(DISTINCT (entity_id, date)) FROM dirty WHERE date IS NOT NULL"),
                ("timeseries", "time_gaps", "info", "date", "SELECT COUNT(*) FROM gaps"),
            )
        ]
        + [_MISSED.format(s="events", t="dirty", c=c, required="TRUE" if c in ("entity_id", "date", "v") else "FALSE") for c in ("entity_id", "date", "v", "cat", "v_text", "date_text", "v_inf")]
        + [_MISSED.format(s="customer", t="customer", c=c, required="TRUE" if c == "c_custkey" else "FALSE") for c in _CUSTOMER]
        + [f"SELECT '{s}', 'outliers', 'iqr_outliers', 'warn', feature, pct FROM ({_fence_sql(cte, cols, 1.5)}) WHERE pct > 0.1" for s, cte, cols in (("events", "dirty", ["v", "v_inf"]), ("customer", "customer", ["c_custkey", "c_nationkey", "c_acctbal"]))]
    )
    + ")",
    """watch1 AS (SELECT * FROM watch0 WHERE value > 0
      UNION ALL SELECT 'events', 'schema', code, level, col, NULL FROM (VALUES ('missing_required_columns', 'error', 'region'), ('missing_optional_columns', 'info', 'note'), ('unexpected_columns', 'warn', 'date_text'), ('unexpected_columns', 'warn', 'v_inf'), ('dtype_mismatch', 'warn', 'v_text')) x(code, level, col)
      UNION ALL SELECT 'customer', 'schema', 'unexpected_columns', 'info', column_name, NULL FROM (DESCRIBE customer) WHERE column_name <> 'c_custkey'),
  watched AS (SELECT * FROM watch1 UNION ALL SELECT s, c, 'ok', 'info', '', NULL FROM (VALUES ('events'), ('customer')) a(s), (VALUES ('schema'), ('missing'), ('duplicates'), ('financial'), ('outliers'), ('timeseries')) b(c)
      WHERE NOT EXISTS (SELECT 1 FROM watch1 w WHERE w.source = s AND w.check_name = c))""",
)


def _watched(spark, sf):
    folder = new_path(spark, "watched")
    t.dirty_events(spark, sf).write.parquet(f"{folder}/events.parquet")
    table(spark, sf, "customer").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([("not parquet",)], "value string").write.text(f"{folder}/unread.parquet")
    return (*validation.validate_folder(spark, folder, AS_OF_DATE, AS_OF_YEAR, WATCHED, order={"events": "seq"}, reports=f"{folder}/reports"), folder)


@query("corpus_findings", sql_with(*WATCH, body='SELECT source, check_name AS "check", code, level, col AS "column", value FROM watched'))
def _watch_findings(spark, sf):
    return _watched(spark, sf)[0]


@query(
    "corpus_findings_summary",
    sql_with(
        *WATCH,
        body="""SELECT s.source, s.present, n_rows, coalesce(n_errors, 0)::INTEGER AS n_errors, coalesce(n_warnings, 0)::INTEGER AS n_warnings, s.present AND NOT s.failed AND coalesce(n_errors, 0) = 0 AS is_valid, s.failed
          FROM (VALUES ('events', TRUE, FALSE), ('customer', TRUE, FALSE), ('rates', FALSE, FALSE), ('unread', TRUE, TRUE)) s(source, present, failed)
          LEFT JOIN (SELECT source, COUNT(*) FILTER (level = 'error') AS n_errors, COUNT(*) FILTER (level = 'warn') AS n_warnings FROM watched GROUP BY source) w USING (source)
          LEFT JOIN (SELECT 'events' AS source, COUNT(*) AS n_rows FROM dirty UNION ALL SELECT 'customer', COUNT(*) FROM customer) c USING (source)""",
    ),
)
def _watch_summary(spark, sf):
    """The summary as it was written, read back."""
    _, summary, folder = _watched(spark, sf)
    written = files.read_json(spark, f"{folder}/reports/_summary.json")
    rows = [(d["source"], d["present"], d["n_rows"], d["n_errors"], d["n_warnings"], d["is_valid"], d["load_error"] is not None) for d in written["datasets"]]
    return spark.createDataFrame(rows, "source string, present boolean, n_rows bigint, n_errors int, n_warnings int, is_valid boolean, failed boolean")


# ---------------------------------------------------------------- streams
@query(
    "stream_scoring",
    f"""SELECT id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, {RISK} AS risk_score, {BAND.format(RISK)} AS risk_level
    FROM (SELECT event_id AS id, least(value, 100.0) / 100.0::DOUBLE AS p FROM events)""",
)
def _stream(spark, sf):
    events = stream.file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    rows = events.select(F.col("event_id").alias("id"), (F.least("value", F.lit(100.0)) / 100.0).alias("p"))
    scored = scoring.score(rows, "p", 0.5, "v001", "stream", F.lit("2024-01-20T00:00:00"))
    return stream.run_available(scored, "scored").select("id", "prediction", "risk_score", "risk_level")


@query(
    "stream_request_metrics",
    """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) FILTER (event_type <> 'purchase') AS request_count, coalesce(CAST(SUM(user_id % 5 + 1) FILTER (event_type = 'purchase') AS BIGINT), 0) AS prediction_count,
      COUNT(*) FILTER (event_type = 'error') AS error_count, round_even(coalesce(AVG(value) FILTER (event_type <> 'purchase'), 0) * 1e3::DOUBLE, 0) / 1e3::DOUBLE AS avg_latency_ms
    FROM events GROUP BY time_bucket(INTERVAL 6 HOUR, ts) HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def _stream_metrics(spark, sf):
    ev = stream.file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    log = ev.select(
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "prediction").otherwise("request").alias("kind"),
        F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("is_error"), (F.col("user_id") % 5 + 1).alias("predictions"), (F.col("value") / 2).alias("inference_ms"),
    )
    out = stream.run_available(stream.windowed_requests(log, width="6 hours"), "requests")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "request_count", "prediction_count", "error_count", "avg_latency_ms")
