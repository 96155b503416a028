"""A sample of the registered queries against their SQL on the smallest data."""
import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "dirty_events_table", "firm_features", "iqr_outlier_share", "series_gaps", "kendall_tau", "spearman_matrix", "winsorize", "impute_nearest_neighbours",
    "feature_generation", "selection_vote", "full_evaluation", "cumulative_lift", "batch_scoring", "time_split", "stratified_folds", "rolling_volatility",
    "company_facts", "coded_series", "column_shuffle", "nearest_neighbour_probe", "preparation_lineage", "stream_request_metrics", "corpus_cross_check", "corpus_cross_summary",
    "corpus_findings", "corpus_findings_summary", "corpus_entity_overlap", "ordinal_encode_many", "onehot_encode_many", "fit_naive_bayes", "fit_knn", "impute_median", "engineered_features",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_scores_every_firm(spark):
    out = entry.entry(spark).toPandas()
    assert len(out) == len(entry.queries()["firm_features"](spark, FOLDER).toPandas())
    assert set(out["risk_level"]) <= {"Low", "Medium", "High"} and out["id"].is_unique
