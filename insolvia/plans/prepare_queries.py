"""Learned preparation fitted on the train split and applied to every split."""
from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, rounded
from ..operators import neighbors as nb
from ..operators import prepare as p
from . import tables as t
from .registry import query
from .tables import DIRTY, FEATURES, FIRMS, GAPPY, r, sql_with

TRAIN = "train AS (SELECT * FROM firms WHERE split = 'train')"
GTRAIN = "gtrain AS (SELECT * FROM gappy WHERE split = 'train')"


def split_of(df, name="train"):
    return df.filter(F.col("split") == name)


def _shown(df, cols, keep=("entity_id", "split")):
    return df.select(*keep, *[rounded(c).alias(c) for c in cols])


@query(
    "clean_text",
    sql_with(
        DIRTY,
        body=r"""SELECT seq, CASE WHEN lower(x) IN ('', 'na', 'n/a', 'none', 'null', '?', 'nan', '-') THEN NULL ELSE x END AS cat FROM (SELECT seq, trim(regexp_replace(cat, '\s+', ' ', 'g')) AS x FROM dirty)""",
    ),
)
def _text(spark, sf):
    return t.dirty_events(spark, sf).select("seq", clean_text("cat").alias("cat"))


@query("null_like_tokens", sql_with(DIRTY, body="SELECT cat AS raw, CASE WHEN lower(trim(cat)) = 'n/a' THEN NULL ELSE lower(regexp_replace(trim(cat), ' +', ' ', 'g')) END AS cleaned, COUNT(*) AS n FROM dirty GROUP BY 1, 2"))
def _tokens(spark, sf):
    return t.dirty_events(spark, sf).groupBy(F.col("cat").alias("raw"), clean_text("cat", lower=True).alias("cleaned")).agg(F.count("*").alias("n"))


@query("drop_missing_target", sql_with(DIRTY, body="SELECT seq, v FROM dirty WHERE v IS NOT NULL"))
def _no_target(spark, sf):
    return p.drop_missing_target(t.dirty_events(spark, sf).select("seq", "v"), "v")


@query("drop_infinite_rows", sql_with(DIRTY, body="SELECT seq, v, v_inf FROM dirty WHERE NOT isinf(v_inf)"))
def _no_inf(spark, sf):
    return p.drop_infinite_rows(t.dirty_events(spark, sf).select("seq", "v", "v_inf"))


@query(
    "consistency_audit",
    sql_with(DIRTY, body="SELECT 'blank' AS \"column\", 'entirely null' AS finding UNION ALL SELECT 'flag', 'fewer than 2 classes' WHERE (SELECT COUNT(*) FROM dirty) > 0"),
)
def _audit(spark, sf):
    df = t.dirty_events(spark, sf).select("seq", "v", F.when(F.col("seq") < 0, 1).alias("blank"), F.lit(1).alias("flag"))
    return p.consistency_audit(df, "flag")


for _strategy, _fn in (("median", "quantile_cont({0}, 0.5)"), ("mean", "AVG({0})")):

    @query(
        f"impute_{_strategy}",
        sql_with(
            GAPPY, GTRAIN,
            body=f"""SELECT entity_id, split, {r(f"coalesce(gross, (SELECT {_fn.format('gross')} FROM gtrain))")} AS gross, {r(f"coalesce(avg_disc, (SELECT {_fn.format('avg_disc')} FROM gtrain))")} AS avg_disc FROM gappy""",
        ),
    )
    def _impute(spark, sf, strategy=_strategy):
        df = t.gappy_firms(spark, sf)
        return _shown(p.apply_impute(df, p.fit_impute(split_of(df), ["gross", "avg_disc"], strategy=strategy)), ["gross", "avg_disc"])


@query(
    "impute_most_frequent",
    sql_with(GAPPY, GTRAIN, body="SELECT entity_id, split, coalesce(segment, (SELECT segment FROM gtrain WHERE segment IS NOT NULL GROUP BY segment ORDER BY COUNT(*) DESC, segment LIMIT 1)) AS segment FROM gappy"),
)
def _mode(spark, sf):
    df = t.gappy_firms(spark, sf)
    return p.apply_impute(df, p.fit_impute(split_of(df), [], ["segment"])).select("entity_id", "split", "segment")


def _knn_fill(c, others):
    both = " + ".join(f"CASE WHEN q.{x} IS NOT NULL AND d.{x} IS NOT NULL THEN (q.{x} - d.{x}) ** 2 ELSE 0 END" for x in others)
    have = " + ".join(f"CASE WHEN q.{x} IS NOT NULL AND d.{x} IS NOT NULL THEN 1 ELSE 0 END" for x in others)
    return f"""{c}_fill AS (SELECT entity_id, AVG(v) AS f FROM (SELECT q.entity_id, d.{c} AS v, ROW_NUMBER() OVER (PARTITION BY q.entity_id ORDER BY sqrt(({both}) * {len(others)}::DOUBLE / ({have})), d.entity_id) AS rn
    FROM scaled q JOIN scaled d ON q.{c} IS NULL AND d.{c} IS NOT NULL AND d.split = 'train' WHERE ({have}) > 0) WHERE rn <= 5 GROUP BY entity_id)"""


KNN_COLS = ["gross", "qty", "avg_disc"]


@query(
    "impute_nearest_neighbours",
    sql_with(
        GAPPY,
        "scaled AS MATERIALIZED (SELECT entity_id, split, gross / 1000000 AS gross, qty / 1000 AS qty, avg_disc * 10 AS avg_disc FROM gappy)",
        _knn_fill("gross", KNN_COLS), _knn_fill("avg_disc", KNN_COLS),
        body=f"SELECT s.entity_id, split, {r('coalesce(gross, a.f)')} AS gross, {r('qty')} AS qty, {r('coalesce(avg_disc, b.f)')} AS avg_disc FROM scaled s LEFT JOIN gross_fill a ON a.entity_id = s.entity_id LEFT JOIN avg_disc_fill b ON b.entity_id = s.entity_id",
    ),
)
def _knn(spark, sf):
    df = t.gappy_firms(spark, sf).select(
        "entity_id", "split", (F.col("gross") / 1000000).alias("gross"), (F.col("qty") / 1000).alias("qty"), (F.col("avg_disc") * 10).alias("avg_disc")
    )
    return _shown(nb.knn_impute(df, split_of(df), "entity_id", KNN_COLS, 5), KNN_COLS)


def _clip_sql(lo, hi):
    return sql_with(FIRMS, TRAIN, body="SELECT entity_id, split, " + ", ".join(f"{r(f'least(greatest({c}, (SELECT {lo.format(c)} FROM train)), (SELECT {hi.format(c)} FROM train))')} AS {c}" for c in FEATURES) + " FROM firms")


@query("winsorize", _clip_sql("quantile_cont({0}, 0.01)", "quantile_cont({0}, 0.99)"))
def _winsorize(spark, sf):
    df = t.firms(spark, sf)
    return _shown(p.apply_clip(df, p.fit_clip(split_of(df), FEATURES, "winsorize")), FEATURES)


@query(
    "iqr_clip",
    _clip_sql("quantile_cont({0}, 0.25) - 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))", "quantile_cont({0}, 0.75) + 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"),
)
def _iqr(spark, sf):
    df = t.firms(spark, sf)
    return _shown(p.apply_clip(df, p.fit_clip(split_of(df), FEATURES, "iqr_clip")), FEATURES)


@query("zscore_clip", _clip_sql("AVG({0}) - 2 * stddev_samp({0})", "AVG({0}) + 2 * stddev_samp({0})"))
def _zclip(spark, sf):
    df = t.firms(spark, sf)
    return _shown(p.apply_clip(df, p.fit_clip(split_of(df), FEATURES, "zscore_clip", z=2.0)), FEATURES)


@query(
    "zscore_row_filter",
    sql_with(
        FIRMS, TRAIN,
        body="SELECT entity_id, split FROM firms WHERE NOT (split = 'train' AND (" + " OR ".join(f"abs({c} - (SELECT AVG({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train) > 2.5" for c in FEATURES) + "))",
    ),
)
def _zfilter(spark, sf):
    df = t.firms(spark, sf)
    return p.apply_zscore_filter(df, p.fit_zscore_filter(split_of(df), FEATURES, 2.5)).select("entity_id", "split")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "onehot_encode",
    sql_with(GAPPY, body="SELECT entity_id, split, " + ", ".join(f"CASE WHEN segment = '{x}' THEN 1 ELSE 0 END AS \"segment={x}\"" for x in SEGMENTS) + " FROM gappy"),
)
def _onehot(spark, sf):
    df = t.gappy_firms(spark, sf).select("entity_id", "split", "segment")
    return p.apply_onehot(df, p.fit_categories(split_of(df), ["segment"]))


@query(
    "ordinal_encode",
    sql_with(GAPPY, GTRAIN, body="SELECT g.entity_id, g.split, CAST(coalesce(c.code, -1) AS DOUBLE) AS segment FROM gappy g LEFT JOIN (SELECT segment, ROW_NUMBER() OVER (ORDER BY segment) - 1 AS code FROM (SELECT DISTINCT segment FROM gtrain WHERE segment IS NOT NULL)) c ON g.segment = c.segment"),
)
def _ordinal(spark, sf):
    df = t.gappy_firms(spark, sf).select("entity_id", "split", "segment")
    return p.apply_ordinal(df, p.fit_categories(split_of(df), ["segment"]))


# Long vocabularies: learned on every fourth part left out, so that some values are unseen.
LEARNED = "SELECT DISTINCT {0} AS v FROM {1} WHERE {2} % 4 <> 0"
CODES = "codes AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS code, COUNT(*) OVER () AS n FROM (" + LEARNED + "))"


@query(
    "ordinal_encode_many",
    "WITH " + CODES.format("c_name", "customer", "c_custkey") + " SELECT c_custkey, CAST(coalesce(code, -1) AS DOUBLE) AS c_name FROM customer LEFT JOIN codes ON c_name = v",
)
def _ordinal_many(spark, sf):
    df = t.table(spark, sf, "customer").select("c_custkey", "c_name")
    return p.apply_ordinal(df, p.fit_categories(df.filter(F.col("c_custkey") % 4 != 0), ["c_name"]))


@query(
    "onehot_encode_many",
    "WITH " + CODES.format("p_name", "part", "p_partkey") + " SELECT p_partkey, CAST((SELECT MAX(n) FROM codes) AS INTEGER) AS size, CAST(code AS INTEGER) AS place FROM part LEFT JOIN codes ON p_name = v",
)
def _onehot_many(spark, sf):
    df = t.table(spark, sf, "part").select("p_partkey", "p_name")
    dense = vector_to_array("p_name=")
    place = F.nullif(F.array_position(dense, F.lit(1.0)).cast("int"), F.lit(0)) - 1
    out = p.apply_onehot(df, p.fit_categories(df.filter(F.col("p_partkey") % 4 != 0), ["p_name"]))
    return out.select("p_partkey", F.size(dense).alias("size"), place.alias("place"))


def _scale_sql(expr):
    return sql_with(FIRMS, TRAIN, body="SELECT entity_id, split, " + ", ".join(f"{r(expr.format(c))} AS {c}" for c in FEATURES) + " FROM firms")


for _method, _expr in (
    ("standard", "({0} - (SELECT AVG({0}) FROM train)) / (SELECT stddev_pop({0}) FROM train)"),
    ("minmax", "({0} - (SELECT MIN({0}) FROM train)) / ((SELECT MAX({0}) FROM train) - (SELECT MIN({0}) FROM train))"),
    ("robust", "({0} - (SELECT quantile_cont({0}, 0.5) FROM train)) / ((SELECT quantile_cont({0}, 0.75) FROM train) - (SELECT quantile_cont({0}, 0.25) FROM train))"),
):

    @query(f"scale_{_method}", _scale_sql(_expr))
    def _scale(spark, sf, method=_method):
        df = t.firms(spark, sf)
        return _shown(p.apply_scale(df, p.fit_scale(split_of(df), FEATURES, method)), FEATURES)


@query(
    "simple_clean",
    sql_with(
        DIRTY,
        "uniq AS (SELECT DISTINCT entity_id, date, v, cat FROM dirty)",
        body="SELECT entity_id, date, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM uniq)) AS v, cat FROM uniq",
    ),
)
def _simple(spark, sf):
    df = t.dirty_events(spark, sf).select("entity_id", "date", "v", "cat")
    return p.clean_simple(df, "target")


@query(
    "simple_features",
    sql_with(FIRMS, TRAIN, body="SELECT entity_id, split, " + ", ".join(f"{r(f'({c} - (SELECT AVG({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train)')} AS {c}" for c in FEATURES if c != "avg_disc") + " FROM firms"),
)
def _simple_features(spark, sf):
    df = t.firms(spark, sf)
    fitted = p.fit_simple_features(split_of(df), FEATURES, 0.001)
    return _shown(p.apply_scale(df, fitted["scale"]), fitted["columns"])
