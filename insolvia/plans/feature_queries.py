"""Feature generation, multicollinearity filters and selection, fitted on train."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded, safe_ratio, signed_log
from ..operators import features as f
from ..operators import relations as rel
from . import tables as t
from .profile_queries import ANOVA, CHI, MI, PAIRS, long_sql
from .registry import query
from .tables import FEATURES, FIRMS, r, sql_with

TRAIN = "train AS (SELECT * FROM firms WHERE split = 'train')"
TLONG = f"long AS ({long_sql('train', keep='entity_id, target')})"
CORR = "rel AS (SELECT feature, corr(value, target) AS r FROM long GROUP BY feature)"


def train_of(spark, sf):
    return t.firms(spark, sf).filter(F.col("split") == "train")


@query("signed_log", sql_with(t.DIRTY, body=f"SELECT seq, {r('sign(v - 20) * ln(1 + abs(v - 20))')} AS log_v FROM dirty"))
def _log(spark, sf):
    return t.dirty_events(spark, sf).select("seq", rounded(signed_log(F.col("v") - 20)).alias("log_v"))


@query("ratio_feature", sql_with(FIRMS, body=f"SELECT entity_id, {r('gross / (qty + 1e-9::DOUBLE)')} AS price, {r('qty / (CASE WHEN return_rate <> 0 THEN return_rate END + 1e-9::DOUBLE)', 4)} AS per_return FROM firms"))
def _ratio(spark, sf):
    return t.firms(spark, sf).select("entity_id", rounded(safe_ratio("gross", "qty")).alias("price"), rounded(safe_ratio("qty", "return_rate"), 4).alias("per_return"))


@query("interaction_feature", sql_with(FIRMS, body=f"SELECT entity_id, {r('qty * avg_disc')} AS mul FROM firms"))
def _mul(spark, sf):
    df, _ = f.generate(t.firms(spark, sf), {"interaction": [("qty", "avg_disc")]})
    return df.select("entity_id", rounded("mul__qty__x__avg_disc").alias("mul"))


@query("difference_feature", sql_with(FIRMS, body=f"SELECT entity_id, {r('qty - n_orders')} AS diff FROM firms"))
def _diff(spark, sf):
    df, _ = f.generate(t.firms(spark, sf), {"difference": [("qty", "n_orders")]})
    return df.select("entity_id", rounded("diff__qty__minus__n_orders").alias("diff"))


@query("polynomial_features", sql_with(FIRMS, body=f"SELECT entity_id, {r('qty * qty', 3)} AS pow2, {r('pow(avg_disc, 3)', 9)} AS pow3 FROM firms"))
def _poly(spark, sf):
    df, _ = f.generate(t.firms(spark, sf), {"polynomial": ["qty", "avg_disc"], "degree": 3})
    return df.select("entity_id", rounded("poly__qty__pow2", 3).alias("pow2"), rounded("poly__avg_disc__pow3", 9).alias("pow3"))


@query(
    "generated_median_fill",
    sql_with(
        FIRMS,
        "g AS (SELECT entity_id, split, qty / (CASE WHEN return_rate > 0.25 THEN return_rate END + 1e-9::DOUBLE) AS x FROM firms)",
        body=f"SELECT entity_id, {r('coalesce(x, (SELECT quantile_cont(x, 0.5) FROM g WHERE split = ' + chr(39) + 'train' + chr(39) + '))', 4)} AS x FROM g",
    ),
)
def _fill(spark, sf):
    df = t.firms(spark, sf).withColumn("rate", F.when(F.col("return_rate") > 0.25, F.col("return_rate")))
    plan = {"ratio": [("qty", "rate")]}
    out, names = f.generate(df.filter(F.col("split") == "train"), plan)
    plan["medians"] = {c: q[0] for c, q in f.quantiles(out, names, [0.5]).items()}
    return f.apply_features(df, plan).select("entity_id", rounded(names[0], 4).alias("x"))


@query(
    "base_feature_choice",
    sql_with(FIRMS, TRAIN, TLONG, body="SELECT feature, CAST(ROW_NUMBER() OVER (ORDER BY feature <> 'avg_disc', var_samp(value) DESC) AS INTEGER) AS rank FROM long GROUP BY feature QUALIFY rank <= 3"),
)
def _base(spark, sf):
    return f.base_features(train_of(spark, sf), FEATURES, hints=["avg_disc"], top=3)


@query("adjusted_skew", sql_with(FIRMS, TRAIN, TLONG, body=f"SELECT feature, {r('skewness(value)')} AS skew, abs(skewness(value)) >= 0.3 AS log_planned FROM long GROUP BY feature"))
def _skew(spark, sf):
    train = train_of(spark, sf)
    planned = f.log_columns(train, FEATURES, threshold=0.3)
    return f.adjusted_skew(train, FEATURES).select("feature", rounded("skew").alias("skew"), F.col("feature").isin(*planned or [""]).alias("log_planned"))


@query(
    "pair_plan",
    sql_with(
        FIRMS, TRAIN, TLONG, "ranked AS (SELECT feature, ROW_NUMBER() OVER (ORDER BY var_samp(value) DESC) AS rn FROM long GROUP BY feature)",
        body="SELECT a.feature AS a, b.feature AS b FROM ranked a JOIN ranked b ON a.rn < b.rn ORDER BY a.rn, b.rn LIMIT 6",
    ),
)
def _pairs(spark, sf):
    base = [x["feature"] for x in f.base_features(train_of(spark, sf), FEATURES).orderBy("rank").collect()]
    return spark.createDataFrame(f.pair_plan(base, 6), "a string, b string")


@query(
    "feature_generation",
    sql_with(
        FIRMS,
        body=f"""SELECT entity_id, split, target, {r('ln(1 + n_orders)')} AS log__n_orders, {r('gross / (qty + 1e-9::DOUBLE)')} AS ratio__gross__over__qty, {r('gross * qty', 2)} AS mul__gross__x__qty,
          {r('gross - qty', 2)} AS diff__gross__minus__qty, {r('gross * gross / 1e6', 2)} AS poly__gross__pow2 FROM firms""",
    ),
)
def _generate(spark, sf):
    df = t.firms(spark, sf)
    plan = f.plan_features(df.filter(F.col("split") == "train"), FEATURES, hints={"top_discriminative": ["gross", "qty"], "skewed_features": ["n_orders"]})
    out = f.apply_features(df, plan)
    return out.select(
        "entity_id", "split", "target", rounded("log__n_orders").alias("log__n_orders"), rounded("ratio__gross__over__qty").alias("ratio__gross__over__qty"),
        rounded("mul__gross__x__qty", 2).alias("mul__gross__x__qty"), rounded("diff__gross__minus__qty", 2).alias("diff__gross__minus__qty"),
        rounded(F.col("poly__gross__pow2") / 1e6, 2).alias("poly__gross__pow2"),
    )


@query(
    "correlation_filter",
    sql_with(
        FIRMS, TRAIN, TLONG, CORR, PAIRS.replace("FROM firms", "FROM train"),
        """ordered AS (SELECT ROW_NUMBER() OVER (ORDER BY abs(p.r) DESC, feature_a, feature_b) AS rn, feature_a, feature_b,
          CASE WHEN abs(a.r) < abs(b.r) THEN feature_a ELSE feature_b END AS loser
          FROM pairs p JOIN rel a ON a.feature = feature_a JOIN rel b ON b.feature = feature_b WHERE abs(p.r) > 0.8)""",
        """walk AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS gone UNION ALL
          SELECT o.rn, CASE WHEN list_contains(gone, feature_a) OR list_contains(gone, feature_b) THEN gone ELSE list_append(gone, loser) END
          FROM walk JOIN ordered o ON o.rn = walk.rn + 1)""",
        body="SELECT unnest(gone) AS dropped FROM walk WHERE rn = (SELECT MAX(rn) FROM ordered)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _corr_filter(spark, sf):
    return spark.createDataFrame([(c,) for c in f.correlation_filter(train_of(spark, sf), FEATURES, "target", 0.8)], "dropped string")


@query("vif_elimination")
def _vif(spark, sf):
    removed, left = f.vif_elimination(train_of(spark, sf), FEATURES)
    rows = [(c, True, None) for c in removed] + [(c, False, v) for c, v in left.items() if c not in removed]
    return spark.createDataFrame(rows, "feature string, removed boolean, vif double").withColumn("vif", rounded("vif", 3))


@query("variance_threshold", sql_with(FIRMS, TRAIN, TLONG, body=f"SELECT feature, {r('stddev_samp(value)', 4)} AS deviation, var_samp(value) <= 0.001 AS dropped FROM long GROUP BY feature"))
def _variance(spark, sf):
    return f.low_variance(train_of(spark, sf), FEATURES, 0.001).select("feature", rounded(F.sqrt("variance"), 4).alias("deviation"), "dropped")


@query("relevance_floor", sql_with(FIRMS, TRAIN, TLONG, CORR, body="SELECT feature AS dropped FROM rel WHERE abs(r) < 0.02"))
def _floor(spark, sf):
    return spark.createDataFrame([(c,) for c in f.relevance_floor(train_of(spark, sf), FEATURES, "target", 0.02, 2)], "dropped string")


def _top(cte, col):
    return f"SELECT feature, {r(col)} AS score FROM {cte} ORDER BY {col} DESC, feature LIMIT 3"


@query("mutual_information_top", sql_with(FIRMS, TRAIN, TLONG, MI, body=_top("mi", "mi")))
def _mi(spark, sf):
    s = rel.mutual_information(train_of(spark, sf), "target", FEATURES)
    return s.orderBy(F.desc("mutual_info"), "feature").limit(3).select("feature", rounded("mutual_info").alias("score"))


@query("anova_top", sql_with(FIRMS, TRAIN, TLONG, ANOVA, body=_top("anova", "f")))
def _anova(spark, sf):
    s = rel.anova_f(train_of(spark, sf), "target", FEATURES)
    return s.orderBy(F.desc("f_score"), "feature").limit(3).select("feature", rounded("f_score").alias("score"))


@query("chi_square_top", sql_with(FIRMS, TRAIN, TLONG, CHI, body=_top("chi", "chi2").replace("1000000.0::DOUBLE", "1000.0::DOUBLE")))
def _chi(spark, sf):
    s = rel.chi_square(train_of(spark, sf), "target", FEATURES)
    return s.orderBy(F.desc("chi2"), "feature").limit(3).select("feature", rounded("chi2", 3).alias("score"))


@query(
    "selection_vote",
    sql_with(
        FIRMS, TRAIN, TLONG, MI, ANOVA, CHI,
        "votes AS (SELECT feature, COUNT(*) AS votes FROM (" + " UNION ALL ".join(f"(SELECT feature FROM {c} ORDER BY {v} DESC, feature LIMIT 3)" for c, v in (("mi", "mi"), ("anova", "f"), ("chi", "chi2"))) + ") GROUP BY feature)",
        body="SELECT feature, votes FROM votes WHERE votes >= 2 OR (SELECT COUNT(*) FROM votes WHERE votes >= 2) < 2",
    ),
)
def _vote(spark, sf):
    return f.vote(f.voters(train_of(spark, sf), FEATURES, "target", 3), 2)
