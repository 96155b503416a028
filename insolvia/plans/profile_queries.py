"""Exploratory queries over the firm table."""
from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions.scalars import category_of, column_kinds, rounded
from ..operators import profile as p
from ..operators import relations as rel
from ..operators import sampling
from . import tables as t
from .registry import query
from .tables import DIRTY, FEATURES, FIRMS, GAPPY, r, sql_with


def long_sql(cte: str, cols=FEATURES, keep: str = "") -> str:
    keep = f"{keep}, " if keep else ""
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {cte}" for c in cols)


LONG = f"long AS ({long_sql('firms', keep='entity_id, target')})"
SHAPE = """shape AS (SELECT feature,
  CASE WHEN COUNT(*) > 2 AND MIN(value) < MAX(value) THEN skewness(value) * (COUNT(*) - 2) / sqrt(COUNT(*)::DOUBLE * (COUNT(*) - 1)) ELSE 0 END AS sk,
  CASE WHEN COUNT(*) > 2 AND MIN(value) < MAX(value) THEN kurtosis_pop(value) ELSE 0 END AS ku FROM long GROUP BY feature)"""


@query("firm_features", sql_with(t.FIRM, body=f"SELECT entity_id, segment, n_orders, gross, qty, {r('avg_disc', 9)} AS avg_disc, {r('return_rate', 9)} AS return_rate, target FROM firm"))
def _firm(spark, sf):
    return t.firm_features(spark, sf).withColumns({"avg_disc": rounded("avg_disc", 9), "return_rate": rounded("return_rate", 9)})


_ROLES = {"entity_id": "numeric", "segment": "categorical", "gross": "numeric", "avg_disc": "numeric", "target": "target", "split": "categorical"}


@query("column_roles", sql_with(GAPPY, body=" UNION ALL ".join(f"SELECT '{c}' AS feature, '{role}' AS role, COUNT({c}) AS non_null FROM gappy" for c, role in _ROLES.items())))
def _roles(spark, sf):
    df = t.gappy_firms(spark, sf).select(*_ROLES)
    return column_kinds(df, "target").join(p.column_inventory(df).select("feature", "non_null"), "feature")


@query(
    "column_inventory",
    sql_with(
        DIRTY,
        body=" UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{ty}' AS dtype, COUNT({c}) AS non_null, COUNT(DISTINCT {c}) AS n_unique FROM dirty"
            for c, ty in [("seq", "bigint"), ("entity_id", "bigint"), ("date", "timestamp_ntz"), ("v", "double"), ("cat", "string"), ("v_text", "string"), ("date_text", "string"), ("v_inf", "double")]
        ),
    ),
)
def _inventory(spark, sf):
    return p.column_inventory(t.dirty_events(spark, sf))


@query(
    "target_distribution",
    sql_with(FIRMS, body='SELECT CAST(target AS VARCHAR) AS class, COUNT(*) AS count, round_even(COUNT(*) * 100.0::DOUBLE / (SELECT COUNT(*) FROM firms) * 1e4, 0) / 1e4 AS percentage FROM firms GROUP BY target'),
)
def _target(spark, sf):
    return p.target_distribution(t.firms(spark, sf), "target")


@query(
    "target_summary",
    sql_with(
        FIRMS,
        body="""SELECT n AS n_samples, 2::BIGINT AS n_classes, greatest(pos, n - pos) AS majority_count, least(pos, n - pos) AS minority_count,
          round_even(greatest(pos, n - pos)::DOUBLE / least(pos, n - pos) * 1e3, 0) / 1e3 AS imbalance_ratio, pos AS positive_count, n - pos AS negative_count,
          round_even(pos * 100.0::DOUBLE / n * 1e4, 0) / 1e4 AS positive_pct, greatest(pos, n - pos)::DOUBLE / least(pos, n - pos) >= 5 AS is_imbalanced
        FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (target = 1) AS pos FROM firms)""",
    ),
)
def _summary(spark, sf):
    return p.target_summary(t.firms(spark, sf), "target")


_QS = {"q1": 0.25, "median": 0.5, "q3": 0.75, **{f"p{x}": x / 100 for x in p.PERCENTILES}}


@query(
    "descriptive_statistics",
    sql_with(
        FIRMS, LONG, SHAPE,
        "modes AS (SELECT feature, value AS mode FROM (SELECT feature, value, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY COUNT(*) DESC, value) AS rn FROM long GROUP BY feature, value) WHERE rn = 1)",
        body=f"""SELECT feature, COUNT(*) AS count, {r('AVG(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('var_samp(value)', 2)} AS variance,
          {r('MIN(value)')} AS min, {r('MAX(value)')} AS max, {r('MAX(value) - MIN(value)')} AS range, {', '.join(f"{r(f'quantile_cont(value, {v})')} AS {k}" for k, v in _QS.items())},
          {r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} AS iqr, {r('MAX(mode)')} AS mode, {r('MAX(sk)')} AS skewness, {r('MAX(ku)')} AS kurtosis
        FROM long JOIN modes USING (feature) JOIN shape USING (feature) GROUP BY feature""",
    ),
)
def _describe(spark, sf):
    df = p.descriptive_statistics(t.firms(spark, sf), FEATURES)
    return df.withColumns({c: rounded(c, 2 if c == "variance" else 6) for c in df.columns if c not in ("feature", "count")})


@query(
    "missing_ranking",
    sql_with(
        GAPPY,
        body=" UNION ALL ".join(
            f"SELECT '{c}' AS feature, COUNT(*) FILTER ({c} IS NULL) AS missing_count, round_even(COUNT(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / COUNT(*) * 1e4, 0) / 1e4 AS missing_pct FROM gappy"
            for c in ["gross", "avg_disc", "segment"]
        ),
    ),
)
def _missing(spark, sf):
    return p.missing_ranking(t.gappy_firms(spark, sf))


FENCE = "fence AS (SELECT feature, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m, s FROM (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, AVG(value) AS m, stddev_samp(value) AS s FROM long GROUP BY feature))"


@query(
    "outlier_table",
    sql_with(
        FIRMS, LONG, FENCE,
        body=f"""SELECT feature, i AS iqr_outliers, round_even(i * 100.0::DOUBLE / n * 1e4, 0) / 1e4 AS iqr_outlier_pct, z AS zscore_outliers,
          round_even(z * 100.0::DOUBLE / n * 1e4, 0) / 1e4 AS zscore_outlier_pct, {r('lo')} AS lower_fence, {r('hi')} AS upper_fence
        FROM (SELECT feature, COUNT(*) AS n, COUNT(*) FILTER (value < lo OR value > hi) AS i, COUNT(*) FILTER (abs((value - m) / s) >= 3) AS z, MAX(lo) AS lo, MAX(hi) AS hi
          FROM long JOIN fence USING (feature) GROUP BY feature)""",
    ),
)
def _outliers(spark, sf):
    return p.outlier_table(t.firms(spark, sf), FEATURES).withColumns({c: rounded(c) for c in ("lower_fence", "upper_fence")})


@query(
    "distribution_shape",
    sql_with(FIRMS, LONG, SHAPE, body=f"SELECT feature, {r('sk')} AS skewness, {r('ku')} AS excess_kurtosis, abs(sk) >= 0.5 AS highly_skewed, ku >= 0.5 AS heavy_tailed, {r('abs(sk) + abs(ku)')} AS non_normality FROM shape"),
)
def _shape(spark, sf):
    return p.distribution_shape(t.firms(spark, sf), FEATURES, 0.5, 0.5).withColumns({c: rounded(c) for c in ("skewness", "excess_kurtosis", "non_normality")})


@query(
    "feature_histograms",
    sql_with(
        FIRMS, LONG,
        body="""SELECT g.feature, CAST(g.bin AS INTEGER) AS bin, COUNT(h.feature) AS n
        FROM (SELECT DISTINCT feature, unnest(range(30)) AS bin FROM long) g LEFT JOIN
          (SELECT feature, least(floor((value - lo) * 30.0::DOUBLE / (hi - lo)), 29) AS bin FROM long JOIN (SELECT feature, MIN(value) AS lo, MAX(value) AS hi FROM long GROUP BY feature) USING (feature)) h
          ON g.feature = h.feature AND g.bin = h.bin GROUP BY g.feature, g.bin""",
    ),
)
def _hist(spark, sf):
    return p.histograms(t.firms(spark, sf), FEATURES, 30)


PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM firms" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]
) + ")"


@query(
    "pearson_matrix",
    sql_with(FIRMS, body=" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})') if a != b else 'MAX(1.0::DOUBLE)'} AS r FROM firms" for a in FEATURES for b in FEATURES)),
)
def _pearson(spark, sf):
    return rel.pearson(t.firms(spark, sf), FEATURES).withColumn("r", rounded("r"))


RANKED = "ranked AS (SELECT entity_id, " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in FEATURES
) + " FROM firms)"


@query(
    "spearman_matrix",
    sql_with(FIRMS, RANKED, body=" UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})') if a != b else 'MAX(1.0::DOUBLE)'} AS r FROM ranked" for a in FEATURES for b in FEATURES)),
)
def _spearman(spark, sf):
    return rel.spearman(t.firms(spark, sf), "entity_id", FEATURES).withColumn("r", rounded("r"))


@query("average_ranks", sql_with(FIRMS, RANKED, body=long_sql("ranked", keep="entity_id").replace("AS value", "AS rank")))
def _ranks(spark, sf):
    return rel.average_ranks(t.firms(spark, sf), "entity_id", FEATURES)


def _tau_sql(a, b):
    s = f"sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})"
    return f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'SUM({s}) / sqrt(SUM(abs(sign(x.{a} - y.{a})))::DOUBLE * SUM(abs(sign(x.{b} - y.{b})))::DOUBLE)')} AS tau
    FROM firms x JOIN firms y ON x.entity_id < y.entity_id"""


@query("kendall_tau", sql_with(FIRMS.replace("firms AS (", "firms AS MATERIALIZED ("), body=" UNION ALL ".join(_tau_sql(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])))
def _kendall(spark, sf):
    out = rel.kendall(t.firms(spark, sf), FEATURES)
    return out.withColumn("tau", rounded("tau"))


@query("high_correlation_pairs", sql_with(FIRMS, PAIRS, body=f"SELECT feature_a, feature_b, {r('r')} AS r FROM pairs WHERE abs(r) >= 0.8"))
def _high(spark, sf):
    return rel.high_pairs(rel.correlation_pairs(t.firms(spark, sf), FEATURES), 0.8).withColumn("r", rounded("r"))


def _determinant(names):
    """Determinant of the correlations of `names` as SQL over columns `a_b`, by the sum over permutations."""
    terms = []
    for order in itertools.permutations(range(len(names))):
        swaps = sum(x > y for x, y in itertools.combinations(order, 2))
        cells = ["_".join(sorted((names[i], names[j]))) for i, j in enumerate(order) if i != j]
        terms.append(("-" if swaps % 2 else "+") + "*".join(cells or ["1"]))
    return " ".join(terms)


@query(
    "variance_inflation",
    sql_with(
        FIRMS, "c AS (SELECT " + ", ".join(f"corr({a}, {b}) AS {'_'.join(sorted((a, b)))}" for a, b in itertools.combinations(FEATURES, 2)) + " FROM firms)",
        body=" UNION ALL ".join(f"SELECT '{f}' AS feature, {r(f'({_determinant([x for x in FEATURES if x != f])}) / ({_determinant(FEATURES)})', 4)} AS vif FROM c" for f in FEATURES),
    ),
)
def _vif(spark, sf):
    return rel.variance_inflation(t.firms(spark, sf), FEATURES).withColumn("vif", rounded("vif", 4))


@query(
    "feature_categories",
    """SELECT name AS feature, CASE WHEN regexp_matches(lower(name), 'roa|roe|profit|margin|return|income|earning|eps|per share') THEN 'profitability'
      WHEN regexp_matches(lower(name), 'current ratio|quick ratio|cash|liquid|working capital|acid') THEN 'liquidity'
      WHEN regexp_matches(lower(name), 'debt|liability|liabilities|equity|borrow|leverage|gearing|solvency|net worth') THEN 'leverage'
      WHEN regexp_matches(lower(name), 'turnover|asset turnover|frequency|expense rate|revenue per|productivity|efficiency') THEN 'efficiency'
      WHEN regexp_matches(lower(name), 'cash flow|cashflow|operating cash') THEN 'cash_flow'
      WHEN regexp_matches(lower(name), 'growth|increase|change rate') THEN 'growth'
      WHEN regexp_matches(lower(name), 'interest rate|interest-bearing|tax rate') THEN 'interest_rate' ELSE 'other' END AS category
    FROM (SELECT p_type || ' ' || CASE p_partkey % 8 WHEN 0 THEN 'Operating Cash Flow' WHEN 1 THEN 'Net Profit' WHEN 2 THEN 'Debt Ratio' WHEN 3 THEN 'Inventory Turnover'
      WHEN 4 THEN 'Sales Growth' WHEN 5 THEN 'Tax rate' WHEN 6 THEN 'Quick Ratio' ELSE 'Size' END AS name FROM part)""",
)
def _categories(spark, sf):
    suffix = F.element_at(
        F.array(*[F.lit(x) for x in ("Operating Cash Flow", "Net Profit", "Debt Ratio", "Inventory Turnover", "Sales Growth", "Tax rate", "Quick Ratio", "Size")]),
        (F.col("p_partkey") % 8 + 1).cast("int"),
    )
    return t.table(spark, sf, "part").select(F.concat_ws(" ", "p_type", suffix).alias("feature")).withColumn("category", category_of("feature"))


COHEN = """cohen AS (SELECT feature, CASE WHEN feature = 'return_rate' THEN 'profitability' ELSE 'other' END AS category, m0, m1,
  (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS d
  FROM (SELECT feature, AVG(value) FILTER (target = 0) AS m0, AVG(value) FILTER (target = 1) AS m1, var_samp(value) FILTER (target = 0) AS v0, var_samp(value) FILTER (target = 1) AS v1,
    COUNT(*) FILTER (target = 0) AS n0, COUNT(*) FILTER (target = 1) AS n1 FROM long GROUP BY feature))"""


@query("cohens_d", sql_with(FIRMS, LONG, COHEN, body=f"SELECT feature, category, {r('m0')} AS mean_solvent, {r('m1')} AS mean_bankrupt, {r('d')} AS cohens_d, {r('abs(d)')} AS abs_cohens_d FROM cohen"))
def _cohen(spark, sf):
    out = rel.cohens_d(t.firms(spark, sf), "target", FEATURES)
    return out.withColumns({c: rounded(c) for c in ("mean_solvent", "mean_bankrupt", "cohens_d", "abs_cohens_d")})


@query("category_strength", sql_with(FIRMS, LONG, COHEN, body=f"SELECT category, COUNT(*) AS n_features, {r('AVG(abs(d))')} AS mean_abs_d FROM cohen GROUP BY category"))
def _strength(spark, sf):
    return rel.category_strength(rel.cohens_d(t.firms(spark, sf), "target", FEATURES)).withColumn("mean_abs_d", rounded("mean_abs_d"))


@query("point_biserial", sql_with(FIRMS, LONG, body=f"SELECT feature, {r('corr(value, target)')} AS r FROM long GROUP BY feature"))
def _biserial(spark, sf):
    return rel.correlation_with(t.firms(spark, sf), "target", FEATURES).withColumn("r", rounded("r"))


MI = f"""edges AS (SELECT feature, list_distinct(quantile_cont(value, {[i / 10 for i in range(1, 10)]})) AS e FROM long GROUP BY feature),
cells AS (SELECT feature, bin, target, COUNT(*)::DOUBLE AS n FROM (SELECT feature, len(list_filter(e, lambda x: value > x)) AS bin, target FROM long JOIN edges USING (feature)) GROUP BY feature, bin, target),
mi AS (SELECT feature, SUM(n / t * ln(n * t / (nb * ny))) AS mi FROM (SELECT *, SUM(n) OVER (PARTITION BY feature) AS t, SUM(n) OVER (PARTITION BY feature, bin) AS nb, SUM(n) OVER (PARTITION BY feature, target) AS ny FROM cells) GROUP BY feature)"""


@query("mutual_information", sql_with(FIRMS, LONG, MI, body=f"SELECT feature, {r('mi')} AS mutual_info FROM mi"))
def _mi(spark, sf):
    return rel.mutual_information(t.firms(spark, sf), "target", FEATURES).withColumn("mutual_info", rounded("mutual_info"))


@query(
    "univariate_auc",
    sql_with(
        FIRMS, LONG,
        body=f"""SELECT feature, {r('auc')} AS auc, {r('abs(auc - 0.5) * 2')} AS separability FROM (
          SELECT feature, (SUM(CASE WHEN target = 1 THEN rk END) - p * (p + 1) / 2.0) / (p * (n - p)::DOUBLE) AS auc FROM (
            SELECT feature, target, rank() OVER (PARTITION BY feature ORDER BY value) + (COUNT(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk,
              SUM(target) OVER (PARTITION BY feature) AS p, COUNT(*) OVER (PARTITION BY feature) AS n FROM long) GROUP BY feature, p, n)""",
    ),
)
def _auc(spark, sf):
    return rel.univariate_auc(t.firms(spark, sf), "target", FEATURES).withColumns({c: rounded(c) for c in ("auc", "separability")})


ANOVA = """anova AS (SELECT feature, (n0 * (m0 - m) ** 2 + n1 * (m1 - m) ** 2) / (((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS f
  FROM (SELECT feature, AVG(value) AS m, AVG(value) FILTER (target = 0) AS m0, AVG(value) FILTER (target = 1) AS m1, var_samp(value) FILTER (target = 0) AS v0, var_samp(value) FILTER (target = 1) AS v1,
    COUNT(*) FILTER (target = 0) AS n0, COUNT(*) FILTER (target = 1) AS n1 FROM long GROUP BY feature))"""
CHI = """chi AS (SELECT feature, SUM((o - e) ** 2 / e) AS chi2 FROM (SELECT feature, target, SUM(value - lo) AS o, SUM(SUM(value - lo)) OVER (PARTITION BY feature) * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY feature) AS e
  FROM long JOIN (SELECT feature, MIN(value) AS lo FROM long GROUP BY feature) USING (feature) GROUP BY feature, target) GROUP BY feature)"""


@query("anova_f", sql_with(FIRMS, LONG, ANOVA, body=f"SELECT feature, {r('f')} AS f_score FROM anova"))
def _anova(spark, sf):
    return rel.anova_f(t.firms(spark, sf), "target", FEATURES).withColumn("f_score", rounded("f_score"))


@query("chi_square", sql_with(FIRMS, LONG, CHI, body=f"SELECT feature, {r('chi2', 4)} AS chi2 FROM chi"))
def _chi(spark, sf):
    return rel.chi_square(t.firms(spark, sf), "target", FEATURES).withColumn("chi2", rounded("chi2", 4))


@query(
    "top_value_share",
    "SELECT o_custkey AS entity_id, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, entity_id LIMIT 20",
)
def _top(spark, sf):
    return sampling.top_n(t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count("*").alias("n")), "n", 20, ["entity_id"])
