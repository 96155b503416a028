"""Whole runs composed of the operators: validation, preparation, exploration, features."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import Contract, contract_for
from ..functions.scalars import numeric_columns, text_columns
from ..operators import anomaly as an
from ..operators import models as md
from ..operators import prepare as pr
from ..operators import profile as pf
from ..operators import quality as q
from ..operators import relations as rel
from ..operators.neighbors import knn_impute
from ..operators.sampling import drop_duplicates_by_contract, stratified_split, time_split, union_all
from ..session import materialize
from ..sources.files import discover_datasets, read_dataset, read_split
from ..store.tables import content_hash


# ---------------------------------------------------------------- lineage
@dataclass
class Lineage:
    """Ordered trail of what each step did to the training table."""

    rows: list[tuple] = field(default_factory=list)

    def add(self, step: str, before: tuple[int, int], after: tuple[int, int], detail: str = "", status: str = "applied") -> None:
        self.rows.append((len(self.rows) + 1, step, status, before[0], after[0], after[0] - before[0], before[1], after[1], after[1] - before[1], detail))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.rows,
            "step_order int, step string, status string, rows_before bigint, rows_after bigint, rows_delta bigint, "
            "cols_before int, cols_after int, cols_delta int, detail string",
        )


def lineage_totals(trail: DataFrame) -> DataFrame:
    """Rows removed and columns added, summed per step so that splitting counts as neither."""
    return trail.agg(
        F.count("*").alias("n_steps"),
        F.count_if(F.col("status") == "applied").alias("n_applied"),
        F.sum(F.greatest(-F.col("rows_delta"), F.lit(0))).alias("rows_removed"),
        F.sum(F.greatest(F.col("cols_delta"), F.lit(0)).cast("bigint")).alias("cols_added"),
        F.sum(F.greatest(-F.col("cols_delta"), F.lit(0)).cast("bigint")).alias("cols_removed"),
    )


# ---------------------------------------------------------------- preparation
def _zscore_rows(df: DataFrame, train: DataFrame, columns: Sequence[str], key: str) -> tuple[dict, DataFrame]:
    fitted = pr.fit_zscore_filter(train, columns)
    return fitted, pr.apply_zscore_filter(df, fitted)


def _forest_rows(df: DataFrame, train: DataFrame, columns: Sequence[str], key: str) -> tuple[dict, DataFrame]:
    forest = an.fit_isolation_forest(train, columns, key)
    return {"columns": list(columns), "cut": an.AUTO_CUT}, an.filter_anomalies(df, forest, an.AUTO_CUT)


# Outlier methods that drop rows of train: what was fitted, and the rows that stay.
ROW_FILTERS = {"zscore_rows": _zscore_rows, "isolation_forest": _forest_rows}


def prepare(
    df: DataFrame, target: str, key: str, seq: str, dates: Sequence[str] = (), order: Sequence[str] = (), impute: str = "median",
    clip: str = "winsorize", encode: str = "onehot", scale: str = "standard",
) -> tuple[DataFrame, Lineage, dict]:
    """Clean, deduplicate, split, impute, clip, encode, scale.

    Row-level steps see the whole table; the rest is fitted on train.  The split table is
    written once, then every fitted step is a projection over it.  ``impute`` may also be
    "nearest" (k-NN over the numeric columns), ``clip`` "zscore_rows" or "isolation_forest",
    which drop train rows instead of clipping values; the table is written again after these.
    """
    trail, fitted = Lineage(), {}
    width = lambda d: len([c for c in d.columns if c != "split"])

    n = df.count()
    cleaned = pr.clean_table(df, target, dates)
    m = cleaned.count()
    trail.add("cleaning", (n, width(df)), (m, width(cleaned)))
    unique = drop_duplicates_by_contract(cleaned, seq)
    split = time_split(unique, order) if order else stratified_split(unique, target, key)
    out = materialize(split, "split")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    trail.add("duplicates", (m, width(cleaned)), (sum(counts.values()), width(out)))

    rows = counts.get("train", 0)
    skip = {target, key, seq, "split", *dates}
    train = lambda d: d.filter(F.col("split") == "train")

    def step(name: str, fn: Callable[[DataFrame], DataFrame], detail: str):
        nonlocal out
        before = width(out)
        out = fn(out)
        trail.add(name, (rows, before), (rows, width(out)), detail)

    numeric = [c for c in numeric_columns(out) if c not in skip]
    text = [c for c in text_columns(out) if c not in skip]
    if impute == "nearest":
        fitted["impute"] = {"strategy": impute, "numeric": {}, "categorical": pr.most_frequent(train(out), text)}
        step("imputation", lambda d: materialize(pr.apply_impute(knn_impute(d, train(d), key, numeric), fitted["impute"]), "imputed"), impute)
    else:
        fitted["impute"] = pr.fit_impute(train(out), numeric, text, impute)
        step("imputation", lambda d: pr.apply_impute(d, fitted["impute"]), impute)
    if clip in ROW_FILTERS:
        fitted["clip"], kept = ROW_FILTERS[clip](out, train(out), numeric, key)
        before, out = width(out), materialize(kept, "filtered")
        left = train(out).count()
        trail.add("outliers", (rows, before), (left, width(out)), clip)
        rows = left
    else:
        fitted["clip"] = pr.fit_clip(train(out), numeric, clip)
        step("outliers", lambda d: pr.apply_clip(d, fitted["clip"]), clip)
    fitted["categories"] = pr.fit_categories(train(out), text)
    encoder = pr.apply_onehot if encode == "onehot" else pr.apply_ordinal
    step("encoding", lambda d: encoder(d, fitted["categories"]), encode)
    # every numeric column is scaled, freshly encoded ones included
    fitted["scale"] = pr.fit_scale(train(out), [c for c in numeric_columns(out) if c not in skip], scale) if scale != "none" else {"stats": {}}
    step("scaling", lambda d: pr.apply_scale(d, fitted["scale"]), scale)
    return out, trail, fitted


# ---------------------------------------------------------------- features
def hints_from_tables(shape: DataFrame, pairs: DataFrame, vif: DataFrame, discrimination: DataFrame) -> dict:
    """What exploration suggests to feature engineering, whole lists; each table has a row per feature."""
    return {
        "skewed_features": [r["feature"] for r in shape.filter("highly_skewed").orderBy("feature").collect()],
        "high_correlation_pairs": [(r["feature_a"], r["feature_b"], r["r"]) for r in rel.high_pairs(pairs).collect()],
        "high_vif_features": [r["feature"] for r in vif.filter("vif > 10").orderBy(F.desc("vif")).collect()],
        "top_discriminative": [r["feature"] for r in discrimination.orderBy(F.desc("abs_cohens_d"), "feature").collect()],
    }


# ---------------------------------------------------------------- stored splits
def check_stored_splits(spark: SparkSession, folder: str, target: str, hashes: dict[str, str], required: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """``ready_to_train`` for splits as they are stored, and whether each has the columns of the first one and the
    content hash noted when it was written.  A split that is absent is not ready; one without a noted hash does not match."""
    columns, found, facts = None, [], []
    for name in required:
        try:
            df = read_split(spark, folder, name)
        except FileNotFoundError:
            facts.append((name, False, False))
            continue
        columns = columns or df.dtypes
        facts.append((name, df.dtypes == columns, content_hash(df) == hashes.get(name)))
        found.append(q.ready_to_train(df.withColumn("split", F.lit(name)), target, required=[name]))
    noted = spark.createDataFrame(facts, "split string, same_columns boolean, same_hash boolean")  # one row per split
    if not found:
        return noted.select("split", *[F.lit(0).cast("bigint").alias(c) for c in ("n_rows", "bad_labels", "bad_cells")], "same_columns", "same_hash", F.lit(False).alias("ready"))
    out = noted.join(union_all(found), "split", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ready = F.coalesce("ready", F.lit(False)) & F.col("same_columns") & F.col("same_hash")
    return out.select("split", zero("n_rows"), zero("bad_labels"), zero("bad_cells"), "same_columns", "same_hash", ready.alias("ready"))


# ---------------------------------------------------------------- exploration
SEVERITY = {"critical": 0, "warning": 1, "info": 2}


def insights(summary: DataFrame) -> DataFrame:
    """Rules over a one-row summary; absent or null inputs leave their rule silent.
    Ordered by severity, then by rule."""
    have = set(summary.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p[0].cast("string") for p in parts])
    ratio, mean_iqr, anomalies = col("imbalance_ratio"), col("mean_iqr_outlier_pct"), col("anomaly_pct")
    rules = [
        (ratio >= 5, "critical", "class_imbalance", text("severe class imbalance ", (ratio,), ":1")),
        ((ratio >= 2) & (ratio < 5), "warning", "class_imbalance", text("moderate class imbalance ", (ratio,), ":1")),
        (col("n_features_with_missing") == 0, "info", "data_quality", F.lit("no missing values")),
        ((col("n_features_with_missing") > 0) & (col("overall_missing_pct") >= 5), "warning", "data_quality", text((col("n_features_with_missing"),), " features have missing values")),
        (col("n_highly_skewed") > 0, "warning", "feature_distribution", text((col("n_highly_skewed"),), " features highly skewed, ", (col("n_heavy_tailed"),), " heavy-tailed")),
        ((col("n_high_pairs") > 0) | (col("n_high_vif") > 0), "warning", "multicollinearity", text((col("n_high_pairs"),), " correlated pairs, ", (F.coalesce(col("n_high_vif"), F.lit(0)),), " features with high inflation")),
        (mean_iqr >= 5, "warning", "outliers", text("mean outlier share ", (F.format_number(mean_iqr.cast("double"), 1),), " %")),
        (anomalies >= 1, "info", "outliers", text((anomalies,), " % of rows are anomalous")),
        (col("top_discriminative").isNotNull(), "info", "financial_signal", text("most discriminative: ", (col("top_discriminative"),))),
        (col("best_category").isNotNull(), "info", "financial_signal", text("strongest category: ", (col("best_category"),))),
        (col("best_feature").isNotNull(), "info", "predictive_power", text("strongest predictor: ", (col("best_feature"),))),
        (col("mean_separability") < 0.05, "warning", "predictive_power", F.lit("features separate the classes only weakly")),
        (col("n_components_95pct") < 0.5 * col("n_features"), "info", "dimensionality", text((col("n_components_95pct"),), " of ", (col("n_features"),), " components explain 95 %")),
    ]
    items = [
        F.when(cond, F.struct(F.lit(i).alias("rule"), F.lit(SEVERITY[s]).alias("rank"), F.lit(s).alias("severity"), F.lit(c).alias("category"), m.alias("message")))
        for i, (cond, s, c, m) in enumerate(rules)
    ]
    out = summary.select(F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.*")
    return out.orderBy("rank", "rule").drop("rank")


def headline(found: DataFrame) -> str:
    row = found.filter(F.col("severity") != "info").limit(1).collect()
    return row[0]["message"] if row else "no critical data issues found"


ANALYZERS: dict[str, Callable[[DataFrame, list[str], str, str], DataFrame]] = {
    "overview": lambda df, cols, target, key: pf.column_inventory(df),
    "target": lambda df, cols, target, key: pf.target_summary(df, target),
    "descriptive": lambda df, cols, target, key: pf.descriptive_statistics(df, cols),
    "missing": lambda df, cols, target, key: pf.missing_ranking(df),
    "outliers": lambda df, cols, target, key: pf.outlier_table(df, cols),
    "distributions": lambda df, cols, target, key: pf.distribution_shape(df, cols),
    "correlation": lambda df, cols, target, key: rel.correlation_pairs(df, cols),
    "inflation": lambda df, cols, target, key: rel.variance_inflation(df, cols),
    "ratios": lambda df, cols, target, key: rel.cohens_d(df, target, cols),
    "relationships": lambda df, cols, target, key: rel.univariate_auc(df, target, cols),
    "dimensionality": lambda df, cols, target, key: md.explained_variance(df, cols)[0],
    "anomalies": lambda df, cols, target, key: an.anomaly_summary(df, cols, key),
}


def explore(df: DataFrame, target: str, key: str, skip: Sequence[str] = (), only: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run the analyzers in order; returns their tables and a status row for each."""
    cols = [c for c in numeric_columns(df) if c not in {target, key, *skip}]
    tables, status = {}, []
    for name in only or ANALYZERS:
        try:
            # result tables are a row per feature; writing them once shields later readers
            tables[name] = materialize(ANALYZERS[name](df, cols, target, key), f"explore-{name}")
            status.append((name, "ok", None))
        except Exception as exc:  # one analyzer must not stop the rest
            status.append((name, "failed", f"{type(exc).__name__}: {str(exc)[:200]}"))
    return tables, df.sparkSession.createDataFrame(status, "analyzer string, status string, error string")


# ---------------------------------------------------------------- validation
def validate_table(df: DataFrame, source: str, contract: Contract, as_of: str, as_of_year: int, seq: str | None = None) -> DataFrame:
    """One row of component scores, overall score and grade for a dataset."""
    data = df.drop(seq) if seq else df
    one = lambda frame: frame.first().asDict()
    schema = one(q.schema_metrics(data, contract))
    missing = one(q.missing_metrics(data, list(contract.required)))
    dup = one(q.duplicate_rows(data))
    validity = one(q.validity_metrics(q.value_rules(data, contract, as_of, as_of_year)))
    outliers = q.iqr_outliers(data, q.outlier_columns(data, contract)).agg(F.avg("pct").alias("p")).first()["p"]
    timely = None
    if seq and contract.entity in df.columns and any(c in df.columns for c in (*contract.dates, *contract.years)):
        time = next(c for c in (*contract.dates, *contract.years) if c in df.columns)
        timely = one(q.timeliness(df, contract.entity, time, seq))["timeliness_score"]
    row = (
        source, dup["n_rows"], len(data.columns), schema["schema_score"], missing["completeness_score"], dup["uniqueness_score"],
        validity["validity_score"], timely, outliers or 0.0,
        sum(1 for x in (schema["missing_required"],) if x) + int(missing["required_mostly_missing"] > 0) + int((validity["invalid_rows"] or 0) > 0),
    )
    base = df.sparkSession.createDataFrame(
        [row],
        "source string, n_rows bigint, n_cols int, schema double, completeness double, uniqueness double, validity double, timeliness double, mean_iqr_pct double, n_errors int",
    )
    return q.quality_score(base)


def validate_corpus(spark: SparkSession, folder: str, as_of: str, as_of_year: int, only: Sequence[str] | None = None, contracts: dict[str, Contract] | None = None) -> DataFrame:
    """Every dataset of a folder; an unreadable one becomes a row with its error."""
    parts, broken = [], []
    for name in discover_datasets(spark, folder):
        if only is not None and name not in only:
            continue
        try:
            df = read_dataset(spark, folder, name)
            parts.append(validate_table(df, name, (contracts or {}).get(name) or contract_for(name), as_of, as_of_year))
        except Exception as exc:  # keep validating the others
            broken.append((name, f"{type(exc).__name__}: {str(exc)[:200]}"))
    bad = spark.createDataFrame(broken, "source string, load_error string")
    return union_all([*parts, bad])
