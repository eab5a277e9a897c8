"""The application's jobs, from raw files to published scores.

    load_job      CSV files -> typed Parquet tables, keys checked     (IO2, IO3, K1)
    feature_job   raw tables -> the feature table, key and rows checked (IO4)
    train_job     features -> a saved model                           (F1-F12, M1, M2, IO8)
    score_job     features + saved model -> scores, checked           (M3, M12, B1-B9, IO7)
    publish_job   features + scores -> the reporting view             (J5, IO5)

All tables of the application live in one folder and are published as sets
(``sources.versions``): a job writes aside, runs its gates on what it wrote,
and only then makes it current.  A failed gate raises and leaves the tables of
the last good run; a rerun gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, model, prepare, quality, report, scores
from ..session import bounded_scans, shuffle_tasks
from ..sources import files, versions
from .views import build_features

# K1: the primary keys the tables must keep
PRIMARY_KEYS = {"raw_application_train": "sk_id_curr", "raw_bureau": "sk_id_bureau",
                "customer_features": "sk_id_curr", "customer_scores": "sk_id_curr"}


def _stage(spark: SparkSession, folder: str, name: str, df: DataFrame) -> tuple[str, DataFrame]:
    path = versions.staged(folder, name)
    files.write_table(df, path)
    return path, files.read_table(spark, path)


def _check(name: str, df: DataFrame, rows: int | None = None, complete: list[str] | None = None) -> None:
    """K1, F6 and the row count, on a staged table."""
    if name in PRIMARY_KEYS:
        quality.assert_primary_key(df, PRIMARY_KEYS[name])
    if rows is not None and df.count() != rows:
        raise ValueError(f"{name}: {df.count()} rows, expected {rows}")
    if complete:
        quality.assert_complete(df, complete)


def load_job(spark: SparkSession, csv_paths: dict[str, str], folder: str,
             multi_line: bool = False) -> dict[str, DataFrame]:
    """Load the CSV files and publish them typed; any bad field or key aborts."""
    loaded = files.read_raw_tables(spark, csv_paths, multi_line)
    staged = {name: _stage(spark, folder, name, df) for name, df in loaded.items()}
    for name, (_, df) in staged.items():
        _check(name, df)
    versions.publish(spark, folder, {name: path for name, (path, _) in staged.items()})
    return {name: df for name, (_, df) in staged.items()}


def feature_job(spark: SparkSession, raw: dict[str, DataFrame], folder: str) -> DataFrame:
    """IO4 - publish ``customer_features``: one row per staged application."""
    counted = [(df, df.count()) for df in raw.values()]
    tasks = shuffle_tasks(spark, max(rows for _, rows in counted))
    if tasks:
        bounded_scans(spark, counted)
    path, df = _stage(spark, folder, "customer_features", build_features(raw, tasks))
    _check("customer_features", df, rows=clean.staged_applications(raw["raw_application_train"]).count())
    versions.publish(spark, folder, {"customer_features": path})
    return df


def train_job(spark: SparkSession, folder: str, model_path: str) -> model.RiskModel:
    """Fit on the published features (the completeness gate F6 runs first) and save the model."""
    fitted, _, _ = model.train(versions.read(spark, folder, "customer_features"))
    fitted.save(model_path)
    return fitted


def score_job(spark: SparkSession, folder: str, model_path: str | None = None) -> DataFrame:
    """Score everyone with the saved model (the fixed scorecard when none is
    given) and publish ``customer_scores``: one row per customer, each with a
    probability and its segments."""
    feats = versions.read(spark, folder, "customer_features")
    if model_path is None:
        imputed = prepare.Imputation.fit(feats).transform(feats)
        with_p = imputed.withColumn("risk_probability", scores.scorecard_probability(imputed))
    else:
        with_p = model.RiskModel.load(spark, model_path).predict(feats)
    path, df = _stage(spark, folder, "customer_scores", scores.customer_scores(with_p))
    _check("customer_scores", df, rows=feats.count(),
           complete=["sk_id_curr", "risk_probability", "risk_score", "risk_segment", "health_segment"])
    outside = df.where(~F.col("risk_probability").between(0.0, 1.0) | F.isnan("risk_probability")).limit(1).count()
    if outside:
        raise ValueError("customer_scores: a probability outside 0 to 1")
    versions.publish(spark, folder, {"customer_scores": path})
    return df


def publish_job(spark: SparkSession, folder: str) -> DataFrame:
    """J5 - the reporting view over one published version's tables."""
    paths = versions.current(spark, folder)
    missing = {"customer_features", "customer_scores"} - set(paths)
    if missing:
        raise ValueError(f"not published yet: {sorted(missing)}")
    view = report.dashboard_view(files.read_table(spark, paths["customer_features"]),
                                 files.read_table(spark, paths["customer_scores"]))
    view.createOrReplaceTempView("vw_customer_dashboard")
    return view


def run_all(spark: SparkSession, csv_paths: dict[str, str], folder: str, model_path: str | None = None) -> DataFrame:
    """All jobs, from the CSV files to the reporting view."""
    feature_job(spark, load_job(spark, csv_paths, folder), folder)
    score_job(spark, folder, model_path)
    return publish_job(spark, folder)
