"""IO5/T2/T7: named views and previews.

``register_views`` exposes the staged applications, the feature table, the
scores and the reporting view as temporary views, so the original SQL can be
run with ``spark.sql`` against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, features, report


def build_features(raw: dict[str, DataFrame], tasks: int | None = None) -> DataFrame:
    """The feature table from the five raw tables (``tasks``: see ``operators.features``)."""
    return features.customer_features(
        clean.staged_applications(raw["raw_application_train"]), raw["raw_installments_payments"],
        raw["raw_credit_card_balance"], raw["raw_pos_cash_balance"], raw["raw_bureau"],
        tasks=tasks)


def register_views(raw: dict[str, DataFrame], scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Temporary views over raw tables, whatever they were loaded from."""
    for name, df in raw.items():
        df.createOrReplaceTempView(name)
    out = {"stg_application_train": clean.staged_applications(raw["raw_application_train"]),
           "customer_features": build_features(raw)}
    if scored is not None:
        out["customer_scores"] = scored
        out["vw_customer_dashboard"] = report.dashboard_view(out["customer_features"], scored)
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def preview(df: DataFrame, n: int = 20, key: str = "sk_id_curr") -> DataFrame:
    """T2/T7 - a deterministic ``LIMIT n`` preview (first keys)."""
    return df.orderBy(F.col(key)).limit(n)
