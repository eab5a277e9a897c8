"""Reporting table and portfolio measures.

Measures that share one scan are computed in one aggregation.  Means and
sums of fixed-point values are accumulated as integers (tenths, thousandths,
1/10000 units), so they do not depend on the order rows are added in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import ELIGIBLE, HIGH_RISK

# FIXED VALUES: reporting view layout, in order.
DASHBOARD_FEATURES = ["sk_id_curr", "target", "name_contract_type", "code_gender", "age_years",
                      "employment_years", "income", "amt_credit", "amt_annuity",
                      "name_education_type", "name_family_status", "name_housing_type",
                      "occupation_type", "num_late_payments", "avg_days_late", "lateness_trend",
                      "avg_utilization_overall", "utilization_trend", "avg_dpd_overall",
                      "max_dpd_ever", "dpd_trend", "num_bureau_accounts", "total_external_debt"]
DASHBOARD_SCORES = ["risk_probability", "risk_score", "risk_segment", "collection_priority_score",
                    "collection_rank", "cross_sell_eligible", "health_score", "health_segment"]
# DPD buckets: upper bounds and labels
DPD_CURRENT = "0 (Current)"
DPD_BUCKETS = [(30, "1-30"), (60, "31-60"), (90, "61-90")]
DPD_WORST = "90+"


def dashboard_view(features: DataFrame, scores: DataFrame) -> DataFrame:
    """J5 - ``vw_customer_dashboard``: features inner-joined to scores, 31 columns."""
    f = features.select(*DASHBOARD_FEATURES)
    s = scores.select("sk_id_curr", *DASHBOARD_SCORES)
    return f.join(s, "sk_id_curr", "inner").select(*DASHBOARD_FEATURES, *DASHBOARD_SCORES)


def _units(c: Column, scale: int) -> Column:
    """The value as a whole number of 1/scale units; sums reach 38 digits."""
    return F.round(c.cast("double") * scale).cast("decimal(28,0)")


def fixed_sum(c: Column, digits: int) -> Column:
    """Exact sum of values with at most ``digits`` decimals, as double."""
    scale = 10 ** digits
    return F.sum(_units(c, scale)).cast("double") / F.lit(float(scale))


def fixed_mean(c: Column, digits: int) -> Column:
    """Exact mean of values with at most ``digits`` decimals (nulls ignored)."""
    scale = 10 ** digits
    total = F.sum(_units(c, scale)).cast("double")
    return total / (F.lit(float(scale)) * F.nullif(F.count(c), F.lit(0)).cast("double"))


def _count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def portfolio_kpis(view: DataFrame) -> DataFrame:
    """R1-R9 in one pass."""
    high = F.col("risk_segment") == HIGH_RISK
    eligible = F.col("cross_sell_eligible") == ELIGIBLE
    warning = ((F.coalesce(F.col("lateness_trend") > 0, F.lit(False)))
               | (F.coalesce(F.col("utilization_trend") > 0, F.lit(False)))
               | (F.coalesce(F.col("dpd_trend") > 0, F.lit(False))))
    n = F.count(F.lit(1))
    return view.agg(
        n.alias("total_portfolio"),
        fixed_sum(F.col("amt_credit"), 4).alias("total_loan_exposure"),
        _count_where(high).alias("customers_at_risk"),
        fixed_mean(F.col("health_score"), 1).alias("avg_health_score"),
        _count_where(warning).alias("early_warning_count"),
        _count_where(eligible).alias("cross_sell_opportunities"),
        (F.sum("target").cast("double") / F.nullif(n, F.lit(0)).cast("double")).alias("actual_default_rate"),
        (_count_where(eligible).cast("double") / F.nullif(n, F.lit(0)).cast("double")).alias("cross_sell_pct"),
        fixed_sum(F.when(high, F.col("amt_credit")), 4).alias("exposure_at_risk"),
    )


def segment_counts(view: DataFrame, segment: str) -> DataFrame:
    """R10 - customers per segment."""
    return view.groupBy(segment).agg(F.count(F.lit(1)).alias("customers"))


def default_rate_by(view: DataFrame, segment: str = "risk_segment") -> DataFrame:
    """R11 - actual default rate per segment."""
    return view.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"),
        (F.sum("target").cast("double") / F.count(F.lit(1)).cast("double")).alias("default_rate"))


def risk_histogram(view: DataFrame, width: int = 10) -> DataFrame:
    """R12 / P21 - risk score in bins of ``width``."""
    b = (F.floor(F.col("risk_score") / width) * width).cast("int")
    return view.groupBy(b.alias("risk_bin")).agg(F.count(F.lit(1)).alias("customers"))


def trends_by_segment(view: DataFrame, segment: str = "risk_segment") -> DataFrame:
    """R13 - mean of the three trends per segment (nulls ignored)."""
    return view.groupBy(segment).agg(
        fixed_mean(F.col("lateness_trend"), 1).alias("avg_lateness_trend"),
        fixed_mean(F.col("utilization_trend"), 3).alias("avg_utilization_trend"),
        fixed_mean(F.col("dpd_trend"), 1).alias("avg_dpd_trend"))


def collection_queue(view: DataFrame, max_rank: int = 100) -> DataFrame:
    """R15 / T5 - customers with collection rank <= max_rank (ties may add rows),
    best rank first, 6 columns."""
    return (view.where(F.col("collection_rank") <= max_rank)
            .orderBy("collection_rank", "sk_id_curr")
            .select("sk_id_curr", "risk_score", "amt_credit", "collection_priority_score",
                    "avg_dpd_overall", "max_dpd_ever"))


def dpd_bucket(avg_dpd: Column) -> Column:
    """P20 - a blank (no POS history) compares equal to 0."""
    d = F.coalesce(avg_dpd, F.lit(0.0))
    expr = F.when(d == 0, DPD_CURRENT)
    for upper, label in DPD_BUCKETS:
        expr = expr.when(d <= upper, label)
    return expr.otherwise(DPD_WORST)


def dpd_bucket_counts(view: DataFrame) -> DataFrame:
    """R16 - customers per DPD bucket."""
    return (view.withColumn("dpd_bucket", dpd_bucket(F.col("avg_dpd_overall")))
            .groupBy("dpd_bucket").agg(F.count(F.lit(1)).alias("customers")))


def eligible_by(view: DataFrame, segment: str) -> DataFrame:
    """R17 - cross-sell eligible customers per occupation / education."""
    return (view.where(F.col("cross_sell_eligible") == ELIGIBLE)
            .groupBy(segment).agg(F.count(F.lit(1)).alias("customers")))


def eligible_by_income(view: DataFrame) -> DataFrame:
    """R18 / T6 - eligible customers, highest income first, 4 columns."""
    return (view.where(F.col("cross_sell_eligible") == ELIGIBLE)
            .select("sk_id_curr", "income", "amt_credit", "risk_score")
            .orderBy(F.col("income").desc(), "sk_id_curr"))
