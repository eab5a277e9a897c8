"""Business scores from a default probability.

Score arithmetic is float64, as in the original (decimals were coerced to
float when read into pandas), and uses float64 rounding (ties to even).
The two portfolio-wide constants (credit min/max, then the largest raw
priority) are scalar subqueries: one-row aggregates that Spark evaluates
once and substitutes into the row expressions - never a driver round trip
and never a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, nan_to_null, numpy_round
from .ordered import rank_desc

# FIXED VALUES: business thresholds and weights of the original score rules.
RISK_LOW, RISK_HIGH = 30, 60                 # risk segment cut points
HEALTH_HEALTHY, HEALTH_MONITOR = 80, 55      # health segment cut points
CROSS_SELL_MAX_RISK = 20
CROSS_SELL_MAX_UTILIZATION = 0.40
HEALTH_WEIGHTS = (0.5, 0.3, 0.2)             # risk, collection priority, cross-sell
LOW_RISK, MEDIUM_RISK, HIGH_RISK = "Low Risk", "Medium Risk", "High Risk"
HEALTHY, MONITOR = "Healthy", "Monitor"
ELIGIBLE, NOT_ELIGIBLE = "Eligible", "Not Eligible"

SCORE_COLUMNS = ["sk_id_curr", "target", "risk_probability", "risk_score", "risk_segment",
                 "collection_priority_score", "collection_rank", "cross_sell_eligible",
                 "health_score", "health_segment"]


def risk_segment(score: Column) -> Column:
    """P16 - NaN and null fall to the last branch, as pandas comparisons do."""
    s = nan_to_null(score)
    return F.when(s < RISK_LOW, LOW_RISK).when(s < RISK_HIGH, MEDIUM_RISK).otherwise(HIGH_RISK)


def health_segment(score: Column) -> Column:
    """P17 (G9: NaN >= 80 is true in Spark, so NaN becomes null first)."""
    s = nan_to_null(score)
    return F.when(s >= HEALTH_HEALTHY, HEALTHY).when(s >= HEALTH_MONITOR, MONITOR).otherwise(HIGH_RISK)


def cross_sell_flag(risk_score: Column, late: Column, util: Column) -> Column:
    """B6 - low risk, never late, utilization under 40 % (no card counts as 0)."""
    ok = ((risk_score < CROSS_SELL_MAX_RISK) & (late == 0)
          & (F.coalesce(util, F.lit(0.0)) < CROSS_SELL_MAX_UTILIZATION))
    return F.when(F.coalesce(ok, F.lit(False)), ELIGIBLE).otherwise(NOT_ELIGIBLE)


def health_score(risk_score: Column, priority: Column, eligible: Column) -> Column:
    """B7 - clip(100 - .5 risk - .3 priority + .2 * (0|100), 0, 100), 1 digit."""
    w_r, w_p, w_x = HEALTH_WEIGHTS
    opportunity = (eligible == ELIGIBLE).cast("int") * 100
    raw = F.lit(100.0) - F.lit(w_r) * risk_score - F.lit(w_p) * priority + F.lit(w_x) * opportunity
    return numpy_round(clip(raw, 0.0, 100.0), 1)


def customer_scores(df: DataFrame, probability: str = "risk_probability", credit: str = "amt_credit",
                    late: str = "num_late_payments", util: str = "avg_utilization_overall",
                    id_col: str = "sk_id_curr", target: str = "target") -> DataFrame:
    """B1-B9 - the 10-column ``customer_scores`` table.

    ``df`` holds one row per customer with the probability and the
    (zero-filled) late-payment count and utilization.
    """
    base = df.select(id_col, target, F.col(credit).cast("double").alias("_credit"), late, util,
                     F.col(probability).cast("double").alias("risk_probability"))
    base = base.withColumn("risk_score", numpy_round(F.col("risk_probability") * 100, 1))

    # B2 - exposure normalised with the portfolio min/max (scalar subqueries)
    cmin, cmax = base.agg(F.min("_credit")).scalar(), base.agg(F.max("_credit")).scalar()
    exposure = (F.col("_credit") - cmin) / F.nullif(cmax - cmin, F.lit(0.0))
    raw = base.withColumn("_raw", F.col("risk_score") * exposure)

    # B4 - rescale by the largest raw priority (a second scalar subquery)
    raw_max = raw.agg(F.max("_raw")).scalar()
    prio = raw.withColumn("collection_priority_score",
                          numpy_round(F.col("_raw") / F.nullif(raw_max, F.lit(0.0)) * 100, 1))

    # B5 - shared minimum rank, highest priority first.  The score is rounded
    # to 0.1 on [0, 100], so about 1001 distinct values are ranked; the rank
    # table is counted and then broadcast, so no customer row moves.
    ranked = rank_desc(prio, "collection_priority_score", out="collection_rank")

    scored = (ranked
              .withColumn("risk_segment", risk_segment(F.col("risk_score")))
              .withColumn("cross_sell_eligible",
                          cross_sell_flag(F.col("risk_score"), F.col(late), F.col(util)))
              .withColumn("health_score", health_score(F.col("risk_score"),
                                                       F.col("collection_priority_score"),
                                                       F.col("cross_sell_eligible")))
              .withColumn("health_segment", health_segment(F.col("health_score"))))
    return scored.select(*SCORE_COLUMNS)


def top_priority(scores: DataFrame, features: DataFrame, n: int = 10) -> DataFrame:
    """T3 - the n highest collection priorities (ties by id), 5 columns."""
    return (scores.join(features.select("sk_id_curr", "amt_credit"), "sk_id_curr")
            .select("sk_id_curr", "risk_score", "amt_credit", "collection_priority_score",
                    "collection_rank")
            .orderBy(F.col("collection_priority_score").desc(), F.col("sk_id_curr"))
            .limit(n))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """P22 - equal-width bins between min and max, the last bin closed on the
    right; returns (bin, lower_edge, count) for non-empty bins."""
    v = F.col(value).cast("double")
    lo, hi = df.agg(F.min(v)).scalar(), df.agg(F.max(v)).scalar()
    idx = F.floor((v - lo) * bins / F.nullif(hi - lo, F.lit(0.0))) + 1
    binned = (df.where(v.isNotNull())
              .withColumn("bin", F.least(F.coalesce(idx, F.lit(1)), F.lit(bins)).cast("int")))
    return (binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (lo + (F.col("bin") - 1) * ((hi - lo) / bins)).alias("lower_edge"), "count"))


def frequency_share(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """A23 - ``value_counts()`` and ``value_counts(normalize=True).round(d) * 100``."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    share = numpy_round(F.col("count") / total, digits) * 100
    return counts.select(column, "count", share.alias("pct")).orderBy(F.col("count").desc(), column)


def mean_target_by(df: DataFrame, column: str, target: str = "target") -> DataFrame:
    """A24 - observed default rate per segment."""
    return df.groupBy(column).agg(
        (F.sum(F.col(target).cast("long")).cast("double") / F.count(target).cast("double"))
        .alias("default_rate")).orderBy(F.col("default_rate").desc(), column)


# Fixed scorecard used where a SQL-checkable probability is needed in place
# of the fitted model (score rules, reports and evaluation are then exactly
# reproducible in SQL).  Inputs are the imputed feature columns.
SCORECARD_TERMS = [("ext_source_2", -3.0), ("ext_source_3", -1.5),
                   ("num_late_payments", 0.02), ("avg_dpd_overall", 0.01)]
SCORECARD_INTERCEPT = 1.5


def scorecard_probability(prepared: DataFrame) -> Column:
    """p = 0.5 + 0.5 * z / (1 + |z|) for a fixed linear score z (only exact
    IEEE operations, so every engine returns the same double)."""
    z = F.lit(SCORECARD_INTERCEPT)
    for column, weight in SCORECARD_TERMS:
        z = z + F.lit(weight) * F.col(column).cast("double")
    return F.lit(0.5) + F.lit(0.5) * z / (F.lit(1.0) + F.abs(z))
