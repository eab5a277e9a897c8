"""Registered queries for preparation, scores, reports and evaluation.

Score rules, reports and evaluation are checked with the fixed scorecard
probability (``scores.scorecard_probability``) because a fitted model's
probabilities cannot be restated in SQL; the model-driven variants are
registered as well, without an oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, features, model, newton, prepare, quality, report, scores
from ..sources.standins import EDUCATION_LEVELS, FAMILY_STATUSES, HOUSING_TYPES, OCCUPATIONS
from ..session import table_folder
from . import jobs, views
from .catalog import CUSTOMER_FEATURES_CTE, csv_files, customer_features_df, register
from .stored import stored

# ------------------------------------------------------------------ Spark side


def features_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feature table (IO4)."""
    return stored(spark, sf_dir, "customer_features", lambda: customer_features_df(spark, sf_dir))


def imputed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = features_table(spark, sf_dir)
    return stored(spark, sf_dir, "imputed", lambda: prepare.Imputation.fit(feats).transform(feats))


def encoded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    imputed = imputed_features(spark, sf_dir)
    return prepare.OneHot.fit(imputed).transform(imputed, keep_source=True)


def scorecard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored scores (IO7): reports and histograms read these."""
    def build() -> DataFrame:
        imputed = imputed_features(spark, sf_dir)
        return scores.customer_scores(
            imputed.withColumn("risk_probability", scores.scorecard_probability(imputed)))
    return stored(spark, sf_dir, "customer_scores", build)


def scorecard_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dashboard_view(features_table(spark, sf_dir), scorecard_scores(spark, sf_dir))


def scorecard_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    imputed = imputed_features(spark, sf_dir)
    with_p = (imputed.withColumn("risk_probability", scores.scorecard_probability(imputed))
              .withColumn("prediction", (F.col("risk_probability") > 0.5).cast("int")))
    return prepare.stratified_split(with_p).where(F.col("split") == "test")


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = features_table(spark, sf_dir)
    _, _, scaler, cols, split = model.split_and_prepare(feats)
    return scaler.transform(split).select("sk_id_curr", "split", *cols)


# ------------------------------------------------------------------ SQL side
D = "DOUBLE"
_ZERO = prepare.ZERO_FILL_COLUMNS + prepare.TREND_COLUMNS
_MEDIAN = prepare.MEDIAN_FILL_COLUMNS
# levels present in the stand-in data, sorted; the first one is the baseline
_LEVELS = {
    "name_contract_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "code_gender": ["F", "M"],
    "name_education_type": sorted(EDUCATION_LEVELS),
    "name_family_status": sorted(FAMILY_STATUSES),
    "name_housing_type": sorted(HOUSING_TYPES),
    "occupation_type": sorted(OCCUPATIONS + [prepare.UNKNOWN_OCCUPATION]),
}
_NUMERIC = ["age_years", "employment_years", "income", "amt_credit", "amt_annuity", "cnt_children",
            "cnt_fam_members", "ext_source_1", "ext_source_2", "ext_source_3",
            "total_installments", "num_late_payments", "num_missed_payments", "avg_days_late",
            "max_days_late", "lateness_trend", "avg_utilization_overall", "utilization_trend",
            "avg_dpd_overall", "max_dpd_ever", "dpd_trend", "num_bureau_accounts",
            "num_active_accounts", "num_closed_accounts", "credit_history_length_days",
            "max_external_overdue_days", "total_external_debt", "is_not_employed"]
_DUMMIES = [(c, lv) for c, lvs in _LEVELS.items() for lv in lvs[1:]]
MODEL_COLUMNS = _NUMERIC + [f"{c}_{lv}" for c, lv in _DUMMIES]


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _imputed_select() -> str:
    cols = []
    for c in ["sk_id_curr", "target", "name_contract_type", "code_gender", "age_years", "income",
              "amt_credit", "cnt_children", "name_education_type", "name_family_status",
              "name_housing_type"]:
        cols.append(c)
    cols += [f"CAST(coalesce(CAST({c} AS {D}), 0.0) AS {D}) AS {c}" for c in _ZERO]
    cols += [f"coalesce(CAST({c} AS {D}), m.med_{c}) AS {c}" for c in _MEDIAN]
    cols += ["CAST(employment_years IS NULL AS INTEGER) AS is_not_employed",
             f"coalesce(employment_years, CAST(0.0 AS {D})) AS employment_years",
             f"coalesce(occupation_type, '{prepare.UNKNOWN_OCCUPATION}') AS occupation_type"]
    medians = ", ".join(f"median(CAST({c} AS {D})) AS med_{c}" for c in _MEDIAN)
    return f""",
medians AS (SELECT {medians} FROM customer_features),
imputed AS (SELECT {', '.join(cols)} FROM customer_features CROSS JOIN medians m)"""


IMPUTED_CTE = CUSTOMER_FEATURES_CTE + _imputed_select()

_DUMMY_SQL = ", ".join(f"CAST(coalesce({c} = '{lv}', false) AS INTEGER) AS {_q(f'{c}_{lv}')}"
                       for c, lv in _DUMMIES)
ENCODED_CTE = IMPUTED_CTE + f""",
encoded AS (SELECT *, {_DUMMY_SQL} FROM imputed)"""

_HASH = "CAST(('0x' || substr(md5('42:' || CAST(sk_id_curr AS VARCHAR)), 1, 15)) AS BIGINT)"
SPLIT_CTE = ENCODED_CTE + f""",
split AS (
  SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY target ORDER BY {_HASH}, sk_id_curr)
                      <= (2 * COUNT(*) OVER (PARTITION BY target) + 5) // 10
            THEN 'test' ELSE 'train' END AS split
  FROM encoded)"""

_SCORECARD = "(0.5::DOUBLE + 0.5::DOUBLE * z / (1.0::DOUBLE + abs(z)))"
_Z = ("(1.5::DOUBLE + (-3.0)::DOUBLE * ext_source_2 + (-1.5)::DOUBLE * ext_source_3"
      " + 0.02::DOUBLE * num_late_payments + 0.01::DOUBLE * avg_dpd_overall)")


def _np_round(x: str, digits: int) -> str:
    s = float(10 ** digits)
    return f"(round_even(({x}) * {s}::DOUBLE, 0) / {s}::DOUBLE)"


SCORES_CTE = IMPUTED_CTE + f""",
prob AS (SELECT sk_id_curr, target, CAST(amt_credit AS {D}) AS credit, num_late_payments,
           avg_utilization_overall, {_SCORECARD} AS risk_probability
         FROM (SELECT *, {_Z} AS z FROM imputed) t),
s1 AS (SELECT *, {_np_round('risk_probability * 100', 1)} AS risk_score FROM prob),
s2 AS (SELECT *, risk_score * ((credit - min(credit) OVER ())
                  / NULLIF(max(credit) OVER () - min(credit) OVER (), 0)) AS raw FROM s1),
s3 AS (SELECT *, {_np_round('raw / NULLIF(max(raw) OVER (), 0) * 100', 1)} AS collection_priority_score
       FROM s2),
s4 AS (SELECT *, CAST(RANK() OVER (ORDER BY collection_priority_score DESC) AS INTEGER) AS collection_rank,
         CASE WHEN risk_score < 20 AND num_late_payments = 0
                   AND coalesce(avg_utilization_overall, 0.0) < 0.40::DOUBLE
              THEN 'Eligible' ELSE 'Not Eligible' END AS cross_sell_eligible
       FROM s3),
s5 AS (SELECT *, {_np_round('greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - 0.5::DOUBLE * risk_score'
                            ' - 0.3::DOUBLE * collection_priority_score'
                            " + 0.2::DOUBLE * (CAST(cross_sell_eligible = 'Eligible' AS INTEGER) * 100)))", 1)}
         AS health_score FROM s4),
customer_scores AS (
  SELECT sk_id_curr, target, risk_probability, risk_score,
    CASE WHEN risk_score < 30 THEN 'Low Risk' WHEN risk_score < 60 THEN 'Medium Risk'
         ELSE 'High Risk' END AS risk_segment,
    collection_priority_score, collection_rank, cross_sell_eligible, health_score,
    CASE WHEN health_score >= 80 THEN 'Healthy' WHEN health_score >= 55 THEN 'Monitor'
         ELSE 'High Risk' END AS health_segment
  FROM s5)"""

VIEW_CTE = SCORES_CTE + f""",
vw_customer_dashboard AS (
  SELECT {', '.join('f.' + c for c in report.DASHBOARD_FEATURES)},
         {', '.join('s.' + c for c in report.DASHBOARD_SCORES)}
  FROM customer_features f JOIN customer_scores s ON f.sk_id_curr = s.sk_id_curr)"""


def _fixed_sum(x: str, digits: int) -> str:
    s = 10 ** digits
    return f"(CAST(SUM(CAST(round(CAST({x} AS {D}) * {s}) AS BIGINT)) AS {D}) / {s}.0::DOUBLE)"


def _fixed_mean(x: str, digits: int) -> str:
    s = 10 ** digits
    return (f"(CAST(SUM(CAST(round(CAST({x} AS {D}) * {s}) AS BIGINT)) AS {D})"
            f" / ({s}.0::DOUBLE * CAST(NULLIF(COUNT({x}), 0) AS {D})))")


# ------------------------------------------------------------------ preparation
register("prepared_features", ENCODED_CTE + "\nSELECT * FROM encoded")(encoded_features)

def _missing_sql(columns: list[str]) -> str:
    return " + ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL)" for c in columns)


# every cell, before and after the imputation
register("imputation_completeness", IMPUTED_CTE + f"""
SELECT 'before' AS stage, CAST({_missing_sql(features.FEATURE_COLUMNS)} AS BIGINT) AS missing_cells
FROM customer_features
UNION ALL SELECT 'after', CAST({_missing_sql([*features.FEATURE_COLUMNS, 'is_not_employed'])} AS BIGINT)
FROM imputed""")(
    lambda spark, d: quality.total_missing_cells(features_table(spark, d)).select(
        F.lit("before").alias("stage"), "missing_cells").union(
        quality.total_missing_cells(imputed_features(spark, d)).select(F.lit("after"), "missing_cells")))

register("category_levels", CUSTOMER_FEATURES_CTE + f"""
SELECT {', '.join(f'COUNT(DISTINCT {c}) AS {c}_levels' for c in prepare.CATEGORICAL_COLUMNS)}
FROM customer_features""")(
    lambda spark, d: quality.distinct_per_category(
        features_table(spark, d), prepare.CATEGORICAL_COLUMNS))

register("split_class_balance", SPLIT_CTE + """
SELECT split, COUNT(*) AS rows, AVG(CAST(target AS DOUBLE)) AS default_rate FROM split GROUP BY split""")(
    lambda spark, d: quality.class_balance(
        prepare.stratified_split(encoded_features(spark, d))))

_Q_SEL = ",\n  ".join(
    f"quantile_cont(CAST({_q(c)} AS {D}), 0.25) AS {_q(c + '__q25')}, "
    f"quantile_cont(CAST({_q(c)} AS {D}), 0.5) AS {_q(c + '__q50')}, "
    f"quantile_cont(CAST({_q(c)} AS {D}), 0.75) AS {_q(c + '__q75')}" for c in MODEL_COLUMNS)


def _scaled(c: str) -> str:
    iqr = f"(q.{_q(c + '__q75')} - q.{_q(c + '__q25')})"
    v = f"((CAST(s.{_q(c)} AS {D}) - q.{_q(c + '__q50')}) / CASE WHEN {iqr} = 0 THEN 1.0::DOUBLE ELSE {iqr} END)"
    return f"greatest(-10.0::DOUBLE, least(10.0::DOUBLE, {v})) AS {_q(c)}"


register("scaled_features", SPLIT_CTE + f""",
q AS (SELECT {_Q_SEL} FROM split WHERE split = 'train')
SELECT s.sk_id_curr, s.split, {', '.join(_scaled(c) for c in MODEL_COLUMNS)}
FROM split s CROSS JOIN q""")(scaled_features)

# the inputs before scaling, dummies included
register("feature_target_correlation", ENCODED_CTE + f"""
SELECT {', '.join(f'corr(CAST({_q(c)} AS {D}), CAST(target AS {D})) AS {_q(c)}' for c in MODEL_COLUMNS)}
FROM encoded""")(
    lambda spark, d: prepare.target_correlations(encoded_features(spark, d), MODEL_COLUMNS))

register("scaled_features_summary", SPLIT_CTE + f""",
q AS (SELECT {_Q_SEL} FROM split WHERE split = 'train'),
scaled AS (SELECT {', '.join(_scaled(c) for c in _NUMERIC)} FROM split s CROSS JOIN q),
long AS (UNPIVOT scaled ON {', '.join(map(_q, _NUMERIC))} INTO NAME feature VALUE v)
SELECT feature, COUNT(*) AS "count", round(avg(v), 6) + 0.0::{D} AS mean, round(stddev_samp(v), 6) AS std,
  min(v) AS "min", quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
  quantile_cont(v, 0.75) AS q75, max(v) AS "max" FROM long GROUP BY feature""")(
    lambda spark, d: prepare.describe_columns(scaled_features(spark, d), _NUMERIC))

# ------------------------------------------------------------------ scores
register("customer_scores", SCORES_CTE + "\nSELECT * FROM customer_scores")(scorecard_scores)

register("top_collection_priority", SCORES_CTE + """
SELECT s.sk_id_curr, s.risk_score, f.amt_credit, s.collection_priority_score, s.collection_rank
FROM customer_scores s JOIN customer_features f ON s.sk_id_curr = f.sk_id_curr
ORDER BY s.collection_priority_score DESC, s.sk_id_curr LIMIT 10""")(
    lambda spark, d: scores.top_priority(scorecard_scores(spark, d), features_table(spark, d)))

register("risk_score_histogram", SCORES_CTE + """,
span AS (SELECT min(risk_score) AS lo, max(risk_score) AS hi FROM customer_scores),
binned AS (
  SELECT CAST(least(coalesce(floor((risk_score - lo) * 50 / NULLIF(hi - lo, 0)) + 1, 1), 50) AS INTEGER) AS bin,
         lo, hi
  FROM customer_scores CROSS JOIN span WHERE risk_score IS NOT NULL)
SELECT bin, lo + (bin - 1) * ((hi - lo) / 50) AS lower_edge, COUNT(*) AS "count"
FROM binned GROUP BY bin, lo, hi""")(
    lambda spark, d: scores.histogram(scorecard_scores(spark, d), "risk_score"))

for _col in ("risk_segment", "cross_sell_eligible", "health_segment"):
    register(f"{_col}_share", SCORES_CTE + f"""
SELECT {_col}, COUNT(*) AS "count",
  {_np_round(f'CAST(COUNT(*) AS {D}) / CAST(SUM(COUNT(*)) OVER () AS {D})', 3)} * 100 AS pct
FROM customer_scores WHERE {_col} IS NOT NULL GROUP BY {_col}""")(
        (lambda col: lambda spark, d: scores.frequency_share(scorecard_scores(spark, d), col))(_col))

for _col in ("risk_segment", "health_segment"):
    register(f"default_rate_by_{_col}", SCORES_CTE + f"""
SELECT {_col}, CAST(SUM(target) AS {D}) / CAST(COUNT(target) AS {D}) AS default_rate
FROM customer_scores GROUP BY {_col}""")(
        (lambda col: lambda spark, d: scores.mean_target_by(scorecard_scores(spark, d), col))(_col))

register("risk_score_summary", SCORES_CTE + f"""
SELECT COUNT(risk_score) AS "count", {_fixed_mean('risk_score', 1)} AS mean,
  stddev_samp(risk_score) AS std, min(risk_score) AS "min",
  quantile_cont(risk_score, 0.25) AS q25, quantile_cont(risk_score, 0.5) AS q50,
  quantile_cont(risk_score, 0.75) AS q75, max(risk_score) AS "max"
FROM customer_scores""")(
    lambda spark, d: quality.numeric_summary(
        scorecard_scores(spark, d), "risk_score", digits=1))

for _col in ("collection_priority_score", "health_score"):
    register(f"{_col}_summary", SCORES_CTE + f"""
SELECT COUNT({_col}) AS "count", {_fixed_mean(_col, 1)} AS mean,
  stddev_samp({_col}) AS std, min({_col}) AS "min",
  quantile_cont({_col}, 0.25) AS q25, quantile_cont({_col}, 0.5) AS q50,
  quantile_cont({_col}, 0.75) AS q75, max({_col}) AS "max"
FROM customer_scores""")(
        (lambda col: lambda spark, d: quality.numeric_summary(scorecard_scores(spark, d), col, digits=1))(_col))

register("feature_preview", CUSTOMER_FEATURES_CTE + """
SELECT * FROM customer_features ORDER BY sk_id_curr LIMIT 20""")(
    lambda spark, d: views.preview(features_table(spark, d)))

# ------------------------------------------------------------------ reports
register("dashboard_view", VIEW_CTE + "\nSELECT * FROM vw_customer_dashboard")(scorecard_view)



def csv_dashboard_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reporting view by way of all jobs and their gates: CSV files,
    published raw tables, features, scores, view."""
    folder = f"{table_folder(spark)}/jobs-{uuid.uuid4().hex}"
    return jobs.run_all(spark, csv_files(spark, sf_dir, folder), f"{folder}/tables")


register("csv_dashboard_view", VIEW_CTE + "\nSELECT * FROM vw_customer_dashboard")(csv_dashboard_view)

register("portfolio_kpis", VIEW_CTE + f"""
SELECT COUNT(*) AS total_portfolio,
  {_fixed_sum('amt_credit', 4)} AS total_loan_exposure,
  COUNT(*) FILTER (WHERE risk_segment = 'High Risk') AS customers_at_risk,
  {_fixed_mean('health_score', 1)} AS avg_health_score,
  COUNT(*) FILTER (WHERE coalesce(lateness_trend > 0, false) OR coalesce(utilization_trend > 0, false)
                         OR coalesce(dpd_trend > 0, false)) AS early_warning_count,
  COUNT(*) FILTER (WHERE cross_sell_eligible = 'Eligible') AS cross_sell_opportunities,
  CAST(SUM(target) AS {D}) / CAST(NULLIF(COUNT(*), 0) AS {D}) AS actual_default_rate,
  CAST(COUNT(*) FILTER (WHERE cross_sell_eligible = 'Eligible') AS {D}) / CAST(NULLIF(COUNT(*), 0) AS {D})
    AS cross_sell_pct,
  {_fixed_sum("CASE WHEN risk_segment = 'High Risk' THEN amt_credit END", 4)} AS exposure_at_risk
FROM vw_customer_dashboard""")(lambda spark, d: report.portfolio_kpis(scorecard_view(spark, d)))

for _col in ("health_segment", "risk_segment"):
    register(f"customers_by_{_col}", VIEW_CTE + f"""
SELECT {_col}, COUNT(*) AS customers FROM vw_customer_dashboard GROUP BY {_col}""")(
        (lambda col: lambda spark, d: report.segment_counts(scorecard_view(spark, d), col))(_col))

register("actual_default_rate_by_risk_segment", VIEW_CTE + f"""
SELECT risk_segment, COUNT(*) AS customers,
  CAST(SUM(target) AS {D}) / CAST(COUNT(*) AS {D}) AS default_rate
FROM vw_customer_dashboard GROUP BY risk_segment""")(
    lambda spark, d: report.default_rate_by(scorecard_view(spark, d)))

register("risk_bins_of_ten", VIEW_CTE + """
SELECT CAST(floor(risk_score / 10) * 10 AS INTEGER) AS risk_bin, COUNT(*) AS customers
FROM vw_customer_dashboard GROUP BY risk_bin""")(
    lambda spark, d: report.risk_histogram(scorecard_view(spark, d)))

register("trends_by_risk_segment", VIEW_CTE + f"""
SELECT risk_segment, {_fixed_mean('lateness_trend', 1)} AS avg_lateness_trend,
  {_fixed_mean('utilization_trend', 3)} AS avg_utilization_trend,
  {_fixed_mean('dpd_trend', 1)} AS avg_dpd_trend
FROM vw_customer_dashboard GROUP BY risk_segment""")(
    lambda spark, d: report.trends_by_segment(scorecard_view(spark, d)))

register("collection_queue", VIEW_CTE + """
SELECT sk_id_curr, risk_score, amt_credit, collection_priority_score, avg_dpd_overall, max_dpd_ever
FROM vw_customer_dashboard WHERE collection_rank <= 100 ORDER BY collection_rank, sk_id_curr""")(
    lambda spark, d: report.collection_queue(scorecard_view(spark, d)))

register("dpd_bucket_counts", VIEW_CTE + """
SELECT CASE WHEN coalesce(avg_dpd_overall, 0) = 0 THEN '0 (Current)'
            WHEN coalesce(avg_dpd_overall, 0) <= 30 THEN '1-30'
            WHEN coalesce(avg_dpd_overall, 0) <= 60 THEN '31-60'
            WHEN coalesce(avg_dpd_overall, 0) <= 90 THEN '61-90' ELSE '90+' END AS dpd_bucket,
  COUNT(*) AS customers
FROM vw_customer_dashboard GROUP BY dpd_bucket""")(
    lambda spark, d: report.dpd_bucket_counts(scorecard_view(spark, d)))

for _col in ("occupation_type", "name_education_type"):
    register(f"eligible_by_{_col}", VIEW_CTE + f"""
SELECT {_col}, COUNT(*) AS customers FROM vw_customer_dashboard
WHERE cross_sell_eligible = 'Eligible' GROUP BY {_col}""")(
        (lambda col: lambda spark, d: report.eligible_by(scorecard_view(spark, d), col))(_col))

register("eligible_by_income", VIEW_CTE + """
SELECT sk_id_curr, income, amt_credit, risk_score FROM vw_customer_dashboard
WHERE cross_sell_eligible = 'Eligible' ORDER BY income DESC, sk_id_curr""")(
    lambda spark, d: report.eligible_by_income(scorecard_view(spark, d)))

# ------------------------------------------------------------------ evaluation
TEST_CTE = IMPUTED_CTE + f""",
scored AS (SELECT sk_id_curr, target, {_SCORECARD} AS risk_probability
           FROM (SELECT *, {_Z} AS z FROM imputed) t),
test AS (
  SELECT * FROM (
    SELECT *, CAST(risk_probability > 0.5 AS INTEGER) AS prediction,
      ROW_NUMBER() OVER (PARTITION BY target ORDER BY {_HASH}, sk_id_curr) AS rn,
      (2 * COUNT(*) OVER (PARTITION BY target) + 5) // 10 AS test_n
    FROM scored) t WHERE rn <= test_n),
roc AS (
  SELECT score, pos, neg,
    SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp,
    SUM(pos) OVER () AS p_total, SUM(neg) OVER () AS n_total,
    COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM (SELECT risk_probability AS score, SUM(target) AS pos, SUM(1 - target) AS neg
        FROM test GROUP BY risk_probability) g)"""

register("scorecard_auc_ks", TEST_CTE + f"""
SELECT CAST(SUM(pos * (2 * neg_below + neg)) AS {D}) / (2.0::DOUBLE * CAST(max(p_total) AS {D})
         * CAST(max(n_total) AS {D})) AS auc,
  greatest(0.0::DOUBLE, max(CAST(tp AS {D}) / CAST(p_total AS {D}) - CAST(fp AS {D}) / CAST(n_total AS {D}))) AS ks
FROM roc""")(lambda spark, d: evaluate.auc_ks(scorecard_test_rows(spark, d)))

register("scorecard_roc_points", TEST_CTE + f"""
SELECT score AS threshold, CAST(tp AS {D}) / CAST(NULLIF(p_total, 0) AS {D}) AS tpr,
  CAST(fp AS {D}) / CAST(NULLIF(n_total, 0) AS {D}) AS fpr FROM roc
UNION ALL SELECT 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""")(
    lambda spark, d: evaluate.roc_points(scorecard_test_rows(spark, d), drop_collinear=False))

# a point between equal steps of the curve is left out
register("scorecard_roc_curve", TEST_CTE + f"""
SELECT score AS threshold, CAST(tp AS {D}) / CAST(NULLIF(p_total, 0) AS {D}) AS tpr,
  CAST(fp AS {D}) / CAST(NULLIF(n_total, 0) AS {D}) AS fpr
FROM (SELECT *, tp - lag(tp, 1, 0) OVER w - (lead(tp) OVER w - tp) AS bend_tp, row_number() OVER w AS nth,
        fp - lag(fp, 1, 0) OVER w - (lead(fp) OVER w - fp) AS bend_fp FROM roc WINDOW w AS (ORDER BY score DESC))
WHERE nth = 1 OR bend_tp IS NULL OR bend_tp <> 0 OR bend_fp <> 0
UNION ALL SELECT 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""")(
    lambda spark, d: evaluate.roc_points(scorecard_test_rows(spark, d)))

register("scorecard_confusion_matrix", TEST_CTE + """
SELECT target AS actual, COUNT(*) FILTER (WHERE prediction = 0) AS predicted_0,
  COUNT(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM test GROUP BY target""")(
    lambda spark, d: evaluate.confusion_matrix(scorecard_test_rows(spark, d)))


def _div0(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS {D}) / CAST({b} AS {D}) END)"


def _f1(p: str, r: str) -> str:
    return f"(CASE WHEN {p} + {r} = 0 THEN 0.0::DOUBLE ELSE 2 * {p} * {r} / ({p} + {r}) END)"


register("scorecard_classification_report", TEST_CTE + f""",
c AS (SELECT COUNT(*) FILTER (WHERE target = 1 AND prediction = 1) AS tp,
             COUNT(*) FILTER (WHERE target = 0 AND prediction = 1) AS fp,
             COUNT(*) FILTER (WHERE target = 1 AND prediction = 0) AS fn,
             COUNT(*) FILTER (WHERE target = 0 AND prediction = 0) AS tn FROM test),
m AS (SELECT {_div0('tn', 'tn + fn')} AS p0, {_div0('tn', 'tn + fp')} AS r0, tn + fp AS s0,
             {_div0('tp', 'tp + fp')} AS p1, {_div0('tp', 'tp + fn')} AS r1, tp + fn AS s1,
             {_div0('tp + tn', 'tp + tn + fp + fn')} AS acc, tp + tn + fp + fn AS n FROM c),
m2 AS (SELECT *, {_f1('p0', 'r0')} AS f0, {_f1('p1', 'r1')} AS f1,
         CAST(s0 AS {D}) / CAST(n AS {D}) AS w0, CAST(s1 AS {D}) / CAST(n AS {D}) AS w1 FROM m)
SELECT 'Repaid' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM m2
UNION ALL SELECT 'Defaulted', p1, r1, f1, s1 FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, acc, n FROM m2
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m2
UNION ALL SELECT 'weighted avg', p0 * w0 + p1 * w1, r0 * w0 + r1 * w1, f0 * w0 + f1 * w1, n FROM m2""")(
    lambda spark, d: evaluate.classification_report(scorecard_test_rows(spark, d)))


# ------------------------------------------------------------------ a stored coefficient set
# Weights by rule, so that scaling, alignment, dot product, sigmoid, class and
# ranking can be stated in SQL; the last feature occurs in no data (F8).
FIXED_INTERCEPT = -0.25
FIXED_COEFFICIENTS = {c: ((i * 37) % 41 - 20) / 64 for i, c in enumerate([*MODEL_COLUMNS, "occupation_type_Pilots"])}
PROBABILITY_DIGITS = 6

_FIXED_SCALED_CTE = SPLIT_CTE + f""",
q AS (SELECT {_Q_SEL} FROM split WHERE split = 'train'),
scaled AS (SELECT s.sk_id_curr, s.target, s.split, {', '.join(_scaled(c) for c in MODEL_COLUMNS)}
           FROM split s CROSS JOIN q),
fixed_scores AS (
  SELECT *, 1 / (1 + exp(-({' + '.join([f'({FIXED_INTERCEPT})::{D}'] + [
      f'({FIXED_COEFFICIENTS[c]})::{D} * {_q(c)}' for c in MODEL_COLUMNS])}))) AS p FROM scaled)"""


def _fixed_rows(spark: SparkSession, sf_dir: str):
    _, _, scaler, cols, split = model.split_and_prepare(features_table(spark, sf_dir))
    return newton.LinearModel(scaler, FIXED_COEFFICIENTS, FIXED_INTERCEPT).predict(split), scaler, cols


def fixed_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3/M4/M12/F8 - everyone's probability and class under the stored coefficients."""
    rows, _, _ = _fixed_rows(spark, sf_dir)
    return _rounded(rows)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("sk_id_curr", "split", F.round("risk_probability", PROBABILITY_DIGITS).alias("risk_probability"),
                       "prediction")


_FIXED_SCORES = _FIXED_SCALED_CTE + f"""
SELECT sk_id_curr, split, round(p, {PROBABILITY_DIGITS}) AS risk_probability,
  CAST(p > 0.5 AS INTEGER) AS prediction FROM fixed_scores"""
register("fixed_model_scores", _FIXED_SCORES)(fixed_model_scores)


def reloaded_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO8 - the stored coefficient set saved, loaded again and applied to everyone."""
    _, _, scaler, _, split = model.split_and_prepare(features_table(spark, sf_dir))
    path = f"{table_folder(spark)}/model-{uuid.uuid4().hex}"
    newton.LinearModel(scaler, FIXED_COEFFICIENTS, FIXED_INTERCEPT).save(spark, path)
    return _rounded(newton.LinearModel.load(spark, path).predict(split))


register("reloaded_model_scores", _FIXED_SCORES)(reloaded_model_scores)


def fixed_model_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10/M11/T4/R14 - the 15 largest coefficients with their rank and
    direction, and the feature's mean scaled value over all customers."""
    rows, scaler, cols = _fixed_rows(spark, sf_dir)
    means = rows.agg(*[F.avg(scaler.column(c)).alias(f"m{i}") for i, c in enumerate(cols)])
    long = means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean_scaled"))
                                           for i, c in enumerate(cols)])))
    ranked = model.feature_importance(spark, list(FIXED_COEFFICIENTS), FIXED_COEFFICIENTS.values())
    return (ranked.where("rank <= 15").join(long, "feature", "left")
            .withColumn("mean_scaled", F.round(F.coalesce("mean_scaled", F.lit(0.0)), PROBABILITY_DIGITS) + 0.0))


register("fixed_model_drivers", _FIXED_SCALED_CTE + f""",
weights(feature, coefficient) AS (VALUES {', '.join(f"('{c}', ({w})::{D})" for c, w in FIXED_COEFFICIENTS.items())}),
means AS (UNPIVOT (SELECT {', '.join(f'avg({_q(c)}) AS {_q(c)}' for c in MODEL_COLUMNS)} FROM scaled)
          ON {', '.join(map(_q, MODEL_COLUMNS))} INTO NAME feature VALUE mean_scaled)
SELECT feature, coefficient, abs(coefficient) AS abs_coefficient, rank,
  CASE WHEN coefficient > 0 THEN 'Increases Risk' ELSE 'Decreases Risk' END AS direction,
  round(coalesce(mean_scaled, 0.0), {PROBABILITY_DIGITS}) + 0.0::DOUBLE AS mean_scaled
FROM (SELECT *, CAST(row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS INTEGER) AS rank FROM weights)
LEFT JOIN means USING (feature) WHERE rank <= 15""")(fixed_model_drivers)


# ------------------------------------------------------------------ a fitted model of three inputs
SMALL_INPUTS = ["ext_source_2", "ext_source_3", "num_late_payments"]
_SMALL_STEPS = 12              # of the SQL form; Newton steps change nothing after about 7


def _small_model_sql() -> str:
    """The Newton steps, unrolled: sums over the training rows, elimination of
    the symmetric system, back substitution."""
    d = len(SMALL_INPUTS) + 1
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = ["1.0::DOUBLE"] + [f"t.x{i}" for i in range(1, d)]
    parts = [f""",
q AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS {D}), {p}) AS {c}__{n}" for c in SMALL_INPUTS
                        for n, p in prepare.QUARTILES.items())} FROM split WHERE split = 'train'),
inputs AS MATERIALIZED (SELECT s.sk_id_curr, s.split, s.target, CAST(s.target AS {D}) AS y, {", ".join(
    f"{_scaled(c).rsplit(' AS ', 1)[0]} AS x{i}" for i, c in enumerate(SMALL_INPUTS, 1))} FROM split s CROSS JOIN q),
train AS MATERIALIZED (
  SELECT *, CAST(COUNT(*) OVER () AS {D}) / (2.0::DOUBLE * CAST(COUNT(*) OVER (PARTITION BY target) AS {D})) AS w
  FROM inputs WHERE split = 'train'),
beta0 AS (SELECT {", ".join(f"0.0::DOUBLE AS b{i}" for i in range(d))})"""]
    z = "b.b0" + "".join(f" + b.b{i} * t.x{i}" for i in range(1, d))
    for k in range(_SMALL_STEPS):
        ridge = lambda i, j: "" if i != j or i == 0 else f" + {1 / model.INVERSE_REGULARISATION}::DOUBLE"
        parts.append(f""",
sums{k} AS (SELECT {", ".join(f"max(b{i}) AS b{i}" for i in range(d))},
  {", ".join(f"sum(w * (p - y) * {x[i]}){'' if i == 0 else f' + {1 / model.INVERSE_REGULARISATION}::DOUBLE * max(b{i})'} AS r{i}"
             for i in range(d))},
  {", ".join(f"sum(w * p * (1 - p) * {x[i]} * {x[j]}){ridge(i, j)} AS h{i}{j}" for i, j in pairs)}
  FROM (SELECT t.*, b.*, 1 / (1 + exp(-({z}))) AS p FROM train t CROSS JOIN beta{k} b) t)""")
        last = f"sums{k}"
        for e in range(d - 1):                 # eliminate below row e
            cell = lambda i, j: f"h{i}{j} - h{e}{i} * h{e}{j} / h{e}{e}" if i > e else f"h{i}{j}"  # noqa: E731,B023
            parts.append(f""",
gone{k}_{e} AS (SELECT {", ".join(f"b{i}" for i in range(d))},
  {", ".join(f"{f'r{i} - h{e}{i} / h{e}{e} * r{e}' if i > e else f'r{i}'} AS r{i}" for i in range(d))},
  {", ".join(f"{cell(i, j)} AS h{i}{j}" for i, j in pairs)} FROM {last})""")
            last = f"gone{k}_{e}"
        for i in reversed(range(d)):           # back substitution
            known = "".join(f" - h{i}{j} * d{j}" for j in range(i + 1, d))
            parts.append(f""",
back{k}_{i} AS (SELECT *, (r{i}{known}) / h{i}{i} AS d{i} FROM {last})""")
            last = f"back{k}_{i}"
        parts.append(f""",
beta{k + 1} AS MATERIALIZED (SELECT {", ".join(f"b{i} - d{i} AS b{i}" for i in range(d))} FROM {last})""")
    parts.append(f""",
small AS (SELECT t.*, 1 / (1 + exp(-({z}))) AS p FROM inputs t CROSS JOIN beta{_SMALL_STEPS} b)""")
    return SPLIT_CTE + "".join(parts)


_SMALL_CTE = _small_model_sql()


def _small_model(spark: SparkSession, sf_dir: str) -> tuple[newton.LinearModel, DataFrame]:
    split = prepare.stratified_split(imputed_features(spark, sf_dir))
    return newton.LinearModel.fit(split, SMALL_INPUTS), split


def small_model_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1/M2/M10 - the fitted coefficients, one row each."""
    fitted, _ = _small_model(spark, sf_dir)
    return fitted.terms(spark).select("term", F.round("coefficient", PROBABILITY_DIGITS).alias("coefficient"))


def small_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3/M4/M12 - everyone's probability and class under the fitted model."""
    fitted, split = _small_model(spark, sf_dir)
    return _rounded(fitted.predict(split))


def small_model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5/M7 - AUC and KS of the fitted model on the held-out rows."""
    fitted, split = _small_model(spark, sf_dir)
    got = evaluate.auc_ks(fitted.predict(split.where(F.col("split") == "test")))
    return got.select(*[F.round(c, PROBABILITY_DIGITS).alias(c) for c in ("auc", "ks")])


register("small_model_coefficients", _SMALL_CTE + f"""
SELECT unnest(['intercept', {", ".join(f"'{c}'" for c in SMALL_INPUTS)}]) AS term,
  unnest([{", ".join(f"round(b{i}, {PROBABILITY_DIGITS})" for i in range(len(SMALL_INPUTS) + 1))}]) AS coefficient
FROM beta{_SMALL_STEPS}""")(small_model_coefficients)
register("small_model_scores", _SMALL_CTE + f"""
SELECT sk_id_curr, split, round(p, {PROBABILITY_DIGITS}) AS risk_probability, CAST(p > 0.5 AS INTEGER) AS prediction
FROM small""")(small_model_scores)
register("small_model_evaluation", _SMALL_CTE + f""",
counts AS (SELECT p, SUM(target) AS pos, SUM(1 - target) AS neg FROM small WHERE split = 'test' GROUP BY p),
steps AS (SELECT pos, neg, SUM(pos) OVER (ORDER BY p DESC) AS tp, SUM(neg) OVER (ORDER BY p DESC) AS fp,
            SUM(pos) OVER () AS all_pos, SUM(neg) OVER () AS all_neg FROM counts)
SELECT round(CAST(SUM(pos * (2 * (all_neg - fp) + neg)) AS {D}) / CAST(2 * max(all_pos) * max(all_neg) AS {D}), {PROBABILITY_DIGITS}) AS auc,
  round(greatest(0.0::DOUBLE, max(CAST(tp AS {D}) / CAST(all_pos AS {D}) - CAST(fp AS {D}) / CAST(all_neg AS {D}))), {PROBABILITY_DIGITS}) AS ks
FROM steps""")(small_model_evaluation)


# ------------------------------------------------------------------ fitted model (no SQL oracle)
def _fit(spark: SparkSession, sf_dir: str):
    feats = features_table(spark, sf_dir)
    fitted, split, iterations = model.train(feats)
    return feats, fitted, split, iterations


def _model_test_rows(spark: SparkSession, sf_dir: str):
    """The held-out rows with the fitted model's probability and class, and
    the solver's iterations; only they are scored."""
    _, fitted, split, iterations = _fit(spark, sf_dir)
    return fitted.predict_imputed(split.where(F.col("split") == "test")), iterations


def risk_model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M5, M7: fit, then AUC and KS on the held-out rows."""
    test, iterations = _model_test_rows(spark, sf_dir)
    return evaluate.auc_ks(test).withColumn("iterations", F.lit(iterations))


def risk_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 15 coefficients by absolute value."""
    _, fitted, _, _ = _fit(spark, sf_dir)
    return fitted.coefficients(spark).where(F.col("rank") <= 15)


def model_customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 + B1-B9 with the fitted model's probabilities."""
    feats, fitted, _, _ = _fit(spark, sf_dir)
    return scores.customer_scores(fitted.predict(feats))


register("risk_model_evaluation")(risk_model_evaluation)
register("risk_drivers")(risk_drivers)
register("model_customer_scores")(model_customer_scores)


register("risk_model_confusion_matrix")(
    lambda spark, d: evaluate.confusion_matrix(_model_test_rows(spark, d)[0]))
register("risk_model_classification_report")(
    lambda spark, d: evaluate.classification_report(_model_test_rows(spark, d)[0]))
