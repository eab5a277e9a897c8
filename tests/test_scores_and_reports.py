import math

from pyspark.sql import functions as F

from conftest import rows
from loanlens.functions.numeric import numpy_round, sql_round
from loanlens.operators import report, scores
from loanlens.operators.ordered import rank_desc


def test_two_rounding_rules(spark):
    df = spark.createDataFrame([(0.25,)], "x double")
    r = df.select(sql_round(F.col("x").cast("decimal(18,4)"), 1).cast("double").alias("sql"),
                  numpy_round(F.col("x"), 1).alias("np")).first()
    assert (r["sql"], r["np"]) == (0.3, 0.2)


def test_rank_min_descending(spark):
    df = spark.createDataFrame([(1, 9.0), (2, 7.0), (3, 7.0), (4, 1.0), (5, None)], "id long, s double")
    got = dict(rows(rank_desc(df, "s", slices=2), "id", "rank"))
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: None}


def test_segments(spark):
    df = spark.createDataFrame([(29.9,), (30.0,), (59.9,), (60.0,)], "s double")
    assert [r[0] for r in rows(df.select(scores.risk_segment(F.col("s"))))] == \
        ["Low Risk", "Medium Risk", "Medium Risk", "High Risk"]
    df = spark.createDataFrame([(80.0,), (79.9,), (55.0,), (54.9,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in rows(df.select(scores.health_segment(F.col("s"))))] == \
        ["Healthy", "Monitor", "Monitor", "High Risk", "High Risk", "High Risk"]


def test_health_clip_and_cross_sell(spark):
    df = spark.createDataFrame([(5.0, 0.0, "Eligible")], "r double, p double, e string")
    assert df.select(scores.health_score(F.col("r"), F.col("p"), F.col("e"))).first()[0] == 100.0
    df = spark.createDataFrame([(19.9, 0.0, 0.39), (19.9, 0.0, 0.40), (19.9, 0.0, None), (19.9, 1.0, 0.1)],
                               "r double, late double, u double")
    got = [r[0] for r in rows(df.select(scores.cross_sell_flag(F.col("r"), F.col("late"), F.col("u"))))]
    assert got == ["Eligible", "Not Eligible", "Eligible", "Not Eligible"]


def test_customer_scores_rules(spark):
    data = [(1, 0, 100.0, 0.0, 0.1, 0.05), (2, 1, 200.0, 0.0, 0.1, 0.85),
            (3, 0, 300.0, 2.0, 0.1, 0.5), (4, 1, 300.0, 0.0, None, 0.85)]
    df = spark.createDataFrame(data, "sk_id_curr long, target int, amt_credit double, "
                                     "num_late_payments double, avg_utilization_overall double, "
                                     "risk_probability double")
    out = {r["sk_id_curr"]: r for r in scores.customer_scores(df).collect()}
    assert out[1]["risk_score"] == 5.0 and out[1]["collection_priority_score"] == 0.0
    assert out[4]["collection_priority_score"] == 100.0 and out[4]["collection_rank"] == 1
    assert out[3]["collection_rank"] == 2
    assert out[1]["cross_sell_eligible"] == "Eligible" and out[1]["health_score"] == 100.0
    assert out[3]["risk_segment"] == "Medium Risk"


def test_dpd_buckets_and_early_warning(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.1,), (30.0,), (30.1,), (90.0,), (90.1,)], "d double")
    assert [r[0] for r in rows(df.select(report.dpd_bucket(F.col("d"))))] == \
        ["0 (Current)", "0 (Current)", "1-30", "1-30", "31-60", "61-90", "90+"]
    view = spark.createDataFrame(
        [(None, None, 0.1, 1, 1.0, "High Risk", "Eligible", 50.0),
         (None, 0.0, -1.0, 0, 3.0, "Low Risk", "Not Eligible", None)],
        "lateness_trend double, utilization_trend double, dpd_trend double, target int, "
        "amt_credit double, risk_segment string, cross_sell_eligible string, health_score double")
    k = report.portfolio_kpis(view).first()
    assert k["early_warning_count"] == 1 and k["customers_at_risk"] == 1
    assert k["avg_health_score"] == 50.0 and k["exposure_at_risk"] == 1.0
    assert k["actual_default_rate"] == 0.5 and k["cross_sell_pct"] == 0.5


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 49.99, 50]], "v double")
    got = dict(rows(scores.histogram(df, "v"), "bin", "count"))
    assert got[1] == 1 and got[50] == 2 and sum(got.values()) == 5
