"""Totals and counts beyond 64 bits, and values that used to change."""

from pyspark.sql import functions as F

from loanlens.functions import numeric
from loanlens.operators import evaluate, prepare, report


def test_sums_beyond_a_bigint_of_units(spark):
    df = spark.createDataFrame([(6e14,), (6e14,)], "v double")
    r = df.agg(report.fixed_sum(F.col("v"), 4).alias("s"), report.fixed_mean(F.col("v"), 4).alias("m")).first()
    assert (r.s, r.m) == (1.2e15, 6e14)


def test_counts_beyond_ten_to_the_twelfth(spark):
    r = spark.range(1).select(numeric.exact_quotient(F.lit(5).cast("decimal(30,4)") * 10 ** 12,
                                                     F.lit(4 * 10 ** 12)).alias("q")).first()
    assert float(r.q) == 1.25


def test_int_div_is_exact_and_truncates(spark):
    big = 2 ** 60 + 1
    df = spark.createDataFrame([(big,), (-big,), (-7,), (7,)], "v long")
    got = [r[0] for r in df.select(numeric.int_div(F.col("v"), 3)).collect()]
    assert got == [big // 3, -(big // 3), -2, 2]


def test_clip_keeps_nan_and_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 50.0), (4, -50.0)], "i int, v double")
    got = {r.i: r.c for r in df.select("i", numeric.clip(F.col("v"), -10.0, 10.0).alias("c")).collect()}
    assert got[1] != got[1] and got[2] is None and got[3] == 10.0 and got[4] == -10.0


def test_auc_of_very_large_classes(spark, monkeypatch):
    # 2 x positives x negatives is far above 2^63
    n = 10 ** 12
    counts = spark.createDataFrame([(0.2, 0, n), (0.8, n, 0)], "score double, pos long, neg long")
    monkeypatch.setattr(evaluate, "_score_counts", lambda *a: counts)
    r = evaluate.auc_ks(counts).first()
    assert (r.auc, r.ks) == (1.0, 1.0)


def test_roc_starts_at_the_origin(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0)], "risk_probability double, target int")
    points = sorted(((r.fpr, r.tpr) for r in evaluate.roc_points(df).collect()))
    assert points == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def test_binary_quartiles_equal_the_ranked_ones(spark):
    data = [(i, int(i % 4 == 0), int(i % 2), 0, 1, None if i % 3 else 1) for i in range(41)]
    df = spark.createDataFrame(data, "i int, a int, b int, c int, d int, e int")
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    assert prepare.binary_quantiles(df, list("abcde"), probs) == prepare.column_quantiles(df, list("abcde"), probs)


def test_split_moves_no_wide_row(spark):
    df = spark.range(500).select(F.col("id").alias("sk_id_curr"), (F.col("id") % 11 == 0).cast("int").alias("target"),
                                 *[F.lit(i).alias(f"c{i}") for i in range(20)])
    split = prepare.stratified_split(df)
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    got = {(r.target, r.split): r["count"] for r in split.groupBy("target", "split").count().collect()}
    assert got == {(1, "test"): 9, (1, "train"): 37, (0, "test"): 91, (0, "train"): 363}


def test_one_class_has_no_auc(spark):
    for label in (0, 1):
        df = spark.createDataFrame([(0.9, label), (0.1, label)], "risk_probability double, target int")
        assert tuple(evaluate.auc_ks(df).first()) == (None, None)


def test_collinear_points_of_the_curve_are_left_out(spark):
    import random
    import numpy as np
    rng = random.Random(6)
    for trial in range(6):
        rows = [(rng.randint(0, 40) / 40, rng.randint(0, 1)) for _ in range(rng.choice([2, 20, 300]))] + [(0.5, 0), (0.5, 1)]
        if trial == 0:                        # straight stretches
            rows = [(i / 20, int(i > 12)) for i in range(20)]
        scores = sorted({s for s, _ in rows}, reverse=True)
        tps = np.array([sum(y for s, y in rows if s >= t) for t in scores], float)
        fps = np.array([sum(1 - y for s, y in rows if s >= t) for t in scores], float)
        keep = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True] if len(scores) > 2 else np.ones(len(scores), bool)
        want = {(t, tp / tps[-1], fp / fps[-1]) for t, tp, fp, k in zip(scores, tps, fps, keep) if k}
        df = spark.createDataFrame(rows, "risk_probability double, target int")
        got = {tuple(r) for r in evaluate.roc_points(df).collect()}
        assert got == want | {(float("inf"), 0.0, 0.0)}
        assert len(got) < len(scores) + 1 or trial
