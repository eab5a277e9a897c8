import random

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from conftest import rows
from loanlens.operators import evaluate, model, prepare

SF = "/root/testdata/sf0.001"


def test_auc_ks_extremes(spark):
    tied = spark.createDataFrame([(0.3, 0), (0.3, 1), (0.3, 0), (0.3, 1)], "p double, y int")
    r = evaluate.auc_ks(tied, "p", "y").first()
    assert (r["auc"], r["ks"]) == (0.5, 0.0)
    perfect = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "p double, y int")
    r = evaluate.auc_ks(perfect, "p", "y").first()
    assert (r["auc"], r["ks"]) == (1.0, 1.0)


def test_auc_matches_spark_evaluator(spark):
    rng = random.Random(1)
    data = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(500)]
    df = spark.createDataFrame(data, "p double, y int")
    ours = evaluate.auc_ks(df, "p", "y").first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    assert abs(ours - ev.evaluate(df.withColumn("y", F.col("y").cast("double")))) < 1e-12


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "target int, prediction int")
    rep = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert rep["Defaulted"]["precision"] == 0.0 and rep["Defaulted"]["f1_score"] == 0.0
    assert rep["accuracy"]["f1_score"] == 2 / 3
    cm = dict((r[0], (r[1], r[2])) for r in rows(evaluate.confusion_matrix(df)))
    assert cm == {0: (2, 0), 1: (1, 0)}


def _newton(X, y, w, C=1.0, iters=50):
    """Minimise C * sum w_i logloss_i + 0.5 ||beta||^2 (intercept free)."""
    n, d = X.shape
    A = np.hstack([X, np.ones((n, 1))])
    theta = np.zeros(d + 1)
    reg = np.ones(d + 1)
    reg[-1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-A @ theta))
        g = C * A.T @ (w * (p - y)) + reg * theta
        H = C * (A * (w * p * (1 - p))[:, None]).T @ A + np.diag(reg)
        theta -= np.linalg.solve(H + 1e-12 * np.eye(d + 1), g)
    return theta


def test_logistic_regression_matches_objective(spark, tmp_path):
    from loanlens.plans.catalog import customer_features_df
    feats = customer_features_df(spark, SF).cache()
    fitted, split, iterations = model.train(feats)
    assert iterations > 0
    prepared = fitted.prepare(feats).join(split.select("sk_id_curr", "split"), "sk_id_curr").where("split = 'train'")
    data = prepared.select("features", "target").collect()        # tiny fixture
    X = np.array([r["features"].toArray() for r in data])
    y = np.array([r["target"] for r in data], dtype=float)
    n, n1 = len(y), y.sum()
    w = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    theta = _newton(X, y, w)
    spark_theta = np.append(fitted.classifier.coefficients.toArray(), fitted.classifier.intercept)
    assert np.max(np.abs(theta - spark_theta)) < 1e-3 * max(1.0, np.max(np.abs(theta)))

    # IO8: save / load gives the same probabilities
    path = str(tmp_path / "model")
    fitted.save(path)
    again = model.RiskModel.load(spark, path)
    a = {r[0]: r[1] for r in fitted.predict(feats).select("sk_id_curr", "risk_probability").collect()}
    b = {r[0]: r[1] for r in again.predict(feats).select("sk_id_curr", "risk_probability").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    # no row is read to plan the inputs, so none need be there
    assert again.predict(feats.where("sk_id_curr < 0")).collect() == []

    imp = fitted.coefficients(spark).orderBy("rank").collect()
    assert imp[0]["rank"] == 1 and imp[0]["abs_coefficient"] >= imp[-1]["abs_coefficient"]
    feats.unpersist()


def test_newton_steps_agree_with_the_ml_fit(spark):
    """M1/M2: both solve the same objective."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from loanlens.operators import newton
    from loanlens.plans import catalog_scoring as cs
    fitted, split = cs._small_model(spark, "/root/testdata/sf0.01")
    scaled = fitted.scaler.transform(split.where("split = 'train'"))
    rows, n = model.balanced_weights(VectorAssembler(inputCols=cs.SMALL_INPUTS, outputCol="features").transform(scaled))
    ml = LogisticRegression(labelCol="target", weightCol=model.WEIGHT_COLUMN, regParam=1.0 / n, standardization=False,
                            maxIter=500, tol=1e-12).fit(rows)
    want = [ml.intercept, *ml.coefficients]
    got = [fitted.intercept, *fitted.coefficients.values()]
    assert all(abs(a - b) < 1e-4 for a, b in zip(got, want)), (got, want)
    assert all(abs(c) > 1e-3 for c in got)
    path = f"/tmp/loanlens-linear-{n}"
    fitted.save(spark, path)
    again = newton.LinearModel.load(spark, path)
    assert again == fitted
    # a column the data lacks counts as 0
    few = split.select("sk_id_curr", "ext_source_2").limit(3)
    assert all(0 < r.risk_probability < 1 for r in fitted.predict(few).collect())


def test_sparse_levels_equal_the_wide_form(spark):
    """The same scaled inputs as one-hot columns, level by level."""
    from loanlens.operators import prepare
    from loanlens.operators.levels import LevelVectors
    import random
    rng = random.Random(4)
    rows = [(i, rng.choice("aaaaabbbcd"), rng.choice(["x", "y", None]), rng.choice("pq") if i else "only")
            for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    columns = ["a", "b", "c"]
    wide = prepare.OneHot.fit(df, columns)
    scale = prepare.RobustScale.fit(wide.transform(df), wide.output_columns)
    new = spark.createDataFrame([(-1, "zz", None, "p"), (-2, "a", "y", "unseen"), *rows[:60]], "i int, a string, b string, c string")
    want = {r.i: {c: r[c] for c in wide.output_columns} for r in scale.transform(wide.transform(new)).collect()}
    made = LevelVectors.fit(df, df, columns)
    out = made.transform(new.withColumn("dense", F.array(*made.scaled_columns(columns)))).collect()
    dense, sparse = made.names
    assert sorted([*dense, *(s for s in sparse if s)]) == sorted(wide.output_columns) and dense
    for r in out:
        got = dict(zip(dense, r.dense))
        held = np.concatenate([r[v].toArray() for v in made.vectors])
        got.update({name: x for name, x in zip(sparse, held) if name})
        assert all(x == 0 for name, x in zip(sparse, held) if not name)
        assert got == want[r.i]


def test_a_hundred_thousand_levels_add_no_columns(spark, monkeypatch):
    from loanlens.operators import levels as lv
    from pyspark.ml.classification import LogisticRegression
    monkeypatch.setattr(lv, "CATEGORICAL_COLUMNS", ["job"])
    rows = spark.range(120_000).select(
        (F.col("id") % 3 == 0).cast("int").alias("target"), F.lit(1.0).alias("class_weight"), (F.col("id") % 7).cast("double").alias("x"),
        F.concat(F.lit("job "), F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("job"))
    made = lv.LevelVectors.fit(rows, rows, ["job"])
    n = len(made.indexer.labelsArray[0])
    assert n > 60_000 and not made.common["job"]
    scale = prepare.RobustScale({"x": 3.0}, {"x": 2.0})
    fitted = model.RiskModel(prepare.Imputation({}), made, scale, ["x"], None)
    ready = fitted.assemble(rows)
    assert ready.columns == [*rows.columns, "features"]
    assert ready.first().features.size == n + 1
    fitted.classifier = LogisticRegression(labelCol="target", maxIter=3, regParam=1e-4, standardization=False).fit(ready)
    out = fitted.predict_imputed(rows)
    assert out.where("risk_probability between 0 and 1").count() == 120_000
    assert fitted.coefficients(spark).count() == n          # all but the first level, and x
