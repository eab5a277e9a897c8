"""Model evaluation on Spark (M5-M9).

AUC, ROC points and KS are computed from one row per distinct score with
its positive and negative counts; running sums over those rows come from
``running_totals`` (no single-task sort).  Confusion matrix and report are
arithmetic over four counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_totals

# FIXED VALUES: class names of the original report.
CLASS_NAMES = {0: "Repaid", 1: "Defaulted"}


def _score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positive and negative counts."""
    y = F.col(label).cast("long")
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))


def roc_points(df: DataFrame, score: str = "risk_probability", label: str = "target",
               drop_collinear: bool = True) -> DataFrame:
    """M6 - tpr/fpr of ``score >= t`` at distinct thresholds t, and the curve's
    start (0, 0) at an infinite threshold.

    By default points inside a straight stretch of the curve are left out, as
    the usual ROC routine does: the steps to a point and on to the next lower
    threshold are these two scores' counts, so a point stays if they differ or
    if it is the highest or the lowest.  Without it every threshold stays."""
    counts = _score_counts(df, score, label)
    ranked = running_totals(counts, ["score"], ["pos", "neg"], previous=["pos", "neg"] if drop_collinear else None)
    if drop_collinear:
        highest = ((F.col("pos_before") + F.col("pos") == F.col("pos_total"))
                   & (F.col("neg_before") + F.col("neg") == F.col("neg_total")))
        bends = ((F.col("pos") != F.col("pos_previous")) | (F.col("neg") != F.col("neg_previous")))
        ranked = ranked.where(F.col("pos_previous").isNull() | highest | bends)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    points = ranked.select(
        F.col("score").alias("threshold"),
        (tp.cast("double") / F.nullif(F.col("pos_total"), F.lit(0)).cast("double")).alias("tpr"),
        (fp.cast("double") / F.nullif(F.col("neg_total"), F.lit(0)).cast("double")).alias("fpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], points.schema)
    return points.union(start)


def auc_ks(df: DataFrame, score: str = "risk_probability", label: str = "target") -> DataFrame:
    """M5 + M7 - exact ROC AUC (ties count one half) and KS = max(tpr - fpr);
    both null where the rows are of one class only."""
    ranked = running_totals(_score_counts(df, score, label), ["score"], ["pos", "neg"])
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    share = lambda part, whole: part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    gap = share(tp, F.col("pos_total")) - share(fp, F.col("neg_total"))
    # pairs (positive, negative) with the negative scored lower, ties half
    wins = (F.col("pos").cast("decimal(18,0)")
            * (2 * F.col("neg_before").cast("decimal(18,0)") + F.col("neg")).cast("decimal(20,0)"))
    pairs = F.first("pos_total").cast("double") * F.first("neg_total").cast("double")
    best = F.max(gap)
    return ranked.agg((F.sum(wins).cast("double") / F.nullif(F.lit(2.0) * pairs, F.lit(0.0))).alias("auc"),
                      F.when(best.isNotNull(), F.greatest(F.lit(0.0), best)).alias("ks"))


def confusion_matrix(df: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """M8 - counts per (actual, predicted); rows actual, columns predicted."""
    pred = F.col(prediction).cast("int")
    return (df.groupBy(F.col(label).cast("int").alias("actual"))
            .agg(F.count_if(pred == 0).alias("predicted_0"), F.count_if(pred == 1).alias("predicted_1")))


def classification_report(df: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """M9 - precision, recall, F1 and support per class, accuracy, macro and
    weighted means; a zero denominator gives 0."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))

    def f1(pr, rc):
        return F.when(pr + rc == 0, F.lit(0.0)).otherwise(2 * pr * rc / (pr + rc))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m = c.select(
        ratio(tn, tn + fn).alias("p0"), ratio(tn, tn + fp).alias("r0"), (tn + fp).alias("s0"),
        ratio(tp, tp + fp).alias("p1"), ratio(tp, tp + fn).alias("r1"), (tp + fn).alias("s1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("acc"), (tp + tn + fp + fn).alias("n"))
    m = m.withColumn("f0", f1(F.col("p0"), F.col("r0"))).withColumn("f1", f1(F.col("p1"), F.col("r1")))
    w0 = F.col("s0").cast("double") / F.col("n").cast("double")
    w1 = F.col("s1").cast("double") / F.col("n").cast("double")
    def row(name, precision, recall, f1_score, support):
        return F.struct(F.lit(name).alias("class"), precision.cast("double").alias("precision"),
                        recall.cast("double").alias("recall"), f1_score.cast("double").alias("f1_score"),
                        support.cast("long").alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row(CLASS_NAMES[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row(CLASS_NAMES[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", none, none, F.col("acc"), F.col("n")),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
            (F.col("f0") + F.col("f1")) / 2, F.col("n")),
        row("weighted avg", F.col("p0") * w0 + F.col("p1") * w1, F.col("r0") * w0 + F.col("r1") * w1,
            F.col("f0") * w0 + F.col("f1") * w1, F.col("n")),
    )
    return m.select(F.inline(rows))
