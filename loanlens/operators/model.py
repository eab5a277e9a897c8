"""Risk model (M1-M4, M10-M12, IO8).

Logistic regression on Spark ML.  The original objective is L2 with C = 1
and balanced class weights (w_c = n / (2 n_c)):

    C * sum_i w_i loss_i + 0.5 * ||beta||^2      (intercept not penalised)

Spark ML minimises (1 / sum_i w_i) * sum_i w_i loss_i + 0.5 * regParam *
||beta||^2 with ``standardization=False``; since balanced weights sum to n,
``regParam = 1 / (C * n_train)`` gives the same optimum.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from .levels import LevelVectors
from .prepare import (CATEGORICAL_COLUMNS, ID_COLUMN, LABEL_COLUMN, Imputation, OneHot, RobustScale,
                      numeric_feature_columns, stratified_split)
from .quality import assert_complete

MAX_ITER = 1000
INVERSE_REGULARISATION = 1.0   # C
WEIGHT_COLUMN = "class_weight"
ROWS_PER_TASK = 50_000         # of a solver pass: the time of fewer rows goes into scheduling


def balanced_weights(train: DataFrame, label: str = LABEL_COLUMN) -> tuple[DataFrame, int]:
    """Class weight column n / (2 * n_class) and the row count n.

    The per-class counts are one row per label value (two rows), fetched
    once; the weights then enter the plan as a ``when`` over the label.
    """
    counts = {r[label]: r["_nc"] for r in
              train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc")).collect()}  # one row per class
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for cls, n_class in sorted(counts.items(), reverse=True):
        weight = F.when(F.col(label) == cls, F.lit(n / (2.0 * n_class))).otherwise(weight)
    return train.withColumn(WEIGHT_COLUMN, weight), n


@dataclass
class RiskModel:
    """Numeric inputs and common levels as one dense vector, the other levels
    as sparse ones, so the number of levels adds no columns to a plan."""
    imputation: Imputation
    levels: LevelVectors
    scaler: RobustScale                 # of the numeric inputs
    numeric_columns: list[str]
    classifier: LogisticRegressionModel | None

    # ---- preparation shared by training and scoring
    def prepare(self, features: DataFrame) -> DataFrame:
        return self.assemble(self.imputation.transform(features))

    def assemble(self, imputed: DataFrame) -> DataFrame:
        """Adds the scaled model inputs as one vector; other columns stay raw,
        so scores and reports need no join back to them."""
        missing = {c: F.lit(None).cast("string") for c in self.levels.columns if c not in imputed.columns}
        aligned = imputed.withColumns(missing) if missing else imputed
        # F8: an input the data lacks counts as a raw 0
        numbers = [self.scaler.column(c) if c in imputed.columns else self.scaler.scaled(c, F.lit(0))
                   for c in self.numeric_columns]
        values = [*numbers, *self.levels.scaled_columns(imputed.columns)]
        # with its length stated no row is read to find it
        dense = array_to_vector(F.array(*values)).alias("_dense", metadata={"ml_attr": {"num_attrs": len(values)}})
        with_parts = self.levels.transform(aligned.select("*", dense))
        return (VectorAssembler(inputCols=["_dense", *self.levels.vectors], outputCol="features")
                .transform(with_parts).drop("_dense", *self.levels.vectors, *missing))

    def predict(self, features: DataFrame) -> DataFrame:
        """M3/M4/M12 - the imputed rows with probability of default and class at 0.5."""
        return self.predict_imputed(self.imputation.transform(features))

    def predict_imputed(self, imputed: DataFrame) -> DataFrame:
        out = self.classifier.transform(self.assemble(imputed))
        return (out.withColumn("risk_probability", vector_to_array("probability")[1])
                .drop("features", "rawPrediction", "probability"))

    @property
    def input_names(self) -> list[str | None]:
        """The name of every place of the vector; None where no row holds a value."""
        dense, sparse = self.levels.names
        return [*self.numeric_columns, *dense, *sparse]

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """M10/M11 - one row per feature: coefficient, |coefficient|, rank, direction."""
        pairs = [(name, c) for name, c in zip(self.input_names, self.classifier.coefficients.toArray()) if name]
        return feature_importance(spark, [name for name, _ in pairs], [c for _, c in pairs])

    # ---- IO8 persistence
    def save(self, path: str) -> None:
        self.classifier.write().overwrite().save(os.path.join(path, "classifier"))
        self.levels.indexer.write().overwrite().save(os.path.join(path, "indexer"))
        self.levels.encoder.write().overwrite().save(os.path.join(path, "encoder"))
        state = {"medians": self.imputation.medians, "columns": self.levels.columns, "common": self.levels.common,
                 "center": self.scaler.center, "spread": self.scaler.spread,
                 "numeric_columns": self.numeric_columns}
        spark = SparkSession.getActiveSession()
        (spark.createDataFrame([(json.dumps(state),)], "state string")
         .write.mode("overwrite").json(os.path.join(path, "preparation")))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RiskModel":
        state = json.loads(spark.read.json(os.path.join(path, "preparation")).first()["state"])
        common = {c: {level: tuple(v) for level, v in held.items()} for c, held in state["common"].items()}
        levels = LevelVectors(state["columns"], StringIndexerModel.load(os.path.join(path, "indexer")),
                              OneHotEncoderModel.load(os.path.join(path, "encoder")), common)
        return cls(Imputation(state["medians"]), levels, RobustScale(state["center"], state["spread"]),
                   state["numeric_columns"], LogisticRegressionModel.load(os.path.join(path, "classifier")))


def feature_importance(spark: SparkSession, names: list[str], coefficients) -> DataFrame:
    """M11 - ``feature_importance``: rank by |coefficient| (ties by name).

    The coefficients are the fitted model's parameters, already on the
    driver (one number per model column), so they are ranked there and
    handed to Spark as a small table; no data is collected for this.
    """
    pairs = sorted(((name, float(c)) for name, c in zip(names, coefficients)),
                   key=lambda p: (-abs(p[1]), p[0]))
    rows = [(name, c, abs(c), rank, "Increases Risk" if c > 0 else "Decreases Risk")
            for rank, (name, c) in enumerate(pairs, start=1)]
    return spark.createDataFrame(
        rows, "feature string, coefficient double, abs_coefficient double, rank int, direction string")


def split_and_prepare(features: DataFrame):
    """E2 up to the model input in wide form, for reports over few levels:
    impute (whole population, D3), encode, split, fit the scaler on the
    training rows.  ``train`` keeps levels sparse instead."""
    imputation = Imputation.fit(features)
    imputed = imputation.transform(features)
    assert_complete(imputed)                                 # F6: stop before training
    encoder = OneHot.fit(imputed)
    encoded = encoder.transform(imputed)
    cols = numeric_feature_columns(encoded, encoder)
    # the split table feeds the scaler fit (two passes), the class counts and
    # the solver: materialise it once instead of recomputing the split
    split = store(stratified_split(encoded))
    scaler = RobustScale.fit(split.where(F.col("split") == "train"), cols,
                             binary=[*encoder.output_columns, "is_not_employed"])
    return imputation, encoder, scaler, cols, split


def train(features: DataFrame, max_iter: int = MAX_ITER):
    """M1/M2 - returns (model, imputed rows with their ``split``, iterations)."""
    imputation = Imputation.fit(features)
    imputed = imputation.transform(features)
    assert_complete(imputed)                                 # F6: stop before training
    split = store(stratified_split(imputed))
    train_rows = split.where(F.col("split") == "train")
    numeric = [c for c in imputed.columns if c not in (ID_COLUMN, LABEL_COLUMN, *CATEGORICAL_COLUMNS)]
    scaler = RobustScale.fit(train_rows, numeric, binary=["is_not_employed"])
    prepared = RiskModel(imputation, LevelVectors.fit(split, train_rows), scaler, numeric, None)
    weighted, n_train = balanced_weights(train_rows)
    # every solver pass reads the inputs: three stored columns instead of the plan that prepares them
    inputs = store(prepared.assemble(weighted).select("features", LABEL_COLUMN, WEIGHT_COLUMN))
    inputs = inputs.coalesce(max(1, math.ceil(n_train / ROWS_PER_TASK)))
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL_COLUMN, weightCol=WEIGHT_COLUMN,
                            regParam=1.0 / (INVERSE_REGULARISATION * n_train), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, maxIter=max_iter)
    prepared.classifier = lr.fit(inputs)
    return prepared, split, prepared.classifier.summary.totalIterations
