"""Logistic regression by Newton steps (M1, M2), for models of few inputs.

The objective is that of ``model``: class-weighted logistic loss plus half
the squared coefficients (the intercept is not penalised).  A step needs the
gradient and the matrix of weighted products of the inputs; both come from one
aggregation over the training rows (partial sums per task), so a step moves
one row of (d + 1)(d + 4) / 2 numbers per task.  The d + 1 equations are solved
on the driver.  The steps are plain sums, so SQL can state them too.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import INVERSE_REGULARISATION, WEIGHT_COLUMN, balanced_weights
from .prepare import LABEL_COLUMN, RobustScale

MAX_INPUTS = 100               # the aggregation has a sum for every pair of inputs
MAX_STEPS, TOLERANCE = 50, 1e-10


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def newton_fit(rows: DataFrame, inputs: list[Column], label: str = LABEL_COLUMN, weight: str = WEIGHT_COLUMN,
               penalty: float = 1.0 / INVERSE_REGULARISATION) -> tuple[np.ndarray, int]:
    """(intercept and coefficients, steps) for rows with label 0/1 and weight."""
    if len(inputs) > MAX_INPUTS:
        raise ValueError(f"more than {MAX_INPUTS} inputs; fit them with model.train")
    x = [F.lit(1.0), *inputs]
    d = len(x)
    beta = np.zeros(d)
    ridge = np.diag([0.0] + [penalty] * (d - 1))
    w, y = F.col(weight), F.col(label).cast("double")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    for step in range(1, MAX_STEPS + 1):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta[1:], x[1:])), F.lit(float(beta[0])))
        named = rows.select(w.alias("w"), y.alias("y"), sigmoid(z).alias("p"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
        error, curve = F.col("w") * (F.col("p") - F.col("y")), F.col("w") * F.col("p") * (1 - F.col("p"))
        sums = named.agg(*[F.sum(error * F.col(f"x{i}")).alias(f"g{i}") for i in range(d)],
                         *[F.sum(curve * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs]).first()
        gradient = np.array([sums[f"g{i}"] for i in range(d)]) + ridge @ beta
        matrix = np.zeros((d, d))
        for i, j in pairs:
            matrix[i, j] = matrix[j, i] = sums[f"h{i}_{j}"]
        move = np.linalg.solve(matrix + ridge, gradient)
        beta = beta - move
        if np.abs(move).max() < TOLERANCE:
            return beta, step
    raise ValueError(f"no convergence in {MAX_STEPS} Newton steps")


@dataclass
class LinearModel:
    """A scaled linear model: its inputs, their scaling and coefficients (IO8)."""
    scaler: RobustScale
    coefficients: dict[str, float]
    intercept: float

    @classmethod
    def fit(cls, split: DataFrame, inputs: list[str], label: str = LABEL_COLUMN) -> "LinearModel":
        """Fit on the rows whose ``split`` is train, scaled by their own quartiles."""
        train = split.where(F.col("split") == "train")
        scaler = RobustScale.fit(train, inputs)
        weighted, _ = balanced_weights(train, label)
        beta, _ = newton_fit(weighted, [scaler.column(c) for c in inputs], label)
        return cls(scaler, dict(zip(inputs, beta[1:].tolist())), float(beta[0]))

    def probability(self, present: list[str]) -> Column:
        """M3 - a feature absent from the data counts as 0 (F8)."""
        z = F.lit(self.intercept)
        for name, weight in self.coefficients.items():
            z = z + F.lit(float(weight)) * (self.scaler.column(name) if name in present else F.lit(0.0))
        return sigmoid(z)

    def predict(self, rows: DataFrame) -> DataFrame:
        """M4, M12 - adds the probability of default and the class at 0.5."""
        out = rows.withColumn("risk_probability", self.probability(rows.columns))
        return out.withColumn("prediction", (F.col("risk_probability") > 0.5).cast("int"))

    def terms(self, spark: SparkSession) -> DataFrame:
        """One row per coefficient, the intercept included."""
        return spark.createDataFrame([("intercept", self.intercept), *self.coefficients.items()],
                                     "term string, coefficient double")

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"center": self.scaler.center, "spread": self.scaler.spread,
                 "coefficients": self.coefficients, "intercept": self.intercept}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinearModel":
        state = json.loads(spark.read.schema("state string").json(path).first()["state"])
        return cls(RobustScale(state["center"], state["spread"]), state["coefficients"], state["intercept"])
