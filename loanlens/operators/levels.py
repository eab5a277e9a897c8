"""Categories as sparse vectors (F7, F8): model inputs for columns of very many levels.

Every level but the alphabetically first is an input of 0 or 1, as in
``prepare.OneHot``, but a row holds only its own levels: an index over the
sorted levels (Spark ML's) and one sparse vector per column.  Levels unseen at
fit time, nulls and the first level are all zeros.

Inputs are robust-scaled like the others.  For a 0/1 input that changes
something only if at least a quarter of the rows hold the level; these few
levels (at most 4 of a column, beyond tiny tables) become columns of their own, scaled, and the rest stays
sparse and as it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prepare import CATEGORICAL_COLUMNS, CLIP_LIMIT, QUARTILES, RobustScale, binary_position, melt_text


def _index(c: str) -> str:
    return f"{c}__index"


def _vector(c: str) -> str:
    return f"{c}__levels"


@dataclass
class LevelVectors:
    columns: list[str]
    indexer: StringIndexerModel
    encoder: OneHotEncoderModel
    common: dict[str, dict[str, tuple[float, float]]]      # column -> level -> (center, spread)

    @classmethod
    def fit(cls, rows: DataFrame, train: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> "LevelVectors":
        """Levels from all ``rows``, their scaling from the ``train`` rows."""
        indexer = StringIndexer(inputCols=columns, outputCols=[_index(c) for c in columns],
                                stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
        n = train.count()
        # only a level on this many rows has an upper quartile above 0
        least = n - math.ceil((n - 1) * QUARTILES["q75"])
        held = melt_text(train, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("k"))
        common: dict[str, dict[str, tuple[float, float]]] = {c: {} for c in columns}
        for r in held.where(F.col("k") >= max(1, least)).collect():        # a few levels of each column
            q = {name: binary_position(n, n - r.k, p) for name, p in QUARTILES.items()}
            spread = q["q75"] - q["q25"]
            common[r.feature][r.value] = (q["q50"], spread if spread else 1.0)
        firsts = {c: labels[0] for c, labels in zip(columns, indexer.labelsArray) if labels}
        for c, first in firsts.items():
            common[c].pop(first, None)
        made = cls(columns, indexer, None, common)
        made.encoder = OneHotEncoder(inputCols=[_index(c) for c in columns], outputCols=[_vector(c) for c in columns],
                                     dropLast=True).fit(made._indexed(rows.limit(0)))
        return made

    def _indexed(self, rows: DataFrame) -> DataFrame:
        """Adds the level numbers; those that are not in a vector get the number after the last."""
        out = self.indexer.transform(rows)
        numbers = {}
        for c, labels in zip(self.columns, self.indexer.labelsArray):
            outside = F.col(_index(c)) == 0
            if self.common[c]:
                outside = outside | F.coalesce(F.col(f"`{c}`").isin(*self.common[c]), F.lit(False))
            size = max(1, len(labels))
            number = F.when(outside, F.lit(float(size))).otherwise(F.col(_index(c)))
            numbers[_index(c)] = number.alias(_index(c), metadata={"ml_attr": {"type": "nominal", "num_vals": size + 1}})
        return out.select(*[x for x in out.columns if x not in numbers], *numbers.values())

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds the sparse vectors."""
        return self.encoder.transform(self._indexed(rows)).drop(*[_index(c) for c in self.columns])

    @property
    def vectors(self) -> list[str]:
        return [_vector(c) for c in self.columns]

    def scaled_columns(self, present: list[str]) -> list[Column]:
        """The common levels as scaled numbers, in the order of ``names``."""
        out = []
        for c in self.columns:
            for level, (center, spread) in sorted(self.common[c].items()):
                x = F.coalesce((F.col(f"`{c}`") == level).cast("int"), F.lit(0)) if c in present else F.lit(0)
                out.append(RobustScale({level: center}, {level: spread}).scaled(level, x, CLIP_LIMIT))
        return out

    @property
    def names(self) -> tuple[list[str], list[str | None]]:
        """Input names: of the common levels, then of the vectors' places (None
        for places no row ever holds)."""
        dense = [f"{c}_{level}" for c in self.columns for level in sorted(self.common[c])]
        sparse: list[str | None] = []
        for c, labels in zip(self.columns, self.indexer.labelsArray):
            sparse += [None if i == 0 or level in self.common[c] else f"{c}_{level}" for i, level in enumerate(labels)]
            sparse += [None] * (not labels)
        return dense, sparse
