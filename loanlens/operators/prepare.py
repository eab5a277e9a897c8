"""Feature preparation for the risk model.

Fitted state is small by construction - one number per feature column, one
list of levels per text column - so it is brought to the driver and applied
back as literals.  The data itself never leaves the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from .selection import column_quantiles

# FIXED VALUES: the imputation groups of the original preparation.
ZERO_FILL_COLUMNS = [
    "avg_utilization_overall", "avg_dpd_overall", "max_dpd_ever",
    "num_bureau_accounts", "num_active_accounts", "num_closed_accounts",
    "credit_history_length_days", "max_external_overdue_days", "total_external_debt",
    "avg_days_late", "max_days_late", "num_late_payments", "num_missed_payments",
    "total_installments",
]
TREND_COLUMNS = ["lateness_trend", "utilization_trend", "dpd_trend"]
MEDIAN_FILL_COLUMNS = ["ext_source_1", "ext_source_2", "ext_source_3", "amt_annuity",
                       "cnt_fam_members"]
CATEGORICAL_COLUMNS = ["name_contract_type", "code_gender", "name_education_type",
                       "name_family_status", "name_housing_type", "occupation_type"]
ID_COLUMN, LABEL_COLUMN = "sk_id_curr", "target"
UNKNOWN_OCCUPATION = "Unknown"
CLIP_LIMIT = 10.0
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
TEST_SHARE_TENTHS = 2          # 20 % test share
SPLIT_SEED = 42
HASH_BITS, PREFIX_BITS = 60, 12
SPLIT_FETCH = 10_000           # rows of the last prefixes that are ranked on the driver


def binary_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> dict[str, dict]:
    """The quantiles of 0/1 columns, from their row counts and sums."""
    if not columns:
        return {}
    r = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)],
               *[F.sum(F.col(f"`{c}`").cast("long")).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        n, zeros = r[f"n{i}"], r[f"n{i}"] - (r[f"k{i}"] or 0)
        out[c] = {name: binary_position(n, zeros, p) for name, p in probs.items()}
    return out


def binary_position(n: int, zeros: int, p: float) -> float | None:
    """The p quantile of ``zeros`` zeros among n values of 0 and 1."""
    if n == 0:
        return None
    pos = (n - 1) * p
    lo, hi = math.floor(pos), math.ceil(pos)
    low, high = float(lo >= zeros), float(hi >= zeros)
    return low + (high - low) * (pos - lo)


# ---------------------------------------------------------------- imputation
@dataclass
class Imputation:
    medians: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] = MEDIAN_FILL_COLUMNS) -> "Imputation":
        """F3 - interpolated medians of the non-null values (pandas median)."""
        q = column_quantiles(df, columns, {"median": 0.5})
        return cls({c: q[c]["median"] for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        """F1, F2, F3, F4, F5 in the original order."""
        fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                 for c in ZERO_FILL_COLUMNS + TREND_COLUMNS if c in df.columns}
        for c, m in self.medians.items():
            fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(m))
        out = df.withColumns(fills)
        out = out.withColumn("is_not_employed", F.col("employment_years").isNull().cast("int"))
        return out.withColumns({
            "employment_years": F.coalesce(F.col("employment_years"), F.lit(0.0)),
            "occupation_type": F.coalesce(F.col("occupation_type"), F.lit(UNKNOWN_OCCUPATION)),
        })


# ---------------------------------------------------------------- encoding
@dataclass
class OneHot:
    """F7/F8 - one 0/1 column per level except the alphabetically first one.

    Columns are named ``<column>_<level>`` and ordered by column, then level.
    A level unseen at fit time, and null, encode as all zeros - as does the
    baseline level.
    """
    levels: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> "OneHot":
        pairs = melt_text(df, columns).distinct()
        found: dict[str, list[str]] = {c: [] for c in columns}
        for r in pairs.collect():      # one row per output column, as the encoding itself has
            found[r["feature"]].append(r["value"])
        return cls({c: sorted(v)[1:] for c, v in found.items()})

    @property
    def output_columns(self) -> list[str]:
        return [f"{c}_{lv}" for c, lvs in self.levels.items() for lv in lvs]

    def transform(self, df: DataFrame, keep_source: bool = False) -> DataFrame:
        dummies = {f"{c}_{lv}": F.coalesce((F.col(c) == lv).cast("int"), F.lit(0))
                   for c, lvs in self.levels.items() for lv in lvs}
        out = df.withColumns(dummies)
        return out if keep_source else out.drop(*self.levels.keys())


def melt_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide -> long: one (feature, value) row per non-null text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value"))
                      for c in columns])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def numeric_feature_columns(df: DataFrame, encoder: OneHot) -> list[str]:
    """F9 - model inputs: every column but id, label and text, then dummies."""
    skip = {ID_COLUMN, LABEL_COLUMN, *encoder.levels.keys(), *encoder.output_columns}
    return [c for c in df.columns if c not in skip] + encoder.output_columns


# ---------------------------------------------------------------- split
def split_hash(id_col: str = ID_COLUMN, seed: int = SPLIT_SEED) -> Column:
    """A reproducible 60-bit number per id: md5('<seed>:<id>'), first 15 hex digits."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def split_thresholds(df: DataFrame, label: str, id_col: str, seed: int, fetch: int = SPLIT_FETCH) -> dict:
    """{class: (hash, id)} of the last test row of each class.

    The k-th smallest hash by prefixes: rows are counted by class and the
    hash's leading bits, the prefix that holds the k-th row is kept, and its
    next bits are counted, until the rows left are few enough to fetch and
    rank.  Only counts are shuffled; ``PREFIX_BITS`` bits give at most 4096 rows
    a class and round."""
    h = split_hash(id_col, seed)
    rows = df.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(label).alias("label"), h.alias("hash"), F.col(id_col).alias("id"))
    wanted: dict = {}          # class -> (prefix, bits of it, rows still to skip)
    shift = HASH_BITS - PREFIX_BITS
    prefix = F.shiftright("hash", shift)
    found = rows.groupBy("label", prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()   # prefixes only
    totals: dict = {}
    for r in found:
        totals[r["label"]] = totals.get(r["label"], 0) + r["n"]
    # round(0.2 n), halves up; the k-th row is the last of the test set
    skip = {c: (n * TEST_SHARE_TENTHS * 2 + 10) // 20 - 1 for c, n in totals.items()}
    open_ = {c: k for c, k in skip.items() if k >= 0}
    while True:
        sizes = {}
        for c, left in open_.items():
            for r in sorted((r for r in found if r["label"] == c), key=lambda r: r["prefix"]):
                if left < r["n"]:
                    wanted[c], open_[c], sizes[c] = r["prefix"], left, r["n"]
                    break
                left -= r["n"]
        inside = F.lit(False)
        for c in open_:
            inside = inside | ((F.col("label") == F.lit(c)) & (F.shiftright("hash", shift) == F.lit(wanted[c])))
        held = rows.where(inside)
        if shift == 0 or sum(sizes.values()) <= fetch:
            break
        shift = max(0, shift - PREFIX_BITS)
        found = held.groupBy("label", F.shiftright("hash", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()
    last: dict = {}
    # equal rows (one id on many rows) are one row with its count
    few = sorted(held.groupBy("label", "hash", "id").agg(F.count(F.lit(1)).alias("n")).collect(),
                 key=lambda r: (r["hash"], r["id"]))
    for c, left in open_.items():
        for r in (r for r in few if r["label"] == c):
            if left < r["n"]:
                last[c] = (r["hash"], r["id"])
                break
            left -= r["n"]
    return last


def stratified_split(df: DataFrame, label: str = LABEL_COLUMN, id_col: str = ID_COLUMN,
                     seed: int = SPLIT_SEED) -> DataFrame:
    """F10 - adds ``split`` ('train'/'test'): within each class the rows with
    the smallest hashes, round(0.2 * class size) of them, are the test set.
    Exact class shares.  The last test row of each class is found by prefix
    counts and is a threshold that a filter applies to the rows, which never
    move.  A null label or id is training data."""
    h = split_hash(id_col, seed)
    is_test = F.lit(False)
    for c, (hashed, key) in split_thresholds(df, label, id_col, seed).items():
        is_test = is_test | ((F.col(label) == F.lit(c)) & (
            (h < hashed) | ((h == hashed) & (F.col(id_col) <= F.lit(key)))))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


# ---------------------------------------------------------------- scaling
@dataclass
class RobustScale:
    """F11/F12 - (x - median) / (q75 - q25), a zero spread divides by 1,
    fitted on training rows only; then clipped to +-10."""
    center: dict[str, float] = field(default_factory=dict)
    spread: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], binary: list[str] | None = None) -> "RobustScale":
        """``binary``: columns of 0 and 1, whose quartiles follow from their
        counts in one aggregation; only the others are searched."""
        binary = [c for c in binary or [] if c in columns]
        q = column_quantiles(df, [c for c in columns if c not in binary], QUARTILES)
        q |= binary_quantiles(df, binary, QUARTILES)
        center, spread = {}, {}
        for c in columns:
            iqr = (q[c]["q75"] or 0.0) - (q[c]["q25"] or 0.0)
            center[c] = q[c]["q50"] or 0.0
            spread[c] = iqr if iqr != 0 else 1.0
        return cls(center, spread)

    def column(self, c: str, clip_limit: float | None = CLIP_LIMIT) -> Column:
        """The scaled (and clipped) value of one column."""
        return self.scaled(c, F.col(f"`{c}`"), clip_limit)

    def scaled(self, c: str, value: Column, clip_limit: float | None = CLIP_LIMIT) -> Column:
        """A value scaled as those of column ``c``."""
        v = (value.cast("double") - F.lit(self.center[c])) / F.lit(self.spread[c])
        return clip(v, -clip_limit, clip_limit) if clip_limit is not None else v

    def transform(self, df: DataFrame, clip_limit: float | None = CLIP_LIMIT) -> DataFrame:
        return df.withColumns({c: self.column(c, clip_limit) for c in self.center})


def describe_columns(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """A25 over many columns - ``describe()`` with one row per column: count,
    mean and sample std (rounded), min, exact quartiles, max.  Mean and std
    come from Spark's merged central moments, which do not cancel on large
    values; the quartiles are found by refinement."""
    q = column_quantiles(df, columns, QUARTILES)
    value = lambda c: F.col(f"`{c}`").cast("double")
    row = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(value(c)).alias(f"n{i}"), F.avg(value(c)).alias(f"mean{i}"), F.stddev_samp(value(c)).alias(f"std{i}"),
        F.min(value(c)).alias(f"min{i}"), F.max(value(c)).alias(f"max{i}"))])
    number = lambda x: F.lit(x).cast("double")
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").alias("count"), (F.round(F.col(f"mean{i}"), digits) + 0.0).alias("mean"),
        F.round(F.col(f"std{i}"), digits).alias("std"), F.col(f"min{i}").alias("min"),
        *[number(q[c][name]).alias(name) for name in QUARTILES], F.col(f"max{i}").alias("max"))
        for i, c in enumerate(columns)])))


def target_correlations(df: DataFrame, columns: list[str], label: str = LABEL_COLUMN) -> DataFrame:
    """F13 - Pearson correlation of every feature with the label, one pass."""
    return df.agg(*[F.corr(F.col(f"`{c}`").cast("double"), F.col(label).cast("double")).alias(c)
                    for c in columns])
