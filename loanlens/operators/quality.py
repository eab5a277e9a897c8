"""Profiling, key checks and data-quality gates.

Each function returns a small DataFrame (one row, or one row per category);
all of them are single-pass aggregations with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean, exact_quotient, int_div, sql_round
from ..session import store
from .clean import EMPLOYED_SENTINEL, GENDER_PLACEHOLDER, INCOME_CAP
from .selection import column_quantiles


def _pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """ROUND(100.0 * part / whole, digits) with exact decimals, as double."""
    return sql_round(exact_quotient(part.cast("decimal(30,4)") * 100, whole), digits).cast("double")


def _constants(values: dict[str, float | None]) -> list[Column]:
    """Fitted numbers as columns of doubles."""
    return [F.lit(v).cast("double").alias(name) for name, v in values.items()]


def _one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Fitted numbers as a table of one row."""
    return df.sparkSession.range(1).select(*_constants(values))


# ---------------------------------------------------------------- keys
def key_violations(df: DataFrame, key: str | list[str]) -> DataFrame:
    """K1/K2 - key values that occur more than once, or are null, with counts."""
    keys = [key] if isinstance(key, str) else list(key)
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
            .where((F.col("row_count") > 1) | null_key))


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """K2 - ``GROUP BY key HAVING COUNT(*) > 1``."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
            .where(F.col("row_count") > 1))


def assert_primary_key(df: DataFrame, key: str | list[str]) -> None:
    """K1 - fail when the key is not unique and not null (Spark enforces no keys)."""
    bad = key_violations(df, key).limit(1).count()
    if bad:
        raise ValueError(f"primary key {key!r} violated (duplicate or null values)")


# ---------------------------------------------------------------- profiles
def portfolio_default_rate(app: DataFrame, target: str = "target") -> DataFrame:
    """A1 - customers, defaults and default rate in percent (2 digits)."""
    return app.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum(target).cast("long").alias("total_defaults"),
        _pct(F.sum(target), F.count(F.lit(1))).alias("default_rate_pct"),
    )


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A2 - total rows and ``COUNT(*) - COUNT(c)`` for each column, one pass."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  *[(F.count(F.lit(1)) - F.count(c)).alias(f"missing_{c}") for c in columns])


def segment_profile(app: DataFrame, segment: str = "name_contract_type",
                    credit: str = "amt_credit", income: str = "amt_income_total") -> DataFrame:
    """A3 + W4 - per segment: count, share of the portfolio, mean loan and
    income (0 digits), largest segment first.  The share's denominator is the
    sum over the grouped result, a scalar subquery evaluated once."""
    grouped = app.groupBy(segment).agg(
        F.count(F.lit(1)).alias("num_customers"),
        sql_round(exact_mean(F.col(credit)), 0).cast("double").alias("avg_loan_amount"),
        sql_round(exact_mean(F.col(income)), 0).cast("double").alias("avg_income"),
    )
    portfolio = grouped.agg(F.sum("num_customers")).scalar()
    return (grouped
            .withColumn("pct_of_portfolio", _pct(F.col("num_customers"), portfolio))
            .select(segment, "num_customers", "pct_of_portfolio", "avg_loan_amount", "avg_income")
            .orderBy(F.col("num_customers").desc()))


def age_bucket(days_birth: Column) -> Column:
    """P7 - integer years (truncating division) bucketed."""
    years = int_div(-days_birth, 365)
    return (F.when(years < 30, "Under 30").when(years < 45, "30-44")
            .when(years < 60, "45-59").otherwise("60+"))


def gender_age_default(app: DataFrame, gender: str = "code_gender", days_birth: str = "days_birth",
                       target: str = "target") -> DataFrame:
    """A4 - default rate by gender x age bucket, placeholder gender excluded."""
    return (app.where(F.col(gender) != GENDER_PLACEHOLDER)
            .withColumn("age_bucket", age_bucket(F.col(days_birth)))
            .groupBy(gender, "age_bucket")
            .agg(F.count(F.lit(1)).alias("num_customers"),
                 _pct(F.sum(target), F.count(F.lit(1))).alias("default_rate_pct"))
            .orderBy(gender, "age_bucket"))


def sentinel_share(app: DataFrame, column: str = "days_employed",
                   sentinel: int = EMPLOYED_SENTINEL) -> DataFrame:
    """A5 - rows carrying the sentinel, count and percent."""
    hit = F.count_if(F.col(column) == sentinel)
    return app.agg(F.count(F.lit(1)).alias("total_rows"), hit.alias("anomalous_rows"),
                   _pct(hit, F.count(F.lit(1))).alias("pct_anomalous"))


def category_frequency(df: DataFrame, column: str) -> DataFrame:
    """A6 - rows per category value (null is its own group)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def income_outliers(app: DataFrame, income: str = "amt_income_total") -> DataFrame:
    """A7 - min, max, mean (0 digits), exact median and 99th percentile.

    The mean is an exact decimal sum; the percentiles are found by refinement.
    """
    v = F.col(income)
    known = app.agg(F.count(v).alias("n"), F.min(v).cast("double").alias("min_income"),
                    F.max(v).cast("double").alias("max_income"),
                    sql_round(exact_mean(v), 0).cast("double").alias("avg_income")).first()
    q = column_quantiles(app, [income], {"median_income": 0.5, "p99_income": 0.99}, counts={income: known["n"]})[income]
    return _one_row(app, {**{c: known[c] for c in ("min_income", "max_income", "avg_income")}, **q})


def count_above(df: DataFrame, column: str = "amt_income_total", ceiling: int = INCOME_CAP) -> DataFrame:
    """A8 - rows above a ceiling."""
    return df.agg(F.count_if(F.col(column) > ceiling).alias("count"))


def cleaned_view_check(stg: DataFrame) -> DataFrame:
    """A9 - rows, largest capped income, sentinel rows left as nulls."""
    return stg.agg(F.count(F.lit(1)).alias("row_count"),
                   F.max("amt_income_total_clean").cast("double").alias("max_income_clean"),
                   (F.count(F.lit(1)) - F.count("days_employed_clean")).alias("still_have_nulls"))


def null_payments(inst: DataFrame, amount: str = "amt_payment") -> DataFrame:
    """A9 (installments) - rows and rows without a payment amount."""
    return inst.agg(F.count(F.lit(1)).alias("row_count"),
                    (F.count(F.lit(1)) - F.count(amount)).alias("null_payments"))


def zero_limit_rows(cc: DataFrame, limit: str = "amt_credit_limit_actual") -> DataFrame:
    """A10 - card months with a zero limit (why the ratio needs NULLIF)."""
    return cc.agg(F.count_if(F.col(limit) == 0).alias("zero_limit_rows"))


def distinct_per_category(df: DataFrame, columns: list[str]) -> DataFrame:
    """A26 - ``nunique()`` per text column (nulls excluded), one pass."""
    return df.agg(*[F.count_distinct(c).alias(f"{c}_levels") for c in columns])


def total_missing_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A28 - ``isnull().sum().sum()``."""
    cols = columns or df.columns
    expr = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    return df.agg(expr.cast("long").alias("missing_cells"))


def assert_complete(df: DataFrame, columns: list[str] | None = None) -> None:
    """F6 - completeness gate: fail if any cell is still null."""
    n = total_missing_cells(df, columns).first()["missing_cells"]
    if n:
        raise ValueError(f"{n} missing cells remain after imputation")


def class_balance(df: DataFrame, split: str = "split", target: str = "target") -> DataFrame:
    """A29 - rows and default rate per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"),
                                 F.avg(F.col(target).cast("double")).alias("default_rate"))


def lateness_distribution(inst: DataFrame, due: str = "days_instalment",
                          paid: str = "days_entry_payment") -> DataFrame:
    """A12 - exact p50/p95/p99 and max of lateness over late, paid rows."""
    # stored: the refinement reads this one column several times, not the rows behind it
    late = store(inst.where(F.col(paid).isNotNull())
                 .select((F.col(paid) - F.col(due)).alias("days_late"))
                 .where(F.col("days_late") > 0))
    known = late.agg(F.count("days_late").alias("n"), F.max("days_late").cast("double").alias("max_late")).first()
    q = column_quantiles(late, ["days_late"], {"median_late": 0.5, "p95_late": 0.95, "p99_late": 0.99},
                         counts={"days_late": known["n"]})["days_late"]
    return _one_row(late, {**q, "max_late": known["max_late"]})


def numeric_summary(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """A25 - ``describe()``: count, mean, sample std, min, exact quartiles, max.

    With ``digits`` (values known to carry at most that many decimals) the
    mean and the variance are accumulated exactly in integer units, so they do
    not depend on the order rows are added in:
    var = (N * sum(u^2) - sum(u)^2) / (N (N - 1)).  Without it they are Spark's
    merged central moments.
    """
    c = F.col(column).cast("double")
    mean, std = F.avg(c), F.stddev_samp(c)
    if digits is not None:
        scale = 10 ** digits
        units = F.round(c * scale).cast("decimal(19,0)")
        total, rows = F.sum(units), F.count(c).cast("decimal(38,0)")
        squares = F.sum((units * units).cast("decimal(38,0)"))
        mean = total.cast("double") / (F.lit(float(scale)) * F.nullif(F.count(c), F.lit(0)).cast("double"))
        spread = (rows * squares - total * total).cast("double")
        pairs = F.nullif(rows * (rows - 1), F.lit(0)).cast("double")
        std = F.sqrt(spread / pairs) / F.lit(float(scale))
    q = column_quantiles(df, [column], {"q25": 0.25, "q50": 0.5, "q75": 0.75})[column]
    return (df.agg(F.count(c).alias("count"), mean.alias("mean"), std.alias("std"), F.min(c).alias("min"),
                   F.max(c).alias("max"))
            .select("*", *_constants(q)))
