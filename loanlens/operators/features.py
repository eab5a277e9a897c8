"""Per-customer behavioural features.

Every child table is reduced to at most one row per customer *before* it is
joined to the customer table (no fan-out), and every reduction is a
partial-aggregatable ``groupBy`` so a customer holding a large share of the
rows is combined map-side before the shuffle.

The installment lateness trend needs each row's recency rank within its
customer (``ROW_NUMBER() OVER (PARTITION BY customer ORDER BY due DESC)``).
Ties on the due day are broken by the payment day (ascending, unpaid last):
that makes rows that still tie carry the same ``days_late``, so the trend is
fully determined (the original order is arbitrary on ties).  With that order
the rank is computed on rows pre-aggregated to distinct (customer, due, paid)
triples; a hot customer contributes at most one row per distinct day pair
to the window, never its raw rows.

``tasks`` (``session.shuffle_tasks`` of the rows) deals installments by (customer,
due, paid), the other children by (customer, month or day), and what is already
reduced by customer, over that many tasks, so that what a task groups, sorts and
joins does not grow with the input; None leaves it to the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import exact_mean, exact_quotient, int_div, mean_of, safe_ratio, sql_round
from ..session import dealt

KEY = "sk_id_curr"


def _dbl(c: Column) -> Column:
    return c.cast("double")


# --------------------------------------------------------------------------
# installments
# --------------------------------------------------------------------------

def lateness_groups(inst: DataFrame, key: str = KEY, due: str = "days_instalment",
                    paid: str = "days_entry_payment", paid_only: bool = False,
                    tasks: int | None = None) -> DataFrame:
    """Installment rows collapsed to (key, due, paid) with a row count.

    ``days_late`` = paid - due is constant inside a group.  With
    ``paid_only`` unpaid rows are removed first (the exploratory variant).
    Dealt rows are not combined before the shuffle: a hot customer's rows go to
    many tasks by their days, and a hot day pair's are only counted in passing.
    """
    rows = inst.select(key, due, paid)
    if paid_only:
        rows = rows.where(F.col(paid).isNotNull())
    return (dealt(rows, tasks, key, due, paid).groupBy(key, due, paid)
            .agg(F.count(F.lit(1)).alias("_cnt"))
            .withColumn("days_late", F.col(paid) - F.col(due)))


def _with_half_split(groups: DataFrame, key: str, due: str, paid: str, tasks: int | None = None) -> DataFrame:
    """Adds, per group, how many of its rows fall in the recent half.

    Recency order: due DESC NULLS FIRST, paid ASC NULLS LAST.  Rank <= n / 2
    (integer division) is the recent half, the rest the earlier half.
    """
    order = Window.partitionBy(key).orderBy(F.col(due).desc_nulls_first(), F.col(paid).asc_nulls_last())
    before = F.coalesce(F.sum("_cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_cnt").over(Window.partitionBy(key))
    g = dealt(groups, tasks, key).withColumn("_before", before).withColumn("_half", int_div(total, 2))
    recent = F.least(F.col("_cnt"), F.greatest(F.col("_half") - F.col("_before"), F.lit(0)))
    return g.withColumn("_recent", recent).withColumn("_earlier", F.col("_cnt") - F.col("_recent"))


def _weighted_mean(x: Column, weight: Column) -> Column:
    """Exact mean of ``x`` where each value stands for ``weight`` rows."""
    w = F.when(x.isNotNull(), weight)
    return exact_quotient(F.sum(x.cast("decimal(18,4)") * w.cast("decimal(12,0)")), F.sum(w))


def _trend(recent_mean: Column, earlier_mean: Column, digits: int) -> Column:
    return _dbl(sql_round(recent_mean - earlier_mean, digits))


def payment_features(inst: DataFrame, key: str = KEY, due: str = "days_instalment",
                     paid: str = "days_entry_payment", tasks: int | None = None) -> DataFrame:
    """A18 - final payment features over all installment rows.

    total_installments, num_late_payments, num_missed_payments,
    avg_days_late (late rows, 1 digit), max_days_late, lateness_trend
    (mean lateness of the recent half minus the earlier half, 1 digit).
    """
    g = _with_half_split(lateness_groups(inst, key, due, paid, tasks=tasks), key, due, paid, tasks)
    dl = F.col("days_late")
    cnt = F.col("_cnt")
    return g.groupBy(key).agg(
        F.sum(cnt).alias("total_installments"),
        F.coalesce(F.sum(F.when(dl > 0, cnt)), F.lit(0)).alias("num_late_payments"),
        F.coalesce(F.sum(F.when(F.col(paid).isNull(), cnt)), F.lit(0)).alias("num_missed_payments"),
        _dbl(sql_round(_weighted_mean(F.when(dl > 0, dl), cnt), 1)).alias("avg_days_late"),
        _dbl(F.max(dl)).alias("max_days_late"),
        _trend(_weighted_mean(dl, F.col("_recent")), _weighted_mean(dl, F.col("_earlier")), 1)
        .alias("lateness_trend"),
    )


def payment_lateness(inst: DataFrame, key: str = KEY, due: str = "days_instalment",
                     paid: str = "days_entry_payment") -> DataFrame:
    """A11 - lateness of paid installments per customer."""
    days_late = (F.col(paid) - F.col(due)).alias("days_late")
    rows = inst.where(F.col(paid).isNotNull()).select(key, days_late)
    dl = F.col("days_late")
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_installments"),
        F.count_if(dl > 0).alias("num_late_payments"),
        _dbl(sql_round(exact_mean(dl, dl > 0), 1)).alias("avg_days_late"),
        _dbl(F.max(dl)).alias("max_days_late"),
    )


def missed_payments(inst: DataFrame, key: str = KEY, paid: str = "days_entry_payment") -> DataFrame:
    """A13 - installments never paid, per customer (customers with none absent)."""
    return (inst.where(F.col(paid).isNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("num_missed_payments")))


def lateness_trend_paid(inst: DataFrame, key: str = KEY, due: str = "days_instalment",
                        paid: str = "days_entry_payment", tasks: int | None = None) -> DataFrame:
    """A14 - exploratory trend: unpaid rows removed *before* ranking."""
    g = _with_half_split(lateness_groups(inst, key, due, paid, paid_only=True, tasks=tasks), key, due, paid, tasks)
    dl = F.col("days_late")
    recent = _weighted_mean(dl, F.col("_recent"))
    earlier = _weighted_mean(dl, F.col("_earlier"))
    return g.groupBy(key).agg(
        _dbl(sql_round(recent, 1)).alias("avg_late_recent_half"),
        _dbl(sql_round(earlier, 1)).alias("avg_late_earlier_half"),
        _trend(recent, earlier, 1).alias("lateness_trend"),
    )


# --------------------------------------------------------------------------
# monthly balances
# --------------------------------------------------------------------------

def _reduced(df: DataFrame, key: str, part: str, tasks: int | None,
             states: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """One row per ``key`` of the named states, each a (``F.sum``, ``F.count``,
    ``F.min`` or ``F.max``, value).

    Dealt rows are reduced by (key, part) and then by key: a step holds no more
    groups than its task has rows, whereas a map-side combine of a split holds every
    customer in it.  A hot customer's rows go to many tasks by their parts, and
    their second step reads one row per part.
    """
    once = [made(value).alias(name) for name, (made, value) in states.items()]
    if not tasks:
        return df.groupBy(key).agg(*once)
    parts = dealt(df, tasks, key, part).groupBy(key, part).agg(*once)
    # another number than the joins' tasks, else these would hold the pages of every child's step as well
    return dealt(parts, tasks + 1, key).groupBy(key).agg(
        *[(F.sum if made is F.count else made)(name).alias(name) for name, (made, _) in states.items()])


def _recent(months: Column) -> Column:
    return months >= -6


def _prior(months: Column) -> Column:
    return months.between(-12, -7)


def _mean_states(x: Column, months: Column) -> dict[str, tuple[Callable[[Column], Column], Column]]:
    """Sum and count of ``x`` over all, the recent and the prior months."""
    spans = {"overall": x, "recent": F.when(_recent(months), x), "prior": F.when(_prior(months), x)}
    return {f"_{state}_{span}": (made, value) for span, value in spans.items()
            for state, made in (("total", F.sum), ("count", F.count))}


def utilization(cc: DataFrame, key: str = KEY, months: str = "months_balance",
                balance: str = "amt_balance", limit: str = "amt_credit_limit_actual",
                detailed: bool = True, tasks: int | None = None) -> DataFrame:
    """A15 (detailed) / A19 - card utilization level and trend, 3 digits.

    utilization = balance / NULLIF(limit, 0); a zero limit drops the month.
    """
    u = safe_ratio(F.col(balance), F.col(limit))
    kind = cc.select(u.alias("u")).schema["u"].dataType
    held = _reduced(cc, key, months, tasks, _mean_states(u, F.col(months)))
    overall, recent, prior = (mean_of(F.col(f"_total_{span}"), F.col(f"_count_{span}"), kind)
                              for span in ("overall", "recent", "prior"))
    cols = [_dbl(sql_round(overall, 3)).alias("avg_utilization_overall")]
    if detailed:
        cols += [_dbl(sql_round(recent, 3)).alias("avg_utilization_recent_6mo"),
                 _dbl(sql_round(prior, 3)).alias("avg_utilization_prior_6mo")]
    cols.append(_trend(recent, prior, 3).alias("utilization_trend"))
    return held.select(key, *cols)


def dpd_features(pos: DataFrame, key: str = KEY, months: str = "months_balance",
                 dpd: str = "sk_dpd", detailed: bool = True, tasks: int | None = None) -> DataFrame:
    """A16 (detailed) / A20 - days-past-due level, worst value and trend, 1 digit."""
    d = F.col(dpd)
    held = _reduced(pos, key, months, tasks, {**_mean_states(d.cast("decimal(18,4)"), F.col(months)),
                                              "max_dpd_ever": (F.max, d)})
    overall, recent, prior = (exact_quotient(F.col(f"_total_{span}"), F.col(f"_count_{span}"))
                              for span in ("overall", "recent", "prior"))
    cols = [_dbl(sql_round(overall, 1)).alias("avg_dpd_overall"), F.col("max_dpd_ever")]
    if detailed:
        cols += [_dbl(sql_round(recent, 1)).alias("avg_dpd_recent_6mo"),
                 _dbl(sql_round(prior, 1)).alias("avg_dpd_prior_6mo")]
    cols.append(_trend(recent, prior, 1).alias("dpd_trend"))
    return held.select(key, *cols)


# --------------------------------------------------------------------------
# external credit
# --------------------------------------------------------------------------

def bureau_features(bureau: DataFrame, key: str = KEY, status: str = "credit_active",
                    days_credit: str = "days_credit", overdue: str = "credit_day_overdue",
                    debt: str = "amt_credit_sum_debt", tasks: int | None = None) -> DataFrame:
    """A17 / A21 - external accounts: counts by status, history length,
    worst overdue, total debt (0 digits)."""
    s = F.col(status)
    held = _reduced(bureau, key, days_credit, tasks, {
        "num_bureau_accounts": (F.count, F.lit(1)),
        "num_active_accounts": (F.count, F.when(s == "Active", 1)),
        "num_closed_accounts": (F.count, F.when(s == "Closed", 1)),
        "_first_credit": (F.min, F.col(days_credit)),
        "max_external_overdue_days": (F.max, F.col(overdue)),
        "_debt": (F.sum, F.col(debt)),
    })
    return held.select(
        key, "num_bureau_accounts", "num_active_accounts", "num_closed_accounts",
        (-F.col("_first_credit")).alias("credit_history_length_days"),
        "max_external_overdue_days",
        _dbl(sql_round(F.col("_debt"), 0)).alias("total_external_debt"),
    )


# --------------------------------------------------------------------------
# assembly
# --------------------------------------------------------------------------

# FIXED VALUES: output layout of the customer feature table, in order.
BASE_COLUMNS = ["sk_id_curr", "target", "name_contract_type", "code_gender", "age_years",
                "employment_years", "income", "amt_credit", "amt_annuity", "cnt_children",
                "cnt_fam_members", "name_education_type", "name_family_status",
                "name_housing_type", "occupation_type", "ext_source_1", "ext_source_2",
                "ext_source_3"]
PAYMENT_COLUMNS = ["total_installments", "num_late_payments", "num_missed_payments",
                   "avg_days_late", "max_days_late", "lateness_trend"]
CARD_COLUMNS = ["avg_utilization_overall", "utilization_trend"]
POS_COLUMNS = ["avg_dpd_overall", "max_dpd_ever", "dpd_trend"]
BUREAU_COLUMNS = ["num_bureau_accounts", "num_active_accounts", "num_closed_accounts",
                  "credit_history_length_days", "max_external_overdue_days",
                  "total_external_debt"]
FEATURE_COLUMNS = BASE_COLUMNS + PAYMENT_COLUMNS + CARD_COLUMNS + POS_COLUMNS + BUREAU_COLUMNS


def base_columns(stg: DataFrame) -> DataFrame:
    """Demographic part of the feature table, from the cleaned applications."""
    from ..functions.numeric import years_from_days
    return stg.select(
        "sk_id_curr", "target", "name_contract_type", "code_gender",
        years_from_days(F.col("days_birth")).alias("age_years"),
        years_from_days(F.col("days_employed_clean")).alias("employment_years"),
        _dbl(F.col("amt_income_total_clean")).alias("income"),
        _dbl(F.col("amt_credit")).alias("amt_credit"),
        _dbl(F.col("amt_annuity")).alias("amt_annuity"),
        "cnt_children",
        _dbl(F.col("cnt_fam_members")).alias("cnt_fam_members"),
        "name_education_type", "name_family_status", "name_housing_type", "occupation_type",
        _dbl(F.col("ext_source_1")).alias("ext_source_1"),
        _dbl(F.col("ext_source_2")).alias("ext_source_2"),
        _dbl(F.col("ext_source_3")).alias("ext_source_3"),
    )


def customer_features(stg: DataFrame, inst: DataFrame, cc: DataFrame, pos: DataFrame,
                      bureau: DataFrame, key: str = KEY, tasks: int | None = None) -> DataFrame:
    """J1-J4 - one row per cleaned customer with all 35 feature columns.

    Children are aggregated first, then left-joined on the key; a customer
    missing from a child gets nulls (also for its counts).
    """
    out = dealt(base_columns(stg), tasks, key)
    for child in (payment_features(inst, key, tasks=tasks),
                  utilization(cc, key, detailed=False, tasks=tasks),
                  dpd_features(pos, key, detailed=False, tasks=tasks),
                  bureau_features(bureau, key, tasks=tasks)):
        out = out.join(dealt(child, tasks, key), on=key, how="left")
    return out.select(*FEATURE_COLUMNS)


def child_activity(installments: DataFrame, cards: DataFrame) -> DataFrame:
    """Per customer with installments: how many, how many unpaid, the card
    months and the latest one (J1, J2).  Both sides are reduced by the customer key first;
    over tables bucketed on it (K3) neither that nor the join shuffles."""
    paid = installments.groupBy("sk_id_curr").agg(
        F.count(F.lit(1)).alias("installments"),
        F.count_if(F.col("days_entry_payment").isNull()).alias("unpaid"))
    months = cards.groupBy("sk_id_curr").agg(F.count(F.lit(1)).alias("card_months"),
                                             F.max("months_balance").alias("latest_month"))
    return (paid.join(months.hint("merge"), "sk_id_curr", "left")
            .select("sk_id_curr", "installments", "unpaid", F.coalesce("card_months", F.lit(0)).alias("card_months"),
                    "latest_month"))
