"""Lending-shaped tables derived from the driver's TPC-H-like tables.

The original lending files are not available, so every raw table is derived
from the given parquet tables with plain column arithmetic (no sampling, no
row caps): the derived tables grow exactly with the inputs.  The same
derivations are written as SQL in ``loanlens.plans.standin_sql`` so that DuckDB
can rebuild identical inputs.

| lending table              | from                 |
| raw_application_train      | customer             |
| raw_installments_payments  | lineitem joined to orders (on the order key) |
| raw_credit_card_balance    | orders               |
| raw_pos_cash_balance       | events               |
| raw_bureau                 | orders               |

Only columns that some query reads are produced; the remaining raw columns
exist in ``schemas`` for CSV loading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_scans, dealt, shuffle_tasks
from .schemas import AMOUNT

# Day and month offsets are counted from this "application date".
REFERENCE_DATE = "2001-08-01"
# Installment due day = order day + this many days.
DUE_SHIFT_DAYS = 36
# Every PUNCTUAL-th customer pays what they pay before it is due.
PUNCTUAL = 4
# Card limit of every account that is not in status 'P' (those get 0).
CARD_LIMIT = 500000

# FIXED VALUES: category labels used for the derived application columns.
EDUCATION_LEVELS = ["Secondary / secondary special", "Higher education",
                    "Incomplete higher", "Lower secondary"]
FAMILY_STATUSES = ["Married", "Single / not married", "Civil marriage"]
HOUSING_TYPES = ["House / apartment", "With parents", "Rented apartment"]
OCCUPATIONS = ["Laborers", "Sales staff", "Core staff", "Managers", "Drivers",
               "Accountants"]


# Declared schemas of the driver tables that are read (TESTDATA.md): with a
# declared schema the scan skips footer-based schema inference.
DRIVER_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
}


def _tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, labels: list[str]) -> Column:
    expr = None
    for i, label in enumerate(labels):
        expr = F.when(index == i, F.lit(label)) if expr is None else expr.when(index == i, F.lit(label))
    return expr


def _dec(c: Column) -> Column:
    return c.cast(AMOUNT)


def _days_from_ref(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(REFERENCE_DATE).cast("date"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tables(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    bal = _dec(F.col("c_acctbal"))
    credit = _dec(bal * 50 + 100000)
    return c.select(
        k.alias("sk_id_curr"),
        (F.col("c_acctbal") < 0).cast("int").alias("target"),
        F.col("c_mktsegment").alias("name_contract_type"),
        F.when(k % 20 == 9, F.lit("XNA"))
         .when(k % 20 == 19, F.lit(None).cast("string"))
         .when(k % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("code_gender"),
        (k % 4).cast("int").alias("cnt_children"),
        F.when(k % 53 == 0, F.lit(None).cast(AMOUNT))
         .when(k % 97 == 0, _dec(F.abs(bal) * 1000 + 20000000))
         .otherwise(_dec(F.abs(bal) * 25 + 30000)).alias("amt_income_total"),
        credit.alias("amt_credit"),
        F.when(k % 37 == 0, F.lit(None).cast(AMOUNT))
         .otherwise(_dec(bal * F.lit(2.5).cast("decimal(2,1)") + 5000)).alias("amt_annuity"),
        F.when(k % 41 == 0, F.lit(None).cast(AMOUNT))
         .otherwise(_dec(bal * 45 + 90000)).alias("amt_goods_price"),
        _pick(F.col("c_nationkey") % 4, EDUCATION_LEVELS).alias("name_education_type"),
        _pick(k % 3, FAMILY_STATUSES).alias("name_family_status"),
        _pick(F.col("c_nationkey") % 3, HOUSING_TYPES).alias("name_housing_type"),
        (-(F.lit(7300) + (k * 37) % 18250)).cast("int").alias("days_birth"),
        F.when(k % 6 == 0, F.lit(365243))
         .otherwise(-((k * 53) % 12000)).cast("int").alias("days_employed"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(_pick(F.col("c_nationkey") % 6, OCCUPATIONS)).alias("occupation_type"),
        F.when(k % 43 == 0, F.lit(None).cast(AMOUNT))
         .otherwise(_dec(k % 4 + 1 + k % 2)).alias("cnt_fam_members"),
        F.when(k % 3 == 0, F.lit(None).cast(AMOUNT))
         .otherwise(_dec(_dec((k * 7919) % 10000) * F.lit(0.0001).cast("decimal(5,4)")))
         .alias("ext_source_1"),
        F.when(k % 29 == 0, F.lit(None).cast(AMOUNT))
         .otherwise(_dec(_dec((F.floor(F.col("c_acctbal")).cast("bigint") + 1000) % 10000)
                         * F.lit(0.0001).cast("decimal(5,4)")))
         .alias("ext_source_2"),
        F.when(k % 7 == 0, F.lit(None).cast(AMOUNT))
         .otherwise(_dec(_dec((k * 271) % 10000) * F.lit(0.0001).cast("decimal(5,4)")))
         .alias("ext_source_3"),
    )


def child_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for shuffles of the children and of the customers (counted from Parquet
    footers); where they are many, the scans' splits follow the rows as well."""
    tables = [_tables(spark, sf_dir, name) for name in ("lineitem", "customer", "orders", "events")]
    counted = [(table, table.count()) for table in tables]
    tasks = shuffle_tasks(spark, max(rows for _, rows in counted))
    if tasks:
        bounded_scans(spark, counted)
    return tasks


def installments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order are few, so both sides are dealt by order; their tasks follow the lines."""
    tasks = child_tasks(spark, sf_dir)
    li = _tables(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate")
    o = _tables(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    unpaid = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    due = _dec(_days_from_ref(F.col("o_orderdate")) + DUE_SHIFT_DAYS)
    li, o = dealt(li, tasks, "l_orderkey"), dealt(o, tasks, "o_orderkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        F.col("l_orderkey").alias("sk_id_prev"),
        F.col("o_custkey").alias("sk_id_curr"),
        _dec(F.col("l_suppkey") % 3).alias("num_instalment_version"),
        F.col("l_linenumber").cast("int").alias("num_instalment_number"),
        due.alias("days_instalment"),
        F.when(unpaid, F.lit(None).cast(AMOUNT))
         .when(F.col("o_custkey") % PUNCTUAL == 0, due - F.col("l_linenumber"))
         .otherwise(_dec(_days_from_ref(F.col("l_shipdate")))).cast(AMOUNT).alias("days_entry_payment"),
        _dec(F.col("l_extendedprice")).alias("amt_instalment"),
        F.when(unpaid, F.lit(None).cast(AMOUNT))
         .otherwise(_dec(_dec(F.col("l_extendedprice")) * (1 - _dec(F.col("l_discount")))))
         .alias("amt_payment"),
    )


def credit_card_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _tables(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("sk_id_prev"),
        F.col("o_custkey").alias("sk_id_curr"),
        ((F.year(d) - 2001) * 12 + (F.month(d) - 8)).cast("int").alias("months_balance"),
        _dec(F.col("o_totalprice")).alias("amt_balance"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0))
         .otherwise(F.lit(CARD_LIMIT)).cast("int").alias("amt_credit_limit_actual"),
    )


def pos_cash_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tables(spark, sf_dir, "events")
    eid = F.col("event_id")
    floor_value = F.floor(F.abs(F.col("value"))).cast("int")
    group = F.col("user_id") % 5
    return e.select(
        eid.alias("sk_id_prev"),
        F.col("user_id").alias("sk_id_curr"),
        (-(eid % 24)).cast("int").alias("months_balance"),
        _dec(F.lit(24)).alias("cnt_instalment"),
        _dec(eid % 24).alias("cnt_instalment_future"),
        F.when(F.col("event_type") == "error", F.lit("Completed"))
         .otherwise(F.lit("Active")).alias("name_contract_status"),
        # a fifth of the customers each: never overdue, then 1-30, 31-60, 61-90, 91-120 days
        F.when(group == 0, F.lit(0))
         .otherwise((group - 1) * 30 + 1 + floor_value % 30).cast("int").alias("sk_dpd"),
        F.greatest(floor_value - 400, F.lit(0)).alias("sk_dpd_def"),
    )


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _tables(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_custkey").alias("sk_id_curr"),
        F.col("o_orderkey").alias("sk_id_bureau"),
        F.when(status == "F", F.lit("Closed")).when(status == "O", F.lit("Active"))
         .otherwise(F.lit("Sold")).alias("credit_active"),
        _days_from_ref(F.col("o_orderdate")).cast("int").alias("days_credit"),
        F.when(status == "O", F.floor(F.col("o_totalprice")).cast("bigint") % 120)
         .otherwise(F.lit(0)).cast("int").alias("credit_day_overdue"),
        F.when(F.col("o_orderpriority").startswith("5"), F.lit(None).cast(AMOUNT))
         .otherwise(_dec(F.col("o_totalprice"))).alias("amt_credit_sum_debt"),
    )


def application_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an application feed before it is accepted: every 11th customer
    was delivered twice and every 101st once more without a key."""
    k = applications(spark, sf_dir).select("sk_id_curr")
    key = F.col("sk_id_curr")
    return (k.union(k.where(key % 11 == 0))
            .union(k.where(key % 101 == 0).select(F.lit(None).cast("long"))))


def bureau_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a bureau feed before it is accepted, in the same manner."""
    k = bureau(spark, sf_dir).select("sk_id_bureau")
    key = F.col("sk_id_bureau")
    return (k.union(k.where(key % 97 == 0))
            .union(k.where(key % 997 == 0).select(F.lit(None).cast("long"))))


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All five raw tables, keyed like the original table names."""
    return {
        "raw_application_train": applications(spark, sf_dir),
        "raw_installments_payments": installments(spark, sf_dir),
        "raw_credit_card_balance": credit_card_balance(spark, sf_dir),
        "raw_pos_cash_balance": pos_cash_balance(spark, sf_dir),
        "raw_bureau": bureau(spark, sf_dir),
    }
