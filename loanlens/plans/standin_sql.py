"""The stand-in derivations of ``loanlens.sources.standins`` as DuckDB SQL.

Used only by the oracle queries: each oracle statement starts with
``WITH <these CTEs>`` and then states the lending query over them.
"""

from __future__ import annotations

from ..sources.standins import (CARD_LIMIT, DUE_SHIFT_DAYS, EDUCATION_LEVELS, FAMILY_STATUSES,
                                HOUSING_TYPES, OCCUPATIONS, PUNCTUAL, REFERENCE_DATE)


def _case(index_sql: str, labels: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
    return f"CASE {index_sql} {arms} END"


D = "DECIMAL(18,4)"

RAW_APPLICATION_TRAIN = f"""
raw_application_train AS (
  SELECT
    c_custkey AS sk_id_curr,
    CAST(c_acctbal < 0 AS INTEGER) AS target,
    c_mktsegment AS name_contract_type,
    CASE WHEN c_custkey % 20 = 9 THEN 'XNA' WHEN c_custkey % 20 = 19 THEN NULL
         WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS code_gender,
    CAST(c_custkey % 4 AS INTEGER) AS cnt_children,
    CASE WHEN c_custkey % 53 = 0 THEN NULL
         WHEN c_custkey % 97 = 0 THEN CAST(abs(CAST(c_acctbal AS {D})) * 1000 + 20000000 AS {D})
         ELSE CAST(abs(CAST(c_acctbal AS {D})) * 25 + 30000 AS {D}) END AS amt_income_total,
    CAST(CAST(c_acctbal AS {D}) * 50 + 100000 AS {D}) AS amt_credit,
    CASE WHEN c_custkey % 37 = 0 THEN NULL
         ELSE CAST(CAST(c_acctbal AS {D}) * CAST(2.5 AS DECIMAL(2,1)) + 5000 AS {D}) END AS amt_annuity,
    CASE WHEN c_custkey % 41 = 0 THEN NULL
         ELSE CAST(CAST(c_acctbal AS {D}) * 45 + 90000 AS {D}) END AS amt_goods_price,
    {_case('c_nationkey % 4', EDUCATION_LEVELS)} AS name_education_type,
    {_case('c_custkey % 3', FAMILY_STATUSES)} AS name_family_status,
    {_case('c_nationkey % 3', HOUSING_TYPES)} AS name_housing_type,
    CAST(-(7300 + (c_custkey * 37) % 18250) AS INTEGER) AS days_birth,
    CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 53) % 12000) END AS INTEGER)
      AS days_employed,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_case('c_nationkey % 6', OCCUPATIONS)} END
      AS occupation_type,
    CASE WHEN c_custkey % 43 = 0 THEN NULL
         ELSE CAST(c_custkey % 4 + 1 + c_custkey % 2 AS {D}) END AS cnt_fam_members,
    CASE WHEN c_custkey % 3 = 0 THEN NULL
         ELSE CAST(CAST((c_custkey * 7919) % 10000 AS {D}) * CAST(0.0001 AS DECIMAL(5,4)) AS {D})
    END AS ext_source_1,
    CASE WHEN c_custkey % 29 = 0 THEN NULL
         ELSE CAST(CAST((CAST(floor(c_acctbal) AS BIGINT) + 1000) % 10000 AS {D})
                   * CAST(0.0001 AS DECIMAL(5,4)) AS {D})
    END AS ext_source_2,
    CASE WHEN c_custkey % 7 = 0 THEN NULL
         ELSE CAST(CAST((c_custkey * 271) % 10000 AS {D}) * CAST(0.0001 AS DECIMAL(5,4)) AS {D})
    END AS ext_source_3
  FROM customer
)"""

_UNPAID = "(l_returnflag = 'R' AND l_linestatus = 'F')"

RAW_INSTALLMENTS_PAYMENTS = f"""
raw_installments_payments AS (
  SELECT
    l_orderkey AS sk_id_prev,
    o_custkey AS sk_id_curr,
    CAST(l_suppkey % 3 AS {D}) AS num_instalment_version,
    CAST(l_linenumber AS INTEGER) AS num_instalment_number,
    CAST(date_diff('day', DATE '{REFERENCE_DATE}', CAST(o_orderdate AS DATE)) + {DUE_SHIFT_DAYS}
         AS {D}) AS days_instalment,
    CASE WHEN {_UNPAID} THEN NULL
         WHEN o_custkey % {PUNCTUAL} = 0
           THEN CAST(date_diff('day', DATE '{REFERENCE_DATE}', CAST(o_orderdate AS DATE)) + {DUE_SHIFT_DAYS}
                     - l_linenumber AS {D})
         ELSE CAST(date_diff('day', DATE '{REFERENCE_DATE}', CAST(l_shipdate AS DATE)) AS {D})
    END AS days_entry_payment,
    CAST(l_extendedprice AS {D}) AS amt_instalment,
    CASE WHEN {_UNPAID} THEN NULL
         ELSE CAST(CAST(l_extendedprice AS {D}) * (1 - CAST(l_discount AS {D})) AS {D})
    END AS amt_payment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

RAW_CREDIT_CARD_BALANCE = f"""
raw_credit_card_balance AS (
  SELECT
    o_orderkey AS sk_id_prev,
    o_custkey AS sk_id_curr,
    CAST((year(o_orderdate) - 2001) * 12 + (month(o_orderdate) - 8) AS INTEGER) AS months_balance,
    CAST(o_totalprice AS {D}) AS amt_balance,
    CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE {CARD_LIMIT} END AS INTEGER)
      AS amt_credit_limit_actual
  FROM orders
)"""

RAW_POS_CASH_BALANCE = f"""
raw_pos_cash_balance AS (
  SELECT
    event_id AS sk_id_prev,
    user_id AS sk_id_curr,
    CAST(-(event_id % 24) AS INTEGER) AS months_balance,
    CAST(24 AS {D}) AS cnt_instalment,
    CAST(event_id % 24 AS {D}) AS cnt_instalment_future,
    CASE WHEN event_type = 'error' THEN 'Completed' ELSE 'Active' END AS name_contract_status,
    CAST(CASE WHEN user_id % 5 = 0 THEN 0
         ELSE (user_id % 5 - 1) * 30 + 1 + CAST(floor(abs(value)) AS INTEGER) % 30 END AS INTEGER) AS sk_dpd,
    CAST(greatest(CAST(floor(abs(value)) AS INTEGER) - 400, 0) AS INTEGER) AS sk_dpd_def
  FROM events
)"""

RAW_BUREAU = f"""
raw_bureau AS (
  SELECT
    o_custkey AS sk_id_curr,
    o_orderkey AS sk_id_bureau,
    CASE WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'O' THEN 'Active'
         ELSE 'Sold' END AS credit_active,
    CAST(date_diff('day', DATE '{REFERENCE_DATE}', CAST(o_orderdate AS DATE)) AS INTEGER)
      AS days_credit,
    CAST(CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice) AS BIGINT) % 120 ELSE 0 END
         AS INTEGER) AS credit_day_overdue,
    CASE WHEN starts_with(o_orderpriority, '5') THEN NULL
         ELSE CAST(o_totalprice AS {D}) END AS amt_credit_sum_debt
  FROM orders
)"""

APPLICATION_DELIVERIES = """
application_deliveries AS (
  SELECT sk_id_curr FROM raw_application_train
  UNION ALL SELECT sk_id_curr FROM raw_application_train WHERE sk_id_curr % 11 = 0
  UNION ALL SELECT NULL FROM raw_application_train WHERE sk_id_curr % 101 = 0)"""

BUREAU_DELIVERIES = """
bureau_deliveries AS (
  SELECT sk_id_bureau FROM raw_bureau
  UNION ALL SELECT sk_id_bureau FROM raw_bureau WHERE sk_id_bureau % 97 = 0
  UNION ALL SELECT NULL FROM raw_bureau WHERE sk_id_bureau % 997 = 0)"""

RAW_CTES = {
    "raw_application_train": RAW_APPLICATION_TRAIN,
    "raw_installments_payments": RAW_INSTALLMENTS_PAYMENTS,
    "raw_credit_card_balance": RAW_CREDIT_CARD_BALANCE,
    "raw_pos_cash_balance": RAW_POS_CASH_BALANCE,
    "raw_bureau": RAW_BUREAU,
}


def with_raw(*names: str) -> str:
    """``WITH`` prefix defining the named raw tables (more CTEs may follow)."""
    return "WITH " + ",\n".join(RAW_CTES[n] for n in names)
