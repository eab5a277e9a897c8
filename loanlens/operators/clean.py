"""Cleaned application view (P1-P4, IO5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES taken over from the original cleaning rules.
EMPLOYED_SENTINEL = 365243     # days_employed placeholder for "not employed"
INCOME_CAP = 20000000          # income ceiling
GENDER_PLACEHOLDER = "XNA"     # placeholder gender, excluded


def staged_applications(app: DataFrame, employed: str = "days_employed",
                        income: str = "amt_income_total", gender: str = "code_gender") -> DataFrame:
    """``stg_application_train``: all raw columns plus

    * days_employed_clean - the sentinel becomes null (P1);
    * amt_income_total_clean - LEAST(income, cap); a null income becomes the
      cap, as LEAST skips nulls (P2);

    keeping only rows whose gender is known and not the placeholder (P4:
    ``!=`` drops null genders as well).
    """
    return (app.where(F.col(gender) != GENDER_PLACEHOLDER)
            .withColumns({
                f"{employed}_clean": F.when(F.col(employed) != EMPLOYED_SENTINEL, F.col(employed)),
                f"{income}_clean": F.least(F.col(income), F.lit(INCOME_CAP).cast("decimal(18,4)")),
            }))
