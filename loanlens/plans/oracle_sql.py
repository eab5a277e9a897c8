"""Small SQL-text helpers for the DuckDB oracle statements."""

from __future__ import annotations


def round_ratio(num: str, den: str, digits: int) -> str:
    """Exact SQL ROUND(num / den, digits), half away from zero, for integer
    ``num`` and positive integer ``den``; null when ``den`` is 0 or null.
    Returned as DOUBLE."""
    scale = 10 ** digits
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    return (f"(CASE WHEN {d} IS NULL OR {d} = 0 OR {n} IS NULL THEN NULL ELSE "
            f"CAST(sign({n}) * ((abs({n}) * {2 * scale} + {d}) // (2 * {d})) AS DOUBLE) / {scale}.0 END)")


def dec_int(expr: str) -> str:
    """A decimal(…,4) value as an exact integer number of 1/10000 units."""
    return f"CAST(({expr}) * 10000 AS HUGEINT)"
