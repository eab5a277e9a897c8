"""loanlens - customer lending analytics as Spark DataFrame jobs.

Subpackages
-----------
sources    raw schemas, CSV/Parquet/JDBC IO, stand-in tables from the test data
functions  column-level helpers: rounding rules, safe ratios, segment rules
operators  DataFrame -> DataFrame steps: quality, cleaning, features,
           preparation, model, scores, reports, ordered statistics
plans      query catalogue (Spark and oracle SQL) wiring the operators
streaming  nothing to build (the original work has no streams); see README
"""

__version__ = "0.1.0"
