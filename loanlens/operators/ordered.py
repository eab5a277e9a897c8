"""Running totals and ranks without a single-partition sort.

Ranks and ROC curves need, for a row, the total weight of the rows ordered
before it.  A window with an
``orderBy`` but no ``partitionBy`` would pull every row into one task.
Instead, at every size:

1. collapse the input to distinct ordering values with a ``groupBy`` (map
   side combine; a value held by a third of the rows becomes one row);
2. range-partition those rows on (group, value) into a fixed, configured
   number of slices (``spark.sql.shuffle.partitions`` unless given) and
   write them once to the shared folder with their slice number;
3. take running sums inside each (group, slice);
4. add the totals of the group's earlier slices.  That table has at most
   one row per (group, slice) pair that occurs: slices + groups rows.

The result is exact; only the load balance depends on the range sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store


def running_totals(df: DataFrame, order: list[str], weights: list[str], by: list[str] | None = None,
                   slices: int | None = None, previous: list[str] | None = None) -> DataFrame:
    """Adds ``<w>_before`` (sum of ``w`` over rows of the same ``by`` group that
    come earlier in ascending ``order``) and ``<w>_total`` for every weight.

    Rows that tie on all order columns are ordered arbitrarily, so give
    distinct order values (e.g. a grouped count table) when that matters.
    Nulls order first.  Sums keep the type ``sum`` gives the weight.

    ``previous`` adds ``<c>_previous``, the column's value in the row just
    before (null for a group's first row).  Only a slice's first row needs
    another slice: the last row of the group's nearest earlier one.
    """
    by, previous = list(by or []), list(previous or [])
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = store(df.repartitionByRange(slices, *by, *order)
                   .withColumn("_slice", F.spark_partition_id()))

    per_slice = sliced.groupBy(*by, "_slice").agg(
        *[F.sum(w).alias(f"_{w}_slice") for w in weights],
        *[F.max_by(c, F.struct(*order)).alias(f"_{c}_last") for c in previous])
    group = Window.partitionBy(*by)              # at most ``slices`` rows of a group
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col("_slice").alias("_of"),
        *[F.sum(f"_{w}_slice").over(earlier).alias(f"_{w}_off") for w in weights],
        *[F.sum(f"_{w}_slice").over(group).alias(f"{w}_total") for w in weights],
        *[F.lag(f"_{c}_last").over(group.orderBy("_slice")).alias(f"_{c}_carried") for c in previous])

    local = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = sliced.withColumns({f"_{w}_local": F.sum(w).over(local) for w in weights})
    if previous:
        before = Window.partitionBy(*by, "_slice").orderBy(*order)
        inside = inside.withColumns({"_first": F.row_number().over(before) == 1,
                                     **{f"_{c}_near": F.lag(c).over(before) for c in previous}})
    same = inside["_slice"] == offsets["_of"]
    for i, c in enumerate(by):
        same = same & inside[c].eqNullSafe(offsets[f"_by_{i}"])
    out = inside.join(offsets, same, "left")
    zero = F.lit(0)
    out = out.withColumns({f"{w}_before": F.coalesce(F.col(f"_{w}_off"), zero)
                           + F.coalesce(F.col(f"_{w}_local"), zero) for w in weights})
    out = out.withColumns({f"{c}_previous": F.when(F.col("_first"), F.col(f"_{c}_carried")).otherwise(F.col(f"_{c}_near"))
                           for c in previous})
    return out.select(*df.columns, *[c for w in weights for c in (f"{w}_before", f"{w}_total")],
                      *[f"{c}_previous" for c in previous])


def rank_desc(df: DataFrame, value: str, out: str = "rank", slices: int | None = None) -> DataFrame:
    """W5 - ``rank(ascending=False, method='min')``: 1 + number of rows with a
    strictly greater value; ties share the rank; null values get null.

    Ranks are computed on the distinct values and joined back; the join is
    left to AQE, which knows the stored table's size.
    """
    counted = (df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")))
    ranked = running_totals(counted, [value], ["n"], None, slices)
    table = ranked.select(value, (F.col("n_total") - F.col("n_before") - F.col("n") + 1).cast("int").alias(out))
    return df.join(table, on=value, how="left")
