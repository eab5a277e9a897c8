"""IO2-IO8: reading raw files, writing derived tables, physical layout.

Writes always replace (drop + create semantics of the original scripts) so a
rerun is idempotent.  Nothing here collects data to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

# A character that never occurs in the files: it becomes the CSV null token,
# so an unquoted empty field is null while a quoted empty field stays ''.
_UNUSED_NULL_TOKEN = "\u0001"


def read_raw_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """IO2 - bulk CSV load with a header line and a fixed positional schema.

    Any value that does not parse into its declared type aborts the load
    (FAILFAST), as a database bulk load would.  A condition over all columns,
    true for every row, keeps them in every read: a count or a narrow select
    checks every field as well.  Header names are not used; columns are
    matched by position.  Quotes inside a
    quoted field are doubled and a backslash is an ordinary character.
    ``multi_line`` allows line breaks inside quoted fields; a file read that
    way cannot be split, so give such a load in many files.
    """
    loaded = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("mode", "FAILFAST")
        .option("quote", '"').option("escape", '"')
        .option("multiLine", str(multi_line).lower())
        .option("nullValue", _UNUSED_NULL_TOKEN)
        .option("emptyValue", "")
        .csv(path)
    )
    return loaded.where(F.xxhash64(*loaded.columns) >= F.lit(-2 ** 63))


def read_raw_tables(spark: SparkSession, paths: dict[str, str], multi_line: bool = False) -> dict[str, DataFrame]:
    """IO2 x5 - ``paths`` maps raw table name -> CSV path."""
    return {name: read_raw_csv(spark, path, schemas.RAW_SCHEMAS[name], multi_line)
            for name, path in paths.items()}


def write_raw_csv(df: DataFrame, path: str, schema: str) -> None:
    """The counterpart of ``read_raw_csv``: every column of the layout, in file
    order (null where ``df`` lacks it), null unquoted and empty text quoted."""
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
               for f in T.StructType.fromDDL(schema)]
    (df.select(*columns).write.mode("overwrite").option("header", "true")
     .option("quote", '"').option("escape", '"').option("emptyValue", '""').csv(path))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """IO3 / IO4 / IO7 - replace a table stored as Parquet."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """K3 - the access path on the customer key.

    Child tables re-read by several feature jobs are stored bucketed and
    sorted by the key, so later joins and aggregations on it need no shuffle.
    The rows are dealt to the buckets first, so a bucket is one file.
    ``path``: where the table's files go (else the warehouse).
    """
    dealt = df.repartition(buckets, key)
    w = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (w.option("path", path) if path else w).saveAsTable(table)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """IO6 - full-table read (column pruning happens in the scan)."""
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, properties: dict | None = None) -> DataFrame:
    """IO6 over JDBC, split into ``partitions`` parallel range reads on ``key``."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    """IO7 over JDBC, replacing the table."""
    df.write.mode("overwrite").jdbc(url, table, properties=properties or {})
