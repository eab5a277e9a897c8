"""IO4 inside a session: derived tables stored once and reused.

``stored(spark, sf_dir, name, build)`` writes what ``build()`` returns as
Parquet in the shared folder and hands the same stored table out again while
the input files stay as they are (names, sizes, modification times).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import drops, store

# tables the lending inputs are derived from
INPUTS = ("customer", "orders", "lineitem", "events")
_TABLES: dict[tuple, DataFrame] = {}


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """(path, length, modification time) of every input file, read through Spark's file systems."""
    sc = spark.sparkContext
    conf, new_path = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    state = []
    for name in INPUTS:
        root = new_path(f"{sf_dir}/{name}.parquet")
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            continue
        files = fs.listFiles(root, True)
        while files.hasNext():
            f = files.next()
            state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(state))


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, drops(spark), sf_dir, name, input_state(spark, sf_dir))
    if key not in _TABLES:
        _TABLES[key] = store(build())
    return _TABLES[key]
