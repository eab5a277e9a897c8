"""Sets of tables published together (IO3, IO4, IO7 behind K1, F6).

A folder holds the data of every run under a name of its own and a list of
publications: ``versions/<n>-<id>.json`` names the data folder of each table
that a run replaced.  A job writes its tables aside, checks them, and then
publishes them by one small file.  Readers apply the publications in order, so
they see a run's tables all together or not at all; a job that fails before
leaves the old ones as they are.

No two jobs write the same file, so publishing at once needs no lock: both
publications count, and for a table that both replace the one that sorts last.
A file that is not complete (of a job lost while it wrote) does not count.
Files are reached by Spark's file systems, so the folder may be in any store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIGITS = 12


def _at(spark: SparkSession, path: str):
    """(file system, path) in Spark's terms."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def staged(folder: str, name: str) -> str:
    """A new path for a table's data; nothing reads it before it is published."""
    return f"{folder.rstrip('/')}/data/{name}-{uuid.uuid4().hex}"


def publications(spark: SparkSession, folder: str) -> list[tuple[str, dict[str, str]]]:
    """(file name, {table: path}) of every complete publication, in order."""
    fs, root = _at(spark, f"{folder.rstrip('/')}/versions")
    if not fs.exists(root):
        return []
    out = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not name.endswith(".json") or not name[:_DIGITS].isdigit():
            continue
        stream = fs.open(status.getPath())
        try:
            text = spark.sparkContext._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A")
            out.append((name, json.loads(text.next() if text.hasNext() else "")))
        except json.JSONDecodeError:
            pass
        finally:
            stream.close()
    return sorted(out)


def current(spark: SparkSession, folder: str) -> dict[str, str]:
    """{table: path} as published last."""
    return {name: path for _, tables in publications(spark, folder) for name, path in tables.items()}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as published last."""
    paths = current(spark, folder)
    if name not in paths:
        raise ValueError(f"{folder} has no published table {name!r}")
    return spark.read.parquet(paths[name])


def publish(spark: SparkSession, folder: str, tables: dict[str, str]) -> str:
    """Make ``tables`` (name -> staged path) current together; others stay."""
    found = publications(spark, folder)
    number = int(found[-1][0][:_DIGITS]) + 1 if found else 1
    name = f"{number:0{_DIGITS}d}-{uuid.uuid4().hex}.json"
    fs, path = _at(spark, f"{folder.rstrip('/')}/versions/{name}")
    stream = fs.create(path, False)
    try:
        stream.write((json.dumps(tables) + "\n").encode())
    finally:
        stream.close()
    return name


def remove_old(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete data that none of the newest ``keep`` states names, and
    publications that are wholly replaced.  Run it when no reader is behind."""
    found = publications(spark, folder)
    states, state = [], {}
    for _, tables in found:
        state = {**state, **tables}
        states.append(state)
    held = {path for s in states[-keep:] for path in s.values()}
    for name, tables in found[:-keep]:
        for path in set(tables.values()) - held:
            fs, at = _at(spark, path)
            fs.delete(at, True)
        if not held & set(tables.values()):
            fs, at = _at(spark, f"{folder.rstrip('/')}/versions/{name}")
            fs.delete(at, False)
