"""Helpers shared by the document operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _trim = ctypes.CDLL(None).malloc_trim          # glibc's; other C libraries lack it
except (AttributeError, OSError):
    _trim = None

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")) % modulus


def release_memory() -> None:
    """Give memory that Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_forget: dict[str, Callable[[], object]] = {}      # of each module that remembers
_last: str | None = None                           # module of the latest task


def remembers(module: str, forget: Callable[[], object]) -> None:
    """``forget`` drops what ``module`` remembers from task to task."""
    _forget[module] = forget


def forget_others(module: str) -> None:
    """Where the latest task was another module's, drop what the others remember:
    Spark hands a Python worker from one query or stage to the next, and it
    would hold the memories of all operators it ever ran."""
    global _last
    if _last not in (None, module):
        for name, forget in _forget.items():
            if name != module:
                forget()
        release_memory()
    _last = module


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving freed memory back at the end of each task:
    Spark keeps idle Python workers, which would hold on to it.  What other
    operators remember goes before ``run`` starts."""
    module = run.__module__

    def wrapped(batches: Iterator) -> Iterator:
        forget_others(module)
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped
