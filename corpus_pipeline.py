"""The corpus pipeline: five document operators, one after the other.

Each stage reads what the stage before it wrote, drops or repeats documents
by its operator's decisions, and returns the columns of documents; the last
returns token ids.  ``run`` writes every stage's result as Parquet in the
shared folder and hands the reread table on.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanlens.llm import bpe, exact_dedup, mixing, near_dedup, toxicity  # noqa: E402
from loanlens.llm.common import DOCUMENT_COLUMNS, crc32_mod, documents  # noqa: E402
from loanlens.llm.queries import TOKENIZER  # noqa: E402
from loanlens.session import ensure_checkpoint_dir, ship_package, small_arrow_batches, store  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model (10) gives a score of 0.5 or more go.

    The decision is made where the text is scored, so no text is shuffled."""
    _prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, use=crc32_mod("doc_id", 5) != 0)
    return toxicity.keep_clean(docs.select(*DOCUMENT_COLUMNS), model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays (7)."""
    _prepare(spark)
    return exact_dedup.survivors(docs.select(*DOCUMENT_COLUMNS), keep="last")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (3)."""
    _prepare(spark)
    return near_dedup.survivors(docs.select(*DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix (5) takes: a document once per whole pass of its
    shard, and the words of its chosen blocks as one more, shorter row."""
    _prepare(spark)
    return mixing.materialise(docs.select(*DOCUMENT_COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (9) of every row: ``doc_id, n_tokens, token_ids``."""
    _prepare(spark)
    return bpe.encode(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

# The classifier and the signatures cannot be stated in SQL.
ORACLE_SQL = None


def _prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    small_arrow_batches(spark)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
