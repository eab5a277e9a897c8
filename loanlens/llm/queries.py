"""One registered query per operator, over whole tables and whole texts.

``QUERIES`` maps names to ``fn(spark, sf_dir) -> DataFrame``; ``ORACLE`` holds
the DuckDB statement of those that SQL can express.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_folder
from . import (bpe, exact_dedup, html_text, langid, license_scan, mixing, near_dedup, periodic_runs, secrets, spelling,
               spotsigs, token_output, toxicity)
from .common import crc32_mod, documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{table_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write_tokens(documents(spark, sf_dir), path, TOKENIZER)
    return token_output.digest(token_output.read_tokens(spark, path))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc32_mod("doc_id", 3) == 1
    model = langid.fit(docs, use=~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "passes")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{table_folder(spark)}/ledger-{uuid.uuid4().hex}"
    found = secrets.scan(documents(spark, sf_dir), ledger)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind_no"] == i)).cast("long")
    spans = secrets.joined(F.col("spans"))       # the base rules; the ledger adds none
    return found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.RULES)],
                        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir), keep="last")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), TOKENIZER)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc32_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), use=~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), edit=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(documents(spark, sf_dir), edit=True)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_source_mixing": op5_source_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_spotsigs": op8_spotsigs,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_html_extraction": op13_html_extraction,
}

def _op6_sql() -> str:
    """Spans per rule from the lengths of the matches and of the pieces between."""
    kinds = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        kinds.append(f"""
            SELECT doc_id, {i} AS kind_no, '{r.kind}' AS kind, regexp_extract_all(body, '{pattern}', 0) AS found,
                   regexp_extract_all(body, '{pattern}', {r.group}) AS vals,
                   string_split_regex(body, '{pattern}') AS gaps, {r.least} AS least
            FROM bodies WHERE regexp_matches(body, '{pattern}')""")
    return f"""
        WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        kinds AS ({" UNION ALL ".join(kinds)}),
        each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM kinds),
        placed AS (
          SELECT doc_id, kind_no, kind, len(found[i]) AS size, len(vals[i]) >= least AS ok,
            coalesce(list_sum([len(x) for x in gaps[1:i]]), 0)
              + coalesce(list_sum([len(x) for x in found[1:i - 1]]), 0) AS start FROM each),
        joined AS (
          SELECT doc_id, count(*) FILTER (WHERE kind_no = 0) AS n_assign, count(*) FILTER (WHERE kind_no = 1) AS n_access,
            count(*) FILTER (WHERE kind_no = 2) AS n_hex,
            string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + size AS BIGINT)), ','
                       ORDER BY start, kind_no) AS spans
          FROM placed WHERE ok GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
               coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id"""


ORACLE = {
    "op6_secret_scan": _op6_sql(),
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
