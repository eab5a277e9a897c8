"""Secret scans with an incremental blob ledger (operator 6; DataFrame
functions only).

Every version of every path is content-addressed: its blob is the sha256 of
its text.  The ledger, a Parquet folder with a part for each rule version,
holds a row for each blob scanned so far with the spans found.  A rule
version is the hash of the rules, so other rules never meet old findings.  A
scan reads only blobs the ledger lacks under its rule version, each once
however many rows carry it, appends them, and joins the spans of all rows'
blobs back to the rows.  Scans at once or a retried one may append a blob
twice, with equal spans; it is read as one.  Blobs
are grouped with a map-side combine, so a text that a third of the rows share
reaches the shuffle once per task.

Spans are code points, end exclusive.  Per rule, matches are leftmost and do
not overlap; a match whose value is too short is dropped.  Offsets come from
the lengths of the pieces between the matches.

Cases: null text is empty and has no spans; repeated rows each get a row;
null ids are kept; an empty table gives an empty result and leaves the ledger
as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


@dataclass(frozen=True)
class Rule:
    """``pattern`` with a value in ``group`` of at least ``least`` characters."""
    kind: str
    pattern: str
    group: int
    least: int


# FIXED VALUES: the base rules, in their order.  The second and third carry
# their least length in the pattern: their runs are maximal, so the matches
# are those of the unbounded run that are long enough.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
_SPANS = "array<struct<start:bigint,kind_no:int,stop:bigint>>"


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """The name of this very list of rules."""
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:32]


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """The rule's spans in ``text``, in order, as (start, kind_no, stop)."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    parts = F.zip_with(F.arrays_zip(matches.alias("match"), values.alias("value")), between, lambda m, b: F.struct(
        F.char_length(b).cast("long").alias("gap"), F.char_length(m["match"]).cast("long").alias("size"),
        F.char_length(m["value"]).alias("value_size")))
    # one piece more than matches: the last has no match
    parts = F.filter(parts, lambda p: p["size"].isNotNull())
    empty = F.array().cast(_SPANS)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        stop = start + p["size"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(p["value_size"] >= rule.least, F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step,
                        lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(empty)


def text_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' spans in ``text``, by start, then rule order."""
    return F.array_sort(F.concat(*[rule_spans(text, r, i) for i, r in enumerate(rules)]))


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(folder)


_LEDGER = f"blob binary, spans {_SPANS}, rule_version string"


def _scanned(docs: DataFrame, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's part of this rule version."""
    return (docs.sparkSession.read.schema(_LEDGER).parquet(ledger)
            .where(F.col("rule_version") == rule_version(rules)).select("blob", "spans"))


def unseen_blobs(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``blob, body`` of the distinct texts the ledger lacks under these rules."""
    rows = docs.select(text_of(text_col).alias("body")).select(
        F.unhex(F.sha2("body", 256)).alias("blob"), "body")
    blobs = rows.distinct()
    if not _exists(docs, f"{ledger}/rule_version={rule_version(rules)}"):
        return blobs
    return blobs.join(_scanned(docs, ledger, rules).select("blob"), "blob", "left_anti")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger lacks, append it, and return ``doc_id, blob, spans``
    for every row of ``docs`` (spans: start, kind_no, stop)."""
    new = unseen_blobs(docs, ledger, rules, text_col).select(
        "blob", text_spans(F.col("body"), rules).alias("spans"), F.lit(rule_version(rules)).alias("rule_version"))
    new.write.mode("append").partitionBy("rule_version").parquet(ledger)
    paths = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("blob"))
    if not _exists(docs, f"{ledger}/rule_version={rule_version(rules)}"):      # nothing was ever scanned
        return paths.select("doc_id", "blob", F.array().cast(_SPANS).alias("spans"))
    # blobs without findings (most) need no row to join; the hot blob's rows
    # are split by AQE when the join shuffles
    known = _scanned(docs, ledger, rules).where(F.size("spans") > 0).dropDuplicates(["blob"])
    return (paths.join(known, "blob", "left")
            .select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind_no"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
