"""Exact duplicates by 128-bit content hash (operator 7; DataFrame functions only).

Rows are grouped by (hash, whole text): the 16-byte hash decides where a
group lives, and the text in the grouping key makes Spark compare the bytes
of the texts inside a hash group, so a collision can never merge two texts.
The grouping combines on the map side, so a text held by a third of all rows
reaches the shuffle once per task, not once per row.  Only the hash, the
chosen id and the counts go on from there; each row finds its group by hash.
A hash shared by different texts (a true collision) is detected, and just
the rows under such hashes are matched by their text.

Cases: null text counts as empty, and all empty texts form one group; a null
id is smaller (for ``keep="first"``: larger) than any other and is chosen only
when every id of the group is null; rows that repeat id and text share one
decision in ``classes`` and leave one row in ``survivors``; an empty table
gives an empty result; other columns are ignored by ``classes`` and kept as
they are by ``survivors``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import text_of


def content_hash(text: Column) -> Column:
    """The 128-bit content hash, 16 bytes."""
    return F.unhex(F.md5(text))


def _pick(keep: str) -> Callable[[str], Column]:
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' (smallest id) or 'last' (largest id)")
    return F.min if keep == "first" else F.max


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "first",
            hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep="first"`` keeps the smallest id of equal texts, ``"last"`` the largest.
    """
    pick = _pick(keep)
    rows = (docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
            .withColumn("hash", hash_of(F.col("body"))))
    chosen = [pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]

    groups = store(rows.groupBy("hash", "body").agg(*chosen)
                   .select("hash", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256")))
    shared = groups.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash")
    if shared.isEmpty():
        found = rows.select("doc_id", "hash").join(groups, "hash")
    else:
        alone = groups.join(shared, "hash", "left_anti")
        collided = rows.join(shared, "hash", "left_semi")
        by_text = (collided.groupBy("hash", "body").agg(*chosen)
                   .withColumn("text_sha256", F.sha2("body", 256)))
        found = (rows.select("doc_id", "hash").join(alone, "hash")
                 .unionByName(collided.join(by_text, ["hash", "body"]).drop("body")))
    return found.select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "first",
              hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, with the columns of ``docs``: one row per text.

    Rows that also tie on the id are told apart by a hash of their columns."""
    pick = F.min_by if keep == "first" else F.max_by
    _pick(keep)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rank = F.struct(F.col(f"`{id_col}`").isNull() if keep == "first" else F.col(f"`{id_col}`").isNotNull(),
                    F.col(f"`{id_col}`"), tie)
    rows = docs.select(hash_of(text_of(F.col(f"`{text_col}`"))).alias("hash"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"),
                       F.col(f"`{text_col}`").isNull().alias("absent"),
                       text_of(F.col(f"`{text_col}`")).alias("body"), rank.alias("rank"))
    best = rows.groupBy("hash", "body").agg(pick(F.struct("rest", "absent"), "rank").alias("best"))
    return best.select(*[
        F.when(F.col("best.absent"), F.lit(None).cast("string")).otherwise(F.col("body")).alias(c)
        if c == text_col else F.col("best.rest")[c].alias(c) for c in docs.columns])
