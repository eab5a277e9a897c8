"""Document fingerprints by SpotSigs (operator 8).

Wherever an anchor stands, the anchor and the next ``CHAIN`` content words
(words that are not anchors) form a signature; the beginning of the text
counts as an anchor too.  Anchors are the common words ``ANCHORS`` and, in any
language, the words whose hash is divisible by ``DRAWN_EVERY``, so the whole of
a text without a listed word takes part as well.  A document's fingerprint is
the set of its signatures as 32-bit hashes, written as ascending hex digits
of 8; the likeness of two documents is the Jaccard index of their sets.

``classes`` links documents whose likeness is at least a threshold.  Sets are
partitioned by their length: two sets can only reach the threshold when their
lengths fall into the same or neighbouring partitions.  Inside a partition
only sets that share one of their rarest signatures meet (a set that reaches
the threshold must share one of its first n - ceil(threshold n) + 1 by
document frequency), and ``linking`` compares those exactly, stopping where the
shared count can't reach the threshold.

``edited_likeness`` compares every document with an edited text of its own and
with the next document in descending order of id.  Rows are dealt to slices of
neighbouring ids (cut points by a quantile sketch, a fixed number per shuffle
partition); each slice also gets the first row of the next one, so the texts
are shuffled once and no row needs a global order.

Cases: null text is empty; a text without words has an empty fingerprint, and
two empty fingerprints have likeness 1, an empty and another 0; a single
document is its own next; repeated ids are ordered by text; null ids come
last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import store
from .common import lean, partitions, text_of
from .hashing import GOLDEN, WORD, mix, word_hashes
from .linking import link, shared_buckets

# FIXED VALUES: common words of English, German, French and Spanish.
ANCHORS = frozenset((
    "a an and are as at be but by for from had has have he her his i in is it not of on or that the "
    "their they this to was were which with you "
    "als auch auf aus bei das dem den der des die ein eine einen er es für im ist mit nicht sich sie "
    "sind und von war wie wird zu "
    "au aux avec ce dans de du elle en est et il la le les ne par pas pour que qui se son sur un une "
    "al como con del el ella esta la las lo los más no para por se su sus una y"
).split())
DRAWN_EVERY = 16               # of the distinct words, this share are anchors by their hash
CHAIN = 2
THRESHOLD = 0.8
ROWS_AT_ONCE = 256


def signatures(text: str, chain: int = CHAIN) -> np.ndarray:
    """The ascending distinct signature hashes of a text (uint32)."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint32)
    h = word_hashes(words)
    anchor = np.fromiter(map(ANCHORS.__contains__, words), bool, len(words)) | (h % np.uint64(DRAWN_EVERY) == 0)
    content = np.concatenate([h[~anchor], np.zeros(chain, np.uint64)])
    n_content = len(content) - chain
    # the start of the text, then each anchor: how many content words stand before it
    before = np.concatenate([[0], np.cumsum(~anchor)[anchor]])
    key = np.concatenate([[np.uint64(1)], h[anchor]])
    if n_content:
        key, before = key[before < n_content], before[before < n_content]
    with np.errstate(over="ignore"):
        for k in range(chain):
            key = mix(key * GOLDEN + content[np.minimum(before + k, len(content) - 1)])
    return np.unique((key >> np.uint64(32)).astype(np.uint32))


def fingerprint(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard index; 0 at once where the lengths alone keep it below ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _compare(batches):
    out = []
    held = None          # the previous row of the slice: (slice, id, text, signatures)

    def flush():
        nonlocal out
        rows, out = out, []
        return pa.RecordBatch.from_pylist(rows, schema=_RESULT_ARROW)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for place, ghost, doc_id, text in zip(*columns):
            found = signatures(text)
            if held is not None and held[0] == place and not held[4]:
                _, own_id, own, own_found, _ = held
                cut = len(own) // 3
                edited = own[:len(own) - cut] + text[:cut]
                edited_found = signatures(edited)
                out.append({
                    "doc_id": own_id, "n_chars": len(own),
                    "edited_sha256": hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                    "fingerprint": fingerprint(own_found), "edited_fingerprint": fingerprint(edited_found),
                    "near_edited": likeness(own_found, edited_found), "near_next": likeness(own_found, found),
                    "n_signatures": len(own_found)})
                if len(out) >= ROWS_AT_ONCE:
                    yield flush()
            held = place, doc_id, text, found, ghost
    if out:
        yield flush()


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, n_signatures long")
_RESULT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("n_signatures", pa.int64())])


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    slices: int | None = None) -> DataFrame:
    """Per row: its fingerprint, that of its edited text (the last third
    replaced by the beginning of the next document, descending id; after the
    last comes the first), and the likeness to both."""
    spark = docs.sparkSession
    slices = slices or partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)] or [0.5],
                                        10 * slices)).first()[0]                  # slices - 1 numbers
    splits = [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="value", outputCol="slice").transform(
        rows.withColumn("value", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))).drop("value")
    heads = sorted(rows.groupBy("slice").agg(F.max("doc_id")).collect(), reverse=True)    # a row per slice
    if not heads:
        return spark.createDataFrame([], _RESULT)
    # the first row of each slice also ends the slice before it; the very first ends the last
    after = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]
    target = spark.createDataFrame(after, T.StructType([T.StructField("head", T.LongType()),
                                                        T.StructField("slice", T.DoubleType())]))
    ghosts = (rows.drop("slice").join(F.broadcast(target), F.col("doc_id").eqNullSafe(F.col("head")))
              .select("slice", F.lit(1).alias("ghost"), "doc_id", "body"))
    dealt = rows.select("slice", F.lit(0).alias("ghost"), "doc_id", "body").union(ghosts)
    return (dealt.repartitionById(len(splits) - 1, F.col("slice").cast("int"))      # a slice is a partition
            .sortWithinPartitions("slice", "ghost", F.col("doc_id").desc_nulls_last(), "body")
            .mapInArrow(lean(_compare), _RESULT))


def _sets(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.slice(lo, ROWS_AT_ONCE)
            found = [signatures(t) for t in rows.column(1).to_pylist()]
            nodes = [hashlib.blake2b(f.tobytes(), digest_size=16).digest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(nodes, pa.binary()),
                 pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))],
                names=["doc_id", "node", "tokens"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id`` (smallest id of the class) of every row.  Texts
    without words share one class."""
    rows = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
                 .mapInArrow(lean(_sets), "doc_id long, node binary, tokens array<long>"))
    nodes = store(rows.where(F.size("tokens") > 0).select("node", "tokens").dropDuplicates(["node"]))
    each = nodes.select("node", F.explode("tokens").alias("token"))
    frequency = each.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    rare = (each.join(frequency, "token").groupBy("node")
            .agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("by_rarity")))
    n = F.size("by_rarity")
    part = F.floor(F.log(n.cast("double")) / float(-np.log(threshold)) + 1e-9)
    prefix = F.slice("by_rarity", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    members = (rare.select("node", n.cast("long").alias("tokens_n"), part.alias("part"), F.explode(prefix).alias("p"))
               .select("node", "tokens_n", F.explode(F.array("part", F.col("part") + 1)).alias("part"),
                       F.col("p.token").alias("token"))
               .select(F.xxhash64("part", "token").alias("bucket"), "node", "tokens_n"))
    payloads = nodes.withColumn("weights", F.transform("tokens", lambda t: F.lit(1.0).cast("float")))
    linked = store(link(shared_buckets(members.distinct()), payloads, threshold))
    placed = store(rows.select("doc_id", "node").join(linked, "node", "left")
                   .select("doc_id", F.coalesce("class", "node").alias("class")))
    named = store(placed.groupBy("class").agg(F.min("doc_id").alias("class_id")))
    return placed.join(named, "class").select("doc_id", "class_id")
