"""Classes of similar items from shared buckets, without pairing whole buckets.

Items (``node``, 16 bytes) that share a bucket are compared; two are linked
when their similarity is at least the threshold, and a class is a connected
component of the links.  Only the components are wanted, so:

1. every member of a bucket is compared with the bucket's pivot (its smallest
   node): rows linear in the bucket sizes;
2. buckets whose members then still belong to several components get the
   rest of the comparisons.  The members of such a bucket's largest component
   need none among themselves: they and the other members are cut into chunks
   of about ``CHUNK_TOKENS`` tokens, every chunk of others meets every chunk,
   and a task compares two chunks at a time, only pairs of different
   components, and returns only a spanning set of links.  With few members
   outside the largest component its rows are copied once, however many.

Every pair of a bucket is thus compared or already connected: the components
are those of all links, and no task holds more than two chunks.

Similarity is the larger of the Jaccard index of the token sets and the
probability Jaccard index of the weighted tokens (equal if all weights are).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import lean

CHUNK_TOKENS = 1 << 18


def probability_jaccard(ta: np.ndarray, wa: np.ndarray, tb: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common tokens i of 1 / sum_j max(a_j / a_i, b_j / b_i); tokens sorted."""
    _, ia, ib = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    upto = np.searchsorted(ratio, ratio, side="right")          # tokens of a ratio not above
    x_low = float(wa.sum()) - x.sum() + np.concatenate([[0], np.cumsum(x)])[upto]
    y_high = float(wb.sum()) - np.concatenate([[0], np.cumsum(y)])[upto]
    return float((1 / (y_high / y + x_low / x)).sum())


def similarity(ta, wa, tb, wb, enough: float = 0.0) -> float:
    """The larger index; 0 where neither can reach ``enough``."""
    if not len(ta) or not len(tb):
        return 0.0
    common = len(np.intersect1d(ta, tb, assume_unique=True))
    plain = common / (len(ta) + len(tb) - common)
    if plain >= enough > 0 or common == 0:
        return plain
    if (wa == wa[0]).all() and (wb == wb[0]).all() and wa[0] == wb[0]:
        return plain
    return max(plain, probability_jaccard(ta, wa, tb, wb))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            (ta, oa), (wa, _), (tb, ob), (wb, _) = (_lists(batch.column(i)) for i in (2, 3, 4, 5))
            keep = [similarity(ta[oa[i]:oa[i + 1]], wa[oa[i]:oa[i + 1]], tb[ob[i]:ob[i + 1]], wb[ob[i]:ob[i + 1]],
                               threshold) >= threshold for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))
    return run


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        nodes, classes = table.column("node").to_pylist(), table.column("class").to_pylist()
        chunk = table.column("chunk").to_numpy()
        same_chunk = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        tokens, at = _lists(table.column("tokens"))
        weights, _ = _lists(table.column("weights"))
        owner = np.repeat(np.arange(n), np.diff(at))
        order = np.argsort(tokens, kind="stable")
        listed, listed_owner = tokens[order], owner[order]
        mass = np.add.reduceat(np.append(weights, 0.0), at[:-1]) * (np.diff(at) > 0)
        size = np.diff(at)

        root = {c: c for c in classes}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        number = {c: i for i, c in enumerate(dict.fromkeys(classes))}
        label = np.array([number[c] for c in classes])
        largest = np.bincount(label).argmax()
        found = []
        for i in np.flatnonzero(label != largest):               # one side of every open pair
            own = slice(at[i], at[i + 1])
            left = np.searchsorted(listed, tokens[own], "left")
            count = np.searchsorted(listed, tokens[own], "right") - left
            total = int(count.sum())
            ends = np.cumsum(count)
            hits = listed_owner[np.arange(total) + np.repeat(left - (ends - count), count)]
            common = np.bincount(hits, minlength=n)
            shared = np.bincount(hits, weights=np.repeat(weights[own], count), minlength=n)
            plain = common / np.maximum(size[i] + size - common, 1)
            # neither index can exceed the common share of this item's weight
            may = (plain >= threshold) | (shared >= threshold * mass[i] * (1 - 1e-6))
            may &= (chunk != chunk[i]) | same_chunk
            for j in np.flatnonzero(may):
                a, b = find(classes[i]), find(classes[j])
                if a == b:
                    continue
                other = slice(at[j], at[j + 1])
                if plain[j] >= threshold or similarity(tokens[own], weights[own], tokens[other], weights[other],
                                                       threshold) >= threshold:
                    root[max(a, b)] = min(a, b)
                    found.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()),
                         "b": pa.array([b for _, b in found], pa.binary())})
    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, class`` (the component's smallest node) for the nodes of ``a, b`` edges.

    Alternating large-star and small-star steps; each is a grouped minimum
    and a join, written to the shared folder, until nothing changes."""
    current = store(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
                    .distinct())
    state = None
    while True:
        both = current.select(F.col("high").alias("u"), F.col("low").alias("v")).union(current.select("low", "high"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("high"), F.col("m").alias("low")).distinct())
        large = store(large)
        root = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(root, "high")
        small = (joined.where("low <> m").select(F.greatest("low", "m").alias("high"), F.least("low", "m").alias("low"))
                 .union(root.select("high", "m")).distinct())
        current = store(small)
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if now == state:
            break
        state = now
    return (current.select(F.col("high").alias("node"), F.col("low").alias("class"))
            .union(current.select(F.col("low").alias("node"), F.col("low").alias("class")).distinct()))


def shared_buckets(members: DataFrame) -> DataFrame:
    """The rows of (bucket, node, tokens_n) whose bucket has several nodes, stored."""
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    return store(members.join(several, "bucket"))


def link(shared: DataFrame, payloads: DataFrame, threshold: float, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``node, class`` of the nodes with a link, from ``shared_buckets`` and
    (node, tokens, weights) of its nodes, tokens ascending and distinct."""
    pivots = shared.groupBy("bucket").agg(F.min("node").alias("pivot"))
    pairs = (shared.join(pivots, "bucket").where("node <> pivot")
             .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    of = lambda side: payloads.select(F.col("node").alias(side), F.col("tokens").alias(f"t{side}"),
                                      F.col("weights").alias(f"w{side}"))
    first = store(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "wa", "tb", "wb")
                  .mapInArrow(lean(_verify(threshold)), "a binary, b binary"))
    joined = store(components(first))

    placed = (shared.join(joined, "node", "left").withColumn("class", F.coalesce("class", "node")))
    still_open = (placed.groupBy("bucket", "class").agg(F.sum("tokens_n").alias("tokens"))
                  .groupBy("bucket").agg(F.max_by("class", "tokens").alias("main"), F.max("tokens").alias("most"),
                                         F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("classes"))
                  .where("classes > 1")
                  .select("bucket", "main", F.ceil((F.col("all") - F.col("most")) / chunk_tokens).alias("others"),
                          F.ceil(F.col("most") / chunk_tokens).alias("mains")))
    # chunks of others are numbered first, then those of the largest component
    inside = F.col("class") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(inside, F.col("mains")).otherwise(F.col("others")))
    rest = (placed.join(still_open, "bucket")
            .withColumn("chunk", F.when(inside, F.col("others") + own).otherwise(own))
            .withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("others"))
                                                      .otherwise(F.col("others") + F.col("mains")) - 1)))
            .select("bucket", F.least("chunk", "meets").alias("low"), F.greatest("chunk", "meets").alias("high"),
                    "chunk", "node", "class"))
    second = store(rest.join(payloads, "node").select("bucket", "low", "high", "chunk", "node", "class", "tokens",
                                                      "weights")
                   .groupBy("bucket", "low", "high").applyInArrow(_tile(threshold), "a binary, b binary"))
    return components(first.union(second))
