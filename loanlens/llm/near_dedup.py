"""Near duplicates by ProbMinHash (operator 3).

A document is the weighted set of its word shingles (``SHINGLE`` words, lower
case; weight 1 + ln(count)).  ProbMinHash: each shingle's arrivals form a
Poisson process whose rate is its weight, every arrival lands in one of
``BANDS * ROWS`` registers, and a register keeps the shingle that arrives
first.  A document stops once the next arrival of each shingle comes later
than its latest register.  Two documents agree in a register with the
probability Jaccard index of their weighted sets, so at an index of 0.8 they
share one of 25 bands of 5 registers with probability 0.99995.  The same
hashes with equal weights give the bands of the plain sets, whose registers
agree with their Jaccard index; where a document's weights are all equal the
two are the same.  Each index that links is thus retrieved by its own bands.

Documents with equal weighted sets are one node; nodes that share a band are
verified exactly and classed by ``linking`` (an exact similarity of
``threshold`` or more by the probability Jaccard index of the weighted sets
or the Jaccard index of the plain sets).

Cases: null text is empty; a text of fewer than ``SHINGLE`` words is one
shingle; texts without words are classed by their whole text; repeated rows
and equal texts share a class; null ids are smallest and name a class only if
all its ids are null; an id on several rows names rows, not one document: each
is decided by its own text; an empty table gives an empty result; extra
columns are ignored by ``classes`` and kept by ``survivors``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import lean, text_of
from .hashing import GOLDEN, WORD, mix, word_hashes
from .linking import link, shared_buckets

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
DOCS_AT_ONCE, CHARS_AT_ONCE = 1024, 1_000_000      # texts a task handles together

def shingles(texts: list[str], size: int = SHINGLE):
    """The weighted shingles of each text: hashes ascending per text, weights,
    and the bounds of each text in them."""
    rows = [WORD.findall(t.lower()) for t in texts]
    lengths = np.array([len(r) for r in rows], np.int64)
    h = word_hashes([w for r in rows for w in r])
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(rows)), counts)
    start = np.repeat(ends - lengths, counts) + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = np.minimum(lengths, size)[doc]
    s = width.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for k in range(size):
        s = np.where(k < width, mix(s * GOLDEN + padded[start + k]), s)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(s)))
    bounds = np.searchsorted(doc[at], np.arange(len(rows) + 1))
    return s[at], (1 + np.log(count)).astype(np.float32), bounds


def prob_min_hash(tokens: np.ndarray, weights: np.ndarray, bounds: np.ndarray, registers: int) -> np.ndarray:
    """(text, register): the token whose arrival came first; 0 for an empty text."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(tokens))
    active = np.arange(len(tokens))
    seed = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(active):
            seed += GOLDEN
            draw = mix(tokens[active] + seed)
            u = ((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53
            time[active] -= np.log(u) / weights[active]
            place = doc[active] * registers + (mix(draw + GOLDEN) % np.uint64(registers)).astype(np.int64)
            t = time[active]
            np.minimum.at(first, place, t)
            won = t == first[place]
            winner[place[won]] = tokens[active[won]]
            some = np.unique(doc[active])
            latest = np.zeros(n)
            latest[some] = first.reshape(n, registers)[some].max(1)
            active = active[t < latest[doc[active]]]
    return winner.reshape(n, registers)


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key + signature[:, k::rows][:, :bands])
    return key.view(np.int64)


def _bands(tokens: np.ndarray, weights: np.ndarray, bounds: np.ndarray, bands: int, rows: int):
    """The band keys of each text's weighted set and of its plain set, each
    key once, and the bounds of each text in them (none for an empty text)."""
    sizes = np.diff(bounds)
    weighted = _band_keys(prob_min_hash(tokens, weights, bounds, bands * rows), bands, rows)
    # equal weights only scale the times: the plain registers are the same
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.append(weights, 1)[bounds[:-1]]
    uneven = np.zeros(len(sizes), bool)
    uneven[doc[weights != first[doc]]] = True
    plain = np.zeros_like(weighted)
    inside = uneven[doc]
    plain[uneven] = _band_keys(prob_min_hash(tokens[inside], np.ones(inside.sum(), np.float32),
                                             np.concatenate([[0], np.cumsum(sizes[uneven])]), bands * rows), bands, rows)
    use = np.concatenate([np.repeat(sizes[:, None] > 0, bands, 1), uneven[:, None] & (plain != weighted)], 1)
    return np.concatenate([weighted, plain], 1)[use], np.concatenate([[0], np.cumsum(use.sum(1))])


def _node(tokens: np.ndarray, weights: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes() + weights.tobytes(), digest_size=16).digest()


def _wordless(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16, person=b"wordless").digest()


def _parts(batches, size):
    for batch in batches:
        lo = 0
        lengths = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)
        while lo < batch.num_rows:
            total = np.cumsum(lengths[lo:lo + DOCS_AT_ONCE])
            n = max(1, int(np.searchsorted(total, CHARS_AT_ONCE, "right")))
            rows = batch.slice(lo, n)
            with np.errstate(over="ignore"):
                yield rows, *shingles(rows.column(1).to_pylist(), size)
            lo += n


def _sign(size: int, bands: int, rows: int):
    def run(batches):
        for part, tokens, weights, bounds in _parts(batches, size):
            keys, offsets = _bands(tokens, weights, bounds, bands, rows)
            nodes = [_node(tokens[a:b], weights[a:b]) if a < b else _wordless(text)
                     for a, b, text in zip(bounds, bounds[1:], part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(nodes, pa.binary()), pa.array(np.diff(bounds), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys, pa.int64()))],
                names=["doc_id", "text_id", "node", "tokens_n", "bands"])
    return run


def _payload(size: int):
    def run(batches):
        for _, tokens, weights, bounds in _parts(batches, size):
            # hashes as signed integers, ascending as such
            signed = tokens.view(np.int64)
            order = np.lexsort((signed, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
            at = pa.array(bounds.astype(np.int32))
            nodes = [_node(tokens[a:b], weights[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(at, pa.array(signed[order])),
                 pa.ListArray.from_arrays(at, pa.array(weights[order]))], names=["node", "tokens", "weights"])
    return run


def _text_id(body: Column) -> Column:
    return F.unhex(F.md5(F.encode(body, "UTF-8")))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_id, node, tokens_n, bands`` of every row (no bands without
    words); ``text_id`` is the whole text's 128-bit hash."""
    body = text_of(text_col)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), _text_id(body).alias("text_id"))
            .mapInArrow(lean(_sign(size, bands, rows)),
                        "doc_id long, text_id binary, node binary, tokens_n long, bands array<long>"))


def _placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
            size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Of every row: ``doc_id, text_id, class_id, class_size, kept``."""
    signed = store(signatures(docs, id_col, text_col, size, bands, rows))
    nodes = signed.where("tokens_n > 0").groupBy("node").agg(F.min("doc_id").alias("some_id"),
                                                            F.first("tokens_n").alias("tokens_n"),
                                                            F.first("bands").alias("bands"))
    shared = shared_buckets(nodes.select(F.explode("bands").alias("bucket"), "node", "tokens_n"))
    wanted = shared.select("node").distinct()
    # one document for each node to compare: its shingles are made again
    some = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("some_id"))
    some = store(some.select("some_id").distinct())
    texts = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
             .join(some, F.col("doc_id").eqNullSafe(F.col("some_id")), "left_semi"))
    payloads = store(texts.mapInArrow(lean(_payload(size)), "node binary, tokens array<long>, weights array<float>")
                     .dropDuplicates(["node"]))
    linked = store(link(shared, payloads, threshold))

    placed = store(signed.join(linked, "node", "left")
                   .select("doc_id", "text_id", F.coalesce("class", "node").alias("class")))
    # the smallest known id, then the smallest hash of its texts; stored, so
    # that a large class is only a key of a join, whose rows can be split
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_id"))
    named = store(placed.groupBy("class").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size")))
    return (placed.join(named, "class")
            .select("doc_id", "text_id", F.col("first.doc_id").alias("class_id"), "class_size",
                    (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
                     & (F.col("text_id") == F.col("first.text_id"))).alias("kept")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``doc_id, class_id`` (the class's smallest id),
    ``class_size, kept``.  Options: threshold, size, bands, rows."""
    return _placed(docs, id_col, text_col, **options).drop("text_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each class, matched by
    id and text (rows that repeat both all stay; remove exact copies first)."""
    kept = (_placed(docs, id_col, text_col, **options).where("kept")
            .select(F.col("doc_id").alias("kept_id"), F.col("text_id").alias("kept_text")).distinct())
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _text_id(text_of(F.col(f"`{text_col}`"))).alias("hash"),
                       F.struct("*").alias("row"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_text"))
    return rows.join(kept, same, "left_semi").select("row.*")
