"""Toxicity by a factorization machine over hashed terms (operator 10).

A text's terms are its words and their first ``PREFIXES`` letters (stems that
inflected insults share), hashed to ``2 ** HASH_BITS`` buckets.  The model
    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)
learns a weight and a factor vector per bucket, so pairs of terms (an insult
with a group mention) count beyond the sum of their parts.  x is 1 for a
present bucket.  Only the ``FEATURES`` buckets that tell the classes apart
best in the training rows (chi square of ``MIN_CHI`` or more, at least
``MIN_DOCS`` rows) take part; all other buckets are 0, which keeps long texts
from collecting noise (README gives the measured effect of these bounds).
Fewer than ``MIN_CHI`` training rows therefore learn the class share alone.

Training rows: labelled documents, at most ``MAX_TRAIN`` (the smallest hashes
of their ids; a documented bound on the fit).  Spark counts their buckets by
class; the driver gets the chosen buckets and which of them each training row
has, never a text or its other buckets, and descends in numpy.  Scoring:
every row, whole text.

Cases: null text is empty; an empty or unknown text gets sigmoid(w0); null
labels and ids are not trained on; an id labelled twice counts as toxic when
any label is 1; labels repeated or without a document are harmless; with no
labelled row, or one class only, the score is the smoothed class share;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import lean, remembers, text_of

HASH_BITS = 20
PREFIXES = (3, 4, 5)
FEATURES = 4096
MIN_DOCS = 3
MIN_CHI = 15.0
MAX_TRAIN = 16_000
FACTORS = 4
STEPS = 2000                   # of gradient descent, in whole passes over the rows
BATCH = 256
RATE = 0.1
L2 = 1e-5
SEED = 29
CACHE_WORDS = 100_000          # words a worker remembers
ROWS_AT_ONCE = 512             # training rows counted together
_WORD = re.compile(r"\w+")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1)


def word_buckets(word: str) -> tuple[int, ...]:
    return (bucket(word), *(bucket("^" + word[:k]) for k in PREFIXES if len(word) > k))


_remembered_buckets = lru_cache(CACHE_WORDS)(word_buckets)
remembers(__name__, _remembered_buckets.cache_clear)


def buckets_of(text: str) -> np.ndarray:
    """The distinct buckets of a text, ascending."""
    found = {b for w in set(_WORD.findall(text.lower())) for b in _remembered_buckets(w)}
    return np.array(sorted(found), np.int32)


@dataclass
class FactorizationMachine:
    """``place[bucket]`` is the bucket's feature number or -1."""
    place: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)     # features of words seen

    def features(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = tuple(p for p in self.place[list(word_buckets(word))].tolist() if p >= 0)
            self.known[word] = found
        return found

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray) -> "FactorizationMachine":
        size = 1 << HASH_BITS
        n, positive = len(rows), int(labels.sum())
        none = cls(np.full(size, -1, np.int32), float(np.log((positive + 0.5) / (n - positive + 0.5))),
                   np.zeros(0), np.zeros((0, FACTORS)))
        if positive in (0, n):
            return none
        in_toxic, in_all = np.zeros(size), np.zeros(size)
        for lo in range(0, n, ROWS_AT_ONCE):
            some = rows[lo:lo + ROWS_AT_ONCE]
            flat = np.concatenate(some)
            label = np.repeat(labels[lo:lo + ROWS_AT_ONCE], [len(r) for r in some])
            in_toxic += np.bincount(flat, weights=label, minlength=size)
            in_all += np.bincount(flat, minlength=size)
        share = positive / n
        # chi square of presence against the label
        expected = in_all * share
        spread = in_all * (1 - in_all / n) * share * (1 - share)
        chi = np.where((in_all >= MIN_DOCS) & (in_all < n), (in_toxic - expected) ** 2 / np.maximum(spread, 1e-9), 0)
        best = np.argsort(-chi, kind="stable")[:FEATURES]
        best = best[chi[best] >= MIN_CHI]
        place = np.full(size, -1, np.int32)
        place[best] = np.arange(len(best))

        kept = [(lambda p: p[p >= 0])(place[r]) for r in rows]
        columns = np.concatenate(kept)
        starts = np.concatenate([[0], np.cumsum([len(k) for k in kept])])
        rng = np.random.default_rng(SEED)
        w0, w, v = none.w0, np.zeros(len(best)), rng.normal(0, 0.01, (len(best), FACTORS))
        g_w, g_v, g_0 = np.full(len(best), 1e-3), np.full((len(best), FACTORS), 1e-3), 1e-3
        for _ in range(-(-STEPS * BATCH // n) if n >= BATCH else STEPS):
            order = rng.permutation(n)
            for lo in range(0, n, BATCH):
                some = order[lo:lo + BATCH]
                cols = np.concatenate([columns[starts[i]:starts[i + 1]] for i in some])
                row = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
                score, sums = _forward(cols, row, len(some), w0, w, v)
                error = 1 / (1 + np.exp(-score)) - labels[some]
                e = error[row]
                d_w = np.bincount(cols, weights=e, minlength=len(best)) / len(some) + L2 * w
                d_v = np.stack([np.bincount(cols, weights=e * (sums[row, k] - v[cols, k]), minlength=len(best))
                                for k in range(FACTORS)], 1) / len(some) + L2 * v
                d_0 = error.mean()
                g_w += d_w ** 2
                g_v += d_v ** 2
                g_0 += d_0 ** 2
                w -= RATE * d_w / np.sqrt(g_w)
                v -= RATE * d_v / np.sqrt(g_v)
                w0 -= RATE * d_0 / np.sqrt(g_0)
        return cls(place, float(w0), w, v)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of rows given as feature numbers."""
        cols = np.concatenate(rows) if rows else np.zeros(0, int)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        s, _ = _forward(cols.astype(int), row, len(rows), self.w0, self.w, self.v)
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def _forward(cols, row, n, w0, w, v):
    """Raw scores and the per-row factor sums: the pair term in linear time."""
    linear = np.bincount(row, weights=w[cols], minlength=n)
    sums = np.stack([np.bincount(row, weights=v[cols, k], minlength=n) for k in range(FACTORS)], 1)
    squares = np.bincount(row, weights=(v[cols] ** 2).sum(1), minlength=n)
    return w0 + linear + 0.5 * ((sums ** 2).sum(1) - squares), sums


def _bucket_batches(batches):
    for batch in batches:
        found = [buckets_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.int32())), batch.column(0)],
                                         names=["id", "buckets", "toxic"])


def telling_buckets(train: DataFrame) -> list[int]:
    """The buckets that tell the classes of ``train`` (buckets, toxic) apart
    best, by the bounds above; at most ``FEATURES`` of them leave Spark.
    ``FactorizationMachine.fit`` applies the same rule to the same counts."""
    size = train.agg(F.count("*").alias("n"), F.sum("toxic").alias("positive")).first()
    n, positive = size["n"], size["positive"] or 0
    if positive in (0, n):
        return []
    share = positive / n
    spread = F.col("in_all") * (1 - F.col("in_all") / n) * share * (1 - share)
    chi = F.pow(F.col("in_toxic") - F.col("in_all") * share, F.lit(2.0)) / F.greatest(spread, F.lit(1e-9))
    counts = (train.select(F.explode("buckets").alias("bucket"), "toxic").groupBy("bucket")
              .agg(F.count("*").cast("double").alias("in_all"), F.sum("toxic").cast("double").alias("in_toxic")))
    best = (counts.where((F.col("in_all") >= MIN_DOCS) & (F.col("in_all") < n) & (chi >= MIN_CHI))
            .orderBy(chi.desc(), "bucket").limit(FEATURES))
    return [r.bucket for r in best.select("bucket").collect()]


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> FactorizationMachine:
    """Fit on at most ``max_train`` labelled rows for which ``use`` (over the
    labels table's ``id_col``) holds."""
    known = labels.where(use) if use is not None else labels
    # chosen from the narrow labels table alone; at most max_train rows
    sample = (known.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(max_train))
    rows = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
            .join(F.broadcast(sample), "id").select("toxic", "body", "id"))
    # an id on several rows counts once: max_train rows of hashed buckets at most
    train = store(rows.mapInArrow(lean(_bucket_batches),
                                  f"id {rows.schema['id'].dataType.simpleString()}, buckets array<int>, toxic int")
                  .groupBy("id").agg(F.min(F.struct("buckets", "toxic")).alias("row")).select("row.*"))
    terms = F.array(*[F.lit(b) for b in telling_buckets(train)]).cast("array<int>")
    got = train.select(F.array_intersect("buckets", terms).alias("buckets"), "toxic").toArrow()
    lists = got.column("buckets").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.chunked_array(lists).combine_chunks()
    values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
    toxic = got.column("toxic").to_numpy().astype(float)
    cut = [values[a:b] for a, b in zip(bounds, bounds[1:])]
    # rows in an order of their own, so the fit does not depend on arrival
    order = sorted(range(len(cut)), key=lambda i: (len(cut[i]), zlib.crc32(cut[i].tobytes()), toxic[i]))
    return FactorizationMachine.fit([cut[i] for i in order], toxic[order] if len(order) else np.zeros(0))


def _score_texts(m: FactorizationMachine, texts: list[str | None]) -> np.ndarray:
    features = m.features
    return m.score([np.array(sorted({f for w in set(_WORD.findall((text or "").lower())) for f in features(w)}),
                             np.int64) for text in texts])


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # FEATURES rows and 2**HASH_BITS places

    def run(batches):
        for batch in batches:
            s = _score_texts(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
            .mapInArrow(lean(run), "doc_id long, score double, predicted int"))


def keep_clean(docs: DataFrame, model: FactorizationMachine, text_col: str = "text",
               threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that score below ``threshold``;
    each is decided where it is scored, so nothing shuffles."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = _score_texts(shared.value, batch.column(at).to_pylist()) < threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
