"""Language identification by a bidirectional gated recurrent network over
bytes (operator 4).

Texts are read as UTF-8 bytes in consecutive windows of ``WINDOW`` bytes, so a
long text is many windows of one batch and all of it is read.  In a window one
gated recurrent unit runs forwards and one backwards; a softmax over both
states labels every byte position, and a document's probabilities are the
mean over its letter positions (ASCII letters and bytes of 128 and up).

The network is trained in numpy by backpropagation through time (Adam) on the
driver.  It learns every language of the table.  The training rows of each are
bounded: about ``PER_LANGUAGE`` documents, fewer (``SAMPLE`` in all, but
``LEAST_PER_LANGUAGE`` or more) when the languages are many, chosen by a hash
of the id, ``WINDOWS_PER_DOCUMENT`` windows of each.  Prediction runs in Arrow
batches on every row; nothing shuffles.

Cases: null text or text without any letter: ``und``, score 0; null
languages and ids are not trained on; without training rows every text is
``und``; repeated rows get equal predictions; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of

HIDDEN = 8
WINDOW = 64
PER_LANGUAGE = 400
SAMPLE = 25_600
LEAST_PER_LANGUAGE = 32
WINDOWS_PER_DOCUMENT = 8
STEPS = 300
BATCH = 256
RATE = 0.02
SEED = 43
WINDOWS_AT_ONCE = 2048
UNDETERMINED = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _run(x: np.ndarray, table: np.ndarray, u: np.ndarray, order, keep: bool = False):
    """States of one direction over bytes ``x`` (time, batch), laid out
    (time, hidden, batch).  ``table`` (3 hidden, 256) holds the input part of
    update, reset and candidate; ``u`` (3 hidden, hidden) the recurrent part.
    A sigmoid is (tanh(x / 2) + 1) / 2.  ``keep``: also what training needs."""
    hidden = u.shape[1]
    steps, batch = x.shape
    states = np.empty((steps, hidden, batch), table.dtype)
    h = np.zeros((hidden, batch), table.dtype)
    kept = {}
    for t in order:
        given = np.take(table, x[t], axis=1)
        back = u @ h
        gates = given[:2 * hidden]
        gates += back[:2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:hidden], gates[hidden:]
        n = given[2 * hidden:]
        n += r * back[2 * hidden:]
        np.tanh(n, out=n)
        new = states[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        if keep:
            kept[t] = h, z, r, n, back[2 * hidden:]
        h = new
    return states, kept


def _back(x, u, order, kept, d_states):
    """Gradients of one direction: of ``table`` and ``u``."""
    hidden = u.shape[1]
    d_u = np.zeros_like(u)
    d_h = np.zeros_like(d_states[0])
    d_given = np.empty((x.shape[0], 3 * hidden, x.shape[1]), u.dtype)
    for t in reversed(list(order)):
        before, z, r, n, back_n = kept[t]
        d_h = d_h + d_states[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (before - n) * z * (1 - z)
        d_r = d_n * back_n * r * (1 - r)
        d_given[t] = np.concatenate([d_z, d_r, d_n])
        d_back = np.concatenate([d_z, d_r, d_n * r])
        d_u += d_back @ before.T
        d_h = d_h * z + u.T @ d_back
    flat = x.ravel()
    d_table = np.stack([np.bincount(flat, weights=d_given[:, k].ravel(), minlength=256)
                        for k in range(3 * hidden)]).astype(u.dtype)
    return d_table, d_u


@dataclass
class BidirectionalGru:
    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> "BidirectionalGru":
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        weights = {}
        for way in ("forward", "backward"):
            weights[f"{way}_table"] = make(3 * hidden, 256, scale=0.3)
            weights[f"{way}_u"] = make(3 * hidden, hidden, scale=hidden ** -0.5)
        weights["out"] = make(len(languages), 2 * hidden, scale=0.3)
        weights["bias"] = np.zeros((len(languages), 1), np.float32)
        return cls(languages, weights)

    def _positions(self, x: np.ndarray, keep: bool = False):
        """Probabilities (language, time * batch) of every position, and the states."""
        w = self.weights
        steps = range(x.shape[0])
        f, kept_f = _run(x, w["forward_table"], w["forward_u"], steps, keep)
        b, kept_b = _run(x, w["backward_table"], w["backward_u"], steps[::-1], keep)
        both = np.concatenate([f, b], 1).transpose(1, 0, 2).reshape(w["out"].shape[1], -1)
        p = w["out"] @ both
        p += w["bias"]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p, both, kept_f, kept_b

    def label_positions(self, text: str) -> np.ndarray:
        """Probabilities (byte, language) of every byte of one text."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        x, _, _ = _windows(data, np.array([0, len(data)]))
        p, _, _, _ = self._positions(np.ascontiguousarray(x.T))
        p = p.reshape(len(self.languages), WINDOW, -1).transpose(2, 1, 0).reshape(-1, len(self.languages))
        return p[:len(data)]

    def pooled(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean probabilities over the letter positions of the texts
        ``data[bounds[i]:bounds[i + 1]]``; zeros for a text without letters."""
        x, of, used = _windows(data, bounds)
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        letters = np.zeros(len(bounds) - 1)
        # each byte has a probability for every language: fewer windows when these are many
        n = max(1, WINDOWS_AT_ONCE * 64 // max(64, len(self.languages)))
        for lo in range(0, len(x), n):
            some = np.ascontiguousarray(x[lo:lo + n].T)
            mask = _LETTER[some] & (np.arange(WINDOW)[:, None] < used[lo:lo + n])
            p, _, _, _ = self._positions(some)
            p = p.reshape(len(self.languages), *some.shape)
            p *= mask
            np.add.at(total, of[lo:lo + n], p.sum(1, dtype=np.float64).T)
            np.add.at(letters, of[lo:lo + n], mask.sum(0))
        return total / np.maximum(letters, 1)[:, None]

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean cross entropy of the letter positions of windows ``x`` (time,
        batch) of languages ``y``, and its gradients by backpropagation through time."""
        w = self.weights
        p, both, kept_f, kept_b = self._positions(x, keep=True)
        mask = _LETTER[x].ravel()
        target = np.tile(y, x.shape[0])
        count = max(1, int(mask.sum()))
        at = np.arange(p.shape[1])
        loss = -float(np.log(np.maximum(p[target, at], 1e-12))[mask].sum()) / count
        d = p
        d[target, at] -= 1
        d *= mask / np.float32(count)
        d_both = (w["out"].T @ d).reshape(-1, *x.shape).transpose(1, 0, 2)
        hidden = w["forward_u"].shape[1]
        steps = range(x.shape[0])
        grads = {"out": d @ both.T, "bias": d.sum(1, keepdims=True)}
        grads["forward_table"], grads["forward_u"] = _back(x, w["forward_u"], steps, kept_f, d_both[:, :hidden])
        grads["backward_table"], grads["backward_u"] = _back(x, w["backward_u"], steps[::-1], kept_b,
                                                             d_both[:, hidden:])
        return loss, grads

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = RATE) -> None:
        """Adam over batches that hold the languages evenly; ``windows`` (n, WINDOW) bytes."""
        rng = np.random.default_rng(SEED)
        by_language = [np.flatnonzero(labels == i) for i in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(by_language[i]) for i in rng.integers(len(self.languages), size=BATCH)])
            _, grads = self.loss_and_gradients(np.ascontiguousarray(windows[pick].T), labels[pick])
            size = np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))
            decay = 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
                self.weights[k] -= (rate * decay * move).astype(np.float32)


def _windows(data: np.ndarray, bounds: np.ndarray):
    """Cut texts into windows: bytes (n, WINDOW) padded by 0, the text of each
    window, and its number of bytes."""
    lengths = np.diff(bounds)
    counts = -(-lengths // WINDOW)
    of = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[:-1][of] + nth * WINDOW
    used = np.minimum(WINDOW, bounds[1:][of] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(of) else np.zeros((0, WINDOW), np.uint8)
    x[np.arange(WINDOW) >= used[:, None]] = 0
    return x, of, used


def _sample_windows(batches):
    for batch in batches:
        data = []
        for text in batch.column(0).to_pylist():
            raw = text.encode("utf-8", "replace")
            rng = np.random.default_rng(zlib.crc32(raw))
            last = max(0, len(raw) - WINDOW)
            data.append([raw[at:at + WINDOW].ljust(WINDOW, b"\0")
                         for at in sorted(set(rng.integers(0, last + 1, WINDOWS_PER_DOCUMENT).tolist()))])
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(data, pa.list_(pa.binary()))],
                                         names=["id", "lang", "windows"])


def fit(docs: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", per_language: int = PER_LANGUAGE, steps: int = STEPS) -> BidirectionalGru:
    """Train on a hash sample of the rows for which ``use`` (over ``id_col``) holds."""
    rows = docs.where(use) if use is not None else docs
    rows = (rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang"))
            .where(F.col("id").isNotNull() & F.col("body").isNotNull() & F.col("lang").isNotNull()))
    counts = rows.groupBy("lang").count().collect()                # a row per language
    if not counts:
        return BidirectionalGru.start([])
    # a language's rows pass with the probability that leaves about this many of them
    most = min(per_language, max(LEAST_PER_LANGUAGE, SAMPLE // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], most / r["count"]) for r in counts],
                                               "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    # an id on several rows of a language counts once, so the sample bounds what the driver gets
    got = (rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("body", "lang", "id")
           .mapInArrow(lean(_sample_windows),
                       f"id {rows.schema['id'].dataType.simpleString()}, lang string, windows array<binary>")
           .groupBy("id", "lang").agg(F.min("windows").alias("windows"))
           .select("lang", F.explode("windows").alias("bytes")).toArrow())
    pairs = sorted(set(zip(got.column("lang").to_pylist(), got.column("bytes").to_pylist())))
    languages = sorted({lang for lang, _ in pairs})
    model = BidirectionalGru.start(languages)
    if len(languages) > 1:
        windows = np.frombuffer(b"".join(b for _, b in pairs), np.uint8).reshape(-1, WINDOW)
        model.train(windows, np.array([languages.index(lang) for lang, _ in pairs]), steps)
    return model


def predict(docs: DataFrame, model: BidirectionalGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    languages = np.array(model.languages, object)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                texts = rows.column(1).cast(pa.large_string())
                raw = [t.encode("utf-8", "replace") for t in texts.to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                data = np.frombuffer(b"".join(raw), np.uint8)
                known = [any(c.isalpha() for c in t.as_py()) for t in texts]
                if len(languages):
                    p = model.pooled(data, bounds)
                    best = p.argmax(1)
                    names = [languages[b] if k else UNDETERMINED for b, k in zip(best, known)]
                    scores = np.where(known, p[np.arange(len(best)), best], 0.0)
                else:
                    names, scores = [UNDETERMINED] * len(raw), np.zeros(len(raw))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1), pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
            .mapInArrow(lean(run), "doc_id long, lang_pred string, score double"))
