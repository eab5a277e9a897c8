"""Periodic runs of words inside a document (operator 12).

A run of period q is a stretch of consecutive words in which words q apart
are identical, of at least ``max(LEAST, 2 q)`` words, that no neighbouring
word extends; q is the smallest period of the stretch.  Its words and their
copies q further on agree over at least max(LEAST - q, q) words, so with
LEAST = 12 at least 6 of them: every run shows as two equal 6-grams at lag q.

Seed and extend, on the diagonals (lags) of one document:

1. k-grams of the guaranteed overlap are indexed: 6-grams for lags below 12,
   then 12-grams for lags of 12 to 23, 24-grams and so on, twice the length
   each time.  Grams get exact names (a gram's name is that of its two
   halves); only grams that occur again are carried on.
2. Occurrence pairs of a gram with a lag of its scale are enumerated, but
   only those of which one side is a head: no earlier occurrence within half
   a gram.  If neither is, the words before both repeat with the gram's own
   period and agree, so the stretch does not begin here.  The pair at which a
   stretch begins is always listed, and a text has O(words) pairs a scale,
   however repetitive it is.
3. A table holds, for every lag, the furthest word covered so far.  Pairs
   come in order of their position; one that is covered is part of a stretch
   already extended and is skipped, any other is a stretch's begin and is
   extended by the names from the longest gram to the shortest.
4. Stretches with the same bounds are the same run at multiples of its
   period: the smallest one stays.

A document is one row's work; nothing is shuffled.  Words and periods have no
upper bound, and no pair is dropped.

Cases: null text is empty; a text without words has no run (null figures, the
hashes of the empty string); repeated rows each get a row; a null id leaves
the text as it is (no edit); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12                     # words of the shortest run
_FIELDS = "n_runs long, start long, length long, period long, exponent_milli long"


def word_ids(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def _names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names, equal only where both are; -1 where a pair
    occurs once (or a half does)."""
    out = np.full(len(left), -1, np.int64)
    use = np.flatnonzero((left >= 0) & (right >= 0))
    if len(use):
        pair = left[use] * (int(right[use].max()) + 1) + right[use]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1
        out[use[order[again]]] = group[again]
    return out


def _grams(ids: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(size, names by position) for the sizes least/2, least, 2 least ...
    while a gram of that size occurs twice."""
    n, half = len(ids), least // 2
    if n < least:
        return []
    names, size = ids, 1
    while size < half:                        # up to the first size, in steps of at most doubling
        step = min(size, half - size)
        names = _names(names[:n - size - step + 1], names[step:n - size + 1])
        size += step
    out = []
    while (names >= 0).any():
        out.append((size, names))
        if 2 * size > n:
            break
        names = _names(names[:n - 2 * size + 1], names[size:n - size + 1])
        size *= 2
    return out


def _pairs(names: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags (``low`` to ``high`` - 1) of equal grams of which one is a head."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]        # by name, then position
    name = names[at]
    head = np.ones(len(at), bool)
    head[1:] = (name[1:] != name[:-1]) | (at[1:] - at[:-1] > size // 2)
    heads = np.flatnonzero(head)
    # a key that grows by name and position, with room for a lag between names
    room = int(at.max()) + high + 1
    key = name * room + at
    found = []
    for sign in (1, -1):                                 # the head comes first, or last
        edges = (low, high) if sign > 0 else (1 - high, 1 - low)
        left = np.searchsorted(key, key[heads] + edges[0], "left")
        right = np.searchsorted(key, key[heads] + edges[1], "left")
        count = right - left
        ends = np.cumsum(count)
        other = np.arange(int(ends[-1])) + np.repeat(left - (ends - count), count)
        own = np.repeat(heads, count)
        first, last = (own, other) if sign > 0 else (other, own)
        found.append((at[first], at[last] - at[first]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Every run as (start, length, period), by start, then period."""
    grams = _grams(ids, least)
    n = len(ids)

    def agree(i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` on (i < j)."""
        begin = i
        for level, (size, names) in enumerate(reversed(grams)):
            end = len(names)
            while j < end and names[i] >= 0 and names[i] == names[j]:
                i, j = i + size, j + size
                if level:                     # a longer gram has failed here already
                    break
        while j < n and ids[i] == ids[j]:
            i, j = i + 1, j + 1
        return i - begin

    covered: dict[int, int] = {}              # lag -> the first word not covered yet
    best: dict[tuple[int, int], int] = {}     # (start, length) -> smallest period
    for size, names in grams:
        low = 1 if size == least // 2 else size
        position, lag = _pairs(names, size, low, 2 * size)
        order = np.lexsort((lag, position))
        for i, q in zip(position[order].tolist(), lag[order].tolist()):
            if i < covered.get(q, 0):
                continue
            same = agree(i, i + q)
            covered[q] = i + same
            length = same + q
            if length >= max(least, 2 * q):
                best[i, length] = min(q, best.get((i, length), q))
    return sorted((start, length, period) for (start, length), period in best.items())


def edited(words: list[str], doc_id: int | None) -> list[str]:
    """The document's words with the periodic tail that its id may ask for."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words outside every run's repeats (its words after the first period)."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def _of_batches(edit: bool, least: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in (
                "n_runs", "start", "length", "period", "exponent_milli", "a", "b")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORDS.findall(text)
                if edit:
                    words = edited(words, doc_id)
                runs = find_runs(word_ids(words), least)
                out["n_runs"].append(len(runs))
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
                out["start"].append(start)
                out["length"].append(length)
                out["period"].append(period)
                out["exponent_milli"].append(1000 * length // period if runs else None)
                rest = " ".join(collapsed(words, runs) if runs else words)
                if full:
                    out["a"].append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                    out["b"].append(rest)
                else:
                    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
                    out["a"].append(hashlib.sha256(lines.encode()).hexdigest())
                    out["b"].append(hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest())
            kinds = [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()] \
                if full else [pa.string()] * 2
            types = [pa.int64()] * 5 + kinds
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), types)]],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                       *(("runs", "collapsed") if full else ("runs_sha256", "collapsed_sha256"))])
    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("body"))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
         edit: bool = False) -> DataFrame:
    """Per row: ``doc_id``, the longest run, all ``runs`` (start, length,
    period) and the ``collapsed`` text.  ``least``: an even number of words."""
    return _rows(docs, id_col, text_col).mapInArrow(lean(_of_batches(edit, least, True)), (
        f"doc_id long, {_FIELDS}, runs array<struct<start:long,length:long,period:long>>, collapsed string"))


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                edit: bool = True) -> DataFrame:
    """As ``runs`` of the edited texts, with the hashes of the runs and of the collapsed text."""
    return _rows(docs, id_col, text_col).mapInArrow(lean(_of_batches(edit, least, False)), (
        f"doc_id long, {_FIELDS}, runs_sha256 string, collapsed_sha256 string"))
