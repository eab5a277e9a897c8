"""Spelling variants grouped by one-edit neighbours (operator 11).

Words are counted over all documents with map-side combine.  A word is a
point: how often each letter stands in it.  One replaced letter moves the
point by 2 in L1 distance (one count up, one down), one inserted or deleted
letter by 1.  For each word length a k-d tree splits the points at medians of
single letters' counts; range searches run per length pair (L, L), (L, L + 1)
and (L, L - 1), enter only boxes that the allowed moves can reach, and the
letter order of the points found decides.

On Spark: the upper levels of the trees are cut from a bounded sample of
words (``SAMPLE_WORDS``; it only balances the work) and send every word to
its own box as a point and to every box in reach as a query.  Boxes are
counted and cut into chunks of at most about ``POINTS`` points by ``QUERIES``
queries, whatever the words are; a task holds one chunk, builds the lower
levels over its points, and returns one row per query that has neighbours:
how many, and the most frequent one.  Chunks of points are disjoint, so the
sums over chunks are exact.  The index covers every word and the boxes are
pruned by exact bounds: no neighbour is lost.

A word's form is its most frequent neighbour if that occurs ``RATIO`` times as
often; roots follow forms to the end by doubling the steps, each round
stored.  Counts grow by the ratio along a chain, so chains are short.

Words are runs of ASCII letters and U+00C0 to U+00FF, so a letter is one byte
of Latin-1.

Cases: null text has no words; a null id counts as the empty text in the
edit's hash; repeated rows count each; ties between forms go to the smallest
word in code-point order; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import lean, text_of

LETTERS = r"[a-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
EDIT_MODULUS = 199             # the runs whose hash it divides lose a letter
SAMPLE_WORDS = 60_000          # words the upper tree levels are cut from, at most
POINTS, QUERIES = 4096, 16_384  # of one task, about
LEAF = 24                      # points of a task's smallest boxes
PAIRS_AT_ONCE = 1 << 22        # numbers compared together, about
WORDS_AT_ONCE = 50_000         # words a task routes together
KINDS = 26 + 64                # letters
_ROUTED = "length int, box int, target boolean, word string, n long"
_FOUND = "word string, n_near long, best_n long, best string"


# ------------------------------------------------------------------- counting
def _deleted(word: Column, doc_id: Column) -> Column:
    """The word without one letter where its hash with the id asks for it."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word), "UTF-8"))
    at = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % EDIT_MODULUS == 0, cut).otherwise(word)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, edit: bool = False) -> DataFrame:
    """``word, n`` of the words of at least these letters and occurrences."""
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.translate(text_of(F.col(f"`{text_col}`")), upper, upper.lower())
    # a run that is too short cannot become longer
    runs = F.regexp_extract_all(lowered, F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("word"))
    if edit:
        words = (words.select(_deleted(F.col("word"), F.col("id")).alias("word"))
                 .where(F.char_length("word") >= least_length))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# ------------------------------------------------------------------ the trees
def _vectors(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, place): the letters as bytes; (word, letter): their counts."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
    counts = np.empty((len(words), KINDS), np.int16 if length < 1 << 15 else np.int32)
    step = max(1, PAIRS_AT_ONCE // max(length, KINDS))
    for lo in range(0, len(words), step):
        # a-z, then U+00C0 to U+00FF
        some = codes[lo:lo + step].astype(np.int64)
        kind = np.where(some < 128, some - 97, some - 192 + 26) + np.arange(len(some))[:, None] * KINDS
        counts[lo:lo + step] = np.bincount(kind.ravel(), minlength=len(some) * KINDS).reshape(-1, KINDS)
    return codes, counts


def _cut(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, value) that halves the points best: counts up to the value go
    left; None where all points are equal."""
    n = len(counts)
    if not n:
        return None
    middle = np.partition(counts, (n - 1) // 2, axis=0)[(n - 1) // 2]
    best = None
    for value in (middle, middle - 1):
        left = (counts <= value).sum(0)
        uneven = np.where((left > 0) & (left < n), np.abs(2 * left - n), n + 1)
        letter = int(uneven.argmin())
        if uneven[letter] <= n and (best is None or uneven[letter] < best[0]):
            best = (int(uneven[letter]), letter, int(value[letter]))
    return best and best[1:]


def build_tree(counts: np.ndarray, most: float) -> list[tuple[int, int, int, int]]:
    """Nodes (letter, value, left, right); a box is (-1, its number, 0, 0).
    Boxes hold at most ``most`` points unless these are equal."""
    nodes: list = [None]
    work, boxes = [(0, np.arange(len(counts)))], 0
    while work:
        at, inside = work.pop()
        cut = _cut(counts[inside]) if len(inside) > most else None
        if cut is None:
            nodes[at] = (-1, boxes, 0, 0)
            boxes += 1
            continue
        left = counts[inside, cut[0]] <= cut[1]
        nodes[at] = (*cut, len(nodes), len(nodes) + 1)
        work += [(len(nodes), inside[left]), (len(nodes) + 1, inside[~left])]
        nodes += [None, None]
    return nodes


def _reach(tree, counts: np.ndarray, up: int, down: int):
    """Yields (box, rows): the boxes each point reaches when its letters'
    counts may rise by ``up`` and fall by ``down`` in all.  Moves along one
    letter add up over the splits, so a box keeps the largest move of each
    letter; what is left of the allowance prunes the branch."""
    rows = np.arange(len(counts))
    work = [(0, rows, {})]
    while work:
        at, inside, moved = work.pop()
        if not len(inside):
            continue
        letter, value, left, right = tree[at]
        if letter < 0:
            yield value, inside
            continue
        have = counts[inside, letter].astype(np.int64)
        for side, need in ((left, np.minimum(value - have, 0)), (right, np.maximum(value + 1 - have, 0))):
            low, high = moved.get(letter, (None, None))
            # the furthest fall and rise that any split on this letter asked for
            fall = -need if low is None else np.maximum(low, -need)
            rise = np.where(need > 0, need, 0) if high is None else np.maximum(high, need)
            fall = np.maximum(fall, 0)
            now = {**moved, letter: (fall, rise)}
            ok = (sum(f for f, _ in now.values()) <= down) & (sum(r for _, r in now.values()) <= up)
            work.append((side, inside[ok], {k: (f[ok], r[ok]) for k, (f, r) in now.items()}))


# how far a query's counts may rise and fall towards points longer by -1, 0, 1
_MOVES = {-1: (0, 1), 0: (1, 1), 1: (1, 0)}


def _together(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _route(trees: dict[int, list]):
    """Each word to its box as a target and to all boxes in reach as a query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, WORDS_AT_ONCE):
            words, ns = table.column(0).combine_chunks(), table.column(1).to_numpy()
            lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                own_words, own_n = words.take(pa.array(at)), ns[at]
                _, counts = _vectors(own_words.to_pylist(), length)
                plan = [(length, True, (0, 0))] + [(length + d, False, move) for d, move in _MOVES.items()]
                for goal, target, (up, down) in plan:
                    for box, rows in _reach(trees[goal], counts, up, down) if goal in trees else ():
                        m = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, goal, np.int32)), pa.array(np.full(m, box, np.int32)),
                             pa.array(np.full(m, target)), own_words.take(pa.array(rows)), pa.array(own_n[rows])],
                            names=["length", "box", "target", "word", "n"])
    return run


# -------------------------------------------------------------------- a task
def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one replaced letter, or one
    inserted letter (``b`` longer by one)."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(1) == 1
    before = (a == b[:, :length]).cumprod(1).sum(1)
    after = (a[:, ::-1] == b[:, ::-1][:, :length]).cumprod(1).sum(1)
    return before + after >= length


def near_pairs(points: tuple, queries: tuple, difference: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) index pairs one edit apart, in blocks; points are longer
    by ``difference`` than the queries."""
    p_codes, p_counts = points
    q_codes, q_counts = queries
    tree = build_tree(p_counts, LEAF)
    at = {box: rows for box, rows in _reach(tree, p_counts, 0, 0)}
    up, down = _MOVES[difference]
    for box, rows in _reach(tree, q_counts, up, down):
        inside = at.get(box)
        if inside is None:
            continue
        step = max(1, PAIRS_AT_ONCE // (len(inside) * p_counts.shape[1]))
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            apart = np.abs(q_counts[some][:, None, :] - p_counts[inside][None, :, :]).sum(2, dtype=np.int32)
            q, p = np.nonzero(apart == up + down)
            q, p = some[q], inside[p]
            a, b = q_codes[q], p_codes[p]
            ok = one_edit(b, a) if difference < 0 else one_edit(a, b)
            yield q[ok], p[ok]


def _search(table: pa.Table) -> pa.Table:
    length = table.column("length")[0].as_py()
    texts = table.column("word").to_pylist()
    words = np.empty(len(texts), object)
    words[:] = texts
    n = table.column("n").to_numpy()
    target = table.column("target").to_numpy(zero_copy_only=False).astype(bool)
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    own = np.flatnonzero(target)
    # most frequent first, then code-point order: the first point found is the best
    # (the bytes of Latin-1 are in code-point order)
    own = own[np.lexsort((np.array([w.encode("latin-1") for w in words[own]], f"S{length}"), -n[own]))]
    sizes = np.array([len(w) for w in texts])
    if len(own):
        points = _vectors(words[own].tolist(), length)
        for difference in _MOVES:
            asked = np.flatnonzero(~target & (sizes == length - difference))
            if not len(asked):
                continue
            near = np.zeros(len(asked), np.int64)
            first = np.full(len(asked), len(own), np.int64)
            for q, p in near_pairs(points, _vectors(words[asked].tolist(), length - difference), difference):
                np.add.at(near, q, 1)
                np.minimum.at(first, q, p)
            hit = np.flatnonzero(near)
            out["word"] += words[asked[hit]].tolist()
            out["n_near"] += near[hit].tolist()
            out["best_n"] += n[own[first[hit]]].tolist()
            out["best"] += words[own[first[hit]]].tolist()
    return pa.table({k: pa.array(v, pa.string() if k in ("word", "best") else pa.int64()) for k, v in out.items()})


def neighbours(words: DataFrame, sample_words: int = SAMPLE_WORDS, points: int = POINTS,
               queries: int = QUERIES) -> DataFrame:
    """``word, n_near, best_n, best`` of the words of (word, n) with a
    neighbour: how many, and the most frequent one (ties: the smallest)."""
    total = words.count()
    # a share of the words by hash, then at most the bound
    picked = [r.word for r in words.where(F.pmod(F.xxhash64("word"), max(1, total // sample_words)) == 0)
              .limit(sample_words).collect()]                  # bounded: it only balances the boxes
    scale = max(1.0, total / max(1, len(picked)))
    by_length: dict[int, list[str]] = {}
    for w in picked:
        by_length.setdefault(len(w), []).append(w)
    trees = {length: build_tree(_vectors(some, length)[1], max(2.0, points / scale))
             for length, some in by_length.items()}
    for r in words.select(F.char_length("word").alias("length")).distinct().collect():   # one row per word length
        trees.setdefault(r.length, [(-1, 0, 0, 0)])
    routed = store(words.select("word", "n").mapInArrow(lean(_route(trees)), _ROUTED))
    # how many chunks a box's points and queries need
    sizes = (routed.groupBy("length", "box").agg(F.count_if("target").alias("p"), F.count_if(~F.col("target")).alias("q"))
             .select("length", "box", F.ceil(F.col("p") / points).cast("int").alias("parts"),
                     F.ceil(F.col("q") / queries).cast("int").alias("asks"))
             .where("parts > 0 and asks > 0"))
    h = F.xxhash64("word")
    dealt = routed.join(sizes, ["length", "box"])
    everywhere = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = (dealt.withColumn("part", F.explode(F.when(F.col("target"), F.array(F.pmod(h, "parts").cast("int")))
                                                .otherwise(everywhere("parts"))))
             .withColumn("ask", F.explode(F.when(F.col("target"), everywhere("asks"))
                                          .otherwise(F.array(F.pmod(h, "asks").cast("int"))))))
    found = (dealt.select("length", "box", "part", "ask", "target", "word", "n")
             .groupBy("length", "box", "part", "ask").applyInArrow(_search, _FOUND))
    # the largest count, then the smallest word
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
            .select("word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.word").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of (word, form): where its chain of forms ends."""
    current = store(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("of"), F.col("root").alias("next"))
        stepped = store(current.join(onward, F.col("root") == F.col("of"), "left")
                        .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        current = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            return current


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, ratio: int = RATIO, edit: bool = False) -> DataFrame:
    """Every word: ``word, form, root, n, n_near, form_n``."""
    words = store(word_counts(docs, id_col, text_col, least_length, least_count, edit))
    near = neighbours(words)
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    formed = store(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(is_form, F.col("best")).alias("form"),
                                 F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return (formed.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
