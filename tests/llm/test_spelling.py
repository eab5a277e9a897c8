import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from odd import ROWS, SF, odd_docs, table, text_of

from loanlens.llm import spelling as sp


def brute_counts(rows, edit=True, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if edit and h % 199 == 0:
                i = h % len(word)
                word = word[:i] + word[i + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def brute_near(counts):
    """Neighbours share a word with one letter deleted (at one place)."""
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for w in counts:
        for i in range(len(w)):
            v = w[:i] + w[i + 1:]
            if v in counts:
                near[w].add(v)
                near[v].add(w)
    return near


def brute_rows(counts, ratio=5):
    near = brute_near(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def some_words(rng, count):
    """Words with many neighbours, anagrams and repeats of letters."""
    stems = ["".join(rng.choices("abcdeéÿ", k=rng.randint(6, 9))) for _ in range(count // 8)]
    words = set(stems)
    while len(words) < count:
        w = list(rng.choice(stems))
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0:
                w[i] = rng.choice("abcdeéÿ")
            elif kind == 1:
                w.insert(i, rng.choice("abcdeéÿ"))
            elif kind == 2 and len(w) > 6:
                del w[i]
            else:
                rng.shuffle(w)
        words.add("".join(w))
    return sorted(words)


def test_counts_and_rows_against_brute_force(spark):
    rng = random.Random(3)
    words = some_words(rng, 250)
    weight = [rng.choice([1, 1, 2, 12, 80]) for _ in words]
    docs = [(i, " ".join(rng.choices(words, weight, k=120))) for i in range(120)] + [(None, "Straße straße ÀÉÎabc")] * 6
    docs.append((500, "chainaa " * 5 + "chainab " * 30 + "chainbb " * 200))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for edit in (True, False):
        counts = brute_counts(docs, edit)
        want = brute_rows(counts)
        assert got(sp.variants(df, edit=edit)) == want
        assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)


def test_small_boxes_and_chunks_lose_no_neighbour(spark):
    rng = random.Random(9)
    # many words of equal letter counts: boxes that cannot be split
    anagrams = {"".join(rng.sample("abcdefgh", 8)) for _ in range(150)}
    words = {w: rng.randint(5, 400) for w in set(some_words(rng, 400)) | anagrams}
    near = brute_near(words)
    want = {w: (len(vs), min(vs, key=lambda v: (-words[v], v))) for w, vs in near.items() if vs}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for sample, points, queries in ((60_000, 16, 40), (50, 8, 8), (60_000, 4096, 4096)):
        rows = sp.neighbours(df, sample, points, queries).collect()
        assert {r.word: (r.n_near, r.best) for r in rows} == want
        assert all(r.best_n == words[r.best] for r in rows)


def test_boxes_in_reach_hold_every_near_point():
    rng = random.Random(4)
    words = [w for w in some_words(rng, 300) if len(w) == 7]
    _, counts = sp._vectors(words, 7)
    tree = sp.build_tree(counts, 6)
    box_of = {int(i): box for box, rows in sp._reach(tree, counts, 0, 0) for i in rows}
    assert sorted(box_of) == list(range(len(words)))
    reached = defaultdict(set)
    for box, rows in sp._reach(tree, counts, 1, 1):
        for i in rows:
            reached[int(i)].add(box)
    pairs = 0
    for i in range(len(words)):
        for j in range(len(words)):
            if np.abs(counts[i].astype(int) - counts[j]).sum() == 2:
                assert box_of[j] in reached[i]
                pairs += 1
    assert pairs > 50 and np.mean([len(r) for r in reached.values()]) < len(set(box_of.values()))


def test_chains_reach_their_end(spark):
    chain = [("w%d" % i, "w%d" % (i + 1)) for i in range(13)]
    rows = sp.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.word: r.root for r in rows} == {w: "w13" for w, _ in chain}


def test_very_long_words(spark):
    long = "ab" * 40_000
    df = spark.createDataFrame([(long, 50), (long + "c", 5), (long[:-1] + "z", 5), ("abcdef", 9)], "word string, n long")
    assert {r.word: (r.n_near, r.best) for r in sp.neighbours(df).collect()} == {
        long: (2, long + "c") if long + "c" < long[:-1] + "z" else (2, long[:-1] + "z"),
        long + "c": (1, long), long[:-1] + "z": (1, long)}


def test_awkward_and_empty_tables(spark):
    docs = odd_docs(spark)
    assert got(sp.variants(docs, edit=True)) == brute_rows(brute_counts([(r[0], text_of(r)) for r in ROWS]))
    assert got(sp.variants(odd_docs(spark, []), edit=True)) == []


def test_query_against_brute_force(spark):
    from loanlens.llm.queries import QUERIES
    sf = SF.replace("0.001", "0.01")
    counts = brute_counts([(r.doc_id, r.text or "") for r in table(spark, "documents", sf).collect()])
    want = brute_rows(counts)
    assert any(r[1] for r in want)
    assert got(QUERIES["op11_spelling_variants"](spark, sf)) == want
