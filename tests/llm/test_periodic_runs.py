import hashlib
import random
import time
import zlib

import numpy as np
from odd import ROWS, SF, odd_docs, table, text_of

from loanlens.llm import periodic_runs as pr


def brute(words, least=12):
    """Every stretch of agreement at every lag, kept where its smallest period is the lag."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(least, 2 * q) and not any(
                    part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted((s, m, q) for s, m, q in out)


def brute_words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


def brute_row(doc_id, text, edit=True):
    w = brute_words(text)
    if edit and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(keep)))


def found(words, least=12):
    return pr.find_runs(pr.word_ids(list(words)), least)


def test_runs_of_random_and_repetitive_texts():
    rng = random.Random(5)
    for trial in range(1500):
        n, letters = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5])
        kind = trial % 4
        if kind == 0:
            w = [rng.randrange(letters) for _ in range(n)]
        elif kind == 1:                       # lines dealt anew from a few
            lines = [[rng.randrange(letters) for _ in range(rng.randint(1, 9))] for _ in range(3)]
            w = sum((rng.choice(lines) for _ in range(12)), [])
        elif kind == 2:                       # repeats of a block that itself repeats
            block = [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 4)
            block += [rng.randrange(letters) for _ in range(rng.randint(0, 3))]
            w = [9] * rng.randint(0, 2) + block * rng.randint(2, 4) + [rng.randrange(letters) for _ in range(5)]
        else:                                 # one changed word in a periodic text
            p = rng.randint(1, 20)
            block = [rng.randrange(letters) for _ in range(p)]
            w = (block * 90)[:n]
            if w:
                w[rng.randrange(len(w))] = 7
        assert found(map(str, w)) == brute(w), w
        assert found(map(str, w), 6) == brute(w, 6), w


def test_every_gram_of_a_block_occurs_twice():
    """Nearer occurrences of each seed inside the block do not hide its period."""
    rng = random.Random(8)
    for _ in range(40):
        line = [rng.randrange(3) for _ in range(8)]
        block = line * 2 + [5] + line + [6] + line * 2 + [6] + line + [5]
        w = block * 3 + line
        assert found(map(str, w)) == brute(w)


def test_long_repetitive_texts_take_linear_pairs():
    n = 60_000
    begin = time.time()
    assert found(["a"] * n) == [(0, n, 1)]
    rng = random.Random(1)
    line = [f"w{i}" for i in range(10)]
    w = sum((line if rng.random() < 0.7 else [f"x{i}"] for i in range(n // 10)), [])
    runs = found(w)
    assert runs and all(w[s:s + m - q] == w[s + q:s + m] and m >= max(12, 2 * q) for s, m, q in runs)
    assert time.time() - begin < 60
    total = sum(len(pr._pairs(names, size, 1 if size == 6 else size, 2 * size)[0])
                for size, names in pr._grams(np.zeros(n, np.int64), 12))
    assert total < 40 * n


def test_rows_against_brute_force(spark):
    rows = [r for r in ROWS if len(text_of(r)) < 5000]
    got = sorted((tuple(r) for r in pr.run_digests(odd_docs(spark, rows)).collect()), key=str)
    assert got == sorted((brute_row(r[0], text_of(r)) for r in rows), key=str)
    assert pr.run_digests(odd_docs(spark)).count() == len(ROWS)
    assert pr.run_digests(odd_docs(spark, [])).collect() == []


def test_given_documents(spark):
    docs = table(spark, "documents")
    short = [r for r in docs.collect() if len(text_of((0, r.text))) < 2500]
    got = {r.doc_id: tuple(r) for r in pr.run_digests(docs).collect()}
    assert len(got) == docs.count() and any(r[1] for r in got.values())
    for r in short:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text or "")


def test_operator_returns_runs_and_text(spark):
    text = "start " + "one two three " * 5 + "end\tof  text"
    docs = spark.createDataFrame([(7, text)], "key long, words string")
    row = pr.runs(docs, "key", "words").first()
    assert [tuple(r) for r in row.runs] == [(1, 15, 3)]
    assert row.collapsed == "start one two three end of text"
    assert (row.start, row.length, row.period, row.exponent_milli) == (1, 15, 3, 5000)


def test_query_reads_the_whole_table(spark):
    from loanlens.llm.queries import QUERIES
    df = QUERIES["op12_periodic_runs"](spark, SF)
    assert df.columns[0] == "doc_id" and df.count() == table(spark, "documents").count()
