import heapq
import random
import re
from collections import defaultdict
from fractions import Fraction

from odd import ROWS, odd_docs, table, text_of
from pyspark.sql import functions as F

from loanlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, free, fixed = Fraction(sum(sizes.values())), set(names), {}
    while free:
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**fixed, **share}
        fixed |= {s: Fraction(most * sizes[s]) for s in over}
        free -= over
    return fixed


def test_targets_against_brute_force(spark):
    rng = random.Random(3)
    for sizes in ({"a": 10, "b": 1000, "c": 1000, "ä": 5, None: 700, "d": 0}, {"x": 5}, {"x": 0, "y": 0},
                  {f"s{i}": rng.choice([1, 10, 100, 10_000]) for i in range(40)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - float(want[s])) <= 1e-9 * max(1.0, float(want[s]))


def test_sainte_lague_against_a_heap(spark):
    rng = random.Random(8)
    groups = {0: (100, [rng.randint(0, 1000) for _ in range(30)]), 1: (7, [53, 24, 23]), 2: (0, [5, 6]),
              3: (50, [10, 10, 10, 10]), 4: (1000, [1, 1_000_000]), 5: (3, [1] * 40)}
    rows = [(g, k, float(v), n) for g, (n, votes) in groups.items() for k, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, k int, v double, n long")
    got = {(r.g, r.k): r.quota for r in mixing.sainte_lague(df, "g", "k", "v", "n").collect()}
    for g, (n, votes) in groups.items():
        seats = defaultdict(int)
        queue = [(-v, k) for k, v in enumerate(votes) if v]
        heapq.heapify(queue)
        for _ in range(n):
            _, k = heapq.heappop(queue)
            seats[k] += 1
            heapq.heappush(queue, (-votes[k] / (2 * seats[k] + 1), k))
        assert {k: got[g, k] for k in range(len(votes))} == {k: seats[k] for k in range(len(votes))}, g


def check_mix(rows, sizes_of, block=mixing.BLOCK):
    by_source = defaultdict(list)
    for r in rows:
        assert r.taken <= 3 * r["size"] and r.taken >= 0
        spans = [(s.start, s.stop) for s in r.spans]
        assert all(0 <= a < b <= r["size"] for a, b in spans)
        assert sum(b - a for a, b in spans) + r.passes * r["size"] == r.taken
        by_source[r.source].append(r)
    want = brute_targets(sizes_of)
    for source, own in by_source.items():
        assert {r.source_size for r in own} == {sizes_of[source]}
        assert abs(own[0].target - float(want[source])) < 1e-6 * max(1, float(want[source]))
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 * block


def test_mix_of_odd_documents(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(text_of(r)))
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted(
        (r[0] or -1, len(WORD.findall(text_of(r)))) for r in ROWS)
    check_mix(got, sizes)


def test_mix_of_documents_in_many_shards(spark):
    docs = table(spark, "documents")
    options = {"shard_words": 3000, "block": 8}
    got = mixing.mix(docs, **options).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    by_source = defaultdict(int)
    for r in got:
        by_source[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    targets = {r.source: r.target for r in got}
    for s, taken in by_source.items():
        assert abs(taken - targets[s]) <= 8 * 3 + 0.01 * targets[s]
    again = mixing.mix(docs.repartition(7), **options).collect()
    assert sorted((r.doc_id, r.taken, str(r.spans)) for r in got) == sorted(
        (r.doc_id, r.taken, str(r.spans)) for r in again)


def test_materialised_words_are_those_taken(spark):
    docs = odd_docs(spark)
    plan = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {r.source: r.taken for r in plan if r.taken} == dict(words)


def test_empty_table(spark):
    docs = odd_docs(spark, [])
    assert mixing.mix(docs).collect() == []
    assert mixing.materialise(docs).collect() == []
