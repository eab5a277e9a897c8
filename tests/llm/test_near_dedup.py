import random

import numpy as np
from odd import ROWS, odd_docs, table, text_of

from loanlens.llm import linking, near_dedup
from loanlens.session import store


def payloads_of(texts):
    tokens, weights, bounds = near_dedup.shingles(texts)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        t = tokens[a:b].view(np.int64)
        order = np.argsort(t)
        out.append((t[order], weights[a:b][order]))
    return out


def brute_classes(texts, threshold=0.8):
    """Class number of each text: components over all pairs."""
    with np.errstate(over="ignore"):
        payloads = payloads_of(texts)
    sets = [frozenset(p[0].tolist()) for p in payloads]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and sets[i] & sets[j] and (
                    sets[i] == sets[j] or linking.similarity(*payloads[i], *payloads[j]) >= threshold):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def named(ids, classes):
    """id -> set of ids that share its class."""
    groups = {}
    for i, c in zip(ids, classes):
        groups.setdefault(c, []).append(i)
    return {i: min(groups[c]) for i, c in zip(ids, classes)}


def test_probability_jaccard_against_the_double_sum():
    rng = np.random.default_rng(7)
    for _ in range(50):
        ta, tb = (np.sort(rng.choice(30, rng.integers(1, 25), replace=False)) for _ in range(2))
        wa, wb = rng.random(len(ta)) + 0.1, rng.random(len(tb)) + 0.1
        a, b = dict(zip(ta, wa)), dict(zip(tb, wb))
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
                   for i in a.keys() & b.keys())
        assert abs(linking.probability_jaccard(ta, wa, tb, wb) - want) < 1e-9


def test_registers_agree_with_the_probability_jaccard():
    rng = np.random.default_rng(3)
    with np.errstate(over="ignore"):
        base = rng.integers(1, 1 << 62, 60).astype(np.uint64)
        for share in (0.9, 0.5, 0.2):
            keep = int(60 * share)
            a = np.sort(base)
            b = np.sort(np.concatenate([base[:keep], rng.integers(1, 1 << 62, 60 - keep).astype(np.uint64)]))
            wa, wb = (rng.integers(1, 5, 60).astype(np.float32) for _ in range(2))
            signature = near_dedup.prob_min_hash(np.concatenate([a, b]), np.concatenate([wa, wb]),
                                                 np.array([0, 60, 120]), 4000)
            want = linking.probability_jaccard(a, wa, b, wb)
            assert abs((signature[0] == signature[1]).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5 + 0.005


def test_documents_against_brute_force(spark):
    rows = table(spark, "documents").collect()
    got = {r.doc_id: r for r in near_dedup.classes(table(spark, "documents")).collect()}
    want = named([r.doc_id for r in rows], brute_classes([r.text for r in rows]))
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def repeated_line(seed):
    """A text, and the same text with a line repeated: the plain index is over
    0.8, the weighted one near 0.5."""
    base = [f"t{seed}_{i}" for i in range(90)]
    line = [f"r{seed}_{i}" for i in range(12)]
    return [" ".join(base), " ".join(base + line * 50)]


def test_pairs_alike_by_the_plain_index_only_share_a_band(spark):
    texts = [t for seed in range(60) for t in repeated_line(seed)]
    with np.errstate(over="ignore"):
        (ta, wa), (tb, wb) = payloads_of(texts[:2])
    common = len(np.intersect1d(ta, tb))
    assert common / (len(ta) + len(tb) - common) >= 0.8 and linking.probability_jaccard(ta, wa, tb, wb) < 0.6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_band_keys_of_weighted_and_plain_sets():
    texts = ["", "one two three four five six seven", "a b c d e f a b c d e f", repeated_line(0)[1]]
    with np.errstate(over="ignore"):
        tokens, weights, bounds = near_dedup.shingles(texts)
        keys, at = near_dedup._bands(tokens, weights, bounds, 25, 5)
    own = [keys[a:b].tolist() for a, b in zip(at, at[1:])]
    assert all(len(set(k)) == len(k) for k in own)                # a bucket lists a text once
    assert len(own[0]) == 0 and len(own[1]) == 25                # all weights equal: the sets agree
    assert len(own[3]) > 25


def family(n, words=60, seed=4, edits=6):
    """Copies of one text with a few words replaced, alone at random places."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    texts = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"x{k}_{rng.randrange(1000)}"
        texts.append(" ".join(own))
    return texts


def test_a_large_group_of_near_copies_in_small_chunks(spark):
    texts = family(150, edits=3) + [f"other text number {i} says nothing like it at all {i}" for i in range(20)]
    with np.errstate(over="ignore"):
        payloads = payloads_of(texts)
    nodes = [i.to_bytes(16, "big") for i in range(len(texts))]
    # every text in one bucket: the components of all pairs must come out
    shared = store(spark.createDataFrame([(1, n, len(p[0])) for n, p in zip(nodes, payloads)],
                                         "bucket long, node binary, tokens_n long"))
    given = store(spark.createDataFrame([(n, p[0].tolist(), [float(w) for w in p[1]]) for n, p in zip(nodes, payloads)],
                                        "node binary, tokens array<long>, weights array<float>"))
    want = brute_classes(texts)
    assert len(set(want)) > 22                       # some edited copies link to no other
    for chunk in (1 << 18, 500):
        linked = {bytes(r["node"]): bytes(r["class"])
                  for r in linking.link(shared, given, 0.8, chunk_tokens=chunk).collect()}
        got = [int.from_bytes(linked.get(n, n), "big") for n in nodes]
        groups = lambda c: sorted(sorted(i for i, x in enumerate(c) if x == k) for k in set(c))
        assert groups(got) == groups(want)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    node = lambda i: i.to_bytes(16, "big")
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (200, 300), (7, 7)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(node(a), node(b)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["class"], "big") for r in linking.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert linking.components(df.where("false")).collect() == []


def test_odd_documents(spark):
    got = near_dedup.classes(odd_docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    cat = [r for r in got if r.class_size == 4]
    assert sorted(str(r.doc_id) for r in cat) == ["1", "2", "2", "None"] and {r.class_id for r in cat} == {1}
    assert all(r.class_id == r.doc_id for r in got if r.class_size == 1)
    kept = near_dedup.survivors(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert {text_of((r.doc_id, r.text)) for r in kept.collect()} == {text_of(r) for r in ROWS}
    assert near_dedup.classes(odd_docs(spark, [])).collect() == []
    assert near_dedup.survivors(odd_docs(spark, [])).collect() == []


def test_equal_texts_without_words_share_a_class(spark):
    texts = {1: "", 2: None, 3: "...", 4: "...", 5: "?!", 6: "", None: "...", 7: "word", 8: "word"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.classes(docs).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 6: (1, 3), 3: (3, 3), 4: (3, 3), None: (3, 3), 5: (5, 1), 7: (7, 2), 8: (7, 2)}
    assert sorted(r.doc_id for r in near_dedup.survivors(docs).collect()) == [1, 3, 5, 7]


def test_an_id_on_several_rows_is_decided_by_each_text(spark):
    """Id 5 stands on a near copy of document 1 and on a text of its own."""
    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i}" for i in range(60))
    last = " ".join(f"item{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (5, base + " more"), (5, other), (7, last + " x"), (7, last)],
                                 "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.class_size, r.kept) for r in near_dedup.classes(docs).collect())
    assert got[0] == (1, 1, 2, True) and got[1:3] == [(5, 1, 2, False), (5, 5, 1, True)]
    assert sorted(r[3] for r in got[3:]) == [False, True]
    kept = sorted((r.doc_id, r.text) for r in near_dedup.survivors(docs).collect())
    assert kept[:2] == [(1, base), (5, other)] and len(kept) == 3 and kept[2][0] == 7
