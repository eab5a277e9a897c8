import hashlib

import numpy as np
from odd import ROWS, odd_docs, table, text_of

from loanlens.llm import spotsigs
from loanlens.llm.hashing import WORD, word_hashes


def brute(rows):
    """Per row of (id, text) in descending order of id, nulls last: its edited text and the next text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, r in enumerate(order):
        own, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(own) // 3
        edited = own[:len(own) - cut] + following[:cut]
        sets = [set(spotsigs.signatures(t).tolist()) for t in (own, edited, following)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((r[0], len(own), hashlib.sha256(edited.encode()).hexdigest(),
                    "".join(f"{x:08x}" for x in sorted(sets[0])), "".join(f"{x:08x}" for x in sorted(sets[1])),
                    round(like(sets[0], sets[1]), 12), round(like(sets[0], sets[2]), 12)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                    round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect()), key=str)


def test_signatures_are_chains_after_common_words():
    a = spotsigs.signatures("The quick fox is on a high fence")
    assert len(a) == 5                                # after the start, the, is, on, a
    assert len(spotsigs.signatures("")) == len(spotsigs.signatures("!!!")) == 0
    assert len(spotsigs.signatures("lonely")) == 1
    same = spotsigs.signatures("the QUICK, fox. Is on; a high fence?")
    assert (same == a).all()
    moved = spotsigs.signatures("Zebra the quick fox is on a high fence")
    assert len(np.intersect1d(a, moved)) >= 3


def naive(text):
    """The anchor and its next content words, one by one."""
    words = WORD.findall(text.lower())
    drawn = lambda w: int(word_hashes([w])[0]) % spotsigs.DRAWN_EVERY == 0
    anchors = [w in spotsigs.ANCHORS or drawn(w) for w in words]
    found = set()
    for i in range(-1, len(words)):
        if i < 0 or anchors[i]:
            chain = [w for w, a in zip(words[i + 1:], anchors[i + 1:]) if not a][:spotsigs.CHAIN]
            if chain or (words and all(anchors)):            # a text of anchors alone keeps them
                found.add((words[i] if i >= 0 else None, *chain))
    return found


def test_signatures_against_naive_chains(spark):
    for r in table(spark, "documents").collect():
        text = r.text or ""
        if len(text) < 20_000:
            assert len(spotsigs.signatures(text)) == len(naive(text)), r.doc_id


def test_texts_without_listed_anchors_take_part_as_a_whole():
    words = [f"w{i}x" for i in range(400)]
    own = spotsigs.signatures(" ".join(words))
    assert len(own) >= 10
    other = spotsigs.signatures(" ".join(words[:40] + [f"v{i}y" for i in range(360)]))
    assert spotsigs.likeness(own, other) < 0.3
    near = spotsigs.signatures(" ".join([*words[:200], "new", *words[200:]]))
    assert spotsigs.likeness(own, near) > 0.8


def test_edited_likeness_against_brute_force(spark):
    for slices in (1, 3, None):
        assert got(spotsigs.edited_likeness(odd_docs(spark), slices=slices)) == brute(ROWS)
    docs = table(spark, "documents")
    assert got(spotsigs.edited_likeness(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(spotsigs.edited_likeness(odd_docs(spark, ROWS[:1]))) == brute(ROWS[:1])
    nulls = [r for r in ROWS if r[0] is None]
    assert got(spotsigs.edited_likeness(odd_docs(spark, nulls))) == brute(nulls)
    assert spotsigs.edited_likeness(odd_docs(spark, [])).collect() == []


def test_likeness_tells_edits_from_other_documents(spark):
    rows = spotsigs.edited_likeness(table(spark, "documents")).where("n_signatures >= 20").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.3
    assert np.mean([r.near_next for r in rows]) < 0.05


def test_classes_against_brute_force(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    rows = docs.collect()
    for threshold in (0.8, 0.4):
        sets = [frozenset(spotsigs.signatures(r.text or "").tolist()) for r in rows]
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                common = len(sets[i] & sets[j])
                if sets[i] == sets[j] or common >= threshold * len(sets[i] | sets[j]):
                    root[max(find(i), find(j))] = min(find(i), find(j))
        groups = {}
        for i, r in enumerate(rows):
            groups.setdefault(find(i), []).append(r.doc_id)
        want = {d: min(g) for g in groups.values() for d in g}
        found = {r.doc_id: r.class_id for r in spotsigs.classes(docs, threshold=threshold).collect()}
        assert found == want
    odd = {(r.doc_id, r.class_id) for r in spotsigs.classes(odd_docs(spark)).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 3), (10, 10)} <= odd
    assert spotsigs.classes(odd_docs(spark, [])).collect() == []
