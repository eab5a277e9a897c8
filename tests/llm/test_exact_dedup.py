import hashlib
from collections import defaultdict

from odd import ROWS, odd_docs, text_of
from pyspark.sql import functions as F

from loanlens.llm import exact_dedup


def brute(rows, last):
    groups = defaultdict(list)
    for r in rows:
        groups[text_of(r)].append(r[0])
    out = []
    for r in rows:
        ids = groups[text_of(r)]
        known = [i for i in ids if i is not None]
        keep = (max if last else min)(known) if known else None
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(text_of(r).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_classes_against_brute_force(spark):
    for keep in ("first", "last"):
        assert got(exact_dedup.classes(odd_docs(spark), keep=keep)) == brute(ROWS, keep == "last")


def test_collisions_are_told_apart_by_bytes(spark):
    weak = lambda c: F.unhex(F.lpad(F.hex(F.char_length(c) % 3), 4, "0"))
    assert got(exact_dedup.classes(odd_docs(spark), keep="last", hash_of=weak)) == brute(ROWS, True)


def test_survivors_keep_columns_and_one_row_per_text(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.survivors(docs, keep="last")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({text_of(r) for r in ROWS})
    best = {text: max((i for i, t, *_ in ROWS if (t or "") == text and i is not None), default=None)
            for text in {text_of(r) for r in ROWS}}
    assert {(r.text or ""): r.doc_id for r in rows} == best
    assert next(r for r in rows if r.doc_id == 4).text == ""
    first = exact_dedup.survivors(docs, keep="first").collect()
    assert next(r for r in first if (r.text or "") == "").doc_id == 3
    assert next(r for r in first if (r.text or "") == "").text is None


def test_empty_table(spark):
    docs = odd_docs(spark, [])
    assert exact_dedup.classes(docs).collect() == []
    assert exact_dedup.survivors(docs).collect() == []
