import glob
import hashlib
import zlib

import numpy as np
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import LONG, ROWS, odd_docs, table, text_of
from tokenizers import Tokenizer

from loanlens.llm import bpe, token_output
from loanlens.llm.queries import TOKENIZER

LIBRARY = Tokenizer.from_file(TOKENIZER)
OWN = bpe.Bpe.load(TOKENIZER)
ENCODER = token_output.PieceEncoder.load(TOKENIZER)
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                           0x202F, 0x205F, 0x3000, 0x180E, 0x200B, 0xFEFF, 0x7F, 0x1B]))
TRICKY = ["", " ", "ΑΣ ΣΑΣ Σ", "İstanbul I ı", "é ́ ą́", "don't DON'T 's'll", "ǅ ﬃ ß ẞ", "½²Ⅷ٣",
          "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "x".join(SPACES), "日本語 テスト", "😀👨‍👩‍👧", "a" * 3000,
          "̸= K Å", "_a_b_ 12,345.6", "naïve­co­op", LONG]


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts_equal_the_library(text):
    ids, decoded = expected(text)
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == decoded
    assert OWN.round_trip(text) == (" ".join(map(str, ids)), decoded)
    assert ENCODER.encode([text])[0].tolist() == ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cn")), max_size=40)
                | st.text("aAeEéÉsStT'’ \n.,!?-09<|>", max_size=60), max_size=5))
def test_any_text_equals_the_library(texts):
    got = ENCODER.encode(texts)
    for text, ids in zip(texts, got):
        want, decoded = expected(text)
        assert OWN.encode(text) == want and ids.tolist() == want
        assert OWN.round_trip(text)[1] == decoded


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=4))
def test_token_files_follow_the_library_on_unassigned_code_points(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in [*texts, "a\u1c89a \U00010d50"]]
    assert [i.tolist() for i in ENCODER.encode(texts)] == [expected(t)[0] for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    encoder, own = token_output.PieceEncoder(TOKENIZER), bpe.Bpe(TOKENIZER)
    for text in [t for t in TRICKY if len(t) < 500] * 2:
        ids, _ = expected(text)
        assert encoder.encode([text])[0].tolist() == ids and own.encode(text) == ids


def digest_rows(rows):
    out = []
    for r in rows:
        ids, decoded = expected(text_of(r))
        out.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip_of_tables(spark):
    assert sorted((tuple(r) for r in bpe.round_trip_digests(odd_docs(spark), TOKENIZER).collect()),
                  key=str) == digest_rows(ROWS)
    docs = table(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in bpe.round_trip_digests(docs, TOKENIZER).collect()), key=str) == digest_rows(rows)
    assert bpe.round_trip_digests(odd_docs(spark, []), TOKENIZER).collect() == []


def test_encode_then_decode(spark):
    tokens = bpe.encode(odd_docs(spark), TOKENIZER)
    got = sorted(((r.doc_id, r.text) for r in bpe.decode(tokens, TOKENIZER).collect()), key=str)
    assert got == sorted(((r[0], expected(text_of(r))[1]) for r in ROWS), key=str)


def check_files(spark, docs, rows, folder, **options):
    token_output.write_tokens(docs, folder, TOKENIZER, **options)
    got = token_output.digest(token_output.read_tokens(spark, folder)).collect()
    got = sorted(got, key=lambda r: (r.part, r.pos))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_of(r).encode()))
    start = 0
    assert len(got) == len(ordered)
    for r, (doc_id, text, *_) in zip(got, ordered):
        ids = expected(text or "")[0] + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_orc_files(spark, tmp_path):
    check_files(spark, odd_docs(spark), ROWS, str(tmp_path / "odd"), files=3)
    docs = table(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    folder = str(tmp_path / "docs")
    check_files(spark, docs, rows, folder, files=2, stripe_bytes=1 << 14, row_index_stride=1000)
    files = sorted(glob.glob(f"{folder}/*.orc"))
    assert len(files) == 2
    ids = []
    for f in files:
        orc = pyarrow.orc.ORCFile(f)
        assert orc.nstripes >= 1
        ids += orc.read(columns=["doc_id"]).column("doc_id").to_pylist()
    assert ids == sorted(ids)                              # files in name order hold ascending ids
    assert b"ORC" == open(files[0], "rb").read(3)
    pruned = token_output.read_tokens(spark, folder).where("doc_id = 7")
    assert "doc_id" in pruned._jdf.queryExecution().toString().split("PushedFilters")[1][:60]
    assert [r.doc_id for r in pruned.collect()] == [7]


def test_rows_of_one_id_are_parted_among_files(spark, tmp_path):
    rows = [(None if i % 2 else 7, f"{i * 7919 % 4000} a text of its own", "en", "a") for i in range(4000)]
    folder = str(tmp_path / "null")
    check_files(spark, odd_docs(spark, rows), rows, folder, files=8)
    sizes = [r["count"] for r in token_output.read_tokens(spark, folder).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_a_filter_on_ids_skips_row_groups(spark, tmp_path):
    folder = str(tmp_path / "groups")
    docs = spark.createDataFrame([(i * 2, f"text {i}") for i in range(40_000)], "doc_id long, text string")
    token_output.write_tokens(docs, folder, TOKENIZER, files=2, row_index_stride=1000)
    for doc_id, found in ((31_000, 1), (31_001, 0)):           # by the index; by the Bloom filter
        one = token_output.read_tokens(spark, folder).where(f"doc_id = {doc_id}")
        assert len(one.collect()) == found
        scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.metrics().apply("numOutputRows").value() <= 1000 * found


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    token_output.write_tokens(odd_docs(spark, []), folder, TOKENIZER)
    assert token_output.digest(token_output.read_tokens(spark, folder)).collect() == []


def test_a_word_is_numbered_by_its_lookup_and_learned_once(monkeypatch):
    encoder, learned = token_output.PieceEncoder(TOKENIZER), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learned.extend(words), learn(words)))
    for texts in ([*TRICKY, *TRICKY, "one two one"], [], ["two three one", *TRICKY]):
        ids, bounds = encoder.encode_joined(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [expected(t)[0] for t in texts]
        assert list(encoder.number.values()) == list(range(encoder.ids.count))
    assert len(learned) == len(set(learned)) == len(encoder.number)
    assert learned[-1] == "three"
    monkeypatch.setattr(encoder, "_learn", lambda words: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        encoder.encode_joined(["four"])
    monkeypatch.setattr(encoder, "_learn", learn)
    assert encoder.encode(["four one"])[0].tolist() == expected("four one")[0]
