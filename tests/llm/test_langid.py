import zlib

import numpy as np
from odd import ROWS, odd_docs, table, text_of
from pyspark.sql import functions as F

from loanlens.llm import langid
from loanlens.llm.queries import op4_language_id


def windows_of(texts, per=6):
    out, rng = [], np.random.default_rng(5)
    for t in texts:
        raw = t.encode()
        for at in rng.integers(0, max(0, len(raw) - langid.WINDOW) + 1, per):
            out.append(raw[at:at + langid.WINDOW].ljust(langid.WINDOW, b"\0"))
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, langid.WINDOW)


def test_gradients_against_differences():
    model = langid.BidirectionalGru.start(["a", "b", "c"], hidden=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = np.random.default_rng(1).integers(90, 110, (9, 5)).astype(np.uint8)
    y = np.array([0, 1, 2, 1, 0])
    _, grads = model.loss_and_gradients(x, y)
    for name, g in grads.items():
        w = model.weights[name]
        for at in [np.unravel_index(i, w.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            w[at] += 1e-5
            above, _ = model.loss_and_gradients(x, y)
            w[at] -= 2e-5
            below, _ = model.loss_and_gradients(x, y)
            w[at] += 1e-5
            assert abs((above - below) / 2e-5 - g[at]) < 1e-6


def naive_positions(model, data):
    """The network written out byte by byte, one unit at a time."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    hidden = model.weights["forward_u"].shape[1]

    def states(way, order):
        table, u = model.weights[f"{way}_table"], model.weights[f"{way}_u"]
        h, out = [0.0] * hidden, {}
        for t in order:
            given = [float(table[k, data[t]]) for k in range(3 * hidden)]
            back = [sum(float(u[k, j]) * h[j] for j in range(hidden)) for k in range(3 * hidden)]
            new = []
            for j in range(hidden):
                update, reset = sigmoid(given[j] + back[j]), sigmoid(given[hidden + j] + back[hidden + j])
                candidate = np.tanh(given[2 * hidden + j] + reset * back[2 * hidden + j])
                new.append((1 - update) * candidate + update * h[j])
            h = out[t] = new
        return out

    forward, backward = states("forward", range(len(data))), states("backward", range(len(data) - 1, -1, -1))
    rows = []
    for t in range(len(data)):
        z = [sum(float(w) * x for w, x in zip(row, forward[t] + backward[t])) + float(b)
             for row, b in zip(model.weights["out"], model.weights["bias"][:, 0])]
        e = np.exp(np.array(z) - max(z))
        rows.append(e / e.sum())
    return np.array(rows)


def test_forward_pass_against_a_naive_one():
    model = langid.BidirectionalGru.start(["a", "b", "c"], hidden=5)
    rng = np.random.default_rng(3)
    for way in ("forward", "backward"):
        model.weights[f"{way}_u"] = rng.normal(0, 1, (15, 5)).astype(np.float32)
    model.weights["bias"] = rng.normal(0, 1, (3, 1)).astype(np.float32)
    for text in ("x", "Grüße, 12 cats!", "q" * langid.WINDOW, "ein Fenster " * 5):
        raw = text.encode()
        assert len(raw) <= langid.WINDOW
        want = naive_positions(model, raw)
        x, _, _ = langid._windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if len(raw) == langid.WINDOW:                       # a full window: every position
            assert np.allclose(model.label_positions(text), want, atol=1e-5)
            letters = [t for t, c in enumerate(raw) if langid._LETTER[c]]
            pooled = model.pooled(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
            assert np.allclose(pooled, want[letters].mean(0), atol=1e-5)
        padded = raw + bytes(x.shape[1] - len(raw))         # windows are filled up with zero bytes
        assert np.allclose(model.label_positions(text), naive_positions(model, padded)[:len(raw)], atol=1e-5)


def test_windows_cover_every_byte():
    texts = [b"", b"a" * 5, b"b" * 64, b"c" * 65, b"", b"d" * 200]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, of, used = langid._windows(np.frombuffer(b"".join(texts), np.uint8), bounds)
    for i, t in enumerate(texts):
        got = b"".join(bytes(row[:n]) for row, n in zip(x[of == i], used[of == i]))
        assert got == t


def test_pooling_does_not_depend_on_the_batch():
    model = langid.BidirectionalGru.start(["a", "b"])
    texts = ["hello there", "x" * 300, "", "¿qué?", "... 12"]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    together = model.pooled(np.frombuffer(b"".join(raw), np.uint8), bounds)
    for i, r in enumerate(raw):
        alone = model.pooled(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(together[i], alone[0], atol=1e-5)
    assert (together[2] == 0).all() and (together[4] == 0).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op4_language_id(spark, sf).collect()}
    rows = table(spark, "documents", sf).collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_positions_follow_a_change_of_language(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    model = langid.fit(docs)
    en = next(r.text for r in docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").collect())[:256]
    fr = next(r.text for r in docs.where("lang = 'fr' and n_chars > 500").orderBy("doc_id").collect())[:256]
    p = model.label_positions(en + fr)
    assert p.shape == (len((en + fr).encode()), len(model.languages))
    labels = p.argmax(1)
    n = len(en.encode())
    assert (labels[:n] == model.languages.index("en")).mean() > 0.7
    assert (labels[n:] == model.languages.index("fr")).mean() > 0.7


def test_odd_documents(spark):
    docs = odd_docs(spark)
    model = langid.fit(docs, steps=3)
    got = langid.predict(docs, model).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in ROWS)
    letters = {(r[0], any(c.isalpha() for c in text_of(r))) for r in ROWS}
    for r in got:
        assert (r.lang_pred != "und") in {known for i, known in letters if i == r.doc_id}
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
    untrained = langid.fit(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, untrained).collect()} == {("und", 0.0)}
    single = langid.fit(docs.where(F.col("lang") == "en"))
    assert {r.lang_pred for r in langid.predict(docs, single).collect()} == {"en", "und"}
    assert langid.predict(odd_docs(spark, []), model).collect() == []


def test_a_repeated_id_is_one_training_document(spark, monkeypatch):
    rows = [(k, f"{w} {i} " * 40, w) for k, w in ((1, "hello"), (2, "bonjour")) for i in range(200)]
    seen = []
    monkeypatch.setattr(langid.BidirectionalGru, "train", lambda self, windows, labels, steps: seen.append(len(windows)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen) == 1 and 2 <= seen[0] <= 2 * langid.WINDOWS_PER_DOCUMENT


def test_rare_languages_are_learned_too(spark):
    names = [f"l{i:02}" for i in range(70)]
    rows = [(i * 100 + k, f"{name} words number {k}", name) for i, name in enumerate(names) for k in range(2 + i % 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=2)
    assert model.languages == names
    text = b"some words " * 3000
    assert np.allclose(model.pooled(np.frombuffer(text, np.uint8), np.array([0, len(text)])).sum(), 1)
