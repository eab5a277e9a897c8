import zlib

import numpy as np
from odd import ROWS, odd_docs, table

from loanlens.llm import toxicity
from loanlens.llm.queries import op10_toxicity


def test_learns_a_pair_that_no_single_term_shows():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(4000):
        insult, group = (rng.random(2) < 0.5).tolist()
        filler = [f"w{i}" for i in rng.integers(0, 50, 6)]
        rows.append(toxicity.buckets_of(" ".join(filler + ["vermin"] * insult + ["those", "foreigners"] * group)))
        labels.append(float(insult and group))
    model = toxicity.FactorizationMachine.fit(rows, np.array(labels))
    place = lambda text: (lambda p: p[p >= 0])(model.place[toxicity.buckets_of(text)])
    both, one, other, none = model.score([place(t) for t in (
        "vermin those foreigners w1 w2", "vermin w1 w2", "those foreigners w1 w2", "w1 w2")])
    assert both > 0.9 and max(one, other, none) < 0.1
    pair = model.v[place("vermin")].sum(0) @ model.v[place("foreigners")].sum(0)
    assert pair > 0


def test_pair_term_against_the_double_sum():
    rng = np.random.default_rng(4)
    w, v = rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS))
    rows = [np.array([0, 3, 5, 8]), np.array([], int), np.array([2])]
    cols = np.concatenate(rows).astype(int)
    row = np.repeat(np.arange(3), [len(r) for r in rows])
    got, _ = toxicity._forward(cols, row, 3, 0.3, w, v)
    for r, s in zip(rows, got):
        want = 0.3 + sum(w[i] for i in r) + sum(v[i] @ v[j] for i in r for j in r if i < j)
        assert abs(s - want) < 1e-9


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op10_toxicity(spark, sf).collect()}
    assert len(got) == table(spark, "documents", sf).count()
    labels = {r.doc_id: r.toxic for r in table(spark, "labels", sf).collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    toxic = [i for i in held if labels[i] == 1]
    clean = [i for i in held if labels[i] == 0]
    assert sum(got[i].predicted for i in toxic) / len(toxic) > 0.8
    assert sum(got[i].predicted for i in clean) / len(clean) < 0.01
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_odd_documents(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (8, None), (999, 1)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert all(0 < r.score < 1 for r in got)
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.score < 0.5 for r in got)
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1")):
        one = toxicity.fit(docs, some)
        assert len({r.score for r in toxicity.score(docs, one).collect()}) == 1
    assert toxicity.score(odd_docs(spark, []), model).collect() == []


def test_a_repeated_id_is_one_training_row(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"copy {i} of it") for i in range(300)] + [(2, "another text"), (3, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    fitted = []
    real = toxicity.FactorizationMachine.fit
    monkeypatch.setattr(toxicity.FactorizationMachine, "fit",
                        lambda rows, toxic: fitted.append((len(rows), toxic.tolist())) or real(rows, toxic))
    toxicity.fit(docs, labels)
    assert [(n, sorted(t)) for n, t in fitted] == [(3, [0.0, 0.0, 1.0])]


def test_buckets_chosen_on_spark_are_those_of_all_counts(spark, monkeypatch):
    """The fit over the chosen buckets alone equals the one over all buckets."""
    rng = np.random.default_rng(6)
    texts = [" ".join([f"w{k}" for k in rng.integers(0, 300, 40)] + ["vermin"] * (i % 3 == 0) + ["scum"] * (i % 6 == 0))
             for i in range(600)]
    toxic = [float(i % 3 == 0) for i in range(600)]
    rows = [toxicity.buckets_of(t) for t in texts]
    train = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(rows, toxic)], "buckets array<int>, toxic int")
    for features in (toxicity.FEATURES, 5):
        monkeypatch.setattr(toxicity, "FEATURES", features)
        chosen = toxicity.telling_buckets(train)
        whole = toxicity.FactorizationMachine.fit(rows, np.array(toxic))
        cut = toxicity.FactorizationMachine.fit([r[np.isin(r, chosen)] for r in rows], np.array(toxic))
        assert chosen and sorted(chosen) == np.flatnonzero(whole.place >= 0).tolist()
        assert (whole.place == cut.place).all() and np.array_equal(whole.w, cut.w) and np.array_equal(whole.v, cut.v)


def test_the_driver_gets_chosen_buckets_only(spark, monkeypatch):
    """Long texts do not enlarge what the fit fetches."""
    docs = spark.createDataFrame([(i, ("vermin " if i % 2 else "") + " ".join(f"x{i}y{k}" for k in range(3000)))
                                  for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    fetched = []
    real = toxicity.FactorizationMachine.fit
    monkeypatch.setattr(toxicity.FactorizationMachine, "fit",
                        lambda rows, toxic: fetched.extend(rows) or real(rows, toxic))
    model = toxicity.fit(docs, labels)
    assert len(fetched) == 60 and max(map(len, fetched)) <= 4 and sum(map(len, fetched)) > 0
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {i: i % 2 for i in range(60)}
