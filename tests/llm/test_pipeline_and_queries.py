import re
import sys
from collections import defaultdict

import duckdb
from odd import SF, odd_docs, table

sys.path.insert(0, "/".join(__file__.split("/")[:-3]))
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402
from test_bpe_and_tokens import expected  # noqa: E402
from test_mixing import WORD, brute_targets  # noqa: E402
from test_near_dedup import brute_classes, named  # noqa: E402

from loanlens.llm.queries import ORACLE, QUERIES  # noqa: E402
from loanlens.session import store  # noqa: E402

NAMES = [n for n, _ in pipeline.STAGES]


def test_registered_once_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == cols
        key = lambda rows: sorted(map(str, rows))
        assert key(tuple(r[c] for c in cols) for r in df.collect()) == key(
            want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_stages_take_effect(spark):
    docs = table(spark, "documents")
    results = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, SF))
        results[name] = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
        if name != NAMES[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = results["toxicity"]
    labels = {r.doc_id: r.toxic for r in table(spark, "labels").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert all(labels.get(i) != 0 for i in gone)
    before, after = results["exact_dedup"]
    best = {}
    for r in before:
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert {r["text"]: r["doc_id"] for r in after} == best and len(after) == len(best)
    before, after = results["near_dedup"]
    classes = named([r["doc_id"] for r in before], brute_classes([r["text"] for r in before]))
    assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))
    before, after = results["mix_sources"]
    size, taken = defaultdict(int), defaultdict(int)
    for rows, count in ((before, size), (after, taken)):
        for r in rows:
            count[r["source"]] += len(WORD.findall(r["text"]))
    for s, target in brute_targets(size).items():
        assert abs(taken[s] - target) <= 48
    before, after = results["bpe_encode"]
    assert sorted((r["doc_id"], tuple(r["token_ids"])) for r in after) == sorted(
        (r["doc_id"], tuple(expected(r["text"])[0])) for r in before)


def test_run_gives_the_last_stage(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and all(r.n_tokens == len(r.token_ids) for r in rows)


def test_stages_of_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), odd_docs(spark, [])):
        for name, stage in pipeline.STAGES:
            docs = store(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "n_tokens", "token_ids"]


def test_a_worker_remembers_for_one_operator_at_a_time():
    # the pipeline's stages follow each other in the same Python workers
    import pyarrow as pa

    from loanlens.llm import bpe, common, hashing, near_dedup, token_output, toxicity
    from loanlens.llm.queries import TOKENIZER
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two three"]), pa.array([b"1"])],
                                       names=["doc_id", "body", "text_id"])
    held = lambda: [len(bpe.Bpe._loaded), len(token_output.PieceEncoder._loaded),
                    toxicity._remembered_buckets.cache_info().currsize > 0, len(hashing._known) > 0]
    task = lambda run: list(common.lean(run)([batch]))
    signed = task(near_dedup._sign(5, 25, 5))
    for _ in range(2):
        task(bpe._tokens(TOKENIZER))
        own = bpe.Bpe._loaded[TOKENIZER]
        assert held() == [1, 0, False, False]
    task(bpe._digests(TOKENIZER))
    assert bpe.Bpe._loaded[TOKENIZER] is own          # kept from task to task of one operator
    task(toxicity._bucket_batches)
    assert held() == [0, 0, True, False]
    assert task(near_dedup._sign(5, 25, 5)) == signed
    assert held() == [0, 0, False, True]
