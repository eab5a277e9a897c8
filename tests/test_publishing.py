"""Gates and published versions: a failed job leaves the last good tables."""

import threading

import pytest
from pyspark.sql import functions as F

from loanlens.plans import jobs
from loanlens.sources import files, schemas, standins, versions

SF = "/root/testdata/sf0.001"
DDL = schemas.RAW_SCHEMAS["raw_bureau"]


def load(spark, tmp_path, ids):
    df = spark.createDataFrame([(7, i) for i in ids], "sk_id_curr long, sk_id_bureau long")
    files.write_raw_csv(df, str(tmp_path / "b.csv"), DDL)
    return jobs.load_job(spark, {"raw_bureau": str(tmp_path / "b.csv")}, str(tmp_path / "tables"))


def ids(spark, tmp_path):
    return sorted(r.sk_id_bureau for r in versions.read(spark, str(tmp_path / "tables"), "raw_bureau").collect())


def test_a_violated_key_leaves_the_old_table(spark, tmp_path):
    load(spark, tmp_path, [1, 2])
    for bad in ([7, 7], [3, None]):
        with pytest.raises(ValueError, match="primary key"):
            load(spark, tmp_path, bad)
        assert ids(spark, tmp_path) == [1, 2]
    held = versions.read(spark, str(tmp_path / "tables"), "raw_bureau")
    load(spark, tmp_path, [4, 5, 6])
    assert ids(spark, tmp_path) == [4, 5, 6]
    assert held.count() == 2                 # a reader that began before keeps its version


def test_a_field_that_does_not_parse_leaves_the_old_table(spark, tmp_path):
    load(spark, tmp_path, [1, 2])
    n = len(schemas.RAW_SCHEMAS["raw_bureau"].split(","))
    (tmp_path / "bad.csv").write_text(",".join("c" * n) + "\n" + ",".join(["x"] * n) + "\n")
    with pytest.raises(Exception):
        jobs.load_job(spark, {"raw_bureau": str(tmp_path / "bad.csv")}, str(tmp_path / "tables"))
    assert ids(spark, tmp_path) == [1, 2]


def test_scores_are_checked_before_they_are_published(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "tables")
    with pytest.raises(ValueError, match="not published"):
        jobs.publish_job(spark, folder)
    with pytest.raises(ValueError, match="no published table"):
        jobs.score_job(spark, folder)
    jobs.feature_job(spark, standins.raw_tables(spark, SF), folder)
    good = sorted(map(str, jobs.score_job(spark, folder).collect()))
    right = jobs.scores.customer_scores
    spoilt = {
        "primary key": lambda df: right(df).union(right(df).limit(1)),
        "rows, expected": lambda df: right(df).where("risk_score > 20"),
        "missing cells": lambda df: right(df).withColumn("risk_probability", F.lit(None).cast("double")),
        "outside 0 to 1": lambda df: right(df).withColumn("risk_probability", F.lit(1.5)),
    }
    for message, wrong in spoilt.items():
        monkeypatch.setattr(jobs.scores, "customer_scores", wrong)
        with pytest.raises(ValueError, match=message):
            jobs.score_job(spark, folder)
        assert sorted(map(str, versions.read(spark, folder, "customer_scores").collect())) == good
    monkeypatch.setattr(jobs.scores, "customer_scores", right)
    assert jobs.publish_job(spark, folder).count() == len(good)


def test_versions_published_at_once_keep_all_tables(spark, tmp_path):
    folder = str(tmp_path / "tables")
    assert versions.current(spark, folder) == {}
    threads = [threading.Thread(target=versions.publish, args=(spark, folder, {f"t{i}": f"p{i}"})) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert versions.current(spark, folder) == {f"t{i}": f"p{i}" for i in range(6)}


def test_an_unfinished_publication_does_not_count(spark, tmp_path):
    folder = str(tmp_path / "tables")
    versions.publish(spark, folder, {"a": "x"})
    (tmp_path / "tables" / "versions" / "000000000002-lost.json").write_text('{"a": "y')
    assert versions.current(spark, folder) == {"a": "x"}
    versions.publish(spark, folder, {"b": "z"})
    versions.publish(spark, folder, {"a": "w"})
    assert versions.current(spark, folder) == {"a": "w", "b": "z"}


def test_old_versions_are_removed(spark, tmp_path):
    for some in ([1], [2], [3]):
        load(spark, tmp_path, some)
    versions.remove_old(spark, str(tmp_path / "tables"), keep=1)
    assert ids(spark, tmp_path) == [3]
    assert len(list((tmp_path / "tables" / "data").iterdir())) == 1
