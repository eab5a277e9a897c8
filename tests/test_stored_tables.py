"""Stored tables: reused while their inputs stay, built again when dropped."""

import bench
from loanlens.plans.stored import stored
from loanlens.session import drop_tables, store

SF = "/root/testdata/sf0.001"


def test_stored_once_and_again_after_a_drop(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    for _ in range(3):
        assert stored(spark, SF, "numbers", build).count() == 5
    assert len(built) == 1
    drop_tables(spark)
    assert stored(spark, SF, "numbers", build).count() == 5
    assert len(built) == 2


def test_a_stored_table_is_read_with_pruning(spark):
    df = store(spark.range(10).selectExpr("id", "id * 2 as twice", "cast(id as string) as text"))
    plan = df.where("id = 3").select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,twice:bigint>" in plan and "EqualTo(id,3)" in plan
    assert df.where("id = 3").select("twice").collect()[0][0] == 6


def test_every_run_of_the_benchmark_builds_its_tables(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    for _ in range(3):
        bench._run_spark(lambda s, sf: stored(s, sf, "timed", build), spark, SF)
    assert len(built) == 3
