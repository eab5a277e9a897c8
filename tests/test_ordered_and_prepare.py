import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from conftest import rows
import pytest

from pyspark.sql import functions as F

from loanlens.operators import prepare
from loanlens.operators.ordered import rank_desc, running_totals
from loanlens.operators.selection import column_quantiles


def test_running_totals_match_brute_force(spark):
    rng = random.Random(7)
    data = [(rng.choice([0, 1]), float(rng.randint(0, 50)), rng.randint(1, 5)) for _ in range(400)]
    df = spark.createDataFrame(data, "g int, v double, w long").groupBy("g", "v").sum("w") \
        .withColumnRenamed("sum(w)", "w")
    got = {(r["g"], r["v"]): (r["w_before"], r["w_total"])
           for r in running_totals(df, ["v"], ["w"], by=["g"], slices=4).collect()}
    for (g, v), (before, total) in got.items():
        assert before == sum(w for gg, vv, w in data if gg == g and vv < v)
        assert total == sum(w for gg, _, w in data if gg == g)


@pytest.mark.parametrize("slices", [None, 1, 5])
def test_running_totals_without_groups(spark, slices):
    rng = random.Random(11)
    data = [(float(v), rng.randint(1, 4)) for v in rng.sample(range(-300, 300), 120)]
    df = spark.createDataFrame(data, "v double, w long")
    got = running_totals(df, ["v"], ["w"], slices=slices).collect()
    assert len(got) == len(data)
    for r in got:
        assert r["w_before"] == sum(w for v, w in data if v < r["v"])
        assert r["w_total"] == sum(w for _, w in data)


def test_group_spanning_many_slices(spark):
    rng = random.Random(5)
    data = [(g, float(v), 1) for g in (0, 1) for v in rng.sample(range(1000), 90)]
    df = spark.createDataFrame(data + [(None, 1.0, 1)], "g int, v double, w long")
    for r in running_totals(df, ["v"], ["w"], by=["g"], slices=12).collect():
        assert r["w_before"] == sum(1 for g, v, _ in data if g == r["g"] and v < r["v"])
        assert r["w_total"] == (1 if r["g"] is None else 90)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    r = column_quantiles(df, ["v"], {"a": 0.25, "b": 0.5, "c": 0.99})["v"]
    for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.99)):
        assert abs(r[name] - float(np.percentile(values, p * 100))) < 1e-9


@pytest.mark.parametrize("sample", [8, 100, 20_000])
def test_refinement_of_many_columns(spark, sample):
    """Hot values, ties, nulls, constants, infinities and odd names; few samples take more rounds."""
    rng = random.Random(sample)
    n = 3000
    columns = {"hot": [0.0 if rng.random() < 0.6 else rng.gauss(0, 1) for _ in range(n)],
               "steps": [float(rng.randint(0, 3)) for _ in range(n)],
               "one": [7.0] * n, "wide": [rng.choice([1e300, -1e300, rng.random()]) for _ in range(n)],
               "a b.c": [rng.random() if i % 3 else None for i in range(n)],
               "ends": [float("inf") if i % 50 == 0 else -float("inf") if i % 50 == 1 else float(i) for i in range(n)],
               "none": [None] * n}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` double" for c in columns)).repartition(5)
    got = column_quantiles(df, list(columns), {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.9, "hi": 1.0}, sample)
    for c, values in columns.items():
        known = sorted(v for v in values if v is not None)
        for name, p in (("lo", 0.0), ("q", 0.25), ("m", 0.5), ("p", 0.9), ("hi", 1.0)):
            if not known:
                assert got[c][name] is None
                continue
            at = p * (len(known) - 1)
            low, high = known[math.floor(at)], known[math.ceil(at)]
            assert got[c][name] == (low if at == math.floor(at) else low + (high - low) * (at - math.floor(at))), (c, name)


def test_refinement_shuffles_no_rows(spark, monkeypatch):
    """Only one row of pivots or counts leaves a task, however many rows and columns there are."""
    from loanlens.operators import selection
    plans = []

    class Watched:
        def __init__(self, df):
            self.df = df

        def agg(self, *columns):
            out = self.df.agg(*columns)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

        def select(self, *columns):
            return Watched(self.df.select(*columns))

    df = spark.range(5000).select(*[(F.rand(i) * 100).alias(f"c{i}") for i in range(6)])
    selection.column_quantiles(Watched(df), df.columns, prepare.QUARTILES, 300)
    assert plans
    for plan in plans:
        assert "Generate" not in plan and "Expand" not in plan and "Sort " not in plan
        assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan


def test_describe_of_large_values_with_small_spread(spark):
    df = spark.createDataFrame([(1e9 - 1, 4.0), (1e9, None), (1e9 + 1, None)], "v double, w double").repartition(3)
    got = {r.feature: r for r in prepare.describe_columns(df, ["v", "w"]).collect()}
    assert (got["v"]["count"], got["v"]["mean"], got["v"]["std"]) == (3, 1e9, 1.0)
    assert (got["w"]["count"], got["w"]["std"], got["w"]["q50"]) == (1, None, 4.0)
    many = spark.range(1000).select((F.lit(1e9) + (F.col("id") % 3) - 1).alias("v"))
    want = float(np.std(np.arange(1000) % 3, ddof=1))
    assert abs(prepare.describe_columns(many, ["v"]).first()["std"] - want) < 1e-6


def test_neighbours_across_slices(spark):
    rng = random.Random(3)
    data = [(g, float(v), rng.randint(1, 9)) for g in (0, 1) for v in rng.sample(range(500), 70)]
    df = spark.createDataFrame(data, "g int, v double, w long")
    want = {}
    for g in (0, 1):
        ordered = sorted((v, w) for gg, v, w in data if gg == g)
        for i, (v, _) in enumerate(ordered):
            want[g, v] = ordered[i - 1][1] if i else None
    for slices in (1, 3, 16):
        got = running_totals(df, ["v"], ["w"], by=["g"], slices=slices, previous=["w"]).collect()
        assert {(r.g, r.v): r.w_previous for r in got} == want


def test_rank_matches_pandas(spark):
    import pandas as pd
    vals = [round(random.Random(i).random() * 10, 1) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, s double")
    got = dict(rows(rank_desc(df, "s"), "id", "rank"))
    want = pd.Series(vals).rank(ascending=False, method="min").astype(int)
    assert all(got[i] == want[i] for i in range(200))


def test_imputation_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "ext_source_1 double")
    imp = prepare.Imputation.fit(df, ["ext_source_1"])
    assert imp.medians == {"ext_source_1": 2.5}


def test_one_hot_drops_first_and_zeroes_unseen(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    enc = prepare.OneHot.fit(df, ["t"])
    assert enc.output_columns == ["t_b", "t_c"]
    new = spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "t string")
    assert rows(enc.transform(new), "t_b", "t_c") == [(0, 0), (0, 1), (0, 0), (0, 0)]


def test_robust_scale_edge_columns(spark):
    data = [(5.0, 1 if i < 10 else 0, float(i)) for i in range(100)]
    df = spark.createDataFrame(data, "const double, flag int, x double")
    sc = prepare.RobustScale.fit(df, ["const", "flag", "x"])
    assert sc.spread["const"] == 1.0 and sc.spread["flag"] == 1.0
    out = sc.transform(df.where("x in (0, 99)")).orderBy("x").collect()
    assert out[0]["flag"] == 1.0 and out[1]["flag"] == 0.0      # rare dummy kept
    assert out[0]["const"] == 0.0
    big = spark.createDataFrame([(37.0,), (-12.0,)], "v double")
    sc2 = prepare.RobustScale({"v": 0.0}, {"v": 1.0})
    assert [r[0] for r in sc2.transform(big).collect()] == [10.0, -10.0]


def test_stratified_split_shares(spark):
    data = [(i, 1 if i % 12 == 0 else 0) for i in range(1200)]
    df = spark.createDataFrame(data, "sk_id_curr long, target int")
    split = prepare.stratified_split(df)
    counts = {(r[0], r[1]): r[2] for r in split.groupBy("split", "target").count().collect()}
    assert counts[("test", 1)] == 20 and counts[("test", 0)] == 220
    again = {r["sk_id_curr"]: r["split"] for r in prepare.stratified_split(df).collect()}
    assert again == {r[0]: r[1] for r in split.select("sk_id_curr", "split").collect()}


def test_split_by_prefixes_equals_a_full_rank(spark):
    rng = random.Random(2)
    data = [(rng.randint(0, 400), rng.choice([0, 0, 0, 1, None])) for _ in range(2500)] + [(None, 1), (7, 2)]
    data += [(77, 0)] * 900                                   # one id on very many rows
    df = spark.createDataFrame(data, "sk_id_curr long, target int")
    hashed = {r[0]: r[1] for r in df.select("sk_id_curr", prepare.split_hash().alias("h")).distinct().collect()}
    want = {}
    for c in (0, 1, 2):
        ranked = sorted((hashed[i], i) for i, t in data if t == c and i is not None)
        k = (len(ranked) * 4 + 10) // 20
        if k:
            want[c] = ranked[k - 1]
    for fetch in (10_000, 1):
        assert prepare.split_thresholds(df, "target", "sk_id_curr", 42, fetch) == want
