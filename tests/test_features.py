import decimal
import re

from conftest import rows
from loanlens import session
from loanlens.operators import features
from loanlens.plans.catalog import QUERIES, customer_features_df
from loanlens.plans.catalog_scoring import features_table
from loanlens.sources import standins
from pyspark.sql import functions as F

D = decimal.Decimal
INST = "sk_id_curr long, days_instalment decimal(18,4), days_entry_payment decimal(18,4)"


def _inst(spark, data):
    return spark.createDataFrame([(k, None if d is None else D(d), None if p is None else D(p))
                                  for k, d, p in data], INST)


def _by_key(df):
    return {r["sk_id_curr"]: r.asDict() for r in df.collect()}


def test_lateness_counts(spark):
    # days_late 5, 0, -3 and one unpaid row for customer 1; only unpaid for 2
    df = _inst(spark, [(1, -10, -5), (1, -20, -20), (1, -30, -33), (1, -40, None),
                       (2, -1, None), (2, -2, None)])
    out = _by_key(features.payment_features(df))
    c1 = out[1]
    assert (c1["total_installments"], c1["num_late_payments"], c1["num_missed_payments"]) == (4, 1, 1)
    assert (c1["avg_days_late"], c1["max_days_late"]) == (5.0, 5.0)
    c2 = out[2]
    assert (c2["num_late_payments"], c2["num_missed_payments"]) == (0, 2)
    assert c2["avg_days_late"] is None and c2["max_days_late"] is None and c2["lateness_trend"] is None


def test_half_split_trend(spark):
    df = _inst(spark, [(1, -1, 9),                          # one row -> null
                       (2, -1, 9), (2, -5, -5),             # latest 10 - earlier 0
                       (3, -1, 2), (3, -2, -2), (3, -3, -1)])  # 3 - mean(0, 2)
    out = _by_key(features.payment_features(df))
    assert out[1]["lateness_trend"] is None
    assert out[2]["lateness_trend"] == 10.0
    assert out[3]["lateness_trend"] == 2.0


def test_ties_and_null_due_day(spark):
    # two rows due the same day: order by payment day decides, on every run
    df = _inst(spark, [(1, -1, 5), (1, -1, -1), (1, -9, -9), (1, -10, -10)])
    first = _by_key(features.payment_features(df))[1]["lateness_trend"]
    assert first == _by_key(features.payment_features(df))[1]["lateness_trend"]
    # recent half = due -1 rows (late 6 and 0) -> 3.0, earlier = 0 -> trend 3.0
    assert first == 3.0
    # a null due day ranks first (DESC NULLS FIRST); its days_late is null
    df = _inst(spark, [(1, None, 4), (1, -1, 9), (1, -2, -2), (1, -3, -3)])
    # n = 4, recent = {null row, due -1}: mean of 10 -> 10; earlier mean 0
    assert _by_key(features.payment_features(df))[1]["lateness_trend"] == 10.0


def test_exploratory_trend_drops_unpaid_first(spark):
    df = _inst(spark, [(1, -1, None), (1, -2, 0), (1, -3, -3)])
    r = _by_key(features.lateness_trend_paid(df))[1]
    assert (r["avg_late_recent_half"], r["avg_late_earlier_half"], r["lateness_trend"]) == (2.0, 0.0, 2.0)


def test_utilization_windows(spark):
    schema = "sk_id_curr long, months_balance int, amt_balance decimal(18,4), amt_credit_limit_actual int"
    data = [(1, 0, D(50), 100), (1, -6, D(30), 100), (1, -7, D(20), 100), (1, -12, D(0), 100),
            (1, -13, D(100), 100), (1, -3, D(999), 0),      # zero limit ignored
            (2, 0, D(10), 100), (2, -1, D(20), 100)]        # only recent months
    out = _by_key(features.utilization(spark.createDataFrame(data, schema)))
    assert out[1]["avg_utilization_recent_6mo"] == 0.4
    assert out[1]["avg_utilization_prior_6mo"] == 0.1
    assert out[1]["utilization_trend"] == 0.3
    assert out[1]["avg_utilization_overall"] == 0.4        # (.5+.3+.2+0+1)/5
    assert out[2]["utilization_trend"] is None


def test_bureau_status(spark):
    schema = ("sk_id_curr long, credit_active string, days_credit int, credit_day_overdue int, "
              "amt_credit_sum_debt decimal(18,4)")
    data = [(1, "Active", -100, 0, D("10.5")), (1, "Closed", -300, 5, None), (1, "Sold", -50, 1, D("0.4"))]
    r = _by_key(features.bureau_features(spark.createDataFrame(data, schema)))[1]
    assert (r["num_bureau_accounts"], r["num_active_accounts"], r["num_closed_accounts"]) == (3, 1, 1)
    assert (r["credit_history_length_days"], r["max_external_overdue_days"]) == (300, 5)
    assert r["total_external_debt"] == 11.0


def test_absent_customer_gets_nulls(spark):
    from loanlens.plans.catalog import customer_features_df
    feats = customer_features_df(spark, "/root/testdata/sf0.001")
    cnt = feats.count()
    assert cnt == feats.select("sk_id_curr").distinct().count()     # one row per customer
    no_pos = feats.where("avg_dpd_overall IS NULL").limit(1).collect()
    assert no_pos and no_pos[0]["max_dpd_ever"] is None and no_pos[0]["dpd_trend"] is None


def test_one_exchange_feeds_window_and_aggregate(spark):
    from loanlens.sources import standins
    df = features.payment_features(standins.installments(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # exchanges: join inputs, the (customer, due, paid) pre-aggregation and one
    # on the customer key shared by the window and the final aggregate
    assert plan.count("hashpartitioning(sk_id_curr") <= 2


def test_scan_prunes_columns(spark):
    from loanlens.plans.catalog import customer_features_df
    plan = customer_features_df(spark, "/root/testdata/sf0.001")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "c_name" not in plan


def test_views_and_materialised_table(spark, tmp_path):
    from loanlens.plans import jobs, views
    from loanlens.sources import standins
    raw = standins.raw_tables(spark, "/root/testdata/sf0.001")
    v = views.register_views(raw)
    n = spark.sql("SELECT COUNT(*) FROM customer_features").first()[0]
    assert n == v["customer_features"].count()
    folder = str(tmp_path / "tables")
    stored = jobs.feature_job(spark, raw, folder)
    assert stored.count() == n
    sc = jobs.score_job(spark, folder)
    assert sc.count() == n and len(sc.columns) == 10
    assert views.preview(stored).count() == 20
    # train, save, reload, score, publish
    jobs.train_job(spark, folder, str(tmp_path / "model"))
    again = jobs.score_job(spark, folder, str(tmp_path / "model"))
    assert again.count() == n
    view = jobs.publish_job(spark, folder)
    assert view.count() == n and spark.table("vw_customer_dashboard").count() == n


def test_load_job_stops_at_a_violated_key(spark, tmp_path):
    import pytest

    from loanlens.plans import jobs
    from loanlens.sources import files, schemas
    ddl = schemas.RAW_SCHEMAS["raw_bureau"]
    for ids in ([1, 1], [1, None]):
        df = spark.createDataFrame([(7, i) for i in ids], "sk_id_curr long, sk_id_bureau long")
        files.write_raw_csv(df, str(tmp_path / "b.csv"), ddl)
        with pytest.raises(ValueError, match="primary key"):
            jobs.load_job(spark, {"raw_bureau": str(tmp_path / "b.csv")}, str(tmp_path / "out"))


def test_training_stops_at_a_missing_cell(spark):
    import pytest

    from loanlens.operators import model
    from loanlens.plans.catalog import customer_features_df
    from pyspark.sql import functions as F
    feats = customer_features_df(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="missing cells"):
        model.train(feats.withColumn("age_years", F.lit(None).cast("double")))


def test_bucketed_layout_needs_no_shuffle_on_the_key(spark):
    """K3: a child table stored bucketed on the customer key is grouped by
    that key without an exchange (the original's index on the key)."""
    from loanlens.operators import features
    from loanlens.sources import files, standins
    inst = standins.installments(spark, "/root/testdata/sf0.001")
    files.save_bucketed(inst, "raw_installments_payments_bucketed", "sk_id_curr", 4)
    stored = spark.table("raw_installments_payments_bucketed")
    assert stored.count() == inst.count()
    grouped = features.missed_payments(stored)
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert sorted(grouped.collect()) == sorted(features.missed_payments(inst).collect())


def test_bucketed_children_are_joined_without_a_shuffle(spark):
    """K3: no exchange on the customer key, and no broadcast of a child table."""
    from loanlens.plans.catalog import QUERIES
    df = QUERIES["bucketed_child_activity"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert df.count() > 0


def _held_by_task(df):
    """Rows of each task of a result, the largest first."""
    return sorted((r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()),
                  reverse=True)


def _driver_tables(spark, folder, customers, lines):
    """The tables that the stand-ins read; every order has two lines."""
    day = F.timestamp_seconds(F.lit(980_000_000) + F.col("id") * 86_400).cast("timestamp_ntz")
    typed = {
        "customer": spark.range(customers).select(
            F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), (F.col("id") % 24).cast("int").alias("c_nationkey"),
            ((F.col("id") * 31) % 50 - 4.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")),
        "orders": spark.range(lines // 2).select(
            F.col("id").alias("o_orderkey"), (F.col("id") % customers).alias("o_custkey"),
            F.lit("F").alias("o_orderstatus"), F.lit(100.0).alias("o_totalprice"), day.alias("o_orderdate"),
            F.lit("1-URGENT").alias("o_orderpriority")),
        "lineitem": spark.range(lines).select(
            F.floor(F.col("id") / 2).alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"),
            F.lit(1).cast("long").alias("l_suppkey"), (F.col("id") % 2 + 1).cast("int").alias("l_linenumber"),
            F.lit(1.0).alias("l_quantity"), F.lit(5.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"),
            F.lit(0.0).alias("l_tax"), F.when(F.col("id") % 5 == 0, "R").otherwise("N").alias("l_returnflag"),
            F.lit("F").alias("l_linestatus"), day.alias("l_shipdate")),
        "events": spark.range(customers).select(
            F.col("id").alias("event_id"), day.alias("ts"), F.col("id").alias("user_id"),
            F.lit("view").alias("event_type"), F.lit(3.0).alias("value"), F.lit("{}").alias("props")),
    }
    for name, df in typed.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_tasks_of_a_shuffle_follow_the_rows(spark):
    planned = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    full = session.SHUFFLE_ROWS
    assert session.shuffle_tasks(spark, 0) is None and session.shuffle_tasks(spark, planned * full) is None
    assert session.shuffle_tasks(spark, planned * full + 1) == planned + 1
    assert session.shuffle_tasks(spark, 1000 * full) == 1000 or planned >= 1000


def test_installments_and_features_of_one_task_do_not_grow(spark, tmp_path, monkeypatch):
    folder = _driver_tables(spark, tmp_path, customers=3000, lines=12_000)
    whole = [standins.installments(spark, folder), customer_features_df(spark, folder)]
    before = [sorted(map(tuple, df.collect()), key=repr) for df in whole]
    monkeypatch.setattr(session, "SHUFFLE_ROWS", 100)
    assert standins.child_tasks(spark, folder) == 120
    dealt = [standins.installments(spark, folder), customer_features_df(spark, folder)]
    for df, rows_before in zip(dealt, before):
        assert sorted(map(tuple, df.collect()), key=repr) == rows_before
        assert _held_by_task(df)[0] <= 3 * len(rows_before) / 120 + 20


def test_dealt_payment_features_keep_results(spark):
    df = _inst(spark, [(k % 7, -(k % 11), None if k % 5 == 0 else k % 13 - 11) for k in range(300)]
               + [(None, -1, 2), (None, -3, 2), (3, None, 1)])
    for made in (features.payment_features, features.lateness_trend_paid):
        assert sorted(map(tuple, made(df, tasks=40).collect()), key=repr) == sorted(map(tuple, made(df).collect()), key=repr)
        # the distinct day pairs reach the window dealt by customer, not raw rows
        plan = made(df, tasks=40)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(sk_id_curr" in plan and ", 40)" in plan and plan.count("partial_count(1)") >= 1


def _same_when_dealt(spark, tmp_path, monkeypatch, name):
    """A query's rows with the session's own tasks, and over features made by many."""
    few, many = (_driver_tables(spark, tmp_path / x, customers=3000, lines=12_000) for x in ("few", "many"))
    expected = sorted(map(tuple, QUERIES[name](spark, few).collect()), key=repr)
    monkeypatch.setattr(session, "SHUFFLE_ROWS", 300)
    assert sorted(map(tuple, QUERIES[name](spark, many).collect()), key=repr) == expected
    # each task of the shuffle wrote its part of the stored feature table
    assert len(features_table(spark, many).inputFiles()) > 30 > len(features_table(spark, few).inputFiles())
    return expected


def test_health_summary_over_dealt_features(spark, tmp_path, monkeypatch):
    (row,) = _same_when_dealt(spark, tmp_path, monkeypatch, "health_score_summary")
    assert row[0] == 3000 - 150 - 150          # customers of known gender


def test_confusion_matrix_over_dealt_features(spark, tmp_path, monkeypatch):
    matrix = _same_when_dealt(spark, tmp_path, monkeypatch, "risk_model_confusion_matrix")
    assert [r[0] for r in matrix] == [0, 1]
    assert sum(r[1] + r[2] for r in matrix) == round(0.2 * 2700)


def _exchanges(df):
    """(columns, partitions) of each hash shuffle in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {(re.sub(r"#\d+L?", "", columns), int(n)) for columns, n in re.findall(r"hashpartitioning\((.*?), (\d+)\)", plan)}


def test_day_groups_of_health_summary_are_dealt(spark, tmp_path, monkeypatch):
    folder = _driver_tables(spark, tmp_path, customers=3000, lines=12_000)
    monkeypatch.setattr(session, "SHUFFLE_ROWS", 300)
    dealt = [(columns, n) for columns, n in _exchanges(customer_features_df(spark, folder)) if "days_instalment" in columns]
    assert dealt == [("sk_id_curr, days_instalment, days_entry_payment", 40)]
    assert ("sk_id_curr", 40) in _exchanges(customer_features_df(spark, folder))


def test_dealt_day_groups_of_a_hot_customer(spark):
    # half of the rows are one customer's, and a third of those one day pair; keys and days may be null
    df = _inst(spark, [(0 if k % 2 else k, -(k % 67) if k % 3 else -1, 5 if k % 3 == 0 else -(k % 31)) for k in range(4000)]
               + [(None, None, None)] * 50 + [(None, -1, None)] * 50)
    dealt = features.lateness_groups(df, tasks=40)
    assert sorted(rows(dealt), key=repr) == sorted(rows(features.lateness_groups(df)), key=repr)
    held = _held_by_task(dealt)
    assert len(held) > 30 and held[0] < 0.1 * sum(held)


def _children(spark):
    # half of the rows are one customer's; keys, months and values may be null
    key = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 41 == 0, None).otherwise(F.col("id") % 97)
    n = F.col("id")
    return spark.range(6000).select(
        key.cast("long").alias("sk_id_curr"),
        F.when(n % 53 != 0, -(n * 7 % 29)).cast("int").alias("months_balance"),
        F.when(n % 19 != 0, (n * 7919 % 100_003) / 7).cast("decimal(18,4)").alias("amt_balance"),
        F.when(n % 11 == 0, 0).otherwise(n % 13 * 1000 + 3).cast("int").alias("amt_credit_limit_actual"),
        F.when(n % 17 != 0, n * 31 % 121).cast("int").alias("sk_dpd"),
        F.element_at(F.array(*map(F.lit, ("Active", "Closed", "Sold"))), (n % 3 + 1).cast("int")).alias("credit_active"),
        F.when(n % 53 != 0, -(n * 7 % 301)).cast("int").alias("days_credit"),
        F.when(n % 23 != 0, n % 120).cast("int").alias("credit_day_overdue"),
        F.when((n % 5 != 0) & (n % 97 != 3), (n * 104_729 % 1_000_003) / 3).cast("decimal(18,4)").alias("amt_credit_sum_debt"))


def test_dealt_children_keep_results_and_spread_a_hot_customer(spark):
    df = _children(spark).cache()
    parts = {features.utilization: "months_balance", features.dpd_features: "months_balance",
             features.bureau_features: "days_credit"}
    for made, part in parts.items():
        dealt = made(df, tasks=40)
        assert sorted(rows(dealt), key=repr) == sorted(rows(made(df)), key=repr)
        assert _exchanges(dealt) == {(f"sk_id_curr, {part}", 40), ("sk_id_curr", 41)}
        held = _held_by_task(df.repartition(40, "sk_id_curr", part))
        assert held[0] < 0.2 * sum(held)
    # the means are those of avg
    u = F.col("amt_balance") / F.nullif("amt_credit_limit_actual", F.lit(0))
    m = F.col("months_balance")
    recent, prior = F.avg(F.when(m >= -6, u)), F.avg(F.when(m.between(-12, -7), u))
    plain = df.groupBy("sk_id_curr").agg(*[F.round(x, 3).cast("double") for x in (F.avg(u), recent, prior, recent - prior)])
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(rows(features.utilization(df, tasks=40)), key=repr)


def test_rows_of_a_scan_task_follow_the_rows(spark, tmp_path, monkeypatch):
    folder = _driver_tables(spark, tmp_path / "in", customers=3000, lines=12_000)
    path = f"{folder}/lineitem.parquet"
    lines = spark.read.parquet(path).repartition(1)
    # one file of many row groups, as larger tables have
    (lines.write.mode("overwrite").option("parquet.block.size", 4096).option("parquet.page.size", 1024)
     .option("parquet.block.size.row.check.min", 50).option("parquet.page.size.row.check.min", 50)
     .parquet(f"{folder}/lines.parquet"))
    table = spark.read.parquet(f"{folder}/lines.parquet")
    key = "spark.sql.files.maxPartitionBytes"
    session_limit = spark.conf.get(key)
    try:
        monkeypatch.setattr(session, "SHUFFLE_ROWS", 1000)
        session.bounded_scans(spark, [(table, 12_000)])
        assert int(spark.conf.get(key).rstrip("b")) == session.SPLIT_BYTES      # files this small are not split further
        monkeypatch.setattr(session, "SPLIT_BYTES", 1)
        session.bounded_scans(spark, [(table, 900)])
        assert int(spark.conf.get(key)) == 4 << 20                              # few rows need no splits
        session.bounded_scans(spark, [(table, 12_000)])
        assert _held_by_task(spark.read.parquet(f"{folder}/lines.parquet"))[0] <= 3000
        lowered = spark.conf.get(key)
        monkeypatch.setattr(session, "SHUFFLE_ROWS", 6000)
        session.bounded_scans(spark, [(table, 12_000)])
        assert spark.conf.get(key) == lowered                                   # never raised
        # the queries over children lower it as well, once their shuffles need more tasks
        spark.conf.set(key, session_limit)
        assert standins.child_tasks(spark, folder) is None and spark.conf.get(key) == session_limit
        monkeypatch.setattr(session, "SHUFFLE_ROWS", 100)
        assert standins.child_tasks(spark, folder) == 120 and int(spark.conf.get(key)) < 100_000
    finally:
        spark.conf.set(key, session_limit)
