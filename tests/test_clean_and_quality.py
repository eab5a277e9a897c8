import decimal

from pyspark.sql import functions as F

from conftest import rows
from loanlens.operators import clean, quality
from loanlens.sources import schemas

D = decimal.Decimal


def _apps(spark, data):
    schema = "sk_id_curr long, code_gender string, days_employed int, amt_income_total decimal(18,4)"
    return spark.createDataFrame(data, schema)


def test_sentinel_cap_and_placeholder(spark):
    df = _apps(spark, [(1, "F", 365243, D("25000000")), (2, "M", -100, D("5")), (3, "F", None, None),
                       (4, "XNA", -5, D("1")), (5, None, -5, D("1"))])
    out = {r[0]: r[1:] for r in rows(clean.staged_applications(df), "sk_id_curr",
                                      "days_employed_clean", "amt_income_total_clean")}
    assert set(out) == {1, 2, 3}                      # XNA and null gender dropped
    assert out[1] == (None, D("20000000.0000"))         # sentinel -> null, capped
    assert out[2] == (-100, D("5.0000"))
    assert out[3] == (None, D("20000000.0000"))         # LEAST skips the null income


def test_key_reports(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    assert sorted(rows(quality.key_violations(df, "k")), key=str) == sorted([(1, 2), (None, 1)], key=str)
    assert rows(quality.duplicate_keys(df, "k")) == [(1, 2)]
    try:
        quality.assert_primary_key(df, "k")
        raise AssertionError("expected failure")
    except ValueError:
        pass


def test_rates_are_exact(spark):
    df = spark.createDataFrame([(0,)] * 5 + [(1,)] * 3, "target int")
    (n, d, pct), = rows(quality.portfolio_default_rate(df))
    assert (n, d, pct) == (8, 3, 37.5)


def test_age_bucket_truncates(spark):
    df = spark.createDataFrame([(-(30 * 365) + 1,), (-(30 * 365),), (-(60 * 365),)], "d int")
    assert [r[0] for r in rows(df.select(quality.age_bucket(F.col("d"))))] == ["Under 30", "30-44", "60+"]


def test_csv_semantics(spark, tmp_path):
    p = tmp_path / "ok.csv"
    p.write_text('a,b,c\n1,,1e-05\n2,"",7\n')
    schema = "x bigint, y string, z decimal(18,4)"
    from loanlens.sources.files import read_raw_csv
    out = rows(read_raw_csv(spark, str(p), schema))
    assert out == [(1, None, D("0.0000")), (2, "", D("7.0000"))]
    bad = tmp_path / "bad.csv"
    bad.write_text("a\n7.0\n")
    import pytest
    loaded = read_raw_csv(spark, str(bad), "x int")
    with pytest.raises(Exception, match="7.0|FAILFAST|[Mm]alformed"):
        loaded.collect()


def test_csv_bad_value_aborts_a_narrow_read(spark, tmp_path):
    import pytest

    from loanlens.sources.files import read_raw_csv
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,x\n7.0,y\n")
    loaded = read_raw_csv(spark, str(bad), "a int, b string")
    for read in (loaded.count, loaded.select("b").collect):
        with pytest.raises(Exception, match="7.0|FAILFAST|[Mm]alformed"):
            read()


def test_csv_quotes_backslashes_and_line_breaks(spark, tmp_path):
    from loanlens.sources.files import read_raw_csv, write_raw_csv
    p = tmp_path / "q.csv"
    p.write_text('a,b\n1,"say ""hi"", ok"\n2,"end\\"\n')
    assert rows(read_raw_csv(spark, str(p), "a int, b string")) == [(1, 'say "hi", ok'), (2, "end\\")]
    broken = tmp_path / "m.csv"
    broken.write_text('a,b\n1,"two\nlines"\n')
    assert rows(read_raw_csv(spark, str(broken), "a int, b string", multi_line=True)) == [(1, "two\nlines")]
    data = [(1, 'a "b" c'), (2, None), (3, ""), (4, "x\\"), (5, "p,q")]
    write_raw_csv(spark.createDataFrame(data, "a int, b string"), str(tmp_path / "w"), "a int, b string, c int")
    got = rows(read_raw_csv(spark, str(tmp_path / "w"), "a int, b string, c int"))
    assert sorted(got) == [(a, b, None) for a, b in data]


def test_raw_layouts(spark):
    from pyspark.sql import types as T
    widths = {"raw_application_train": 122, "raw_installments_payments": 8, "raw_credit_card_balance": 23,
              "raw_pos_cash_balance": 8, "raw_bureau": 17}
    assert {n: len(T.StructType.fromDDL(ddl)) for n, ddl in schemas.RAW_SCHEMAS.items()} == widths


def test_describe_is_exact_in_integer_units(spark):
    """A25 with digits=1: count, mean, std from integer tenths; the std is
    within one ulp of the exact value and the quartiles equal NumPy's."""
    import random
    from decimal import Decimal, getcontext

    import numpy as np

    getcontext().prec = 50
    rng = random.Random(3)
    vals = [rng.randint(0, 1000) / 10 for _ in range(997)] + [None, None]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    r = quality.numeric_summary(df, "s", digits=1).first()
    xs = [v for v in vals if v is not None]
    units = [round(v * 10) for v in xs]
    n, s1, s2 = len(units), sum(units), sum(u * u for u in units)
    exact = (Decimal(n * s2 - s1 * s1) / Decimal(n * (n - 1))).sqrt() / 10
    assert r["count"] == n
    assert r["mean"] == s1 / (10.0 * n)
    assert abs(r["std"] - float(exact)) <= 2 * np.spacing(float(exact))
    assert r["min"] == min(xs) and r["max"] == max(xs)
    for name, p in (("q25", 25), ("q50", 50), ("q75", 75)):
        assert r[name] == float(np.percentile(xs, p))
    one = quality.numeric_summary(spark.createDataFrame([(1.5,)], "s double"), "s", digits=1).first()
    assert one["count"] == 1 and one["std"] is None
