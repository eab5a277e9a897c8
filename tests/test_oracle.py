"""Every registered query against its DuckDB statement on the smallest data."""

import os

import pytest

import __spark_entry__ as E
from compare import compare, duck
from loanlens.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# the lending queries; those over documents have tests of their own
QUERIES = {n: f for n, f in E.queries().items() if n in catalog.QUERIES}
ORACLE = {n: s for n, s in E.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# Physical operators no registered query may contain: pair-producing joins
# and row-at-a-time Python evaluation.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _forbidden_operators(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [op for op in FORBIDDEN if op in plan]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    problems = compare(df, con, ORACLE[name])
    assert not problems, problems
    assert not _forbidden_operators(df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_model_query_plans(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
    assert not _forbidden_operators(df)


def test_no_checked_query_is_empty(spark):
    """Green rows prove something: every branch of the rules occurs."""
    for name in ("duplicate_customer_keys", "bureau_key_violations", "eligible_by_income",
                 "eligible_by_occupation_type", "eligible_by_name_education_type"):
        assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0, name
    assert QUERIES["dpd_bucket_counts"](spark, "/root/testdata/sf0.01").count() == 5


def test_fitted_model_values(spark):
    """M1-M5, M7-M9 agree with each other and with a brute-force AUC over the scored test rows."""
    from loanlens.plans import catalog_scoring
    rows, _ = catalog_scoring._model_test_rows(spark, SF)
    pairs = [(r[0], r[1], r[2]) for r in rows.select("risk_probability", "target", "prediction").collect()]
    pos, neg = [p for p, t, _ in pairs if t == 1], [p for p, t, _ in pairs if t == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = QUERIES["risk_model_evaluation"](spark, SF).first()
    assert abs(got.auc - auc) < 1e-9
    assert abs(got.ks - max(sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg)
                            for t, _, _ in pairs)) < 1e-9
    assert all(c == int(p > 0.5) for p, _, c in pairs)
    matrix = {r.actual: (r.predicted_0, r.predicted_1)
              for r in QUERIES["risk_model_confusion_matrix"](spark, SF).collect()}
    assert matrix == {t: (sum(c == 0 for _, y, c in pairs if y == t), sum(c == 1 for _, y, c in pairs if y == t))
                      for t in (0, 1)}
    report = {r["class"]: r for r in QUERIES["risk_model_classification_report"](spark, SF).collect()}
    assert abs(report["accuracy"].f1_score - sum(c == t for _, t, c in pairs) / len(pairs)) < 1e-9


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert all(n.startswith(("risk_model", "risk_drivers", "model_")) for n in set(QUERIES) - set(ORACLE))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["sk_id_curr", "target"] and len(df.columns) == 35
    assert df.count() > 0
