from decimal import Decimal

import numpy as np
import pytest

from patronage.functions.scaling import zscore
from patronage.operators.clv.summary import clv_summary
from patronage.operators.cohort import cohort_report
from patronage.operators.dbscan import dbscan
from patronage.operators.features import folds, impute_median, split
from patronage.operators.metrics import classification_metrics, regression_metrics
from patronage.operators import order_stats
from patronage.operators.order_stats import quantiles, select_ranks
from patronage.operators.rfm import rfm_from_transactions, rfm_scores
from pyspark.sql import functions as F

NAN = float("nan")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    cols = {"ties": rng.integers(0, 5, 400).astype(float), "spread": rng.lognormal(0, 8, 400),
            "holes": np.where(rng.random(400) < 0.3, np.nan, rng.normal(size=400)), "same": np.full(400, 2.5)}
    rows = [tuple(None if np.isnan(v[i]) and i % 2 else float(v[i]) for v in cols.values()) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, list(cols), probs)
    for c, v in cols.items():
        assert np.allclose(got[c], np.nanquantile(v, probs), rtol=1e-12, atol=0)
    assert quantiles(df.where("false"), ["ties"], [0.5]) == {"ties": [None]}
    assert select_ranks(df, {"x": (None, "ties", 400)}) == {"x": None}


@pytest.mark.parametrize(("grid", "margin"), [(1000, 2), (4, 0)])
def test_ranks_with_ids_of_any_type(spark, monkeypatch, grid, margin):
    """Large numbers, strings with a shared head, repeated and null ids; brackets that miss are widened."""
    monkeypatch.setattr(order_stats, "GRID", grid)
    monkeypatch.setattr(order_stats, "MARGIN", margin)
    rng = np.random.default_rng(4)
    value = [float(x) for x in rng.choice([1.0, 1.0, 1.0, 2.0, 7.5, -3.0], 900)]
    for kind, ids in (("long", [2**60 + int(i) for i in rng.permutation(900)]),
                      ("string", ["customer-%07d" % i for i in rng.permutation(900)]),
                      ("string", [None if i == 3 else "é" * (i % 5) + str(i // 2) for i in range(900)]),
                      ("decimal(20,0)", [Decimal(2**60 + int(i)) for i in rng.permutation(900)])):
        df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, value)], f"who {kind}, value double, id string").repartition(6)
        want = sorted(zip(value, ids), key=lambda r: (r[0], r[1] is not None, r[1].encode() if isinstance(r[1], str) else r[1]))
        ranks = [0, 1, 100, 449, 450, 700, 898, 899]
        got = select_ranks(df, {r: (None, "value", r) for r in ranks}, "who")
        assert [got[r] for r in ranks] == [want[r] for r in ranks]


def test_scores_of_large_ids_and_jobs(spark):
    """All ties: 200 customers a score; ids beyond 2^53 are told apart, and the log is read once."""
    for kind, ids in (("long", [2**60 + i for i in range(1000)]), ("string", ["%020d" % (2**60 + i) for i in range(1000)])):
        df = spark.createDataFrame([(i, 1, 2, 3.0) for i in ids], f"customer_id {kind}, recency long, frequency long, monetary double")
        got = rfm_scores(df).orderBy("customer_id").collect()
        assert [r.F_score for r in got] == [1 + sum(i > j * 999 // 5 for j in range(1, 5)) for i in range(1000)]
        assert [r.R_score for r in got] == [6 - r.F_score for r in got]
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        read.add(1)
        return x
    rfm_scores(df.withColumn("frequency", seen("frequency"))).count()
    assert read.value == 1000


def test_nan_counts_as_missing(spark):
    txn = spark.createDataFrame([(1, "2024-01-01", 10.0), (1, "2024-01-05", NAN), (2, "2024-02-01", 5.0)],
                                "customer_id long, date string, amount double").withColumn("date", F.to_timestamp("date"))
    m = {r.customer_id: r for r in rfm_from_transactions(txn, "customer_id", "date", "amount", "2024-03-01").collect()}
    assert m[1].monetary == 10.0 and m[1].frequency == 2
    assert {r.customer_id: r.monetary_value for r in clv_summary(txn, observation_end="2024-03-01").collect()}[1] == 10.0
    assert not any(np.isnan(r.revenue) for r in cohort_report(txn).collect())
    x = spark.createDataFrame([(1, 1.0), (2, NAN), (3, 3.0)], "id long, v double")
    assert [r.v for r in zscore(x, ["v"], keep=["id"]).orderBy("id").collect()][1] is None
    assert {r.id: r.v for r in impute_median(x, ["v"]).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}


def test_scores_break_ties_by_id(spark):
    for ids in (list(range(23)), ["c%02d" % i for i in range(23)]):
        kind = "long" if isinstance(ids[0], int) else "string"
        df = spark.createDataFrame([(i, 1, 2, 3.0) for i in ids],
                                   f"customer_id {kind}, recency long, frequency long, monetary double")
        got = [r.F_score for r in rfm_scores(df).orderBy("customer_id").collect()]
        want = [1 + sum(i > j * 22 // 5 for j in range(1, 5)) for i in range(23)]
        assert got == want


def test_one_class_and_constant_labels_give_null(spark):
    p = spark.createDataFrame([(1.0, 1.0, 0.9), (1.0, 0.0, 0.2)], "label double, prediction double, score double")
    assert classification_metrics(p).first().roc_auc is None
    assert regression_metrics(p).first().r2 is None
    assert classification_metrics(p.where("false")).first().accuracy is None


def test_split_and_folds_are_stratified(spark):
    df = spark.createDataFrame([(i, 1 if i % 17 == 0 else 0) for i in range(200)], "id long, y int")
    a = split(df, "id", 0.2, exact=True, stratify="y").repartition(7)
    assert a.where("is_test").count() == 40 and a.where("is_test AND y = 1").count() in (2, 3)
    f = folds(df, "id", 5, stratify="y").groupBy("fold", "y").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in f if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_dbscan_keeps_rows_with_missing_values(spark):
    rows = [(i, float(i % 4) * 0.1, 1.0) for i in range(30)] + [(30, None, 1.0), (31, NAN, 1.0)]
    df = spark.createDataFrame(rows, "customer_id long, a double, b double")
    for parts in (1, 8):
        got = dbscan(df.repartition(parts), ["a", "b"]).collect()
        assert len(got) == 32 and {r.cluster for r in got} == {0}
