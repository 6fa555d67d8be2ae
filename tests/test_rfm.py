import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.operators import rfm


def _txn(spark):
    rows = [(1, dt.datetime(2025, 1, 1), 100.0), (1, dt.datetime(2025, 1, 2), 150.0), (1, dt.datetime(2025, 1, 3), 200.0),
            (2, dt.datetime(2025, 1, 4), 80.0), (2, dt.datetime(2025, 1, 5), 120.0), (3, dt.datetime(2025, 1, 6), 300.0)]
    return spark.createDataFrame(rows, "customer_id long, transaction_date timestamp, amount double")


def test_rfm_from_transactions_hand_values(spark):
    out = {r.customer_id: r for r in rfm.rfm_from_transactions(_txn(spark), reference_date="2025-01-10").collect()}
    assert out[1].frequency == 3 and out[1].monetary == 450.0 and out[1].recency == 7
    assert out[3].recency == 4


def test_whole_days_not_calendar_days(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 23, 0), 1.0)]
    df = spark.createDataFrame(rows, "customer_id long, transaction_date timestamp, amount double")
    r = rfm.rfm_from_transactions(df, reference_date="2024-01-02 01:00:00").first()
    assert r.recency == 0


def _random_rfm(spark, n=100, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.exponential(30)), int(rng.poisson(5) + 1), float(rng.lognormal(3, 1))) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id long, recency long, frequency long, monetary double")


def _expected_bins(values, ids, reverse=False):
    order = sorted(range(len(values)), key=lambda i: (values[i], ids[i]))
    n = len(values)
    out = [0] * n
    for rn, i in enumerate(order, start=1):
        b = max(1, math.ceil(5 * (rn - 1) / (n - 1)))
        out[i] = 6 - b if reverse else b
    return out


def test_scores_match_qcut_rule_and_ranges(spark):
    df = _random_rfm(spark)
    pdf = df.toPandas()
    got = rfm.rfm_scores(df).toPandas().sort_values("customer_id").reset_index(drop=True)
    pdf = pdf.sort_values("customer_id").reset_index(drop=True)
    assert list(got.R_score) == _expected_bins(list(pdf.recency), list(pdf.customer_id), reverse=True)
    assert list(got.F_score) == _expected_bins(list(pdf.frequency), list(pdf.customer_id))
    assert list(got.M_score) == _expected_bins(list(pdf.monetary), list(pdf.customer_id))
    assert got.RFM_score.between(3, 15).all()


def test_single_row_scores_three(spark):
    df = spark.createDataFrame([(1, 30, 1, 100.0)], "customer_id long, recency long, frequency long, monetary double")
    r = rfm.rfm_scores(df).first()
    assert (r.R_score, r.F_score, r.M_score) == (3, 3, 3)


def test_missing_values_fall_back_to_three(spark):
    rows = [(i, None if i == 0 else i, None if i == 1 else i, None if i == 2 else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "customer_id long, recency long, frequency long, monetary double")
    got = rfm.rfm_scores(df).collect()
    assert all(r.R_score == 3 and r.F_score == 3 and r.M_score == 3 for r in got)


def test_empty_frame(spark):
    df = spark.createDataFrame([], "customer_id long, recency long, frequency long, monetary double")
    assert rfm.rfm_scores(df).count() == 0


def test_segments_partition_customers_and_rules(spark):
    seg = rfm.segment_customers(rfm.rfm_scores(_random_rfm(spark, 200, 3))).toPandas()
    assert len(seg) == 200 and set(seg.segment) <= set(rfm.SEGMENTS)
    champs = seg[seg.segment == "Champions"]
    assert ((champs.R_score >= 4) & (champs.F_score >= 4) & (champs.M_score >= 4)).all()
    dist = rfm.segment_distribution(seg.pipe(lambda p: spark.createDataFrame(p))).toPandas()
    assert dist.customers.sum() == 200


def test_partition_independence(spark):
    df = _random_rfm(spark, 150, 5)
    a = rfm.rfm_scores(df.repartition(1)).orderBy("customer_id").collect()
    b = rfm.rfm_scores(df.repartition(7)).orderBy("customer_id").collect()
    assert a == b


def test_zscores_sample_std(spark):
    z = rfm.rfm_zscores(_random_rfm(spark)).toPandas()
    assert abs(z.recency.mean()) < 1e-9 and abs(z.recency.std(ddof=1) - 1) < 1e-9


def test_bad_method(spark):
    with pytest.raises(ValueError):
        rfm.rfm_scores(_random_rfm(spark), method="custom")
