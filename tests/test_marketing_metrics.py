import itertools

import numpy as np

from patronage.operators import marketing as MK
from patronage.operators import metrics as ME


def test_campaign_budget_and_timeline(spark):
    plan = MK.campaign_plan(spark, ["Champions", "Loyal Customers", "At Risk"], 90000, 60).toPandas()
    assert abs(plan.budget_allocation.sum() - 90000) < 1e-9
    assert MK.campaign_plan(spark, ["Champions"], None).first().budget_allocation is None
    tl = MK.campaign_timeline(spark, 60).orderBy("phase_index").collect()
    assert tl[0].start_day == 1 and tl[-1].end_day == 60
    assert all(a.end_day + 1 == b.start_day for a, b in zip(tl, tl[1:]))


def test_unknown_entries(spark):
    df = spark.createDataFrame([(1, "Champions", 100.0, 5)], "customer_id long, segment string, monetary double, frequency long")
    assert "error" in MK.segment_strategy(df, "Nope").columns
    assert "error" in MK.ab_test_plan(spark, "nope").columns
    s = MK.segment_strategy(df, "Champions").first()
    assert s.customer_count == 1 and s.avg_monetary == 100.0


def test_recommendations(spark):
    df = spark.createDataFrame([(1, "Champions", 3, 6, 50.0), (2, None, 100, 1, 10.0)],
                               "customer_id long, segment string, recency long, frequency long, monetary double")
    rec = {r.customer_id: r.recommendations for r in MK.personal_recommendations(df).collect()}
    assert rec[1][0] == MK.RULE_TEXTS[0] and rec[1][1:] == MK.SEGMENT_STRATEGIES["Champions"]["strategies"][:2]
    assert rec[2][0] == MK.RULE_TEXTS[3] and len(rec[2]) == 3


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200), 1)  # heavy ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label long, score double")
    got = ME.auc_frame(df).first().roc_auc
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)])
    assert abs(got - brute) < 1e-12
