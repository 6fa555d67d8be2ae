import datetime as dt

import pytest

from patronage.operators import cohort as coh


def _txn(spark):
    data = {"A1": ["01-15", "02-20", "03-10", "04-05"], "A2": ["01-20", "02-15"], "B1": ["02-10", "03-15", "04-20"],
            "B2": ["02-22"], "C1": ["03-08", "04-09"]}
    amount = {"A1": 100.0, "A2": 50.0, "B1": 80.0, "B2": 60.0, "C1": 90.0}
    rows = [(c, dt.datetime.strptime(f"2024-{d}", "%Y-%m-%d"), amount[c]) for c, ds in data.items() for d in ds]
    return spark.createDataFrame(rows, "customer_id string, date timestamp, amount double")


def test_sizes_retention_arpu(spark):
    rep = coh.cohort_report(_txn(spark), period="M").toPandas()
    sizes = rep.drop_duplicates("cohort").sort_values("cohort").cohort_size.tolist()
    assert sizes == [2, 2, 1]
    jan = rep[rep.cohort == dt.date(2024, 1, 1)].sort_values("period_offset")
    assert jan.retention.tolist() == [1.0, 1.0, 0.5, 0.5]
    assert jan.arpu.iloc[0] == 75.0
    assert (rep[rep.period_offset == 0].retention == 1.0).all()


def test_wide_and_average(spark):
    rep = coh.cohort_report(_txn(spark), period="M")
    w = coh.wide(rep, "retention", 3).toPandas()
    assert len(w) == 3 and list(w.columns) == ["cohort", "o0", "o1", "o2", "o3"]
    avg = {r.period_offset: r.avg_retention for r in coh.average_retention(rep, 12).collect()}
    assert avg[0] == 1.0


def test_bad_period(spark):
    with pytest.raises(ValueError):
        coh.cohort_report(_txn(spark), period="X")


def test_partition_independence(spark):
    from patronage.sources import tables
    t = tables.txn(spark, "/root/testdata/sf0.001")
    a = coh.cohort_report(t.repartition(1), period="M").orderBy("cohort", "period_offset").collect()
    b = coh.cohort_report(t.repartition(5), period="M").orderBy("cohort", "period_offset").collect()
    assert [(r.cohort, r.period_offset, r.active, r.cohort_size) for r in a] == \
           [(r.cohort, r.period_offset, r.active, r.cohort_size) for r in b]
    assert all(abs(x.revenue - y.revenue) < 1e-6 for x, y in zip(a, b))
