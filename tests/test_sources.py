import os
import tempfile

from patronage.operators import rfm
from patronage.sources import files, tables


def test_csv_roundtrip_mapping_and_dates(spark):
    orders = tables.table(spark, "/root/testdata/sf0.001", "orders")
    folder = tempfile.mkdtemp(prefix="patronage-csv-")
    out = os.path.join(folder, "orders_csv")
    orders.select("o_custkey", "o_orderdate", "o_totalprice").write.option("header", True).csv(out)
    df = files.read_csv(spark, out, "o_custkey long, o_orderdate string, o_totalprice double")
    df = files.map_columns(df, {"customer_id": "o_custkey", "transaction_date": "o_orderdate", "amount": "o_totalprice"})
    df = files.parse_dates(df, "transaction_date")
    head, shape = files.preview(df)
    assert head.count() == 5 and shape == (orders.count(), 3)
    a = rfm.rfm_from_transactions(df, reference_date=tables.TXN_REFERENCE_DATE).orderBy("customer_id").collect()
    b = rfm.rfm_from_transactions(tables.txn(spark, "/root/testdata/sf0.001"), "customer_id", "date", "amount",
                                  tables.TXN_REFERENCE_DATE).orderBy("customer_id").collect()
    assert [(r.customer_id, r.frequency, r.recency) for r in a] == [(r.customer_id, r.frequency, r.recency) for r in b]
    inferred = files.read_csv(spark, out)
    assert len(inferred.columns) == 3


def test_bootstrap_record(spark):
    from patronage.operators.clv import uncertainty as U
    from patronage.operators.clv.summary import clv_summary
    s = clv_summary(tables.txn(spark, "/root/testdata/sf0.001")).persist()
    per, tot = U.bootstrap_clv(s, n_bootstrap=12, seed=1)
    assert set(per.columns) == {"customer_id", "clv_mean", "clv_p02", "clv_p50", "clv_p97", "clv_std"}
    t = tot.first()
    assert t.n_bootstrap + t.n_failed == 12 and t.total_clv_ci_low <= t.total_clv_mean <= t.total_clv_ci_high
    p = per.toPandas()
    assert (p.clv_p02 <= p.clv_p50 + 1e-9).all() and (p.clv_p50 <= p.clv_p97 + 1e-9).all()
    assert U.describe(per).count() == 8
