import os
import tempfile

from patronage.operators import rfm
from patronage.sources import tables as src
from patronage.streaming import rfm_stream as RS

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    schema = spark.read.parquet(os.path.join(SF, "events.parquet")).schema.simpleString()[len("struct<"):-1]
    schema = schema.replace(":", " ")
    folder = tempfile.mkdtemp(prefix="patronage-stream-")
    os.symlink(os.path.join(SF, "events.parquet"), os.path.join(folder, "part-0.parquet"))
    target = tempfile.mkdtemp(prefix="patronage-sink-")
    q = RS.start(RS.purchase_stream(spark, folder, schema), target, tempfile.mkdtemp(prefix="patronage-sckpt-"),
                 available_now=True)
    q.awaitTermination(120)
    got = RS.with_recency(RS.snapshot(spark, target), src.PURCHASES_REFERENCE_DATE)
    want = rfm.rfm_from_transactions(src.purchases(spark, SF), "customer_id", "date", "amount",
                                     src.PURCHASES_REFERENCE_DATE)
    cols = ["customer_id", "frequency", "recency"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
