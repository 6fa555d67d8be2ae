import __spark_entry__ as E
from patronage.plans import registry


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 70
    assert all(callable(f) for f in q.values()) and all(isinstance(v, str) and v.strip() for v in o.values())
    own = registry.queries()
    assert set(own) <= set(q) and not any(k.startswith("op") and k[2:3].isdigit() for k in own)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["segment", "recency_mean", "recency_std", "frequency_mean", "frequency_std",
                          "monetary_mean", "monetary_std", "RFM_score_mean"]
    assert df.count() >= 0
