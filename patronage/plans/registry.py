"""Registered queries: name -> (Spark callable (spark, sf_dir) -> DataFrame,
DuckDB oracle SQL or None).

Every query reads the driver tables in full. Continuous outputs are rounded
to 6 places on both sides so the oracle comparison does not hinge on
summation order.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort as coh
from ..operators import rfm
from ..operators.clv import estimate as CE
from ..operators.clv import models as M
from ..operators.clv import uncertainty as CU
from ..operators.clv.cells import cell_weights
from ..operators.clv.summary import clv_summary
from ..sources import tables as src
from . import sql as S

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ----------------------------------------------------------------- RFM ----

def _txn_rfm(spark, sf):
    return rfm.rfm_from_transactions(src.txn(spark, sf), "customer_id", "date", "amount",
                                     src.TXN_REFERENCE_DATE)


def _txn_segments(spark, sf):
    return rfm.segment_customers(rfm.rfm_scores(_txn_rfm(spark, sf)))


@register("rfm_metrics", f"WITH {S.rfm_cte()} SELECT customer_id, frequency, round(monetary, 6) AS monetary, recency FROM rfm")
def q_rfm_metrics(spark, sf):
    d = _txn_rfm(spark, sf)
    return d.select("customer_id", "frequency", r6("monetary").alias("monetary"), "recency")


@register("rfm_metrics_intraday",
          f"WITH {S.rfm_cte(S.PURCHASES, src.PURCHASES_REFERENCE_DATE)} "
          "SELECT customer_id, frequency, round(monetary, 6) AS monetary, recency FROM rfm")
def q_rfm_metrics_intraday(spark, sf):
    d = rfm.rfm_from_transactions(src.purchases(spark, sf), "customer_id", "date", "amount",
                                  src.PURCHASES_REFERENCE_DATE)
    return d.select("customer_id", "frequency", r6("monetary").alias("monetary"), "recency")


@register("rfm_scores", f"WITH {S.scores_cte()} SELECT customer_id, recency, frequency, "
          "R_score, F_score, M_score, RFM_score FROM seg")
def q_rfm_scores(spark, sf):
    return rfm.rfm_scores(_txn_rfm(spark, sf)).select(
        "customer_id", "recency", "frequency", "R_score", "F_score", "M_score", "RFM_score")


@register("rfm_segments", f"WITH {S.scores_cte()} SELECT customer_id, RFM_score, segment FROM seg")
def q_rfm_segments(spark, sf):
    return _txn_segments(spark, sf).select("customer_id", "RFM_score", "segment")


@register("rfm_segment_summary", f"""WITH {S.scores_cte()}
SELECT segment,
  round_even(avg(recency), 2) AS recency_mean, round_even(stddev_samp(recency), 2) AS recency_std,
  round_even(avg(frequency), 2) AS frequency_mean, round_even(stddev_samp(frequency), 2) AS frequency_std,
  round_even(avg(monetary), 2) AS monetary_mean, round_even(stddev_samp(monetary), 2) AS monetary_std,
  round_even(avg(RFM_score), 2) AS RFM_score_mean
FROM seg GROUP BY segment""")
def q_rfm_segment_summary(spark, sf):
    return rfm.segment_summary(_txn_segments(spark, sf))


@register("rfm_segment_distribution",
          f"WITH {S.scores_cte()} SELECT segment, COUNT(*) AS customers FROM seg GROUP BY segment")
def q_rfm_segment_distribution(spark, sf):
    return rfm.segment_distribution(_txn_segments(spark, sf))


@register("rfm_zscores", f"""WITH {S.rfm_cte()},
st AS (SELECT avg(recency) mr, stddev_samp(recency) sr, avg(frequency) mf, stddev_samp(frequency) sf,
              avg(monetary) mm, stddev_samp(monetary) sm FROM rfm)
SELECT customer_id, round((recency - mr) / sr, 6) AS recency, round((frequency - mf) / sf, 6) AS frequency,
       round((monetary - mm) / sm, 6) AS monetary FROM rfm, st""")
def q_rfm_zscores(spark, sf):
    z = rfm.rfm_zscores(_txn_rfm(spark, sf))
    return z.select("customer_id", *[r6(c).alias(c) for c in ("recency", "frequency", "monetary")])


# -------------------------------------------------------------- cohorts ----

def _cohort_sql(source, period):
    return (f"WITH {S.cohort_cte(source, period)} SELECT cohort, period_offset, cohort_size, active, "
            "round(revenue, 6) AS revenue, round(retention, 6) AS retention, round(arpu, 6) AS arpu FROM report")


def _cohort_spark(source_fn, period):
    def run(spark, sf):
        rep = coh.cohort_report(source_fn(spark, sf), period=period)
        return rep.select("cohort", "period_offset", "cohort_size", "active",
                          *[r6(c).alias(c) for c in ("revenue", "retention", "arpu")])
    return run


for _name, _src_fn, _src_sql, _p in (("cohort_monthly", src.txn, S.TXN, "M"),
                                     ("cohort_quarterly", src.txn, S.TXN, "Q"),
                                     ("cohort_weekly", src.purchases, S.PURCHASES, "W"),
                                     ("cohort_daily", src.purchases, S.PURCHASES, "D")):
    register(_name, _cohort_sql(_src_sql, _p))(_cohort_spark(_src_fn, _p))


@register("cohort_retention_wide", f"""WITH {S.cohort_cte(S.TXN, 'M')}
SELECT cohort, {', '.join(f"round(COALESCE(max(CASE WHEN period_offset = {i} THEN retention END), 0), 6) AS o{i}" for i in range(13))}
FROM report GROUP BY cohort""")
def q_cohort_retention_wide(spark, sf):
    w = coh.wide(coh.cohort_report(src.txn(spark, sf), period="M"), "retention", 12)
    return w.select("cohort", *[r6(f"o{i}").alias(f"o{i}") for i in range(13)])


@register("cohort_average_retention", f"""WITH {S.cohort_cte(S.TXN, 'M')}
SELECT period_offset, round(COALESCE(avg(CASE WHEN retention <> 0 THEN retention END), 0), 6) AS avg_retention
FROM report WHERE period_offset <= 12 GROUP BY period_offset""")
def q_cohort_average_retention(spark, sf):
    a = coh.average_retention(coh.cohort_report(src.txn(spark, sf), period="M"), 12)
    return a.select("period_offset", r6("avg_retention").alias("avg_retention"))


# ------------------------------------------------------------------ CLV ----
# Our own fixed test parameters (close to the fitted values on ``txn``) for
# the oracle-checked formulas; the fits themselves are separate queries.
BG_FIXED = M.BGNBDParams(r=2.4, alpha=480.0, a=1.2, b=140.0)
GG_FIXED = M.GammaGammaParams(p=570.0, q=1.8, gamma=570.0)


def _txn_summary(spark, sf):
    return clv_summary(src.txn(spark, sf))


@register("clv_summary", f"""WITH {S.clv_summary_cte()}
SELECT customer_id, frequency, T, recency, round(monetary_value, 6) AS monetary_value FROM s""")
def q_clv_summary(spark, sf):
    s = _txn_summary(spark, sf)
    return s.select("customer_id", "frequency", "T", "recency", r6("monetary_value").alias("monetary_value"))


@register("bgnbd_loglik", f"""WITH {S.clv_summary_cte()}
SELECT round(sum({S.bgnbd_ll_sql(BG_FIXED.r, BG_FIXED.alpha, BG_FIXED.a, BG_FIXED.b)}), 3) AS loglik FROM s""")
def q_bgnbd_loglik(spark, sf):
    d = CE.bgnbd_data(_txn_summary(spark, sf))
    return CE.bgnbd_loglik(d, BG_FIXED).select(F.round("loglik", 3).alias("loglik"))


@register("gg_loglik", f"""WITH {S.clv_summary_cte()}
SELECT round(sum({S.gg_ll_sql(GG_FIXED.p, GG_FIXED.q, GG_FIXED.gamma)}), 3) AS loglik FROM s WHERE frequency >= 1""")
def q_gg_loglik(spark, sf):
    d = CE.gg_data(_txn_summary(spark, sf))
    return CE.gg_loglik(d, GG_FIXED).select(F.round("loglik", 3).alias("loglik"))


@register("bgnbd_predict", f"""WITH {S.clv_summary_cte()},
{S.expected_purchases_cte(BG_FIXED.r, BG_FIXED.alpha, BG_FIXED.a, BG_FIXED.b, 365.0)}
SELECT customer_id, round(p_alive, 6) AS p_alive, round(expected_purchases, 6) AS expected_purchases_365d FROM ep""")
def q_bgnbd_predict(spark, sf):
    out = CE.score(_txn_summary(spark, sf), BG_FIXED, None, purchases_t=365.0)
    return out.select("customer_id", r6("p_alive").alias("p_alive"),
                      r6("expected_purchases_365d").alias("expected_purchases_365d"))


_P, _Q, _G = GG_FIXED.p, GG_FIXED.q, GG_FIXED.gamma


@register("gg_expected_spend", f"""WITH {S.clv_summary_cte()}
SELECT customer_id, round({_P} * ({_G} + frequency * monetary_value) / ({_P} * frequency + {_Q} - 1), 6) AS expected_spend
FROM s""")
def q_gg_expected_spend(spark, sf):
    out = CE.score(_txn_summary(spark, sf), BG_FIXED, GG_FIXED)
    return out.select("customer_id", r6("expected_spend").alias("expected_spend"))


@register("gg_expected_spend_reference", f"""WITH {S.clv_summary_cte()}
SELECT customer_id, round(({_P} * frequency * monetary_value + {_G} * ({_Q} - 1) * ({_G} * {_P} / ({_Q} - 1)))
                          / greatest({_P} * frequency + {_Q} - 1, 1e-9), 6) AS expected_spend FROM s""")
def q_gg_expected_spend_reference(spark, sf):
    """The reference library's own spend formula (gamma * (q - 1) * m_bar
    with m_bar = gamma p / (q - 1)), kept as ``formula='reference'``."""
    out = CE.score(_txn_summary(spark, sf), BG_FIXED, GG_FIXED, formula="reference")
    return out.select("customer_id", r6("expected_spend").alias("expected_spend"))


_CLV_FIXED = f"""WITH {S.clv_summary_cte()},
{S.expected_purchases_cte(BG_FIXED.r, BG_FIXED.alpha, BG_FIXED.a, BG_FIXED.b, 365.0)}
SELECT customer_id, round(expected_purchases * {_P} * ({_G} + frequency * monetary_value)
                          / ({_P} * frequency + {_Q} - 1), 0) AS clv_365d FROM ep"""


@register("clv_fixed_params", _CLV_FIXED)
def q_clv_fixed_params(spark, sf):
    out = CE.score(_txn_summary(spark, sf), BG_FIXED, GG_FIXED, horizon=365.0)
    return out.select("customer_id", F.round("clv_365d", 0).alias("clv_365d"))


_DESCRIBED = {"count": "COUNT({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
              "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)",
              "max": "max({c})"}


@register("clv_describe", f"WITH c AS ({_CLV_FIXED}) " + " UNION ALL ".join(
    f"SELECT '{name}' AS statistic, round(CAST({call.format(c='clv_365d')} AS DOUBLE), 4) AS clv_365d FROM c"
    for name, call in _DESCRIBED.items()))
def q_clv_describe(spark, sf):
    """The describe table of all customers' values."""
    out = CU.describe(q_clv_fixed_params(spark, sf))
    return out.select("statistic", F.round("clv_365d", 4).alias("clv_365d"))


@register("clv_discounted", f"""WITH {S.clv_summary_cte()},
{S.expected_purchases_cte(BG_FIXED.r, BG_FIXED.alpha, BG_FIXED.a, BG_FIXED.b, 180.0)}
SELECT customer_id, round(expected_purchases * {_P} * ({_G} + frequency * monetary_value)
                          / ({_P} * frequency + {_Q} - 1) / pow(1.1, 180.0 / 365.0), 0) AS clv_180d FROM ep""")
def q_clv_discounted(spark, sf):
    """Half a year's value at a yearly discount of 10 %."""
    out = CE.score(_txn_summary(spark, sf), BG_FIXED, GG_FIXED, horizon=180.0, discount_rate=0.1)
    return out.select("customer_id", F.round("clv_180d", 0).alias("clv_180d"))


@register("bgnbd_fit")
def q_bgnbd_fit(spark, sf):
    s = _txn_summary(spark, sf).persist()
    bg, gg = CE.fit_both(s)
    s.unpersist()
    return CE.params_frame(spark, bg, gg)


@register("clv_fitted")
def q_clv_fitted(spark, sf):
    s = _txn_summary(spark, sf).persist()
    bg, gg = CE.fit_both(s)
    return CE.score(s, bg, gg, horizon=365.0, purchases_t=30.0).drop("first_purchase", "last_purchase")


@register("bootstrap_cell_weights", f"""WITH {S.clv_summary_cte()},
c AS (SELECT frequency, recency, T, COUNT(*) AS n FROM s GROUP BY ALL),
d AS (SELECT n, greatest(0, CAST(trunc(n - 12 * sqrt(n) - 12) AS BIGINT)) AS low, CAST(trunc(n + 12 * sqrt(n) + 40) AS BIGINT) AS high
      FROM (SELECT DISTINCT n FROM c)),
p AS (SELECT n, low, k, exp(k * ln(n) - n - lgamma(k + 1)) AS p FROM (SELECT n, low, unnest(range(low, high + 1)) AS k FROM d)),
f AS (SELECT n, low, sum(p) OVER (PARTITION BY n ORDER BY k) / sum(p) OVER (PARTITION BY n) AS f FROM p),
u AS (SELECT *, ('0x' || substr(md5(frequency::VARCHAR || ':' || recency::VARCHAR || ':' || T::VARCHAR || ':' || replicate::VARCHAR
        || ':42'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM c, (SELECT unnest(range(10)) AS replicate))
SELECT frequency, recency, T, replicate::INTEGER AS replicate, CAST(min(low) + COUNT(*) FILTER (WHERE f <= u) AS BIGINT) AS weight
FROM u JOIN f USING (n) GROUP BY frequency, recency, T, replicate""")
def q_bootstrap_cell_weights(spark, sf):
    """Poisson bootstrap weights of ten replicates for each distinct (x, t_x, T)."""
    keys = ["frequency", "recency", "T"]
    cells = _txn_summary(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return cell_weights(cells, keys, 10, 42).select(*keys, F.posexplode("weights").alias("replicate", "weight"))


@register("clv_bootstrap")
def q_clv_bootstrap(spark, sf):
    s = _txn_summary(spark, sf).persist()
    per_customer, _totals = CU.bootstrap_clv(s, horizon=365.0, n_bootstrap=100, alpha=0.05, seed=42)
    return per_customer


@register("clv_bootstrap_totals")
def q_clv_bootstrap_totals(spark, sf):
    """The result record (V11): replicate count, failures, total CLV mean and
    interval, customers."""
    s = _txn_summary(spark, sf).persist()
    _per_customer, totals = CU.bootstrap_clv(s, horizon=365.0, n_bootstrap=100, alpha=0.05, seed=42)
    return totals


@register("clv_perturbation", S.perturbation_sql(CU.perturbation_draws(BG_FIXED, GG_FIXED, 200, 0.05, 42), 365.0))
def q_clv_perturbation(spark, sf):
    out = CU.parameter_perturbation_clv(BG_FIXED, GG_FIXED, _txn_summary(spark, sf), horizon=365.0,
                                        n_perturbations=200, relative_noise=0.05, seed=42)
    return out.select("customer_id", *[F.round(c, -1).alias(c) for c in ("clv_mean", "clv_p05", "clv_p95")],
                      F.round("clv_std", 0).alias("clv_std"))


def _load_all():
    from . import registry_more  # noqa: F401  (registers the remaining queries)


def queries() -> dict:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
