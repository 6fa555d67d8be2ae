"""Registered queries, part two: marketing, page numbers, clustering,
supervised models and explanations."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scaling import zscore
from ..operators import clustering as CL
from ..operators import dbscan as DB
from ..operators import hierarchical as HC
from ..operators import explain as EX
from ..operators import features as FE
from ..operators import kmeans_chains as KC
from ..operators import kpi
from ..operators import linear_cv as LC
from ..operators import marketing as MK
from ..operators import metrics as ME
from ..operators import rfm
from ..operators import shapley as SH
from ..operators import single_linkage as SL
from ..operators import supervised as SU
from ..sources import files
from ..sources import tables as src
from ..storage import kept, kept_csv
from . import sql as S
from .registry import _txn_rfm, _txn_segments, r6, register


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strategy_values() -> str:
    rows = []
    for seg, v in MK.SEGMENT_STRATEGIES.items():
        rows.append(f"({_q(seg)}, {_q(v['description'])}, {_q('|'.join(v['strategies']))}, "
                    f"{_q('|'.join(v['channels']))}, {_q(v['budget_priority'])}, {_q(v['expected_roi'])}, "
                    f"{_q(v['strategies'][0])}, {_q(v['strategies'][1])})")
    return ("strat(segment, description, strategies, channels, budget_priority, expected_roi, s1, s2) AS "
            f"(VALUES {', '.join(rows)})")


SEG = S.scores_cte()

# ------------------------------------------------------------ marketing ----


@register("segment_strategy", f"""WITH {SEG}, {_strategy_values()},
st AS (SELECT segment, COUNT(*) AS customer_count, avg(monetary) AS m, avg(frequency) AS f FROM seg GROUP BY segment)
SELECT strat.segment, description, strategies, channels, budget_priority, expected_roi, customer_count,
       round(m, 4) AS avg_monetary, round(f, 6) AS avg_frequency
FROM strat LEFT JOIN st ON strat.segment = st.segment""")
def q_segment_strategy(spark, sf):
    out = MK.segment_strategy(_txn_segments(spark, sf))
    return out.select("segment", "description", F.concat_ws("|", "strategies").alias("strategies"),
                      F.concat_ws("|", "channels").alias("channels"), "budget_priority", "expected_roi",
                      "customer_count", F.round("avg_monetary", 4).alias("avg_monetary"),
                      r6("avg_frequency").alias("avg_frequency"))


CAMPAIGN = (["Champions", "Loyal Customers", "At Risk"], 90000.0, 60)


@register("campaign_plan", f"""WITH {SEG}, {_strategy_values()},
plan AS (SELECT * FROM strat WHERE segment IN ({', '.join(_q(s) for s in CAMPAIGN[0])})),
tg AS (SELECT segment, COUNT(*) AS n, sum(monetary) AS m FROM seg GROUP BY segment)
SELECT plan.segment, description, strategies, channels, {CAMPAIGN[1] / len(CAMPAIGN[0])} AS budget_allocation,
       budget_priority AS priority, COALESCE(tg.n, 0) AS target_customers, round(COALESCE(tg.m, 0), 4) AS target_monetary
FROM plan LEFT JOIN tg ON plan.segment = tg.segment""")
def q_campaign_plan(spark, sf):
    segs = _txn_segments(spark, sf)
    plan = MK.campaign_plan(spark, CAMPAIGN[0], CAMPAIGN[1], CAMPAIGN[2])
    tg = MK.campaign_targets(segs, plan).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("monetary").alias("m"))
    return plan.join(tg, "segment", "left").select(
        "segment", "description", F.concat_ws("|", "strategies").alias("strategies"),
        F.concat_ws("|", "channels").alias("channels"), "budget_allocation", "priority",
        F.coalesce("n", F.lit(0).cast("long")).alias("target_customers"),
        F.round(F.coalesce("m", F.lit(0.0)), 4).alias("target_monetary"))


def _unit(*parts) -> str:
    """SQL of ``features.hash_unit``."""
    text = " || ':' || ".join(f"{x}::VARCHAR" for x in parts)
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0)"


@register("ab_test_assignment", f"""WITH {SEG}
SELECT customer_id, segment, 'discount' AS test_type,
       CASE WHEN {_unit('customer_id', "'discount'", 42)} < 0.5 THEN 'A' ELSE 'B' END AS variant
FROM seg WHERE segment = 'At Risk'""")
def q_ab_test_assignment(spark, sf):
    return MK.ab_assignment(_txn_segments(spark, sf), "discount", "At Risk", seed=42)


@register("personal_recommendations", f"""WITH {SEG}, {_strategy_values()}
SELECT seg.customer_id, seg.segment, concat_ws('|',
    CASE WHEN recency < 7 AND frequency > 5 THEN {_q(MK.RULE_TEXTS[0])}
         WHEN recency < 30 AND monetary > 500 THEN {_q(MK.RULE_TEXTS[1])}
         WHEN recency > 60 AND frequency > 3 THEN {_q(MK.RULE_TEXTS[2])}
         WHEN frequency = 1 THEN {_q(MK.RULE_TEXTS[3])} END, strat.s1, strat.s2) AS recommendations
FROM seg LEFT JOIN strat ON seg.segment = strat.segment""")
def q_personal_recommendations(spark, sf):
    out = MK.personal_recommendations(_txn_segments(spark, sf))
    return out.select("customer_id", "segment", F.concat_ws("|", "recommendations").alias("recommendations"))


@register("marketing_report_distribution", f"""WITH {SEG}
SELECT segment, COUNT(*) AS customers, round(avg(monetary), 4) AS avg_value FROM seg GROUP BY segment""")
def q_marketing_report_distribution(spark, sf):
    d = MK.report_distribution(_txn_segments(spark, sf))
    return d.select("segment", "customers", F.round("avg_value", 4).alias("avg_value"))


@register("marketing_report_summary", f"""WITH {SEG},
tot AS (SELECT COUNT(*) AS total_customers,
             CAST(sum(CASE WHEN segment IN ('Champions', 'Loyal Customers') THEN 1 ELSE 0 END) AS BIGINT) AS high_value,
             CAST(sum(CASE WHEN segment IN ('At Risk', 'Lost') THEN 1 ELSE 0 END) AS BIGINT) AS at_risk FROM seg)
SELECT total_customers, high_value, at_risk, round(high_value / total_customers * 100, 6) AS high_value_share,
       '总客户数：' || format('{{:,}}', total_customers) || '。高价值客户占比：' || printf('%.1f', high_value / total_customers * 100)
       || '%。建议重点关注 Champions, Loyal Customers 群体的维护和增值。' AS executive_summary FROM tot""")
def q_marketing_report_summary(spark, sf):
    s = MK.report_summary(_txn_segments(spark, sf))
    return s.select("total_customers", "high_value", "at_risk", r6("high_value_share").alias("high_value_share"),
                    "executive_summary")


# --------------------------------------------------------- page numbers ----

LABELLED_SQL = f"""t AS ({S.TXN}),
fe AS (SELECT customer_id, COUNT(*) AS frequency, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS monetary,
              {S.days(f"TIMESTAMP '{src.TXN_LABEL_CUT}'", 'max(date)')} AS recency
       FROM t WHERE customer_id IS NOT NULL AND date < TIMESTAMP '{src.TXN_LABEL_CUT}' GROUP BY customer_id),
af AS (SELECT customer_id, sum(amount) AS ltv, COUNT(*) AS n FROM t WHERE date >= TIMESTAMP '{src.TXN_LABEL_CUT}' GROUP BY 1),
attr AS (SELECT c_custkey AS customer_id, r_name AS region, c_mktsegment AS mktsegment, c_acctbal AS acctbal
       FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) nr
       ON c_nationkey = nr.n_nationkey),
lc AS (SELECT fe.customer_id, recency, frequency, monetary, acctbal, region, mktsegment,
              COALESCE(af.ltv, 0) AS ltv, CASE WHEN af.n IS NULL THEN 1 ELSE 0 END AS churn
       FROM fe LEFT JOIN af ON fe.customer_id = af.customer_id LEFT JOIN attr ON fe.customer_id = attr.customer_id)"""


def _labelled(spark, sf):
    return FE.labelled_customers(spark, sf)


ALL_CUSTOMERS_SQL = f"""t AS ({S.TXN}),
ac AS (SELECT customer_id, sum(amount) AS monetary, sum(CASE WHEN date >= TIMESTAMP '{src.TXN_LABEL_CUT}' THEN amount ELSE 0 END) AS ltv,
       CASE WHEN max(date) < TIMESTAMP '{src.TXN_LABEL_CUT}' THEN 1 ELSE 0 END AS churn FROM t GROUP BY customer_id)"""
ATTRIBUTES_SQL = """ca AS (SELECT c_custkey AS customer_id, r_name AS region, c_mktsegment AS mktsegment FROM customer
       LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


@register("kpi_overview", f"""WITH {ALL_CUSTOMERS_SQL}
SELECT COUNT(*) AS customers, round(avg(ltv), 4) AS avg_ltv, round(avg(churn) * 100, 6) AS churn_rate_pct,
       round(avg(monetary), 4) AS avg_monetary FROM ac""")
def q_kpi_overview(spark, sf):
    """Every customer of the purchase log: spend, spend after the label cut, no purchase after it."""
    cut = F.lit(src.TXN_LABEL_CUT).cast("timestamp_ntz")
    every = src.txn(spark, sf).groupBy("customer_id").agg(
        F.sum("amount").alias("monetary"), F.sum(F.when(F.col("date") >= cut, F.col("amount")).otherwise(0.0)).alias("ltv"),
        F.when(F.max("date") < cut, 1).otherwise(0).alias("churn"))
    o = kpi.overview(every)
    return o.select("customers", F.round("avg_ltv", 4).alias("avg_ltv"), r6("churn_rate_pct").alias("churn_rate_pct"),
                    F.round("avg_monetary", 4).alias("avg_monetary"))


@register("region_counts", f"WITH {ATTRIBUTES_SQL} SELECT region, COUNT(*) AS count FROM ca GROUP BY region")
def q_region_counts(spark, sf):
    return kpi.value_counts(src.customer_attributes(spark, sf), "region")


@register("mktsegment_counts", f"WITH {ATTRIBUTES_SQL} SELECT mktsegment, COUNT(*) AS count FROM ca GROUP BY mktsegment")
def q_mktsegment_counts(spark, sf):
    return kpi.value_counts(src.customer_attributes(spark, sf), "mktsegment")


def _hist_sql(col, bins):
    return f"""WITH {S.rfm_cte()}, mm AS (SELECT min({col}) AS lo, max({col}) AS hi FROM rfm),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({col} - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin,
             lo, hi FROM rfm, mm WHERE {col} IS NOT NULL)
SELECT bin, round(lo + bin * (hi - lo) / {bins}, 6) AS lower, round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS upper,
       COUNT(*) AS count FROM b GROUP BY bin, lo, hi"""


def _hist_spark(col, bins):
    def run(spark, sf):
        h = kpi.histogram(_txn_rfm(spark, sf), col, bins)
        return h.select("bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "count")
    return run


for _c in ("recency", "frequency", "monetary"):
    register(f"histogram_{_c}", _hist_sql(_c, 30))(_hist_spark(_c, 30))


_LTV_H = "monetary * frequency * (12.0 / (recency / 30.0 + 1.0))"


@register("histogram_ltv", f"""WITH {S.rfm_cte()}, h AS (SELECT {_LTV_H} AS v FROM rfm),
mm AS (SELECT min(v) AS lo, max(v) AS hi FROM h),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin,
             lo, hi FROM h, mm WHERE v IS NOT NULL)
SELECT bin, round(lo + bin * (hi - lo) / 50, 2) AS lower, round(lo + (bin + 1) * (hi - lo) / 50, 2) AS upper,
       COUNT(*) AS count FROM b GROUP BY bin, lo, hi""")
def q_histogram_ltv(spark, sf):
    h = kpi.histogram(_txn_rfm(spark, sf).select(kpi.heuristic_ltv().alias("v")), "v", 50)
    return h.select("bin", F.round("lower", 2).alias("lower"), F.round("upper", 2).alias("upper"), "count")


@register("ltv_distribution", f"""WITH {S.rfm_cte()}, h AS (SELECT {_LTV_H} AS v FROM rfm)
SELECT round(avg(v), 2) AS mean, round(quantile_cont(v, 0.5), 2) AS median, round(stddev_pop(v), 2) AS std,
       round(min(v), 2) AS min, round(max(v), 2) AS max, round(quantile_cont(v, 0.25), 2) AS q25,
       round(quantile_cont(v, 0.75), 2) AS q75, round(quantile_cont(v, 0.9), 2) AS q90 FROM h""")
def q_ltv_distribution(spark, sf):
    d = kpi.distribution(_txn_rfm(spark, sf).select(kpi.heuristic_ltv().alias("v")), "v")
    return d.select(*[F.round(c, 2).alias(c) for c in d.columns])


@register("segment_share", f"""WITH {SEG}, n AS (SELECT COUNT(*) AS n FROM seg)
SELECT segment, COUNT(*) AS size, round(avg(monetary), 4) AS avg_value, round(COUNT(*) / max(n.n) * 100, 6) AS share_pct
FROM seg, n GROUP BY segment""")
def q_segment_share(spark, sf):
    s = kpi.segment_share(_txn_segments(spark, sf))
    return s.select("segment", "size", F.round("avg_value", 4).alias("avg_value"), r6("share_pct").alias("share_pct"))


@register("rfm_score_means", f"""WITH {SEG}
SELECT round(avg(R_score), 6) AS avg_R, round(avg(F_score), 6) AS avg_F, round(avg(M_score), 6) AS avg_M FROM seg""")
def q_rfm_score_means(spark, sf):
    m = kpi.score_means(_txn_segments(spark, sf))
    return m.select(*[r6(c).alias(c) for c in m.columns])


@register("segment_profile_norm", f"""WITH {SEG},
p AS (SELECT segment, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m FROM seg GROUP BY segment),
mm AS (SELECT min(r) rl, max(r) rh, min(f) fl, max(f) fh, min(m) ml, max(m) mh FROM p)
SELECT segment, round((r - rl) / (rh - rl + 1e-10), 6) AS recency, round((f - fl) / (fh - fl + 1e-10), 6) AS frequency,
       round((m - ml) / (mh - ml + 1e-10), 6) AS monetary FROM p, mm""")
def q_segment_profile_norm(spark, sf):
    p = kpi.segment_profile_norm(_txn_segments(spark, sf))
    return p.select("segment", *[r6(c).alias(c) for c in ("recency", "frequency", "monetary")])


@register("at_risk_customers", f"""WITH {SEG}
SELECT customer_id, recency, frequency, round(monetary, 6) AS monetary FROM seg WHERE segment = 'At Risk'""")
def q_at_risk_customers(spark, sf):
    """Filter one segment."""
    seg = _txn_segments(spark, sf).where(F.col("segment") == "At Risk")
    return seg.select("customer_id", "recency", "frequency", r6("monetary").alias("monetary"))


# ----------------------------------------------------------- clustering ----

@register("segment_radar", f"""WITH {SEG},
p AS (SELECT segment, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m FROM seg GROUP BY segment),
mm AS (SELECT min(recency) rl, max(recency) rh, min(frequency) fl, max(frequency) fh, min(monetary) ml,
              max(monetary) mh FROM seg)
SELECT segment, round((r - rl) / (rh - rl + 1e-10), 6) AS recency, round((f - fl) / (fh - fl + 1e-10), 6) AS frequency,
       round((m - ml) / (mh - ml + 1e-10), 6) AS monetary FROM p, mm""")
def q_segment_radar(spark, sf):
    """Radar normalisation (A9) of group profiles against the data's global
    min and max, with the RFM segments as the groups."""
    segs = _txn_segments(spark, sf)
    prof = CL.cluster_profiles(segs, None, CLUSTER_FEATURES, label="segment")
    out = CL.radar(prof, segs, CLUSTER_FEATURES, label="segment")
    return out.select("segment", *[r6(c).alias(c) for c in CLUSTER_FEATURES])


@register("segment_cluster_statistics", f"""WITH {SEG}
SELECT segment, round(avg(recency), 6) AS recency_mean, round(stddev_samp(recency), 6) AS recency_std,
       COUNT(recency) AS recency_count, round(avg(frequency), 6) AS frequency_mean,
       round(stddev_samp(frequency), 6) AS frequency_std, COUNT(frequency) AS frequency_count,
       round(avg(monetary), 4) AS monetary_mean, round(stddev_samp(monetary), 4) AS monetary_std,
       COUNT(monetary) AS monetary_count FROM seg GROUP BY segment""")
def q_segment_cluster_statistics(spark, sf):
    """Cluster statistics (A7: mean, sample std, non-null count per feature)
    with the RFM segments as the groups."""
    segs = _txn_segments(spark, sf)
    st = CL.cluster_statistics(segs, None, CLUSTER_FEATURES, label="segment")
    cols = []
    for c in CLUSTER_FEATURES:
        nd = 4 if c == "monetary" else 6
        cols += [F.round(f"{c}_mean", nd).alias(f"{c}_mean"), F.round(f"{c}_std", nd).alias(f"{c}_std"), f"{c}_count"]
    return st.select("segment", *cols)


@register("cluster_indices_rule", f"""WITH {SEG},
st AS (SELECT avg(recency) mr, stddev_pop(recency) sr, avg(frequency) mf, stddev_pop(frequency) sf,
              avg(monetary) mm, stddev_pop(monetary) sm FROM seg),
z AS (SELECT segment, (recency - mr) / sr AS x0, (frequency - mf) / sf AS x1, (monetary - mm) / sm AS x2 FROM seg, st),
c AS (SELECT segment, COUNT(*) AS n_k, avg(x0) c0, avg(x1) c1, avg(x2) c2 FROM z GROUP BY segment),
g AS (SELECT COUNT(*) AS n, avg(x0) g0, avg(x1) g1, avg(x2) g2 FROM z),
w AS (SELECT z.segment, sum(power(x0 - c0, 2) + power(x1 - c1, 2) + power(x2 - c2, 2)) AS w_k,
             avg(sqrt(power(x0 - c0, 2) + power(x1 - c1, 2) + power(x2 - c2, 2))) AS s_k
      FROM z JOIN c ON z.segment = c.segment GROUP BY z.segment),
cc AS (SELECT c.*, w.w_k, w.s_k FROM c JOIN w ON c.segment = w.segment),
db AS (SELECT avg(r) AS davies_bouldin FROM (
        SELECT a.segment, max((a.s_k + b.s_k) / sqrt(power(a.c0 - b.c0, 2) + power(a.c1 - b.c1, 2) + power(a.c2 - b.c2, 2))) AS r
        FROM cc a JOIN cc b ON a.segment <> b.segment GROUP BY a.segment)),
ch AS (SELECT (sum(n_k * (power(c0 - g0, 2) + power(c1 - g1, 2) + power(c2 - g2, 2))) / (COUNT(*) - 1))
              / (sum(w_k) / (max(n) - COUNT(*))) AS calinski_harabasz, sum(w_k) AS inertia FROM cc, g)
SELECT round(calinski_harabasz, 6) AS calinski_harabasz, round(davies_bouldin, 6) AS davies_bouldin,
       round(inertia, 6) AS inertia FROM ch, db""")
def q_cluster_indices_rule(spark, sf):
    segs = _txn_segments(spark, sf)
    z = zscore(segs, ["recency", "frequency", "monetary"], ddof=0, keep=["segment"])
    q = CL.quality_indices(z, ["recency", "frequency", "monetary"], label="segment")
    return q.select(*[r6(c).alias(c) for c in ("calinski_harabasz", "davies_bouldin", "inertia")])


CLUSTER_FEATURES = ["recency", "frequency", "monetary"]


@register("kmeans_segments")
def q_kmeans_segments(spark, sf):
    lab, _ = CL.kmeans_labels(_txn_rfm(spark, sf), CLUSTER_FEATURES, k=4, n_init=10)
    return lab.select("customer_id", "cluster")


@register("kmeans_profiles")
def q_kmeans_profiles(spark, sf):
    base = _txn_rfm(spark, sf)
    lab, _ = CL.kmeans_labels(base, CLUSTER_FEATURES, k=4, n_init=10)
    return CL.cluster_profiles(base, lab, CLUSTER_FEATURES)


@register("kmeans_k_search")
def q_kmeans_k_search(spark, sf):
    return CL.k_search(_txn_rfm(spark, sf), CLUSTER_FEATURES, range(2, 11), n_init=10)


_Z_POINTS = f"""{S.rfm_cte()},
zst AS (SELECT avg(recency) mr, stddev_pop(recency) sr, avg(frequency) mf, stddev_pop(frequency) sf,
               avg(monetary) mm, stddev_pop(monetary) sm FROM rfm),
pts AS (SELECT customer_id AS id, (recency - mr) / sr AS recency, (frequency - mf) / sf AS frequency,
               (monetary - mm) / sm AS monetary FROM rfm, zst)"""


#: Centres (recency, frequency, monetary, on population z-scores) for one checked K-means step.
STEP_CENTRES = [[-0.5, -1.0, -0.75], [-0.5, 1.0, 1.0], [1.5, -1.0, -1.0], [0.25, 0.25, 0.0]]
_CENTRE_ROWS = ", ".join(f"({i}, {a!r}, {b!r}, {c!r})" for i, (a, b, c) in enumerate(STEP_CENTRES))


@register("kmeans_assignment_step", f"""WITH {_Z_POINTS},
cen(cluster, a, b, c) AS (VALUES {_CENTRE_ROWS}),
d AS (SELECT pts.*, cluster, power(recency - a, 2) + power(frequency - b, 2) + power(monetary - c, 2) AS d2 FROM pts, cen),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster) AS rn FROM d)
SELECT cluster, COUNT(*) AS size, round(avg(recency), 6) AS recency, round(avg(frequency), 6) AS frequency,
       round(avg(monetary), 6) AS monetary, (SELECT round(sum(d2), 4) FROM near WHERE rn = 1) AS inertia
FROM near WHERE rn = 1 GROUP BY cluster""")
def q_kmeans_assignment_step(spark, sf):
    """One step of the K-means chains from given centres: sizes, new centres and inertia."""
    z = zscore(_txn_rfm(spark, sf), CLUSTER_FEATURES, ddof=0, keep=["customer_id"])
    points = kept(z.select(F.array(*CLUSTER_FEATURES).alias("x")))
    n, centres, cost = KC.step(points, "x", np.array(STEP_CENTRES))
    rows = [(i, int(n[i]), *map(float, c), float(cost)) for i, c in enumerate(centres) if n[i]]
    out = spark.createDataFrame(rows, "cluster long, size long, recency double, frequency double, monetary double, inertia double")
    return out.select("cluster", "size", *[r6(c).alias(c) for c in CLUSTER_FEATURES], F.round("inertia", 4).alias("inertia"))


@register("scatter_segments", f"""WITH {SEG} SELECT customer_id, recency, round(monetary, 6) AS monetary, segment FROM seg""")
def q_scatter_segments(spark, sf):
    """Two features with the label of each customer (M8), for the RFM segments."""
    seg = _txn_segments(spark, sf)
    out = CL.scatter(seg.drop("segment"), seg.select("customer_id", "segment"), "recency", "monetary", label="segment")
    return out.select("customer_id", "recency", r6("monetary").alias("monetary"), "segment")


@register("dbscan_segments", S.dbscan_sql(_Z_POINTS, ["recency", "frequency", "monetary"], 0.5, 5))
def q_dbscan_segments(spark, sf):
    """DBSCAN with the reference defaults (eps 0.5, min_samples 5) on
    population-z-scored R/F/M of the purchase log."""
    z = zscore(_txn_rfm(spark, sf), CLUSTER_FEATURES, ddof=0, keep=["customer_id"])
    return DB.dbscan(z, CLUSTER_FEATURES, eps=0.5, min_samples=5)


@register("dbscan_profiles", S.dbscan_sql(
    _Z_POINTS, ["recency", "frequency", "monetary"], 0.5, 5,
    "COALESCE(num.cluster, -1) AS cluster, round(avg(rfm.recency), 6) AS recency, round(avg(rfm.frequency), 6) AS frequency, "
    "round(avg(rfm.monetary), 4) AS monetary, COUNT(*) AS count",
    "JOIN rfm ON rfm.customer_id = pts.id GROUP BY 1"))
def q_dbscan_profiles(spark, sf):
    base = _txn_rfm(spark, sf)
    z = zscore(base, CLUSTER_FEATURES, ddof=0, keep=["customer_id"])
    lab = DB.dbscan(z, CLUSTER_FEATURES, eps=0.5, min_samples=5)
    p = CL.cluster_profiles(base, lab, CLUSTER_FEATURES)
    return p.select("cluster", r6("recency").alias("recency"), r6("frequency").alias("frequency"),
                    F.round("monetary", 4).alias("monetary"), "count")


@register("hierarchical_segments")
def q_hierarchical_segments(spark, sf):
    """Ward agglomerative clustering into 4 groups of population-z-scored
    R/F/M, over 1,000 weighted K-means centres at every size."""
    z = zscore(_txn_rfm(spark, sf), CLUSTER_FEATURES, ddof=0, keep=["customer_id"])
    return HC.hierarchical(z, CLUSTER_FEATURES, n_clusters=4, linkage="ward")


@register("single_linkage_segments", S.single_linkage_sql(_Z_POINTS, CLUSTER_FEATURES, 4))
def q_single_linkage_segments(spark, sf):
    """Exact single linkage into 4 groups of population-z-scored R/F/M."""
    z = zscore(_txn_rfm(spark, sf), CLUSTER_FEATURES, ddof=0, keep=["customer_id"])
    return SL.single_linkage(z, CLUSTER_FEATURES, n_clusters=4)


@register("single_linkage_heights", S.single_linkage_sql(_Z_POINTS, CLUSTER_FEATURES))
def q_single_linkage_heights(spark, sf):
    """The heights of all merges of single linkage (the dendrogram's levels) with their counts."""
    z = zscore(_txn_rfm(spark, sf), CLUSTER_FEATURES, ddof=0, keep=["customer_id"])
    return (SL.merges(z, CLUSTER_FEATURES).groupBy(F.round("height", 6).alias("height"))
            .agg(F.count(F.lit(1)).alias("merges")))


# second clustering input: the embedding vectors
EMB_DIM_SQL = "len(embedding)"


def _embedding_columns(spark, sf):
    emb = src.table(spark, sf, "embeddings")
    low, d = emb.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != d:
        raise ValueError("embeddings differ in length")
    cols = [f"e{i}" for i in range(d)]
    return emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols


@register("cluster_silhouette_rule", f"""WITH {SEG},
st AS (SELECT avg(recency) AS mr, stddev_pop(recency) AS sr, avg(frequency) AS mf, stddev_pop(frequency) AS sf,
       avg(monetary) AS mm, stddev_pop(monetary) AS sm FROM seg),
z AS (SELECT customer_id, segment, (recency - mr) / sr AS r, (frequency - mf) / sf AS f, (monetary - mm) / sm AS m FROM seg, st),
k AS (SELECT segment, COUNT(*) AS n, avg(r * r + f * f + m * m) AS q, avg(r) AS cr, avg(f) AS cf, avg(m) AS cm FROM z GROUP BY segment),
d AS (SELECT customer_id, z.segment AS own, k.segment AS other, n, r * r + f * f + m * m + q - 2 * (r * cr + f * cf + m * cm) AS d
      FROM z, k),
s AS (SELECT customer_id, max(CASE WHEN own = other AND n > 1 THEN d * n / (n - 1) END) AS a,
             min(CASE WHEN own <> other THEN d END) AS b, max(CASE WHEN own = other THEN n END) AS n FROM d GROUP BY customer_id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s""")
def q_cluster_silhouette_rule(spark, sf):
    """Squared-Euclidean silhouette of the RFM segments on population-z-scored R/F/M."""
    seg = _txn_segments(spark, sf)
    z = zscore(seg, CLUSTER_FEATURES, ddof=0, keep=["customer_id", "segment"])
    return CL.silhouette(z, CLUSTER_FEATURES, "segment").select(r6("silhouette").alias("silhouette"))


@register("embedding_label_indices", """WITH
e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(generate_series(1, len(embedding))) AS dim
      FROM embeddings),
c AS (SELECT label, dim, avg(v) AS cv FROM e GROUP BY label, dim),
nk AS (SELECT label, COUNT(*) AS n_k FROM embeddings GROUP BY label),
g AS (SELECT dim, avg(v) AS gv FROM e GROUP BY dim),
pd AS (SELECT e.vec_id, e.label, sum((v - cv) * (v - cv)) AS d2 FROM e JOIN c ON e.label = c.label AND e.dim = c.dim
       GROUP BY e.vec_id, e.label),
w AS (SELECT label, sum(d2) AS w_k, avg(sqrt(d2)) AS s_k FROM pd GROUP BY label),
dd AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.cv - b.cv) * (a.cv - b.cv))) AS dij
       FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY a.label, b.label),
db AS (SELECT avg(r) AS davies_bouldin FROM (
         SELECT dd.la, max((wa.s_k + wb.s_k) / dij) AS r FROM dd JOIN w wa ON dd.la = wa.label JOIN w wb ON dd.lb = wb.label
         GROUP BY dd.la)),
bb AS (SELECT sum(nk.n_k * s) AS B FROM (SELECT label, sum((cv - gv) * (cv - gv)) AS s FROM c JOIN g ON c.dim = g.dim
       GROUP BY label) x JOIN nk ON x.label = nk.label),
ch AS (SELECT (B / ((SELECT COUNT(*) FROM nk) - 1)) / ((SELECT sum(w_k) FROM w)
              / ((SELECT COUNT(*) FROM embeddings) - (SELECT COUNT(*) FROM nk))) AS calinski_harabasz,
              (SELECT sum(w_k) FROM w) AS inertia FROM bb)
SELECT round(calinski_harabasz, 6) AS calinski_harabasz, round(davies_bouldin, 6) AS davies_bouldin,
       round(inertia, 6) AS inertia FROM ch, db""")
def q_embedding_label_indices(spark, sf):
    df, cols = _embedding_columns(spark, sf)
    q = CL.quality_indices(df, cols, label="label")
    return q.select(*[r6(c).alias(c) for c in ("calinski_harabasz", "davies_bouldin", "inertia")])


@register("embedding_kmeans")
def q_embedding_kmeans(spark, sf):
    df, cols = _embedding_columns(spark, sf)
    lab, _ = CL.kmeans_labels(df.withColumnRenamed("vec_id", "customer_id"), cols, k=10, n_init=10)
    return lab.select(F.col("customer_id").alias("vec_id"), "cluster")


@register("pca_projection")
def q_pca_projection(spark, sf):
    lab, _ = CL.kmeans_labels(_txn_rfm(spark, sf), CLUSTER_FEATURES, k=4, n_init=10)
    return CL.pca_projection(lab, len(CLUSTER_FEATURES))


# ------------------------------------------------------ supervised models --

MODEL_FEATURES = ["recency", "frequency", "monetary", "acctbal"]


@register("ltv_model_comparison")
def q_ltv_model_comparison(spark, sf):
    df = _labelled(spark, sf).persist()
    trained = SU.train_regressions(df, MODEL_FEATURES, "ltv", names=("ridge", "random_forest", "gradient_boosting"))
    df.unpersist()
    return SU.comparison(trained, "regression")


@register("ltv_feature_importance")
def q_ltv_feature_importance(spark, sf):
    df = _labelled(spark, sf).persist()
    out = SU.importance([SU.train_regression(df, MODEL_FEATURES, "ltv", name="random_forest")], 10)
    df.unpersist()
    return out


@register("ltv_predictions")
def q_ltv_predictions(spark, sf):
    df = _labelled(spark, sf).persist()
    tr = SU.train_regression(df, MODEL_FEATURES, "ltv", name="ridge")
    return SU.predict(tr, df, keep=("customer_id", "ltv"), out="predicted_ltv")


@register("ltv_prediction_distribution")
def q_ltv_prediction_distribution(spark, sf):
    """Distribution of predicted LTV (A14: mean, median, population std,
    min, max, q25, q75, q90) from the ridge model."""
    df = _labelled(spark, sf).persist()
    tr = SU.train_regression(df, MODEL_FEATURES, "ltv", name="ridge")
    return kpi.distribution(SU.predict(tr, df, out="predicted_ltv"), "predicted_ltv")


@register("churn_model_comparison")
def q_churn_model_comparison(spark, sf):
    df = _labelled(spark, sf).persist()
    trained = SU.train_classifiers(df, MODEL_FEATURES, "churn",
                                   names=("logistic_regression", "random_forest", "gradient_boosting"))
    df.unpersist()
    return SU.comparison(trained, "classification")


@register("churn_high_risk")
def q_churn_high_risk(spark, sf):
    df = _labelled(spark, sf).persist()
    tr = SU.train_classifier(df, MODEL_FEATURES, "churn", name="random_forest")
    return SU.high_risk(tr, df, threshold=0.7).select("customer_id", "churn_probability")


@register("churn_high_risk_top20")
def q_churn_high_risk_top20(spark, sf):
    """The page's top-20 list (T1): highest churn probabilities at or above
    0.7 (a TakeOrderedAndProject; the limit is the report)."""
    df = _labelled(spark, sf).persist()
    tr = SU.train_classifier(df, MODEL_FEATURES, "churn", name="random_forest")
    return SU.high_risk(tr, df, threshold=0.7).select("customer_id", "churn_probability").limit(20)


@register("churn_permutation_importance")
def q_churn_permutation_importance(spark, sf):
    df = _labelled(spark, sf).persist()
    tr = SU.train_classifier(df, MODEL_FEATURES, "churn", name="logistic_regression")
    out = EX.permutation_importance(tr, df, "churn", n_repeats=10, seed=0)  # built from collected rows
    df.unpersist()
    return out


@register("churn_linear_shap")
def q_churn_linear_shap(spark, sf):
    df = _labelled(spark, sf).persist()
    tr = SU.train_classifier(df, MODEL_FEATURES, "churn", name="logistic_regression")
    return EX.linear_shap(tr, df)


@register("churn_tree_shapley")
def q_churn_tree_shapley(spark, sf):
    df = _labelled(spark, sf).persist()
    tr = SU.train_classifier(df, MODEL_FEATURES, "churn", name="random_forest")
    return EX.shapley_sampling(tr, df, n_permutations=10, background=100, seed=0)


@register("train_test_split_stratified", f"""WITH {LABELLED_SQL},
u AS (SELECT customer_id, churn, {_unit('customer_id', 42)} AS u FROM lc),
n AS (SELECT churn, COUNT(*) AS n, (SELECT CAST(ceil(0.2 * COUNT(*)) AS BIGINT) FROM lc) AS t, (SELECT COUNT(*) FROM lc) AS a
      FROM lc GROUP BY churn),
q AS (SELECT churn, t * n // a + CASE WHEN row_number() OVER (ORDER BY (t * n) % a DESC, churn) <= t - sum(t * n // a) OVER ()
      THEN 1 ELSE 0 END AS quota FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY churn ORDER BY u) AS r FROM u)
SELECT customer_id, churn, r <= quota AS is_test FROM r JOIN q USING (churn)""")
def q_train_test_split_stratified(spark, sf):
    return FE.split(_labelled(spark, sf).select("customer_id", "churn"), "customer_id", 0.2, 42, exact=True, stratify="churn")


@register("cv_folds_stratified", f"""WITH {LABELLED_SQL},
r AS (SELECT customer_id, churn, row_number() OVER (PARTITION BY churn ORDER BY {_unit('customer_id', 43)}) AS r,
             COUNT(*) OVER (PARTITION BY churn) AS n FROM lc)
SELECT customer_id, churn, CAST({' + '.join(f"CASE WHEN r > n * {k} // 5 THEN 1 ELSE 0 END" for k in (1, 2, 3, 4))} AS INTEGER) AS fold
FROM r""")
def q_cv_folds_stratified(spark, sf):
    return FE.folds(_labelled(spark, sf).select("customer_id", "churn"), "customer_id", 5, 43, stratify="churn")


@register("ltv_rule_regression_metrics", f"""WITH {LABELLED_SQL},
p AS (SELECT ltv AS y, monetary * 0.1 + 1000.0 AS x FROM lc)
SELECT round(sqrt(avg((y - x) * (y - x))), 4) AS rmse, round(avg(abs(y - x)), 4) AS mae,
       round(1 - sum((y - x) * (y - x)) / (var_pop(y) * COUNT(*)), 6) AS r2 FROM p""")
def q_ltv_rule_regression_metrics(spark, sf):
    """M13 for a rule in place of a fitted model."""
    p = _labelled(spark, sf).select(F.col("ltv").alias("label"), (F.col("monetary") * 0.1 + 1000.0).alias("prediction"))
    m = ME.regression_metrics(p)
    return m.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), r6("r2").alias("r2"))


@register("ltv_least_squares_one_feature", f"""WITH {LABELLED_SQL},
s AS (SELECT avg(monetary) AS m, stddev_pop(monetary) AS s FROM lc WHERE {_unit('customer_id', 42)} >= 0.2),
z AS (SELECT customer_id, ltv, (monetary - m) / s AS x, {_unit('customer_id', 42)} < 0.2 AS is_test FROM lc, s),
b AS (SELECT regr_slope(ltv, x) AS b1, regr_intercept(ltv, x) AS b0 FROM z WHERE NOT is_test)
SELECT customer_id, round(ltv, 4) AS actual, round(b0 + b1 * x, 2) AS predicted FROM z, b WHERE is_test""")
def q_ltv_least_squares_one_feature(spark, sf):
    """Least squares on one scaled feature: predicted against actual on the test part."""
    df = _labelled(spark, sf)
    tr = SU.train_regression(df, ["monetary"], "ltv", name="linear")
    test = FE.split(df, "customer_id").where("is_test")
    p = SU.predict(tr, test, keep=("customer_id", "ltv"))
    return p.select("customer_id", F.round("ltv", 4).alias("actual"), F.round("prediction", 2).alias("predicted"))


@register("ltv_cross_validation_linear", f"""WITH {LABELLED_SQL},
r AS (SELECT ltv AS y, monetary AS a, frequency AS b, row_number() OVER (ORDER BY {_unit('customer_id', 43)}) AS r,
             COUNT(*) OVER () AS n FROM lc),
f AS (SELECT y, a, b, {' + '.join(f"CASE WHEN r > n * {k} // 5 THEN 1 ELSE 0 END" for k in (1, 2, 3, 4))} AS fold FROM r),
m AS (SELECT k, COUNT(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS saa, covar_pop(a, b) AS sab,
             covar_pop(b, b) AS sbb, covar_pop(a, y) AS say, covar_pop(b, y) AS sby
      FROM f, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY k),
w AS (SELECT k, n, my, ma, mb, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa,
             (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb FROM m),
e AS (SELECT fold, n, y, y - my - wa * (a - ma) - wb * (b - mb) AS e FROM f JOIN w ON fold = k)
SELECT CAST(fold AS INTEGER) AS fold, n AS n_train, COUNT(*) AS n_test, round(1 - avg(e * e) / var_pop(y), 6) AS r2,
       round(sqrt(avg(e * e)), 3) AS rmse FROM e GROUP BY fold, n""")
def q_ltv_cross_validation_linear(spark, sf):
    """Five-fold scores of least squares on two features from the folds' moments."""
    out = LC.cross_validate_linear(_labelled(spark, sf), ["monetary", "frequency"], "ltv")
    return out.select("fold", "n_train", "n_test", r6("r2").alias("r2"), F.round("rmse", 3).alias("rmse"))


@register("ltv_test_predictions", f"""WITH {LABELLED_SQL},
z AS (SELECT customer_id, ltv, frequency AS x, {_unit('customer_id', 42)} < 0.2 AS is_test FROM lc),
b AS (SELECT regr_slope(ltv, x) AS b1, regr_intercept(ltv, x) AS b0 FROM z WHERE NOT is_test)
SELECT customer_id, round(ltv, 4) AS actual, round(b0 + b1 * x, 2) AS predicted FROM z, b WHERE is_test""")
def q_ltv_test_predictions(spark, sf):
    """Actual against predicted on the rows that the model was not fitted on."""
    df = _labelled(spark, sf)
    p = SU.held_out_predictions(SU.train_regression(df, ["frequency"], "ltv", name="linear"), df)
    return p.select("customer_id", F.round("actual", 4).alias("actual"), F.round("predicted", 2).alias("predicted"))


def _shapley_sql(feature: str) -> str:
    """The value of one feature of ``_rule_score``: what it adds to each coalition of the others, by weight."""
    others = [f for f in CLUSTER_FEATURES if f != feature]

    def scored(members) -> str:
        r, f, m = (f"{'x' if c in members else 'b'}.{c}" for c in CLUSTER_FEATURES)
        return f"({r} * 0.01 + {f} * {m} / 1000000.0 - {m} / ({r} + 10.0) / 1000.0)"

    return " + ".join(f"({scored({*c, feature})} - {scored(set(c))}) / {(3, 6, 3)[len(c)]}.0"
                      for c in ((), (others[0],), (others[1],), tuple(others)))


def _rule_score(x):
    """A score with products and quotients of recency, frequency and monetary."""
    return x[:, 0] * 0.01 + x[:, 1] * x[:, 2] / 1000000.0 - x[:, 2] / (x[:, 0] + 10.0) / 1000.0


@register("shapley_rule", f"""WITH {S.rfm_cte()},
b AS (SELECT avg(recency) AS recency, avg(frequency) AS frequency, avg(monetary) AS monetary FROM rfm)
SELECT customer_id, {', '.join(f'round({_shapley_sql(f)}, 6) AS shap_{f}' for f in CLUSTER_FEATURES)} FROM rfm x, b""")
def q_shapley_rule(spark, sf):
    """Exact Shapley values of a rule score against the mean customer."""
    base = _txn_rfm(spark, sf)
    mean = base.agg(*[F.avg(c) for c in CLUSTER_FEATURES]).first()
    out = SH.exact_shapley(base, CLUSTER_FEATURES, _rule_score, [list(mean)])
    return out.select("customer_id", *[r6(f"shap_{f}").alias(f"shap_{f}") for f in CLUSTER_FEATURES])


@register("rfm_numeric_features_imputed", f"""WITH {S.rfm_cte()},
h AS (SELECT customer_id, CASE WHEN frequency > 10 THEN NULL ELSE recency END AS recency, frequency,
             CASE WHEN recency < 30 THEN NULL ELSE monetary END AS monetary FROM rfm)
SELECT customer_id, CAST(COALESCE(recency, (SELECT median(recency) FROM h)) AS DOUBLE) AS recency, CAST(frequency AS DOUBLE) AS frequency,
       round(COALESCE(monetary, (SELECT median(monetary) FROM h)), 6) AS monetary FROM h""")
def q_rfm_numeric_features_imputed(spark, sf):
    """Numeric features picked by type (P1), holes filled with the exact median."""
    x = _txn_rfm(spark, sf).select("customer_id", F.when(F.col("frequency") <= 10, F.col("recency")).alias("recency"),
                                   "frequency", F.when(F.col("recency") >= 30, F.col("monetary")).alias("monetary"))
    out = FE.impute_median(x, FE.numeric_features(x, exclude=("customer_id",)))
    return out.select("customer_id", "recency", "frequency", F.round("monetary", 6).alias("monetary"))


def _folds_frame(spark, res: dict, first: str, second: str):
    rows = [(i, float(v)) for i, v in enumerate(res[f"{first}_scores"])]
    df = spark.createDataFrame(rows, f"fold int, {first} double")
    summary = spark.createDataFrame([(float(res[f"{first}_mean"]), float(res[f"{first}_std"]),
                                      float(res[f"{second}_mean"]), float(res[f"{second}_std"]))],
                                    f"{first}_mean double, {first}_std double, {second}_mean double, {second}_std double")
    from ..functions.scaling import attach_row
    return attach_row(df, summary)


@register("ltv_cross_validation")
def q_ltv_cross_validation(spark, sf):
    res = SU.cross_validate(_labelled(spark, sf), MODEL_FEATURES, "ltv", name="linear", cv=5)
    return _folds_frame(spark, res, "r2", "mae")


@register("churn_cross_validation")
def q_churn_cross_validation(spark, sf):
    res = SU.cross_validate(_labelled(spark, sf), MODEL_FEATURES, "churn", name="logistic_regression", cv=5,
                            kind="classification")
    return _folds_frame(spark, res, "roc_auc", "f1")


# rule score: an expression in place of a fitted model, so SQL can check
# the metric operators exactly
_RULE = "1.0 / (1.0 + exp(-(recency - 150.0) / 50.0))"


def _rule_scored(spark, sf):
    df = _labelled(spark, sf)
    return df.select("customer_id", F.col("churn").cast("double").alias("label"),
                     F.expr(_RULE).alias("score")).withColumn("prediction", (F.col("score") >= 0.5).cast("double"))


_RULE_SQL = f"""WITH {LABELLED_SQL}, s AS (SELECT customer_id, churn AS label, {_RULE} AS score,
       CASE WHEN {_RULE} >= 0.5 THEN 1 ELSE 0 END AS prediction FROM lc)"""


_POINTS_RULE = ("CASE WHEN recency >= 120 THEN 0.5 ELSE 0.0 END + CASE WHEN frequency <= 6 THEN 0.375 ELSE 0.0 END"
                " + CASE WHEN monetary < 900000 THEN 0.25 ELSE 0.0 END")


@register("permutation_importance_rule", f"""WITH {LABELLED_SQL},
z AS (SELECT *, row_number() OVER (ORDER BY customer_id) - 1 AS pos, COUNT(*) OVER () AS n FROM lc),
zz AS (SELECT *, (n + a - 1) // a AS b FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM z)),
src AS (SELECT zz.*, g FROM zz, (SELECT unnest(generate_series(0, 11)) AS g)),
{S.permuted_sql('n', 'a', 'b', 'g', 'pos', 'src', seed=3)},
mixed AS (SELECT p.g, t.churn, CASE WHEN p.g // 4 = 0 THEN d.recency ELSE t.recency END AS recency,
                 CASE WHEN p.g // 4 = 1 THEN d.frequency ELSE t.frequency END AS frequency,
                 CASE WHEN p.g // 4 = 2 THEN d.monetary ELSE t.monetary END AS monetary
          FROM permuted p JOIN z d ON d.pos = p.pos JOIN z t ON t.pos = p.x),
v AS (SELECT g, avg(CASE WHEN churn = CASE WHEN {_POINTS_RULE} >= 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) AS v
      FROM mixed GROUP BY g),
base AS (SELECT avg(CASE WHEN churn = CASE WHEN {_POINTS_RULE} >= 0.5 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END) AS v FROM z)
SELECT CASE v.g // 4 WHEN 0 THEN 'recency' WHEN 1 THEN 'frequency' ELSE 'monetary' END AS feature,
       round(avg(base.v - v.v), 6) AS importance_mean, round(stddev_pop(base.v - v.v), 6) AS importance_std
FROM v, base GROUP BY 1""")
def q_permutation_importance_rule(spark, sf):
    """Accuracy lost by a points rule for churn when one feature is shuffled, four shuffles each."""
    out = EX.permutation_importance_of(_labelled(spark, sf), CLUSTER_FEATURES, "churn",
                                       lambda d: d.withColumn("score", F.expr(_POINTS_RULE)),
                                       n_repeats=4, seed=3, scoring="accuracy")
    return out.select("feature", r6("importance_mean").alias("importance_mean"), r6("importance_std").alias("importance_std"))


@register("churn_rule_metrics", f"""{_RULE_SQL},
c AS (SELECT sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) tp,
             sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) fp,
             sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) tn,
             sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) fn FROM s),
m AS (SELECT (tp + tn) / (tp + fp + tn + fn) AS accuracy,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c),
bysc AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
cum AS (SELECT *, COALESCE(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM bysc),
a AS (SELECT sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc FROM cum)
SELECT round(accuracy, 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1, round(roc_auc, 6) AS roc_auc
FROM m, a""")
def q_churn_rule_metrics(spark, sf):
    m = ME.classification_metrics(_rule_scored(spark, sf))
    return m.select(*[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@register("churn_rule_confusion", f"""{_RULE_SQL},
g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted))
SELECT g.actual, g.predicted, COALESCE(x.n, 0) AS count FROM g LEFT JOIN
  (SELECT CAST(label AS INTEGER) AS actual, CAST(prediction AS INTEGER) AS predicted, COUNT(*) AS n FROM s GROUP BY 1, 2) x
  ON g.actual = x.actual AND g.predicted = x.predicted""")
def q_churn_rule_confusion(spark, sf):
    return ME.confusion_matrix(_rule_scored(spark, sf))


@register("churn_rule_roc", f"""{_RULE_SQL},
bysc AS (SELECT score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1),
cum AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
               sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM bysc)
SELECT round(threshold, 9) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr, round(tp / (tp + fp), 6) AS precision,
       round(tp / P, 6) AS recall FROM cum""")
def q_churn_rule_roc(spark, sf):
    r = ME.roc_points(_rule_scored(spark, sf))
    return r.select(F.round("threshold", 9).alias("threshold"), *[r6(c).alias(c) for c in ("fpr", "tpr", "precision", "recall")])


@register("churn_rule_high_risk", f"""{_RULE_SQL}
SELECT CAST(sum(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk,
       round(avg(CASE WHEN score >= 0.7 THEN 1.0 ELSE 0.0 END) * 100, 6) AS high_risk_pct FROM s""")
def q_churn_rule_high_risk(spark, sf):
    h = kpi.high_risk_summary(_rule_scored(spark, sf).withColumnRenamed("score", "churn_probability"), threshold=0.7)
    return h.select("high_risk", r6("high_risk_pct").alias("high_risk_pct"))


def _rule_probabilities(spark, sf):
    return _rule_scored(spark, sf).select("customer_id", F.col("score").alias("churn_probability"))


@register("churn_rule_decisions", f"""{_RULE_SQL}
SELECT customer_id, round(score, 9) AS churn_probability, CAST(prediction AS INTEGER) AS churn_prediction FROM s""")
def q_churn_rule_decisions(spark, sf):
    """The 0/1 decision for every customer (P6), of a rule score in place of a model."""
    return SU.decide(_rule_probabilities(spark, sf)).withColumn("churn_probability", F.round("churn_probability", 9))


@register("churn_rule_at_risk", f"""{_RULE_SQL}
SELECT customer_id, round(score, 9) AS churn_probability FROM s WHERE score >= 0.7""")
def q_churn_rule_at_risk(spark, sf):
    """All customers at or above the risk threshold (P5), of a rule score in place of a model."""
    return SU.at_risk(_rule_probabilities(spark, sf)).withColumn("churn_probability", F.round("churn_probability", 9))


@register("csv_purchase_months", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS purchases, COUNT(DISTINCT o_custkey) AS customers,
       round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1""")
def q_csv_purchase_months(spark, sf):
    """The whole purchase log through CSV files: scan with a schema (S1), column mapping (S2), day/month/year dates (S3)."""
    log = src.table(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), "o_totalprice")
    df = files.read_csv(spark, kept_csv(log), "o_custkey BIGINT, day STRING, o_totalprice DOUBLE")
    df = files.map_columns(df, {"customer_id": "o_custkey", "transaction_date": "day", "amount": "o_totalprice"})
    df = files.parse_dates(df, "transaction_date", "dd/MM/yyyy")
    return df.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("purchases"), F.countDistinct("customer_id").alias("customers"),
        F.round(F.sum("amount"), 2).alias("amount"))


CONTRIB_WEIGHTS = {"recency": 0.8, "frequency": -0.5, "monetary": 0.3, "acctbal": 0.1}
CONTRIB_MEANS = {"recency": 100.0, "frequency": 8.0, "monetary": 2000000.0, "acctbal": 4500.0}


@register("churn_contributions", f"""WITH {LABELLED_SQL},
u AS (SELECT customer_id, 'recency' AS feature, CAST(recency AS DOUBLE) AS value FROM lc
      UNION ALL SELECT customer_id, 'frequency', CAST(frequency AS DOUBLE) FROM lc
      UNION ALL SELECT customer_id, 'monetary', CAST(monetary AS DOUBLE) FROM lc
      UNION ALL SELECT customer_id, 'acctbal', CAST(acctbal AS DOUBLE) FROM lc),
w AS (SELECT * FROM (VALUES {', '.join(f"({_q(k)}, {v}, {CONTRIB_MEANS[k]})" for k, v in CONTRIB_WEIGHTS.items())}) t(feature, wt, mu)),
c AS (SELECT customer_id, u.feature, value, wt * (value - mu) AS contribution FROM u JOIN w ON u.feature = w.feature),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, feature) AS rank FROM c)
SELECT customer_id, CAST(rank AS INTEGER) AS rank, feature, round(value, 6) AS value, round(contribution, 6) AS contribution
FROM r WHERE rank <= 2""")
def q_churn_contributions(spark, sf):
    df = _labelled(spark, sf)
    top = EX.contributions(df, list(CONTRIB_WEIGHTS), CONTRIB_WEIGHTS, CONTRIB_MEANS, top_k=2)
    lng = EX.contributions_long(top)
    return lng.select("customer_id", "rank", "feature", r6("value").alias("value"),
                      r6("contribution").alias("contribution"))
