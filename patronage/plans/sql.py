"""Shared SQL fragments for the DuckDB oracle texts (views are the driver
tables; the bindings below mirror ``patronage.sources.tables``)."""
from ..functions import shuffle as SH
from ..sources.tables import PURCHASES_REFERENCE_DATE, TXN_REFERENCE_DATE

TXN = "SELECT o_custkey AS customer_id, o_orderdate AS date, o_totalprice AS amount FROM orders"
PURCHASES = ("SELECT user_id AS customer_id, ts AS date, value AS amount FROM events "
             "WHERE event_type = 'purchase'")


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


def rfm_cte(source: str = TXN, ref: str = TXN_REFERENCE_DATE) -> str:
    return f"""t AS ({source}),
rfm AS (
  SELECT customer_id, COUNT(*) AS frequency,
         CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS monetary,
         {days(f"TIMESTAMP '{ref}'", 'max(date)')} AS recency
  FROM t WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


def scores_cte(source: str = TXN, ref: str = TXN_REFERENCE_DATE) -> str:
    return rfm_cte(source, ref) + """,
ranked AS (
  SELECT *, COUNT(*) OVER () AS n,
         row_number() OVER (ORDER BY recency, customer_id) AS rn_r,
         row_number() OVER (ORDER BY frequency, customer_id) AS rn_f,
         row_number() OVER (ORDER BY monetary, customer_id) AS rn_m
  FROM rfm),
scores AS (
  SELECT customer_id, frequency, monetary, recency,
         CAST(6 - greatest(1, ceil(5.0 * (rn_r - 1) / (n - 1))) AS INTEGER) AS R_score,
         CAST(greatest(1, ceil(5.0 * (rn_f - 1) / (n - 1))) AS INTEGER) AS F_score,
         CAST(greatest(1, ceil(5.0 * (rn_m - 1) / (n - 1))) AS INTEGER) AS M_score
  FROM ranked),
seg AS (
  SELECT *, R_score + F_score + M_score AS RFM_score,
    CASE WHEN R_score >= 4 AND F_score >= 4 AND M_score >= 4 THEN 'Champions'
         WHEN R_score >= 4 AND F_score >= 3 THEN 'Loyal Customers'
         WHEN R_score >= 4 AND F_score <= 2 THEN 'New Customers'
         WHEN R_score >= 3 AND F_score >= 3 AND M_score >= 3 THEN 'Potential Loyalists'
         WHEN R_score >= 3 AND F_score <= 2 THEN 'Promising'
         WHEN R_score <= 2 AND F_score >= 3 AND M_score >= 3 THEN 'At Risk'
         WHEN R_score <= 2 AND F_score >= 4 THEN 'Hibernating'
         WHEN R_score <= 2 AND F_score <= 2 AND M_score <= 2 THEN 'Lost'
         ELSE 'Regular' END AS segment
  FROM scores)"""


PERIOD_SQL = {"D": "day", "W": "week", "M": "month", "Q": "quarter"}


def period_offset_sql(later: str, earlier: str, period: str) -> str:
    if period == "D":
        return f"CAST(date_diff('day', {earlier}, {later}) AS BIGINT)"
    if period == "W":
        return f"CAST(date_diff('day', {earlier}, {later}) // 7 AS BIGINT)"
    if period == "M":
        return f"CAST((year({later}) - year({earlier})) * 12 + month({later}) - month({earlier}) AS BIGINT)"
    return f"CAST((year({later}) - year({earlier})) * 4 + quarter({later}) - quarter({earlier}) AS BIGINT)"


def cohort_cte(source: str, period: str) -> str:
    unit = PERIOD_SQL[period]
    return f"""t AS ({source}),
f AS (SELECT customer_id, min(date) AS first_purchase FROM t WHERE customer_id IS NOT NULL GROUP BY 1),
x AS (SELECT t.customer_id, CAST(date_trunc('{unit}', f.first_purchase) AS DATE) AS cohort,
             CAST(date_trunc('{unit}', t.date) AS DATE) AS period, t.amount
      FROM t JOIN f ON t.customer_id = f.customer_id),
y AS (SELECT *, {period_offset_sql('period', 'cohort', period)} AS period_offset FROM x),
sizes AS (SELECT cohort, COUNT(DISTINCT customer_id) AS cohort_size FROM y GROUP BY 1),
cells AS (SELECT cohort, period_offset, COUNT(DISTINCT customer_id) AS active,
                 COALESCE(SUM(amount), 0) AS revenue FROM y GROUP BY 1, 2),
offs AS (SELECT DISTINCT period_offset FROM cells),
report AS (
  SELECT g.cohort, g.period_offset, g.cohort_size,
         COALESCE(c.active, 0) AS active, CAST(COALESCE(c.revenue, 0) AS DOUBLE) AS revenue,
         COALESCE(c.active, 0) / g.cohort_size AS retention,
         COALESCE(c.revenue, 0) / g.cohort_size AS arpu
  FROM (SELECT cohort, cohort_size, period_offset FROM sizes, offs) g
  LEFT JOIN cells c ON c.cohort = g.cohort AND c.period_offset = g.period_offset)"""


def clv_summary_cte(source: str = TXN) -> str:
    return f"""t AS ({source}),
e AS (SELECT max(date) AS end_ts FROM t),
g AS (SELECT customer_id, min(date) AS fp, max(date) AS lp, COUNT(*) - 1 AS frequency, avg(amount) AS mv
      FROM t WHERE customer_id IS NOT NULL GROUP BY customer_id),
s AS (SELECT customer_id, frequency, {days('e.end_ts', 'fp')} AS T, {days('lp', 'fp')} AS recency,
             CASE WHEN frequency = 0 THEN 0.0 ELSE mv END AS monetary_value FROM g, e)"""


def bgnbd_ll_sql(r, alpha, a, b) -> str:
    return f"""(lgamma({r} + frequency) - lgamma({r}) + {r} * ln({alpha}) - ({r} + frequency) * ln({alpha} + T)
  + lgamma({a} + {b}) + lgamma({b} + frequency) - lgamma({b}) - lgamma({a} + {b} + frequency)
  + CASE WHEN frequency > 0 THEN ln(1 + exp(ln({a}) - ln({b} + frequency - 1)
        + ({r} + frequency) * ln(({alpha} + T) / ({alpha} + recency)))) ELSE 0 END)"""


def gg_ll_sql(p, q, g) -> str:
    return f"""(lgamma({p} * frequency + {q}) - lgamma({p} * frequency) - lgamma({q}) + {q} * ln({g})
  + ({p} * frequency - 1) * ln(monetary_value) + {p} * frequency * ln(frequency)
  - ({p} * frequency + {q}) * ln({g} + frequency * monetary_value))"""


def expected_purchases_cte(r, alpha, a, b, t, terms=150) -> str:
    """E[X(t)] through the untransformed 2F1 series summed with lgamma."""
    return f"""hs AS (
  SELECT customer_id, sum(exp(
      lgamma({r} + frequency + n) - lgamma({r} + frequency)
    + lgamma({b} + frequency + n) - lgamma({b} + frequency)
    - lgamma({a} + {b} + frequency - 1 + n) + lgamma({a} + {b} + frequency - 1)
    - lgamma(n + 1) + n * ln({t} / ({alpha} + T + {t})))) AS hyp
  FROM s CROSS JOIN range(0, {terms}) AS rr(n) GROUP BY customer_id),
ep AS (
  SELECT s.*, greatest(0.0, ({a} + {b} + frequency - 1) / ({a} - 1)
      * (1 - power(({alpha} + T) / ({alpha} + T + {t}), {r} + frequency) * hs.hyp)
      / (1 + CASE WHEN frequency > 0 THEN {a} / ({b} + frequency - 1)
                 * power(({alpha} + T) / ({alpha} + recency), {r} + frequency) ELSE 0 END)) AS expected_purchases,
      1.0 / (1 + CASE WHEN frequency > 0 THEN {a} / ({b} + frequency - 1)
                 * power(({alpha} + T) / ({alpha} + recency), {r} + frequency) ELSE 0 END) AS p_alive
  FROM s JOIN hs ON s.customer_id = hs.customer_id)"""


def perturbation_sql(draws: dict, horizon: float = 365.0, terms: int = 150) -> str:
    """CLV over literal perturbed parameter rows; published spend formula."""
    vals = ", ".join(f"({k}, {', '.join(repr(float(v)) for v in row)})" for k, row in draws.items())
    t = float(horizon)
    return f"""WITH {clv_summary_cte()},
d(k, r, alpha, a, b, p, q, g) AS (VALUES {vals}),
mb AS (SELECT COALESCE(avg(monetary_value), 0) AS mbar FROM s WHERE frequency >= 1),
sd AS (SELECT * FROM s CROSS JOIN d),
hs AS (SELECT customer_id, k, sum(exp(
      lgamma(r + frequency + n) - lgamma(r + frequency) + lgamma(b + frequency + n) - lgamma(b + frequency)
    - lgamma(a + b + frequency - 1 + n) + lgamma(a + b + frequency - 1) - lgamma(n + 1)
    + n * ln({t} / (alpha + T + {t})))) AS hyp
  FROM sd CROSS JOIN range(0, {terms}) AS rr(n) GROUP BY customer_id, k),
v AS (SELECT sd.customer_id, sd.k,
    CASE WHEN a <= 1 THEN frequency * ({t} / greatest(T, 1e-9))
         ELSE greatest(0.0, (a + b + frequency - 1) / (a - 1)
              * (1 - power((alpha + T) / (alpha + T + {t}), r + frequency) * hs.hyp)
              / (1 + CASE WHEN frequency > 0 THEN a / greatest(b + frequency - 1, 1e-9)
                     * power((alpha + T) / (alpha + recency), r + frequency) ELSE 0 END)) END
    * CASE WHEN p * frequency + q - 1 > 1e-9 THEN p * (g + frequency * monetary_value) / (p * frequency + q - 1)
           ELSE mb.mbar END AS clv
  FROM sd JOIN hs ON sd.customer_id = hs.customer_id AND sd.k = hs.k, mb)
SELECT customer_id, round(avg(clv), -1) AS clv_mean, round(quantile_cont(clv, 0.05), -1) AS clv_p05,
       round(quantile_cont(clv, 0.95), -1) AS clv_p95, round(stddev_samp(clv), 0) AS clv_std
FROM v GROUP BY customer_id"""


def dbscan_sql(points_cte: str, dims, eps: float, min_samples: int, select: str = "", tail: str = "") -> str:
    """DBSCAN in SQL: neighbours by a self-join, components by a recursive
    transitive closure over core-core edges, borders to the smallest
    adjacent component; clusters numbered by their smallest core id."""
    d2 = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in dims)
    lim = float(eps) * float(eps) * (1 + 1e-12)
    return f"""WITH RECURSIVE {points_cte},
nb AS (SELECT p.id AS a, q.id AS b FROM pts p JOIN pts q ON {d2} <= {lim}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING COUNT(*) >= {min_samples}),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id),
reach(src, dst) AS (SELECT id, id FROM core UNION SELECT r.src, ce.b FROM reach r JOIN ce ON r.dst = ce.a),
comp AS (SELECT src AS id, min(dst) AS lab FROM reach GROUP BY src),
border AS (SELECT nb.a AS id, min(comp.lab) AS lab FROM nb JOIN comp ON nb.b = comp.id
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
num AS (SELECT lab, CAST(dense_rank() OVER (ORDER BY lab) - 1 AS BIGINT) AS cluster FROM (SELECT DISTINCT lab FROM comp))
SELECT {select or "pts.id AS customer_id, COALESCE(num.cluster, -1) AS cluster"}
FROM pts LEFT JOIN lab ON pts.id = lab.id LEFT JOIN num ON lab.lab = num.lab {tail}"""


def single_linkage_sql(points_cte: str, dims, n_clusters: int = 0) -> str:
    """Single linkage in SQL: the minimum spanning tree point by point (Prim) in recursive steps.
    With ``n_clusters`` the labels after the longest edges are left out, else the heights and their counts."""
    d2 = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in dims)
    nd2 = " + ".join(f"({c} - p_{c}) * ({c} - p_{c})" for c in dims)
    xs = ", ".join(dims)
    picked = ", ".join(f"first_value({c}) OVER w AS p_{c}" for c in dims)
    nearer = "nd < d OR (nd = d AND (nlo < lo OR (nlo = lo AND nhi < hi)))"
    tree = f"""WITH RECURSIVE {points_cte},
uniq AS (SELECT {xs}, min(id) AS id FROM pts GROUP BY {xs}),
prim AS (
  SELECT 0 AS step, q.id, {", ".join(f"q.{c}" for c in dims)}, {d2} AS d, least(p.id, q.id) AS lo, greatest(p.id, q.id) AS hi
  FROM uniq p JOIN uniq q ON p.id <> q.id WHERE p.id = (SELECT min(id) FROM uniq)
  UNION ALL
  SELECT step + 1, id, {xs}, CASE WHEN {nearer} THEN nd ELSE d END, CASE WHEN {nearer} THEN nlo ELSE lo END,
         CASE WHEN {nearer} THEN nhi ELSE hi END
  FROM (SELECT *, {nd2} AS nd, least(id, p_id) AS nlo, greatest(id, p_id) AS nhi
        FROM (SELECT *, first_value(id) OVER w AS p_id, {picked} FROM prim WINDOW w AS (ORDER BY d, lo, hi)) WHERE id <> p_id)),
tree AS (SELECT d, lo, hi FROM prim QUALIFY row_number() OVER (PARTITION BY step ORDER BY d, lo, hi) = 1)"""
    if not n_clusters:
        return tree + "\nSELECT round(sqrt(d), 6) AS height, COUNT(*) AS merges FROM tree GROUP BY 1"
    return tree + f""",
short AS (SELECT lo, hi FROM tree ORDER BY d DESC, lo DESC, hi DESC OFFSET {n_clusters - 1}),
links AS (SELECT lo AS a, hi AS b FROM short UNION ALL SELECT hi, lo FROM short),
reach(src, dst) AS (SELECT id, id FROM uniq UNION SELECT r.src, links.b FROM reach r JOIN links ON r.dst = links.a),
comp AS (SELECT src AS id, min(dst) AS lab FROM reach GROUP BY src),
named AS (SELECT pts.id, comp.lab FROM pts JOIN uniq USING ({xs}) JOIN comp ON comp.id = uniq.id),
num AS (SELECT lab, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, min(id)) - 1 AS BIGINT) AS cluster FROM named GROUP BY lab)
SELECT named.id AS customer_id, cluster FROM named JOIN num USING (lab)"""


def permuted_sql(n: str, a: str, b: str, group: str, position: str, source: str, seed: int = 0, walks: int = 6) -> str:
    """CTEs w0 .. that end in ``permuted(<group>, <position>, x)``: keyed permutations of the
    positions of ``source``, whose columns n, a and b hold the size and the two bases."""
    def hashed(digit: str, r: int) -> str:
        key = f"((({seed * SH.KEY_SEED + r * SH.KEY_ROUND + 1} + {group} * {SH.KEY_GROUP}) % {SH.PRIME}) * {SH.FACTOR} % {SH.PRIME})"
        t = f"(({digit} + {key}) % {SH.PRIME})"
        return f"((({t} * {t} + {key}) % {SH.PRIME}) * {SH.FACTOR} % {SH.PRIME})"

    keep = f"{group}, {position}, {n}, {a}, {b}"
    parts, last = [f"w0 AS (SELECT {keep}, CAST({position} AS BIGINT) AS x FROM {source})"], "w0"
    for w in range(walks):
        again = f"{n} <= x" if w else "TRUE"
        parts.append(f"w{w}s AS (SELECT *, x // {b} AS l, x % {b} AS r FROM {last})")
        prev = f"w{w}s"
        for i in range(SH.ROUNDS):
            new = f"l, (r + {hashed('l', i)}) % {b} AS r" if i % 2 else f"(l + {hashed('r', i)}) % {a} AS l, r"
            parts.append(f"w{w}r{i} AS (SELECT {keep}, x, {new} FROM {prev})")
            prev = f"w{w}r{i}"
        last = f"w{w + 1}"
        parts.append(f"{last} AS (SELECT {keep}, CASE WHEN {again} THEN l * {b} + r ELSE x END AS x FROM {prev})")
    parts.append(f"permuted AS (SELECT {group}, {position}, x FROM {last})")
    return ",\n".join(parts)
