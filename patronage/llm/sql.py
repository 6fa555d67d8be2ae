"""DuckDB SQL of the corpus queries that SQL can express."""
from __future__ import annotations

from .chat_format import CONTROL, END, TURN

#: Links among the documents' word pairs on the full sets, and their closure.
NEAR_DUPLICATES = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT w.doc_id, coalesce(any_value(k), 0) AS n FROM w LEFT JOIN (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id) x
      ON w.doc_id = x.doc_id GROUP BY w.doc_id),
r AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
h AS (SELECT g.doc_id, hash(g.s) AS s, n.n FROM g JOIN r USING (s) JOIN n ON g.doc_id = n.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS t, count(*) AS k FROM h a JOIN h b
      ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (t - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.id WHERE c.low < e.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.low AS component_id, m.low = n.doc_id AS kept
FROM n JOIN (SELECT id, min(low) AS low FROM c GROUP BY id) m ON m.id = n.doc_id
"""

#: Every 200-byte string that starts twice, in texts cut into pieces that overlap by 199 bytes; bytes as hex digits.
REPEATED_STRINGS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT r, h, unnest(range(0, strlen(h) // 2 - 199, 500)) AS p FROM d WHERE strlen(h) >= 400),
piece AS (SELECT r, p, substr(h, CAST(2 * p + 1 AS BIGINT), 1398) AS h FROM places),
starts AS (SELECT r, p, h, unnest(range(0, strlen(h) // 2 - 199)) AS i FROM piece),
named AS (SELECT r, p + i AS p, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM starts),
twice AS (SELECT k FROM named GROUP BY k HAVING COUNT(*) > 1),
hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM named SEMI JOIN twice USING (k)),
run AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM hit),
span AS (SELECT r, g, min(p) AS lo, max(p) + 200 AS hi FROM run GROUP BY r, g),
gap AS (SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS lo, lo AS hi FROM span
        UNION ALL SELECT r, max(hi), NULL FROM span GROUP BY r),
rest AS (SELECT gap.r, string_agg(substr(h, CAST(2 * gap.lo + 1 AS BIGINT), CAST(2 * (coalesce(gap.hi, strlen(h) // 2) - gap.lo) AS BIGINT)), ''
                                  ORDER BY gap.lo) AS h
         FROM gap JOIN d ON gap.r = d.r GROUP BY gap.r),
cut AS (SELECT r, sum(hi - lo) AS n, COUNT(*) AS k FROM span GROUP BY r)
SELECT doc_id, CAST(strlen(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(cut.k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r LEFT JOIN rest ON d.r = rest.r
"""

#: Pairs of one label by cosine, and their closure.
VECTOR_LINKS = """
WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT vec_id, label, len(x) AS d, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM v
      WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
        AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.d = b.d AND a.vec_id < b.vec_id
      WHERE list_dot_product(a.x, b.x) >= 0.98),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c(id, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.id WHERE c.low < e.b)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id)::BIGINT AS n_links, m.low AS component_id, m.low = v.vec_id AS kept
FROM v JOIN (SELECT id, min(low) AS low FROM c GROUP BY id) m ON m.id = v.vec_id
"""


def chat_digest() -> str:
    """Conversations read plainly; the formatted length is counted from the template and the escapes."""
    special = r"\\|" + "|".join("".join("\\" + c if c in r"|[]/<>" and c in "|[]" else c for c in s) for s in CONTROL)
    frame = len(TURN) + 1 + len(END) + 1
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT *, {frame} + length(role) + length(text) + len(regexp_extract_all(role, '{special}'))
        + length(role) - length(replace(role, chr(10), '')) + len(regexp_extract_all(text, '{special}')) AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(n)::BIGINT AS formatted_chars FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
