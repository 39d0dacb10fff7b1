"""SQL for DuckDB that gives the rows of the operators that SQL can express."""

from __future__ import annotations

from . import lexical, repair, url_filter, warc_zip

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
x AS (SELECT r, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS s FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN c ON c.a = d.r JOIN d o ON o.r = c.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""

OP8 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, r, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
h AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (g) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
k AS (SELECT r, p, x FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN h USING (r, p)),
j AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN j USING (r)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS g FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d)),
q AS (SELECT r, i FROM s JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) USING (g)),
z AS (SELECT r, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY r ORDER BY i)),
u AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM z) GROUP BY r, k),
v AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM u),
t AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, list(a ORDER BY a) AS la, list(before ORDER BY a) AS lb FROM v GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN t.r IS NULL THEN x ELSE list_aggregate(list_transform(range(1, len(la) + 1), lambda k: substr(x, 2 * lb[k] + 1, 2 * (la[k] - lb[k]))), 'string_agg', '') || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_zip": warc_zip.ORACLE, "op4_url_filter": url_filter.ORACLE, "op5_winnowing": OP5, "op6_jaccard_join": OP6, "op8_relative_lz": OP8, "op9_bwt_merge": OP9, "op12_lexical": lexical.ORACLE, "op13_repair": repair.ORACLE}
