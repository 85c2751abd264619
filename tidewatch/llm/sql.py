"""SQL for the queries that SQL can express."""

from __future__ import annotations

SPLIT = "list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')"
EMPTY = "sha256('')"

OP10 = f"""WITH w AS (SELECT doc_id, {SPLIT.format(x="coalesce(text, '')")} ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) i FROM w)),
f AS (SELECT k, min(doc_id) m FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) j FROM (SELECT g.doc_id, i FROM g JOIN f USING (k) WHERE m < g.doc_id)),
p AS (SELECT doc_id, unnest(ws) x, generate_subscripts(ws, 1) j FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) t FROM p ANTI JOIN c USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) removed FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT n_words, coalesce(removed, 0)::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP2 = f"""WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) i FROM w)),
f AS (SELECT k, min(doc_id) m FROM g GROUP BY k),
s AS (SELECT g.doc_id, i FROM g JOIN f USING (k) WHERE m < g.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) j FROM s),
n AS (SELECT doc_id, count(*) removed, count(*) FILTER (NOT joined) spans FROM (SELECT doc_id, j, coalesce(lag(j) OVER (PARTITION BY doc_id ORDER BY j) = j - 1, false) joined FROM c) GROUP BY doc_id),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) j FROM w),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * j + 1, 2), '' ORDER BY j) t FROM p ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, (length(h) // 2)::BIGINT n_bytes, coalesce(removed, 0)::BIGINT n_removed, coalesce(spans, 0)::BIGINT n_spans, CASE WHEN t IS NULL THEN {EMPTY} ELSE sha256(unhex(t)) END kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format(x="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) c FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(c, w.doc_id)::BIGINT component_id, coalesce(c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

NIBBLE = "(strpos('0123456789abcdef', substr(h, {i} + 1, 1)) - 1)"
OP6 = f"""WITH w AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT payload_bytes, sha1(coalesce(html, '')) h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) m FROM w)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((16 * {NIBBLE.format(i='(5 * i) // 4')} + {NIBBLE.format(i='(5 * i) // 4 + 1')}) >> (3 - (5 * i) % 4)) & 31) + 1)::BIGINT, 1)), '') payload_digest,
CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END record_type, CASE WHEN m <> page_id THEN m END refers_to FROM f"""

SQL = {"op2_suffix_dedup": OP2, "op4_minhash_forest": OP4, "op6_warc": OP6, "op10_window_dedup": OP10}
