"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CHUNKS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

WARC = """SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages)"""

WINNOWING = f"""WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark), part AS (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
span AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM part)),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM span) WHERE len(w) >= n)),
hit AS (SELECT doc_id, place.n, i, item_id FROM place JOIN span USING (s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

MINHASH = f"""WITH RECURSIVE doc AS (SELECT doc_id, {CHUNKS} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM overlap JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept FROM doc LEFT JOIN size USING (doc_id) JOIN part USING (doc_id)"""



def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text."""
    start = f"[CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all({text}, '.'), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce({start}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


PERIODIC = rf"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce({_crc32("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents),
place AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM doc),
planted AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] END) ELSE w END AS w FROM place),
word AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS w FROM planted),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k HAVING max(i) + 1 + q - min(i) >= greatest(6, 4 * q)),
run AS (SELECT r, s, e - s AS l, min(q) AS q FROM island GROUP BY r, s, e),
listed AS (SELECT r, count(*) AS n_runs, arg_min([s, l, q], [-l, s, q]) AS top, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS runs FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[1] AS start, top[2] AS length, top[3] AS period, 1000 * top[2] // top[3] AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)"""


#: Each level of the trees of 3 nodes a run, from the leaves up; then every leaf climbs its levels with its own path.
MERKLE = f"""WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || source, '0') AS k,
{" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))} AS head, text, coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0, false) AS tampered FROM documents),
digest AS (SELECT r, doc_id, k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(u) || ':' || u, '-')) AS altered FROM (SELECT *, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS u FROM doc)),
leaf AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM digest),
node AS (SELECT 0 AS level, k, i, leaf AS h, n FROM leaf UNION ALL SELECT max(level) + 1, k, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM node WHERE n > 1 GROUP BY k, i // 3),
source AS (SELECT k, h, level AS height, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS level, i, h, n FROM source UNION ALL SELECT max(level) + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY i // 3),
step AS (SELECT leaf.r, node.level, string_agg(h, '' ORDER BY node.i) FILTER (node.i < leaf.i // CAST(3 ** node.level AS BIGINT)) AS b, string_agg(h, '' ORDER BY node.i) FILTER (node.i > leaf.i // CAST(3 ** node.level AS BIGINT)) AS a
FROM leaf JOIN node ON leaf.k = node.k AND node.n > 1 AND node.i // 3 = leaf.i // CAST(3 ** (node.level + 1) AS BIGINT) GROUP BY leaf.r, node.level
UNION ALL SELECT leaf.r, source.height + top.level, string_agg(top.h, '' ORDER BY top.i) FILTER (top.i < source.i // CAST(3 ** top.level AS BIGINT)), string_agg(top.h, '' ORDER BY top.i) FILTER (top.i > source.i // CAST(3 ** top.level AS BIGINT))
FROM leaf JOIN source USING (k) JOIN top ON top.n > 1 AND top.i // 3 = source.i // CAST(3 ** (top.level + 1) AS BIGINT) GROUP BY leaf.r, source.height + top.level),
climb AS (SELECT r, 0 AS level, altered AS h FROM leaf UNION ALL SELECT climb.r, climb.level + 1, sha256(coalesce(b, '') || h || coalesce(a, '')) FROM climb JOIN step ON climb.r = step.r AND climb.level = step.level),
proof AS (SELECT r, sha256(string_agg(coalesce(b, '') || coalesce(a, ''), '' ORDER BY level)) AS p FROM step GROUP BY r),
folded AS (SELECT r, arg_max(h, level) AS h FROM climb GROUP BY r)
SELECT doc_id, leaf, source.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaf JOIN source USING (k) JOIN folded USING (r) LEFT JOIN proof USING (r)"""

ORACLES = {"op1_warc": WARC, "op2_winnowing": WINNOWING, "op3_minhash": MINHASH, "op11_merkle": MERKLE, "op12_periodic_runs": PERIODIC}
