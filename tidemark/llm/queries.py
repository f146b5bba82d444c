"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm.bpe import op6_bpe
from tidemark.llm.centroids import op12_centroids
from tidemark.llm.divergence import op13_divergence
from tidemark.llm.embeddings import op10_pigeonhole
from tidemark.llm.language import op1_language
from tidemark.llm.minhash import op8_minhash
from tidemark.llm.mixing import op2_mix
from tidemark.llm.pii import op3_pii
from tidemark.llm.quality import op5_quality
from tidemark.llm.substring import op4_substring
from tidemark.llm.toxicity import op11_toxicity
from tidemark.llm.urlfilter import op9_urls
from tidemark.llm.warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_mix": op2_mix,
    "op3_pii": op3_pii,
    "op4_substring": op4_substring,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_minhash": op8_minhash,
    "op9_urls": op9_urls,
    "op10_pigeonhole": op10_pigeonhole,
    "op11_toxicity": op11_toxicity,
    "op12_centroids": op12_centroids,
    "op13_divergence": op13_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

#: Windows are compared as lists of words, judged by the least doc_id that starts each.
ORACLE["op4_substring"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (
  SELECT doc_id, i, hash(array_to_string(ws[i : i + 12], ' ')) AS h, md5(array_to_string(ws[i : i + 12], ' ')) AS m
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT h, m, min(doc_id) AS d FROM starts GROUP BY h, m),
gone AS (
  SELECT DISTINCT s.doc_id, s.i + k.k AS p FROM starts s JOIN least l ON s.h = l.h AND s.m = l.m AND l.d < s.doc_id
  CROSS JOIN (SELECT unnest(range(0, 13)) AS k) k),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM words x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id LEFT JOIN counts c ON c.doc_id = w.doc_id
"""

#: Digests of hexadecimal numbers are spelled in base 32 five bits at a time.
ORACLE["op7_warc"] = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, hex, octet_length(b) AS n,
    array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
      [strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS s FROM p),
coded AS (
  SELECT page_id, n, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(substr(s, 5 * i + k + 1, 1) AS INTEGER) * (16 >> CAST(k AS INTEGER)))) AS INTEGER), 1)), '') AS d FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < max(page_id) OVER (PARTITION BY hex) THEN max(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM coded
"""

#: Tags with absolute addresses only; the tables have no others. The parts of an address are taken by one pattern, and its spellings made one.
ORACLE["op9_urls"] = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)[^>]*(?:canonical|refresh)[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
raw AS (
  SELECT url AS a, regexp_extract(tag, '(?i)(https?://[^"'' >]+)', 1) AS b FROM tags WHERE regexp_matches(tag, '(?i)https?://')),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM raw UNION SELECT b FROM raw),
parts AS (
  SELECT url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
    regexp_extract(split_part(url, '#', 1), '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?@]*@)?([^/?]*?)(:[0-9]*)?([/?].*)?$', ['scheme', 'who', 'host', 'port', 'more']) AS x FROM urls),
named AS (
  SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    CASE WHEN x.scheme = '' THEN split_part(url, '#', 1) ELSE lower(x.scheme) || '://' || x.who || translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || CASE WHEN x.port IN (':', CASE lower(x.scheme) WHEN 'http' THEN ':80' WHEN 'https' THEN ':443' END) THEN '' ELSE x.port END
      || CASE WHEN starts_with(x.more, '/') THEN '' ELSE '/' END || x.more END AS node FROM parts),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ruled AS (
  SELECT n.url, n.host, n.path, n.node, first(r.host || r.path ORDER BY len(r.host || r.path) DESC) AS rule, first(r.verdict ORDER BY len(r.host || r.path) DESC) AS own
  FROM named n LEFT JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY n.url, n.host, n.path, n.node),
edges AS (SELECT x.node AS a, y.node AS b FROM raw JOIN named x ON x.url = raw.a JOIN named y ON y.url = raw.b),
sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT node AS a, node AS r FROM named UNION SELECT s.b, q.r FROM reach q JOIN sides s ON s.a = q.a),
seen AS (
  SELECT q.a, bool_or(u.own = 'allow') AS allowed, bool_or(u.own = 'block') AS blocked FROM reach q JOIN ruled u ON u.node = q.r GROUP BY q.a)
SELECT p.page_id, coalesce(u.host, '') AS host, coalesce(u.path, '') AS path, u.rule,
  coalesce(u.own, CASE WHEN s.blocked AND NOT coalesce(s.allowed, false) THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN ruled u ON u.url = p.url LEFT JOIN seen s ON s.a = u.node
"""

#: Components are taken at places 1 to 64; a round is one step of the recursion, whose rows carry the centroids as lists by number.
def _rounds() -> str:
    parts = []
    for r in range(4):
        parts.append(f"""
near{r} AS (
  SELECT vec_id, n, x, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT k.vec_id, k.n, k.x, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (k.x[i] - c.c[i]) * (k.x[i] - c.c[i]))) AS d FROM kept k CROSS JOIN c{r} c)
  GROUP BY vec_id, n, x)""")
        if r < 3:
            parts.append(f"""
sums{r} AS (
  SELECT cluster, i, CAST(floor(sum(CAST(x[i] AS HUGEINT)) / count(*)) AS BIGINT) AS rough, sum(CAST(x[i] AS HUGEINT)) AS s, count(*) AS m
  FROM near{r} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
c{r + 1} AS (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
    SELECT cluster, list(CASE WHEN s >= 0 THEN s // m ELSE -((-s + m - 1) // m) END ORDER BY i) AS c FROM sums{r} GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return ",".join(parts)


ORACLE["op12_centroids"] = f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h) AS INTEGER) - 1 AS cluster, x AS c FROM (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM kept ORDER BY h LIMIT 16)),{_rounds()}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM near3 a JOIN c3 c ON c.cluster = a.cluster
"""

#: All kept terms stand against all groups of their language; whole numbers of 128 bits.
ORACLE["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
counts AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN size s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source, s.v),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // CAST(g.total + g.v AS HUGEINT) AS p,
    1 + (1000000000 * (k.n + 1)) // CAST(s.total + s.v AS HUGEINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM placed WHERE part = 'pair' OR r <= 200
"""
