"""SQL for the queries that SQL can say over whole tables, for DuckDB."""

from __future__ import annotations

from hazardlens.llm import secret_scan

_WORD = r"'[^\x20\x09-\x0D]+'"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
head AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM win JOIN head USING (s) WHERE d < doc_id),
place AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM place ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, least(len(ws), 1)))) AS i FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id, coalesce(k, 0) AS n_links
FROM documents LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(r) AS least_id FROM reach GROUP BY a) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM link GROUP BY a) USING (doc_id)"""

SUFFIX = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i - 1, 200) AS s FROM (SELECT doc_id, x, unnest(generate_series(1, len(x) // 2 - 99)) AS i FROM t)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
place AS (SELECT doc_id, substr(x, 2 * p - 1, 2) AS byte, p FROM (SELECT doc_id, x, unnest(generate_series(1, len(x) // 2)) AS p FROM t)),
near AS (SELECT doc_id, p, byte, max(i) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS i FROM place LEFT JOIN (SELECT doc_id, i, i AS p FROM again) USING (doc_id, p)),
flag AS (SELECT doc_id, p, byte, coalesce(p - i < 100, false) AS gone FROM near),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM flag),
per AS (SELECT doc_id, count(*) FILTER (gone) AS r, count(*) FILTER (opens) AS k, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edge GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN per USING (doc_id)"""


URLS = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
a AS (SELECT page_id, n, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM a JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM a LEFT JOIN fit USING (n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_secret_scan": secret_scan.base_sql(), "op8_suffix_dedup": SUFFIX, "op9_substring_dedup": SUBSTRING, "op10_jaccard_join": JACCARD,
        "op11_url_filter": URLS,
    }
