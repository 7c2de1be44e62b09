"""DuckDB SQL of the catalogue's queries.

That of the document map knows how the pages of the table are built (one article with a heading and paragraphs, bold
that is never closed and so goes on from paragraph to paragraph) and writes the results down from there; it
shares nothing with the parser.
"""

from __future__ import annotations

from ..operators.events import CLASSES
from .catalog import DRAFTS, KINDS, REFERENCES

_P = "^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)"


def _scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '{_P}', 1))"


def _authority(u: str) -> str:
    return f"regexp_extract({u}, '{_P}', 2)"


def _host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({_authority(u)}, '^.*@', ''), ':[0-9]*$', ''))"


def _path(u: str) -> str:
    return f"regexp_extract({u}, '{_P}', 3)"


def canonical(u: str) -> str:
    at = f"lower({_authority(u)})"
    port = f"CASE {_scheme(u)} WHEN 'http' THEN regexp_replace({at}, ':80$', '') WHEN 'https' THEN regexp_replace({at}, ':443$', '') ELSE {at} END"
    path = f"CASE WHEN regexp_full_match({_path(u)}, '/+') THEN '/' ELSE regexp_replace({_path(u)}, '/+$', '') END"
    return f"CASE WHEN regexp_matches({u}, '{_P}') THEN {_scheme(u)} || '://' || {port} || {path} ELSE regexp_replace({u}, '[?#].*$', '') END"


_C = canonical("url")
_LINKS = """(SELECT page_id, url, CAST(unnest(range(len(f))) AS INT) AS ord, replace(unnest(f), '&amp;', '&') AS raw
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS f FROM pages))"""
# the links here are absolute or begin with a slash, without dot segments
_RESOLVED = f"CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN raw WHEN raw LIKE '/%' THEN {_scheme('url')} || '://' || {_authority('url')} || raw ELSE {_scheme('url')} || '://' || {_authority('url')} || CASE WHEN raw = '' OR raw LIKE '#%' OR raw LIKE '?%' THEN raw ELSE '/' || raw END END"


def _tags(name: str) -> str:
    return f"CAST(len(regexp_extract_all(html, '<{name}[ >]')) AS BIGINT)"


def _asset(u: str, digest: str = "") -> str:
    p = _path(u)
    base = f"regexp_replace(regexp_extract({p}, '([^/]*)/*$', 1), '\\.[^.]*$', '')"
    safe = f"regexp_replace({base}, '[/\\\\:*?\"<>| ]', '_', 'g')"
    ext = f"regexp_extract({p}, '\\.([^./]*)$', 1)"
    return f"'assets/images/' || CASE WHEN {safe} = '' THEN 'asset' ELSE {safe} END || '-' || {digest or f'sha256({u})'}[1:7] || CASE WHEN {ext} <> '' THEN '.' || {ext} ELSE '' END"


def _text(x: str) -> str:
    """Text of the tables' HTML: few references stand in it, and a cut-off one may lack its semicolon."""
    whole = f"regexp_replace({x}, '&(amp|quot)(<|$)', '&\\1;\\2', 'g')"
    plain = f"regexp_replace({whole}, '<[^>]*>', '', 'g')"
    return f"replace(replace(replace(replace({plain}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def _html(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _md(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim({x}), '\\s+', ' ', 'g'), '([\\\\*_`\\[\\]])', '\\\\\\1', 'g')"


def _values(rows) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


_JITTER = "(CAST('0x' || md5({})[1:8] AS BIGINT) % 501)"
_KNOWN = _values((k, *row) for k, row in enumerate(CLASSES))
# formatting that is on is at most three of a kind, and a paragraph that begins a new one has that inside them
_DOM = f"""
WITH raw AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article><h1>([^<]*)</h1>', 1) AS head, regexp_extract(html, '(?s)<div class="ad">([^<]*)</div>', 1) AS ad,
    regexp_extract(html, '<!--.*?-->') AS note, string_split(regexp_extract(html, '(?s)<article><h1>[^<]*</h1>(.*)</article>', 1), '<p>')[2:] AS f FROM pages),
cut AS (SELECT page_id, unnest(range(len(f))) AS k, unnest(f) AS x FROM raw),
bold AS (SELECT *, x LIKE '<b>%' AS b, sum(CASE WHEN x LIKE '<b>%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS n, {_text('x')} AS t FROM cut),
each AS (SELECT page_id, k, b, t, CASE WHEN b THEN least(n - 1, 3) + 1 ELSE least(n, 3) END AS w FROM bold),
once AS (SELECT * FROM each WHERE (b OR trim(t) <> '') QUALIFY row_number() OVER (PARTITION BY page_id, b, w, trim(t) ORDER BY k) = 1),
text AS (SELECT page_id, sum(length(replace(t, ' ', ''))) AS solid FROM each GROUP BY 1),
body AS (SELECT page_id, string_agg('<p>' || repeat('<b>', w::INT) || {_html('t')} || CASE WHEN b THEN '<br>' ELSE '' END || repeat('</b>', w::INT) || '</p>', '' ORDER BY k) AS inner_html,
    string_agg(CASE WHEN trim(t) <> '' THEN '**' || {_md('t')} || '**' END, chr(10) || chr(10) ORDER BY k) AS inner_md FROM once GROUP BY 1),
page AS (SELECT page_id, url, {_text('head')} AS head, {_text('ad')} AS ad, note, coalesce(inner_html, '') AS inner_html, inner_md, coalesce(solid, 0) + length(replace({_text('head')}, ' ', '')) AS solid
    FROM raw LEFT JOIN body USING (page_id) LEFT JOIN text USING (page_id)),
sized AS (SELECT *, CASE WHEN solid >= 50 THEN 1 WHEN solid + length(replace(ad, ' ', '')) >= 50 THEN 3 END AS layer, '<article><h1>' || {_html('head')} || '</h1>' || inner_html || '</article>' AS article,
    '# ' || {_md('head')} || coalesce(chr(10) || chr(10) || inner_md, '') AS article_md FROM page),
doc AS (SELECT page_id, url, layer, CASE layer WHEN 1 THEN 'article' WHEN 3 THEN 'body' END AS selector,
    CASE layer WHEN 1 THEN article WHEN 3 THEN '<body>' || note || '<div class="ad">' || {_html('ad')} || '</div>' || article || '</body>' END AS content_html,
    CASE layer WHEN 1 THEN article_md WHEN 3 THEN {_md('ad')} || chr(10) || chr(10) || article_md END AS markdown,
    CASE WHEN layer IS NOT NULL THEN trim(regexp_replace({_md('head')}, '`|\\*\\*|__|[*_\\[\\]]', '', 'g')) END AS title,
    CASE layer WHEN 1 THEN NULL WHEN 3 THEN 'normalize' ELSE 'extract' END AS stage, CASE layer WHEN 1 THEN NULL WHEN 3 THEN 'orphan content outside root hierarchy' ELSE 'no content' END AS cause FROM sized),
named AS (SELECT *, {_C} AS canonical_url, nullif(list_filter(string_split({_path(_C)}, '/'), lambda x: x <> '')[1], '') AS section FROM doc),
final AS (SELECT page_id, canonical_url, title, section, markdown, CASE WHEN stage IS NULL AND section IS NULL THEN 'normalize' ELSE stage END AS stage,
    CASE WHEN cause IS NULL AND section IS NULL THEN 'section derivation failed' ELSE cause END AS cause FROM named)
"""
_HASHES = "CASE WHEN cause IS NULL THEN 'sha256:' || sha256(canonical_url) END AS doc_id, CASE WHEN cause IS NULL THEN 'sha256:' || sha256(markdown) END AS content_hash"
_BODY = f"(SELECT *, {_text('plain')} AS t FROM (SELECT *, regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '<!--.*?-->', '', 'g') AS plain FROM pages))"
_RESPONSES = """r AS (SELECT *, CASE WHEN status IS NULL THEN 'network issues' WHEN status >= 500 THEN '5xx' WHEN status = 429 THEN 'too many requests' WHEN status >= 400 THEN 'forbidden' WHEN status >= 300 THEN 'reached redirect limit' WHEN page_id % 5 = 0 THEN 'non-HTML content' END AS cause
FROM (SELECT page_id, url, [200, 301, 403, 404, 429, 500, 503, NULL][page_id % 8 + 1] AS status FROM pages))"""
_LOG = f"""WITH {_RESPONSES},
log AS (SELECT 'fetch' AS kind, url AS about, page_id % 3 AS retries, NULL AS cause, page_id FROM r UNION ALL SELECT 'error', url, NULL, cause, page_id FROM r WHERE cause IS NOT NULL
  UNION ALL SELECT 'skip', url, NULL, NULL, page_id FROM r WHERE page_id % 11 = 0 UNION ALL SELECT 'pipeline', url, NULL, NULL, page_id FROM r WHERE cause IS NULL)"""
_SITE = f"{_scheme('cu')} || '://' || lower({_authority('cu')})"
_RULES = _values([
    (0, "/de/", "^/de/", 0, 0, 4), (0, "/de/1", "^/de/1", 1, 0, 5), (0, "/*.html", "^/.*\\.html$", 0, 1, 7), (0, "/fr", "^/fr", 0, 0, 3), (0, "/fr/", "^/fr/", 1, 0, 4), (0, "/es/2", "^/es/2", 0, 0, 5),
    (1, "/es", "^/es", 0, 0, 3), (1, "/*/2", "^/.*/2$", 0, 0, 3), (1, "/es/", "^/es/", 1, 0, 4),
])

SQL = {
    "url_canonicalize": f"SELECT page_id, {_C} AS canonical_url FROM pages",
    "url_dedup_first": f"SELECT {_C} AS canonical_url, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1",
    "url_host_filter": f"SELECT page_id, {_host('url')} AS host FROM pages WHERE {_host('url')} = (SELECT min({_host('url')}) FROM pages)",
    "url_section": f"SELECT page_id, nullif(list_filter(string_split({_path('cu')}, '/'), lambda x: x <> '')[1], '') AS section FROM (SELECT page_id, {_C} AS cu FROM pages)",
    "url_resolve": f"SELECT page_id, CAST(ord AS INT) AS ord, {_scheme('url')} || '://' || {_authority('url')} || way AS resolved FROM pages, {_values((k, w) for k, (_, w) in enumerate(REFERENCES))} v(ord, way)",
    "url_display": "SELECT page_id, CASE WHEN length(url) <= 30 THEN url ELSE url[1:27] || '...' END AS shown FROM pages",
    "link_kinds": f"SELECT page_id, CAST(ord AS INT) AS ord, kind FROM pages, {_values((k, x) for k, (_, _, x) in enumerate(KINDS))} v(ord, kind)",
    "doc_id_sha256": f"SELECT page_id, 'sha256:' || sha256({_C}) AS doc_id, sha256({_C})[1:12] || '.md' AS file FROM pages",
    "links_extract": f"SELECT page_id, url, ord, raw FROM {_LINKS}",
    "links_kind_count": f"SELECT CASE WHEN raw LIKE '#%' THEN 'anchor' ELSE 'navigation' END AS kind, count(*) AS n FROM {_LINKS} GROUP BY 1",
    "links_resolve_same_host": f"SELECT page_id, ord, resolved FROM (SELECT *, {_RESOLVED} AS resolved FROM {_LINKS}) WHERE {_host('resolved')} = {_host('url')}",
    "link_graph_degree": f"SELECT {canonical('resolved')} AS target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM (SELECT *, {_RESOLVED} AS resolved FROM {_LINKS}) GROUP BY 1",
    "robots_decide": f"""
WITH p AS (SELECT page_id, CASE WHEN {_path('cu')} = '' THEN '/' ELSE {_path('cu')} END AS path, length({_SITE}) % 5 AS which FROM (SELECT page_id, {_C} AS cu FROM pages)),
m AS (SELECT page_id, arg_max(allow, size + CASE WHEN ends = 1 OR path = rule THEN 1000 ELSE 0 END - CASE WHEN allow = 1 THEN 0 ELSE 0.5 END) AS allow FROM p JOIN {_RULES} r(which, rule, pattern, allow, ends, size) ON p.which = r.which AND regexp_matches(path, pattern) GROUP BY 1)
SELECT page_id, which <> 4 AND coalesce(allow = 1, true) AS allowed, CASE WHEN which = 4 THEN 'http server error' WHEN which = 3 THEN 'empty_rule_set' WHEN which = 2 THEN 'user_agent_not_matched' WHEN allow = 1 THEN 'allowed_by_robots' WHEN allow = 0 THEN 'disallowed_by_robots' ELSE 'no_matching_rules' END AS reason,
  CASE WHEN which = 0 THEN CAST(2500 AS BIGINT) END AS crawl_delay_ms FROM p LEFT JOIN m USING (page_id)""",
    "tag_counts": "SELECT page_id, " + ", ".join(f"{_tags(t)} AS n_{t}" for t in ("p", "a", "li", "h1", "h2", "code", "div")) + " FROM pages",
    "content_score": f"SELECT page_id, length(regexp_replace(t, '\\s', '', 'g')) AS solid, {_tags('p')} AS paragraphs, {_tags('h1')} AS headings, round(length(regexp_replace(t, '\\s', '', 'g')) / 50.0::DOUBLE + {_tags('p')} * 5 + {_tags('h1')} * 10 + {_tags('li')} * 2, 4) AS score FROM {_BODY}",
    "link_density_filter": f"SELECT * FROM (SELECT page_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1), lambda x: strlen(trim({_text('x')})))), 0) AS BIGINT) AS link_bytes, strlen(t) AS text_bytes FROM {_BODY}) WHERE link_bytes * 100 <= text_bytes",
    "title_extract": f"{_DOM} SELECT page_id, title FROM doc",
    "draft_checks": f"SELECT page_id, cause FROM pages JOIN {_values((k, c) for k, (_, c) in enumerate(DRAFTS))} v(k, cause) ON page_id % {len(DRAFTS)} = k",
    "image_rewrite": f"""
WITH d AS (SELECT page_id, url, '/img/a b' || page_id % 40 || '.png?v=' || page_id AS one, 'https://cdn.example.com/i/' || page_id % 30 || '.gif' AS two FROM pages),
u AS (SELECT *, {canonical('resolved')} AS key FROM (SELECT page_id, 0 AS ord, one AS raw, {_scheme('url')} || '://' || {_authority('url')} || one AS resolved FROM d UNION ALL SELECT page_id, 1, two, two FROM d)),
f AS (SELECT *, CAST(regexp_extract(resolved, '([0-9]+)[.](png|gif)', 1) AS INT) AS k FROM (SELECT key, arg_min(resolved, page_id * 2 + ord) AS resolved, min(page_id * 2 + ord) AS spot FROM u GROUP BY 1)),
h AS (SELECT *, CASE k % 7 WHEN 0 THEN 'forbidden' WHEN 1 THEN '5xx' END AS cause, sha256('bytes' || k % 10) AS hash FROM f),
g AS (SELECT key, cause, CASE WHEN cause IS NULL THEN first_value({_asset('resolved', 'hash')}) OVER (PARTITION BY (cause IS NULL), hash ORDER BY spot, key) END AS path FROM h),
x AS (SELECT page_id, ord, raw, resolved, cause, path FROM u JOIN g USING (key)),
o AS (SELECT page_id, max(CASE WHEN ord = 0 THEN coalesce(path, raw) END) AS one, max(CASE WHEN ord = 1 THEN coalesce(path, raw) END) AS two, coalesce(list_aggregate(list_sort(list_distinct(list(path) FILTER (path IS NOT NULL))), 'string_agg', '|'), '') AS local,
  coalesce(list_aggregate(list_sort(list_distinct(list(resolved || ' ' || cause) FILTER (cause IS NOT NULL))), 'string_agg', '|'), '') AS missing FROM x GROUP BY 1)
SELECT page_id, 'x ![one](' || one || ') y ![two](' || two || ') z ![one](' || one || ')' AS markdown, local, missing FROM o""",
    "asset_path": f"SELECT page_id, {_asset('cu')} AS path FROM (SELECT page_id, {_C} AS cu FROM pages)",
    "content_dedup": "SELECT 'sha256:' || sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "event_stats": f"WITH {_RESPONSES} SELECT count(*) AS pages_visited, count(*) FILTER (cause IS NULL) AS pages_processed, count(cause) AS errors, CAST(7 AS BIGINT) AS assets, count(*) FILTER (cause IN ('forbidden', 'non-HTML content')) AS manual_retries FROM r",
    "event_kinds": f"{_LOG} SELECT kind, count(*) AS n, count(DISTINCT about) AS n_urls, CAST(sum(retries) AS BIGINT) AS retries, max(page_id) AS last_seq FROM log GROUP BY 1",
    "event_rollup": f"{_LOG} SELECT kind, cause, count(*) AS n FROM log GROUP BY ROLLUP (1, 2)",
    "journal_rows": f"WITH {_RESPONSES} SELECT url, 'fetch' AS stage, cause AS error, CAST(page_id % 3 AS INT) AS retry_count FROM r WHERE cause IN ('forbidden', 'non-HTML content')",
    "retry_backoff_schedule": f"SELECT page_id, CAST(k AS INT) AS attempt, CAST(least(10000, least(10000, 100 * pow(2, k - 1)) + {_JITTER.format("page_id || '-' || k")}) AS BIGINT) AS wait_ms FROM pages, range(1, 10) t(k)",
    "politeness_schedule": f"""
WITH p AS (SELECT page_id, {_host('url')} AS host, CASE WHEN page_id % 3 = 0 THEN 2500 ELSE 1000 END + {_JITTER.format('page_id::VARCHAR')} AS base, page_id % 4 > 1 AS no FROM pages),
q AS (SELECT *, sum(CASE WHEN no THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY page_id) AS run FROM p),
w AS (SELECT page_id, host, CAST(base + CASE WHEN no THEN least(10000, 100 * pow(2, sum(CASE WHEN no THEN 1 ELSE 0 END) OVER (PARTITION BY host, run ORDER BY page_id) - 1)) ELSE 0 END AS BIGINT) AS wait_ms FROM q)
SELECT page_id, host, wait_ms, CAST(coalesce(sum(wait_ms) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM w""",
    "error_classify": f"""
WITH {_RESPONSES}, k(k, stage, cause, policy, canonical_cause) AS (SELECT * FROM {_KNOWN})
SELECT page_id, stage, cause, policy, canonical_cause, 'continue' AS impact FROM r JOIN k USING (cause) WHERE stage = 'fetch' UNION ALL SELECT page_id, stage, cause, policy, canonical_cause, 'continue' FROM pages JOIN k ON page_id % {len(CLASSES)} = k""",
    "bfs_levels": """
WITH RECURSIVE e AS (SELECT 'https://h/r/' || n_regionkey AS a, 'https://h/n/' || n_nationkey AS b FROM nation UNION SELECT 'https://h/n/' || n_nationkey, 'https://h/r/' || n_nationkey % 5 FROM nation UNION SELECT 'https://h/n/' || n_nationkey, 'https://h/r/' || n_nationkey % 3 FROM nation),
w(url, depth) AS (SELECT 'https://h/r/0', 0 UNION SELECT b, depth + 1 FROM w JOIN e ON a = url WHERE depth < 4)
SELECT url, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1""",
    "crawl_order": """
WITH one AS (SELECT n_nationkey AS n, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_regionkey = 0),
two AS (SELECT region, min(k * 2 + ord) AS spot FROM (SELECT n % 5 AS region, k, 0 AS ord FROM one UNION ALL SELECT n % 3, k, 1 FROM one) WHERE region NOT IN (0, 1) GROUP BY 1),
every AS (SELECT 'https://h/r/0' AS url, 0 AS depth, 0 AS spot UNION ALL SELECT 'https://h/n/' || n, 1, k FROM one UNION ALL SELECT 'https://h/r/' || region, 2, spot FROM two
  UNION ALL SELECT 'https://h/n/' || n_nationkey, 3, spot * 100 + n_nationkey FROM nation JOIN two ON n_regionkey = region)
SELECT url, CAST(depth AS INT) AS depth, CAST(row_number() OVER (ORDER BY depth, spot) AS INT) AS place FROM every QUALIFY row_number() OVER (ORDER BY depth, spot) <= 8""",
    "extract_main": f"{_DOM} SELECT page_id, CAST(layer AS INT) AS layer, selector, length(content_html) AS n_chars, CASE WHEN stage = 'extract' OR layer = 3 THEN cause END AS cause FROM doc",
    "sanitize_doc": f"{_DOM} SELECT page_id, content_html, CASE WHEN layer IS NOT NULL THEN '' END AS links FROM doc",
    "to_markdown": f"{_DOM} SELECT page_id, markdown, CASE WHEN layer IS NOT NULL THEN '' END AS refs FROM doc",
    "normalize_doc": f"{_DOM} SELECT page_id, title, section, {_HASHES}, stage, cause FROM final",
    "pipeline_full": f"{_DOM} SELECT page_id, canonical_url, title, section, {_HASHES}, CASE WHEN cause IS NULL THEN sha256(canonical_url)[1:12] || '.md' END AS file, stage, cause, '' AS local FROM final",
    "markdown_manifest": f"""{_DOM}, files AS (SELECT page_id, sha256(canonical_url) AS u, sha256(markdown) AS m FROM final WHERE cause IS NULL QUALIFY row_number() OVER (PARTITION BY sha256(canonical_url)[1:12] ORDER BY page_id) = 1)
SELECT u[1:12] AS url_hash, u[1:12] || '.md' AS path, 'sha256:' || m AS content_hash, CAST(NULL AS VARCHAR) AS cause FROM files""",
    "fetch_retries": """
WITH a AS (SELECT page_id, page_id || ' ' || url AS url, k AS attempt, [503, 429, NULL, 200, 403, 200, 500][(page_id * 3 + k * (page_id % 4 + 1)) % 7 + 1] AS status FROM pages, range(1, 6) t(k)),
b AS (SELECT *, CASE WHEN status IS NULL THEN 'network issues' WHEN status >= 500 THEN '5xx' WHEN status = 429 THEN 'too many requests' WHEN status >= 400 THEN 'forbidden' END AS cause FROM a),
c AS (SELECT *, coalesce(cause IN ('network issues', '5xx', 'too many requests'), false) AND attempt < 4 AS again FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY again, attempt) AS k, CASE WHEN attempt > 1 THEN 100 * pow(2, attempt - 2) ELSE 0 END AS wait FROM c),
e AS (SELECT url, status, cause, attempt AS tries FROM d WHERE k = 1)
SELECT url, CAST(status AS INT) AS status, CAST(tries AS INT) AS tries, CAST(CASE WHEN tries > 1 THEN 100 * (pow(2, tries - 1) - 1) ELSE 0 END AS BIGINT) AS wait_ms, cause FROM e""",
    "crawl_progress": """
WITH RECURSIVE e AS (SELECT 'https://h/r/' || n_regionkey AS a, 'https://h/n/' || n_nationkey AS b FROM nation UNION SELECT 'https://h/n/' || n_nationkey, 'https://h/r/' || n_nationkey % 5 FROM nation UNION SELECT 'https://h/n/' || n_nationkey, 'https://h/r/' || n_nationkey % 3 FROM nation),
w(url, depth) AS (SELECT 'https://h/r/0', 0 UNION SELECT b, depth + 1 FROM w JOIN e ON a = url WHERE depth < 4), m AS (SELECT url, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1)
SELECT depth, count(*) AS admitted, count(*) FILTER (url NOT LIKE '%/r/%') AS waiting FROM m GROUP BY 1""",
    "crawl_bfs": f"""
WITH RECURSIVE e AS (SELECT DISTINCT {_C} AS a, {canonical('resolved')} AS b FROM (SELECT *, {_RESOLVED} AS resolved FROM {_LINKS})),
s AS (SELECT arg_min(url, page_id) AS url FROM pages), h AS (SELECT {_host('url')} AS host FROM s),
w(url, depth) AS (SELECT {_C}, 0 FROM s UNION SELECT b, depth + 1 FROM w JOIN e ON a = w.url WHERE depth < 24 AND {_host('b')} = (SELECT host FROM h))
SELECT url, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
