"""The same queries for a SQL engine (DuckDB dialect)."""

from __future__ import annotations

from artiscope.functions import constants as C
from artiscope.functions.text import WORDS_IN_NAME_RE
from artiscope.operators.grouping import CWE_BY_TAG, MITRE_BY_TAG
from artiscope.operators.rules import DEFAULT_RULES
from artiscope.plans.specimens import CHECKSUM, ENTRY, PLAIN_IMAGE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(map(lit, values))


def _valid(x: str) -> str:
    parts = " AND ".join(f"try_cast(string_split({x}, '.')[{k}] AS INT) <= 255 AND regexp_matches(string_split({x}, '.')[{k}], '^(0|[1-9][0-9]{{0,2}})$')" for k in (1, 2, 3, 4))
    return f"({parts} AND {x} NOT IN ('0.0.0.0', '255.255.255.255'))"


_APART = r"regexp_replace(text, '([^0-9A-Za-z_.])', '\1\1', 'g')"


def _first(source: str, key: str, matches: str, valid: str, name: str, limit: int) -> str:
    """The first distinct valid matches, numbered."""
    return f"""
m AS (SELECT {key}, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (SELECT {key}, {matches} AS x FROM {source})),
d AS (SELECT {key}, v, min(i) AS i FROM m WHERE {valid} GROUP BY {key}, v),
r AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS INT) AS pos, v AS {name} FROM d QUALIFY pos < {limit})"""


_IP_ROWS = _first("documents", "doc_id", f"regexp_extract_all({_APART}, {lit(C.IPV4_RE)}, 1)", _valid("v"), "ip", 15)
IPV4 = f"WITH {_IP_ROWS} SELECT doc_id, pos, ip FROM r"


def _private(x: str) -> str:
    starts = " OR ".join(f"starts_with({x}, {lit(p)})" for p in (*C.INTERNAL_PREFIXES, *C.PRIVATE_IP_PREFIXES))
    return f"({starts} OR regexp_matches({x}, {lit(C.PRIVATE_172_RE)}))"


IP_CLASS = f"WITH {_IP_ROWS} SELECT {_private('ip')} AS private, count(*) AS n, count(DISTINCT ip) AS n_ips FROM r GROUP BY ALL"
# RE2 has no look-behind: a match takes in what assigns a version before it, and such matches are left out
_VERSION_MARK = r"(?i)(?:(?:version|fileversion|productversion|assemblyversion|schemaversion)\s*[:=]\s*[\"']?)?\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_VERSION_A, _VERSION_B = "'6.' || (doc_id % 3) || '.0.' || (length(text) % 7)", "'5.1.2.' || (length(text) % 40)"
VERSION_CONTEXT = f"""
WITH t AS (SELECT doc_id, concat(text, ' <a version="', {_VERSION_A}, '"/> on ', {_VERSION_B}, ' FileVersion : ', {_VERSION_B}, '0 and ProductVersion=', {_VERSION_B}, CASE WHEN length(text) % 2 = 0 THEN ' then ' || {_VERSION_A} ELSE '' END, ' end') AS text FROM documents),
{_first("t", "doc_id", f"regexp_extract_all(text, {lit(_VERSION_MARK)})", "NOT regexp_matches(v, '^[A-Za-z]') AND " + _valid("v"), "ip", 15)} SELECT doc_id, pos, ip FROM r"""
EMAIL = "WITH " + _first("documents", "doc_id", f"regexp_extract_all(text, {lit(C.EMAIL_RE)})", f"lower(regexp_extract(v, '@([^@]*)$', 1)) NOT IN ({listed(C.PLACEHOLDER_EMAIL_DOMAINS)})", "email", 10) + " SELECT doc_id, pos, email FROM r"
API = "WITH p AS (SELECT page_id, regexp_replace(url, '/(en|fr|de|es)/', '/v1/\\1/', 'g') || ' /api/list' AS text FROM pages), " + _first("p", "page_id", f"regexp_extract_all(text, {lit(C.API_RE)})", "true", "endpoint", 10) + " SELECT page_id, pos, endpoint FROM r"
_HOST = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def _below(host: str, domains) -> str:
    return "(" + " OR ".join(f"{host} = {lit(x)} OR ends_with({host}, {lit('.' + x)})" for x in domains) + ")"


URLS = (
    "WITH p AS (SELECT page_id, concat_ws(' ', url, html) AS text FROM pages), "
    + _first("p", "page_id", f"list_transform(regexp_extract_all(text, {lit(C.URL_RE)}), lambda u: regexp_replace(u, '[.,;)\"''\"]+$', ''))", f"{_HOST.format('v')} <> '' AND NOT {_below(_HOST.format('v'), C.BOILERPLATE_DOMAINS)}", "url", 15)
    + " SELECT page_id, pos, url FROM r"
)
HOSTS = f"WITH h AS (SELECT {_HOST.format('url')} AS host, count(*) AS n FROM pages GROUP BY 1) SELECT host, n FROM h WHERE NOT {_below('host', ('theres.example.com', 'example.net', *C.BOILERPLATE_DOMAINS))}"
INTERNAL_HOSTS = f"""
WITH p AS (SELECT page_id, string_split(['api.dev.', 'latest.', 'localhost.', '10.0.0.1#', 'qa.'][page_id % 5 + 1] || {_HOST.format('url')}, '#')[1] AS host FROM pages)
SELECT page_id, host, host <> '' AND (starts_with(host, 'localhost') OR starts_with(host, '127.0.0.1') OR starts_with(host, '0.0.0.0')
  OR (coalesce({_valid('host')}, false) AND {_private('host')}) OR list_has_any(string_split(host, '.'), [{listed(C.INTERNAL_LABELS)}])) AS internal FROM p"""
# strings of a binary are runs of printable ASCII
OTHER_HOSTS = ("latest.", "api.staging.", "cdn.", "10.0.0.7:8080/", "qa-")
_PAGE_TEXT = rf"regexp_replace(concat_ws(chr(10), url, replace(url, '://', '://' || [{listed(OTHER_HOSTS)}][length(html) % {len(OTHER_HOSTS)} + 1]), substr(html, 1, 1000)), '[^\x20-\x7e]', chr(10), 'g')"
NETWORK_ARTIFACTS = f"""
WITH p AS (SELECT 'p' || page_id || '.so' AS path, {_PAGE_TEXT} AS text FROM pages),
{_first("p", "path", f"list_transform(regexp_extract_all(text, {lit(C.URL_RE)}), lambda u: regexp_replace(u, '[.,;)\"''\"]+$', ''))", f"{_HOST.format('v')} <> '' AND NOT {_below(_HOST.format('v'), C.BOILERPLATE_DOMAINS)}", "url", 15)},
h AS (SELECT path, url, {_HOST.format('url')} AS host FROM r)
SELECT 'linux-network-artifact-discovery-internal/development-endpoint-referenced' AS rule_id, url AS evidence, min(path) AS file_path FROM h
WHERE starts_with(host, 'localhost') OR starts_with(host, '127.0.0.1') OR starts_with(host, '0.0.0.0') OR (coalesce({_valid('host')}, false) AND {_private('host')}) OR list_has_any(string_split(host, '.'), [{listed(C.INTERNAL_LABELS)}]) GROUP BY url"""
EMBEDDED = EMAIL.replace("SELECT doc_id, pos, email FROM r", "SELECT 'd' || doc_id || '.so' AS file_path, pos, email FROM r")
_PARTS = [PLAIN_IMAGE[:CHECKSUM], PLAIN_IMAGE[CHECKSUM + 4 : ENTRY] + PLAIN_IMAGE[ENTRY + 8 :]]


def _image_digest(text: str) -> str:
    pad = f"unhex(repeat('00', CAST((8 - (octet_length(encode({text})) + {len(PLAIN_IMAGE)}) % 8) % 8 AS INT)))"
    return "sha256(" + " || ".join([*(f"unhex('{p.hex()}')" for p in _PARTS), f"encode({text})", pad]) + ")"


AUTHENTICODE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, {_image_digest("replace(text, 'token', 'entry')")} AS recorded, {_image_digest("text")} AS calculated FROM t)
SELECT 'd' || doc_id || '.exe' AS path, 'sha256' AS algorithm, recorded, calculated, recorded = calculated AS verified FROM d"""
ARCHIVE_LEVELS = """
WITH d AS (SELECT doc_id, text, source || '-' || lang || '-' || (doc_id // 50) AS g FROM documents WHERE length(text) > 0),
a AS (SELECT doc_id, text, g || '.' || ['zip', 'tar', 'tgz', '7z'][length(g) % 4 + 1] || ' > t' || doc_id || '.txt' AS path FROM d)
SELECT path, CAST(1 AS INT) AS depth, sha256(text) AS sha256 FROM a WHERE doc_id % 5 <> 0
UNION ALL SELECT path || '.zip', 1, NULL FROM a WHERE doc_id % 5 = 0
UNION ALL SELECT path || '.zip > t' || doc_id || '.txt', 2, sha256(text) FROM a WHERE doc_id % 5 = 0"""
PLAUSIBLE = r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '([A-Za-z0-9]+)', 1)) AS sld FROM documents)
SELECT sld || '.com' AS name,
  length(sld) >= 3 AND 2 * length(regexp_replace(sld, '[^0-9]', '', 'g')) <= length(sld)
  AND (regexp_matches(sld, '^[^A-Z]*[a-z][^A-Z]*$') OR regexp_matches(sld, '^[^a-z]*[A-Z][^a-z]*$') OR regexp_matches(sld, '^([^A-Za-z]*[A-Z][a-z]*)+[^A-Za-z]*$') OR regexp_matches(sld, '^[0-9]+$')) AS plausible
FROM w"""


def _share(s: str) -> str:
    return f"((length({s}) - length(replace({s}, c, ''))) / length({s}))"


def _entropy(s: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: -{_share(s)} * log2({_share(s)}))), 0)"


def _shaped(s: str) -> str:
    bare = f"rtrim({s}, '=')"
    head = f"hex(try(from_base64(substr(rpad({bare}, CAST(ceil(length({bare}) / 4) * 4 AS INT), '='), 1, 16))))"
    magic = " OR ".join(f"starts_with({head}, {lit(m)})" for m in C.BINARY_MAGICS_HEX)
    return f"(len(list_distinct(string_split({s}, ''))) > 2 AND NOT regexp_matches({s}, '^[0-9]+$') AND NOT regexp_matches({s}, {lit(C.GUID_RE)}) AND NOT (coalesce({magic}, false) AND length({bare}) >= 8))"


def _high(s: str) -> str:
    return f"(length({s}) BETWEEN {C.MIN_TOKEN} AND {C.MAX_TOKEN} AND CASE WHEN regexp_matches({s}, '^[0-9a-fA-F]+$') THEN {_entropy(s)} >= {C.HEX_THRESHOLD} ELSE {_entropy(s)} >= {C.B64_THRESHOLD} END)"


def _secret(s: str) -> str:
    letters = f"length(regexp_replace({s}, '[^A-Za-z]', '', 'g'))"
    worded = f"coalesce(list_sum(list_transform(regexp_extract_all({s}, '{WORDS_IN_NAME_RE}'), lambda w: length(w))), 0)"
    steps = lambda gap, low, high: f"len(list_filter(range(1, length({s}) - {gap} + 1), lambda i: ascii({s}[i + {gap}]) - ascii({s}[i]) BETWEEN {low} AND {high}))"
    symbol = f"({letters} > 0 AND 10 * {worded} >= 6 * {letters} AND 2 * {letters} >= length({s}))"
    lookup = f"(length({s}) > 3 AND (2 * {steps(1, 1, 2)} >= length({s}) - 1 OR 5 * {steps(2, 0, 1)} >= 4 * (length({s}) - 2)))"
    return f"({_shaped(s)} AND {_high(s)} AND NOT {symbol} AND NOT {lookup})"


_FILES = "SELECT source || '/' || doc_id AS file_path, text FROM documents"
_TURNS = "SELECT 'conversations/' || conv_id || '/' || turn AS file_path, text FROM conversations"
_CANDIDATES = "SELECT {key}, unnest(x) AS candidate, CAST(generate_subscripts(x, 1) - 1 AS INT) AS pos FROM (SELECT {key}, regexp_extract_all(text, {re}) AS x FROM ({source}))"
ENTROPY_CANDIDATES = f"SELECT doc_id, pos, candidate, {_shaped('candidate')} AS token_shaped FROM ({_CANDIDATES.format(key='doc_id', re=lit(C.ENTROPY_CANDIDATE_RE), source='SELECT doc_id, text FROM documents')})"
HIGH_ENTROPY = f"SELECT file_path, pos, candidate, round({_entropy('candidate')}, 4) AS entropy, {_secret('candidate')} AS flagged FROM ({_CANDIDATES.format(key='file_path', re=lit(C.ENTROPY_CANDIDATE_RE), source=f'{_FILES} UNION ALL {_TURNS}')})"

# --- rules and findings ---
_LINES = "SELECT file_path, unnest(x) AS line, CAST(generate_subscripts(x, 1) AS INT) AS line_number FROM (SELECT file_path, string_split(text, chr(10)) AS x FROM ({}))"


def _rules(source: str) -> str:
    parts = [f"SELECT {lit(r.id)} AS rule_id, {lit(r.description)} AS title, {lit(r.severity)} AS severity, {lit(r.confidence)} AS confidence, file_path, line_number, line, unnest(list_distinct(regexp_extract_all(line, {lit(r.regex)}, {r.group}))) AS evidence FROM ln" for r in DEFAULT_RULES]
    return f"WITH ln AS ({_LINES.format(source)}) SELECT 'secrets' AS module, rule_id, title, severity, confidence, file_path, evidence, line_number, CAST(instr(line, evidence) AS INT) AS column_number FROM ({' UNION ALL '.join(parts)})"


def _print(source: str) -> str:
    return f"SELECT *, left(sha256(concat_ws('|', module, rule_id, file_path, coalesce(CAST(line_number AS VARCHAR), 'None'), coalesce(CAST(column_number AS VARCHAR), 'None'), 'None', evidence)), 16) AS fingerprint FROM ({source})"


RULE_SCAN = f"SELECT module, rule_id, severity, file_path, evidence, line_number, column_number, fingerprint FROM ({_print(_rules(f'{_FILES} UNION ALL {_TURNS}'))})"
_NONE = "CAST(NULL AS INT) AS line_number, CAST(NULL AS INT) AS column_number"
_FIRST_IP = "WITH " + _first(f"({_FILES})", "file_path", f"regexp_extract_all({_APART}, {lit(C.IPV4_RE)}, 1)", _valid("v"), "evidence", 15)
_FIRST_MAIL = "WITH " + _first(f"({_FILES})", "file_path", f"regexp_extract_all(text, {lit(C.EMAIL_RE)})", f"lower(regexp_extract(v, '@([^@]*)$', 1)) NOT IN ({listed(C.PLACEHOLDER_EMAIL_DOMAINS)})", "evidence", 10)
_P = _private("evidence")
_FINDINGS = _print(
    f"""SELECT * FROM ({_rules(_FILES)})
UNION ALL SELECT 'secrets', CASE WHEN {_P} THEN 'private-ip' ELSE 'hardcoded-ip' END, CASE WHEN {_P} THEN 'Private address' ELSE 'Hard-coded address' END, CASE WHEN {_P} THEN 'Info' ELSE 'Low' END, 'Medium', file_path, evidence, {_NONE} FROM ({_FIRST_IP} SELECT file_path, evidence FROM r)
UNION ALL SELECT 'secrets', 'embedded-email', 'Embedded e-mail address', 'Info', 'High', file_path, evidence, {_NONE} FROM ({_FIRST_MAIL} SELECT file_path, evidence FROM r)
UNION ALL SELECT 'secrets', 'high-entropy-string', 'High-entropy string', 'Medium', 'Low', file_path, candidate, {_NONE} FROM ({_CANDIDATES.format(key='file_path', re=lit(C.ENTROPY_CANDIDATE_RE), source=_FILES)}) WHERE {_secret('candidate')}"""
)


def with_findings(select: str, then: str | None = None) -> str:
    """``select`` over the findings f; ``then`` over its result r."""
    return f"WITH f AS ({_FINDINGS}), r AS ({select}) {then}" if then else f"WITH f AS ({_FINDINGS}) {select}"


_RANKS = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in C.SEVERITY_RANK.items())
_OCC = "o AS (SELECT DISTINCT module, rule_id, lower(trim(title)) AS issue_title, severity, confidence, file_path, line_number, column_number, evidence, file_path || coalesce(' (line ' || line_number || ', column ' || column_number || ')', '') AS location FROM f)"
_ISSUES = f"i AS (SELECT module, rule_id, issue_title, severity, CASE severity {_RANKS} END AS severity_rank, count(*) AS affected_count, min(file_path) AS first_path FROM o GROUP BY ALL)"


_BUNDLED = f"SELECT file_path, replace(text, 'token = \"', 'password = \"Hx7!' || length(text) || '.Lantern\"' || chr(10) || 'token = \"') AS text FROM ({_FILES} UNION ALL {_TURNS})"
BUNDLES = f"""
WITH x AS (SELECT DISTINCT file_path, line_number, column_number, rule_id, evidence, CASE severity {_RANKS} END AS severity_rank FROM ({_rules(_BUNDLED)})),
s AS (SELECT *, CASE WHEN line_number - lag(line_number) OVER o <= 5 THEN 0 ELSE 1 END AS starts FROM x WINDOW o AS (PARTITION BY file_path ORDER BY line_number, column_number, rule_id, evidence)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY file_path ORDER BY line_number, column_number, rule_id, evidence ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT file_path, min(line_number) AS first_line, max(line_number) AS last_line, count(DISTINCT evidence) AS n_secrets, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules, max(severity_rank) AS severity_rank
FROM r GROUP BY file_path, run HAVING count(DISTINCT evidence) >= 2"""
TOKENS = """
WITH d AS (SELECT doc_id, source, text, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0),
t AS (SELECT 'd' || doc_id AS file_path, CASE WHEN n % 3 = 0 THEN 'none' ELSE 'HS256' END AS alg, source AS iss, left(text, 20) AS sub, 1700000000 + n * 10000 AS exp FROM d)
SELECT file_path, CASE WHEN alg = 'none' THEN 'High' WHEN exp <= 1735689600 THEN 'Low' ELSE 'Medium' END AS severity, alg, iss, sub, exp FROM t"""
_CACHED = "SELECT source || '/' || doc_id AS file_path, CASE WHEN length(text) % 3 = 0 THEN text || ' more' ELSE text END AS text FROM documents WHERE length(text) % 5 <> 2"
CACHE = f"""
WITH n AS (SELECT file_path, count(*) AS n FROM ({_rules(_CACHED)}) GROUP BY file_path)
SELECT d.file_path AS path, 'secrets' AS module, sha256(d.text) AS sha256, coalesce(n.n, 0) AS n_findings FROM ({_CACHED}) d LEFT JOIN n ON n.file_path = d.file_path"""


def with_issues(select: str) -> str:
    return f"WITH f AS ({_FINDINGS}), {_OCC}, {_ISSUES} {select}"


GROUPS = f"""WITH f AS ({_FINDINGS}), {_OCC},
n AS (SELECT *, row_number() OVER (PARTITION BY module, rule_id, issue_title, severity ORDER BY file_path, line_number NULLS FIRST, column_number NULLS FIRST, evidence) AS k FROM o)
SELECT module, rule_id, issue_title, severity, count(*) AS affected_count, max(CASE WHEN k = 1 THEN file_path END) AS file_path, max(CASE WHEN k = 1 THEN evidence END) AS evidence,
  CAST(sum(CAST('0x' || substr(md5(location), 1, 8) AS BIGINT)) AS BIGINT) AS locations_sum FROM n GROUP BY ALL"""
_DIM = ", ".join(f"({lit(k)})" for k in C.SEVERITY_RANK)
SUMMARY = with_issues(f"SELECT s.severity, count(i.rule_id) AS unique_issues, CAST(coalesce(sum(i.affected_count), 0) AS BIGINT) AS instances FROM (VALUES {_DIM}) s(severity) LEFT JOIN i ON i.severity = s.severity GROUP BY s.severity")
_RANKED = "SELECT *, row_number() OVER (ORDER BY severity_rank DESC, affected_count DESC, module, rule_id, issue_title) AS k FROM i"
RANK = with_issues(f"SELECT 'W-' || lpad(CAST(k AS VARCHAR), 3, '0') AS report_id, rule_id, issue_title, severity, affected_count FROM ({_RANKED})")
TOP = with_issues(f"SELECT 'W-' || lpad(CAST(k AS VARCHAR), 3, '0') AS report_id, rule_id, severity, affected_count FROM ({_RANKED}) WHERE CASE WHEN (SELECT count(*) FROM i WHERE severity_rank >= 3) > 0 THEN severity_rank >= 3 ELSE severity = 'Medium' END ORDER BY k LIMIT 5")
_PAGE_URLS = "WITH " + _first("(SELECT 'pages/' || page_id AS file_path, url AS text FROM pages)", "file_path", f"list_transform(regexp_extract_all(text, {lit(C.URL_RE)}), lambda u: regexp_replace(u, '[.,;)\"''\"]+$', ''))", f"{_HOST.format('v')} <> '' AND NOT {_below(_HOST.format('v'), C.BOILERPLATE_DOMAINS)}", "evidence", 15)
_EV_HOST = _HOST.format("evidence")
_IS_INTERNAL = f"(starts_with({_EV_HOST}, 'localhost') OR starts_with({_EV_HOST}, '127.0.0.1') OR starts_with({_EV_HOST}, '0.0.0.0') OR list_has_any(string_split({_EV_HOST}, '.'), [{listed(C.INTERNAL_LABELS)}]))"
INVENTORY = with_findings(f"""SELECT rule_id IN ({listed(C.INVENTORY_RULES)}) OR starts_with(rule_id, 'extracted-') AS inventory, rule_id, count(*) AS n FROM (
  SELECT rule_id FROM f UNION ALL SELECT CASE WHEN {_IS_INTERNAL} THEN 'internal-host' ELSE 'extracted-urls' END FROM ({_PAGE_URLS} SELECT file_path, evidence FROM r)) GROUP BY ALL""")
UI_FILTER = f"""WITH f AS ({_FINDINGS}), {_OCC}
SELECT rule_id, severity, count(*) AS affected_count FROM o GROUP BY module, rule_id, issue_title, severity
HAVING bool_or(confidence = 'Medium') AND (bool_or(contains(lower(issue_title), 'src1')) OR bool_or(contains(lower(rule_id), 'src1')) OR bool_or(contains(lower(location), 'src1') OR contains(lower(evidence), 'src1')))"""


def _labels(table: dict[str, str], tags: str) -> str:
    case = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({tags}, lambda t: CASE t {case} END), lambda x: x IS NOT NULL))), '|')"


_TAG_LIST = "[CASE WHEN k % 2 = 0 THEN 'credential' END, CASE WHEN k % 3 = 0 THEN 'jwt' END, CASE WHEN k = 5 THEN 'database' END, 'nothing', CASE WHEN k > 2 THEN 'tls' END]"
TAGS = f"SELECT event_type, k, {_labels(CWE_BY_TAG, _TAG_LIST)} AS cwe, {_labels(MITRE_BY_TAG, _TAG_LIST)} AS mitre FROM (SELECT DISTINCT event_type, event_id % 7 AS k FROM events)"

# --- services, libraries, reputation ---
SERVICE_LISTING = r"""
SELECT c_mktsegment || '/' || c_nationkey AS source, replace(c_name, '#', '_') AS name, c_custkey % 3 <> 0 AS unquoted,
  CASE WHEN c_custkey % 3 <> 0 THEN 'C:\Program.exe|C:\Program Files\' || c_mktsegment || '.exe' ELSE '' END AS candidates FROM customer"""
PHANTOM = """
SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS path, 'lib' || l_partkey || '.dll' AS dll FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0 OR p_brand = 'Brand#13')
  AND NOT starts_with('lib' || l_partkey, 'lib1') AND NOT starts_with('lib' || l_partkey, 'lib2')"""
PUBLISHERS = """
WITH g AS (SELECT c_nationkey AS root, c_mktsegment AS publisher, count(*) AS n, min('o' || o_orderkey) AS first_path FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT root, count(*) AS n_publishers, (list(first_path ORDER BY n, publisher))[1] AS anchor, array_to_string(list_sort(list(publisher)), ',') AS publishers FROM g GROUP BY root HAVING count(*) > 1"""
RATIO = """
WITH p AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE count(*) FILTER (event_type = 'error') % 7 END AS malicious, count(*) FILTER (event_type = 'view') AS suspicious, count(*) AS engines FROM events GROUP BY user_id)
SELECT user_id, CAST(malicious AS BIGINT) AS malicious, suspicious, engines, CASE WHEN malicious >= 5 OR (malicious > 0 AND malicious / engines >= 0.15) THEN 'Critical' WHEN malicious >= 1 THEN 'High' WHEN suspicious >= 1 THEN 'Medium' ELSE 'none' END AS severity FROM p"""
VERDICTS = """
WITH v AS (SELECT text, max(doc_id % 9) AS m FROM documents WHERE doc_id % 5 = 0 GROUP BY text)
SELECT CASE WHEN m IS NULL THEN 'vt-unknown' WHEN m >= 1 THEN 'vt-flagged' ELSE 'vt-clean' END AS rule_id,
  CASE WHEN m >= 5 THEN 'Critical' WHEN m >= 1 THEN 'High' ELSE 'Info' END AS severity, count(*) AS n FROM documents LEFT JOIN v USING (text) GROUP BY ALL"""

# --- files ---
FILE_ENDS = (".exe", ".JSON", ".so", ".dylib", ".db", ".md", "", ".tar.gz", ".Dll", ".yaml")
_END = f"[{listed(FILE_ENDS)}][p_partkey % {len(FILE_ENDS)} + 1]"
FILE_CLASSES = f"""
SELECT CASE WHEN p_partkey % 11 = 0 THEN '/a/.git/' WHEN p_partkey % 13 = 0 THEN '/node_modules/x/' ELSE '/a/b/' END || 'f' || p_partkey || {_END} AS path,
  CASE WHEN lower({_END}) IN ('.json', '.yaml') THEN 'text' WHEN lower({_END}) IN ('.exe', '.dll') THEN 'pe' WHEN {_END} = '.so' THEN 'elf' WHEN {_END} = '.dylib' THEN 'macho' WHEN {_END} = '.db' THEN 'db' ELSE 'unknown' END AS kind,
  p_partkey % 11 = 0 OR p_partkey % 13 = 0 AS skipped FROM part"""
MITIGATIONS = """
WITH p AS (SELECT CAST((p_size * 1301 + p_partkey * 97) % 32768 AS INT) AS f, p_partkey % 2 = 0 AS wide FROM part),
r AS (
  SELECT CASE WHEN f & 64 = 0 THEN 'aslr-disabled' WHEN wide AND f & 32 = 0 THEN 'aslr-high-entropy-va-disabled' END AS rule_id FROM p
  UNION ALL SELECT CASE WHEN f & 256 = 0 THEN 'dep-disabled' END FROM p
  UNION ALL SELECT CASE WHEN f & 16384 = 0 THEN 'cfg-disabled' END FROM p
  UNION ALL SELECT CASE WHEN NOT wide AND f & 1024 = 0 THEN 'safeseh-disabled' END FROM p)
SELECT rule_id, CASE WHEN rule_id IN ('aslr-disabled', 'dep-disabled') THEN 'High' WHEN rule_id = 'cfg-disabled' THEN 'Info' ELSE 'Medium' END AS severity, count(*) AS n FROM r WHERE rule_id IS NOT NULL GROUP BY rule_id"""
REGISTRY = r"SELECT CAST(s_nationkey AS VARCHAR) AS source, 'S' || s_suppkey AS name, 'C:\Program Files\Acme ' || s_nationkey || '\svc' || s_suppkey || '.exe' AS image_path FROM supplier"
CIPHERS = ("AES/GCM/NoPadding", "AES/ECB/NoPadding", "RSA/ECB/OAEPPadding", "DES/CBC/PKCS5Padding", "Blowfish", "AES")
_CIPHER = f"[{listed(CIPHERS)}][doc_id % {len(CIPHERS)} + 1]"
CLASS_RULES = f"""
SELECT rule_id, severity, count(*) AS n FROM (
  SELECT CASE WHEN upper(string_split({_CIPHER}, '/')[1]) IN ('DES', 'BLOWFISH') THEN 'java-weak-cipher' WHEN {_CIPHER} = 'AES/ECB/NoPadding' THEN 'java-ecb-mode' END AS rule_id,
    CASE WHEN {_CIPHER} = 'Blowfish' THEN 'Low' ELSE 'Medium' END AS severity FROM documents
  UNION ALL SELECT CASE WHEN upper(lang) = 'EN' THEN 'java-weak-hash' END, 'Medium' FROM documents
  UNION ALL SELECT CASE WHEN doc_id % 4 = 0 THEN 'java-hardcoded-db-credentials' END, 'High' FROM documents) WHERE rule_id IS NOT NULL GROUP BY ALL"""
ASSEMBLY_TYPES = ("System.String", "System.Web.UI.LosFormatter", "System.Security.Cryptography.DES", "System.Security.Cryptography.RC2CryptoServiceProvider", "System.Runtime.Remoting.Channels.Ipc.IpcServerChannel", "System.Security.Cryptography.RIPEMD160Managed", "System.IO.File")
_TYPE = f"[{listed(ASSEMBLY_TYPES)}][l_partkey % 97 % {len(ASSEMBLY_TYPES)} + 1]"
ASSEMBLY_RULES = f"""
SELECT rule_id, severity, count(*) AS n FROM (SELECT DISTINCT l_suppkey, {_TYPE} AS t FROM lineitem) JOIN (VALUES
  ('System.Web.UI.LosFormatter', 'dotnet-insecure-deserialization', 'High'), ('System.Security.Cryptography.RC2CryptoServiceProvider', 'dotnet-weak-crypto', 'Medium'),
  ('System.Runtime.Remoting.Channels.Ipc.IpcServerChannel', 'dotnet-remoting-server', 'High'), ('System.Security.Cryptography.RIPEMD160Managed', 'dotnet-weak-hash', 'Low')) v(t, rule_id, severity) USING (t) GROUP BY ALL"""
SOURCE_RULES = """
SELECT rule_id, severity, count(*) AS n FROM (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'electron-node-integration' END AS rule_id, 'High' AS severity FROM events
  UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'electron-sandbox-off' END, 'Medium' FROM events
  UNION ALL SELECT CASE WHEN event_id % 5 = 0 AND event_id % 11 <> 0 THEN 'electron-navigation-unrestricted' END, 'Medium' FROM events) WHERE rule_id IS NOT NULL GROUP BY ALL"""
RISKY_KEYS = ("debug", "ssl_verify", "password", "api_key", "password_min_length", "service_secret", "name")
RISKY_VALUES = ("true", "false", "${X}", "changeme", "P%ssw0rd!Real", "12", "Qp8$wLz2!mRt")
RISKY = f"""
WITH s AS (
  SELECT event_type || '.' || [{listed(RISKY_KEYS)}][event_id % {len(RISKY_KEYS)} + 1] AS key, [{listed(RISKY_VALUES)}][user_id % {len(RISKY_VALUES)} + 1] AS value FROM events),
k AS (SELECT key, value, string_split(lower(key), '.')[-1] AS last, lower(trim(value)) AS v FROM s)
SELECT key, value,
  (regexp_matches(last, '^(debug|trace|verbose|dev_mode)$') AND v IN ('true', '1', 'yes', 'on'))
  OR (regexp_matches(last, 'ssl|tls|cert|verify') AND regexp_matches(last, 'verif|check|valid') AND v IN ('false', '0', 'no', 'off', 'none'))
  OR (regexp_matches(last, 'password|passwd|pwd|secret|token|api_?key') AND NOT regexp_matches(last, 'length|lifetime|expir|timeout|policy|enabled|required|min|max|count|url|file|path|hint|type|name')
      AND NOT regexp_matches(v, '^([$][{{].*[}}]|[$][a-z_]+|%.*%|<.*>|changeme|change_me|example|placeholder|none|null|true|false|xxx+|[*]+|[0-9]{{1,5}})$') AND length(v) >= 6) AS risky,
  count(*) AS n FROM k GROUP BY ALL"""
ROLL_UP = with_findings("SELECT module, rule_id, severity, count(DISTINCT file_path) AS n_files, array_to_string(list_sort(list(DISTINCT file_path))[1:20], ',') AS files FROM f WHERE rule_id = 'hardcoded-ip' GROUP BY ALL")
REPORT_FILTER = with_issues("SELECT rule_id, severity, affected_count, 'Secrets & Configuration' AS label FROM i WHERE module = 'secrets' AND contains(issue_title, 'address')")
LIBRARIES = """
SELECT module, array_to_string(list_sort(list(name))[1:30], ',') AS libraries FROM (
  SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'linux' ELSE 'macos' END AS module, 'lib' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS name FROM lineitem) GROUP BY module"""
CONFIG_COUNTS = f"SELECT lower({_END}) AS extension, count(*) AS n FROM part WHERE lower({_END}) IN ('.json', '.yaml') GROUP BY ALL"
APP_ROOTS = "SELECT '/apps/' || c_custkey AS root, 'm' || c_custkey || '.js' AS main FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0"
UNPACK_STEPS = """
SELECT page_id, '7z x ''a' || page_id || '.zip'' -o''unpacked1''' || CASE WHEN page_id % 2 = 0 THEN ' && npx --yes @electron/asar extract ''unpacked1/b.asar'' ''unpacked2''' ELSE '' END AS steps FROM pages"""
