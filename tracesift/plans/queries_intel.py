"""Queries over reports, indicators, techniques, attack graphs and control coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import text as tx
from tracesift.operators import graph, intel, posture
from tracesift.sources import inventory as inv
from tracesift.sources import reports as rp
from tracesift.sources import techniques as tq

from .bindings import Inputs
from .oracle_sql import case_of, oracle, sql_text, strip
from .queries_logs import joined

QUERIES: dict[str, tuple] = {}

# --- indicators ------------------------------------------------------------------------------------
_OPEN, _CLOSE = "chr(64976)", "chr(64977)"
_REFANG = r"regexp_replace(replace(regexp_replace(replace({0}, '[.]', '.'), '(?i)hxxp', 'http', 'g'), '[:]', ':'), '(?i)\[at\]', '@', 'g')"
_FOUND = " UNION ALL ".join(
    f"""SELECT report_path, text, '{t}' AS ioc_type, i AS no, substr(p, 1, strpos(p, {_CLOSE}) - 1) AS raw_value, p, n FROM (
SELECT report_path, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i, unnest(list_transform(ps, lambda q: length(q))) AS n FROM (
  SELECT report_path, text, string_split(regexp_replace(text, {sql_text('(' + rx + ')' if not rx.startswith('(?i)') else '(?i)(' + rx[4:] + ')')},
    {_OPEN} || '\\1' || {_CLOSE}, 'g'), {_OPEN}) AS ps FROM reports) a) b""".replace("'\\\\1'", "'\\1'")
    for t, rx in fv.REPORT_INDICATORS.items()
)
_LOCATED = f"""SELECT *, 1 + sum(CASE WHEN no = 1 THEN n ELSE n - 1 END) OVER (PARTITION BY report_path, ioc_type ORDER BY no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at0 FROM ({_FOUND}) f"""
_REPORT_IOCS = f"""SELECT report_path, ioc_type, value, raw_value, raw_value <> value AS defanged, context, confidence, CAST(at0 AS INT) AS start FROM (
SELECT *, {_REFANG.format('raw_value')} AS value, 'low' AS confidence,
  substr({strip("replace(substr(text, greatest(CAST(at0 AS BIGINT) - 150, 1), CAST(at0 AS BIGINT) + length(raw_value) + 150 - greatest(CAST(at0 AS BIGINT) - 150, 1)), chr(10), ' ')")}, 1, 300) AS context,
  row_number() OVER (PARTITION BY report_path, ioc_type, lower({_REFANG.format('raw_value')}) ORDER BY at0) AS rn
FROM ({_LOCATED}) l WHERE no > 1) q WHERE rn = 1"""
QUERIES["extract_indicators"] = (lambda x: intel.extract_indicators(x.reports), oracle(_REPORT_IOCS, "reports"))
QUERIES["indicator_summary"] = (
    lambda x: intel.indicator_summary(
        intel.extract_indicators(x.reports, context=False).withColumn("priority", F.when(F.col("defanged"), "high").otherwise("low"))
    ),
    oracle(
        f"""SELECT report_path, ioc_type, count(*) AS total, count(*) FILTER (WHERE defanged) AS high_priority, count(*) AS confidence_low,
  CAST(0 AS BIGINT) AS confidence_medium, CAST(0 AS BIGINT) AS confidence_high FROM ({_REPORT_IOCS}) i GROUP BY report_path, ioc_type""",
        "reports",
    ),
)


def _all(kind: str, group: int, change: str = "v", keep: str = "true") -> str:
    rx = fv.CORRELATOR_INDICATORS[kind]
    return f"""SELECT DISTINCT report_path, '{kind}' AS ioc_type, {change} AS value FROM (
SELECT report_path, unnest(regexp_extract_all(clean, {sql_text(rx)}, {group})) AS v FROM clean) q WHERE {keep}"""


_IN = lambda values: "(" + ", ".join(sql_text(v) for v in values) + ")"
_CORR_IOCS = f"""WITH clean AS (SELECT report_path, replace(replace(replace(text, '[.]', '.'), '[:]', ':'), 'hxxp', 'http') AS clean FROM reports)
{_all('sha256', 0, 'lower(v)')} UNION ALL {_all('sha1', 0, 'lower(v)')} UNION ALL {_all('md5', 0, 'lower(v)')}
UNION ALL {_all('ip', 0, 'v', f'v NOT IN {_IN(fv.IGNORED_IPS)}')}
UNION ALL {_all('domain', 0, 'lower(v)', f'lower(v) NOT IN {_IN(fv.IGNORED_DOMAINS)}')}
UNION ALL {_all('mac', 0, 'upper(v)')} UNION ALL {_all('port', 1, 'v', 'CAST(v AS INT) BETWEEN 1 AND 65535')}"""


def _corr(x: Inputs) -> DataFrame:
    return intel.extract_correlator_indicators(x.reports)


QUERIES["extract_correlator_indicators"] = (_corr, oracle(_CORR_IOCS, "reports"))
QUERIES["merge_indicators"] = (
    lambda x: intel.merge_indicators(_corr(x), intel.extract_indicators(x.reports, ["domain", "email"], context=False)),
    oracle(
        f"""SELECT report_path, ioc_type, value FROM ({_CORR_IOCS}) a UNION SELECT report_path, ioc_type, value FROM ({_REPORT_IOCS}) b
WHERE ioc_type IN ('domain', 'email')""",
        "reports",
    ),
)
_FLOW = "concat(src_ip, ' -> ', dst_ip, ':', dst_port, '/', proto)"
_NONE = "CAST(NULL AS BIGINT)"
_EVIDENCE = f"""
SELECT 'ip' AS ioc_type, v AS ioc_value, 'conversation' AS source, {_FLOW} AS detail, packets, bytes_out AS bytes, 1 AS hits FROM convs JOIN ips ON v = src_ip OR v = dst_ip
UNION ALL SELECT 'ip', v, 'dns_answer', concat(query, ' -> ', v), {_NONE}, {_NONE}, count(*) FROM dns_responses JOIN ips ON answer = v GROUP BY query, v
UNION ALL SELECT 'domain', v, 'dns_query', concat(src_ip, ' queried ', query), {_NONE}, {_NONE}, count(*) FROM dns_queries JOIN names ON contains(lower(query), v) GROUP BY src_ip, query, v
UNION ALL SELECT 'domain', v, 'tls_sni', concat(src_ip, ' -> ', dst_ip, ':', dst_port, ' SNI=', lower(sni)), {_NONE}, {_NONE}, count(*) FROM tls_handshakes JOIN names ON contains(lower(sni), v)
  GROUP BY src_ip, dst_ip, dst_port, sni, v
UNION ALL SELECT 'domain', v, 'http_host', concat(method, ' ', lower(host), path), {_NONE}, {_NONE}, count(*) FROM http_requests JOIN names ON contains(lower(host), v) GROUP BY method, host, path, v
UNION ALL SELECT 'port', v, 'conversation', {_FLOW}, packets, {_NONE}, 1 FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY src_ip, dst_ip, proto) AS n FROM convs JOIN prts ON dst_port = CAST(v AS INT)) p WHERE n <= 20
UNION ALL SELECT 'port', v, 'truncated', concat('... ', count(*) - 20, ' more matches'), {_NONE}, {_NONE}, count(*) - 20 FROM convs JOIN prts ON dst_port = CAST(v AS INT) GROUP BY v HAVING count(*) > 20"""
_EVIDENCE_HEAD = f"""WITH iocs AS ({_CORR_IOCS}), ips AS (SELECT DISTINCT value AS v FROM iocs WHERE ioc_type = 'ip'),
names AS (SELECT DISTINCT value AS v FROM iocs WHERE ioc_type = 'domain'), prts AS (SELECT DISTINCT value AS v FROM iocs WHERE ioc_type = 'port')"""
_EVIDENCE_VIEWS = ("reports", "convs", "dns_queries", "dns_responses", "tls_handshakes", "http_requests")


def _evidence(x: Inputs) -> DataFrame:
    return intel.correlate(_corr(x), x.convs, x.queries, x.responses, x.handshakes, x.requests)


QUERIES["correlate_indicators"] = (
    lambda x: _evidence(x).fillna(-1, ["packets", "bytes"]),
    oracle(
        f"{_EVIDENCE_HEAD} SELECT ioc_type, ioc_value, source, detail, coalesce(packets, -1) AS packets, coalesce(bytes, -1) AS bytes, hits FROM ({_EVIDENCE}) e",
        *_EVIDENCE_VIEWS,
    ),
)
QUERIES["indicator_match_counts"] = (
    lambda x: intel.match_counts(_evidence(x)),
    oracle(
        f"{_EVIDENCE_HEAD} SELECT ioc_type, ioc_value, CAST(sum(hits) AS BIGINT) AS match_count FROM ({_EVIDENCE}) e GROUP BY ioc_type, ioc_value",
        *_EVIDENCE_VIEWS,
    ),
)
QUERIES["unmatched_indicators"] = (
    lambda x: intel.unmatched(_corr(x), _evidence(x)),
    oracle(
        f"""{_EVIDENCE_HEAD}, found AS (SELECT DISTINCT ioc_type, ioc_value FROM ({_EVIDENCE}) e)
SELECT DISTINCT i.ioc_type, i.value AS ioc_value FROM iocs i WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.ioc_type = i.ioc_type AND f.ioc_value = i.value)""",
        *_EVIDENCE_VIEWS,
    ),
)
QUERIES["parent_domain_matches"] = (
    lambda x: intel.labels_containing(x.queries, "query", intel.distinct_values(_corr(x), "domain")),
    oracle(
        f"""{_EVIDENCE_HEAD} SELECT DISTINCT lower(query) AS name, v AS ioc_value FROM dns_queries JOIN names ON lower(query) = v OR ends_with(lower(query), '.' || v)""",
        "reports", "dns_queries",
    ),
)
_MARK = fv.LOG_PATTERNS["TIMESTAMP"]


def _marks(x: Inputs) -> DataFrame:
    times = F.explode(F.regexp_extract_all("text", F.lit(_MARK), F.lit(1)))
    found = x.reports.select("report_path", times.alias("t"))
    return found.select("report_path", (F.unix_micros(F.to_timestamp(F.replace("t", F.lit("T"), F.lit(" ")))) / 1e6).alias("ts"))


QUERIES["events_near_report_times"] = (
    lambda x: intel.near_report_times(x.connections, _marks(x)),
    oracle(
        f"""WITH marks AS (SELECT DISTINCT report_path, epoch_us(CAST(replace(t, 'T', ' ') AS TIMESTAMP)) / 1e6 AS m FROM (
  SELECT report_path, unnest(regexp_extract_all(text, {sql_text(_MARK)}, 1)) AS t FROM reports) q)
SELECT report_path, src_ip, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM (
  SELECT report_path, src_ip, ts, c.n FROM (SELECT *, row_number() OVER () AS n FROM connections) c JOIN marks ON abs(ts - m) <= 300 GROUP BY ALL) e
GROUP BY report_path, src_ip""",
        "reports", "connections",
    ),
)

# --- report text ----------------------------------------------------------------------------------------
QUERIES["search_reports"] = (
    lambda x: intel.search_reports(x.reports, "Exploits CVE"),
    oracle(
        f"""SELECT report_path, name, subdirectory, CAST(n AS INT) AS hit_no, concat('Line ', i, ': ', substr({strip('l')}, 1, 200)) AS match FROM (
SELECT *, row_number() OVER (PARTITION BY report_path ORDER BY i) AS n FROM (SELECT report_path, name, subdirectory,
  unnest(string_split(lower(text), chr(10))) AS l, generate_subscripts(string_split(lower(text), chr(10)), 1) AS i FROM reports) s
WHERE contains(l, 'exploits cve')) r""",
        "reports",
    ),
)
_TYPES = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(report_path), '{w}')" for w in words) + f" THEN {sql_text(label)}" for words, label in fv.REPORT_TYPES
) + f" ELSE '{fv.DEFAULT_REPORT_TYPE}' END"
QUERIES["report_profile"] = (
    lambda x: intel.report_profile(x.reports).withColumn("findings", F.array_join("findings", "|")).withColumn(
        "techniques", F.array_join("techniques", ",")
    ),
    oracle(
        rf"""SELECT report_path, {_TYPES} AS report_type, CAST(len(string_split(text, chr(10))) AS INT) AS lines,
  CAST(len(string_split(text, chr(10) || chr(10))) AS INT) AS pages, CAST(greatest(1, length(text) // 4) AS INT) AS tokens,
  coalesce((SELECT string_agg(f, '|' ORDER BY i) FROM (SELECT f, i FROM (SELECT i, CASE WHEN regexp_matches(s, '^[-*] ') THEN {strip('substr(s, 3)')}
      WHEN regexp_matches(s, '^\d+[.)]\s(.+)') THEN {strip("regexp_extract(s, '^[0-9]+[.)]\\s(.+)', 1)".replace(chr(92) * 2, chr(92)))} END AS f, regexp_matches(s, '^[-*] ') AS bullet
    FROM (SELECT {strip('unnest(string_split(text, chr(10)))')} AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i) a) b
    WHERE f IS NOT NULL AND (NOT bullet OR length(f) > 10) ORDER BY i) c), '') AS findings,
  coalesce((SELECT string_agg(t, ',' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest(regexp_extract_all(text, '{fv.TECHNIQUE_ID}')) AS t,
    generate_subscripts(regexp_extract_all(text, '{fv.TECHNIQUE_ID}'), 1) AS i) d GROUP BY t ORDER BY i) e), '') AS techniques
FROM reports""",
        "reports",
    ),
)
QUERIES["report_chunks"] = (
    lambda x: intel.report_chunks(x.reports, 6000),
    oracle(
        """SELECT * FROM (WITH RECURSIVE p AS (SELECT report_path, text, string_split(text, chr(10) || chr(10)) AS ps FROM reports),
f AS (SELECT report_path, 1 AS i, 0 AS chunk, length(ps[1]) + 2 AS used, ps FROM p WHERE length(text) > 6000
  UNION ALL SELECT report_path, i + 1, CASE WHEN used + length(ps[i + 1]) + 2 > 6000 THEN chunk + 1 ELSE chunk END,
    CASE WHEN used + length(ps[i + 1]) + 2 > 6000 THEN length(ps[i + 1]) + 2 ELSE used + length(ps[i + 1]) + 2 END, ps FROM f WHERE i < len(ps)),
c AS (SELECT report_path, CAST(chunk AS INT) AS chunk_no, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS content FROM f GROUP BY 1, 2
  UNION ALL SELECT report_path, 0, text FROM p WHERE length(text) <= 6000)
SELECT *, CAST(greatest(1, length(content) // 4) AS INT) AS tokens FROM c) z""",
        "reports",
    ),
)
QUERIES["artifact_types"] = (
    lambda x: x.view("inventory").select("filename").distinct().select("filename", tx.artifact_type("filename").alias("artifact_type")),
    oracle(
        "SELECT DISTINCT filename, CASE WHEN ends_with(filename, '.log') OR ends_with(filename, '.log.1') THEN 'log_stream' "
        "WHEN ends_with(filename, '.PCAP') THEN 'pcap' WHEN ends_with(filename, '.json.bak') THEN 'json_events' ELSE 'text' END AS artifact_type FROM inventory",
        "inventory",
    ),
)
QUERIES["text_measures"] = (
    lambda x: x.table("documents").select(
        "doc_id", F.round(tx.shannon_entropy("text"), 3).alias("entropy"), tx.token_estimate("text").alias("tokens"),
        tx.blended_token_estimate("lang", "text").alias("blended"), tx.line_count("text").alias("lines"),
    ),
    oracle(
        """WITH e AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS bits FROM (SELECT doc_id, ch, count(*) AS c, max(n) AS n FROM (
    SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS ch FROM documents) a GROUP BY doc_id, ch) b GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(bits, 0), 3) AS entropy,
  CAST(greatest(1, length(text) // 4) AS INT) AS tokens, CAST(floor((length(lang) // 4 + length(text) // 3) * 1.4::DOUBLE) AS INT) AS blended,
  CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS INT) AS lines FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id""",
    ),
)
_HTML = "regexp_replace(html, '(?s)<!--.*?-->', chr(64976), 'g')"
for _element in rp.HIDDEN_ELEMENTS:
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_element}\\b[^>]*>.*?</{_element}\\s*>', chr(64976), 'g')"
_HTML = f"regexp_replace({_HTML}, '(?s)<[!/?a-zA-Z][^>]*>', chr(64976), 'g')"
_ENTITIES = "t"
for _name, _char in (("copy", 169), ("middot", 183), ("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("amp", 38)):
    _ENTITIES = f"replace({_ENTITIES}, '&{_name};', chr({_char}))"
QUERIES["html_visible_text"] = (
    lambda x: rp.html_reports(x.table("pages"), "page_id", "html", "page-").select("report_path", "text"),
    oracle(
        f"""WITH a AS (SELECT page_id, {_HTML} AS t FROM pages), b AS (SELECT page_id, {_ENTITIES} AS t FROM a),
c AS (SELECT page_id, {strip('p')} AS p, i FROM (SELECT page_id, unnest(string_split(t, chr(64976))) AS p, generate_subscripts(string_split(t, chr(64976)), 1) AS i FROM b) q)
SELECT concat('page-', page_id) AS report_path, string_agg(p, chr(10) ORDER BY i) AS text FROM c WHERE p <> '' GROUP BY page_id""",
    ),
)

# --- files with precedence ------------------------------------------------------------------------------------
_INV = "root, priority, workspace, filename, object_path"
QUERIES["resolve_files"] = (
    lambda x: inv.resolve_files(x.view("inventory")),
    oracle(
        f"""SELECT {_INV} FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY priority, CASE WHEN workspace = '' THEN 1 ELSE 0 END, object_path) AS n
FROM inventory) q WHERE n = 1""",
        "inventory",
    ),
)
QUERIES["workspace_files"] = (
    lambda x: inv.workspace_files(x.view("inventory"), "inc-2"),
    oracle(
        f"""SELECT {_INV} FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY priority, object_path) AS n
FROM inventory WHERE workspace = 'inc-2') q WHERE n = 1""",
        "inventory",
    ),
)

# --- chunk results ----------------------------------------------------------------------------------------------
_FIRST_IOC = """SELECT report_path, ioc_type, value, confidence, priority, is_false_positive, related, pos FROM (SELECT *,
  row_number() OVER (PARTITION BY report_path, ioc_type, lower(value) ORDER BY chunk_no, pos) AS n FROM chunk_indicators c
  WHERE EXISTS (SELECT 1 FROM chunk_mappings m WHERE m.report_path = c.report_path AND m.chunk_no = c.chunk_no)) q WHERE n = 1 AND NOT is_false_positive"""
QUERIES["merged_indicators"] = (
    lambda x: intel.at_least(intel.merged_indicators(x.chunks), "medium").select("report_path", "ioc_type", "value", "confidence", "priority"),
    oracle(
        f"SELECT report_path, ioc_type, value, confidence, priority FROM ({_FIRST_IOC}) f WHERE confidence IN ('medium', 'high')",
        "chunk_indicators", "chunk_mappings",
    ),
)
_FIRST_MAP = """SELECT report_path, technique_id, tactic, confidence, chunk_no, pos FROM (SELECT *,
  row_number() OVER (PARTITION BY report_path, technique_id, tactic ORDER BY chunk_no, pos) AS n FROM chunk_mappings WHERE technique_id <> '') q WHERE n = 1"""
QUERIES["merged_techniques"] = (
    lambda x: intel.merged_techniques(x.chunks).select("report_path", "technique_id", "tactic", "confidence"),
    oracle(f"SELECT report_path, technique_id, tactic, confidence FROM ({_FIRST_MAP}) f", "chunk_mappings"),
)
_IN_CHUNKS = """chunk_mappings m WHERE EXISTS (SELECT 1 FROM chunk_indicators c WHERE c.report_path = m.report_path AND c.chunk_no = m.chunk_no)"""
QUERIES["merged_paths"] = (
    lambda x: intel.merged_paths(x.chunks).select("report_path", "path_no", "path_id", F.get("steps", 0)["technique_id"].alias("technique_id")),
    oracle(
        f"""SELECT report_path, CAST(row_number() OVER (PARTITION BY report_path ORDER BY chunk_no, pos) AS INT) AS path_no, path_id, technique_id FROM (
SELECT *, row_number() OVER (PARTITION BY report_path, path_id ORDER BY chunk_no, pos) AS n FROM (SELECT *, concat('p', pos % 2) AS path_id FROM {_IN_CHUNKS}) q) r WHERE n = 1""",
        "chunk_indicators", "chunk_mappings",
    ),
)
QUERIES["merged_points"] = (
    lambda x: intel.merged_points(x.chunks),
    oracle(
        f"""SELECT DISTINCT report_path, CASE WHEN pos % 3 = 0 THEN 'convergence' ELSE 'branch' END AS kind, technique_id FROM {_IN_CHUNKS} AND pos % 3 < 2""",
        "chunk_indicators", "chunk_mappings",
    ),
)
QUERIES["merged_metadata"] = (
    lambda x: intel.merged_metadata(x.chunks),
    oracle(
        f"""SELECT report_path, unnest(['title', 'part']) AS key, unnest([report_path, CAST(part AS VARCHAR)]) AS value FROM (
SELECT report_path, min(chunk_no) AS part FROM {_IN_CHUNKS} AND chunk_no % 2 = 1 GROUP BY report_path) q""",
        "chunk_indicators", "chunk_mappings",
    ),
)
QUERIES["techniques_from_indicators"] = (
    lambda x: intel.techniques_from_indicators(
        intel.merged_indicators(x.chunks).withColumn("ioc_no", F.struct("chunk_no", "pos")), intel.merged_techniques(x.chunks)
    ).select("report_path", "technique_id", "report_context"),
    oracle(
        f"""SELECT report_path, related AS technique_id, concat('Associated with IOC ', value) AS report_context FROM (
SELECT f.*, row_number() OVER (PARTITION BY f.report_path, f.related ORDER BY c.chunk_no, f.pos) AS k FROM ({_FIRST_IOC}) f JOIN chunk_indicators c USING (report_path, pos)
WHERE f.related <> '') q WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM chunk_mappings m WHERE m.report_path = q.report_path AND m.technique_id = q.related)""",
        "chunk_indicators", "chunk_mappings",
    ),
)

# --- techniques ----------------------------------------------------------------------------------------------------


def _stix_json(x: Inputs) -> DataFrame:
    """Bundle objects as JSON text, parsed again with the source's schema."""
    v = x.view("stix_objects")
    phase = lambda c: F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.col(c).alias("phase_name"))
    ref = F.struct(
        F.lit("mitre-attack").alias("source_name"), F.col("ext_id").alias("external_id"),
        F.concat(F.lit("https://t/"), "ext_id").alias("url"),
    )
    text = F.to_json(
        F.struct(
            "type", "name", "revoked", F.col("deprecated").alias("x_mitre_deprecated"), F.array(ref).alias("external_references"),
            F.filter(F.array(phase("phase1"), phase("phase2")), lambda p: p["phase_name"] != "").alias("kill_chain_phases"),
        )
    )
    return v.select("object_no", "matrix", "matrix_no", F.from_json(text, tq.OBJECT_SCHEMA).alias("o")).select(
        "object_no", "matrix", "matrix_no", "o.*"
    )


def _title(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, '-'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"


QUERIES["stix_techniques"] = (
    lambda x: joined(tq.techniques(_stix_json(x)), "tactics"),
    oracle(
        f"""SELECT technique_id, name, tactics, matrix, url FROM (SELECT ext_id AS technique_id, name, matrix, concat('https://t/', ext_id) AS url,
  concat({_title('phase1')}, CASE WHEN phase2 <> '' THEN ',' ELSE '' END, {_title('phase2')}) AS tactics,
  row_number() OVER (PARTITION BY ext_id ORDER BY matrix_no DESC, object_no DESC) AS n
FROM stix_objects WHERE type = 'attack-pattern' AND NOT revoked AND NOT deprecated AND ext_id <> '') q WHERE n = 1""",
        "stix_objects",
    ),
)
_ORDER = case_of("lower(t)", {t.lower(): n for n, t in enumerate(fv.TACTIC_ORDER, 1)})
_NAMES = case_of("best", dict(enumerate(fv.TACTIC_ORDER, 1)))
_ENTRY = _IN(fv.ENTRY_ONLY_TACTICS)
_ENTRY_LOW = _IN([t.lower() for t in fv.ENTRY_ONLY_TACTICS])
_REPAIRED = f"""SELECT s.*, step_no >= 1 AND s.tactic IN {_ENTRY} AND best IS NOT NULL AS reassigned,
  CASE WHEN step_no >= 1 AND s.tactic IN {_ENTRY} AND best IS NOT NULL THEN {_NAMES} ELSE s.tactic END AS fixed FROM path_steps s
LEFT JOIN (SELECT technique_id AS k, max({_ORDER}) FILTER (WHERE lower(t) NOT IN {_ENTRY_LOW}) AS best FROM (
  SELECT technique_id, unnest(string_split(tactics, ',')) AS t FROM technique_dim) u GROUP BY technique_id) b ON s.technique_id = b.k"""
QUERIES["repair_tactics"] = (
    lambda x: intel.repair_tactics(intel.path_steps(x.paths), x.techniques).select(
        "report_path", "path_id", "step_no", "technique_id", "tactic", "reassigned"
    ),
    oracle(
        f"SELECT report_path, path_id, step_no, technique_id, fixed AS tactic, reassigned FROM ({_REPAIRED}) r", "path_steps", "technique_dim"
    ),
)
_RECONCILED = f"""WITH st AS MATERIALIZED ({_REPAIRED}),
m AS MATERIALIZED (SELECT * FROM technique_mappings),
g AS MATERIALIZED (SELECT report_path, technique_id, fixed AS tactic, min(path_no * 1000 + step_no) AS first_at,
  string_agg(DISTINCT path_id, ',' ORDER BY path_id) AS paths FROM st GROUP BY 1, 2, 3),
fresh AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY report_path, technique_id ORDER BY first_at) AS no
  FROM g ANTI JOIN m USING (report_path, technique_id, tactic)),
promo AS MATERIALIZED (SELECT * FROM fresh SEMI JOIN (SELECT report_path, technique_id FROM m WHERE tactic = '') e USING (report_path, technique_id)
  WHERE no = 1 AND tactic <> ''),
kept AS (SELECT m.report_path, m.technique_id, m.technique_name, coalesce(p.tactic, m.tactic) AS tactic, m.confidence, m.report_context,
  array_to_string(list_sort(list_distinct(string_split(concat_ws(',', g.paths, p.paths), ','))), ',') AS paths FROM m
  LEFT JOIN g ON g.report_path = m.report_path AND g.technique_id = m.technique_id AND g.tactic = m.tactic
  LEFT JOIN (SELECT *, '' AS was FROM promo) p ON p.report_path = m.report_path AND p.technique_id = m.technique_id AND m.tactic = p.was),
added AS (SELECT report_path, technique_id, '' AS technique_name, tactic, 'inferred' AS confidence,
  concat('Backfilled from attack_graph path(s) ''', replace(paths, ',', ', '), '''') AS report_context, paths
  FROM fresh ANTI JOIN promo USING (report_path, technique_id, tactic)),
orphan AS (SELECT DISTINCT report_path, technique_id, '' AS technique_name, '' AS tactic, 'inferred' AS confidence,
  'Backfilled - referenced as leads_to target in attack_graph' AS report_context, '' AS paths
  FROM (SELECT report_path, unnest(string_split(leads_to, ',')) AS technique_id FROM st) u
  ANTI JOIN st USING (report_path, technique_id) ANTI JOIN m USING (report_path, technique_id) WHERE technique_id <> ''),
filled AS (SELECT a.report_path, a.technique_id, coalesce(nullif(a.technique_name, ''), d.name, '') AS technique_name,
  coalesce(nullif(a.tactic, ''), split_part(d.tactics, ',', 1), '') AS tactic, a.confidence, a.report_context, a.paths, d.tactics IS NOT NULL AS known,
  string_split(d.tactics, ',') AS allowed FROM (SELECT * FROM kept UNION ALL SELECT * FROM added UNION ALL SELECT * FROM orphan) a LEFT JOIN technique_dim d USING (technique_id)),
named AS (SELECT *, list_filter(allowed, lambda z: lower(z) = lower(tactic))[1] AS same FROM filled)
SELECT report_path, technique_id, CASE WHEN known THEN technique_name WHEN technique_name = '' THEN '(non-ATT&CK ID)' ELSE technique_name || ' (non-ATT&CK ID)' END AS technique_name,
  CASE WHEN known AND tactic <> '' AND NOT list_contains(allowed, tactic) THEN coalesce(same, tactic) ELSE tactic END AS tactic, confidence, report_context, paths AS context_paths,
  known AS mitre_validated, coalesce(known AND tactic <> '' AND NOT list_contains(allowed, tactic) AND same IS NULL, false) AS tactic_mismatch FROM named"""
QUERIES["reconcile_mappings"] = (
    lambda x: joined(
        intel.reconcile_mappings(x.mappings, x.paths, x.techniques).withColumn("context_paths", F.array_sort("context_paths")), "context_paths"
    ),
    oracle(_RECONCILED, "path_steps", "technique_mappings", "technique_dim"),
)
_SLUG = "coalesce(nullif(replace(lower(tactic), ' ', '-'), ''), 'unknown')"
_SLUGS = [t.lower().replace(" ", "-") for t in fv.TACTIC_ORDER]
_RANK = "CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
QUERIES["stages_from_mappings"] = (
    lambda x: joined(intel.stages_from_mappings(x.mappings), "additional_techniques"),
    oracle(
        f"""WITH r AS (SELECT *, {_SLUG} AS slug, row_number() OVER (PARTITION BY report_path, {_SLUG} ORDER BY {_RANK} DESC, map_no) AS n FROM technique_mappings),
g AS (SELECT report_path, slug, max(technique_id) FILTER (WHERE n = 1) AS mitre_technique_id, max(technique_name) FILTER (WHERE n = 1) AS technique_claimed,
  coalesce(string_agg(technique_id, ',' ORDER BY n) FILTER (WHERE n > 1), '') AS additional_techniques, min(map_no) AS seen FROM r GROUP BY report_path, slug)
SELECT report_path, coalesce({case_of('slug', dict(zip(_SLUGS, fv.TACTIC_ORDER)))}, 'Unknown') AS name, mitre_technique_id, technique_claimed,
  CASE WHEN slug = 'unknown' THEN '' ELSE additional_techniques END AS additional_techniques,
  CAST(row_number() OVER (PARTITION BY report_path ORDER BY coalesce({case_of('slug', {s: n for n, s in enumerate(_SLUGS)})}, 100), seen) AS INT) AS stage_no FROM g""",
        "technique_mappings",
    ),
)

# --- attack graph ---------------------------------------------------------------------------------------------------
_KEY = lambda tid, tac: f"concat({tid}, '|', CASE WHEN {tac} = '' THEN 'unknown' ELSE replace(lower({tac}), ' ', '-') END)"
_EDGES = f"""SELECT DISTINCT h.report_path, {_KEY('h.technique_id', 'h.tactic')} AS source, {_KEY('h.target', "coalesce(nullif(p.tac, ''), nullif(a.tac, ''), nullif(m.tac, ''), '')")} AS target
FROM (SELECT report_path, path_id, technique_id, tactic, unnest(string_split(leads_to, ',')) AS target FROM path_steps) h
LEFT JOIN (SELECT report_path, path_id, technique_id, max_by(tactic, step_no) AS tac FROM path_steps GROUP BY 1, 2, 3) p
  ON p.report_path = h.report_path AND p.path_id = h.path_id AND p.technique_id = h.target
LEFT JOIN (SELECT report_path, technique_id, min_by(tac, path_no) AS tac FROM (SELECT report_path, path_no, technique_id, max_by(tactic, step_no) AS tac FROM path_steps GROUP BY 1, 2, 3) q
  GROUP BY 1, 2) a ON a.report_path = h.report_path AND a.technique_id = h.target
LEFT JOIN (SELECT report_path, technique_id, min_by(tactic, map_no) AS tac FROM technique_mappings GROUP BY 1, 2) m ON m.report_path = h.report_path AND m.technique_id = h.target
WHERE h.target <> ''"""
_GRAPH_VIEWS = ("path_steps", "technique_mappings")
QUERIES["graph_edges"] = (lambda x: graph.edges(x.paths, x.mappings), oracle(_EDGES, *_GRAPH_VIEWS))
_STEP_NODE = _KEY("technique_id", "tactic")
QUERIES["graph_nodes"] = (
    lambda x: graph.nodes(x.paths, x.mappings),
    oracle(
        f"""WITH e AS ({_EDGES}), s AS (SELECT report_path, {_STEP_NODE} AS node, min_by(technique_id, path_no * 1000 + step_no) AS technique_id,
  min_by(tactic, path_no * 1000 + step_no) AS tactic, count(DISTINCT path_id) AS paths FROM path_steps GROUP BY 1, 2),
n AS (SELECT * FROM s UNION ALL SELECT DISTINCT report_path, target, split_part(target, '|', 1), '', CAST(0 AS BIGINT) FROM e
  WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.report_path = e.report_path AND s.node = e.target)),
a AS (SELECT report_path, technique_id, min_by(technique_name, map_no) AS any_name, min_by(tactic, map_no) AS any_tactic FROM technique_mappings GROUP BY 1, 2)
SELECT n.report_path, n.node, n.technique_id, coalesce(nullif(coalesce(m.technique_name, any_name), ''), '') AS technique_name,
  coalesce(nullif(n.tactic, ''), any_tactic, '') AS tactic, paths,
  NOT EXISTS (SELECT 1 FROM e WHERE e.report_path = n.report_path AND e.target = n.node) AS is_entry,
  NOT EXISTS (SELECT 1 FROM e WHERE e.report_path = n.report_path AND e.source = n.node) AS is_exit FROM n
LEFT JOIN technique_mappings m ON m.report_path = n.report_path AND m.technique_id = n.technique_id AND m.tactic = n.tactic AND n.tactic <> ''
LEFT JOIN a ON a.report_path = n.report_path AND a.technique_id = n.technique_id""",
        *_GRAPH_VIEWS,
    ),
)
QUERIES["graph_degrees"] = (
    lambda x: graph.degrees(graph.edges(x.paths, x.mappings)),
    oracle(
        f"""SELECT report_path, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, sum(i) > 1 AS converges, sum(o) > 1 AS branches FROM (
SELECT report_path, target AS node, 1 AS i, 0 AS o FROM ({_EDGES}) a UNION ALL SELECT report_path, source, 0, 1 FROM ({_EDGES}) b) u GROUP BY 1, 2""",
        *_GRAPH_VIEWS,
    ),
)


QUERIES["graph_layers"] = (
    lambda x: graph.layers(graph.edges(x.paths, x.mappings)),
    oracle(
        f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), n AS (SELECT report_path, source AS node FROM e UNION SELECT report_path, target FROM e),
size AS (SELECT report_path, count(*) AS k FROM n GROUP BY 1),
w AS (SELECT report_path, node, 0 AS d FROM n UNION
  SELECT w.report_path, e.target, d + 1 FROM w JOIN e ON e.report_path = w.report_path AND e.source = w.node JOIN size s ON s.report_path = w.report_path WHERE d < s.k),
m AS (SELECT w.report_path, node, max(d) AS d, max(k) AS k FROM w JOIN size s ON s.report_path = w.report_path GROUP BY 1, 2),
last AS (SELECT report_path, max(d) FILTER (WHERE d < k) + 1 AS l FROM m GROUP BY 1)
SELECT m.report_path, node, CAST(CASE WHEN d < k THEN d ELSE coalesce(l, 0) END AS INT) AS layer FROM m JOIN last ON last.report_path = m.report_path""",
        *_GRAPH_VIEWS,
    ),
)

# --- control coverage --------------------------------------------------------------------------------------------------
_REQUIRED = " UNION ALL ".join(
    f"SELECT '{a}' AS attack_type, {sql_text(s)} AS stage, '{kind}' AS relevance"
    for a, kinds in fv.STAGE_REQUIREMENTS.items()
    for kind in ("required", "not_applicable")
    for s in kinds[kind]
)
_CONTROLS = """SELECT assessment_id, stage_no, name AS stage, 0 AS control_no, control1 AS control_name, effect1 AS effect, evidence1 AS evidence, flag1 AS flag
FROM stages WHERE control1 IS NOT NULL UNION ALL SELECT assessment_id, stage_no, name, CASE WHEN control1 IS NULL THEN 0 ELSE 1 END, control2, effect2, evidence2, flag2
FROM stages WHERE control2 IS NOT NULL"""
QUERIES["stage_relevance"] = (
    lambda x: posture.stage_relevance(x.stages),
    oracle(
        f"""SELECT assessment_id, s.attack_type, stage_no, name, stage_present, coalesce(r.relevance, 'optional') AS relevance FROM stages s
LEFT JOIN ({_REQUIRED}) r ON r.attack_type = s.attack_type AND r.stage = s.name""",
        "stages",
    ),
)
QUERIES["missing_required_stages"] = (
    lambda x: posture.missing_required(x.stages),
    oracle(
        f"""SELECT a.assessment_id, r.stage AS name FROM (SELECT DISTINCT assessment_id, attack_type FROM stages) a JOIN ({_REQUIRED}) r USING (attack_type)
WHERE relevance = 'required' AND NOT EXISTS (SELECT 1 FROM stages s WHERE s.assessment_id = a.assessment_id AND s.name = r.stage AND s.stage_present)""",
        "stages",
    ),
)
QUERIES["assessment_metrics"] = (
    lambda x: posture.assessment_metrics(x.stages),
    oracle(
        f"""WITH q AS (SELECT attack_type, stage FROM ({_REQUIRED}) r WHERE relevance = 'required'),
c AS (SELECT assessment_id, s.attack_type, count(DISTINCT q.stage) AS covered, sum(assumptions) AS assumptions FROM stages s
  LEFT JOIN q ON q.attack_type = s.attack_type AND q.stage = s.name AND stage_present GROUP BY 1, 2),
k AS (SELECT assessment_id, count(*) AS n, count(*) FILTER (WHERE evidence IN ('tested', 'benchmark')) AS t FROM ({_CONTROLS}) u GROUP BY 1)
SELECT c.assessment_id, attack_type, round(covered / (SELECT count(*) FROM q WHERE q.attack_type = c.attack_type), 2) AS structural_completeness,
  CASE WHEN coalesce(n, 0) > 0 THEN round(t / n, 2) ELSE 0.0 END AS evidence_strength,
  CASE WHEN coalesce(n, 0) + assumptions > 0 THEN round(assumptions / (coalesce(n, 0) + assumptions), 2) ELSE 0.0 END AS assumption_density
FROM c LEFT JOIN k USING (assessment_id)""",
        "stages",
    ),
)
QUERIES["duplicate_controls"] = (
    lambda x: posture.duplicate_controls(x.stages),
    oracle(f"SELECT assessment_id, control_name, count(*) AS uses FROM ({_CONTROLS}) u GROUP BY 1, 2 HAVING count(*) > 1", "stages"),
)
QUERIES["independence_violations"] = (
    lambda x: posture.independence_violations(x.stages),
    oracle(f"SELECT assessment_id, stage_no, stage, control_name FROM ({_CONTROLS}) u WHERE flag", "stages"),
)
QUERIES["control_coverage"] = (
    lambda x: posture.control_coverage(x.stages),
    oracle(
        f"SELECT assessment_id, control_name, min_by(effect, stage_no * 10 + control_no) AS effectiveness, count(*) AS stages FROM ({_CONTROLS}) u GROUP BY 1, 2",
        "stages",
    ),
)
QUERIES["stage_presence"] = (
    lambda x: posture.presence_counts(x.stages),
    oracle(
        f"""SELECT assessment_id, count(*) FILTER (WHERE stage_present) AS stages_present, count(*) FILTER (WHERE NOT stage_present AND r.stage IS NOT NULL) AS required_missing
FROM stages s LEFT JOIN (SELECT * FROM ({_REQUIRED}) q WHERE relevance = 'required') r ON r.attack_type = s.attack_type AND r.stage = s.name GROUP BY assessment_id""",
        "stages",
    ),
)
QUERIES["unprotected_events"] = (
    lambda x: posture.unprotected_events(x.scenario_events),
    oracle("SELECT scenario_id, event_id, name, sequence_order FROM scenario_events WHERE blocking = 0", "scenario_events"),
)
QUERIES["weak_controls"] = (
    lambda x: posture.weak_controls(x.scenario_controls),
    oracle(
        "SELECT scenario_id, control_id, name, implementation_status AS status FROM scenario_controls WHERE implementation_status <> 'implemented'",
        "scenario_controls",
    ),
)
QUERIES["easy_bypass"] = (
    lambda x: posture.easy_bypass(x.scenario_controls),
    oracle(
        "SELECT scenario_id, control_id, name, bypass_difficulty AS difficulty FROM scenario_controls WHERE bypass_difficulty IN ('trivial', 'low')",
        "scenario_controls",
    ),
)
QUERIES["event_protection"] = (
    lambda x: posture.event_protection(x.scenario_events),
    oracle(
        """SELECT scenario_id, event_id, sequence_order, CASE WHEN blocking > 0 THEN 'PROTECTED' WHEN detecting > 0 THEN 'DETECT ONLY' ELSE 'UNPROTECTED' END AS protection
FROM scenario_events""",
        "scenario_events",
    ),
)
QUERIES["gap_totals"] = (
    lambda x: posture.gap_totals(x.scenario_controls, x.scenario_events),
    oracle(
        """SELECT scenario_id, u AS unprotected_events, w AS weak_controls, e AS easy_bypass, weakest_event, u + w + e AS total_issues FROM (
SELECT scenario_id, count(*) FILTER (WHERE blocking = 0) AS u, min_by(event_id, {'g': blocking + detecting, 's': sequence_order, 'e': event_id}) AS weakest_event FROM scenario_events GROUP BY 1) a
JOIN (SELECT scenario_id, count(*) FILTER (WHERE implementation_status <> 'implemented') AS w, count(*) FILTER (WHERE bypass_difficulty IN ('trivial', 'low')) AS e
FROM scenario_controls GROUP BY 1) b USING (scenario_id)""",
        "scenario_controls", "scenario_events",
    ),
)
_LAYERS = ", ".join(f"('{layer}')" for layer in posture.DEFENSE_LAYERS)
QUERIES["defense_coverage"] = (
    lambda x: posture.defense_coverage(x.scenario_controls),
    oracle(
        f"""SELECT s.scenario_id, l.layer, count(c.control_id) AS control_count, {', '.join(f"count(*) FILTER (WHERE c.implementation_status = '{st}') AS {st}" for st in posture.CONTROL_STATUSES)}
FROM (SELECT DISTINCT scenario_id FROM scenario_controls) s CROSS JOIN (VALUES {_LAYERS}) l(layer)
LEFT JOIN scenario_controls c ON c.scenario_id = s.scenario_id AND c.control_type = l.layer GROUP BY 1, 2""",
        "scenario_controls",
    ),
)
QUERIES["scenario_overview"] = (
    lambda x: posture.scenario_overview(x.scenarios, x.scenario_controls, x.scenario_events),
    oracle(
        """SELECT s.scenario_id, coalesce(c.n, 0) AS controls, coalesce(e.n, 0) AS events, coalesce(e.u, 0) AS unprotected FROM scenarios s
LEFT JOIN (SELECT scenario_id, count(*) AS n FROM scenario_controls GROUP BY 1) c USING (scenario_id)
LEFT JOIN (SELECT scenario_id, count(*) AS n, count(*) FILTER (WHERE blocking = 0) AS u FROM scenario_events GROUP BY 1) e USING (scenario_id)""",
        "scenarios", "scenario_controls", "scenario_events",
    ),
)
