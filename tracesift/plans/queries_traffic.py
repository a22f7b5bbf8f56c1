"""Queries over flows, hunts, industrial protocols and network health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import network as nw
from tracesift.functions import text as tx
from tracesift.functions import times
from tracesift.operators import flows, hunts, netops, ot
from tracesift.sources import packets as pk
from tracesift.sources import zeek

from .bindings import DNS_CASES, TLS_CASES, Inputs
from .oracle_sql import case_of, internal, loc, oracle, ports, service
from .queries_logs import joined

QUERIES: dict[str, tuple] = {}
_KEYS = "src_ip, dst_ip, dst_port, proto"

# --- flows ------------------------------------------------------------------------------------------
QUERIES["conversations"] = (
    lambda x: x.convs,
    oracle("SELECT * FROM convs", "convs"),
)
QUERIES["protocol_distribution"] = (
    lambda x: flows.protocol_distribution(x.connections),
    oracle(
        """SELECT proto, count(*) AS cnt, round(count(*) / (SELECT count(*) FROM connections) * 100, 1) AS percentage
FROM connections GROUP BY proto ORDER BY cnt DESC, proto LIMIT 10""",
        "connections",
    ),
)
QUERIES["capture_summary"] = (
    lambda x: flows.capture_summary(x.traffic),
    oracle(
        """SELECT 'connections' AS measure, CAST(count(*) AS DOUBLE) AS value FROM connections
UNION ALL SELECT 'packets', CAST(sum(packets) AS DOUBLE) FROM connections
UNION ALL SELECT 'bytes_out', CAST(sum(bytes_out) AS DOUBLE) FROM connections
UNION ALL SELECT 'duration_seconds', round(max(ts) - min(ts), 1) FROM connections
UNION ALL SELECT 'unique_ips', CAST(count(*) AS DOUBLE) FROM (SELECT src_ip FROM connections UNION SELECT dst_ip FROM connections) u
UNION ALL SELECT 'dns_queries', CAST(count(*) AS DOUBLE) FROM dns_queries
UNION ALL SELECT 'dns_responses', CAST(count(*) AS DOUBLE) FROM dns_responses
UNION ALL SELECT 'http_requests', CAST(count(*) AS DOUBLE) FROM http_requests
UNION ALL SELECT 'tls_handshakes', CAST(count(*) AS DOUBLE) FROM tls_handshakes
UNION ALL SELECT 'ot_transactions', CAST(count(*) AS DOUBLE) FROM ot
UNION ALL SELECT 'cleartext_creds', CAST(count(*) AS DOUBLE) FROM creds""",
        "connections", "dns_queries", "dns_responses", "http_requests", "tls_handshakes", "ot", "creds",
    ),
)
QUERIES["host_totals"] = (
    lambda x: flows.host_totals(x.convs),
    oracle(
        f"""SELECT count(*) AS total_ips, count(*) FILTER (WHERE {internal('h')}) AS internal_ips, count(*) FILTER (WHERE NOT {internal('h')}) AS external_ips
FROM (SELECT src_ip AS h FROM connections UNION SELECT dst_ip FROM connections) u""",
        "connections",
    ),
)
QUERIES["endpoint_counters"] = (
    lambda x: flows.endpoint_counters(x.connections),
    oracle(
        "SELECT counter, CAST(rank AS INT) AS rank, key, cnt FROM (SELECT *, row_number() OVER (PARTITION BY counter ORDER BY cnt DESC, key) AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS counter, CAST({c} AS VARCHAR) AS key, count(*) AS cnt FROM connections WHERE {test} GROUP BY {c}"
            for c, test in (("src_ip", "true"), ("dst_ip", "true"), ("src_port", "src_port <> 0"), ("dst_port", "dst_port <> 0"))
        )
        + ") u) r WHERE rank <= 20",
        "connections",
    ),
)
QUERIES["port_last_protocol"] = (
    lambda x: flows.port_last_protocol(x.connections),
    oracle(
        """SELECT dst_port, proto FROM (SELECT dst_port, proto, row_number() OVER (PARTITION BY dst_port ORDER BY ts DESC, proto DESC) AS n
FROM connections WHERE dst_port > 0) q WHERE n = 1""",
        "connections",
    ),
)
QUERIES["estimated_packets"] = (
    lambda x: flows.estimated_packets(x.convs),
    oracle("SELECT CAST(sum(packets) AS BIGINT) AS packet_count FROM connections", "connections"),
)
QUERIES["dns_activity"] = (
    lambda x: flows.dns_activity(x.queries, x.responses),
    oracle(
        """SELECT q.query, queries, sources, coalesce(answers, 0) AS answers FROM (SELECT query, count(*) AS queries, count(DISTINCT src_ip) AS sources
  FROM dns_queries GROUP BY query ORDER BY queries DESC, query LIMIT 30) q
LEFT JOIN (SELECT query, count(DISTINCT answer) AS answers FROM dns_responses GROUP BY query) r ON q.query = r.query""",
        "dns_queries", "dns_responses",
    ),
)
QUERIES["tls_by_name"] = (
    lambda x: flows.tls_by_name(x.handshakes),
    oracle(
        """SELECT sni, count(*) AS cnt, count(DISTINCT dst_ip) AS destinations FROM tls_handshakes WHERE sni <> '' GROUP BY sni
ORDER BY cnt DESC, sni LIMIT 30""",
        "tls_handshakes",
    ),
)
QUERIES["tls_name_destinations"] = (
    lambda x: flows.tls_name_destinations(x.handshakes),
    oracle(
        """SELECT sni, dst_ip, count(*) AS cnt FROM tls_handshakes WHERE sni IN (SELECT sni FROM tls_handshakes WHERE sni <> '' GROUP BY sni
ORDER BY count(*) DESC, sni LIMIT 20) GROUP BY sni, dst_ip""",
        "tls_handshakes",
    ),
)
QUERIES["tls_without_name"] = (
    lambda x: flows.tls_without_name(x.handshakes),
    oracle(
        f"SELECT DISTINCT src_ip, dst_ip, dst_port, {loc('dst_ip')} AS dst_location FROM tls_handshakes WHERE sni IS NULL OR sni = ''",
        "tls_handshakes",
    ),
)
QUERIES["http_listing"] = (
    lambda x: flows.http_listing(x.requests),
    oracle(
        "SELECT ts, src_ip, dst_ip, method, host, path FROM http_requests ORDER BY ts, src_ip, host, path LIMIT 30", "http_requests"
    ),
)


def _talkers_sql(metric: str) -> str:
    return oracle(
        f"""SELECT CAST(row_number() OVER (ORDER BY {metric} DESC, host) AS INT) AS rank, host, {loc('host')} AS location, bytes_out, bytes_in, total_bytes, connections,
  packets, peer_count FROM (SELECT host, CAST(sum(o) AS BIGINT) AS bytes_out, CAST(sum(i) AS BIGINT) AS bytes_in, CAST(sum(o + i) AS BIGINT) AS total_bytes,
  CAST(sum(c) AS BIGINT) AS connections, CAST(sum(p) AS BIGINT) AS packets, count(DISTINCT peer) AS peer_count FROM (
  SELECT src_ip AS host, dst_ip AS peer, bytes_out AS o, 0 AS i, 1 AS c, packets AS p FROM convs
  UNION ALL SELECT dst_ip, src_ip, 0, bytes_out, 0, 0 FROM convs) u GROUP BY host) h ORDER BY rank LIMIT 20""",
        "convs",
    )


QUERIES["talkers_by_bytes"] = (lambda x: flows.talkers(x.convs), _talkers_sql("total_bytes"))
QUERIES["talkers_by_connections"] = (lambda x: flows.talkers(x.convs, sort_by="connections"), _talkers_sql("connections"))
_SPAN = "coalesce(last_seen - first_seen, 0.0)"
for _sort, _metric in (("bytes", "bytes_out"), ("duration", _SPAN)):
    QUERIES[f"top_conversations_by_{_sort}"] = (
        lambda x, s=_sort: flows.top_conversations(x.convs, 20, s),
        oracle(
            f"""SELECT CAST(row_number() OVER (ORDER BY {_metric} DESC, {_KEYS}) AS INT) AS rank, {_KEYS}, packets, bytes_out, round({_SPAN}, 3) AS duration,
  concat({loc('src_ip')}, '->', {loc('dst_ip')}) AS direction FROM convs ORDER BY rank LIMIT 20""",
            "convs",
        ),
    )
QUERIES["long_connections"] = (
    lambda x: flows.long_connections(x.convs, 300, True, 50),
    oracle(
        f"""SELECT {_KEYS}, round({_SPAN}, 3) AS duration, packets, bytes_out FROM convs WHERE {_SPAN} >= 300
ORDER BY {_SPAN} DESC, {_KEYS} LIMIT 50""",
        "convs",
    ),
)
QUERIES["bidirectional_pairs"] = (
    lambda x: joined(flows.bidirectional_pairs(x.convs, 200), "ports", "protocols"),
    oracle(
        f"""SELECT a AS host_a, b AS host_b, concat({loc('a')}, '<->', {loc('b')}) AS direction, ab AS bytes_a_to_b, ba AS bytes_b_to_a, ab + ba AS total_bytes,
  pab AS packets_a_to_b, pba AS packets_b_to_a, round(greatest(ab, ba) / greatest(least(ab, ba), 1), 4) AS ratio, ports, protocols, round(l - f, 3) AS duration
FROM (SELECT least(src_ip, dst_ip) AS a, greatest(src_ip, dst_ip) AS b, CAST(sum(CASE WHEN src_ip <= dst_ip THEN bytes_out ELSE 0 END) AS BIGINT) AS ab,
  CAST(sum(CASE WHEN src_ip > dst_ip THEN bytes_out ELSE 0 END) AS BIGINT) AS ba, CAST(sum(CASE WHEN src_ip <= dst_ip THEN packets ELSE 0 END) AS BIGINT) AS pab,
  CAST(sum(CASE WHEN src_ip > dst_ip THEN packets ELSE 0 END) AS BIGINT) AS pba, array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS ports,
  array_to_string(list_sort(list(DISTINCT proto)), ',') AS protocols, min(first_seen) AS f, max(last_seen) AS l FROM convs GROUP BY 1, 2) p
ORDER BY ab + ba DESC, a, b LIMIT 200""",
        "convs",
    ),
)
QUERIES["protocol_breakdown"] = (
    lambda x: flows.protocol_breakdown(x.convs, x.queries, x.requests, x.handshakes),
    oracle(
        """SELECT host, CAST(sum(c) AS BIGINT) AS conversation_count, CAST(sum(d) AS BIGINT) AS dns_count, CAST(sum(h) AS BIGINT) AS http_count,
  CAST(sum(t) AS BIGINT) AS tls_count, CAST(sum(b) AS BIGINT) AS total_bytes FROM (
SELECT src_ip AS host, 1 AS c, 0 AS d, 0 AS h, 0 AS t, bytes_out AS b FROM convs
UNION ALL SELECT src_ip, 0, 1, 0, 0, 0 FROM dns_queries UNION ALL SELECT src_ip, 0, 0, 1, 0, 0 FROM http_requests
UNION ALL SELECT src_ip, 0, 0, 0, 1, 0 FROM tls_handshakes) u GROUP BY host ORDER BY total_bytes DESC, host LIMIT 50""",
        "convs", "dns_queries", "http_requests", "tls_handshakes",
    ),
)
_STORES = ("convs", "dns_queries", "dns_responses", "http_requests", "tls_handshakes")


def _search_sql(conv: str, query: str, answer: str, http: str, tls: str) -> str:
    part = "(SELECT '{0}' AS store, {1} AS ts, src_ip, dst_ip, {2} AS detail FROM {3} WHERE {4})"
    return oracle(
        " UNION ALL ".join(
            part.format(*row)
            for row in (
                ("conversation", "first_seen", "concat(':', dst_port, '/', proto)", "convs", conv),
                ("dns_query", "ts", "query", "dns_queries", query),
                ("dns_answer", "ts", "concat(query, ' -> ', answer)", "dns_responses", answer),
                ("http", "ts", "concat(method, ' ', host, path)", "http_requests", http),
                ("tls", "ts", "coalesce(sni, '')", "tls_handshakes", tls),
            )
        ),
        *_STORES,
    )


def _search(x: Inputs, value: str):
    return flows.indicator_search(value, x.convs, x.queries, x.responses, x.requests, x.handshakes)


_IP_ENDS = "(src_ip = '{0}' OR dst_ip = '{0}')"
QUERIES["indicator_search_ip"] = (
    lambda x: _search(x, "203.0.113.7"),
    _search_sql(*[_IP_ENDS.format("203.0.113.7")] * 2, "answer = '203.0.113.7'", *[_IP_ENDS.format("203.0.113.7")] * 2),
)
QUERIES["indicator_search_domain"] = (
    lambda x: _search(x, "Evil-Corp1"),
    _search_sql(
        "false", *["contains(lower(query), 'evil-corp1')"] * 2,
        "contains(lower(host), 'evil-corp1') OR contains(lower(path), 'evil-corp1')", "contains(lower(coalesce(sni, '')), 'evil-corp1')",
    ),
)
QUERIES["indicator_search_port"] = (
    lambda x: _search(x, "8443"),
    _search_sql("dst_port = 8443", "false", "false", "false", "dst_port = 8443"),
)
QUERIES["indicator_types"] = (
    lambda x: x.queries.select(F.explode(F.array("query", "src_ip", F.substring_index("src_ip", ".", -1))).alias("v")).distinct()
    .select("v", nw.indicator_type("v").alias("kind")),
    oracle(
        r"""SELECT v, CASE WHEN regexp_matches(v, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$') THEN 'ip'
  WHEN TRY_CAST(v AS INT) BETWEEN 1 AND 65535 THEN 'port' ELSE 'domain' END AS kind FROM (
SELECT query AS v FROM dns_queries UNION SELECT src_ip FROM dns_queries UNION SELECT split_part(src_ip, '.', 4) FROM dns_queries) u""",
        "dns_queries",
    ),
)
QUERIES["timeline_of_host"] = (
    lambda x: flows.timeline(x.convs, x.queries, x.requests, x.handshakes, "10.0.0.5"),
    oracle(
        f"""SELECT * FROM (SELECT first_seen AS ts, 'connection' AS type, src_ip, dst_ip, concat(dst_port, '/', proto) AS detail,
  CASE WHEN src_ip = '10.0.0.5' THEN 'outbound' ELSE 'inbound' END AS direction FROM convs WHERE {_IP_ENDS.format('10.0.0.5')}
UNION ALL SELECT ts, 'dns', src_ip, dst_ip, query, NULL FROM dns_queries WHERE {_IP_ENDS.format('10.0.0.5')}
UNION ALL SELECT ts, 'http', src_ip, dst_ip, concat(method, ' ', host, path), NULL FROM http_requests WHERE {_IP_ENDS.format('10.0.0.5')}
UNION ALL SELECT ts, 'tls', src_ip, dst_ip, coalesce(sni, ''), NULL FROM tls_handshakes WHERE {_IP_ENDS.format('10.0.0.5')}) u
""",
        *_STORES,
    ),
)
QUERIES["flow_text_columns"] = (
    lambda x: x.convs.select(
        "src_ip", "dst_ip", "dst_port", "proto", tx.bytes_text("bytes_out").alias("size"), tx.bytes_text_scaled("bytes_out").alias("size_scaled"),
        times.duration_text(flows.span()).alias("lasted"), times.utc_text("first_seen").alias("first_text"),
        nw.subnet24("dst_ip").alias("subnet"), nw.service_label("dst_port").alias("service"),
    ),
    oracle(
        f"""SELECT {_KEYS}, CASE WHEN bytes_out < 1024 THEN concat(bytes_out, ' B') WHEN bytes_out < 1048576 THEN printf('%.1f KB', bytes_out / 1024)
    WHEN bytes_out < 1073741824 THEN printf('%.1f MB', bytes_out / 1048576) ELSE printf('%.1f GB', bytes_out / 1073741824) END AS size,
  CASE WHEN bytes_out < 1024 THEN printf('%.1f B', CAST(bytes_out AS DOUBLE)) WHEN bytes_out < 1048576 THEN printf('%.1f KB', bytes_out / 1024)
    WHEN bytes_out < 1073741824 THEN printf('%.1f MB', bytes_out / 1048576) ELSE printf('%.1f GB', bytes_out / 1073741824) END AS size_scaled,
  CASE WHEN d < 60 THEN printf('%.1fs', d) WHEN d < 3600 THEN printf('%.1fmin', d / 60) ELSE printf('%.1fhrs', d / 3600) END AS lasted,
  strftime(make_timestamp(CAST(floor(first_seen * 1e6) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS first_text,
  CASE WHEN contains(dst_ip, '.') THEN regexp_replace(dst_ip, '\\.[^.]*$', '.0/24') ELSE dst_ip END AS subnet, {service('dst_port')} AS service
FROM (SELECT *, {_SPAN} AS d FROM convs) c""".replace("\\\\", "\\"),
        "convs",
    ),
)

# --- hunts ------------------------------------------------------------------------------------------------
_PORT_TOTALS = """SELECT dst_port, count(*) AS flow_count, count(DISTINCT src_ip) AS source_count, count(DISTINCT dst_ip) AS destination_count,
  CAST(sum(bytes_out) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets FROM convs WHERE dst_port > 0 GROUP BY dst_port"""
_CATEGORIES = (
    ("standard", f"dst_port IN {ports(fv.KNOWN_SERVICES)}", case_of("dst_port", fv.KNOWN_SERVICES), 100000),
    ("ics", f"dst_port IN {ports(fv.ICS_PORTS)}", case_of("dst_port", fv.ICS_PORTS), 100000),
    ("suspicious", f"dst_port IN {ports(fv.SUSPICIOUS_PORTS)}", case_of("dst_port", fv.SUSPICIOUS_PORTS), 100000),
    ("unknown_high", f"dst_port > 1024 AND dst_port NOT IN {ports(fv.KNOWN_SERVICES | fv.ICS_PORTS | fv.SUSPICIOUS_PORTS)}", "'unknown'", 100000),
)
_PORT_USAGE = " UNION ALL ".join(
    f"""(SELECT '{name}' AS category, CAST(row_number() OVER (ORDER BY flow_count DESC, dst_port) AS INT) AS rank, dst_port, {label} AS service, flow_count,
source_count, destination_count, bytes FROM ({_PORT_TOTALS}) t WHERE {test} ORDER BY rank LIMIT {limit})"""
    for name, test, label, limit in _CATEGORIES
)
QUERIES["port_usage"] = (lambda x: hunts.port_usage(x.convs), oracle(_PORT_USAGE, "convs"))
QUERIES["ops_port_usage"] = (
    lambda x: hunts.ops_port_usage(x.convs).withColumn("service", F.coalesce("service", F.lit(""))),
    oracle(
        f"""(SELECT true AS known, CAST(row_number() OVER (ORDER BY flow_count DESC, dst_port) AS INT) AS rank, dst_port, {case_of('dst_port', fv.OPS_SERVICES)} AS service,
  flow_count, source_count, bytes, packets FROM ({_PORT_TOTALS}) t WHERE dst_port IN {ports(fv.OPS_SERVICES)} ORDER BY rank LIMIT 20)
UNION ALL (SELECT false, CAST(row_number() OVER (ORDER BY flow_count DESC, dst_port) AS INT) AS rank, dst_port, '', flow_count, source_count, bytes, packets
FROM ({_PORT_TOTALS}) t WHERE dst_port NOT IN {ports(fv.OPS_SERVICES)} AND dst_port > 1024 ORDER BY rank LIMIT 15)""",
        "convs",
    ),
)
_BEACONS = f"""SELECT src_ip, dst_ip, dst_port, {service('dst_port')} AS service, n AS connections, round(m, 2) AS mean_interval, round(s, 2) AS std_deviation,
  round(s / m * 100, 1) AS jitter_pct, round(l - f, 1) AS duration, CASE WHEN s / m * 100 < 5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
FROM (SELECT src_ip, dst_ip, dst_port, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s, min(ts) AS f, max(ts) AS l
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts) AS gap FROM connections
    WHERE {internal('src_ip')} AND NOT {internal('dst_ip')}) g GROUP BY src_ip, dst_ip, dst_port) b
WHERE n >= 10 AND m > 0 AND s / m * 100 <= 15"""
QUERIES["beacons"] = (lambda x: hunts.beacons(x.connections), oracle(_BEACONS, "connections"))
_ENTROPY = """(SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*) AS c, max(length(label)) AS n
  FROM (SELECT label, unnest(string_split(label, '')) AS ch) e GROUP BY ch) f)"""
_DGA = """SELECT domain, label, round(entropy, 2) AS entropy, CAST(label_length AS INT) AS label_length FROM (
SELECT domain, label, max(n) AS label_length, -sum(c / n * log2(c / n)) AS entropy FROM (
  SELECT domain, label, ch, count(*) AS c, max(length(label)) AS n FROM (SELECT domain, label, unnest(string_split(label, '')) AS ch FROM (
    SELECT DISTINCT query AS domain, CASE WHEN length(query) - length(replace(query, '.', '')) >= 2 THEN split_part(query, '.', 1) ELSE query END AS label
    FROM dns_queries WHERE contains(query, '.')) d WHERE length(label) > 10) e GROUP BY domain, label, ch) f GROUP BY domain, label) g WHERE entropy > 3.5"""
QUERIES["dga_candidates"] = (lambda x: hunts.dga_candidates(x.queries), oracle(_DGA, "dns_queries"))
_TUNNELS = r"""SELECT base_domain, count(DISTINCT sub) AS unique_subdomains FROM (
SELECT regexp_extract(query, '([^.]*\.[^.]*)$', 1) AS base_domain, regexp_extract(query, '^(.*)\.[^.]*\.[^.]*$', 1) AS sub
FROM dns_queries WHERE length(query) - length(replace(query, '.', '')) >= 2) q GROUP BY base_domain HAVING count(DISTINCT sub) > 20"""
QUERIES["tunnel_candidates"] = (lambda x: hunts.tunnel_candidates(x.queries), oracle(_TUNNELS, "dns_queries"))
_TXT = "SELECT src_ip, query, count(*) AS cnt FROM dns_queries WHERE qtype IN ('TXT', '16') GROUP BY src_ip, query"
QUERIES["txt_queries"] = (lambda x: hunts.txt_queries(x.queries), oracle(_TXT, "dns_queries"))
_FREQUENT = "SELECT * FROM (SELECT query, count(*) AS cnt FROM dns_queries GROUP BY query) q WHERE cnt > 50"
QUERIES["frequent_names"] = (lambda x: hunts.frequent_names(x.queries), oracle(_FREQUENT, "dns_queries"))
_TLS_NAMES = """(SELECT 'sni' AS type, sni AS target, count(*) AS cnt, count(DISTINCT dst_ip) AS destinations FROM tls_handshakes WHERE sni <> ''
  GROUP BY sni)
UNION ALL (SELECT 'no_sni', concat(dst_ip, ':', dst_port) AS target, count(*) AS cnt, 1 FROM tls_handshakes WHERE sni IS NULL OR sni = ''
  GROUP BY target)"""
QUERIES["tls_names"] = (lambda x: hunts.tls_names(x.handshakes), oracle(_TLS_NAMES, "tls_handshakes"))
_LATERAL_ROWS = f"SELECT *, {case_of('dst_port', fv.LATERAL_PORTS)} AS svc FROM convs WHERE dst_port IN {ports(fv.LATERAL_PORTS)} AND {internal('src_ip')} AND {internal('dst_ip')}"
_LATERAL = f"""SELECT src_ip, count(DISTINCT dst_ip) AS target_count, count(*) AS flow_count, array_to_string(list_sort(list(DISTINCT svc)), ',') AS services,
  count(DISTINCT dst_ip) > 5 AS potential_scan FROM ({_LATERAL_ROWS}) q GROUP BY src_ip"""
QUERIES["lateral_movement"] = (lambda x: joined(hunts.lateral_movement(x.convs), "services"), oracle(_LATERAL, "convs"))
QUERIES["lateral_flows"] = (
    lambda x: hunts.lateral_flows(x.convs),
    oracle(
        f"""SELECT src_ip, CAST(n AS INT) AS flow_no, dst_ip, dst_port, svc AS service, packets, bytes_out FROM (
SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY dst_ip, dst_port, proto) AS n FROM ({_LATERAL_ROWS}) q) r""",
        "convs",
    ),
)
_SCANS = f"""SELECT src_ip, dst_port, {service('dst_port')} AS service, target_count FROM (SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS target_count
  FROM convs WHERE dst_port > 0 AND {internal('src_ip')} AND {internal('dst_ip')} GROUP BY src_ip, dst_port HAVING count(DISTINCT dst_ip) >= 5) q"""
QUERIES["horizontal_scans"] = (lambda x: hunts.horizontal_scans(x.convs), oracle(_SCANS, "convs"))
_ICS_CROSS = f"""SELECT src_ip, dst_ip, dst_port, proto, {case_of('dst_port', fv.ICS_LATERAL_PORTS)} AS service, packets, {loc('src_ip')} AS src_location,
  {loc('dst_ip')} AS dst_location FROM convs WHERE dst_port IN {ports(fv.ICS_LATERAL_PORTS)} AND NOT ({internal('src_ip')} AND {internal('dst_ip')})"""
QUERIES["ics_cross_zone"] = (lambda x: hunts.ics_cross_zone(x.convs), oracle(_ICS_CROSS, "convs"))
_EXFIL = f"""SELECT f.src_ip, f.dst_ip, f.bytes_out, f.same_in + coalesce(r.back, 0) AS bytes_in, round(f.bytes_out / greatest(f.same_in + coalesce(r.back, 0), 1), 1) AS ratio,
  f.packets, f.ports, round(f.l - f.f, 3) AS duration FROM (SELECT src_ip, dst_ip, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS same_in,
    CAST(sum(packets) AS BIGINT) AS packets, array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS ports, min(first_seen) AS f, max(last_seen) AS l
    FROM convs WHERE {internal('src_ip')} AND NOT {internal('dst_ip')} GROUP BY src_ip, dst_ip) f
LEFT JOIN (SELECT dst_ip AS s, src_ip AS d, CAST(sum(bytes_out) AS BIGINT) AS back FROM convs WHERE NOT {internal('src_ip')} AND {internal('dst_ip')}
    GROUP BY dst_ip, src_ip) r ON f.src_ip = r.s AND f.dst_ip = r.d
WHERE f.bytes_out >= 1048576 AND f.bytes_out / greatest(f.same_in + coalesce(r.back, 0), 1) >= 10"""
QUERIES["asymmetric_outbound"] = (lambda x: joined(hunts.asymmetric_outbound(x.convs), "ports"), oracle(_EXFIL, "convs"))
_FINDINGS = f"""SELECT 'beacons' AS hunt, 'beacon' AS type, CASE WHEN confidence = 'HIGH' THEN 'critical' ELSE 'high' END AS severity,
  concat_ws(' ', src_ip, dst_ip, dst_port) AS subject, CAST(jitter_pct AS DOUBLE) AS metric FROM ({_BEACONS}) q
UNION ALL SELECT 'dns', 'dga_candidate', 'high', domain, CAST(entropy AS DOUBLE) FROM ({_DGA}) q
UNION ALL SELECT 'dns', 'tunnel_candidate', 'high', base_domain, CAST(unique_subdomains AS DOUBLE) FROM ({_TUNNELS}) q
UNION ALL SELECT 'dns', 'txt_query', 'info', concat_ws(' ', src_ip, query), CAST(cnt AS DOUBLE) FROM ({_TXT}) q
UNION ALL SELECT 'dns', 'high_frequency', 'info', query, CAST(cnt AS DOUBLE) FROM ({_FREQUENT}) q
UNION ALL SELECT 'tls', 'name', CASE WHEN type = 'no_sni' THEN 'medium' ELSE 'info' END, concat_ws(' ', type, target), CAST(cnt AS DOUBLE) FROM ({_TLS_NAMES}) q
UNION ALL SELECT 'ports', 'port', CASE category WHEN 'ics' THEN 'high' WHEN 'suspicious' THEN 'critical' ELSE 'info' END, concat_ws(' ', category, dst_port),
  CAST(flow_count AS DOUBLE) FROM ({_PORT_USAGE}) q
UNION ALL SELECT 'lateral', 'mgmt_lateral', 'high', src_ip, CAST(target_count AS DOUBLE) FROM ({_LATERAL}) q
UNION ALL SELECT 'lateral', 'port_scan', 'critical', concat_ws(' ', src_ip, dst_port), CAST(target_count AS DOUBLE) FROM ({_SCANS}) q
UNION ALL SELECT 'lateral', 'ics_cross_zone', 'critical', concat_ws(' ', src_ip, dst_ip, dst_port, proto), CAST(packets AS DOUBLE) FROM ({_ICS_CROSS}) q
UNION ALL SELECT 'exfil', 'asymmetric_outbound', 'critical', concat_ws(' ', src_ip, dst_ip), CAST(bytes_out AS DOUBLE) FROM ({_EXFIL}) q
UNION ALL SELECT 'exfil', 'dns_exfil', 'high', base_domain, CAST(unique_subdomains AS DOUBLE) FROM ({_TUNNELS}) q"""


def _findings(x: Inputs):
    return hunts.findings(x.connections, x.convs, x.queries, x.handshakes)


QUERIES["hunt_findings"] = (_findings, oracle(_FINDINGS, "connections", "convs", "dns_queries", "tls_handshakes"))
QUERIES["hunt_severity"] = (
    lambda x: hunts.hunt_severity(_findings(x)),
    oracle(
        f"""SELECT hunt, CASE WHEN hunt = 'ports' AND bool_or(severity = 'high') THEN 'high'
  ELSE CASE max(CASE severity WHEN 'info' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) WHEN 0 THEN 'info' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END
  END AS severity, count(*) AS findings FROM ({_FINDINGS}) f GROUP BY hunt""",
        "connections", "convs", "dns_queries", "tls_handshakes",
    ),
)
QUERIES["ports_severity"] = (
    lambda x: hunts.ports_severity(hunts.port_usage(x.convs)),
    oracle(
        f"SELECT CASE WHEN bool_or(category = 'ics') THEN 'high' WHEN bool_or(category = 'suspicious') THEN 'critical' ELSE 'info' END AS severity FROM ({_PORT_USAGE}) q",
        "convs",
    ),
)

# --- industrial protocols ------------------------------------------------------------------------------------
_OT_TEXT = ("function_name", "pdu_type")
_OT_INT = ("unit_id", "function_code", "exception_code")
_OT_FLAGS = ("is_write", "is_control", "is_diagnostic", "is_exception")


def _ot_shown(x: Inputs):
    return x.ot.select(
        "capture", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        *[F.coalesce(c, F.lit("")).alias(c) for c in _OT_TEXT], *[F.coalesce(c, F.lit(-1)).alias(c) for c in _OT_INT],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in _OT_FLAGS],
    )


QUERIES["ot_transactions"] = (
    _ot_shown,
    oracle(
        "SELECT capture, ts, src_ip, dst_ip, src_port, dst_port, protocol, "
        + ", ".join(
            [f"coalesce({c}, '') AS {c}" for c in _OT_TEXT]
            + [f"CAST(coalesce({c}, -1) AS INT) AS {c}" for c in _OT_INT]
            + [f"coalesce({c}, false) AS {c}" for c in _OT_FLAGS]
        )
        + " FROM ot",
        "ot",
    ),
)
QUERIES["ot_by_protocol"] = (
    lambda x: ot.by_protocol(x.ot),
    oracle(
        """SELECT protocol, count(*) AS transactions, count(*) FILTER (WHERE is_write) AS writes, count(*) FILTER (WHERE is_control) AS controls,
  count(*) FILTER (WHERE is_exception) AS exceptions, count(*) FILTER (WHERE is_diagnostic) AS diagnostics FROM ot GROUP BY protocol""",
        "ot",
    ),
)
QUERIES["ot_controls"] = (
    lambda x: ot.flagged(x.ot, "control"),
    oracle("SELECT ts, src_ip, dst_ip, dst_port, protocol, coalesce(function_name, '?') AS function_name FROM ot WHERE is_control", "ot"),
)
QUERIES["ot_endpoints"] = (
    lambda x: ot.endpoints(x.ot),
    oracle(f"SELECT h AS host, {loc('h')} AS location FROM (SELECT src_ip AS h FROM ot UNION SELECT dst_ip FROM ot) u", "ot"),
)
QUERIES["ot_writes_by_source"] = (
    lambda x: joined(ot.writes_by_source(x.ot), "protocols", "functions"),
    oracle(
        """SELECT src_ip, count(*) AS writes, count(DISTINCT dst_ip) AS targets, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols,
  array_to_string(list_sort(list(DISTINCT coalesce(function_name, '?'))), ',') AS functions FROM ot WHERE is_write GROUP BY src_ip
ORDER BY writes DESC, src_ip LIMIT 15""",
        "ot",
    ),
)
QUERIES["ot_exceptions"] = (
    lambda x: ot.exceptions_by_function(x.ot),
    oracle(
        """SELECT coalesce(function_name, '?') AS function_name, coalesce(CAST(exception_code AS VARCHAR), '?') AS exception_code, count(*) AS cnt
FROM ot WHERE is_exception GROUP BY ALL ORDER BY cnt DESC, function_name, exception_code LIMIT 10""",
        "ot",
    ),
)
QUERIES["modbus_functions"] = (
    lambda x: joined(ot.modbus_functions(x.ot), "unit_ids").withColumn("mark", F.coalesce("mark", F.lit(""))),
    oracle(
        f"""SELECT CAST(function_code AS INT) AS function_code, function_name, count(*) AS cnt, array_to_string(list_sort(list(DISTINCT unit_id)), ',') AS unit_ids,
  CASE WHEN function_code IN {ports(fv.MODBUS_DIAGNOSTICS)} THEN 'DIAG' WHEN function_code IN {ports(fv.MODBUS_WRITES)} THEN 'WRITE' ELSE '' END AS mark
FROM ot WHERE protocol = 'Modbus' AND function_code IS NOT NULL GROUP BY ALL""",
        "ot",
    ),
)
QUERIES["cleartext_creds"] = (
    lambda x: x.creds.withColumn("port", F.coalesce("port", F.lit(0))),
    oracle("SELECT capture, ts, src_ip, dst_ip, coalesce(port, 0) AS port, protocol, description FROM creds", "creds"),
)
QUERIES["credentials_by_protocol"] = (
    lambda x: ot.credentials_by_protocol(x.creds),
    oracle(
        """SELECT protocol, count(*) AS detections, count(DISTINCT (src_ip, dst_ip)) AS pairs, min(description) AS description FROM creds GROUP BY protocol""",
        "creds",
    ),
)
_ZONE_IN = lambda table: f"dst_port IN {ports(table)}"
_ZONES = f"""SELECT host, CASE WHEN NOT {internal('host')} THEN 'External' WHEN so AND uo THEN 'SCADA' WHEN so THEN 'CONTROL/FIELD' WHEN uo AND office THEN 'Corporate'
  WHEN uo THEN 'SCADA' WHEN sd THEN 'DMZ' ELSE 'Corporate' END AS zone FROM (
SELECT host, bool_or(served AND {_ZONE_IN(fv.SCADA_PORTS)}) AS so, bool_or(NOT served AND {_ZONE_IN(fv.SCADA_PORTS)}) AS uo,
  bool_or({_ZONE_IN(fv.CORPORATE_PORTS + fv.DMZ_PORTS)}) AS office, bool_or(served AND {_ZONE_IN(fv.DMZ_PORTS)}) AS sd FROM (
  SELECT src_ip AS host, false AS served, dst_port FROM convs UNION ALL SELECT dst_ip, true, dst_port FROM convs) u GROUP BY host) z"""
_ZONE_NO = case_of("zone", {z: n for n, z in enumerate(fv.ZONES)})
_NET = lambda c: f"array_to_string(string_split({c}, '.')[1:3], '.')"
_NETS = f"""SELECT network, zone, votes FROM (SELECT *, row_number() OVER (PARTITION BY network ORDER BY votes DESC, {_ZONE_NO}) AS n FROM (
SELECT {_NET('host')} AS network, zone, count(*) AS votes FROM ({_ZONES}) z WHERE len(string_split(host, '.')) = 4 GROUP BY 1, 2) v) r WHERE n = 1"""
_NET_PAIRS = f"""SELECT least(a, b) AS network_a, greatest(a, b) AS network_b, CAST(sum(bytes_out) AS BIGINT) AS bytes
FROM (SELECT {_NET('src_ip')} AS a, {_NET('dst_ip')} AS b, bytes_out FROM convs) q WHERE a <> b GROUP BY 1, 2"""
QUERIES["host_zones"] = (lambda x: ot.host_zones(x.convs), oracle(_ZONES, "convs"))
QUERIES["network_zones"] = (lambda x: ot.network_zones(ot.host_zones(x.convs)), oracle(_NETS, "convs"))
QUERIES["network_pairs"] = (lambda x: ot.network_pairs(x.convs), oracle(_NET_PAIRS, "convs"))
QUERIES["zone_matrix"] = (
    lambda x: ot.zone_matrix(x.convs),
    oracle(
        f"""WITH nets AS ({_NETS}) SELECT za AS zone_a, zb AS zone_b, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS network_pairs FROM (
SELECT coalesce(a.zone, 'External') AS za, coalesce(b.zone, 'External') AS zb, bytes FROM ({_NET_PAIRS}) p
LEFT JOIN nets a ON a.network = network_a LEFT JOIN nets b ON b.network = network_b) q WHERE za <> zb GROUP BY za, zb""",
        "convs",
    ),
)

# --- network health ---------------------------------------------------------------------------------------------
QUERIES["packet_conversations"] = (
    lambda x: flows.conversations(pk.connections(x.packets)).drop("bytes_in", "n_connections"),
    oracle(
        """SELECT src_ip, dst_ip, coalesce(dst_port, 0) AS dst_port, CASE ip_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE 'OTHER' END AS proto,
  count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes_out, min(ts) AS first_seen, max(ts) AS last_seen
FROM packets WHERE src_ip IS NOT NULL GROUP BY 1, 2, 3, 4""",
        "packets",
    ),
)
QUERIES["packet_http_requests"] = (
    lambda x: pk.http_requests(x.packets).select("capture", "ts", "src_ip", "dst_ip", "method", "path", "host"),
    oracle(
        r"""SELECT capture, ts, src_ip, dst_ip, regexp_extract(body, '^([A-Z]+) (\S+)', 1) AS method, regexp_extract(body, '^([A-Z]+) (\S+)', 2) AS path,
  trim(regexp_extract(body, '(?im)^host:[ \t]*([^\r\n]*)', 1)) AS host FROM (
SELECT *, CASE WHEN regexp_matches(payload_hex, '^([0-7].)*$') THEN decode(unhex(payload_hex)) ELSE '' END AS body FROM packets WHERE ip_proto = 6) p
WHERE regexp_matches(body, '^(GET |POST|PUT |HEAD|DELE|PATC|OPTI)')""",
        "packets",
    ),
)
_CASE = lambda cases, field: "CASE l_no " + " ".join(
    f"WHEN {no} THEN {'NULL' if case[field] is None else repr(case[field]) if isinstance(case[field], str) else case[field]}" for no, case in enumerate(cases)
) + " END"


def _by_payload(cases, which: str) -> str:
    arms = " ".join(f"WHEN '{case[0]}' THEN {no}" for no, case in enumerate(cases))
    return f"(SELECT *, CASE payload_hex {arms} END AS l_no FROM packets WHERE {which})"


QUERIES["packet_dns_messages"] = (
    lambda x: pk.dns_messages(x.packets),
    oracle(
        f"""SELECT capture, ts, src_ip, dst_ip, {', '.join(f"{_CASE(DNS_CASES, no)} AS {name}" for no, name in enumerate(('kind', 'query', 'qtype', 'answer', 'rcode'), 1))}
FROM {_by_payload(DNS_CASES, 'ip_proto = 17 AND (src_port = 53 OR dst_port = 53)')}""",
        "packets",
    ),
)
QUERIES["packet_dns_totals"] = (
    lambda x: pk.dns_messages(x.packets).groupBy("capture", "kind").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("query").alias("names")),
    oracle(
        f"""SELECT capture, kind, count(*) AS messages, count(DISTINCT query) AS names FROM (SELECT capture, {_CASE(DNS_CASES, 1)} AS kind, {_CASE(DNS_CASES, 2)} AS query
FROM {_by_payload(DNS_CASES, 'ip_proto = 17 AND (src_port = 53 OR dst_port = 53)')}) q GROUP BY capture, kind""",
        "packets",
    ),
)
QUERIES["packet_tls_names"] = (
    lambda x: pk.tls_client_hellos(x.packets),
    oracle(
        f"""SELECT capture, ts, src_ip, dst_ip, dst_port, {_CASE(TLS_CASES, 2)} AS sni, {_CASE(TLS_CASES, 3)} AS malformed
FROM {_by_payload(TLS_CASES, "ip_proto = 6")} WHERE {_CASE(TLS_CASES, 1)}""",
        "packets",
    ),
)
QUERIES["arp_messages"] = (
    lambda x: pk.arp_messages(x.packets),
    oracle(
        """SELECT capture, pkt_no, ts, CASE arp_op WHEN 1 THEN 'request' ELSE 'reply' END AS kind, arp_spa AS sender_ip, arp_sha AS sender_mac, arp_tpa AS target_ip,
  arp_op = 1 AND arp_spa = arp_tpa AS gratuitous FROM packets WHERE arp_op IN (1, 2)""",
        "packets",
    ),
)
QUERIES["icmp_errors"] = (lambda x: x.icmp_errors, oracle("SELECT * FROM icmp", "icmp"))
QUERIES["loop_packets"] = (lambda x: x.loop_packets, oracle("SELECT * FROM loops", "loops"))
_TCP = """SELECT count(*) AS n, count(*) FILTER (WHERE tcp_flags & 2 <> 0) AS syn, count(*) FILTER (WHERE tcp_flags & 1 <> 0) AS fin,
  count(*) FILTER (WHERE tcp_flags & 4 <> 0) AS rst, count(*) FILTER (WHERE tcp_window = 0) AS zw FROM packets WHERE ip_proto = 6"""
QUERIES["tcp_health"] = (
    lambda x: netops.tcp_health(x.packets),
    oracle(
        f"""SELECT n AS tcp_packets, syn, fin, rst, zw AS zero_window, 0 AS retransmissions, round(rst / n * 100, 2) AS rst_pct, 0.0::DOUBLE AS retransmit_pct,
  round(fin / syn * 100, 1) AS completion_pct, round(rst / syn * 100, 1) AS failure_pct, 'HEALTHY' AS grade FROM ({_TCP}) t""",
        "packets",
    ),
)
QUERIES["problem_conversations"] = (
    lambda x: netops.problem_conversations(x.packets),
    oracle(
        f"""SELECT *, rst + retransmit + zero_window AS issues FROM (SELECT src_ip, dst_ip, dst_port, 'TCP' AS proto, count(*) FILTER (WHERE tcp_flags & 4 <> 0) AS rst,
  CAST(0 AS BIGINT) AS retransmit, count(*) FILTER (WHERE tcp_window = 0) AS zero_window, count(*) AS packets FROM packets WHERE ip_proto = 6 GROUP BY 1, 2, 3) c
WHERE rst + zero_window > 0 ORDER BY issues DESC, {_KEYS} LIMIT 20""",
        "packets",
    ),
)
QUERIES["icmp_by_description"] = (
    lambda x: netops.icmp_by_description(x.icmp_errors),
    oracle("SELECT description, count(*) AS cnt, count(DISTINCT (src_ip, dst_ip)) AS pairs FROM icmp GROUP BY description", "icmp"),
)
QUERIES["icmp_pairs"] = (
    lambda x: netops.icmp_pairs(x.icmp_errors),
    oracle(
        """SELECT description, src_ip, dst_ip, cnt, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY description ORDER BY cnt DESC, src_ip, dst_ip) AS rank
FROM (SELECT description, src_ip, dst_ip, count(*) AS cnt FROM icmp GROUP BY ALL) g) r WHERE rank <= 10""",
        "icmp",
    ),
)
QUERIES["routing_loops"] = (
    lambda x: netops.routing_loops(x.icmp_errors),
    oracle(
        """SELECT notified_host, routers, messages, CASE WHEN routers >= 2 AND messages >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM (
SELECT dst_ip AS notified_host, count(DISTINCT src_ip) AS routers, count(*) AS messages FROM icmp WHERE icmp_type = 11 GROUP BY dst_ip) g
WHERE routers >= 2 OR messages >= 5""",
        "icmp",
    ),
)
QUERIES["routing_loop_sources"] = (
    lambda x: netops.routing_loop_sources(x.icmp_errors),
    oracle(
        """SELECT dst_ip AS notified_host, src_ip AS router, count(*) AS messages FROM icmp WHERE icmp_type = 11 AND dst_ip IN (
SELECT dst_ip FROM icmp WHERE icmp_type = 11 GROUP BY dst_ip HAVING count(DISTINCT src_ip) >= 2 OR count(*) >= 5) GROUP BY 1, 2""",
        "icmp",
    ),
)
QUERIES["duplicate_loops"] = (
    lambda x: joined(netops.duplicate_loops(x.loop_packets), "ttls"),
    oracle(
        """SELECT src_ip, dst_ip, proto, n AS duplicates, array_to_string(list_sort(list_distinct(t)), ',') AS ttls, list_max(t) - list_min(t) AS ttl_spread FROM (
SELECT src_ip, dst_ip, proto, count(*) AS n, list_concat(list(ttl), list(prev_ttl)) AS t FROM loops GROUP BY src_ip, dst_ip, proto) g""",
        "loops",
    ),
)
QUERIES["ttl_exceeded_share"] = (
    lambda x: netops.ttl_exceeded_share(x.icmp_errors, x.packets),
    oracle(
        """SELECT e AS expired, n AS packets, round(e / n * 100, 3) AS expired_pct, e / n * 100 > 0.1 AS elevated FROM (
SELECT (SELECT count(*) FROM icmp WHERE icmp_type = 11) AS e, (SELECT count(*) FROM packets) AS n) q""",
        "icmp",
    ),
)
QUERIES["arp_health"] = (
    lambda x: netops.arp_health(x.packets),
    oracle(
        """SELECT rq AS requests, rp AS replies, g AS gratuitous, rq + rp AS total, round(rq / rp, 1) AS request_reply_ratio, round((rq + rp) / span, 3) AS rate,
  round((rq + rp) / n * 100, 2) AS share_pct, CASE WHEN (rq + rp) / span > 100 THEN 'STORM' WHEN (rq + rp) / span > 30 THEN 'ELEVATED' ELSE 'NORMAL' END AS rate_level,
  rq / rp > 5 AS many_unanswered, (rq + rp) / n * 100 > 5 AS high_share, g > 10 AS gratuitous_flapping FROM (
SELECT count(*) FILTER (WHERE arp_op = 1) AS rq, count(*) FILTER (WHERE arp_op = 2) AS rp, count(*) FILTER (WHERE arp_op = 1 AND arp_spa = arp_tpa) AS g,
  max(ts) FILTER (WHERE arp_op IN (1, 2)) - min(ts) FILTER (WHERE arp_op IN (1, 2)) AS span, count(*) AS n FROM packets) q""",
        "packets",
    ),
)
_BY_MAC = "SELECT arp_sha, count(*) AS requests FROM packets WHERE arp_op = 1 GROUP BY arp_sha"
QUERIES["arp_requesters"] = (
    lambda x: netops.arp_requesters(x.packets).withColumn("level", F.coalesce("level", F.lit(""))),
    oracle(
        f"""SELECT arp_sha, requests, round(requests / t * 100, 1) AS share_pct, CASE WHEN requests > 100 AND requests / t * 100 > 30 THEN 'FLOOD' WHEN requests > 50 THEN 'HIGH' ELSE '' END AS level
FROM ({_BY_MAC}) m, (SELECT count(*) AS t FROM packets WHERE arp_op = 1) n ORDER BY requests DESC, arp_sha LIMIT 10""",
        "packets",
    ),
)
_CONFLICTS = "SELECT arp_spa AS ip, count(DISTINCT arp_sha) AS macs FROM packets WHERE arp_op IN (1, 2) GROUP BY arp_spa HAVING count(DISTINCT arp_sha) > 1"
QUERIES["arp_conflicts"] = (lambda x: netops.arp_conflicts(x.packets), oracle(_CONFLICTS, "packets"))
QUERIES["arp_conflict_claims"] = (
    lambda x: netops.arp_conflict_claims(x.packets),
    oracle(
        f"""SELECT DISTINCT arp_spa AS ip, arp_sha AS mac FROM packets WHERE arp_op IN (1, 2) AND arp_spa IS NOT NULL AND arp_sha IS NOT NULL
AND arp_spa IN (SELECT ip FROM ({_CONFLICTS}) c)""",
        "packets",
    ),
)
_UNANSWERED = """SELECT arp_tpa AS ip, count(*) AS requests FROM packets WHERE arp_op = 1 AND arp_tpa NOT IN (SELECT arp_spa FROM packets WHERE arp_op = 2)
GROUP BY arp_tpa HAVING count(*) >= 2"""
QUERIES["arp_unanswered"] = (lambda x: netops.arp_unanswered(x.packets), oracle(_UNANSWERED, "packets"))
_BUSY = f"""SELECT DISTINCT p.arp_sha AS mac, p.arp_spa AS ip, m.requests FROM packets p JOIN ({_BY_MAC} HAVING count(*) >= 50) m ON p.arp_sha = m.arp_sha WHERE p.arp_op IN (1, 2)"""
QUERIES["arp_claims_of_busy_macs"] = (lambda x: netops.arp_claims_of_busy_macs(x.packets), oracle(_BUSY, "packets"))
QUERIES["fragmentation"] = (
    lambda x: netops.fragmentation(x.packets),
    oracle(
        """SELECT f AS fragments, n AS packets, round(f / n * 100, 2) AS fragment_pct, f / n * 100 > 1 AS high FROM (
SELECT count(*) FILTER (WHERE frag) AS f, count(*) AS n FROM packets) q""",
        "packets",
    ),
)
QUERIES["ttl_families"] = (
    lambda x: netops.ttl_families(x.packets),
    oracle(
        """SELECT CASE WHEN ttl BETWEEN 56 AND 64 THEN 'Linux/macOS (TTL ~64)' WHEN ttl BETWEEN 120 AND 128 THEN 'Windows (TTL ~128)'
  WHEN ttl BETWEEN 250 AND 255 THEN 'Network devices (TTL ~255)' ELSE 'Other' END AS family, count(*) AS cnt,
  round(count(*) / (SELECT count(*) FROM packets) * 100, 1) AS percentage FROM packets WHERE ttl IS NOT NULL GROUP BY 1""",
        "packets",
    ),
)
QUERIES["low_ttls"] = (
    lambda x: netops.low_ttls(x.packets),
    oracle("SELECT ttl, count(*) AS cnt FROM packets WHERE ttl < 10 GROUP BY ttl", "packets"),
)
QUERIES["dns_unanswered"] = (
    lambda x: netops.dns_unanswered(x.queries, x.responses),
    oracle(
        "SELECT query, count(*) AS queries FROM dns_queries WHERE query NOT IN (SELECT query FROM dns_responses) GROUP BY query",
        "dns_queries", "dns_responses",
    ),
)
QUERIES["dns_clients"] = (
    lambda x: netops.dns_clients(x.queries),
    oracle("SELECT src_ip, count(*) AS queries FROM dns_queries GROUP BY src_ip ORDER BY queries DESC, src_ip LIMIT 10", "dns_queries"),
)
_SUM = lambda c: f"CAST(sum({c}) AS BIGINT) AS {c}"
_PART = "SELECT ip, {0} AS rst, 0 AS retransmit, {1} AS icmp_errors, {2} AS unanswered_arp, {3} AS loop_packets, {4} AS ip_conflicts, {5} AS arp_requests FROM {6}"
_SCORES = " UNION ALL ".join(
    _PART.format(*row)
    for row in (
        ("CASE WHEN tcp_flags & 4 <> 0 THEN 1 ELSE 0 END", 0, 0, 0, 0, 0, "(SELECT unnest([src_ip, dst_ip]) AS ip, tcp_flags FROM packets WHERE ip_proto = 6) a"),
        (0, 1, 0, 0, 0, 0, "(SELECT unnest([src_ip, dst_ip]) AS ip FROM icmp) b"),
        (0, 0, "requests", 0, 0, 0, f"({_UNANSWERED}) c"),
        (0, 0, 0, 1, 0, 0, "(SELECT unnest([src_ip, dst_ip]) AS ip FROM loops) d"),
        (0, 0, 0, 0, 1, 0, f"({_CONFLICTS}) e"),
        (0, 0, 0, 0, 0, "requests", f"({_BUSY}) f"),
    )
)
QUERIES["subnet_scores"] = (
    lambda x: netops.subnet_scores(x.packets, x.icmp_errors, x.loop_packets),
    oracle(
        f"""SELECT * FROM (SELECT subnet, rst * 2 + retransmit + icmp_errors * 5 + unanswered_arp + loop_packets * 10 + ip_conflicts * 50 + arp_requests // 100 AS score, rst, retransmit, icmp_errors,
  unanswered_arp, loop_packets, ip_conflicts, arp_requests, ips FROM (SELECT regexp_replace(ip, '\\.[0-9]+$', '.0/24') AS subnet, {', '.join(_SUM(c) for c in
  ('rst', 'retransmit', 'icmp_errors', 'unanswered_arp', 'loop_packets', 'ip_conflicts', 'arp_requests'))}, count(DISTINCT ip) AS ips
  FROM ({_SCORES}) u WHERE {internal('ip')} GROUP BY 1) s) t WHERE score > 0""".replace("\\\\", "\\"),
        "icmp", "loops",
    ),
)

# --- control plane ---------------------------------------------------------------------------------------------------
QUERIES["stp_summary"] = (
    lambda x: netops.stp_summary(x.control_plane),
    oracle(
        """SELECT b AS bpdus, t AS tcns, tc AS tc_flags, rb AS root_bridges, br AS bridges, round((b + t) / span, 4) AS rate, rb > 1 AS root_changed, t > 10 AS many_tcns,
  (b + t) / span > 5 AS elevated FROM (SELECT count(*) FILTER (WHERE msg_type = 'CONFIG') AS b, count(*) FILTER (WHERE msg_type = 'TCN') AS t,
  count(*) FILTER (WHERE state = 'TC') AS tc, count(DISTINCT root_bridge) AS rb, count(DISTINCT src) AS br, max(ts) - min(ts) AS span FROM control_plane WHERE protocol = 'STP') q""",
        "control_plane",
    ),
)

QUERIES["control_plane_members"] = (
    lambda x: netops.control_plane_members(x.control_plane),
    oracle(
        " UNION ALL ".join(
            f"SELECT '{p}' AS protocol, '{c}' AS kind, CAST({c} AS VARCHAR) AS value, count(*) AS messages FROM control_plane WHERE protocol = '{p}' AND {c} IS NOT NULL{more} GROUP BY {c}"
            for p, c, more in (("STP", "root_bridge", " AND msg_type = 'CONFIG'"), ("STP", "src", ""), ("OSPF", "area", ""), ("OSPF", "router_id", ""), ("EIGRP", "as_number", ""))
        ),
        "control_plane",
    ),
)


def _groups(x: Inputs, protocol: str):
    shown = joined(netops.redundancy_groups(x.control_plane, protocol), "states", "priorities", "virtual_ips")
    return shown


for _p in ("HSRP", "VRRP"):
    QUERIES[f"{_p.lower()}_groups"] = (
        lambda x, p=_p: _groups(x, p),
        oracle(
            f"""SELECT group_id, count(*) AS messages, count(DISTINCT src) AS routers,
  coalesce(array_to_string(list_sort(list(DISTINCT state) FILTER (WHERE state IS NOT NULL)), ','), '') AS states,
  coalesce(array_to_string(list_sort(list(DISTINCT priority) FILTER (WHERE priority IS NOT NULL)), ','), '') AS priorities,
  coalesce(array_to_string(list_sort(list(DISTINCT virtual_ip) FILTER (WHERE virtual_ip IS NOT NULL)), ','), '') AS virtual_ips
FROM control_plane WHERE protocol = '{_p}' GROUP BY group_id""",
            "control_plane",
        ),
    )


def _changes_sql(protocol: str, value: str) -> str:
    return oracle(
        f"""SELECT group_id, src, ts, old AS from_value, {value} AS to_value FROM (SELECT *, lag({value}) OVER (PARTITION BY group_id, src ORDER BY ts, {value}) AS old
FROM control_plane WHERE protocol = '{protocol}' AND {value} IS NOT NULL) q WHERE old <> {value}""",
        "control_plane",
    )


QUERIES["hsrp_transitions"] = (lambda x: netops.hsrp_transitions(x.control_plane), _changes_sql("HSRP", "state"))
QUERIES["vrrp_priority_changes"] = (lambda x: netops.vrrp_priority_changes(x.control_plane), _changes_sql("VRRP", "priority"))
QUERIES["ospf_summary"] = (
    lambda x: netops.ospf_summary(x.control_plane),
    oracle(
        """SELECT count(*) AS packets, count(*) FILTER (WHERE msg_type = 'Hello') AS hello, count(*) FILTER (WHERE msg_type = 'DBD') AS dbd,
  count(*) FILTER (WHERE msg_type = 'LSRequest') AS ls_request, count(*) FILTER (WHERE msg_type = 'LSUpdate') AS ls_update, count(*) FILTER (WHERE msg_type = 'LSAck') AS ls_ack,
  count(DISTINCT area) AS areas, count(DISTINCT router_id) AS router_ids FROM control_plane WHERE protocol = 'OSPF'""",
        "control_plane",
    ),
)
QUERIES["ospf_neighbor_gaps"] = (
    lambda x: netops.ospf_neighbor_gaps(x.control_plane),
    oracle(
        """SELECT capture, ip_a, ip_b, round(max(gap), 1) AS max_gap, count(*) AS hellos, max(gap) > 120 AS dead FROM (
SELECT *, ts - lag(ts) OVER (PARTITION BY capture, ip_a, ip_b ORDER BY ts) AS gap FROM (SELECT capture, least(src, dst) AS ip_a, greatest(src, dst) AS ip_b, ts
  FROM control_plane WHERE protocol = 'OSPF' AND msg_type = 'Hello') h) g GROUP BY capture, ip_a, ip_b HAVING max(gap) > 40""",
        "control_plane",
    ),
)
_BURSTS = """SELECT capture, ts AS burst_start, span, CASE WHEN span > 0 THEN 10 / span ELSE 999 END AS rate FROM (SELECT capture, ts, lead(ts, 10) OVER (PARTITION BY capture ORDER BY ts) - ts AS span
FROM control_plane WHERE protocol = 'OSPF' AND msg_type = 'LSUpdate') q WHERE span <= 5"""
QUERIES["ospf_update_bursts"] = (lambda x: netops.ospf_update_bursts(x.control_plane), oracle(_BURSTS, "control_plane"))
QUERIES["ospf_burst_summary"] = (
    lambda x: netops.ospf_burst_summary(x.control_plane),
    oracle(f"SELECT count(*) AS bursts, round(max(rate), 1) AS peak_rate FROM ({_BURSTS}) b", "control_plane"),
)
QUERIES["eigrp_summary"] = (
    lambda x: netops.eigrp_summary(x.control_plane),
    oracle(
        """SELECT *, query > 20 AS many_queries, hello > 0 AND "update" > hello * 0.1 AS topology_changing FROM (SELECT count(*) AS packets,
  count(*) FILTER (WHERE msg_type = 'Hello') AS hello, count(*) FILTER (WHERE msg_type = 'Update') AS "update", count(*) FILTER (WHERE msg_type = 'Query') AS query,
  count(*) FILTER (WHERE msg_type = 'Reply') AS reply, count(DISTINCT as_number) AS as_numbers FROM control_plane WHERE protocol = 'EIGRP') q""",
        "control_plane",
    ),
)

# --- Zeek logs, as JSON text made from the flows -------------------------------------------------------------------------


def _zeek_lines(x: Inputs, log: str):
    """JSON log lines of one type from the flow views, one a row."""
    ends = [
        F.col("src_ip").alias("id.orig_h"), F.lit(51000).alias("id.orig_p"), F.col("dst_ip").alias("id.resp_h"),
        F.coalesce(F.col("dst_port"), F.lit(53)).alias("id.resp_p") if log != "dns" else F.lit(53).alias("id.resp_p"),
    ]
    if log == "conn":
        df = x.connections
        more = [
            F.col("ts").alias("ts"), F.lower("proto").alias("proto"), F.col("service").alias("service"), F.col("duration").alias("duration"),
            F.when(F.col("packets") % 3 == 0, F.lit(0)).otherwise(F.col("bytes_out")).alias("orig_bytes"),
            (F.col("bytes_out") + 40).alias("orig_ip_bytes"), F.col("bytes_in").alias("resp_bytes"),
            F.col("packets").alias("orig_pkts"), F.lit(2).alias("resp_pkts"), F.col("conn_state").alias("conn_state"),
        ]
    elif log == "dns":
        df = x.responses.select(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), "ts", "query", "qtype", "answer", "rcode")
        more = [
            F.date_format(F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
            F.col("query").alias("query"), F.col("qtype").alias("qtype_name"),
            F.array(F.col("answer"), F.concat(F.lit("alias."), "query")).alias("answers"), F.col("rcode").alias("rcode_name"),
        ]
    else:
        df = x.handshakes
        more = [F.col("ts").alias("ts"), F.col("sni").alias("server_name"), F.lit("TLSv12").alias("version")]
    return df.select(F.to_json(F.struct(*ends, *more)).alias("line"))


QUERIES["zeek_connections"] = (
    lambda x: zeek.connections(zeek.parse_json_lines(_zeek_lines(x, "conn"), "conn")).select(
        "ts", "src_ip", "dst_ip", F.coalesce("dst_port", F.lit(0)).alias("dst_port"), "proto", "packets", "bytes_out", "bytes_in"
    ),
    oracle(
        """SELECT ts, src_ip, dst_ip, dst_port, proto, packets + 2 AS packets, CASE WHEN packets % 3 = 0 OR bytes_out = 0 THEN bytes_out + 40 ELSE bytes_out END AS bytes_out,
  bytes_in FROM connections""",
        "connections",
    ),
)
QUERIES["zeek_ot_services"] = (
    lambda x: zeek.ot_services(zeek.parse_json_lines(_zeek_lines(x, "conn"), "conn")).select("ts", "src_ip", "dst_ip", "protocol"),
    oracle(
        "SELECT ts, src_ip, dst_ip, upper(service) AS protocol FROM connections WHERE service IN "
        + "(" + ", ".join(f"'{s}'" for s in fv.OT_SERVICES) + ")",
        "connections",
    ),
)
QUERIES["zeek_dns_responses"] = (
    lambda x: zeek.dns_responses(zeek.parse_json_lines(_zeek_lines(x, "dns"), "dns")).select(
        F.round("ts", 6).alias("ts"), "src_ip", "dst_ip", "query", "qtype", "answer", "rcode"
    ),
    oracle(
        """SELECT round(ts, 6) AS ts, src_ip, dst_ip, query, qtype, unnest([answer, concat('alias.', query)]) AS answer, rcode FROM dns_responses""",
        "dns_responses",
    ),
)
QUERIES["zeek_tls_handshakes"] = (
    lambda x: zeek.tls_handshakes(zeek.parse_json_lines(_zeek_lines(x, "ssl"), "ssl")).select(
        "ts", "src_ip", "dst_ip", "dst_port", F.coalesce("sni", F.lit("")).alias("sni"), "version"
    ),
    oracle("SELECT ts, src_ip, dst_ip, dst_port, coalesce(sni, '') AS sni, 'TLSv12' AS version FROM tls_handshakes", "tls_handshakes"),
)
QUERIES["zeek_dns_queries"] = (
    lambda x: zeek.dns_queries(zeek.parse_json_lines(_zeek_lines(x, "dns"), "dns")).select(F.round("ts", 6).alias("ts"), "src_ip", "dst_ip", "query", "qtype"),
    oracle("SELECT round(ts, 6) AS ts, dst_ip AS src_ip, src_ip AS dst_ip, query, qtype FROM dns_responses", "dns_responses"),
)


def _page_lines(x: Inputs, log: str):
    """JSON lines of http, notice and weird logs, one per request."""
    rows = x.requests.select(
        "ts", F.col("src_ip").alias("id.orig_h"), F.lit(40000).alias("id.orig_p"), F.col("dst_ip").alias("id.resp_h"), F.lit(80).alias("id.resp_p"),
        "method", "host", F.col("path").alias("uri"),
    )
    more = {
        "http": ["method", "host", "uri", F.lit(404).alias("status_code"), F.array(F.lit("text/html"), F.lit("x")).alias("resp_mime_types"), F.lit(7).alias("request_body_len")],
        "notice": [F.when(F.col("method") == "GET", "FTP::Cleartext").when(F.col("method") == "PUT", "Scan::Port").otherwise("SSH::Password_Guessing").alias("note"),
                   F.when(F.col("method") == "POST", F.col("`id.orig_h`")).alias("src"), F.col("host").alias("sub")],
        "weird": [F.concat(F.lit("odd_"), "method").alias("name"), F.when(F.col("method") == "PUT", F.lit("")).otherwise(F.col("uri")).alias("addl")],
    }
    return rows.select(F.to_json(F.struct("ts", "`id.orig_h`", "`id.orig_p`", "`id.resp_h`", "`id.resp_p`", *more[log])).alias("line"))


QUERIES["zeek_http_requests"] = (
    lambda x: zeek.http_requests(zeek.parse_json_lines(_page_lines(x, "http"), "http")).select(
        "ts", "src_ip", "dst_ip", "method", "host", "path", "status_code", "content_type", "request_len", "response_len"),
    oracle(
        """SELECT ts, src_ip, dst_ip, method, host, nullif(path, '') AS path, 404 AS status_code, 'text/html' AS content_type,
  CAST(7 AS BIGINT) AS request_len, CAST(0 AS BIGINT) AS response_len FROM http_requests""",
        "http_requests",
    ),
)
QUERIES["zeek_cleartext_notices"] = (
    lambda x: zeek.cleartext_creds(zeek.parse_json_lines(_page_lines(x, "notice"), "notice")).select("ts", "src_ip", "dst_ip", "protocol", "description"),
    oracle(
        """SELECT ts, src_ip, dst_ip, CASE WHEN method = 'GET' THEN 'FTP::Cleartext' ELSE 'SSH::Password_Guessing' END AS protocol, host AS description
FROM http_requests WHERE method <> 'PUT'""",
        "http_requests",
    ),
)
QUERIES["zeek_weird_events"] = (
    lambda x: zeek.weird_events(zeek.parse_json_lines(_page_lines(x, "weird"), "weird")).select("ts", "src_ip", "dst_ip", "name", F.coalesce("addl", F.lit("")).alias("addl")),
    oracle("SELECT ts, src_ip, dst_ip, concat('odd_', method) AS name, CASE WHEN method = 'PUT' THEN '' ELSE path END AS addl FROM http_requests", "http_requests"),
)
