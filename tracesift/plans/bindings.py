"""Security-event views of the driver's tables.

The given tables hold no network data, so every canonical table is a plain
projection of one of them: one output row per input row, values by arithmetic.
``VIEWS`` is the SQL text, valid in Spark and in DuckDB alike; ``Inputs`` runs
it on Spark, ``oracle_sql.oracle`` puts it in front of an oracle query.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.operators import flows
from tracesift.operators.ranking import evaluated_once
from tracesift.schemas import TrafficTables, conform
from tracesift.sources import packets as pk
from tracesift.sources.lines import text_lines

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Long expressions that filters test several times. A stored table would hold
# them; here they are made once a row and not copied into every filter.
_STORED = {
    "access_lines": ("line",), "iptables_lines": ("line",), "fortinet_lines": ("line",), "paloalto_lines": ("line",),
    "csv_lines": ("line",), "headed_csv_lines": ("line",), "connections": ("src_ip", "dst_ip", "dst_port"), "dns_queries": ("query",), "dns_responses": ("query",),
}

# MICROS(x) is the only dialect-dependent call: microseconds since the epoch
_DIALECT = {
    "spark": lambda arg: f"unix_micros(CAST({arg} AS TIMESTAMP))",
    "duckdb": lambda arg: f"epoch_us({arg})",
}

_TACTICS = (
    "Initial Access,Execution,Persistence,Privilege Escalation,Defense Evasion,Credential Access,Discovery,"
    "Lateral Movement,Collection,Command and Control,Exfiltration,Impact,Reconnaissance,Resource Development"
)
_STAGES = (
    "Initial Access,Execution,Persistence,Privilege Escalation,Defense Evasion,Credential Access,Discovery,"
    "Lateral Movement,Collection,Command and Control,Exfiltration,Impact/Action on Objective"
)


def _pick(values: str, index: str) -> str:
    """The list element at a 0-based index, modulo the list's length."""
    count = values.count(",") + 1
    return f"split_part('{values}', ',', CAST(({index}) % {count} + 1 AS INT))"


def _whole(quotient: str) -> str:
    return f"CAST(floor({quotient}) AS BIGINT)"


_HOST = f"concat('10.0.', {_whole('user_id / 100')}, '.', user_id % 100 + 1)"
_Q = _whole("event_id / 10")
_SEQ = _whole("event_id / 50")
_PAIR = f"({_Q} % 5)"

VIEWS: dict[str, str] = {}

# --- logs --------------------------------------------------------------------------------
VIEWS["access_lines"] = f"""
SELECT concat('access-', user_id % 3) AS file_path, event_id + 1 AS line_no,
  CASE event_type
    WHEN 'error' THEN concat('2024-01-', {_pick('01,02,03', 'event_id')}, ' 08:', {_pick('15,30,45', 'event_id')},
      ':02 ERROR user=', {_pick('root,admin,guest,svc', 'user_id')}, ' login failed from ', {_HOST}, ' code 0x', {_pick('1f,2a,ff', 'event_id')})
    WHEN 'signup' THEN concat({_HOST}, ' - - [05/Jan/2024:10:', {_pick('00,10,20', 'event_id')}, ':00 +0000] "POST /signup?id=', event_id,
      ' HTTP/1.1" ', {_pick('200,302,403,500', 'event_id')}, ' ', {_whole('value * 10')}, ' ')
    WHEN 'purchase' THEN concat({_HOST}, ' - - [06/Jan/2024:11:', {_pick('00,10,20', 'event_id')}, ':00 +0000] "GET /buy?q=1 UNION ALL SELECT ', user_id % 7,
      ' HTTP/1.1" ', {_pick('200,404', 'event_id')}, ' ', {_whole('value * 10')}, ' ')
    WHEN 'view' THEN concat({_HOST}, ' - - [07/Jan/2024:12:', {_pick('00,10,20', 'event_id')}, ':00 +0000] "GET /item/', event_id % 40,
      '?t=<script>x HTTP/1.1" ', {_pick('200,304,401', 'event_id')}, ' ', {_whole('value * 10')}, ' ')
    ELSE concat({_HOST}, ' "', {_pick('GET,TRACE,PROPFIND,PUT', 'event_id')}, ' /c/', event_id % 9, '" ',
      {_pick('200,204', 'event_id')}, ' user: u', user_id % 11, ' port :', event_id % 300, ' done')
  END AS line
FROM {{events}}"""

# --- flows ------------------------------------------------------------------------------
VIEWS["connections"] = f"""
SELECT concat('cap-', event_id % 4) AS capture,
  CASE WHEN event_id % 10 = 3 THEN 1704067200e0 + {_SEQ} * 60 +
    CASE {_PAIR} WHEN 0 THEN 0e0 WHEN 1 THEN ({_SEQ} % 3) * 1e0 WHEN 2 THEN ({_SEQ} % 3) * 4e0
      WHEN 3 THEN ({_SEQ} % 2) * 15e0 ELSE ({_SEQ} % 3) * 5.5e0 END
    ELSE MICROS(ts) / 1e6 END AS ts,
  CASE WHEN event_id % 10 = 2 THEN concat('203.0.113.', {_Q} % 50 + 1)
    WHEN event_id % 10 = 3 THEN concat('10.0.9.', {_PAIR} + 1)
    WHEN event_id % 10 = 4 THEN concat('10.0.0.', user_id % 10 + 1)
    WHEN event_id % 10 = 5 THEN concat('10.0.5.', user_id % 5 + 1)
    WHEN event_id % 10 = 6 THEN {_pick('203.0.113.200,10.0.5.77', _Q)}
    WHEN event_id % 10 = 9 AND {_Q} % 9 = 0 THEN {_pick('fe80::1,not-an-ip,10.0.0.01,172.32.0.1', _Q)}
    ELSE {_HOST} END AS src_ip,
  CAST(40000 + event_id % 20000 AS INT) AS src_port,
  CASE WHEN event_id % 10 <= 1 THEN concat('203.0.113.', {_Q} % 50 + 1)
    WHEN event_id % 10 = 2 THEN {_HOST}
    WHEN event_id % 10 = 3 THEN concat('198.51.100.', {_PAIR} + 1)
    WHEN event_id % 10 = 4 THEN concat('192.168.1.', {_Q} % 17 + 1)
    WHEN event_id % 10 = 5 THEN concat('172.16.3.', {_Q} % 9 + 1)
    WHEN event_id % 10 = 6 THEN {_pick('172.16.3.4,203.0.113.201', _Q)}
    WHEN event_id % 10 = 7 THEN concat('198.51.100.', user_id % 60 + 1)
    WHEN event_id % 10 = 8 THEN '10.0.0.53'
    ELSE concat('192.168.', {_Q} % 4, '.', user_id % 30 + 1) END AS dst_ip,
  CAST(CASE WHEN event_id % 10 <= 2 THEN {_pick('443,80,8080,8443,22', _Q)}
    WHEN event_id % 10 = 3 THEN {_pick('443,8443,4444,53,80', _PAIR)}
    WHEN event_id % 10 = 4 THEN {_pick('22,23,135,139,445,3389,5985,5986', _Q)}
    WHEN event_id % 10 = 5 THEN {_pick('502,102,20000,44818,4840,47808,2404,789', _Q)}
    WHEN event_id % 10 = 6 THEN {_pick('502,102,20000', _Q)}
    WHEN event_id % 10 = 7 AND {_Q} % 3 = 0 THEN {_pick('4444,8888,6667,31337,1080', _Q)}
    WHEN event_id % 10 = 8 THEN '53'
    WHEN event_id % 10 = 9 AND {_Q} % 7 = 0 THEN '0'
    ELSE CAST(1025 + {_Q} % 400 * 3 AS STRING) END AS INT) AS dst_port,
  CASE WHEN event_id % 10 = 8 THEN 'UDP' WHEN event_id % 10 = 9 AND {_Q} % 7 = 0 THEN 'ICMP' ELSE 'TCP' END AS proto,
  CASE WHEN event_id % 10 = 5 THEN {_pick('modbus,s7comm,dnp3,enip', _Q)} WHEN event_id % 10 = 8 THEN 'dns' END AS service,
  event_id % 20 + 1 AS packets,
  CASE WHEN event_id % 10 <= 1 THEN {_whole('value * 100000')} ELSE {_whole('value * 1000')} END AS bytes_out,
  CASE WHEN event_id % 10 = 0 THEN {_whole('value * 10')} ELSE CAST(0 AS BIGINT) END AS bytes_in,
  value AS duration,
  {_pick('SF,S0,REJ', 'event_id')} AS conn_state
FROM {{events}}"""

VIEWS["dns_queries"] = f"""
SELECT concat('cap-', event_id % 4) AS capture, MICROS(ts) / 1e6 AS ts, {_HOST} AS src_ip, '10.0.0.53' AS dst_ip,
  CASE event_type
    WHEN 'view' THEN concat(substr(md5(CAST(event_id AS STRING)), 1, CAST(8 + event_id % 14 AS INT)), '.t', event_id % 3, '.com')
    WHEN 'click' THEN concat('WWW.site', user_id % 5, '.com')
    WHEN 'purchase' THEN concat('shop.store', user_id % 3, '.net')
    WHEN 'signup' THEN concat('n', event_id % 40, '.evil-corp', user_id % 4, '.com')
    ELSE concat('nx', user_id, '.missing.org') END AS query,
  {_pick('A,AAAA,TXT,A,16,MX', 'event_id')} AS qtype
FROM {{events}}"""
VIEWS["dns_responses"] = f"""
SELECT concat('cap-', event_id % 4) AS capture, MICROS(ts) / 1e6 AS ts, '10.0.0.53' AS src_ip, {_HOST} AS dst_ip,
  CASE event_type
    WHEN 'view' THEN concat(substr(md5(CAST(event_id AS STRING)), 1, CAST(8 + event_id % 14 AS INT)), '.t', event_id % 3, '.com')
    WHEN 'click' THEN concat('WWW.site', user_id % 5, '.com')
    WHEN 'purchase' THEN concat('shop.store', user_id % 3, '.net')
    ELSE concat('n', event_id % 40, '.evil-corp', user_id % 4, '.com') END AS query,
  {_pick('A,AAAA,TXT,A,16,MX', 'event_id')} AS qtype,
  concat('203.0.113.', event_id % 90 + 1) AS answer, 'NOERROR' AS rcode
FROM {{events}}"""

VIEWS["http_requests"] = f"""
SELECT concat('cap-', page_id % 4) AS capture, 1704067200e0 + page_id * 2 AS ts,
  concat('10.0.0.', page_id % 90 + 1) AS src_ip, concat('203.0.113.', page_id % 50 + 1) AS dst_ip,
  {_pick('GET,POST,PUT,HEAD', 'page_id')} AS method,
  regexp_extract(url, '^https?://([^/]+)', 1) AS host,
  regexp_extract(url, '^https?://[^/]+(/[^#]*)', 1) AS path
FROM {{pages}}"""

VIEWS["tls_handshakes"] = f"""
SELECT concat('cap-', o_orderkey % 4) AS capture, MICROS(o_orderdate) / 1e6 + o_orderkey % 86400 AS ts,
  concat('10.0.', {_whole('o_custkey / 200')}, '.', o_custkey % 200 + 1) AS src_ip,
  concat('203.0.113.', o_orderkey % 50 + 1) AS dst_ip,
  CAST({_pick('443,8443', 'o_orderkey')} AS INT) AS dst_port,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '5-LOW' THEN concat('cdn', o_custkey % 30, '.evil-corp1.com')
    ELSE concat('host', o_custkey % 60, '.example.net') END AS sni
FROM {{orders}}"""

# --- firewall ------------------------------------------------------------------------------
_LINE_NO = "(l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey"
_FW_SRC = "concat('10.', l_suppkey % 3, '.0.', l_suppkey % 25 + 1)"
_FW_DST = "concat('192.168.', l_partkey % 2, '.', l_partkey % 40 + 1)"
_FW_PORT = "(l_orderkey % 60 * 17 + l_linenumber)"
_FW_TIME = f"concat({_pick('Jan,Feb,Mar', 'l_orderkey')}, '  ', l_linenumber, ' 10:', {_pick('05,25,45', 'l_partkey')}, ':00')"
VIEWS["fw_entries"] = f"""
SELECT concat('fw-', l_suppkey % 8) AS file_path, {_LINE_NO} AS line_no, {_FW_TIME} AS timestamp,
  l_shipdate AS event_time, {_FW_SRC} AS src_ip, {_FW_DST} AS dst_ip,
  CAST(1024 + l_partkey % 5000 AS INT) AS src_port,
  CAST(CASE WHEN l_linenumber = 6 THEN NULL ELSE {_FW_PORT} END AS INT) AS dst_port,
  CASE WHEN l_linenumber = 6 THEN 'ICMP' WHEN l_linenumber = 5 THEN 'UDP' ELSE 'TCP' END AS protocol,
  CASE WHEN l_returnflag = 'R' THEN 'deny' ELSE 'allow' END AS action,
  CAST(l_quantity * 100 AS BIGINT) AS bytes_sent, CAST(l_quantity * 7 AS BIGINT) AS bytes_recv
FROM {{lineitem}}"""
VIEWS["iptables_lines"] = f"""
SELECT concat('fw-', l_suppkey % 8) AS file_path, {_LINE_NO} AS line_no,
  CASE WHEN l_linenumber = 7 THEN concat('fw kernel: link up ', l_partkey)
    ELSE concat({_FW_TIME}, ' gw kernel: [UFW ', {_pick('DROP,ACCEPT,REJECT,LOG', 'l_suppkey')}, '] IN=',
      CASE WHEN l_tax > 0.05 THEN '' ELSE 'eth0' END, ' OUT=eth1 MAC=aa:bb SRC=', {_FW_SRC}, ' DST=', {_FW_DST}, ' LEN=60 TTL=64 PROTO=',
      CASE WHEN l_linenumber = 6 THEN 'ICMP TYPE=8' ELSE concat('tcp SPT=', 1024 + l_partkey % 5000, ' DPT=', {_FW_PORT}) END, ' ')
  END AS line
FROM {{lineitem}}"""
VIEWS["fortinet_lines"] = f"""
SELECT concat('fg-', l_suppkey % 8) AS file_path, {_LINE_NO} AS line_no,
  CASE WHEN l_linenumber = 7 THEN concat('devname=fg1 msg="status report" id=', l_partkey)
    ELSE concat('date=2024-01-0', l_linenumber, ' time=10:', {_pick('05,25', 'l_partkey')}, ':00 devname="FG 1" type=traffic ',
      CASE WHEN l_tax > 0.05 THEN 'src' ELSE 'srcip' END, '=', {_FW_SRC}, ' dstip=', {_FW_DST}, ' srcport=',
      CASE WHEN l_quantity = 1 THEN 'n/a' ELSE CAST(1024 + l_partkey % 5000 AS STRING) END, ' dstport=', {_FW_PORT},
      ' proto="6" action=', {_pick('deny,accept,"blocked",close', 'l_suppkey')}, ' sentbyte=', CAST(l_quantity * 100 AS BIGINT),
      ' rcvdbyte=', CAST(l_quantity * 7 AS BIGINT), ' policyid=', l_suppkey % 5, ' srcintf="port ', l_suppkey % 3, '" proto=17')
  END AS line
FROM {{lineitem}}"""
VIEWS["csv_lines"] = f"""
SELECT concat('csv-', l_suppkey % 8) AS file_path, {_LINE_NO} AS line_no,
  concat('2024-01-0', l_linenumber, ' 10:00:00,', {_FW_SRC}, ',', 1024 + l_partkey % 5000, ',', {_FW_DST}, ',',
    CASE WHEN l_quantity = 1 THEN 'bad' WHEN l_linenumber = 6 THEN '' ELSE CAST({_FW_PORT} AS STRING) END, ',TCP,',
    {_pick('"Denied, rule 4",Allow,Blocked by policy,Permit', 'l_suppkey').replace('"Denied, rule 4"', '"Denied; rule 4"')}) AS line
FROM {{lineitem}}"""
_CSV_PORT = f"CASE WHEN l_quantity = 1 THEN 'bad' WHEN l_linenumber = 6 THEN '' ELSE CAST({_FW_PORT} AS STRING) END"
_CSV_ACTION = _pick('"Denied; ""rule"" 4",Allow,Blocked by policy,Permit', "l_partkey")
VIEWS["headed_csv_lines"] = f"""
SELECT concat('hcsv-', l_suppkey % 8) AS file_path, {_LINE_NO} AS line_no,
  CASE WHEN l_suppkey % 2 = 0
    THEN concat('2024-01-0', l_linenumber, ' 10:00:00,', {_FW_SRC}, ',', 1024 + l_partkey % 5000, ',', {_FW_DST}, ',', {_CSV_PORT}, ',TCP,', {_CSV_ACTION})
    ELSE concat({_CSV_ACTION}, ',', {_FW_DST}, ',', {_CSV_PORT}, ',', 1024 + l_partkey % 5000, ',', {_FW_SRC}, ',UDP,2024-01-0', l_linenumber, ' 11:00:00') END AS line
FROM {{lineitem}}
UNION ALL
SELECT DISTINCT concat('hcsv-', l_suppkey % 8), CAST(1 AS BIGINT),
  CASE WHEN l_suppkey % 2 = 0 THEN 'date,src-ip,src-port,dst-ip,dst-port,proto,action' ELSE 'Status,Dest IP,Dest Port,Src Port,Src IP,Protocol,Event Time' END
FROM {{lineitem}}"""
VIEWS["paloalto_lines"] = f"""
SELECT concat('pa-', l_suppkey % 8) AS file_path, {_LINE_NO} AS line_no,
  concat('1,2024/01/0', l_linenumber, ' 10:00:00,S1,TRAFFIC,end,x,y,', {_FW_SRC}, ',', {_FW_DST}, ',n1,n2,n3,"rule, ', l_suppkey % 5,
    '",u,v,app,vs,z1,z2,i1,i2,lf,d,1,', CASE WHEN l_quantity = 1 THEN 'bad' ELSE CAST(1024 + l_partkey % 5000 AS STRING) END, ',',
    CASE WHEN l_linenumber = 6 THEN '' ELSE CAST({_FW_PORT} AS STRING) END, ',0,0,0x0,tcp,', {_pick('deny,allow,drop,reset-both', 'l_suppkey')}, ',',
    CAST(l_quantity * 100 AS BIGINT), ',', CAST(l_quantity * 7 AS BIGINT), CASE WHEN l_linenumber = 7 THEN ',1' ELSE ',1,2,3' END) AS line
FROM {{lineitem}}"""

# --- DNS and TLS payloads ------------------------------------------------------------------


def _labels(name: str) -> str:
    return "".join(f"{len(x):02X}{x.encode().hex().upper()}" for x in name.split("."))


def _dns(flags: str, name: str, kind: int, *answers: str, tail: str = "00") -> str:
    return f"1234{flags}0001{len(answers):04X}00000000{_labels(name)}{tail}{kind:04X}0001{''.join(answers)}"


def _answer(kind: int, data: str) -> str:
    return f"C00C{kind:04X}00010000003C{len(data) // 2:04X}{data}"


#: Payload, and what it means: kind, query, type, answer, code.
DNS_CASES = (
    (_dns("0100", "www.example.com", 1), "query", "www.example.com", "1", None, None),
    (_dns("0100", "a.b.test", 16), "query", "a.b.test", "16", None, None),
    (_dns("8180", "www.example.com", 1, _answer(1, "CB007107"), _answer(1, "CB007108")), "response", "www.example.com", "1", "203.0.113.7", "NOERROR"),
    (_dns("8180", "cdn.example.com", 5, _answer(5, "0465646765C010")), "response", "cdn.example.com", "5", "edge.example.com.", "NOERROR"),
    (_dns("8180", "v6.test", 28, _answer(28, "20010DB8000000000000000000000001")), "response", "v6.test", "28", "2001:db8::1", "NOERROR"),
    (_dns("8180", "t.test", 16, _answer(16, "0B763D73706631202D616C6C")), "response", "t.test", "16", "v=spf1 -all", "NOERROR"),
    (_dns("8183", "gone.test", 1), "no_answer", "gone.test", "1", None, "NXDOMAIN"),
    (_dns("0100", "loop.test", 1, tail="C00C"), "malformed", None, None, None, None),
    ("12340100000100000000000003777777C00C00010001", "malformed", None, None, None, None),
    ("1234010000010000", "malformed", None, None, None, None),
    (_dns("0100", "cut.test", 1)[:-14], "malformed", None, None, None, None),
    (_dns("8180", "short.test", 1, _answer(1, "CB007107"))[:-4], "malformed", None, None, None, None),
)


def _hello(*extensions: str, session: str = "", cut: int = 0) -> str:
    tail = "".join(extensions)
    body = f"0303{'AB' * 32}{len(session) // 2:02X}{session}0004130113020100" + (f"{len(tail) // 2:04X}{tail}" if extensions else "")
    message = f"01{len(body) // 2:06X}{body}"
    whole = f"160301{len(message) // 2:04X}{message}"
    return whole[: len(whole) - 2 * cut]


def _named(name: str) -> str:
    data = name.encode().hex().upper()
    n = len(name)
    return f"0000{n + 5:04X}{n + 3:04X}00{n:04X}{data}"


#: Payload, and what it means: whether it is a ClientHello, its name, and whether it is malformed.
TLS_CASES = (
    (_hello(_named("host7.example.net")), True, "host7.example.net", False),
    (_hello("000A00040002001D", "FF01000100", _named("cdn3.evil-corp1.com"), session="CD" * 32), True, "cdn3.evil-corp1.com", False),
    (_hello("000A00040002001D"), True, None, False),
    (_hello(), True, None, False),
    (_hello(_named("cut.example.net"), cut=4), True, None, True),
    (_hello(_named("early.example.net"), "000A00040002001D", cut=3), True, "early.example.net", True),
    (_hello(session="CD" * 32, cut=20), True, None, True),
    ("16030300040E000000", False, None, False),
)

# --- packets ---------------------------------------------------------------------------------
_PORTS = "502,102,20000,21,80,443,161,23,25,53,5900,47808"
_SERVICE = "service"
VIEWS["packets"] = f"""
SELECT concat('cap-', l_orderkey % 3) AS capture, {_LINE_NO} AS pkt_no,
  1704067200e0 + (l_orderkey * 8 + l_linenumber) * 0.25e0 AS ts,
  CAST(60 + l_quantity * 10 AS INT) AS frame_len,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('10.0.', l_suppkey % 4, '.', l_suppkey % 20 + 1) END AS src_ip,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' THEN concat('203.0.113.', l_partkey % 12 + 1)
    ELSE concat('192.168.', l_partkey % 3, '.', l_partkey % 12 + 1) END AS dst_ip,
  CAST(CASE WHEN l_linenumber <= 4 THEN 6 WHEN l_linenumber = 5 THEN 17 WHEN l_linenumber = 6 THEN 1 END AS INT) AS ip_proto,
  CAST(CASE WHEN l_linenumber < 7 THEN l_orderkey % 7 END AS INT) AS ip_id,
  CAST(CASE WHEN l_linenumber < 7 THEN {_pick('9,56,64,128,255,63,32,5', 'CAST(l_quantity AS BIGINT)')} END AS INT) AS ttl,
  l_tax > 0.07 AND l_linenumber < 7 AS frag,
  CAST(CASE WHEN l_linenumber > 5 THEN NULL WHEN l_linestatus = 'F' THEN {_SERVICE} ELSE CAST(40000 + l_orderkey % 1000 AS STRING) END AS INT) AS src_port,
  CAST(CASE WHEN l_linenumber > 5 THEN NULL WHEN l_linestatus = 'F' THEN CAST(40000 + l_orderkey % 50 AS STRING) ELSE {_SERVICE} END AS INT) AS dst_port,
  CAST(CASE WHEN l_linenumber <= 4 THEN CAST(l_quantity AS INT) % 32 END AS INT) AS tcp_flags,
  CAST(CASE WHEN l_linenumber <= 4 THEN CASE WHEN l_quantity = 13 THEN 0 ELSE 1024 END END AS INT) AS tcp_window,
  CAST(CASE WHEN l_linenumber = 6 THEN {_pick('3,5,11,8,11', 'l_suppkey')} END AS INT) AS icmp_type,
  CAST(CASE WHEN l_linenumber = 6 THEN {_pick('0,1,3,13', 'l_partkey')} END AS INT) AS icmp_code,
  CAST(CASE WHEN l_linenumber = 7 THEN CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END END AS INT) AS arp_op,
  CASE WHEN l_linenumber = 7 THEN concat('10.0.1.', l_suppkey % 15 + 1) END AS arp_spa,
  CASE WHEN l_linenumber = 7 THEN concat('10.0.1.', l_partkey % 30 + 1) END AS arp_tpa,
  CASE WHEN l_linenumber = 7 THEN concat('aa:bb:cc:00:00:1', (l_suppkey + CASE WHEN l_orderkey % 40 = 0 THEN 1 ELSE 0 END) % 5) END AS arp_sha,
  CASE WHEN l_linenumber > 5 THEN NULL
    WHEN {_SERVICE} = '502' THEN concat('000100000006', {_pick('01,02,03,11', 'l_suppkey')}, {_pick('01,03,05,06,0F,10,2B,08,83,90,63', 'l_orderkey')}, '020A')
    WHEN {_SERVICE} = '102' THEN concat('0300001902F08032', {_pick('01,03,07,02,09', 'l_suppkey')}, '0000000000', {_pick('04,05,28,29,1A,1B,F0', 'l_orderkey')}, '0001')
    WHEN {_SERVICE} = '20000' THEN concat('056405C401000A0000000000C0', {_pick('00,01,02,05,0D,12,81,63', 'l_orderkey')})
    WHEN {_SERVICE} = '21' THEN {_pick(','.join(t.encode().hex().upper() for t in ('USER bob', 'pass x1', '220 ready', 'QUIT')), 'l_orderkey')}
    WHEN {_SERVICE} = '80' THEN {_pick(','.join(t.encode().hex().upper() for t in (
        'GET /a?x=1 HTTP/1.1\r\nHost: web.example.com\r\nAuthorization: Basic Zm9v\r\n\r\n',
        'POST /login HTTP/1.1\r\nhost: app.test\r\n\r\nusername=a&password=b', 'HTTP/1.1 200 OK\r\n\r\n',
        'PUT /f HTTP/1.1\r\n\r\n', 'DELETE /g HTTP/1.1\r\nHOST:  d.test \r\n\r\n')), 'l_orderkey')}
    WHEN {_SERVICE} = '23' THEN {_pick(','.join(t.encode().hex().upper() for t in ('host Login: ', 'ls -la')), 'l_orderkey')}
    WHEN {_SERVICE} = '25' THEN {_pick(','.join(t.encode().hex().upper() for t in ('AUTH LOGIN', 'EHLO example')), 'l_orderkey')}
    WHEN {_SERVICE} = '53' AND l_linenumber = 5 THEN {_pick(','.join(c[0] for c in DNS_CASES), 'l_orderkey')}
    WHEN {_SERVICE} = '443' AND l_linenumber <= 4 THEN {_pick(','.join(c[0] for c in TLS_CASES), 'l_orderkey')}
    WHEN {_SERVICE} = '161' THEN {_pick('302601,3026010104', 'l_orderkey')}
    ELSE '0102030405' END AS payload_hex
FROM (SELECT *, {_pick(_PORTS, 'l_partkey')} AS service FROM {{lineitem}}) l"""

VIEWS["control_plane"] = f"""
SELECT concat('cap-', o_custkey % 2) AS capture,
  CASE WHEN o_orderkey % 5 = 3 AND o_custkey % 4 = 1
    THEN 1704067200e0 + {_whole('o_orderkey / 400')} * 600 + (o_orderkey % 400) * 0.015625e0
    ELSE 1704067200e0 + o_orderkey * 1.5e0 END AS ts,
  {_pick('STP,HSRP,VRRP,OSPF,EIGRP', 'o_orderkey')} AS protocol,
  CASE o_orderkey % 5 WHEN 0 THEN {_pick('CONFIG,CONFIG,CONFIG,TCN', 'o_custkey')} WHEN 1 THEN 'Hello' WHEN 2 THEN 'Advertisement'
    WHEN 3 THEN {_pick('Hello,LSUpdate,DBD,LSAck', 'o_custkey')} ELSE {_pick('Hello,Update,Query,Reply,Hello', 'o_custkey')} END AS msg_type,
  concat('10.0.0.', o_custkey % 6 + 1) AS src,
  CASE o_orderkey % 5 WHEN 3 THEN concat('10.0.0.', {_whole('o_custkey / 6')} % 7 + 1) ELSE '224.0.0.2' END AS dst,
  CAST(CASE WHEN o_orderkey % 5 IN (1, 2) THEN o_custkey % 4 END AS INT) AS group_id,
  CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_custkey % 9 = 0 THEN 'TC' END
    WHEN 1 THEN {_pick('Active,Standby,Init', _whole('o_orderkey / 90'))} END AS state,
  CAST(CASE WHEN o_orderkey % 5 = 2 THEN 100 + {_whole('o_orderkey / 130')} % 3 * 10 END AS INT) AS priority,
  CASE WHEN o_orderkey % 5 = 1 THEN concat('10.0.0.25', o_custkey % 4) END AS virtual_ip,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('8000.aa', {_whole('o_orderkey / 700')} % 3) END AS root_bridge,
  CASE WHEN o_orderkey % 5 = 3 THEN concat('0.0.0.', o_custkey % 3) END AS area,
  CASE WHEN o_orderkey % 5 = 3 THEN concat('1.1.1.', o_custkey % 6) END AS router_id,
  CAST(CASE WHEN o_orderkey % 5 = 4 THEN 100 + o_custkey % 2 END AS INT) AS as_number
FROM {{orders}}"""

# --- reports and indicators -----------------------------------------------------------------------
VIEWS["reports"] = f"""
SELECT concat('vendor/', source, '/doc-', doc_id, '.md') AS report_path, concat('doc-', doc_id, '.md') AS name, source AS subdirectory,
  concat(text, chr(10), '- Beacon to 203[.]0[.]113[.]', doc_id % 120 + 1, ' on dport: ', {_pick('443,4444,99999,502', 'doc_id')}, chr(10),
    '1. Exploits CVE-2024-', 1000 + doc_id % 700, ' (T', 1000 + doc_id % 300, ') from hxxps://n', doc_id % 40, '.evil-corp', doc_id % 4,
    '[.]com/x?id=', doc_id, chr(10), chr(10), '* ok', chr(10), 'Contact soc', doc_id % 9, '@store', doc_id % 3, '.net md5 ', md5(CAST(doc_id % 50 AS STRING)),
    ' sha256 ', md5(CAST(doc_id AS STRING)), md5(CAST(doc_id + 1 AS STRING)), ' mac AA-bb-cc-00-00-', {_pick('01,02,0f', 'doc_id')},
    ' site evil-corp', doc_id % 4, '.com seen 2024-01-', {_pick('05,11,17,23', 'doc_id')}, 'T', {_pick('03,09,15,21', _whole('doc_id / 4'))}, ':22:01') AS text
FROM {{documents}}"""

VIEWS["chunk_indicators"] = f"""
SELECT concat('rep-', user_id) AS report_path, CAST({_whole('event_id / 40')} % 6 AS INT) AS chunk_no, event_id AS pos,
  CASE WHEN event_id % 3 = 0 THEN 'ip' ELSE 'domain' END AS ioc_type,
  CASE WHEN event_id % 3 = 0 THEN concat('198.51.100.', event_id % 60 + 1)
    ELSE concat({_pick('N,n', 'user_id')}, event_id % 17, '.Evil', event_id % 5, '.com') END AS value,
  {_pick('low,medium,high,unknown', 'event_id')} AS confidence,
  {_pick('high,low,low', 'event_id')} AS priority,
  event_type = 'error' AS is_false_positive,
  CASE WHEN event_id % 4 = 0 THEN concat('T', 1000 + event_id % 23) ELSE '' END AS related
FROM {{events}}"""

VIEWS["chunk_mappings"] = f"""
SELECT concat('rep-', user_id) AS report_path, CAST({_whole('event_id / 40')} % 6 AS INT) AS chunk_no, event_id AS pos,
  CASE WHEN event_type = 'signup' THEN '' ELSE concat('T', 1000 + event_id % 31) END AS technique_id,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE {_pick(_TACTICS, 'event_id')} END AS tactic,
  {_pick('low,medium,high', 'event_id')} AS confidence
FROM {{events}}"""

# --- techniques, paths and mappings ---------------------------------------------------------------------
VIEWS["stix_objects"] = f"""
SELECT p_partkey AS object_no, CASE WHEN p_partkey % 7 = 0 THEN 'ics' ELSE 'enterprise' END AS matrix,
  CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS matrix_no,
  CASE WHEN p_type = 'PROMO' THEN 'malware' ELSE 'attack-pattern' END AS type,
  p_name AS name, p_size = 1 AS revoked, p_size = 2 AS deprecated,
  CASE WHEN p_size = 3 THEN '' ELSE concat('T', 1000 + p_partkey % 900) END AS ext_id,
  {_pick('initial-access,execution,command-and-control,impact', 'p_partkey')} AS phase1,
  CASE WHEN p_size % 2 = 0 THEN {_pick('persistence,lateral-movement,reconnaissance', 'p_partkey')} ELSE '' END AS phase2
FROM {{part}}"""

VIEWS["technique_dim"] = f"""
SELECT concat('T', 1000 + p_partkey % 330) AS technique_id, min(p_name) AS name,
  concat({_pick(_TACTICS, 'min(p_partkey)').replace('Command and Control', 'Command And Control')},
    CASE WHEN min(p_partkey) % 3 = 0 THEN ',Command And Control,Execution' WHEN min(p_partkey) % 3 = 1 THEN ',Initial Access' ELSE '' END) AS tactics
FROM {{part}} GROUP BY concat('T', 1000 + p_partkey % 330)"""

_REPORT = f"concat('rep-', {_whole('l_orderkey / 3')})"
_STEP_TACTIC = f"CASE WHEN l_suppkey % 15 = 0 THEN '' ELSE {_pick(_TACTICS, 'l_suppkey')} END"
_STEP_TECHNIQUE = "concat('T', 1000 + l_linenumber * 45 + l_partkey % 40)"
VIEWS["path_steps"] = f"""
SELECT report_path, CAST(path_no AS INT) AS path_no, path_id, CAST(step_no AS INT) AS step_no, technique_id, tactic,
  concat(coalesce(lead(technique_id) OVER (PARTITION BY path_no ORDER BY step_no), ''),
    CASE WHEN extra < 4 THEN concat(',T', 1000 + extra * 90) ELSE '' END) AS leads_to
FROM (
  SELECT concat('rep-', {_whole('l_orderkey / 3')}) AS report_path, l_orderkey AS path_no, concat('p', l_orderkey % 3) AS path_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS step_no,
    {_STEP_TECHNIQUE} AS technique_id, l_partkey % 19 AS extra,
    CASE WHEN l_suppkey % 15 = 0 THEN '' ELSE {_pick(_TACTICS, 'l_suppkey')} END AS tactic
  FROM {{lineitem}}
) s"""

VIEWS["technique_mappings"] = f"""
SELECT report_path, technique_id, tactic, concat('c-', technique_id) AS report_context,
  CASE WHEN n % 3 = 0 THEN 'high' WHEN n % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN n % 2 = 0 THEN '' ELSE concat('name ', technique_id) END AS technique_name,
  row_number() OVER (PARTITION BY report_path ORDER BY n, technique_id, tactic) AS map_no
FROM (
  SELECT concat('rep-', {_whole('l_orderkey / 3')}) AS report_path, {_STEP_TECHNIQUE} AS technique_id,
    CASE WHEN l_linestatus = 'F' THEN '' WHEN l_tax > 0.06 THEN lower({_pick(_TACTICS, 'l_suppkey')}) ELSE {_pick(_TACTICS, 'l_suppkey')} END AS tactic,
    min(l_partkey) AS n
  FROM {{lineitem}}
  GROUP BY concat('rep-', {_whole('l_orderkey / 3')}), {_STEP_TECHNIQUE},
    CASE WHEN l_linestatus = 'F' THEN '' WHEN l_tax > 0.06 THEN lower({_pick(_TACTICS, 'l_suppkey')}) ELSE {_pick(_TACTICS, 'l_suppkey')} END
) m"""

# --- posture ---------------------------------------------------------------------------------------------
VIEWS["stages"] = f"""
SELECT concat('a-', l_orderkey) AS assessment_id, {_pick('ddos,ransomware,data_theft,apt,insider_threat,web_attack,generic', 'l_orderkey')} AS attack_type,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS stage_no,
  {_pick(_STAGES, 'l_partkey')} AS name, l_returnflag <> 'R' AS stage_present,
  CASE WHEN l_quantity > 10 THEN concat('ctl-', l_suppkey % 9) END AS control1,
  {_pick('tested,claimed,benchmark,none', 'l_partkey')} AS evidence1, {_pick('strong,partial,weak', 'l_partkey')} AS effect1, l_tax > 0.06 AS flag1,
  CASE WHEN l_discount > 0.04 THEN concat('ctl-', l_partkey % 9) END AS control2,
  {_pick('claimed,tested', 'l_suppkey')} AS evidence2, {_pick('weak,strong', 'l_suppkey')} AS effect2, l_tax > 0.07 AS flag2,
  CAST(l_linenumber % 3 AS INT) AS assumptions
FROM {{lineitem}}"""
VIEWS["scenarios"] = """
SELECT concat('s-', o_orderkey) AS scenario_id, concat('scenario ', o_custkey) AS name FROM {orders}"""
VIEWS["scenario_controls"] = f"""
SELECT concat('s-', l_orderkey) AS scenario_id, concat('c-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS control_id, concat('control ', l_suppkey) AS name,
  {_pick('perimeter,network,endpoint,application,data,identity,monitoring', 'l_partkey')} AS control_type,
  {_pick('implemented,partial,planned,missing', 'l_suppkey')} AS implementation_status,
  {_pick('trivial,low,medium,high,extreme', 'l_partkey')} AS bypass_difficulty
FROM {{lineitem}}"""
VIEWS["scenario_events"] = f"""
SELECT concat('s-', l_orderkey) AS scenario_id, concat('e-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS event_id, concat('event ', l_partkey) AS name,
  CAST(l_linenumber AS INT) AS sequence_order,
  CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey % 3 END AS INT) AS blocking,
  CAST(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_suppkey % 2 END AS INT) AS detecting
FROM {{lineitem}}"""
VIEWS["inventory"] = f"""
SELECT {_pick('pillar,common', 'l_suppkey')} AS root, CAST(l_suppkey % 2 AS INT) AS priority,
  CASE WHEN l_linenumber > 4 THEN '' ELSE concat('inc-', l_linenumber) END AS workspace,
  concat('log-', l_partkey, {_pick('.log,.log.1,.PCAP,.txt,.json.bak,', 'l_partkey')}) AS filename,
  concat(CASE WHEN l_linenumber > 4 THEN '' ELSE concat('inc-', l_linenumber, '/') END, 'log-', l_partkey, '/', l_orderkey, '/', l_suppkey) AS object_path
FROM {{lineitem}}"""

# documents as lines: the split differs between dialects, so it has two texts
_DOC_LINES_DUCKDB = """
SELECT concat('doc-', doc_id) AS file_path, CAST(i AS BIGINT) AS line_no, l AS line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {documents}) d"""


def _render(text: str, dialect: str) -> str:
    return re.sub(r"MICROS\(([^()]*)\)", lambda m: _DIALECT[dialect](m.group(1)), text)


def view_sql(name: str) -> str:
    """DuckDB text of a view over the registered tables."""
    text = _DOC_LINES_DUCKDB if name == "doc_lines" else VIEWS[name]
    return _render(text, "duckdb").format(**{t: t for t in TABLES})


class Inputs:
    """The views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, dealt: str | None = None) -> DataFrame:
        """A view; its table dealt over tasks by an expression whose values bound what a task gets, if one is named."""
        text = _render(VIEWS[name], "spark")
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in text}
        if dealt is not None:
            used = {t: df.repartition(F.expr(dealt)) for t, df in used.items()}
        df = self.spark.sql(text, **used)
        for column in _STORED.get(name, ()):
            df = evaluated_once(df.withColumnRenamed(column, "_made"), column, F.col("_made")).drop("_made")
        return df

    @cached_property
    def doc_lines(self) -> DataFrame:
        return text_lines(self.table("documents"), "doc_id", "text", "doc-")

    @cached_property
    def access_lines(self) -> DataFrame:
        return self.view("access_lines")

    @cached_property
    def connections(self) -> DataFrame:
        return self.view("connections")

    @cached_property
    def convs(self) -> DataFrame:
        return flows.conversations(self.connections)

    @cached_property
    def queries(self) -> DataFrame:
        return self.view("dns_queries")

    @cached_property
    def responses(self) -> DataFrame:
        return self.view("dns_responses")

    @cached_property
    def requests(self) -> DataFrame:
        return self.view("http_requests")

    @cached_property
    def handshakes(self) -> DataFrame:
        return self.view("tls_handshakes")

    @cached_property
    def fw_entries(self) -> DataFrame:
        return self.view("fw_entries")

    @cached_property
    def packets(self) -> DataFrame:
        return conform(self.view("packets").withColumn("payload", F.unhex("payload_hex")), "packets")

    @cached_property
    def ot(self) -> DataFrame:
        return pk.ot_transactions(self.packets)

    @cached_property
    def creds(self) -> DataFrame:
        return pk.cleartext_creds(self.packets)

    @cached_property
    def icmp_errors(self) -> DataFrame:
        return pk.icmp_errors(self.packets)

    @cached_property
    def loop_packets(self) -> DataFrame:
        return pk.loop_packets(self.packets)

    @cached_property
    def control_plane(self) -> DataFrame:
        return self.view("control_plane")

    @cached_property
    def reports(self) -> DataFrame:
        return self.view("reports")

    @cached_property
    def techniques(self) -> DataFrame:
        return self.view("technique_dim").withColumn("tactics", F.split("tactics", ","))

    @cached_property
    def paths(self) -> DataFrame:
        """The steps of ``path_steps`` by path, from one exchange by report: an array's order gives the
        step numbers and next steps that the view's windows give. A report has three orders."""
        lines = self.table("lineitem").repartition(F.expr(_REPORT))
        line = F.struct(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.expr(_STEP_TECHNIQUE).alias("technique_id"),
            F.expr(_STEP_TACTIC).alias("tactic"), (F.col("l_partkey") % 19).alias("extra"),
        )
        grouped = lines.groupBy(
            F.expr(_REPORT).alias("report_path"), F.col("l_orderkey").cast("int").alias("path_no"),
            F.concat(F.lit("p"), (F.col("l_orderkey") % 3).cast("string")).alias("path_id"),
        ).agg(F.array_sort(F.collect_list(line)).alias("_lines"))

        def step(line: Column, no: Column) -> Column:
            onward = F.get("_lines", no + 1)["technique_id"]
            extra = F.when(line["extra"] < 4, F.concat(F.lit("T"), (line["extra"] * 90 + 1000).cast("string")))
            return F.struct(
                line["technique_id"].alias("technique_id"), F.lit("").alias("technique_name"), line["tactic"].alias("tactic"),
                F.array_compact(F.array(onward, extra)).alias("leads_to"),
            )

        return evaluated_once(grouped, "steps", F.transform("_lines", step)).drop("_lines")

    @cached_property
    def mappings(self) -> DataFrame:
        return self.view("technique_mappings", _REPORT)

    @cached_property
    def chunks(self) -> DataFrame:
        """Nested chunk results, one row per report and chunk."""
        related = F.filter(F.array("related"), lambda t: t != "")
        ioc = F.struct(
            "pos", "ioc_type", "value", "confidence", "priority", F.lit("").alias("context"),
            related.alias("related_mitre"), "is_false_positive",
        )
        keys = ["report_path", "chunk_no"]
        no_pos = lambda c: F.transform(F.array_sort(c), lambda s: s.dropFields("pos"))
        iocs = self.view("chunk_indicators").groupBy(*keys).agg(no_pos(F.collect_list(ioc)).alias("refined_iocs"))
        mapping = F.struct(
            "pos", "technique_id", F.concat(F.lit("name "), "technique_id").alias("technique_name"), "tactic", "confidence",
            F.lit("").alias("report_context"),
        )
        step = F.struct("technique_id", F.lit("").alias("technique_name"), "tactic", F.array().cast("array<string>").alias("leads_to"))
        path = F.struct("pos", F.concat(F.lit("p"), F.col("pos") % 2).alias("path_id"), F.lit("").alias("description"), F.array(step).alias("steps"))
        graph = F.struct(
            no_pos(F.collect_list(path)).alias("paths"),
            F.collect_set(F.when(F.col("pos") % 3 == 0, F.col("technique_id"))).alias("convergence_points"),
            F.collect_set(F.when(F.col("pos") % 3 == 1, F.col("technique_id"))).alias("branch_points"),
        )
        maps = self.view("chunk_mappings").groupBy(*keys).agg(
            no_pos(F.collect_list(mapping)).alias("additional_mitre_techniques"), graph.alias("attack_graph")
        )
        filled = F.create_map(F.lit("title"), F.col("report_path"), F.lit("part"), F.col("chunk_no").cast("string"))
        return iocs.join(maps, keys).withColumn(
            "report_metadata", F.when(F.col("chunk_no") % 2 == 1, filled).otherwise(F.create_map().cast("map<string,string>"))
        )

    @cached_property
    def stages(self) -> DataFrame:
        def control(n: int):
            return F.struct(
                F.col(f"control{n}").alias("control_name"), F.lit("preventive").alias("control_type"),
                F.col(f"effect{n}").alias("effectiveness_rating"), F.col(f"evidence{n}").alias("evidence_basis"),
                F.col(f"flag{n}").alias("independence_flag"),
            )

        controls = F.filter(F.array(control(1), control(2)), lambda c: c["control_name"].isNotNull())
        return self.view("stages").select(
            "assessment_id", "attack_type", "stage_no", "name", "stage_present", controls.alias("controls"),
            F.array_repeat(F.lit("assumed"), F.col("assumptions")).alias("assumptions"),
        )

    @cached_property
    def scenarios(self) -> DataFrame:
        return self.view("scenarios")

    @cached_property
    def scenario_controls(self) -> DataFrame:
        return self.view("scenario_controls")

    @cached_property
    def scenario_events(self) -> DataFrame:
        return self.view("scenario_events").select(
            "scenario_id", "event_id", "name", "sequence_order",
            F.array_repeat(F.lit("c"), F.col("blocking")).alias("blocking_controls"),
            F.array_repeat(F.lit("c"), F.col("detecting")).alias("detecting_controls"),
        )

    @cached_property
    def traffic(self) -> TrafficTables:
        return TrafficTables(
            connections=self.connections, packets=self.packets, dns_queries=self.queries, dns_responses=self.responses,
            http_requests=self.requests, tls_handshakes=self.handshakes, ot_transactions=self.ot,
            cleartext_creds=self.creds, icmp_errors=self.icmp_errors, control_plane=self.control_plane,
        )
