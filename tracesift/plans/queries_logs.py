"""Queries over log lines and firewall entries, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.operators import firewall, logs
from tracesift.session import ensure_checkpoint_dir
from tracesift.sources import firewall as fw
from tracesift.streaming import windows

from .bindings import Inputs
from .oracle_sql import oracle, signature, sql_text, strip


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as comma-separated text, for comparison across engines."""
    for c in columns:
        df = df.withColumn(c, F.concat_ws(",", F.col(c).cast("array<string>")))
    return df


def _with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame to every row as scalar subqueries."""
    for c in totals.columns:
        rows = rows.withColumn(c, totals.select(c).scalar())
    return rows


QUERIES: dict[str, tuple] = {}
CSV_HEADER = ["Event Time", "Src IP", "Src Port", "Dest-IP", "Dest Port", "Protocol", "Action"]

# --- lines -------------------------------------------------------------------------------------
QUERIES["log_line_counts"] = (
    lambda x: logs.line_counts(x.doc_lines),
    oracle("SELECT file_path, count(*) AS line_count FROM doc_lines GROUP BY file_path", "doc_lines"),
)
QUERIES["log_read_segment"] = (
    lambda x: logs.read_segment(x.doc_lines, 2, 5),
    oracle(
        """SELECT d.file_path, d.line_no, d.line, m.last > 7 AS has_more FROM doc_lines d
JOIN (SELECT file_path, max(line_no) AS last FROM doc_lines GROUP BY file_path) m USING (file_path)
WHERE d.line_no > 2 AND d.line_no <= 7""",
        "doc_lines",
    ),
)


def _first_match(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(line, {sql_text(pattern)}) THEN regexp_extract(line, {sql_text(pattern)}, 1) END"


def _frequency_sql(view: str, pattern: str, limit: int) -> str:
    return oracle(
        f"""SELECT value, cnt, w.file_path AS first_file, w.line_no AS first_line FROM (
SELECT value, count(*) AS cnt, min({{'file_path': file_path, 'line_no': line_no}}) AS w
FROM (SELECT *, {_first_match(pattern)} AS value FROM {view}) q WHERE value IS NOT NULL GROUP BY value) g
ORDER BY cnt DESC, w LIMIT {limit}""",
        view,
    )


QUERIES["log_value_frequency_ip"] = (
    lambda x: logs.value_frequency(x.doc_lines, "IP", 10),
    _frequency_sql("doc_lines", fv.LOG_PATTERNS["IP"], 10),
)
QUERIES["log_value_frequency_regex"] = (
    lambda x: logs.value_frequency(x.access_lines, r"user[=:]\s?(?P<name>\w+)", 5),
    _frequency_sql("access_lines", r"user[=:]\s?(\w+)", 5),
)
QUERIES["log_value_samples"] = (
    lambda x: logs.value_samples(x.access_lines, "HTTPSTATUS", 6),
    oracle(
        f"""WITH hits AS (SELECT *, {_first_match(fv.LOG_PATTERNS['HTTPSTATUS'])} AS value FROM access_lines),
top AS (SELECT value, count(*) AS cnt, min({{'file_path': file_path, 'line_no': line_no}}) AS w FROM hits WHERE value IS NOT NULL
  GROUP BY value ORDER BY cnt DESC, w LIMIT 6),
r AS (SELECT h.value, t.cnt, CAST(row_number() OVER (PARTITION BY h.value ORDER BY file_path, line_no) AS INT) AS sample_no,
  substr({strip('line')}, 1, 200) AS sample FROM hits h JOIN top t ON h.value = t.value)
SELECT * FROM r WHERE sample_no <= 3""",
        "access_lines",
    ),
)
QUERIES["log_frequency_totals"] = (
    lambda x: logs.frequency_totals(x.doc_lines, "EMAIL"),
    oracle(
        f"""SELECT count(*) AS lines_processed, count(*) FILTER (WHERE regexp_matches(line, {sql_text(fv.LOG_PATTERNS['EMAIL'])})) AS matches_found
FROM doc_lines""",
        "doc_lines",
    ),
)
QUERIES["log_pattern_profile"] = (
    lambda x: logs.pattern_profile(x.access_lines),
    oracle(
        "SELECT pattern, count(*) AS matches, count(DISTINCT value) AS distinct_values FROM ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS pattern, {_first_match(rx)} AS value FROM access_lines" for name, rx in fv.LOG_PATTERNS.items()
        )
        + ") q WHERE value IS NOT NULL GROUP BY pattern",
        "access_lines",
    ),
)


def _signature_sql(view: str, cut: int, skip: tuple, tail: str) -> str:
    text, clipped = signature("line", cut, skip)
    return oracle(
        f"""WITH s AS (SELECT file_path, line_no, {strip('line')} AS line, {text} AS sig FROM {view} WHERE {strip('line')} <> ''),
g AS (SELECT {clipped} AS signature, count(*) AS cnt, min({{'f': file_path, 'n': line_no, 'l': line}}) AS w FROM s GROUP BY 1),
t AS (SELECT CAST(sum(cnt) AS BIGINT) AS lines_processed, count(*) AS unique_patterns FROM g)
{tail}""",
        view,
    )


QUERIES["signature_discovery"] = (
    lambda x: logs.signature_discovery(x.doc_lines, 5),
    _signature_sql(
        "doc_lines", 300, (),
        """SELECT signature, cnt, round(cnt / lines_processed * 100, 1) AS percentage, w.l AS example, lines_processed, unique_patterns
FROM g, t ORDER BY cnt DESC, w LIMIT 5""",
    ),
)
QUERIES["signature_discovery_access"] = (
    lambda x: logs.signature_discovery(x.access_lines, 8),
    _signature_sql(
        "access_lines", 300, (),
        """SELECT signature, cnt, round(cnt / lines_processed * 100, 1) AS percentage, w.l AS example, lines_processed, unique_patterns
FROM g, t ORDER BY cnt DESC, w LIMIT 8""",
    ),
)
QUERIES["log_attack_pattern_scan"] = (
    lambda x: logs.attack_pattern_scan(x.access_lines, 5),
    _signature_sql(
        "access_lines", 200, ("<UUID>",),
        """SELECT concat('[', printf('%.0f', cnt / lines_processed * 100), '%] ', substr(signature, 1, 120)) AS value, cnt,
  substr(w.l, 1, 200) AS line, lines_processed FROM g, t ORDER BY cnt DESC, w LIMIT 5""",
    ),
)


def _section_sql(workflow: str) -> str:
    parts = [
        f"SELECT {no} AS n, {sql_text(name)} AS section, {_first_match(rx)} AS value, file_path, line_no FROM access_lines"
        for no, (name, rx) in enumerate(fv.WORKFLOW_SECTIONS[workflow])
    ]
    return oracle(
        f"""SELECT section, CAST(rank AS INT) AS rank, value, cnt FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, w) AS rank FROM (
SELECT n, section, value, count(*) AS cnt, min({{'file_path': file_path, 'line_no': line_no}}) AS w FROM ({' UNION ALL '.join(parts)}) u
WHERE value IS NOT NULL GROUP BY n, section, value) g) r WHERE rank <= 10""",
        "access_lines",
    )


for _workflow in fv.WORKFLOW_SECTIONS:
    QUERIES[f"log_{_workflow}"] = (
        lambda x, w=_workflow: logs.section_scan(x.access_lines, w),
        _section_sql(_workflow),
    )
QUERIES["log_address_activity"] = (
    lambda x: logs.address_activity(x.access_lines, "10.0.0.8"),
    oracle(
        f"""SELECT file_path, line_no, concat('L', line_no, ': ', substr({strip('line')}, 1, 200)) AS line FROM access_lines
WHERE contains(line, '10.0.0.8')""",
        "access_lines",
    ),
)
QUERIES["log_investigate"] = (
    lambda x: _with_totals(logs.investigate_lines(x.access_lines, "FAILED"), logs.investigate_totals(x.access_lines, "FAILED")),
    oracle(
        f"""SELECT file_path, line_no, {strip('line')} AS line, (SELECT count(*) FROM access_lines) AS lines_scanned,
(SELECT count(*) FROM access_lines WHERE contains(lower(line), 'failed')) AS total_matches
FROM access_lines WHERE contains(lower(line), 'failed')""",
        "access_lines",
    ),
)
QUERIES["log_search_regex"] = (
    lambda x: logs.search(x.doc_lines, r"PASS|secret|token\s*=", "regex", 100),
    oracle(
        r"""SELECT file_path, line_no AS line_number, regexp_replace(line, '\s+$', '') AS text FROM doc_lines
WHERE regexp_matches(line, '(?i)PASS|secret|token\s*=') ORDER BY file_path, line_no LIMIT 100""",
        "doc_lines",
    ),
)
QUERIES["log_search_totals_inverted"] = (
    lambda x: logs.search_totals(x.doc_lines, "the", "text", 50, True),
    oracle(
        """SELECT count(*) AS lines_scanned, count(*) FILTER (WHERE NOT contains(lower(line), 'the')) AS total_matches,
count(*) FILTER (WHERE NOT contains(lower(line), 'the')) > 50 AS truncated FROM doc_lines""",
        "doc_lines",
    ),
)
QUERIES["log_search_context"] = (
    lambda x: _lines_joined(logs.search(x.access_lines, "code 0x", "text", 40, 2)),
    oracle(
        r"""WITH h AS (SELECT file_path, line_no, regexp_replace(line, '\s+$', '') AS text FROM access_lines
  WHERE contains(lower(line), 'code 0x') ORDER BY file_path, line_no LIMIT 40)
SELECT h.file_path, h.line_no AS line_number, h.text,
  coalesce((SELECT string_agg(regexp_replace(a.line, '\s+$', ''), '|' ORDER BY a.line_no) FROM access_lines a
    WHERE a.file_path = h.file_path AND a.line_no BETWEEN h.line_no - 2 AND h.line_no - 1), '') AS context_before,
  coalesce((SELECT string_agg(regexp_replace(a.line, '\s+$', ''), '|' ORDER BY a.line_no) FROM access_lines a
    WHERE a.file_path = h.file_path AND a.line_no BETWEEN h.line_no + 1 AND h.line_no + 2), '') AS context_after
FROM h""",
        "access_lines",
    ),
)


def _lines_joined(df: DataFrame) -> DataFrame:
    return df.withColumn("context_before", F.array_join("context_before", "|")).withColumn(
        "context_after", F.array_join("context_after", "|")
    )


# --- firewall ------------------------------------------------------------------------------------
_ENTRY = ["file_path", "line_no", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "action"]


def _entries(df: DataFrame, *more: str) -> DataFrame:
    """Entry columns with nulls shown as 0 or empty text."""
    numbers = ("src_port", "dst_port", "bytes_sent", "bytes_recv")
    return df.select(
        *[F.coalesce(c, F.lit(0) if c in numbers else F.lit("")).alias(c) for c in (*_ENTRY, *more)]
    )


_IPTABLES_SQL = f"""SELECT file_path, line_no, m.t AS timestamp, m.src AS src_ip, m.dst AS dst_ip,
  coalesce(TRY_CAST(m.spt AS INT), 0) AS src_port, coalesce(TRY_CAST(m.dpt AS INT), 0) AS dst_port, m.proto AS protocol,
  CASE WHEN lower(m.act) IN ('drop', 'reject') THEN 'deny' ELSE 'allow' END AS action,
  CASE WHEN m.i <> '' THEN m.i ELSE m.o END AS interface
FROM (SELECT file_path, line_no, regexp_extract(line, {sql_text(fv.IPTABLES_LINE)},
  ['t', 'act', 'i', 'o', 'src', 'dst', 'proto', 'spt', 'dpt']) AS m FROM iptables_lines
  WHERE regexp_matches(line, {sql_text(fv.IPTABLES_LINE)})) q"""
QUERIES["fw_parse_iptables"] = (
    lambda x: _entries(fw.parse_iptables(x.view("iptables_lines")), "interface"),
    oracle(
        _IPTABLES_SQL,
        "iptables_lines",
    ),
)
_KV = "regexp_extract(line, '(?:^|\\s){0}=(\".*?\"|\\S+)', 1)"


def _kv(*keys: str) -> str:
    picks = [f"nullif(trim({_KV.format(k)}, '\"'), '')" for k in keys]
    return f"coalesce({', '.join(picks)})"


_FORTINET_SQL = f"""SELECT file_path, line_no, concat({_kv('date')}, ' ', {_kv('time')}) AS timestamp, {_kv('srcip', 'src')} AS src_ip, {_kv('dstip')} AS dst_ip,
  coalesce(TRY_CAST({_kv('srcport')} AS INT), 0) AS src_port, coalesce(TRY_CAST({_kv('dstport')} AS INT), 0) AS dst_port, '17' AS protocol,
  CASE WHEN lower({_kv('action')}) IN ('deny', 'dropped', 'blocked') THEN 'deny' ELSE 'allow' END AS action,
  coalesce(TRY_CAST({_kv('sentbyte')} AS BIGINT), 0) AS bytes_sent, coalesce(TRY_CAST({_kv('rcvdbyte')} AS BIGINT), 0) AS bytes_recv,
  {_kv('policyid')} AS rule, {_kv('srcintf')} AS interface
FROM fortinet_lines WHERE {_kv('srcip', 'src')} IS NOT NULL"""
QUERIES["fw_parse_fortinet"] = (
    lambda x: _entries(fw.parse_fortinet(x.view("fortinet_lines")), "bytes_sent", "bytes_recv", "rule", "interface"),
    oracle(
        _FORTINET_SQL,
        "fortinet_lines",
    ),
)
_PALO_SQL = """SELECT file_path, line_no, c[2] AS timestamp, c[8] AS src_ip, c[9] AS dst_ip, CAST(c[25] AS INT) AS src_port,
  coalesce(TRY_CAST(c[26] AS INT), 0) AS dst_port, c[30] AS protocol, CASE WHEN c[31] IN ('deny', 'drop', 'reset-both') THEN 'deny' ELSE 'allow' END AS action,
  CAST(c[32] AS BIGINT) AS bytes_sent, CAST(c[33] AS BIGINT) AS bytes_recv, replace(c[13], ';', ', ') AS rule
FROM (SELECT file_path, line_no, string_split(replace(replace(line, '"', ''), 'rule, ', 'rule;'), ',') AS c FROM paloalto_lines) q
WHERE len(c) >= 35 AND c[25] <> 'bad'"""
QUERIES["fw_parse_paloalto"] = (
    lambda x: _entries(fw.parse_paloalto(x.view("paloalto_lines")), "bytes_sent", "bytes_recv", "rule"),
    oracle(
        _PALO_SQL,
        "paloalto_lines",
    ),
)
QUERIES["fw_parse_generic_csv"] = (
    lambda x: _entries(fw.parse_generic_csv(x.view("csv_lines"), CSV_HEADER)),
    oracle(
        """SELECT file_path, line_no, c[1] AS timestamp, c[2] AS src_ip, c[4] AS dst_ip, CAST(c[3] AS INT) AS src_port,
  coalesce(TRY_CAST(c[5] AS INT), 0) AS dst_port, c[6] AS protocol,
  CASE WHEN regexp_matches(lower(c[7]), 'deny|drop|block|reject') THEN 'deny' ELSE 'allow' END AS action
FROM (SELECT file_path, line_no, string_split(replace(line, '"', ''), ',') AS c FROM csv_lines WHERE line_no > 1) q WHERE c[5] <> 'bad'""",
        "csv_lines",
    ),
)


def _mixed_lines(x: Inputs) -> DataFrame:
    """All formats: pfSense lines are kernel lines with another program name, Palo Alto files begin with a wide header."""
    iptables, palo = x.view("iptables_lines"), x.view("paloalto_lines")
    pfsense = iptables.select(F.concat(F.lit("pf-"), "file_path").alias("file_path"), "line_no", F.replace("line", F.lit("kernel:"), F.lit("filterlog:")).alias("line"))
    header = palo.select("file_path", F.lit(1).cast("long").alias("line_no"), F.lit(_PALO_HEADER).alias("line")).distinct()
    parts = [iptables, pfsense, x.view("fortinet_lines"), palo, header, x.view("headed_csv_lines")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_PALO_HEADER = ",".join(["TRAFFIC", *(f"h{i}" for i in range(35))])
_PF_LINES = "(SELECT concat('pf-', file_path) AS file_path, line_no, replace(line, 'kernel:', 'filterlog:') AS line FROM iptables_lines)"
_MIXED_VIEWS = ("iptables_lines", "fortinet_lines", "paloalto_lines", "headed_csv_lines")
QUERIES["fw_detect_formats"] = (
    lambda x: fw.detect_formats(_mixed_lines(x)),
    oracle(
        f"""SELECT file_path, CASE WHEN bool_or(contains(line, 'TRAFFIC')) AND bool_or(line_no = 1 AND length(line) - length(replace(line, ',', '')) > 30) THEN 'paloalto_csv'
  WHEN bool_or(contains(line, 'devname=') OR contains(line, 'type=traffic')) THEN 'fortinet_syslog'
  WHEN bool_or(contains(line, 'filterlog')) THEN 'pfsense'
  WHEN bool_or(regexp_matches(line, 'SRC=\\S+ DST=\\S+')) THEN 'iptables'
  WHEN bool_or(contains(lower(line), 'src-ip') OR contains(lower(line), 'source address')) THEN 'windows_fw' ELSE 'generic_csv' END AS log_format
FROM (SELECT file_path, line_no, line FROM iptables_lines UNION ALL SELECT * FROM {_PF_LINES} pf UNION ALL SELECT file_path, line_no, line FROM fortinet_lines
  UNION ALL SELECT file_path, line_no, line FROM paloalto_lines UNION ALL SELECT DISTINCT file_path, 1, '{_PALO_HEADER}' FROM paloalto_lines
  UNION ALL SELECT file_path, line_no, line FROM headed_csv_lines) u
GROUP BY file_path""",
        *_MIXED_VIEWS,
    ),
)
_CSV_PARTS = """SELECT file_path, line_no, c, CAST(split_part(file_path, '-', 2) AS INT) % 2 = 0 AS dated
FROM (SELECT file_path, line_no, string_split(replace(line, '"', ''), ',') AS c FROM headed_csv_lines WHERE line_no > 1) q"""
_CSV_SQL = f"""SELECT file_path, line_no, CASE WHEN dated THEN c[1] ELSE c[7] END AS timestamp, CASE WHEN dated THEN c[2] ELSE c[5] END AS src_ip,
  CASE WHEN dated THEN c[4] ELSE c[2] END AS dst_ip, CAST(CASE WHEN dated THEN c[3] ELSE c[4] END AS INT) AS src_port,
  coalesce(TRY_CAST(CASE WHEN dated THEN c[5] ELSE c[3] END AS INT), 0) AS dst_port, c[6] AS protocol,
  CASE WHEN regexp_matches(lower(CASE WHEN dated THEN c[7] ELSE c[1] END), 'deny|drop|block|reject') THEN 'deny' ELSE 'allow' END AS action,
  CASE WHEN dated THEN 'windows_fw' ELSE 'generic_csv' END AS log_format
FROM ({_CSV_PARTS}) p WHERE CASE WHEN dated THEN c[5] ELSE c[3] END <> 'bad'"""
_COMMON = "file_path, line_no, timestamp, src_ip, dst_ip, src_port, dst_port, protocol, action"
_MIXED_SQL = f"""SELECT {_COMMON}, 'iptables' AS log_format FROM ({_IPTABLES_SQL}) a
UNION ALL SELECT {_COMMON}, 'pfsense' FROM ({_IPTABLES_SQL.replace('FROM iptables_lines', f'FROM {_PF_LINES} pf')}) b
UNION ALL SELECT {_COMMON}, 'fortinet_syslog' FROM ({_FORTINET_SQL}) c
UNION ALL SELECT {_COMMON}, 'paloalto_csv' FROM ({_PALO_SQL}) d
UNION ALL SELECT {_COMMON}, log_format FROM ({_CSV_SQL}) e"""
QUERIES["fw_parse_mixed"] = (lambda x: _entries(fw.parse_detected(_mixed_lines(x)), "log_format"), oracle(_MIXED_SQL, *_MIXED_VIEWS))
QUERIES["fw_load_counts"] = (
    lambda x: firewall.load_counts(fw.parse_detected(_mixed_lines(x))),
    oracle(f"SELECT file_path, log_format, count(*) AS total_entries FROM ({_MIXED_SQL}) m GROUP BY file_path, log_format", *_MIXED_VIEWS),
)
QUERIES["fw_summary"] = (
    lambda x: firewall.summary(x.fw_entries),
    oracle(
        """SELECT count(*) AS total_entries, count(DISTINCT src_ip) AS unique_sources, count(DISTINCT dst_ip) AS unique_destinations,
  CAST(sum(bytes_sent + bytes_recv) AS BIGINT) AS total_bytes,
  (SELECT timestamp FROM fw_entries ORDER BY file_path, line_no LIMIT 1) AS first_row_ts,
  (SELECT timestamp FROM fw_entries ORDER BY file_path DESC, line_no DESC LIMIT 1) AS last_row_ts FROM fw_entries""",
        "fw_entries",
    ),
)
QUERIES["fw_distribution"] = (
    lambda x: firewall.distribution(x.fw_entries),
    oracle(
        """WITH t AS (SELECT count(*) AS n FROM fw_entries)
SELECT 'action' AS kind, action AS key, count(*) AS cnt, round(count(*) / max(n) * 100, 1) AS percentage FROM fw_entries, t GROUP BY action
UNION ALL SELECT 'protocol', protocol, count(*), round(count(*) / max(n) * 100, 1) FROM fw_entries, t GROUP BY protocol""",
        "fw_entries",
    ),
)
_FW_W = "min({'file_path': file_path, 'line_no': line_no})"


def _ranked(parts: list[str], limit: int, columns: str) -> str:
    return f"""SELECT kind, CAST(rank AS INT) AS rank, {columns}, cnt FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cnt DESC, w) AS rank
FROM ({' UNION ALL '.join(parts)}) u) r WHERE rank <= {limit}"""


QUERIES["fw_top_talkers"] = (
    lambda x: firewall.top_talkers(x.fw_entries, 20).select(
        "kind", "rank", F.coalesce("src_ip", "dst_ip", F.col("dst_port").cast("string")).alias("key"), "cnt"
    ),
    oracle(
        _ranked(
            [
                f"SELECT '{kind}' AS kind, CAST({c} AS VARCHAR) AS key, count(*) AS cnt, {_FW_W} AS w FROM fw_entries WHERE {c} IS NOT NULL GROUP BY {c}"
                for kind, c in (("source", "src_ip"), ("destination", "dst_ip"), ("port", "dst_port"))
            ],
            20, "key",
        ),
        "fw_entries",
    ),
)
QUERIES["fw_deny_hotspots"] = (
    lambda x: firewall.deny_hotspots(x.fw_entries, 20).select(
        "kind", "rank",
        F.coalesce(F.concat("src_ip", F.lit(" "), "dst_ip"), F.col("dst_port").cast("string")).alias("key"), "cnt",
    ),
    oracle(
        _ranked(
            [
                f"SELECT 'pair' AS kind, concat(src_ip, ' ', dst_ip) AS key, count(*) AS cnt, {_FW_W} AS w FROM fw_entries WHERE action = 'deny' GROUP BY src_ip, dst_ip",
                f"SELECT 'port' AS kind, CAST(dst_port AS VARCHAR) AS key, count(*) AS cnt, {_FW_W} AS w FROM fw_entries WHERE action = 'deny' AND dst_port IS NOT NULL GROUP BY dst_port",
            ],
            20, "key",
        ),
        "fw_entries",
    ),
)
QUERIES["fw_port_scans"] = (
    lambda x: joined(firewall.port_scans(x.fw_entries, 10, 200), "sample_ports"),
    oracle(
        f"""SELECT src_ip, dst_ip, port_count, array_to_string(list_sort(ports)[1:20], ',') AS sample_ports FROM (
SELECT src_ip, dst_ip, count(DISTINCT dst_port) AS port_count, list(DISTINCT dst_port) AS ports, {_FW_W} AS w FROM fw_entries WHERE dst_port > 0
GROUP BY src_ip, dst_ip HAVING count(DISTINCT dst_port) >= 10) g ORDER BY port_count DESC, w LIMIT 200""",
        "fw_entries",
    ),
)
_DENY_WINDOWS_SQL = """SELECT strftime(time_bucket(INTERVAL 1 DAY, event_time), '%Y-%m-%d %H:%M:%S') AS window_start, src_ip, dst_ip, count(*) AS denies
FROM fw_entries WHERE action = 'deny' GROUP BY ALL"""


def _streamed_denies(x: Inputs) -> DataFrame:
    """The table arrives in six deliveries by time; each holds back a ninth of its rows, which come with the next one, late.

    Each delivery is one micro-batch, however many files it has: the stream goes on from
    its checkpoint, takes all that has arrived and stops. A last denied row far in the
    future (others are filtered before they move the watermark) lets the watermark pass
    all windows but its own, and, come again in a batch of its own, has them written.
    """
    folder = f"{ensure_checkpoint_dir(x.spark)}/stream-{uuid.uuid4().hex}"
    rows = x.fw_entries.select("line_no", F.col("event_time").cast("timestamp").alias("event_time"), "src_ip", "dst_ip", "action")
    year = F.year("event_time") - 1992
    dealt = rows.withColumn("delivery", year + (F.pmod("line_no", F.lit(9)) == 4).cast("int")).drop("line_no")
    last = dealt.agg(F.min("delivery"), F.max("delivery")).head()
    end = x.spark.range(1).select(
        F.lit("2999-01-01").cast("timestamp").alias("event_time"),
        F.lit("-").alias("src_ip"), F.lit("-").alias("dst_ip"), F.lit("deny").alias("action"),
    )
    deliveries = [dealt.where(F.col("delivery") == no).drop("delivery") for no in range(last[0], last[1] + 1)]
    schema = ", ".join(f"{n} {t}" for n, t in end.dtypes)
    for rows in (*deliveries, end, end):
        rows.write.mode("append").parquet(f"{folder}/in")
        arriving = windows.entry_stream(x.spark, f"{folder}/in", schema, max_files=2**31 - 1)
        done = windows.deny_stream(arriving, "event_time", 60 * 24, "800 days")
        windows.start(done, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return x.spark.read.schema(done.schema).parquet(f"{folder}/out").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "src_ip", "dst_ip", "denies"
    )


QUERIES["stream_deny_windows"] = (_streamed_denies, oracle(_DENY_WINDOWS_SQL, "fw_entries"))
QUERIES["fw_deny_windows"] = (
    lambda x: firewall.deny_windows(x.fw_entries, 60 * 24).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "src_ip", "dst_ip", "denies"
    ),
    oracle(_DENY_WINDOWS_SQL, "fw_entries"),
)
