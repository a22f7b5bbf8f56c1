import json
import re

import pytest
from pyspark.sql import functions as F

from tracesift.operators import firewall
from tracesift.sources import inventory, lines, packets, reports, sinks, techniques, zeek
from tracesift.sources import firewall as fw
from tracesift.schemas import SCHEMAS
from tracesift.streaming import windows


def log(spark, texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts, 1)], SCHEMAS["log_lines"])


def test_line_numbers_across_splits(spark, tmp_path):
    for name, count in (("a.log", 5000), ("b.log", 3)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(1, count + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = lines.log_lines(spark, str(tmp_path))
        assert df.where(F.element_at(F.split("line", " "), -1).cast("bigint") != F.col("line_no")).count() == 0
        assert df.count() == 5003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_iptables(spark):
    rows = fw.parse_iptables(log(spark, [
        "Jan  5 10:00:01 gw kernel: DROP IN=eth0 OUT= MAC=x SRC=1.2.3.4 DST=10.0.0.1 LEN=60 PROTO=TCP SPT=1 DPT=22",
        "Jan  5 10:00:02 gw kernel: ACCEPT IN= OUT=eth1 SRC=1.2.3.4 DST=10.0.0.2 LEN=1 PROTO=ICMP", "noise",
    ])).collect()
    assert [(r.action, r.src_port, r.dst_port, r.interface) for r in rows] == [("deny", 1, 22, "eth0"), ("allow", None, None, "eth1")]


def test_fortinet(spark):
    rows = fw.parse_fortinet(log(spark, [
        'date=2024-01-01 time=10:00:00 devname="F W" srcip=1.1.1.1 dstip=2.2.2.2 dstport=80 action="deny" dstport=81 srcport=x',
        "src=3.3.3.3 status=blocked", "devname=only",
    ])).collect()
    assert (rows[0].timestamp, rows[0].dst_port, rows[0].src_port, rows[0].action) == ("2024-01-01 10:00:00", 81, None, "deny")
    assert (rows[1].src_ip, rows[1].timestamp, rows[1].action) == ("3.3.3.3", None, "deny") and len(rows) == 2


def test_paloalto(spark):
    cells = [str(i) for i in range(36)]
    cells[1], cells[7], cells[8], cells[12], cells[30] = "t", "1.1.1.1", "2.2.2.2", '"a, b"', "drop"
    bad = [*cells]
    bad[24] = "oops"
    rows = fw.parse_paloalto(log(spark, [",".join(cells), ",".join(bad), ",".join(cells[:30])])).collect()
    assert [(r.src_ip, r.rule, r.action, r.src_port, r.bytes_sent) for r in rows] == [("1.1.1.1", "a, b", "deny", 24, 31)]


def test_generic_csv_files_with_their_own_headers(spark, tmp_path):
    names = ["Src IP", "Dest IP", "dst-port", "Status", "Proto", "Event Time", "x"]
    roles = spark.range(1).select(fw.column_roles(F.array(*[F.lit(n) for n in names])).alias("r")).head().r
    assert roles == ["src_ip", "dst_ip", "dst_port", "action", "protocol", "timestamp", None]
    (tmp_path / "w.csv").write_text("date,src-ip,dst-ip,dst-port,action\nd,1.1.1.1,2.2.2.2,80,Dropped\nd,1.1.1.1,2.2.2.2,x,allow\n")
    (tmp_path / "v.csv").write_text('action,dst-port,dst-ip,src-ip,date\n"De ""ny"", x",81,4.4.4.4,3.3.3.3,d\nblock,9,4.4.4.4\n')
    rows = fw.read_generic_csv(spark, str(tmp_path)).orderBy(F.desc("file_path"), "line_no").collect()
    assert [(r.line_no, r.src_ip, r.dst_port, r.action) for r in rows] == [(2, "1.1.1.1", 80, "deny"), (2, "3.3.3.3", 81, "allow"), (3, None, 9, "deny")]
    assert rows[1].raw == 'De "ny", x,81,4.4.4.4,3.3.3.3,d'


def test_detect_and_parse_mixed(spark):
    rows = [("i", 1, "Jan  5 1:0:0 k: DROP IN=e OUT= SRC=1.1.1.1 DST=2.2.2.2 X PROTO=TCP"), ("f", 1, "type=traffic srcip=1.1.1.1"),
            ("p", 1, "Jan filterlog: 1,2"), ("w", 1, "date,src-ip"), ("w", 2, "d,1.1.1.1"), ("g", 1, "a,b"), ("g", 2, "1,2"), ("c", 1, "TRAFFIC" + "," * 34),
            *(("late", n, "noise") for n in range(1, 40)), ("late", 40, "type=traffic srcip=9.9.9.9")]
    df = spark.createDataFrame(rows, SCHEMAS["log_lines"])
    found = {r.file_path: r.log_format for r in fw.detect_formats(df).collect()}
    assert found == {"i": "iptables", "f": "fortinet_syslog", "p": "pfsense", "w": "windows_fw", "g": "generic_csv", "c": "paloalto_csv", "late": "fortinet_syslog"}
    loaded = {(r.file_path, r.log_format): r.total_entries for r in firewall.load_counts(fw.parse_detected(df)).collect()}
    assert loaded == {("i", "iptables"): 1, ("f", "fortinet_syslog"): 1, ("late", "fortinet_syslog"): 1, ("c", "paloalto_csv"): 1,
                      ("w", "windows_fw"): 1, ("g", "generic_csv"): 1}


def test_zeek_folder(spark, tmp_path):
    folder = tmp_path / "cap1"
    folder.mkdir()
    conn = {"ts": 1.5, "id.orig_h": "10.0.0.1", "id.orig_p": 5, "id.resp_h": "8.8.8.8", "id.resp_p": 53, "proto": "udp",
            "service": "modbus", "orig_bytes": 0, "orig_ip_bytes": 70, "resp_bytes": 9, "orig_pkts": 1, "resp_pkts": 2}
    (folder / "conn.log").write_text("#fields\n\n" + json.dumps(conn) + "\n{broken\n")
    (folder / "dns.log").write_text(json.dumps({"ts": "2024-01-01T00:00:00Z", "id.orig_h": "a", "id.resp_h": "b", "query": "q.com", "qtype": 16, "answers": ["1.1.1.1", "x"]}) + "\n")
    (folder / "http.log").write_text(json.dumps({"ts": 1, "method": "GET", "host": "h", "uri": "/", "resp_mime_types": ["text/html"]}) + "\n")
    (folder / "notice.log").write_text(json.dumps({"ts": 1, "note": "FTP::Cleartext", "src": "s", "dst": "d"}) + "\n")
    (folder / "weird.log").write_text(json.dumps({"ts": 1, "name": "odd"}) + "\n")
    (folder / "ssl.log").write_text(json.dumps({"ts": 1, "id.resp_p": 443, "server_name": ""}) + "\n")
    t = zeek.load_zeek(spark, str(tmp_path))
    row = t.connections.head()
    assert (row.capture, row.proto, row.bytes_out, row.bytes_in, row.packets, row.dst_port) == ("cap1", "UDP", 70, 9, 3, 53)
    assert t.connections.count() == 1 and t.ot_transactions.head().protocol == "MODBUS"
    assert [(r.src_ip, r.answer, r.qtype) for r in t.dns_responses.collect()] == [("b", "1.1.1.1", "16"), ("b", "x", "16")]
    assert t.dns_queries.head().ts == 1704067200.0
    assert t.http_requests.head().content_type == "text/html" and t.tls_handshakes.head().sni is None
    assert t.cleartext_creds.head().protocol == "FTP::Cleartext" and t.weird_events.head().name == "odd"


def test_s7_and_dnp3(spark):
    s7 = bytes.fromhex("0300001902f080") + b"2" + bytes([1, 0, 0, 0, 0, 0, 0x28, 0, 1])
    dnp = bytes.fromhex("056405c401000a0000000000c00d")
    rows = [("c", 1, 1.0, "a", "b", 6, 1, 102, bytearray(s7)), ("c", 2, 2.0, "a", "b", 6, 20000, 9, bytearray(dnp))]
    df = spark.createDataFrame(rows, "capture string, pkt_no bigint, ts double, src_ip string, dst_ip string, ip_proto int, src_port int, dst_port int, payload binary")
    got = {r.protocol: r for r in packets.ot_transactions(df).collect()}
    assert (got["S7comm"].function_name, got["S7comm"].pdu_type, got["S7comm"].is_control) == ("PLC-Stop", "Job", True)
    assert (got["DNP3"].function_name, got["DNP3"].is_control, got["DNP3"].is_write) == ("Cold-Restart", True, False)


def test_reports_and_listing(spark, tmp_path):
    base = tmp_path / "corpus"
    (base / "vendor").mkdir(parents=True)
    (base / "generated" / "summaries").mkdir(parents=True)
    (base / "vendor" / "a.md").write_text("one\ntwo")
    (base / "b.txt").write_text("x")
    (base / "c.bin").write_text("x")
    (base / "generated" / "summaries" / "b.md").write_text("s")
    found = reports.read_reports(spark, str(base))
    assert sorted((r.report_path, r.subdirectory, r.text) for r in found.collect()) == [("b.txt", "", "x"), ("vendor/a.md", "vendor", "one\ntwo")]
    have = inventory.file_inventory(spark, str(base)).select(F.col("relative_path").alias("object_path"))
    assert {r.report_path: r.has_summary for r in reports.list_reports(found, have).collect()} == {"b.txt": True, "vendor/a.md": False}
    entries = inventory.directory_entries(inventory.file_inventory(spark, str(base))).collect()
    assert [(e.name, e.type) for e in entries] == [("generated/", "directory"), ("vendor/", "directory"), ("b.txt", "file"), ("c.bin", "file")]
    meta = inventory.file_metadata(spark, str(base / "vendor" / "a.md")).head()
    assert (meta.name, meta.line_count, meta.size_bytes) == ("a.md", 2, 7)


def test_visible_text_and_character_references(spark, one):
    page = "<html><!-- c --><head><title>T&amp;x</title><script>var a='</p>';</script></head><body><nav>n</nav><p>Hi <b>you</b></p>&nbsp;</body></html>"
    df = spark.createDataFrame([(1, page)], "k int, html string")
    assert reports.html_reports(df, "k", "html").head().text == "T&x\nHi\nyou"
    text = "a&lt;b&gt; &#233;&#xE9;&#x1F600; &Eacute; &nosuch; & &amp;lt; &#0; &#xD800; AT&T &copy"
    assert one(reports.unescaped(F.lit(text))) == "a<b> éé\U0001F600 É &nosuch; & &lt; &#0; &#xD800; AT&T &copy"


def test_relative_paths_repeat_the_folder_name(spark, tmp_path):
    base = tmp_path / "reports" / "x y" / "reports"
    (base / "reports").mkdir(parents=True)
    (base / "a.txt").write_text("1")
    (base / "reports" / "b.txt").write_text("2")
    found = {r.report_path: r.subdirectory for r in reports.read_reports(spark, str(base)).collect()}
    assert found == {"a.txt": "", "reports/b.txt": "reports"}
    assert {r.relative_path for r in inventory.file_inventory(spark, str(base)).collect()} == set(found)


def test_stix_bundles(spark, tmp_path):
    def obj(tid, name, **more):
        return {"type": "attack-pattern", "name": name, "external_references": [{"source_name": "x"}, {"source_name": "mitre-attack", "external_id": tid, "url": "u"}],
                "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "command-and-control"}], **more}
    (tmp_path / "e.json").write_text(json.dumps({"objects": [obj("T1", "one"), obj("T1", "two"), obj("T2", "gone", revoked=True)]}, indent=1))
    (tmp_path / "i.json").write_text(json.dumps({"objects": [obj("T3", "ics"), obj("T4", "old", x_mitre_deprecated=True)]}))
    got = techniques.read_techniques(spark, {"enterprise": str(tmp_path / "e.json"), "ics": str(tmp_path / "i.json")}).collect()
    assert sorted((r.technique_id, r.name, r.tactics[0], r.matrix) for r in got) == [
        ("T1", "two", "Command And Control", "enterprise"), ("T3", "ics", "Command And Control", "ics")]


def test_precedence(spark):
    rows = [("common", 1, "inc", "a", "inc/a"), ("pillar", 0, "", "a", "a"), ("pillar", 0, "inc", "b", "inc/b"), ("common", 1, "", "b", "b")]
    df = spark.createDataFrame(rows, SCHEMAS["inventory"])
    assert {r.filename: (r.root, r.workspace) for r in inventory.resolve_files(df).collect()} == {"a": ("pillar", ""), "b": ("pillar", "inc")}
    assert [r.root for r in inventory.workspace_files(df, "inc", include_common=False).collect()] == ["pillar"]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    sinks.export_results({"one": df, "two": df}, str(tmp_path / "exports"), "t1", "parquet")
    back = spark.read.parquet(str(tmp_path / "exports"))
    assert {(r.source_tool, r.tag) for r in back.select("source_tool", "tag").distinct().collect()} == {("one", "t1"), ("two", "t1")}
    with pytest.raises(ValueError):
        sinks.write_result(df, str(tmp_path / "x"), "pdf")


def test_streams(spark, tmp_path):
    schema = "event_time timestamp, src_ip string, dst_ip string, action string, line string"
    rows = [(f"2024-01-01 0{h}:10:00", "a", "b", "deny", "x ERROR y") for h in (0, 0, 1, 5)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "t string, src_ip string, dst_ip string, action string, line string").selectExpr(
        "cast(t as timestamp) event_time", "src_ip", "dst_ip", "action", "line").write.parquet(str(source))
    for name, make in (("deny", windows.deny_stream), ("freq", lambda d: windows.frequency_stream(d, "LOGLEVEL"))):
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = windows.start(make(stream), str(tmp_path / name), str(tmp_path / (name + "-cp")), once=True)
        query.awaitTermination()
        out = spark.read.parquet(str(tmp_path / name))
        value = "denies" if name == "deny" else "cnt"
        assert sorted(r[value] for r in out.collect()) == [1, 2]


def test_dns_and_tls_messages_of_every_length(spark):
    from tracesift.plans.bindings import DNS_CASES, TLS_CASES

    def payloads(cases, proto):
        rows = []
        for no, case in enumerate(cases):
            whole = bytes.fromhex(case[0])
            rows += [("c", float(no), proto, 53, 40000, bytearray(whole[:n])) for n in range(1, len(whole) + 1)]
        return spark.createDataFrame(rows, "capture string, ts double, ip_proto int, src_port int, dst_port int, payload binary").selectExpr("*", "'a' AS src_ip", "'b' AS dst_ip")

    dns = payloads(DNS_CASES, 17)
    found = packets.dns_messages(dns).collect()
    assert len(found) == dns.count()
    for no, (_, kind, query, qtype, answer, code) in enumerate(DNS_CASES):
        sound = [(r.kind, r.query, r.qtype, r.answer, r.rcode) for r in found if r.ts == no and r.kind != "malformed"]
        assert all(s[1] == query for s in sound)
        assert not sound if kind == "malformed" else sound[-1] == (kind, query, qtype, answer, code)
    assert packets.dns_queries(dns).where("qtype = '16'").count() == 1 and packets.dns_responses(dns).count() > 3
    hellos = packets.tls_client_hellos(payloads(TLS_CASES, 6)).collect()
    # a hello that ends where its extensions would begin is whole too
    assert {(r.sni, r.malformed) for r in hellos if r.ts == 0} == {(None, True), (None, False), ("host7.example.net", False)}
    whole = {no: sum(not r.malformed for r in hellos if r.ts == no) for no in range(len(TLS_CASES))}
    assert whole == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0}


def test_mixed_files_are_parsed_without_shuffling_their_lines(spark):
    rows = [("a", n, f"kernel: x SRC=10.0.0.{n} DST=10.0.1.1 ") for n in range(1, 9)] + [("b", n, f'type=traffic srcip=10.1.0.{n} dstport=5') for n in range(1, 9)]
    parsed = fw.parse_detected(spark.createDataFrame(rows, SCHEMAS["log_lines"]))
    assert "hashpartitioning" not in parsed._jdf.queryExecution().executedPlan().toString()
    assert {(r.file_path, r.log_format) for r in parsed.collect()} >= {("b", "fortinet_syslog")}


def test_listing_takes_few_tasks(spark, tmp_path):
    """Reports in many folders are listed by tasks of many folders each."""
    for no in range(40):
        (tmp_path / f"v{no}").mkdir()
        (tmp_path / f"v{no}" / "r.txt").write_text(f"report {no}")
    context, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    context.setJobGroup("listing", "listing")
    try:
        found = reports.read_reports(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listing")]
    tasks = [context.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism < 40
    assert spark.conf.get(name) == before
    assert found.count() == 40


def test_fortinet_lookups_are_compiled(spark):
    """No lambda looks a key up, and no generated method exceeds the 8,000 bytes up to which the JVM compiles."""
    entries = fw.parse_fortinet(log(spark, ['date=2024-01-01 time=10:00:00 src=10.0.0.1 src="10.0.0.2" dstip=8.8.8.8 action="deny"', "dstip=1.1.1.1"]))
    assert [(r.timestamp, r.src_ip, r.dst_ip, r.action, r.dst_port) for r in entries.collect()] == [("2024-01-01 10:00:00", "10.0.0.2", "8.8.8.8", "deny", None)]
    plan = entries._jdf.queryExecution().executedPlan()
    assert "lambda" not in plan.toString()
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(plan)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000


def test_paloalto_cells_are_compiled(spark):
    cells = ["1", "2024-01-01", *["x"] * 5, "10.0.0.1", '"8.8.8.8"', *["y"] * 15, "1024", "443", *["z"] * 3, "tcp", "deny", "10", "", "e", "f"]
    broken = [*cells[:24], "n/a", *cells[25:]]
    entries = fw.parse_paloalto(log(spark, [",".join(cells), ",".join(broken), ",".join(cells[:34]), None]))
    assert [(r.line_no, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.action, r.bytes_recv) for r in entries.collect()] == [
        (1, "10.0.0.1", "8.8.8.8", 1024, 443, "deny", None)]
    plan = entries._jdf.queryExecution().executedPlan()
    assert "lambda" not in plan.toString()
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(plan)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
