"""Hand-computed and brute-force cases."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracesift.operators import firewall, flows, graph, hunts, intel, logs, netops, ot, posture, ranking
from tracesift.plans import triage
from tracesift.schemas import SCHEMAS, TrafficTables, struct_of


def table(spark, name, rows):
    """Rows given as dicts; missing columns are null."""
    names = [f.name for f in struct_of(name).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[name])


def conn(src, dst, port, ts, **more):
    return {"src_ip": src, "dst_ip": dst, "dst_port": port, "ts": float(ts), "proto": "TCP", "packets": 1, "bytes_out": 1, "bytes_in": 0, **more}


# --- building blocks -----------------------------------------------------------------------


def test_gap_statistics_equal_brute_force_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot", rng.uniform(0, 40000)) for _ in range(3000)] + [("cold", float(i * i)) for i in range(40)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, ts double")
    got = {r.k: r for r in ranking.gap_statistics(df, ["k"], "ts", 100.0).collect()}
    for key in ("hot", "cold"):
        times = sorted(t for k, t in rows if k == key)
        gaps = [b - a for a, b in zip(times, times[1:])]
        assert got[key].n == len(times)
        assert got[key].mean_gap == pytest.approx(statistics.fmean(gaps), rel=1e-9)
        assert got[key].std_gap == pytest.approx(statistics.pstdev(gaps), rel=1e-9)
        assert got[key].max_gap == pytest.approx(max(gaps))
    assert got["one"].mean_gap is None and got["one"].std_gap is None


def test_value_changes_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(i * 37), rng.choice(["x", "y"])) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, ts double, v string")
    want, last = set(), {}
    for k, ts, v in rows:
        if k in last and last[k] != v:
            want.add((k, ts, last[k], v))
        last[k] = v
    got = {tuple(r) for r in ranking.value_changes(df, ["k"], "v", bucket_seconds=200.0).collect()}
    assert got == want


def test_totals_with_top_n(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(300)], "k int, n int")
    rows = ranking.with_group_totals(df, 4, [F.desc("n"), F.asc("k")], {"s": F.sum("n"), "c": F.count(F.lit(1))}).collect()
    assert [(r.k, r.n) for r in rows] == [(6, 6), (13, 6), (20, 6), (27, 6)]
    assert {(r.s, r.c) for r in rows} == {(sum(i % 7 for i in range(300)), 300)}


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in ranking.first_per_key(df, ["k"], "o").collect()) == [("a", 1, "y"), ("b", 1, "z")]


# --- logs -----------------------------------------------------------------------------------


def lines(spark, texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts, 1)], SCHEMAS["log_lines"])


def test_frequency_ties_go_to_the_first_seen(spark):
    df = lines(spark, ["x 2.2.2.2", "x 1.1.1.1", "x 1.1.1.1", "x 2.2.2.2", "x 3.3.3.3"])
    assert [(r.value, r.cnt) for r in logs.value_frequency(df, "IP", 2).collect()] == [("2.2.2.2", 2), ("1.1.1.1", 2)]
    assert logs.frequency_totals(df, "IP", 3).head() == (3, 3)


def test_search_with_context_and_invert(spark):
    df = lines(spark, ["a", "ERROR one ", "b", "c", "error two"])
    hits = {r.line_number: r for r in logs.search(df, "error", context_lines=1).collect()}
    assert (hits[2].text, hits[2].context_before, hits[2].context_after) == ("ERROR one", ["a"], ["b"])
    assert hits[5].context_after == []
    assert logs.search_totals(df, "ERR.R", "regex", 2, invert=True).head() == (5, 3, True)
    assert [r.has_more for r in logs.read_segment(df, 3, 2).collect()] == [False, False]


def test_discovery_sample_counts_non_blank_lines(spark):
    df = lines(spark, ["", "GET 1", "  ", "GET 2", "other", "GET 3"])
    top = logs.signature_discovery(df, 1, 3).head()
    assert (top.signature, top.cnt, top.lines_processed, top.unique_patterns, top.example) == ("<METHOD> <NUM>", 2, 3, 2, "GET 1")


# --- firewall ---------------------------------------------------------------------------------


def test_port_scan_threshold(spark):
    rows = [{"file_path": "f", "line_no": i, "src_ip": s, "dst_ip": "d", "dst_port": 100 + i, "action": "deny"} for s, n in (("nine", 9), ("ten", 10)) for i in range(n)]
    got = firewall.port_scans(table(spark, "fw_entries", rows)).collect()
    assert [(r.src_ip, r.port_count, r.sample_ports[0]) for r in got] == [("ten", 10, 100)]


def test_time_range_is_first_and_last_row(spark):
    rows = [{"file_path": "f", "line_no": i, "timestamp": t, "src_ip": "s", "action": "allow"} for i, t in enumerate(["m", "z", "a"], 1)]
    r = firewall.summary(table(spark, "fw_entries", rows)).head()
    assert (r.first_row_ts, r.last_row_ts, r.total_bytes) == ("m", "a", 0)


# --- hunts -------------------------------------------------------------------------------------


def test_beacon_thresholds(spark):
    rows = []
    for dst, jitter, n in (("8.8.8.1", 0, 10), ("8.8.8.2", 0, 9), ("8.8.8.3", 5, 30), ("8.8.8.4", 25, 30), ("10.0.0.9", 0, 30)):
        rows += [conn("10.0.0.1", dst, 443, 1000 + 60 * i + (jitter if i % 2 else 0)) for i in range(n)]
    got = {r.dst_ip: r.confidence for r in hunts.beacons(table(spark, "connections", rows), bucket_seconds=120).collect()}
    # alternating gaps of 65 and 55 s deviate by 5 s, 8.3 % of a minute
    assert got == {"8.8.8.1": "HIGH", "8.8.8.3": "MEDIUM"}


def test_exfiltration_counts_reverse_and_same_row_bytes(spark):
    big = 1048576
    rows = [conn("10.0.0.1", "8.8.8.1", 1, 1, bytes_out=big, bytes_in=big // 20), conn("8.8.8.1", "10.0.0.1", 2, 2, bytes_out=big // 20),
            conn("10.0.0.1", "8.8.8.2", 1, 1, bytes_out=big, bytes_in=big // 5), conn("10.0.0.1", "8.8.8.3", 1, 1, bytes_out=big - 1)]
    got = hunts.asymmetric_outbound(flows.conversations(table(spark, "connections", rows))).collect()
    assert [(r.dst_ip, r.bytes_in, r.ratio) for r in got] == [("8.8.8.1", 2 * (big // 20), 10.0)]


def test_lateral_and_scan_thresholds(spark):
    rows = [conn("10.0.0.1", f"10.0.1.{i}", 22, i) for i in range(6)] + [conn("10.0.0.2", f"10.0.1.{i}", 22, i) for i in range(5)]
    rows += [conn("10.0.0.3", f"10.0.1.{i}", 999, i) for i in range(4)]
    convs = flows.conversations(table(spark, "connections", rows))
    assert {r.src_ip: r.potential_scan for r in hunts.lateral_movement(convs).collect()} == {"10.0.0.1": True, "10.0.0.2": False}
    assert {r.src_ip for r in hunts.horizontal_scans(convs).collect()} == {"10.0.0.1", "10.0.0.2"}


def test_dns_thresholds(spark):
    rows = [{"query": f"s{i}.{base}", "src_ip": "a", "qtype": "A"} for base, n in (("b20.com", 20), ("b21.com", 21)) for i in range(n)]
    rows += [{"query": q, "src_ip": "a", "qtype": "16"} for q, n in (("q50.io", 50), ("q51.io", 51)) for _ in range(n)]
    rows += [{"query": "abcdefghij.x.com", "qtype": "A"}, {"query": "abcdefghijkl.x.com", "qtype": "A"}, {"query": "aaaaaaaaaaaa.x.com", "qtype": "A"}]
    df = table(spark, "dns_queries", rows)
    assert [r.base_domain for r in hunts.tunnel_candidates(df).collect()] == ["b21.com"]
    assert [r.query for r in hunts.frequent_names(df).collect()] == ["q51.io"]
    assert [r.label for r in hunts.dga_candidates(df).collect()] == ["abcdefghijkl"]
    assert sum(r.cnt for r in hunts.txt_queries(df).collect()) == 101


def test_ports_severity_ladder(spark):
    def level(*ports):
        convs = flows.conversations(table(spark, "connections", [conn("10.0.0.1", "10.0.0.2", p, 1) for p in ports]))
        return hunts.ports_severity(hunts.port_usage(convs)).head()[0]
    assert (level(502, 4444), level(4444), level(80)) == ("high", "critical", "info")
    convs = flows.conversations(table(spark, "connections", [conn("10.0.0.1", "10.0.0.2", 8888, 1)]))
    assert {r.category for r in hunts.port_usage(convs).collect()} == {"standard", "suspicious"}


def test_long_connection_bounds(spark):
    rows = [c for n in (299, 300, 301) for c in (conn("10.0.0.1", f"8.8.8.{n - 298}", 1, 1000), conn("10.0.0.1", f"8.8.8.{n - 298}", 1, 1000 + n))]
    convs = flows.conversations(table(spark, "connections", rows))
    assert flows.long_connections(convs).count() == 2 and flows.long_connections(convs, inclusive=False).count() == 1


# --- network health -------------------------------------------------------------------------------


def test_update_bursts_equal_brute_force(spark):
    rng = random.Random(9)
    times = sorted(rng.uniform(0, 300) if i % 3 else rng.uniform(100, 108) for i in range(400))
    rows = [{"protocol": "OSPF", "msg_type": "LSUpdate", "ts": t} for t in times]
    want = sorted(a for a, b in zip(times, times[10:]) if b - a <= 5)
    got = sorted(r.burst_start for r in netops.ospf_update_bursts(table(spark, "control_plane", rows)).collect())
    assert got == want


def test_neighbor_gaps(spark):
    rows = [{"protocol": "OSPF", "msg_type": "Hello", "src": s, "dst": "z", "ts": t} for s, gap in (("a", 40.0), ("b", 41.0), ("c", 121.0)) for t in (0.0, gap)]
    got = {r.ip_a: r.dead for r in netops.ospf_neighbor_gaps(table(spark, "control_plane", rows)).collect()}
    assert got == {"b": False, "c": True}


def test_health_grade_uses_a_source_that_marks_retransmissions(spark):
    df = spark.createDataFrame([(6, 2, 1, i < 3) for i in range(100)], "ip_proto int, tcp_flags int, tcp_window int, retransmit boolean")
    r = netops.tcp_health(df).head()
    assert (r.retransmissions, r.grade, r.syn) == (3, "DEGRADED", 100)


# --- zones -------------------------------------------------------------------------------------------


def test_zones_and_ties(spark):
    rows = [conn("10.0.0.1", "10.0.0.2", 502, 1), conn("10.0.0.2", "10.0.0.3", 502, 1), conn("10.0.1.1", "10.0.1.2", 443, 1), conn("8.8.8.8", "10.0.1.2", 443, 1)]
    zones = ot.host_zones(flows.conversations(table(spark, "connections", rows)))
    assert {r.host: r.zone for r in zones.collect()} == {
        "10.0.0.1": "SCADA", "10.0.0.2": "SCADA", "10.0.0.3": "CONTROL/FIELD", "10.0.1.1": "Corporate", "10.0.1.2": "DMZ", "8.8.8.8": "External"}
    assert {r.network: r.zone for r in ot.network_zones(zones).collect()}["10.0.1"] == "Corporate"


# --- indicators -----------------------------------------------------------------------------------------


def report(spark, text):
    return table(spark, "reports", [{"report_path": "r", "text": text}])


@pytest.mark.parametrize(
    "text,kind,value,defanged",
    [("at 1.2.3.4 now", "ip", "1.2.3.4", False), ("at 1[.]2[.]3[.]4 now", "ip", "1.2.3.4", True), ("see CVE-2024-12345", "cve", "CVE-2024-12345", False),
     ("uses T1059.001", "mitre_technique", "T1059.001", False), ("h " + "a" * 64, "hash_sha256", "a" * 64, False)],
)
def test_extraction(spark, text, kind, value, defanged):
    got = intel.extract_indicators(report(spark, text), [kind]).collect()
    assert [(r.value, r.defanged, r.confidence) for r in got] == [(value, defanged, "low")]


def test_extraction_context_and_duplicates(spark):
    text = "x1.2.3.4 " + "p" * 200 + "\n1.2.3.4 mid 5.6.7.8 " + "q" * 200 + " 1.2.3.4"
    got = {r.value: r for r in intel.extract_indicators(report(spark, text), ["ip"]).collect()}
    assert set(got) == {"1.2.3.4", "5.6.7.8"}
    for value in got:
        at = text.index("\n" + value) + 1 if value == "1.2.3.4" else text.index(value)
        assert got[value].context == text[max(0, at - 150) : at + len(value) + 150].replace("\n", " ").strip()[:300]
    assert intel.extract_indicators(report(spark, "")).count() == 0


@pytest.mark.parametrize("text, kind, value", [
    ("x" * 40000 + ".ru a" + "b" * 30 + " " + "ab" * 16, "hash_md5", "ab" * 16),
    ("see\u00a0(10[.]0[.]0[.]7),", "ip", "10[.]0[.]0[.]7"),
    ("end. at hxxps[:]//a-b.c/d?e=f.", "url", "hxxps[:]//a-b.c/d?e=f."),
])
def test_indicators_inside_words(spark, text, kind, value):
    """Only words that may hold an indicator are searched, long ones and ones without a digit among them."""
    (row,) = intel.extract_indicators(report(spark, text), [kind]).collect()
    assert (row.raw_value, row.start) == (value, text.index(value) + 1)


def test_indicators_without_context(spark):
    df = report(spark, "x1.2.3.4 1[.]2[.]3[.]4 a@b.org " * 3)
    whole, slim = intel.extract_indicators(df), intel.extract_indicators(df, context=False)
    assert "context" not in slim.columns and sorted(slim.collect()) == sorted(whole.drop("context").collect())


def test_words_that_may_hold_indicators_are_few(spark):
    """Prose is passed over: of these words only the last three are searched."""
    df = report(spark, "Plain words, end. " * 50 + "(x.y) T1001 " + "f" * 32)
    pieces = df.select(F.size(intel._cut_before(F.col("text"), intel._CANDIDATE)).alias("n")).head().n
    assert pieces - 1 == 3


def test_correlator_indicators_inside_words(spark):
    df = report(spark, "mac AA-bb-cc-dd-ee-ff, DPORT =\n 443 dst.port: 8080, xport:70000 " + "AB" * 16)
    got = sorted((r.ioc_type, r.value) for r in intel.extract_correlator_indicators(df).collect())
    assert got == [("mac", "AA-BB-CC-DD-EE-FF"), ("md5", "ab" * 16), ("port", "443"), ("port", "8080")]


def test_substring_match_equals_brute_force(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("ab.c") for _ in range(rng.randint(3, 14))) for _ in range(120)]
    values = list({"".join(rng.choice("ab.c") for _ in range(rng.randint(2, 6))) for _ in range(40)})
    got = intel.names_containing(spark.createDataFrame([(n,) for n in names], "q string"), "q", spark.createDataFrame([(v,) for v in values], "ioc_value string"))
    assert {tuple(r) for r in got.select("name", "ioc_value").collect()} == {(n, v) for n in names for v in values if v in n}


def test_port_evidence_keeps_the_rest_as_a_count(spark):
    convs = flows.conversations(table(spark, "connections", [conn("10.0.0.1", f"10.1.{i // 200}.{i % 200}", 4444, 1) for i in range(25)]))
    iocs = spark.createDataFrame([("port", "4444"), ("mac", "AA")], "ioc_type string, value string")
    evidence = intel.port_matches(iocs, convs)
    assert intel.match_counts(evidence).head().match_count == 25
    assert [r.detail for r in evidence.where("source = 'truncated'").collect()] == ["... 5 more matches"]
    assert [r.ioc_type for r in intel.unmatched(iocs, evidence).collect()] == ["mac"]


# --- techniques -------------------------------------------------------------------------------------------

DIM = [("T1", "One", ["Execution", "Impact"], "e", ""), ("T2", "Two", ["Initial Access", "Command And Control"], "e", ""), ("T3", "Three", ["Initial Access"], "e", "")]


def step(tid, tactic, *leads):
    return (tid, "", tactic, list(leads))


def reconciled(spark, mappings, *paths):
    maps = spark.createDataFrame([("r", *m, "high", "ctx") for m in mappings] or [("r", "", "", "", "", "")], "report_path string, technique_id string, technique_name string, tactic string, confidence string, report_context string")
    flow = spark.createDataFrame([("r", i, f"p{i}", list(s)) for i, s in enumerate(paths)] or [("x", 0, "p", [])], SCHEMAS["attack_paths"])
    dim = spark.createDataFrame(DIM, SCHEMAS["techniques"])
    got = intel.reconcile_mappings(maps, flow, dim).where("report_path = 'r'").collect()
    return {(r.technique_id, r.tactic): r for r in got}


def test_reconcile_attach_backfill_promote_orphan(spark):
    got = reconciled(spark, [("T1", "n", "Execution"), ("T2", "", "")], [step("T1", "Execution", "T9"), step("T2", "Command And Control")], [step("T1", "Impact")])
    assert got["T1", "Execution"].context_paths == ["p0"]
    assert got["T1", "Impact"].confidence == "inferred" and got["T1", "Impact"].technique_name == "One"
    assert ("T2", "") not in got and got["T2", "Command And Control"].context_paths == ["p0"] and got["T2", "Command And Control"].technique_name == "Two"
    assert got["T9", ""].technique_name == "(non-ATT&CK ID)" and got["T9", ""].mitre_validated is False and len(got) == 4


def test_reconcile_casing_and_mismatch(spark):
    got = reconciled(spark, [("T2", "n", "command and control"), ("T1", "n", "Discovery"), ("T1", "n", "Impact")])
    assert got["T2", "Command And Control"].tactic_mismatch is False
    assert got["T1", "Discovery"].tactic_mismatch is True and got["T1", "Impact"].tactic_mismatch is False


def test_tactic_repair(spark):
    paths = spark.createDataFrame([("r", 0, "p", [step("T2", "Initial Access"), step("T2", "Initial Access"), step("T3", "Initial Access"), step("T1", "Execution")])], SCHEMAS["attack_paths"])
    got = intel.repair_tactics(intel.path_steps(paths), spark.createDataFrame(DIM, SCHEMAS["techniques"])).orderBy("step_no").collect()
    assert [(r.tactic, r.reassigned) for r in got] == [("Initial Access", False), ("Command and Control", True), ("Initial Access", False), ("Execution", False)]


def test_chunk_merge(spark):
    ioc = lambda v, fp=False: ("ip", v, "high", "low", "", [], fp)
    tech = lambda t, tactic: (t, "n", tactic, "high", "")
    path = lambda pid: (pid, "", [step("T1", "Execution")])
    rows = [("r", 0, [ioc("A.b"), ioc("x", True)], [tech("T1", "Execution")], {}, ([path("p1")], ["T1"], [])),
            ("r", 1, [ioc("a.B"), ioc("c")], [tech("T1", "Impact"), tech("T1", "Execution"), tech("", "x")], {"k": "v"}, ([path("p1"), path("p2")], ["T1", "T2"], ["T3"]))]
    df = spark.createDataFrame(rows, SCHEMAS["chunks"])
    assert sorted(r.value for r in intel.merged_indicators(df).collect()) == ["A.b", "c"]
    assert intel.merged_techniques(df).count() == 2
    assert [(r.path_no, r.path_id) for r in intel.merged_paths(df).orderBy("path_no").collect()] == [(1, "p1"), (2, "p2")]
    assert intel.merged_points(df).count() == 3
    assert [tuple(r) for r in intel.merged_metadata(df).collect()] == [("r", "k", "v")]


# --- graph ---------------------------------------------------------------------------------------------------


def layers_by_hand(nodes, links):
    placed, level = {}, 0
    while True:
        left = [n for n in nodes if n not in placed]
        free = [n for n in left if not any(b == n and a in left for a, b in links)]
        if not free:
            return placed | {n: level for n in left}
        placed |= {n: level for n in free}
        level += 1


def test_layers_equal_brute_force(spark):
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(14)]
    links = {(f"n{a}", f"n{b}") for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(18)) if a < b} | {("n12", "n3"), ("n3", "n12")}
    edges = spark.createDataFrame([("r", *e) for e in links], "report_path string, source string, target string")
    every = spark.createDataFrame([("r", n) for n in nodes], "report_path string, node string")
    got = {r.node: r.layer for r in graph.layers(edges, every).collect()}
    assert got == layers_by_hand(nodes, links)


# --- posture ------------------------------------------------------------------------------------------------------


def test_assessment_metrics(spark):
    control = lambda n, evidence, flag=False: (n, "preventive", "strong", evidence, flag)
    rows = [
        {"assessment_id": "a", "attack_type": "ransomware", "stage_no": i, "name": n, "stage_present": True, "controls": c, "assumptions": []}
        for i, (n, c) in enumerate([
            ("Initial Access", [control("mail", "tested"), control("edr", "claimed")]), ("Execution", [control("edr", "benchmark")]),
            ("Privilege Escalation", [control("pam", "tested", True)]), ("Impact/Action on Objective", [control("backup", "none")])])
    ]
    df = table(spark, "stages", rows)
    r = posture.assessment_metrics(df).head()
    assert (r.structural_completeness, r.evidence_strength, r.assumption_density) == (1.0, 0.6, 0.0)
    assert [(r.control_name, r.uses) for r in posture.duplicate_controls(df).collect()] == [("edr", 2)]
    assert posture.independence_violations(df).count() == 1 and posture.missing_required(df).count() == 0


def test_gaps(spark):
    controls = table(spark, "scenario_controls", [
        {"scenario_id": "s", "control_id": c, "control_type": t, "implementation_status": s, "bypass_difficulty": b}
        for c, t, s, b in (("1", "network", "implemented", "high"), ("2", "data", "partial", "medium"), ("3", "data", "implemented", "low"))])
    events = table(spark, "scenario_events", [
        {"scenario_id": "s", "event_id": e, "sequence_order": n, "blocking_controls": b, "detecting_controls": d}
        for e, n, b, d in (("e1", 1, ["1"], []), ("e2", 2, [], ["2"]), ("e3", 3, [], []))])
    r = posture.gap_totals(controls, events).head()
    assert (r.unprotected_events, r.weak_controls, r.easy_bypass, r.weakest_event, r.total_issues) == (2, 1, 1, "e3", 4)
    assert {x.event_id: x.protection for x in posture.event_protection(events).collect()} == {"e1": "PROTECTED", "e2": "DETECT ONLY", "e3": "UNPROTECTED"}
    cover = {x.layer: (x.control_count, x.partial) for x in posture.defense_coverage(controls).collect()}
    assert len(cover) == 7 and cover["data"] == (2, 1) and cover["identity"] == (0, 0)


# --- composed reports -----------------------------------------------------------------------------------------------


def test_reports_build_and_run(spark):
    t = TrafficTables(
        connections=table(spark, "connections", [conn("10.0.0.1", "8.8.8.8", 443, i * 60) for i in range(12)]),
        dns_queries=table(spark, "dns_queries", [{"query": "a.b.com", "src_ip": "10.0.0.1", "qtype": "A"}]),
        dns_responses=table(spark, "dns_responses", []), tls_handshakes=table(spark, "tls_handshakes", []),
        packets=table(spark, "packets", []), ot_transactions=table(spark, "ot_transactions", []),
        cleartext_creds=table(spark, "cleartext_creds", []), control_plane=table(spark, "control_plane", []),
    )
    assert triage.security_triage(t, persist=True)["beacons"].count() == 1
    assert triage.industrial_report(t)["protocols"].count() == 0
    assert triage.operations_report(t)["dns_unanswered"].head().query == "a.b.com"


# --- ranks ---------------------------------------------------------------------------------


def test_numbered_equals_row_number_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else None if i % 7 == 0 else f"k{i % 11}", (i * 7919) % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {(r["k"], r["v"]): r["rank"] for r in ranking.numbered(df, ["k"], F.desc("v")).collect()}
    by_key = {}
    for k, v in rows:
        by_key.setdefault(k, []).append(v)
    assert got == {(k, v): i for k, vs in by_key.items() for i, v in enumerate(sorted(vs, reverse=True), 1)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join these few rows again
    try:
        spread = ranking.placed(df, ["k"], F.asc("v")).where("k = 'hot'")
        assert spread.select("_bucket").distinct().count() > 1
        ranked = ranking.numbered(df, ["k"], F.desc("v"))
        assert {(r["k"], r["v"]): r["rank"] for r in ranked.collect()} == got
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in ranking.numbered(df, [], F.asc("v")).orderBy("v").collect()] == list(range(1, 5001))
    assert ranking.numbered(df.limit(0), ["k"], F.asc("v")).count() == 0


def test_matches_in_a_text_with_very_many_hits(spark):
    words = [f"w{i} 10.{i % 7}.0.{i % 200}\n" if i % 3 else f"{'x' * (i % 90)} évil.example.com " for i in range(75_000)]
    text = "".join(words)
    reports = spark.createDataFrame([("r", text), ("none", "nothing here"), ("empty", ""), ("null", None)], "report_path string, text string")
    got = {r.value: (r.start, r.context) for r in intel.extract_indicators(reports, ["ip"]).where("report_path = 'r'").collect()}
    import re
    for value in ("10.1.0.1", "10.3.0.150", "10.6.0.199"):
        found = re.search(rf"(?<![\d.]){re.escape(value)}(?![\d.])", text)
        if found is None:
            assert value not in got
            continue
        around = text[max(0, found.start() - 150) : found.end() + 150].replace("\n", " ").strip()[:300]
        assert got[value] == (found.start() + 1, around)
    assert len(got) > 500


def test_names_containing_equals_brute_force(spark):
    rng = random.Random(12)
    names = ["".join(rng.choice("ab.cé") for _ in range(rng.randrange(1, 40))) for _ in range(300)] + ["WWW.Evil.com", "", None, "hot.example.com"]
    names += [f"h{i}.hot.example.com" for i in range(200)]
    values = {"".join(rng.choice("ab.cé") for _ in range(rng.randrange(1, 7))) for _ in range(80)} | {"evil.com", "example.com", "zzz.nowhere", "a", "é.", ""}
    df = spark.createDataFrame([(n,) for n in names], "text string")
    made = intel.names_containing(df, "text", spark.createDataFrame([(v,) for v in values], "ioc_value string"))
    got = [(r["name"], r.ioc_value) for r in made.collect()]
    want = {(n.lower(), v) for n in names if n for v in values if v and v in n.lower()}
    assert len(got) == len(set(got)) and set(got) == want


def test_update_bursts_of_a_storm(spark):
    rng = random.Random(13)
    times = sorted([100 + rng.randrange(5000) / 5000 for _ in range(100_000)] + [rng.randrange(2000) / 4 for _ in range(500)] + [50.0] * 25)
    df = spark.createDataFrame([(t,) for t in times], "ts double").selectExpr("'c' AS capture", "'OSPF' AS protocol", "'LSUpdate' AS msg_type", "ts")
    want = sorted((a, b - a) for a, b in zip(times, times[10:]) if b - a <= 5)
    got = sorted((r.burst_start, r.span) for r in netops.ospf_update_bursts(df).collect())
    assert got == want


def test_events_of_a_hot_bucket_near_report_times(spark):
    rng = random.Random(14)
    events = [(1000.0 + rng.random() * 200, f"h{i % 300}") for i in range(4000)] + [(rng.random() * 20_000, f"h{i % 7}") for i in range(2000)]
    marks = [("a", 1100.0), ("a", 1150.0), ("a", 9000.0), ("b", 950.0), ("c", 99_999.0)]
    made = intel.near_report_times(spark.createDataFrame(events, "ts double, src_ip string"), spark.createDataFrame(marks, "report_path string, ts double"))
    got = {(r.report_path, r.src_ip): (r.events, r.first_seen, r.last_seen) for r in made.collect()}
    want = {}
    for report in "abc":
        for t, host in events:
            if any(r == report and abs(t - m) <= 300 for r, m in marks):
                want.setdefault((report, host), []).append(t)
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()}


def test_flows_of_a_hot_source_and_hits_of_a_long_report_are_numbered(spark):
    rng = random.Random(15)
    rows = [conn("10.0.0.1" if i % 3 else f"10.0.1.{i % 20}", f"192.168.{i % 9}.{i % 250}", rng.choice([22, 445, 3389]), i) for i in range(3000)]
    convs = flows.conversations(table(spark, "connections", rows))
    got = {}
    for r in hunts.lateral_flows(convs).collect():
        got.setdefault(r.src_ip, []).append((r.flow_no, r.dst_ip, r.dst_port))
    for source, found in got.items():
        want = sorted({(r["dst_ip"], r["dst_port"]) for r in rows if r["src_ip"] == source})
        assert sorted(found) == [(no, *flow) for no, flow in enumerate(want, 1)]
    text = "\n".join("a Needle here" if i % 2 else "nothing" for i in range(5000))
    reports = spark.createDataFrame([("r", "n", "s", text), ("q", "n", "s", "needle")], "report_path string, name string, subdirectory string, text string")
    hits = sorted((r.report_path, r.hit_no, r.match) for r in intel.search_reports(reports, "needle").collect())
    assert hits == [("q", 1, "Line 1: needle")] + [("r", no, f"Line {2 * no}: a needle here") for no in range(1, 2501)]


def test_layers_of_a_long_chain_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "_TARGETS", 7)
    writes = []
    monkeypatch.setattr(graph, "written_once", lambda df, own=graph.written_once: writes.append(1) or own(df))
    chain = [("chain", f"n{i:03}", f"n{i + 1:03}") for i in range(119)]
    hub = [("hub", "h", f"t{i}") for i in range(40)] + [("hub", "t3", "h2")] + [("hub", "h2", f"u{i}") for i in range(20)]
    ring = [("ring", "a", "b"), ("ring", "b", "c"), ("ring", "c", "b"), ("all", "x", "y"), ("all", "y", "x")]
    got = {(r.report_path, r.node): r.layer for r in graph.layers(spark.createDataFrame(chain + hub + ring, "report_path string, source string, target string")).collect()}
    want = {("chain", f"n{i:03}"): i for i in range(120)}
    want |= {("hub", "h"): 0, ("hub", "h2"): 2} | {("hub", f"t{i}"): 1 for i in range(40)} | {("hub", f"u{i}"): 3 for i in range(20)}
    want |= {("ring", "a"): 0, ("ring", "b"): 1, ("ring", "c"): 1, ("all", "x"): 0, ("all", "y"): 0}
    assert got == want
    assert len(writes) <= 12  # a tenth of the depth


def test_layers_by_rows_and_by_peels(spark, monkeypatch):
    rng = random.Random(16)
    graphs = {f"r{g}": {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(4 + 3 * g)} for g in range(5)}
    edges = spark.createDataFrame([(g, *e) for g, links in graphs.items() for e in links], "report_path string, source string, target string")
    want = {(g, n): layer for g, links in graphs.items() for n, layer in layers_by_hand(sorted({n for e in links for n in e}), links).items()}
    peeled = []
    monkeypatch.setattr(graph, "_peeled_layers", lambda *a, own=graph._peeled_layers: peeled.append(1) or own(*a))
    for most in (graph._LINKS, 8):
        monkeypatch.setattr(graph, "_LINKS", most)
        assert {(r.report_path, r.node): r.layer for r in graph.layers(edges).collect()} == want
    assert len(peeled) == 1


def test_report_graphs_shuffle_each_table_once(spark):
    from tracesift.plans.bindings import Inputs

    x = Inputs(spark, "/root/testdata/sf0.001")
    edges = graph.edges(x.paths, x.mappings)
    for df, most in ((edges, 2), (graph.degrees(edges), 2), (graph.nodes(x.paths, x.mappings, edges), 4)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= most


def test_reports_with_the_same_times_are_searched_once(spark):
    events = spark.createDataFrame([(float(t), f"h{t % 400}") for t in range(0, 4000, 5)], "ts double, src_ip string")
    marks = spark.createDataFrame([(f"r{i}", t) for i in range(300) for t in (1000.0, 2000.0)] + [("other", 2000.0), ("none", None)], "report_path string, ts double")
    found = intel.near_report_times(events, marks)
    got = {(r.report_path, r.src_ip): r.events for r in found.collect()}
    near = lambda t, *marks: any(abs(t - m) <= 300 for m in marks)
    want = {}
    for t in range(0, 4000, 5):
        for report in [*[f"r{i}" for i in range(300) if near(t, 1000, 2000)], *["other"] * near(t, 2000)]:
            want[report, f"h{t % 400}"] = want.get((report, f"h{t % 400}"), 0) + 1
    assert got == want
    assert "first_report" in found._jdf.queryExecution().optimizedPlan().toString()


def test_loop_packets_of_one_number_go_by_ttl(spark):
    from tracesift.sources import packets as pk

    rows = [dict(capture="c", pkt_no=n, src_ip="10.0.0.1", dst_ip="10.0.0.2", ip_proto=6, ip_id=5, ttl=ttl) for n, ttl in ((1, 64), (2, 9), (2, 60), (2, 30))]
    for order in (rows, rows[::-1]):
        got = sorted((r.ttl, r.prev_ttl) for r in pk.loop_packets(table(spark, "packets", order).coalesce(1)).collect())
        assert got == [(9, 64), (30, 9), (60, 30)]


def test_pattern_profile_runs_each_pattern_once(spark):
    lines = spark.createDataFrame([("f", 1, "10.0.0.1 GET /a?b user=bob"), ("f", 2, "-"), ("f", 3, None)], "file_path string, line_no long, line string")
    found = logs.pattern_profile(lines, ["IP", "IPV4", "PATH", "URI", "USER", "EMAIL"])
    assert {r["pattern"]: (r["matches"], r["distinct_values"]) for r in found.collect()} == {
        "IP": (1, 1), "IPV4": (1, 1), "PATH": (1, 1), "URI": (1, 1), "USER": (1, 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 5 and "RLIKE" not in plan
