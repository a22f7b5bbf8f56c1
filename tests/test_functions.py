import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracesift import registry
from tracesift.functions import network as nw
from tracesift.functions import text as tx
from tracesift.functions import times
from tracesift.operators import flows, logs


@pytest.mark.parametrize(
    "ip,inside",
    [("10.0.0.1", True), ("172.16.0.1", True), ("172.31.255.255", True), ("172.32.0.1", False), ("192.168.1.1", True),
     ("192.169.1.1", False), ("10.0.0.256", False), ("10.0.0.01", False), ("fe80::1", False), ("", False), (None, False)],
)
def test_is_internal(one, ip, inside):
    assert one(nw.is_internal(F.lit(ip))) is inside


def test_ports_and_labels(one):
    assert one(nw.service_label(F.lit(8888))) == "HTTP-Alt2"
    assert one(nw.service_label(F.lit(502))) == "ICS:Modbus"
    assert one(nw.service_label(F.lit(4444))) == "SUSPECT:Metasploit"
    assert one(nw.service_label(F.lit(49999))) == "49999"
    assert one(nw.subnet24(F.lit("10.1.2.3"))) == "10.1.2.0/24"
    assert one(nw.indicator_type(F.lit("70000"))) == "domain"
    assert one(nw.indicator_type(F.lit(" 443 "))) == "port"
    assert one(nw.icmp_description(F.lit(3), F.lit(9))) == "ICMP type=3 code=9"
    assert one(nw.icmp_description(F.lit(8), F.lit(0))) is None


@pytest.mark.parametrize("text", ["abcd", "aab", "a", "", "xk3j9d8f7a6s5"])
def test_entropy(one, text):
    n = len(text)
    want = -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if text else 0.0
    assert one(tx.shannon_entropy(F.lit(text))) == pytest.approx(want, abs=1e-12)


def test_refang_and_signature(one):
    assert one(tx.refang(F.lit("hXXps[:]//a[.]b/x soc[AT]c"))) == "https://a.b/x soc@c"
    line = '10.0.0.1 2024-01-02 10:11:12 GET 0xAB 550e8400-e29b-41d4-a716-446655440000 77 a1'
    assert one(tx.signature(F.lit(line))) == "<IP> <DATE> <TIME> <METHOD> <HEX> <UUID> <NUM> a1"
    assert one(tx.signature(F.lit("x" * 301))) == "x" * 300 + "..."


def test_names(one):
    assert one(tx.domain_label(F.lit("a.b"))) == "a.b"
    assert one(tx.domain_label(F.lit("a.b.c"))) == "a"
    assert one(tx.base_domain(F.lit("x.y.b.c"))) == "b.c"
    assert one(tx.subdomain(F.lit("x.y.b.c"))) == "x.y"
    assert one(tx.subdomain(F.lit("b.c"))) is None
    assert one(tx.node_key(F.lit("T1"), F.lit("Initial Access"))) == "T1|initial-access"
    assert one(tx.node_key(F.lit("T1"), F.lit(""))) == "T1|unknown"


def test_sizes_and_times(one):
    assert one(tx.bytes_text(F.lit(512))) == "512 B"
    assert one(tx.bytes_text(F.lit(1536))) == "1.5 KB"
    assert one(tx.bytes_text_scaled(F.lit(512))) == "512.0 B"
    assert one(times.duration_text(F.lit(90.0))) == "1.5min"
    assert one(times.zeek_time(F.lit("1700000000.5"))) == 1700000000.5
    assert one(times.zeek_time(F.lit("2023-11-14T22:13:20.500000Z"))) == 1700000000.5
    assert one(times.zeek_time(F.lit("soon"))) is None
    assert one(times.utc_text(F.lit(0.0))) == "1970-01-01 00:00:00"


def test_report_text(one):
    text = "- short\n- a longer finding\n2) second one\n* star finding here\nplain"
    assert one(tx.key_findings(F.lit(text))) == ["a longer finding", "second one", "star finding here"]
    assert one(tx.technique_ids(F.lit("T1059.001 T1059 T1059.001"))) == ["T1059.001", "T1059"]
    assert one(tx.report_type(F.lit("x/CISA-aa.md"))) == "CISA Advisory"
    assert one(tx.report_type(F.lit("plain.md"))) == "Threat Intelligence Report"
    assert one(tx.artifact_type(F.lit("/var/auth.log.1"))) == "log_stream"
    assert one(tx.artifact_type(F.lit("noext"))) == "text"
    assert one(tx.line_count(F.lit("a\nb\n"))) == 2


def chunks_by_hand(text, size):
    if len(text) <= size:
        return [text]
    out, current, used = [], [], 0
    for para in text.split("\n\n"):
        need = len(para) + 2
        if used + need > size and current:
            out.append("\n\n".join(current))
            current, used = [], 0
        current.append(para)
        used += need
    return out + ["\n\n".join(current)]


@pytest.mark.parametrize("text", ["short", "aaaa\n\nbbbb\n\ncccc", "\n\n\n\nxxxxxxxxxxxxxxxxxxxxxxxx\n\ny", "a" * 50 + "\n\n" + "b" * 3])
def test_paragraph_chunks(one, text):
    assert one(tx.paragraph_chunks(F.lit(text), 12)) == chunks_by_hand(text, 12)


def test_bad_arguments_fail_at_plan_time(spark):
    lines = spark.createDataFrame([("f", 1, "x")], "file_path string, line_no bigint, line string")
    with pytest.raises(ValueError):
        logs.value_frequency(lines, "(")
    with pytest.raises(ValueError):
        logs.section_scan(lines, "nope")
    with pytest.raises(ValueError):
        logs.search(lines, "")
    with pytest.raises(ValueError):
        flows.talkers(lines, sort_by="colour")


def test_registry_lists_operators():
    names = registry.describe()
    assert "hunts.beacons" in names and all(not n.split(".")[1].startswith("_") for n in names)


def test_running_totals(spark, one):
    for n in (0, 1, 5, 256, 257, 1000):
        numbers = F.array(*[F.lit(i % 7 - 2) for i in range(n)]) if n <= 5 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i % 7 - 2)
        want, total = [], 0
        for i in range(n):
            total += i % 7 - 2
            want.append(total)
        assert one(tx.running_totals(numbers.cast("array<int>"))) == want


@pytest.mark.parametrize("text, want", [("\n\n\nab", 1.3709505944546687), ("😀😀éa", 1.5), ("a" * 5000 + "b" * 5000, 1.0)])
def test_entropy_of_runs(one, spark, text, want):
    entropy = tx.shannon_entropy(F.lit(text))
    assert one(entropy) == pytest.approx(want, abs=1e-12)
    step = spark.createDataFrame([(text,)], "text string").select(tx.shannon_entropy("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in step and "split" in step  # characters are sorted without a comparing lambda
