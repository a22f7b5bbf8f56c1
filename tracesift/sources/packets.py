"""Protocol tables derived from ``packets`` with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import network as nw
from tracesift.operators.ranking import evaluated_once
from tracesift.schemas import conform


def _latin(payload: Column | str = "payload") -> Column:
    """Payload as text with one character per byte."""
    return F.decode(nw.col(payload), "ISO-8859-1")


def _byte(text: Column, index) -> Column:
    """Byte at a 0-based index of one-character-per-byte text; null past the end."""
    at = index if isinstance(index, Column) else F.lit(index)
    return F.when(at < F.length(text), F.ascii(F.substring(text, at + 1, F.lit(1))))


def ip_packets(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("src_ip").isNotNull())


def connections(packets: DataFrame) -> DataFrame:
    """Every IP packet as a one-packet connection row; sums and spans follow from
    the conversation aggregate."""
    rows = ip_packets(packets)
    return conform(
        rows.select(
            "capture", "ts", "src_ip", "src_port", "dst_ip", F.coalesce("dst_port", F.lit(0)).alias("dst_port"),
            nw.protocol_of_number("ip_proto").alias("proto"), F.lit(1).alias("packets"),
            F.col("frame_len").alias("bytes_out"), F.lit(0).alias("bytes_in"),
        ),
        "connections",
    )


def arp_messages(packets: DataFrame) -> DataFrame:
    """ARP requests and replies with kind and gratuitous mark."""
    rows = packets.where(F.col("arp_op").isin(1, 2))
    request = F.col("arp_op") == 1
    return rows.select(
        "capture", "pkt_no", "ts", F.when(request, "request").otherwise("reply").alias("kind"),
        F.col("arp_spa").alias("sender_ip"), F.col("arp_sha").alias("sender_mac"), F.col("arp_tpa").alias("target_ip"),
        F.coalesce(request & (F.col("arp_spa") == F.col("arp_tpa")), F.lit(False)).alias("gratuitous"),
    )


def icmp_errors(packets: DataFrame) -> DataFrame:
    text = nw.icmp_description("icmp_type", "icmp_code")
    rows = packets.where(F.col("ip_proto") == 1).withColumn("description", text)
    return conform(rows.where(F.col("description").isNotNull()), "icmp_errors")


def loop_packets(packets: DataFrame) -> DataFrame:
    """Packets whose IP id was last seen on the same path with another TTL.

    Partitions are one IP id of one path; a busy path spreads over its ids. Packets
    with one number go by their TTL, so that the result is the same in every run.
    """
    seen = ip_packets(packets).where(F.col("ip_id") != 0).select(
        "capture", "pkt_no", "src_ip", "dst_ip", "ip_proto", "ip_id", "ttl"
    )
    order = Window.partitionBy("capture", "src_ip", "dst_ip", "ip_proto", "ip_id").orderBy("pkt_no", "ttl")
    rows = seen.withColumn("prev_ttl", F.lag("ttl").over(order)).where(F.col("prev_ttl") != F.col("ttl"))
    proto = F.when(F.col("ip_proto") == 6, "TCP").when(F.col("ip_proto") == 17, "UDP").otherwise("OTHER")
    return conform(rows.withColumn("proto", proto), "loop_packets")


def ot_transactions(packets: DataFrame) -> DataFrame:
    """Packets on an industrial port with Modbus, S7comm and DNP3 details.

    The port filter comes first; bytes are read only of what is left, each once.
    """
    ports = fv.OT_PROTOCOL_PORTS
    name = F.coalesce(nw.lookup(F.col("dst_port"), ports), nw.lookup(F.col("src_port"), ports))
    rows = packets.where(F.col("dst_port").isin(*ports) | F.col("src_port").isin(*ports)).withColumn("protocol", name)
    raw, tcp, size = F.col("raw"), F.col("ip_proto") == 6, F.length("raw")
    is_ = lambda protocol: tcp & (F.col("protocol") == protocol)
    rows = rows.withColumn("raw", F.coalesce(_latin(), F.lit("")))
    # 0x32 ("2") starts an S7 header; ``at`` is where it stands
    rows = rows.withColumn("at", F.when(is_("S7comm") & raw.contains("2"), F.instr(raw, "2") - 1))
    codes = F.struct(
        F.when(is_("Modbus") & (size >= 8), _byte(raw, 7)).alias("modbus"),
        F.when(is_("Modbus") & (size >= 8), _byte(raw, 6)).alias("unit"),
        F.when(is_("Modbus"), _byte(raw, 8)).alias("error"),
        F.when(F.col("at") + 2 < size, _byte(raw, F.col("at") + 1)).alias("pdu"),
        F.when(F.col("at") + 8 < size, _byte(raw, F.col("at") + 7)).alias("s7"),
        F.when(is_("DNP3") & raw.startswith("\x05d"), _byte(raw, 13)).alias("dnp3"),
    )
    rows = evaluated_once(rows, "_codes", codes)
    base, pdu, dnp3 = F.col("_codes.modbus").bitwiseAND(F.lit(127)), F.col("_codes.pdu"), F.col("_codes.dnp3")
    failed = F.col("_codes.modbus") >= 128
    s7 = F.when(pdu.isin(1, 3), F.col("_codes.s7"))
    hex_name = lambda v: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(v), 2, "0")))
    fc_name = lambda v: F.concat(F.lit("FC-"), v.cast("string"))
    out = rows.select(
        "capture", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        F.col("_codes.unit").alias("unit_id"),
        F.coalesce(base, dnp3).alias("function_code"),
        F.coalesce(
            nw.lookup(base, fv.MODBUS_FUNCTIONS, fc_name(base)),
            nw.lookup(s7, fv.S7_FUNCTIONS, hex_name(s7)),
            nw.lookup(dnp3, fv.DNP3_FUNCTIONS, fc_name(dnp3)),
        ).alias("function_name"),
        nw.lookup(pdu, fv.S7_PDU_TYPES, hex_name(pdu)).alias("pdu_type"),
        F.coalesce(base.isin(*fv.MODBUS_WRITES), s7.isin(*fv.S7_WRITES), dnp3.isin(*fv.DNP3_WRITES)).alias("is_write"),
        F.coalesce(s7.isin(*fv.S7_CONTROLS), dnp3.isin(*fv.DNP3_CONTROLS)).alias("is_control"),
        base.isin(*fv.MODBUS_DIAGNOSTICS).alias("is_diagnostic"),
        failed.alias("is_exception"),
        F.when(failed, F.col("_codes.error")).alias("exception_code"),
    )
    return conform(out, "ot_transactions")


def cleartext_creds(packets: DataFrame) -> DataFrame:
    """First matching credential rule of each packet; no payload is kept.

    The rule's number is found once a packet, its texts are looked up after.
    """
    rules = fv.CREDENTIAL_RULES
    either = lambda ports: F.coalesce(F.col("dst_port").isin(*ports), F.lit(False)) | F.coalesce(
        F.col("src_port").isin(*ports), F.lit(False)
    )
    rule = None
    for number, (_, ports, pattern, _) in enumerate(rules):
        test = F.lit(True) if ports is None else either(ports)
        if pattern is not None:
            test = test & F.col("raw").rlike(pattern)
        rule = F.when(test, number) if rule is None else rule.when(test, number)
    rows = packets.where(F.length("payload") >= 4).select(
        "capture", "ts", "src_ip", "dst_ip", "src_port", "dst_port", _latin().alias("raw")
    )
    found = evaluated_once(rows, "rule", rule).where(F.col("rule").isNotNull())
    # rules without a pattern report the service's side of the packet
    sender = F.lit(False)
    for number, (_, ports, pattern, _) in enumerate(rules):
        if pattern is None:
            sender = sender | ((F.col("rule") == number) & ~F.coalesce(F.col("dst_port").isin(*ports), F.lit(False)))
    return conform(
        found.select(
            "capture", "ts", "src_ip", "dst_ip",
            F.when(sender, F.col("src_port")).otherwise(F.col("dst_port")).alias("port"),
            nw.lookup(F.col("rule"), {n: r[0] for n, r in enumerate(rules)}).alias("protocol"),
            nw.lookup(F.col("rule"), {n: r[3] for n, r in enumerate(rules)}).alias("description"),
        ),
        "cleartext_creds",
    )


def http_requests(packets: DataFrame) -> DataFrame:
    """Requests recognised by their method at the start of the payload, any port."""
    tcp = packets.where((F.col("ip_proto") == 6) & (F.length("payload") > 4))
    rows = tcp.withColumn("raw", _latin()).where(F.col("raw").rlike(r"^(GET |POST|PUT |HEAD|DELE|PATC|OPTI)"))
    line = r"^([A-Z]+) (\S+)"
    out = rows.select(
        "capture", "ts", "src_ip", "dst_ip",
        F.regexp_extract("raw", line, 1).alias("method"), F.regexp_extract("raw", line, 2).alias("path"),
        F.trim(F.regexp_extract("raw", r"(?im)^host:[ \t]*([^\r\n]*)", 1)).alias("host"),
    ).where(F.col("method") != "")
    return conform(out, "http_requests")


# --- DNS and TLS messages -------------------------------------------------------------------


def _number16(text: Column, index: Column) -> Column:
    return _byte(text, index) * 256 + _byte(text, index + 1)


def _utf8(text: Column) -> Column:
    """Text of one character per byte as UTF-8, with replacement characters for what is none."""
    return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))


#: Most labels and pointers of a name; each step of the fold reads one.
_NAME_STEPS = 128


def _dns_name(raw: Column, start: Column) -> Column:
    """(name, next): the name at a place, labels joined by dots, and the place after it; null if malformed.

    A compression pointer must lead before the place where its own part of the name
    began, so that no message can make a loop; the steps are bounded besides.
    """
    first = F.struct(
        start.cast("int").alias("pos"), start.cast("int").alias("began"), F.lit(None).cast("int").alias("next"), F.lit("").alias("name"), F.lit(0).alias("state")
    )

    def step(acc: Column, _: Column) -> Column:
        pos, here = acc["pos"], _byte(raw, acc["pos"])
        target = (here - 192) * 256 + _byte(raw, pos + 1)
        state = lambda pos, after, name, state, began=acc["began"]: F.struct(
            pos.cast("int").alias("pos"), began.cast("int").alias("began"), after.cast("int").alias("next"), name.alias("name"), F.lit(state).alias("state")
        )
        dot = F.when(acc["name"] == "", "").otherwise(".")
        label = F.concat(acc["name"], dot, F.substring(raw, pos + 2, here))
        return (
            F.when(acc["state"] != 0, acc)
            .when(here == 0, state(pos, F.coalesce(acc["next"], pos + 1), acc["name"], 1))
            .when((here >= 192) & (target < acc["began"]), state(target, F.coalesce(acc["next"], pos + 2), acc["name"], 0, target))
            .when((here < 64) & (pos + here < F.length(raw)), state(pos + here + 1, acc["next"], label, 0))
            .otherwise(state(pos, acc["next"], acc["name"], 2))
        )

    steps = F.sequence(F.lit(1), F.least(F.lit(_NAME_STEPS), F.length(raw)))
    return F.aggregate(
        steps, first, step, lambda acc: F.when(acc["state"] == 1, F.struct(_utf8(acc["name"]).alias("name"), acc["next"].alias("next")))
    )


def _ipv6(data: Column) -> Column:
    """Address text of 16 bytes in hex: groups without leading zeros, the first longest run of zero groups as ``::``."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(data, i * 4 + 1, F.lit(4)), "^0{1,3}", "")
    )
    text = F.array_join(groups, ":")
    out = text
    for run in range(2, 9):
        pattern = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)"
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1::")).otherwise(out)
    return out


def dns_messages(packets: DataFrame) -> DataFrame:
    """One row per UDP packet on a DNS port: ``kind`` is query, response, no_answer or malformed.

    Queries bring their first question; responses the first question's name and the
    first answer: an address, a name with its closing dot, the first text of a TXT
    record, or the data in hex. A message whose names or lengths don't fit the
    payload is malformed and keeps its row.
    """
    port = F.col("src_port").isin(*fv.DNS_PORTS) | F.col("dst_port").isin(*fv.DNS_PORTS)
    udp = packets.where((F.col("ip_proto") == 17) & F.coalesce(port, F.lit(False)) & (F.length("payload") > 0))
    rows = evaluated_once(udp.select("capture", "ts", "src_ip", "dst_ip", "payload"), "raw", _latin()).drop("payload")
    raw = F.col("raw")
    count = lambda at: F.coalesce(_number16(raw, F.lit(at)), F.lit(0))
    rows = evaluated_once(rows, "asked", F.when(count(4) > 0, _dns_name(raw, F.lit(12))))
    start = F.when(count(4) == 0, F.lit(12)).otherwise(F.col("asked.next") + 4)
    rows = evaluated_once(rows, "owner", F.when((count(6) > 0) & (count(4) <= 1), _dns_name(raw, start)))
    at = F.col("owner.next")
    rows = evaluated_once(rows, "kind_no", _number16(raw, at))
    size = _number16(raw, at + 8)
    data = F.lower(F.hex(F.encode(F.substring(raw, at + 11, size), "ISO-8859-1")))
    part = lambda i: F.conv(F.substring(data, 2 * i + 1, 2), 16, 10)
    text_size = _byte(raw, at + 10)
    rdata = (
        F.when(at + 10 + size > F.length(raw), F.lit(None))
        .when((F.col("kind_no") == 1) & (size == 4), F.concat_ws(".", *[part(i) for i in range(4)]))
        .when((F.col("kind_no") == 28) & (size == 16), _ipv6(data))
        .when(F.col("kind_no").isin(2, 5, 12), F.concat(_dns_name(raw, at + 10)["name"], F.lit(".")))
        .when((F.col("kind_no") == 16) & (text_size < size), _utf8(F.substring(raw, at + 12, text_size)))
        .otherwise(data)
    )
    rows = evaluated_once(rows, "answer", F.when(at.isNotNull(), rdata))
    qtype = _number16(raw, F.col("asked.next"))
    response = _byte(raw, 2) >= 128
    sound = (F.length(raw) >= 12) & ((count(4) == 0) | (F.col("asked").isNotNull() & (F.col("asked.next") + 4 <= F.length(raw))))
    kind = (
        F.when(~sound, "malformed")
        .when(~response, F.when(count(4) > 0, "query").otherwise("malformed"))
        .when(count(6) == 0, "no_answer")
        .when(F.col("answer").isNull(), "malformed")
        .otherwise("response")
    )
    code = _byte(raw, 3) % 16
    out = rows.withColumn("kind", kind)
    good = F.col("kind") != "malformed"
    return out.select(
        "capture", "ts", "src_ip", "dst_ip", "kind", F.when(good, F.rtrim(F.col("asked.name"), F.lit("."))).alias("query"),
        F.when(good, F.when(F.col("kind") == "response", F.col("kind_no")).otherwise(qtype).cast("string")).alias("qtype"),
        F.when(F.col("kind") == "response", F.col("answer")).alias("answer"),
        F.when(good & response, F.coalesce(nw.lookup(code, fv.DNS_CODES), code.cast("string"))).alias("rcode"),
    )


def dns_queries(packets: DataFrame) -> DataFrame:
    return conform(dns_messages(packets).where(F.col("kind") == "query"), "dns_queries")


def dns_responses(packets: DataFrame) -> DataFrame:
    return conform(dns_messages(packets).where(F.col("kind") == "response"), "dns_responses")


#: Most extensions of a ClientHello that are walked through.
_EXTENSIONS = 256


def tls_client_hellos(packets: DataFrame) -> DataFrame:
    """One row per TCP payload that begins with a TLS ClientHello record: ``sni``, null without one, and ``malformed``.

    The lengths before the extensions are followed one by one, then a fold walks
    from extension to extension up to the server name. A hello that ends before its
    own lengths say so is malformed and keeps its row; a name before the cut counts.
    """
    tcp = packets.where((F.col("ip_proto") == 6) & (F.length("payload") > 5))
    rows = evaluated_once(tcp.select("capture", "ts", "src_ip", "dst_ip", "dst_port", "payload"), "raw", _latin()).drop("payload")
    raw = F.col("raw")
    rows = rows.where((_byte(raw, 0) == 22) & (_byte(raw, 1) == 3) & (_byte(raw, 5) == 1))
    size = F.length(raw)
    rows = evaluated_once(rows, "ciphers", F.lit(44) + _byte(raw, 43))
    rows = evaluated_once(rows, "methods", F.col("ciphers") + 2 + _number16(raw, F.col("ciphers")))
    rows = evaluated_once(rows, "begin", F.col("methods") + 1 + _byte(raw, F.col("methods")))
    rows = evaluated_once(rows, "end", F.when(F.col("begin") == size, size).otherwise(F.col("begin") + 2 + _number16(raw, F.col("begin"))))
    first = F.struct((F.col("begin") + 2).cast("int").alias("pos"), F.lit(None).cast("string").alias("name"))

    def step(acc: Column, _: Column) -> Column:
        pos = acc["pos"]
        kind, length = _number16(raw, pos), _number16(raw, pos + 2)
        name_size = _number16(raw, pos + 7)
        named = (kind == 0) & (length > 5) & (pos + 9 + name_size <= size)
        walked = F.struct(
            (pos + 4 + length).cast("int").alias("pos"), F.when(named, F.substring(raw, pos + 10, name_size)).alias("name")
        )
        return F.when(acc["name"].isNull() & (pos + 4 <= F.col("end")) & length.isNotNull(), walked).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(_EXTENSIONS))
    steps = F.slice(steps, F.lit(1), F.least(F.lit(_EXTENSIONS), F.floor(size / 4).cast("int")))
    rows = evaluated_once(rows, "found", F.when(F.col("end").isNotNull(), F.aggregate(steps, first, step, lambda acc: acc["name"])))
    return rows.select(
        "capture", "ts", "src_ip", "dst_ip", "dst_port", F.nullif(_utf8(F.col("found")), F.lit("")).alias("sni"),
        F.coalesce(F.col("end") > size, F.lit(True)).alias("malformed"),
    )


def tls_handshakes(packets: DataFrame) -> DataFrame:
    return conform(tls_client_hellos(packets), "tls_handshakes")
