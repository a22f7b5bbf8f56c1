"""Network health over packets, ICMP errors, ARP and control-plane messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesift.functions import network as nw

from .flows import CONVERSATION_KEYS
from .ranking import gap_statistics, numbered, top_n, top_per_group, value_changes, with_group_totals

FIN, SYN, RST = 1, 2, 4


def _count(test: Column) -> Column:
    return F.sum(F.coalesce(test, F.lit(False)).cast("bigint"))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)


def _retransmitted(packets: DataFrame) -> Column:
    """Packet captures carry no retransmission mark; sources that do name it ``retransmit``."""
    return F.col("retransmit") if "retransmit" in packets.columns else F.lit(False)


def tcp_packets(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("ip_proto") == 6)


def tcp_health(packets: DataFrame) -> DataFrame:
    """One row: flag counts, rates and the health grade by retransmission rate."""
    flags = "tcp_flags"
    totals = tcp_packets(packets).agg(
        F.count(F.lit(1)).alias("tcp_packets"),
        F.coalesce(_count(nw.has_flag(flags, SYN)), F.lit(0)).alias("syn"),
        F.coalesce(_count(nw.has_flag(flags, FIN)), F.lit(0)).alias("fin"),
        F.coalesce(_count(nw.has_flag(flags, RST)), F.lit(0)).alias("rst"),
        F.coalesce(_count(F.col("tcp_window") == 0), F.lit(0)).alias("zero_window"),
        F.coalesce(_count(_retransmitted(packets)), F.lit(0)).alias("retransmissions"),
    )
    lost = _pct(F.col("retransmissions"), F.col("tcp_packets"))
    return totals.select(
        "*",
        F.round(_pct(F.col("rst"), F.col("tcp_packets")), 2).alias("rst_pct"),
        F.round(lost, 2).alias("retransmit_pct"),
        F.round(_pct(F.col("fin"), F.col("syn")), 1).alias("completion_pct"),
        F.round(_pct(F.col("rst"), F.col("syn")), 1).alias("failure_pct"),
        F.when(lost < 1, "HEALTHY").when(lost < 5, "DEGRADED").when(lost.isNotNull(), "CRITICAL").alias("grade"),
    )


def conversation_health(packets: DataFrame) -> DataFrame:
    """Per TCP conversation: resets, retransmissions, zero windows and packets.

    The packet count is part of the same aggregate, so no join to the
    conversation table is needed.
    """
    rows = tcp_packets(packets).withColumn("proto", F.lit("TCP"))
    return rows.groupBy(*CONVERSATION_KEYS).agg(
        _count(nw.has_flag("tcp_flags", RST)).alias("rst"),
        _count(_retransmitted(packets)).alias("retransmit"),
        _count(F.col("tcp_window") == 0).alias("zero_window"),
        F.count(F.lit(1)).alias("packets"),
    )


def problem_conversations(packets: DataFrame, top: int = 20) -> DataFrame:
    scored = conversation_health(packets).withColumn("issues", F.col("rst") + F.col("retransmit") + F.col("zero_window"))
    return top_n(scored.where(F.col("issues") > 0), top, F.desc("issues"), *[F.asc(k) for k in CONVERSATION_KEYS])


# --- ICMP ------------------------------------------------------------------------------


def icmp_by_description(icmp_errors: DataFrame) -> DataFrame:
    return icmp_errors.groupBy("description").agg(
        F.count(F.lit(1)).alias("cnt"), F.countDistinct("src_ip", "dst_ip").alias("pairs")
    )


def icmp_pairs(icmp_errors: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent host pairs of each error text."""
    counted = icmp_errors.groupBy("description", "src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("cnt"))
    return top_per_group(
        counted, ["description"], top, F.desc("cnt"), F.asc("src_ip"), F.asc("dst_ip"), name="rank"
    )


def routing_loops(icmp_errors: DataFrame, min_routers: int = 2, min_messages: int = 5) -> DataFrame:
    """TTL-exceeded messages by the host they notify (the original sender)."""
    expired = icmp_errors.where(F.col("icmp_type") == 11)
    grouped = expired.groupBy(F.col("dst_ip").alias("notified_host")).agg(
        F.countDistinct("src_ip").alias("routers"), F.count(F.lit(1)).alias("messages")
    )
    many_routers, many_messages = F.col("routers") >= min_routers, F.col("messages") >= min_messages
    return grouped.where(many_routers | many_messages).withColumn(
        "confidence", F.when(many_routers & many_messages, "HIGH").otherwise("MEDIUM")
    )


def routing_loop_sources(icmp_errors: DataFrame, min_routers: int = 2, min_messages: int = 5) -> DataFrame:
    """Evidence of each routing loop: the routers that reported it, with their messages."""
    found = routing_loops(icmp_errors, min_routers, min_messages).select("notified_host")
    reported = icmp_errors.where(F.col("icmp_type") == 11).groupBy(F.col("dst_ip").alias("notified_host"), F.col("src_ip").alias("router")).agg(
        F.count(F.lit(1)).alias("messages"))
    return reported.join(found, "notified_host", "left_semi")


def duplicate_loops(loop_packets: DataFrame) -> DataFrame:
    """Duplicate packets per path; a TTL is one byte, which bounds the array."""
    ttls = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("ttl", "prev_ttl")))))
    grouped = loop_packets.groupBy("src_ip", "dst_ip", "proto").agg(
        F.count(F.lit(1)).alias("duplicates"), ttls.alias("ttls")
    )
    return grouped.withColumn("ttl_spread", F.array_max("ttls") - F.array_min("ttls"))


def ttl_exceeded_share(icmp_errors: DataFrame, packets: DataFrame, threshold_pct: float = 0.1) -> DataFrame:
    """One row: TTL-exceeded messages as a share of all packets."""
    both = (
        icmp_errors.where(F.col("icmp_type") == 11)
        .agg(F.count(F.lit(1)).alias("expired"), F.lit(0).cast("bigint").alias("packets"))
        .unionByName(packets.agg(F.lit(0).cast("bigint").alias("expired"), F.count(F.lit(1)).alias("packets")))
        .agg(F.sum("expired").alias("expired"), F.sum("packets").alias("packets"))
    )
    share = _pct(F.col("expired"), F.col("packets"))
    return both.select("expired", "packets", F.round(share, 3).alias("expired_pct"), (share > threshold_pct).alias("elevated"))


# --- ARP ---------------------------------------------------------------------------------


def arp_packets(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("arp_op").isin(1, 2)).select("capture", "pkt_no", "ts", "arp_op", "arp_spa", "arp_tpa", "arp_sha")


def arp_health(packets: DataFrame) -> DataFrame:
    """One row of ARP counts, rates and their flags, from one pass over the packets."""
    request, reply = F.col("arp_op") == 1, F.col("arp_op") == 2
    arp_ts = F.when(request | reply, F.col("ts"))
    totals = packets.agg(
        F.coalesce(_count(request), F.lit(0)).alias("requests"),
        F.coalesce(_count(reply), F.lit(0)).alias("replies"),
        F.coalesce(_count(request & (F.col("arp_spa") == F.col("arp_tpa"))), F.lit(0)).alias("gratuitous"),
        (F.max(arp_ts) - F.min(arp_ts)).alias("span"),
        F.count(F.lit(1)).alias("packets"),
    ).withColumn("total", F.col("requests") + F.col("replies"))
    rate = F.when(F.col("span") > 0, F.col("total") / F.col("span"))
    share = _pct(F.col("total"), F.col("packets"))
    per_reply = F.when(F.col("replies") > 0, F.col("requests") / F.col("replies"))
    return totals.select(
        "requests", "replies", "gratuitous", "total",
        F.round(per_reply, 1).alias("request_reply_ratio"),
        F.round(rate, 3).alias("rate"),
        F.round(share, 2).alias("share_pct"),
        F.when(rate > 100, "STORM").when(rate > 30, "ELEVATED").otherwise("NORMAL").alias("rate_level"),
        F.coalesce(per_reply > 5, (F.col("requests") > 10)).alias("many_unanswered"),
        F.coalesce(share > 5, F.lit(False)).alias("high_share"),
        (F.col("gratuitous") > 10).alias("gratuitous_flapping"),
    )


def _requests_by_mac(packets: DataFrame) -> DataFrame:
    sent = arp_packets(packets).where((F.col("arp_op") == 1) & F.col("arp_sha").isNotNull())
    return sent.groupBy("arp_sha").agg(F.count(F.lit(1)).alias("requests"))


def arp_requesters(packets: DataFrame, top: int = 10) -> DataFrame:
    """Top request senders with their share of all requests."""
    ranked = with_group_totals(
        _requests_by_mac(packets), top, [F.desc("requests"), F.asc("arp_sha")], {"total": F.sum("requests")}
    )
    share = F.col("requests") / F.col("total") * 100
    level = F.when((F.col("requests") > 100) & (share > 30), "FLOOD").when(F.col("requests") > 50, "HIGH")
    return ranked.select("arp_sha", "requests", F.round(share, 1).alias("share_pct"), level.alias("level"))


def _claims(packets: DataFrame) -> DataFrame:
    """Distinct (address, MAC) claims of requests and replies."""
    rows = arp_packets(packets).where(F.col("arp_spa").isNotNull() & F.col("arp_sha").isNotNull())
    return rows.select(F.col("arp_spa").alias("ip"), F.col("arp_sha").alias("mac")).distinct()


def arp_conflicts(packets: DataFrame) -> DataFrame:
    """Addresses claimed by more than one MAC."""
    counted = _claims(packets).groupBy("ip").agg(F.count(F.lit(1)).alias("macs"))
    return counted.where(F.col("macs") > 1)


def arp_conflict_claims(packets: DataFrame) -> DataFrame:
    """Evidence of each conflict: the address and every MAC that claims it."""
    return _claims(packets).join(arp_conflicts(packets).select("ip"), "ip", "left_semi")


def arp_unanswered(packets: DataFrame, min_requests: int = 2) -> DataFrame:
    """Targets asked for at least twice that never replied."""
    arp = arp_packets(packets)
    asked = (
        arp.where((F.col("arp_op") == 1) & F.col("arp_tpa").isNotNull())
        .groupBy(F.col("arp_tpa").alias("ip"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") >= min_requests)
    )
    replied = arp.where(F.col("arp_op") == 2).select(F.col("arp_spa").alias("ip")).distinct()
    return asked.join(replied, "ip", "left_anti")


def arp_claims_of_busy_macs(packets: DataFrame, min_requests: int = 50) -> DataFrame:
    """Addresses claimed by MACs that send many requests, with the request count."""
    busy = _requests_by_mac(packets).where(F.col("requests") >= min_requests)
    return _claims(packets).join(busy.withColumnRenamed("arp_sha", "mac"), "mac").select("mac", "ip", "requests")


# --- IP layer -----------------------------------------------------------------------------


def fragmentation(packets: DataFrame) -> DataFrame:
    totals = packets.agg(
        F.coalesce(_count(F.col("frag")), F.lit(0)).alias("fragments"), F.count(F.lit(1)).alias("packets")
    )
    share = _pct(F.col("fragments"), F.col("packets"))
    return totals.select("fragments", "packets", F.round(share, 2).alias("fragment_pct"), (share > 1).alias("high"))


def ttl_families(packets: DataFrame) -> DataFrame:
    """Operating-system family guessed from the TTL, as a share of all packets.

    The TTL has at most 256 values, so everything after the first aggregate is tiny.
    """
    per_ttl = packets.groupBy("ttl").agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy())
    family = (
        F.when(F.col("ttl").between(56, 64), "Linux/macOS (TTL ~64)")
        .when(F.col("ttl").between(120, 128), "Windows (TTL ~128)")
        .when(F.col("ttl").between(250, 255), "Network devices (TTL ~255)")
        .otherwise("Other")
    )
    shared = per_ttl.withColumn("total", total).where(F.col("ttl").isNotNull())
    return shared.groupBy(family.alias("family")).agg(
        F.sum("cnt").alias("cnt"), F.round(F.sum("cnt") / F.max("total") * 100, 1).alias("percentage")
    )


def low_ttls(packets: DataFrame, below: int = 10) -> DataFrame:
    return packets.where(F.col("ttl") < below).groupBy("ttl").agg(F.count(F.lit(1)).alias("cnt"))


# --- DNS health -----------------------------------------------------------------------------


def dns_unanswered(queries: DataFrame, responses: DataFrame, top: int | None = None) -> DataFrame:
    """Names that were asked for and never answered."""
    asked = queries.groupBy("query").agg(F.count(F.lit(1)).alias("queries"))
    answered = responses.select("query").distinct()
    silent = asked.join(answered, "query", "left_anti")
    return silent if top is None else top_n(silent, top, F.desc("queries"), F.asc("query"))


def dns_clients(queries: DataFrame, top: int = 10) -> DataFrame:
    counted = queries.groupBy("src_ip").agg(F.count(F.lit(1)).alias("queries"))
    return top_n(counted, top, F.desc("queries"), F.asc("src_ip"))


# --- subnets ----------------------------------------------------------------------------------

_WEIGHTS = {
    "rst": 2, "retransmit": 1, "icmp_errors": 5, "unanswered_arp": 1, "loop_packets": 10, "ip_conflicts": 50,
}


def subnet_scores(packets: DataFrame, icmp_errors: DataFrame, loop_packets: DataFrame, top: int | None = None) -> DataFrame:
    """Anomaly score of each internal /24.

    Each source of trouble is summed per address first; the union of those sums
    is then summed per subnet, so distinct addresses need no distinct count.
    """
    measures = list(_WEIGHTS) + ["arp_requests"]

    def per_ip(df: DataFrame, **values: Column) -> DataFrame:
        sums = [F.sum(values[m]).alias(m) for m in values]
        summed = df.where(nw.is_internal("ip")).groupBy("ip").agg(*sums)
        return summed.select(
            "ip", *[(F.col(m) if m in values else F.lit(0)).cast("bigint").alias(m) for m in measures]
        )

    def ends(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), *keep)

    one = F.lit(1)
    parts = [
        per_ip(ends(conversation_health(packets), "rst", "retransmit"), rst=F.col("rst"), retransmit=F.col("retransmit")),
        per_ip(ends(icmp_errors), icmp_errors=one),
        per_ip(arp_unanswered(packets), unanswered_arp=F.col("requests")),
        per_ip(arp_conflicts(packets), ip_conflicts=one),
        per_ip(ends(loop_packets), loop_packets=one),
        per_ip(arp_claims_of_busy_macs(packets), arp_requests=F.col("requests")),
    ]
    addresses = reduce(DataFrame.unionByName, parts).groupBy("ip").agg(*[F.sum(m).alias(m) for m in measures])
    subnets = addresses.groupBy(nw.subnet24("ip").alias("subnet")).agg(
        *[F.sum(m).alias(m) for m in measures], F.count(F.lit(1)).alias("ips")
    )
    score = reduce(lambda a, b: a + b, [F.col(m) * w for m, w in _WEIGHTS.items()])
    score = score + F.floor(F.col("arp_requests") / 100).cast("bigint")
    ranked = top_n(subnets.withColumn("score", score).where(F.col("score") > 0), top, F.desc("score"), F.asc("subnet"))
    return ranked.select("subnet", "score", *measures, "ips")


# --- control plane ------------------------------------------------------------------------------


def _messages(control_plane: DataFrame, protocol: str) -> DataFrame:
    return control_plane.where(F.col("protocol") == protocol)


def stp_summary(control_plane: DataFrame) -> DataFrame:
    """One row: BPDU, TCN and TC counts, root bridges, rate and flags."""
    stp = _messages(control_plane, "STP")
    totals = stp.agg(
        _count(F.col("msg_type") == "CONFIG").alias("bpdus"),
        _count(F.col("msg_type") == "TCN").alias("tcns"),
        _count(F.col("state") == "TC").alias("tc_flags"),
        F.countDistinct("root_bridge").alias("root_bridges"),
        F.countDistinct("src").alias("bridges"),
        (F.max("ts") - F.min("ts")).alias("span"),
    )
    rate = F.when(F.col("span") > 0, (F.col("bpdus") + F.col("tcns")) / F.col("span"))
    return totals.select(
        "bpdus", "tcns", "tc_flags", "root_bridges", "bridges", F.round(rate, 4).alias("rate"),
        (F.col("root_bridges") > 1).alias("root_changed"), (F.col("tcns") > 10).alias("many_tcns"),
        F.coalesce(rate > 5, F.lit(False)).alias("elevated"),
    )


def control_plane_members(control_plane: DataFrame) -> DataFrame:
    """Rows behind the summaries' counts: BPDUs per root and bridge, OSPF areas and routers, EIGRP AS numbers."""
    stp, ospf, eigrp = (_messages(control_plane, p) for p in ("STP", "OSPF", "EIGRP"))
    config = stp.where(F.col("msg_type") == "CONFIG")
    parts = (
        (config, "STP", "root_bridge"), (stp, "STP", "src"), (ospf, "OSPF", "area"), (ospf, "OSPF", "router_id"), (eigrp, "EIGRP", "as_number"),
    )
    counted = [
        rows.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("messages"))
        .select(F.lit(protocol).alias("protocol"), F.lit(name).alias("kind"), "value", "messages")
        for rows, protocol, name in parts
    ]
    return reduce(DataFrame.unionByName, counted)


def redundancy_groups(control_plane: DataFrame, protocol: str) -> DataFrame:
    """HSRP or VRRP groups: messages, routers, states, priorities, virtual addresses.

    States, priorities (one byte) and a group's virtual addresses are short lists.
    """
    if protocol not in ("HSRP", "VRRP"):
        raise ValueError("protocol must be HSRP or VRRP")
    return _messages(control_plane, protocol).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("src").alias("routers"),
        F.array_sort(F.collect_set("state")).alias("states"),
        F.array_sort(F.collect_set("priority")).alias("priorities"),
        F.array_sort(F.collect_set("virtual_ip")).alias("virtual_ips"),
    )


def hsrp_transitions(control_plane: DataFrame) -> DataFrame:
    """State changes of each router in each HSRP group."""
    return value_changes(_messages(control_plane, "HSRP"), ["group_id", "src"], "state")


def vrrp_priority_changes(control_plane: DataFrame) -> DataFrame:
    return value_changes(_messages(control_plane, "VRRP"), ["group_id", "src"], "priority")


def ospf_summary(control_plane: DataFrame) -> DataFrame:
    kinds = {"hello": "Hello", "dbd": "DBD", "ls_request": "LSRequest", "ls_update": "LSUpdate", "ls_ack": "LSAck"}
    return _messages(control_plane, "OSPF").agg(
        F.count(F.lit(1)).alias("packets"),
        *[_count(F.col("msg_type") == kind).alias(name) for name, kind in kinds.items()],
        F.countDistinct("area").alias("areas"),
        F.countDistinct("router_id").alias("router_ids"),
    )


def ospf_neighbor_gaps(control_plane: DataFrame, gap_seconds: float = 40.0, dead_seconds: float = 120.0) -> DataFrame:
    """Neighbour pairs of a capture whose hellos paused for longer than the threshold."""
    hellos = _messages(control_plane, "OSPF").where(F.col("msg_type") == "Hello")
    pairs = hellos.select("capture", F.least("src", "dst").alias("ip_a"), F.greatest("src", "dst").alias("ip_b"), "ts")
    stats = gap_statistics(pairs, ["capture", "ip_a", "ip_b"], "ts")
    return stats.where(F.col("max_gap") > gap_seconds).select(
        "capture", "ip_a", "ip_b", F.round("max_gap", 1).alias("max_gap"), F.col("n").alias("hellos"),
        (F.col("max_gap") > dead_seconds).alias("dead"),
    )


def ospf_update_bursts(control_plane: DataFrame, steps: int = 10, seconds: float = 5.0) -> DataFrame:
    """Windows of a capture in which the update ``steps`` places later comes within ``seconds``.

    Updates are numbered in their capture over range partitions and meet the update
    ``steps`` numbers further on by an equi-join, so a storm is spread over many
    tasks. Of updates at one instant only the last ``steps`` can reach another
    instant and only the first ``steps`` can be reached: the others begin windows of
    span 0 and need no number.
    """
    updates = _messages(control_plane, "OSPF").where(F.col("msg_type") == "LSUpdate").where(F.col("ts").isNotNull())
    instants = updates.groupBy("capture", "ts").agg(F.count(F.lit(1)).alias("n"))
    some = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(steps))))
    ranked = numbered(instants.select("capture", "ts", some.alias("i")), ["capture"], F.asc("ts"), F.asc("i"), name="no")
    later = ranked.select(F.col("capture").alias("_capture"), (F.col("no") - steps).alias("_no"), F.col("ts").alias("end"))
    same = F.col("capture").eqNullSafe(F.col("_capture")) & (F.col("no") == F.col("_no"))
    apart = ranked.join(later, same).select("capture", "ts", (F.col("end") - F.col("ts")).alias("span"))
    more = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - steps))
    crowded = instants.where(F.col("n") > steps).select("capture", "ts", F.lit(0.0).alias("span"), more.alias("i")).drop("i")
    found = apart.unionByName(crowded).where(F.col("span") <= seconds)
    rate = F.when(F.col("span") > 0, F.lit(float(steps)) / F.col("span")).otherwise(999.0)
    return found.select("capture", F.col("ts").alias("burst_start"), "span", rate.alias("rate"))


def ospf_burst_summary(control_plane: DataFrame) -> DataFrame:
    return ospf_update_bursts(control_plane).agg(
        F.count(F.lit(1)).alias("bursts"), F.round(F.max("rate"), 1).alias("peak_rate")
    )


def eigrp_summary(control_plane: DataFrame) -> DataFrame:
    kinds = {"hello": "Hello", "update": "Update", "query": "Query", "reply": "Reply"}
    totals = _messages(control_plane, "EIGRP").agg(
        F.count(F.lit(1)).alias("packets"),
        *[_count(F.col("msg_type") == kind).alias(name) for name, kind in kinds.items()],
        F.countDistinct("as_number").alias("as_numbers"),
    )
    return totals.withColumn("many_queries", F.col("query") > 20).withColumn(
        "topology_changing", (F.col("hello") > 0) & (F.col("update") > F.col("hello") * 0.1)
    )
