"""Flow analytics over connections, conversations and the protocol tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.functions import network as nw
from tracesift.functions import text as tx

from .ranking import ranked_top_n, top_n, top_per_group, with_group_totals

CONVERSATION_KEYS = ["src_ip", "dst_ip", "dst_port", "proto"]
_IP = re.compile(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")


def _by_key() -> list[Column]:
    return [F.asc(k) for k in CONVERSATION_KEYS]


def conversations(connections: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Connections summed per (source, destination, port, protocol)."""
    return connections.groupBy(*extra_keys, *CONVERSATION_KEYS).agg(
        F.coalesce(F.sum("packets"), F.lit(0)).alias("packets"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out"),
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("n_connections"),
    )


def span() -> Column:
    return F.coalesce(F.col("last_seen") - F.col("first_seen"), F.lit(0.0))


def with_locations(flows: DataFrame) -> DataFrame:
    """Adds ``src_int`` and ``dst_int`` once, for all direction tests."""
    return flows.withColumn("src_int", nw.is_internal("src_ip")).withColumn("dst_int", nw.is_internal("dst_ip"))


def touching(flows: DataFrame, ip: str | None) -> DataFrame:
    return flows if ip is None else flows.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))


def hosts(flows: DataFrame) -> DataFrame:
    """Distinct addresses over both ends."""
    ends = F.explode(F.array_distinct(F.array("src_ip", "dst_ip")))
    return flows.select(ends.alias("host")).where(F.col("host").isNotNull()).distinct()


def host_totals(flows: DataFrame) -> DataFrame:
    """One row: hosts, split into internal and external."""
    inside = nw.is_internal("host").cast("bigint")
    return hosts(flows).agg(
        F.count(F.lit(1)).alias("total_ips"),
        F.coalesce(F.sum(inside), F.lit(0)).alias("internal_ips"),
        F.coalesce(F.sum(1 - inside), F.lit(0)).alias("external_ips"),
    )


def protocol_distribution(connections: DataFrame, top: int = 10) -> DataFrame:
    """Rows per protocol with their share of all rows."""
    counted = connections.groupBy("proto").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = with_group_totals(counted, top, [F.desc("cnt"), F.asc("proto")], {"total": F.sum("cnt")})
    return ranked.select("proto", "cnt", F.round(F.col("cnt") / F.col("total") * 100, 1).alias("percentage"))


def endpoint_counters(connections: DataFrame, top: int = 20) -> DataFrame:
    """Top source and destination addresses and ports, one pass over the rows."""
    ends = F.array(
        F.struct(F.lit("src_ip").alias("counter"), F.col("src_ip").alias("key")),
        F.struct(F.lit("dst_ip").alias("counter"), F.col("dst_ip").alias("key")),
        F.struct(F.lit("src_port").alias("counter"), F.nullif("src_port", F.lit(0)).cast("string").alias("key")),
        F.struct(F.lit("dst_port").alias("counter"), F.nullif("dst_port", F.lit(0)).cast("string").alias("key")),
    )
    counted = (
        connections.select(F.inline(ends))
        .where(F.col("key").isNotNull())
        .groupBy("counter", "key")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return top_per_group(counted, ["counter"], top, F.desc("cnt"), F.asc("key"), name="rank")


def port_last_protocol(connections: DataFrame) -> DataFrame:
    """Protocol seen last on each destination port."""
    used = connections.where(F.col("dst_port") > 0)
    return used.groupBy("dst_port").agg(F.max_by("proto", F.struct("ts", "proto")).alias("proto"))


def estimated_packets(convs: DataFrame) -> DataFrame:
    """Packet total of a source that has no packets of its own."""
    return convs.agg(F.coalesce(F.sum("packets"), F.lit(0)).alias("packet_count"))


def capture_summary(tables) -> DataFrame:
    """One row per measure of a capture: ``measure``, ``value``.

    Every table contributes its own few-row aggregate; the union avoids joining
    single rows to each other.
    """
    conns = tables.connections
    base = conns.agg(
        F.count(F.lit(1)).alias("connections"),
        F.coalesce(F.sum("packets"), F.lit(0)).alias("packets"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out"),
        F.round(F.max("ts") - F.min("ts"), 1).alias("duration_seconds"),
    )
    rows = base.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
                    for c in ("connections", "packets", "bytes_out", "duration_seconds")
                ]
            )
        )
    )
    unique = hosts(conns).agg(F.count(F.lit(1)).cast("double").alias("value"))
    rows = rows.unionByName(unique.select(F.lit("unique_ips").alias("measure"), "value"))
    for name in ("dns_queries", "dns_responses", "http_requests", "tls_handshakes", "ot_transactions", "cleartext_creds"):
        table = tables.present().get(name)
        if table is not None:
            counted = table.agg(F.count(F.lit(1)).cast("double").alias("value"))
            rows = rows.unionByName(counted.select(F.lit(name).alias("measure"), "value"))
    return rows


# --- DNS and TLS overviews -----------------------------------------------------------


def dns_activity(queries: DataFrame, responses: DataFrame, top: int = 30) -> DataFrame:
    """Top names with query, source and answer counts.

    Only the kept names are joined to their answers; both sides are aggregates.
    """
    asked = queries.groupBy("query").agg(
        F.count(F.lit(1)).alias("queries"), F.countDistinct("src_ip").alias("sources")
    )
    kept = top_n(asked, top, F.desc("queries"), F.asc("query"))
    answered = responses.where(F.col("query").isNotNull()).groupBy("query").agg(F.countDistinct("answer").alias("answers"))
    return kept.join(answered, "query", "left").select(
        "query", "queries", "sources", F.coalesce("answers", F.lit(0)).alias("answers")
    )


def tls_by_name(handshakes: DataFrame, top: int | None = 30) -> DataFrame:
    """Top server names with handshake and distinct-destination counts."""
    named = handshakes.where(F.coalesce("sni", F.lit("")) != "")
    counted = named.groupBy("sni").agg(
        F.count(F.lit(1)).alias("cnt"), F.countDistinct("dst_ip").alias("destinations")
    )
    return top_n(counted, top, F.desc("cnt"), F.asc("sni"))


def tls_name_destinations(handshakes: DataFrame, top: int = 20) -> DataFrame:
    """Every destination of each of the top server names, one row each."""
    named = handshakes.where(F.coalesce("sni", F.lit("")) != "")
    kept = tls_by_name(handshakes, top).select("sni")
    return named.join(kept, "sni", "left_semi").groupBy("sni", "dst_ip").agg(F.count(F.lit(1)).alias("cnt"))


def tls_without_name(handshakes: DataFrame) -> DataFrame:
    """Distinct (source, destination, port) of handshakes without a server name."""
    bare = handshakes.where(F.coalesce("sni", F.lit("")) == "")
    return bare.select("src_ip", "dst_ip", "dst_port", nw.location("dst_ip").alias("dst_location")).distinct()


def http_listing(requests: DataFrame, top: int = 30) -> DataFrame:
    """First requests in time order."""
    first = top_n(requests, top, F.asc("ts"), F.asc("src_ip"), F.asc("host"), F.asc("path"))
    return first.select("ts", "src_ip", "dst_ip", "method", "host", "path")


# --- hosts, pairs and conversations -----------------------------------------------------


def talkers(convs: DataFrame, top: int = 20, sort_by: str = "bytes") -> DataFrame:
    """Hosts ranked by bytes, connections or packets; connections and packets
    count on the sending side only."""
    if sort_by not in ("bytes", "connections", "packets"):
        raise ValueError("sort_by must be bytes, connections or packets")
    zero = F.lit(0).cast("bigint")
    ends = F.array(
        F.struct(
            F.col("src_ip").alias("host"),
            F.col("dst_ip").alias("peer"),
            F.col("bytes_out").alias("bytes_out"),
            zero.alias("bytes_in"),
            F.lit(1).cast("bigint").alias("connections"),
            F.col("packets").alias("packets"),
        ),
        F.struct(
            F.col("dst_ip").alias("host"),
            F.col("src_ip").alias("peer"),
            zero.alias("bytes_out"),
            F.col("bytes_out").alias("bytes_in"),
            zero.alias("connections"),
            zero.alias("packets"),
        ),
    )
    # distinct peers come from a first aggregate per (host, peer), which also
    # spreads a host that owns many flows
    per_peer = convs.select(F.inline(ends)).groupBy("host", "peer").agg(
        *[F.sum(c).alias(c) for c in ("bytes_out", "bytes_in", "connections", "packets")]
    )
    per_host = per_peer.groupBy("host").agg(
        *[F.sum(c).alias(c) for c in ("bytes_out", "bytes_in", "connections", "packets")],
        F.count("peer").alias("peer_count"),
    )
    per_host = per_host.where(F.col("host").isNotNull()).withColumn("total_bytes", F.col("bytes_out") + F.col("bytes_in"))
    metric = {"bytes": "total_bytes"}.get(sort_by, sort_by)
    ranked = ranked_top_n(per_host, top, F.desc(metric), F.asc("host"))
    return ranked.select(
        "rank", "host", nw.location("host").alias("location"), "bytes_out", "bytes_in", "total_bytes",
        "connections", "packets", "peer_count",
    )


def top_conversations(convs: DataFrame, top: int = 20, sort_by: str = "bytes") -> DataFrame:
    if sort_by not in ("bytes", "packets", "duration"):
        raise ValueError("sort_by must be bytes, packets or duration")
    timed = convs.withColumn("duration", span())
    metric = {"bytes": "bytes_out"}.get(sort_by, sort_by)
    ranked = ranked_top_n(timed, top, F.desc(metric), *_by_key())
    return ranked.select(
        "rank", *CONVERSATION_KEYS, "packets", "bytes_out", F.round("duration", 3).alias("duration"),
        nw.direction("src_ip", "dst_ip").alias("direction"),
    )


def long_connections(
    convs: DataFrame, min_seconds: float = 300.0, inclusive: bool = True, top: int = 20, ip: str | None = None
) -> DataFrame:
    """Conversations that last at least (or, exclusively, longer than) a threshold."""
    timed = touching(convs, ip).withColumn("duration", span())
    test = F.col("duration") >= min_seconds if inclusive else F.col("duration") > min_seconds
    ranked = top_n(timed.where(test), top, F.desc("duration"), *_by_key())
    return ranked.select(*CONVERSATION_KEYS, F.round("duration", 3).alias("duration"), "packets", "bytes_out")


def bidirectional_pairs(convs: DataFrame, top: int = 20, ip: str | None = None) -> DataFrame:
    """Both directions of each host pair side by side (pair in text order)."""
    a, b = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
    forward = F.col("src_ip") == F.col("host_a")
    flows = touching(convs, ip).withColumn("host_a", a).withColumn("host_b", b)
    pairs = flows.groupBy("host_a", "host_b").agg(
        F.sum(F.when(forward, F.col("bytes_out")).otherwise(0)).alias("bytes_a_to_b"),
        F.sum(F.when(forward, 0).otherwise(F.col("bytes_out"))).alias("bytes_b_to_a"),
        F.sum(F.when(forward, F.col("packets")).otherwise(0)).alias("packets_a_to_b"),
        F.sum(F.when(forward, 0).otherwise(F.col("packets"))).alias("packets_b_to_a"),
        F.array_sort(F.collect_set("dst_port")).alias("ports"),
        F.array_sort(F.collect_set("proto")).alias("protocols"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    larger, smaller = F.greatest("bytes_a_to_b", "bytes_b_to_a"), F.least("bytes_a_to_b", "bytes_b_to_a")
    scored = pairs.withColumn("total_bytes", F.col("bytes_a_to_b") + F.col("bytes_b_to_a"))
    ranked = top_n(scored, top, F.desc("total_bytes"), F.asc("host_a"), F.asc("host_b"))
    return ranked.select(
        "host_a", "host_b", nw.direction("host_a", "host_b", "<->").alias("direction"),
        "bytes_a_to_b", "bytes_b_to_a", "total_bytes", "packets_a_to_b", "packets_b_to_a",
        F.round(nw.ratio(larger, smaller), 4).alias("ratio"), "ports", "protocols",
        F.round(span(), 3).alias("duration"),
    )


def protocol_breakdown(
    convs: DataFrame, queries: DataFrame, requests: DataFrame, handshakes: DataFrame, top: int = 50, ip: str | None = None
) -> DataFrame:
    """Per source host: conversations, bytes, DNS, HTTP and TLS counts."""

    def counted(df: DataFrame, kind: str) -> DataFrame:
        mine = df if ip is None else df.where(F.col("src_ip") == ip)
        return mine.groupBy("src_ip").agg(
            F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("total_bytes")
        ).select("src_ip", F.lit(kind).alias("kind"), "n", "total_bytes")

    flows = touching(convs, ip).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_out").alias("total_bytes"))
    parts = flows.select("src_ip", F.lit("conversation").alias("kind"), "n", "total_bytes")
    for df, kind in ((queries, "dns"), (requests, "http"), (handshakes, "tls")):
        parts = parts.unionByName(counted(df, kind))
    per_host = parts.groupBy(F.col("src_ip").alias("host")).agg(
        *[
            F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(f"{kind}_count")
            for kind in ("conversation", "dns", "http", "tls")
        ],
        F.sum("total_bytes").alias("total_bytes"),
    )
    return top_n(per_host.where(F.col("host").isNotNull()), top, F.desc("total_bytes"), F.asc("host"))


# --- one indicator over all tables -----------------------------------------------------


def indicator_search(
    indicator: str, convs: DataFrame, queries: DataFrame, responses: DataFrame, requests: DataFrame,
    handshakes: DataFrame, per_store: int | None = None,
) -> DataFrame:
    """Evidence for one address, port or name over all stores; optionally the first rows of each."""
    value = indicator.strip()
    if not value:
        raise ValueError("indicator is required")
    is_ip = bool(_IP.match(value))
    is_port = value.isdigit() and 1 <= int(value) <= 65535
    low = value.lower()
    ends = (F.col("src_ip") == value) | (F.col("dst_ip") == value)
    never = F.lit(False)
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(low)

    def store(df: DataFrame, name: str, test: Column, ts: str, detail: Column) -> DataFrame:
        hits = df.where(test).select(F.lit(name).alias("store"), F.col(ts).alias("ts"), "src_ip", "dst_ip", detail.alias("detail"))
        return top_n(hits, per_store, F.asc("ts"), F.asc("src_ip"), F.asc("dst_ip"), F.asc("detail"))

    port_text = F.concat(F.lit(":"), F.col("dst_port").cast("string"), F.lit("/"), F.col("proto"))
    on_port = (F.col("dst_port") == int(value)) if is_port else never
    return (
        store(convs, "conversation", ends if is_ip else on_port, "first_seen", port_text)
        .unionByName(store(queries, "dns_query", ends if is_ip else (never if is_port else has("query")), "ts", F.col("query")))
        .unionByName(
            store(
                responses, "dns_answer", (F.col("answer") == value) if is_ip else (never if is_port else has("query")),
                "ts", F.concat_ws(" -> ", "query", "answer"),
            )
        )
        .unionByName(
            store(
                requests, "http", ends if is_ip else (never if is_port else has("host") | has("path")),
                "ts", F.concat(F.col("method"), F.lit(" "), F.col("host"), F.col("path")),
            )
        )
        .unionByName(
            store(handshakes, "tls", ends if is_ip else (on_port if is_port else has("sni")), "ts", F.coalesce("sni", F.lit("")))
        )
    )


def timeline(
    convs: DataFrame, queries: DataFrame, requests: DataFrame, handshakes: DataFrame | None = None,
    ip: str | None = None, limit: int | None = None, either_end: bool = True,
) -> DataFrame:
    """Connections, DNS, HTTP and TLS events in time order.

    ``either_end`` also takes DNS and HTTP rows whose destination is the
    address; without it only their source counts.
    """
    mine = (lambda df: touching(df, ip)) if either_end else (
        lambda df: df if ip is None else df.where(F.col("src_ip") == ip)
    )
    empty = F.lit(None).cast("string")
    flows = touching(convs, ip).where(F.col("first_seen").isNotNull()).select(
        F.col("first_seen").alias("ts"), F.lit("connection").alias("type"), "src_ip", "dst_ip",
        F.concat(F.col("dst_port").cast("string"), F.lit("/"), F.col("proto")).alias("detail"),
        (F.when(F.col("src_ip") == ip, "outbound").otherwise("inbound") if ip else empty).alias("direction"),
    )
    events = flows.unionByName(
        mine(queries).select("ts", F.lit("dns").alias("type"), "src_ip", "dst_ip", F.col("query").alias("detail"), empty.alias("direction"))
    ).unionByName(
        mine(requests).select(
            "ts", F.lit("http").alias("type"), "src_ip", "dst_ip",
            F.concat(F.col("method"), F.lit(" "), F.col("host"), F.col("path")).alias("detail"), empty.alias("direction"),
        )
    )
    if handshakes is not None:
        events = events.unionByName(
            mine(handshakes).select(
                "ts", F.lit("tls").alias("type"), "src_ip", "dst_ip",
                F.coalesce("sni", F.lit("")).alias("detail"), empty.alias("direction"),
            )
        )
    return top_n(events, limit, F.asc("ts"), F.asc("type"), F.asc("src_ip"), F.asc("dst_ip"), F.asc("detail"))


def bandwidth_text(top_convs: DataFrame) -> DataFrame:
    """Display columns for a conversation ranking."""
    return top_convs.withColumn("bytes_text", tx.bytes_text("bytes_out"))
