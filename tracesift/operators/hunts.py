"""Threat hunts: beacons, DNS anomalies, TLS, lateral movement, exfiltration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import network as nw
from tracesift.functions import text as tx

from .flows import span, tls_by_name, with_locations
from .ranking import gap_statistics, numbered, top_n, top_per_group


# --- ports ---------------------------------------------------------------------------


def _port_totals(convs: DataFrame) -> DataFrame:
    used = convs.where(F.col("dst_port") > 0)
    return used.groupBy("dst_port").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.countDistinct("src_ip").alias("source_count"),
        F.countDistinct("dst_ip").alias("destination_count"),
        F.sum("bytes_out").alias("bytes"),
        F.sum("packets").alias("packets"),
    )


def port_usage(convs: DataFrame, standard: int | None = None, unknown: int | None = None) -> DataFrame:
    """Ports by category, all of them unless the standard or unknown-high ones
    are to be cut to the busiest. A port named in two lists appears under both."""
    port = F.col("dst_port")
    category = F.filter(
        F.array(
            F.when(nw.port_in(port, fv.KNOWN_SERVICES), "standard"),
            F.when(nw.port_in(port, fv.ICS_PORTS), "ics"),
            F.when(nw.port_in(port, fv.SUSPICIOUS_PORTS), "suspicious"),
            F.when(
                ~nw.port_in(port, fv.KNOWN_SERVICES | fv.ICS_PORTS | fv.SUSPICIOUS_PORTS) & (port > 1024), "unknown_high"
            ),
        ),
        lambda c: c.isNotNull(),
    )
    listed = _port_totals(convs).withColumn("category", F.explode(category))
    ranked = top_per_group(listed, ["category"], 65536, F.desc("flow_count"), F.asc("dst_port"), name="rank")
    limit = F.when(F.col("category") == "standard", F.lit(standard)).when(F.col("category") == "unknown_high", F.lit(unknown))
    service = (
        F.when(F.col("category") == "standard", nw.lookup(port, fv.KNOWN_SERVICES))
        .when(F.col("category") == "ics", nw.lookup(port, fv.ICS_PORTS))
        .when(F.col("category") == "suspicious", nw.lookup(port, fv.SUSPICIOUS_PORTS))
        .otherwise("unknown")
    )
    return ranked.where(limit.isNull() | (F.col("rank") <= limit)).select(
        "category", "rank", "dst_port", service.alias("service"), "flow_count", "source_count", "destination_count", "bytes"
    )


def ops_port_usage(convs: DataFrame, known: int = 20, other: int = 15) -> DataFrame:
    """Port distribution with the operations naming, threat categories left out."""
    name = nw.lookup(F.col("dst_port"), fv.OPS_SERVICES)
    totals = _port_totals(convs).withColumn("service", name)
    totals = totals.withColumn("known", F.col("service").isNotNull()).where(F.col("known") | (F.col("dst_port") > 1024))
    ranked = top_per_group(totals, ["known"], max(known, other), F.desc("flow_count"), F.asc("dst_port"), name="rank")
    keep = F.col("rank") <= F.when(F.col("known"), known).otherwise(other)
    return ranked.where(keep).select("known", "rank", "dst_port", "service", "flow_count", "source_count", "bytes", "packets")


def ports_severity(usage: DataFrame) -> DataFrame:
    """One row. Suspicious ports do not raise the level once ICS ports set it."""
    has = lambda c: F.max((F.col("category") == c).cast("int")) == 1
    return usage.agg(
        F.when(F.coalesce(has("ics"), F.lit(False)), "high")
        .when(F.coalesce(has("suspicious"), F.lit(False)), "critical")
        .otherwise("info")
        .alias("severity")
    )


# --- beacons ----------------------------------------------------------------------------


def beacons(
    connections: DataFrame, min_connections: int = 10, max_jitter_pct: float = 15.0, bucket_seconds: float = 900.0
) -> DataFrame:
    """Regular internal-to-external traffic, from the start times of connections.

    Times come from the connections themselves, not from one first-seen time
    per conversation, and none are dropped.
    """
    outbound = connections.where(nw.is_internal("src_ip") & ~nw.is_internal("dst_ip") & F.col("dst_ip").isNotNull())
    stats = gap_statistics(outbound, ["src_ip", "dst_ip", "dst_port"], "ts", bucket_seconds)
    jitter = F.col("std_gap") / F.col("mean_gap") * 100
    found = (
        stats.where((F.col("n") >= min_connections) & (F.col("mean_gap") > 0))
        .withColumn("jitter", jitter)
        .where(F.col("jitter") <= max_jitter_pct)
    )
    return found.orderBy(F.asc("jitter"), F.asc("src_ip"), F.asc("dst_ip"), F.asc("dst_port")).select(
        "src_ip", "dst_ip", "dst_port", nw.service_label("dst_port").alias("service"),
        F.col("n").alias("connections"),
        F.round("mean_gap", 2).alias("mean_interval"),
        F.round("std_gap", 2).alias("std_deviation"),
        F.round("jitter", 1).alias("jitter_pct"),
        F.round(F.col("last_ts") - F.col("first_ts"), 1).alias("duration"),
        F.when(F.col("jitter") < 5, "HIGH").otherwise("MEDIUM").alias("confidence"),
    )


# --- DNS -----------------------------------------------------------------------------------


def dga_candidates(queries: DataFrame, min_label: int = 11, min_entropy: float = 3.5, top: int | None = None) -> DataFrame:
    """Names whose first label is long and of high entropy; ``top=None`` for all."""
    label = tx.domain_label("query")
    names = queries.where(F.col("query").contains(".")).select("query").distinct()
    scored = (
        names.withColumn("label", label)
        .where(F.length("label") >= min_label)
        .withColumn("raw_entropy", tx.shannon_entropy("label"))
        .where(F.col("raw_entropy") > min_entropy)
    )
    listed = scored.select(
        F.col("query").alias("domain"), "label", F.round("raw_entropy", 2).alias("entropy"),
        F.length("label").alias("label_length"),
    )
    return listed if top is None else top_n(listed, top, F.desc("entropy"), F.asc("domain"))


def tunnel_candidates(queries: DataFrame, min_subdomains: int = 21) -> DataFrame:
    """Base domains with many distinct subdomains."""
    parts = queries.select(tx.base_domain("query").alias("base_domain"), tx.subdomain("query").alias("subdomain"))
    counted = parts.where(F.col("subdomain").isNotNull()).groupBy("base_domain").agg(
        F.countDistinct("subdomain").alias("unique_subdomains")
    )
    return counted.where(F.col("unique_subdomains") >= min_subdomains)


def txt_queries(queries: DataFrame) -> DataFrame:
    """TXT lookups per source and name; the type may be a name or its number."""
    txt = queries.where(F.col("qtype").isin("TXT", "16"))
    return txt.groupBy("src_ip", "query").agg(F.count(F.lit(1)).alias("cnt"))


def frequent_names(queries: DataFrame, top: int | None = None, min_count: int = 51) -> DataFrame:
    """The most queried names, then only those above the threshold."""
    counted = queries.groupBy("query").agg(F.count(F.lit(1)).alias("cnt"))
    return top_n(counted, top, F.desc("cnt"), F.asc("query")).where(F.col("cnt") >= min_count)


# --- TLS ------------------------------------------------------------------------------------


def tls_names(handshakes: DataFrame, named: int | None = None, bare: int | None = None) -> DataFrame:
    """Top server names, and top targets of handshakes without one."""
    names = tls_by_name(handshakes, named).select(
        F.lit("sni").alias("type"), F.col("sni").alias("target"), "cnt", "destinations"
    )
    port = F.coalesce("dst_port", F.lit(443)).cast("string")
    no_name = handshakes.where(F.coalesce("sni", F.lit("")) == "")
    targets = no_name.groupBy(F.concat("dst_ip", F.lit(":"), port).alias("target")).agg(F.count(F.lit(1)).alias("cnt"))
    return names.unionByName(
        top_n(targets, bare, F.desc("cnt"), F.asc("target")).select(
            F.lit("no_sni").alias("type"), "target", "cnt", F.lit(1).cast("bigint").alias("destinations")
        )
    )


# --- lateral movement -----------------------------------------------------------------------


def _management_flows(convs: DataFrame) -> DataFrame:
    return convs.where(
        nw.port_in("dst_port", fv.LATERAL_PORTS) & nw.is_internal("src_ip") & nw.is_internal("dst_ip")
    ).withColumn("service", nw.lookup(F.col("dst_port"), fv.LATERAL_PORTS))


def lateral_movement(convs: DataFrame, scan_above: int = 5) -> DataFrame:
    """Internal management-port activity per source."""
    found = _management_flows(convs).groupBy("src_ip").agg(
        F.countDistinct("dst_ip").alias("target_count"),
        F.count(F.lit(1)).alias("flow_count"),
        F.array_sort(F.collect_set("service")).alias("services"),
    )
    return found.withColumn("potential_scan", F.col("target_count") > scan_above)


def lateral_flows(convs: DataFrame, per_source: int | None = None) -> DataFrame:
    """Flows of every such source, numbered by target and port; optionally the first ones of each."""
    order = (F.asc("dst_ip"), F.asc("dst_port"), F.asc("proto"))
    if per_source:
        ranked = top_per_group(_management_flows(convs), ["src_ip"], per_source, *order, name="flow_no")
    else:
        ranked = numbered(_management_flows(convs), ["src_ip"], *order, name="flow_no")
    return ranked.select("src_ip", "flow_no", "dst_ip", "dst_port", "service", "packets", "bytes_out")


def horizontal_scans(convs: DataFrame, min_targets: int = 5, top: int | None = None) -> DataFrame:
    """Sources that reach many internal hosts on one port."""
    inside = convs.where((F.col("dst_port") > 0) & nw.is_internal("src_ip") & nw.is_internal("dst_ip"))
    counted = inside.groupBy("src_ip", "dst_port").agg(F.countDistinct("dst_ip").alias("target_count"))
    found = counted.where(F.col("target_count") >= min_targets)
    ranked = top_n(found, top, F.desc("target_count"), F.asc("src_ip"), F.asc("dst_port"))
    return ranked.select("src_ip", "dst_port", nw.service_label("dst_port").alias("service"), "target_count")


def ics_cross_zone(convs: DataFrame) -> DataFrame:
    """Industrial-protocol flows with at least one end outside."""
    tagged = with_locations(convs.where(nw.port_in("dst_port", fv.ICS_LATERAL_PORTS)))
    crossing = tagged.where(~(F.col("src_int") & F.col("dst_int")))
    label = lambda c: F.when(F.col(c), "INT").otherwise("EXT")
    return crossing.select(
        "src_ip", "dst_ip", "dst_port", "proto", nw.lookup(F.col("dst_port"), fv.ICS_LATERAL_PORTS).alias("service"),
        "packets", label("src_int").alias("src_location"), label("dst_int").alias("dst_location"),
    )


# --- exfiltration -----------------------------------------------------------------------------


def asymmetric_outbound(convs: DataFrame, min_ratio: float = 10.0, min_bytes_out: int = 1048576) -> DataFrame:
    """Internal-to-external pairs that send much more than they receive.

    Received bytes are the reverse flows' bytes plus the bytes the source
    recorded as inbound on the same rows. Both sides of the join are per-pair
    aggregates, so a busy pair costs one row.
    """
    tagged = with_locations(convs)
    forward = (
        tagged.where(F.col("src_int") & ~F.col("dst_int") & F.col("dst_ip").isNotNull())
        .groupBy("src_ip", "dst_ip")
        .agg(
            F.sum("bytes_out").alias("bytes_out"),
            F.sum(F.coalesce("bytes_in", F.lit(0))).alias("same_row_in"),
            F.sum("packets").alias("packets"),
            F.array_sort(F.collect_set("dst_port")).alias("ports"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
        .where(F.col("bytes_out") >= min_bytes_out)
    )
    reverse = (
        tagged.where(~F.col("src_int") & F.col("dst_int"))
        .groupBy(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"))
        .agg(F.sum("bytes_out").alias("reverse_in"))
    )
    joined = forward.join(reverse, ["src_ip", "dst_ip"], "left").withColumn(
        "bytes_in", F.col("same_row_in") + F.coalesce("reverse_in", F.lit(0))
    )
    share = nw.ratio(F.col("bytes_out"), F.col("bytes_in"))
    return joined.where(share >= min_ratio).select(
        "src_ip", "dst_ip", "bytes_out", "bytes_in", F.round(share, 1).alias("ratio"), "packets", "ports",
        F.round(span(), 3).alias("duration"),
    )


# --- one list of findings -----------------------------------------------------------------------


def _finding(df: DataFrame, hunt: str, kind: str, severity: Column | str, subject: Column, metric: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        F.lit(hunt).alias("hunt"), F.lit(kind).alias("type"), level.alias("severity"),
        subject.alias("subject"), metric.cast("double").alias("metric"),
    )


def findings(connections: DataFrame, convs: DataFrame, queries: DataFrame, handshakes: DataFrame) -> DataFrame:
    """Every detector's hits in one schema: hunt, type, severity, subject, metric."""
    flow = F.concat_ws(" ", "src_ip", "dst_ip", F.col("dst_port").cast("string"))
    source_port = F.concat_ws(" ", "src_ip", F.col("dst_port").cast("string"))
    usage = port_usage(convs)
    parts = [
        _finding(
            beacons(connections), "beacons", "beacon", F.when(F.col("confidence") == "HIGH", "critical").otherwise("high"),
            flow, F.col("jitter_pct"),
        ),
        _finding(dga_candidates(queries), "dns", "dga_candidate", "high", F.col("domain"), F.col("entropy")),
        _finding(tunnel_candidates(queries), "dns", "tunnel_candidate", "high", F.col("base_domain"), F.col("unique_subdomains")),
        _finding(txt_queries(queries), "dns", "txt_query", "info", F.concat_ws(" ", "src_ip", "query"), F.col("cnt")),
        _finding(frequent_names(queries), "dns", "high_frequency", "info", F.col("query"), F.col("cnt")),
        _finding(
            tls_names(handshakes), "tls", "name", F.when(F.col("type") == "no_sni", "medium").otherwise("info"),
            F.concat_ws(" ", "type", "target"), F.col("cnt"),
        ),
        _finding(
            usage, "ports", "port",
            F.when(F.col("category") == "ics", "high").when(F.col("category") == "suspicious", "critical").otherwise("info"),
            F.concat_ws(" ", "category", F.col("dst_port").cast("string")), F.col("flow_count"),
        ),
        _finding(lateral_movement(convs), "lateral", "mgmt_lateral", "high", F.col("src_ip"), F.col("target_count")),
        _finding(horizontal_scans(convs), "lateral", "port_scan", "critical", source_port, F.col("target_count")),
        _finding(ics_cross_zone(convs), "lateral", "ics_cross_zone", "critical", F.concat_ws(" ", flow, "proto"), F.col("packets")),
        _finding(
            asymmetric_outbound(convs), "exfil", "asymmetric_outbound", "critical",
            F.concat_ws(" ", "src_ip", "dst_ip"), F.col("bytes_out"),
        ),
        _finding(tunnel_candidates(queries), "exfil", "dns_exfil", "high", F.col("base_domain"), F.col("unique_subdomains")),
    ]
    return reduce(DataFrame.unionByName, parts)


def hunt_severity(found: DataFrame) -> DataFrame:
    """Severity of each hunt.

    The ports hunt keeps ``high`` once industrial ports set it; every other
    hunt takes its most severe finding.
    """
    rank = nw.lookup(F.col("severity"), {"info": 0, "medium": 1, "high": 2, "critical": 3})
    per_hunt = found.groupBy("hunt").agg(
        F.max(rank).alias("level"), F.max((F.col("severity") == "high").cast("int")).alias("any_high"),
        F.count(F.lit(1)).alias("findings"),
    )
    level = F.when((F.col("hunt") == "ports") & (F.col("any_high") == 1), 2).otherwise(F.col("level"))
    names = F.create_map(F.lit(0), F.lit("info"), F.lit(1), F.lit("medium"), F.lit(2), F.lit("high"), F.lit(3), F.lit("critical"))
    return per_hunt.select("hunt", F.try_element_at(names, level).alias("severity"), "findings")
