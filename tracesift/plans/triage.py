"""Composed reports: named sets of operator results over one capture set.

Conversations feed most parts, so they are built once; pass ``persist=True`` to
keep them (spilling to disk) while the parts run.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tracesift.operators import flows, hunts, netops, ot
from tracesift.schemas import TrafficTables
from tracesift.sources import packets as pk


def _conversations(tables: TrafficTables, persist: bool) -> DataFrame:
    convs = flows.conversations(tables.connections)
    return convs.persist(StorageLevel.MEMORY_AND_DISK) if persist else convs


def security_triage(tables: TrafficTables, persist: bool = False) -> dict[str, DataFrame]:
    """Talkers, conversations, ports, beacons, DNS, TLS, lateral movement, exfiltration."""
    convs = _conversations(tables, persist)
    return {
        "host_totals": flows.host_totals(convs),
        "protocols": flows.protocol_distribution(tables.connections),
        "talkers": flows.talkers(convs, 15),
        "conversations": flows.top_conversations(convs),
        "ports": hunts.port_usage(convs),
        "beacons": hunts.beacons(tables.connections),
        "dga": hunts.dga_candidates(tables.dns_queries),
        "tunnels": hunts.tunnel_candidates(tables.dns_queries),
        "tls": hunts.tls_names(tables.tls_handshakes),
        "exfiltration": hunts.asymmetric_outbound(convs),
        "lateral": hunts.lateral_movement(convs),
        "scans": hunts.horizontal_scans(convs),
        "findings": hunts.findings(tables.connections, convs, tables.dns_queries, tables.tls_handshakes),
    }


def industrial_report(tables: TrafficTables, persist: bool = False) -> dict[str, DataFrame]:
    """Industrial protocol activity, credentials, and the IT hunts that go with it."""
    convs = _conversations(tables, persist)
    return {
        "protocols": ot.by_protocol(tables.ot_transactions),
        "endpoints": ot.endpoints(tables.ot_transactions),
        "writes": ot.writes_by_source(tables.ot_transactions),
        "controls": ot.flagged(tables.ot_transactions, "control"),
        "exceptions": ot.exceptions_by_function(tables.ot_transactions),
        "modbus": ot.modbus_functions(tables.ot_transactions),
        "credentials": ot.credentials_by_protocol(tables.cleartext_creds),
        "zones": ot.zone_matrix(convs),
        "beacons": hunts.beacons(tables.connections),
        "ics_cross_zone": hunts.ics_cross_zone(convs),
        "ports": hunts.port_usage(convs),
    }


def operations_report(tables: TrafficTables, persist: bool = False) -> dict[str, DataFrame]:
    """Network health of a packet capture."""
    convs = _conversations(tables, persist)
    errors, loops = pk.icmp_errors(tables.packets), pk.loop_packets(tables.packets)
    out = {
        "tcp": netops.tcp_health(tables.packets),
        "problem_conversations": netops.problem_conversations(tables.packets),
        "icmp": netops.icmp_by_description(errors),
        "routing_loops": netops.routing_loops(errors),
        "duplicate_loops": netops.duplicate_loops(loops),
        "arp": netops.arp_health(tables.packets),
        "arp_requesters": netops.arp_requesters(tables.packets),
        "arp_conflicts": netops.arp_conflicts(tables.packets),
        "fragmentation": netops.fragmentation(tables.packets),
        "ttl_families": netops.ttl_families(tables.packets),
        "bandwidth": flows.top_conversations(convs, 15),
        "long_connections": flows.long_connections(convs, inclusive=False, top=15),
        "ports": hunts.ops_port_usage(convs),
        "subnets": netops.subnet_scores(tables.packets, errors, loops),
    }
    if tables.dns_queries is not None and tables.dns_responses is not None:
        out["dns_unanswered"] = netops.dns_unanswered(tables.dns_queries, tables.dns_responses)
        out["dns_clients"] = netops.dns_clients(tables.dns_queries)
    if tables.control_plane is not None:
        out["stp"] = netops.stp_summary(tables.control_plane)
        out["hsrp"] = netops.redundancy_groups(tables.control_plane, "HSRP")
        out["vrrp"] = netops.redundancy_groups(tables.control_plane, "VRRP")
        out["ospf"] = netops.ospf_summary(tables.control_plane)
        out["eigrp"] = netops.eigrp_summary(tables.control_plane)
    return out
