"""Canonical column layouts. Missing values are null, never ``''`` or 0."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "log_lines": "file_path string, line_no bigint, line string",
    "fw_entries": (
        "file_path string, line_no bigint, timestamp string, src_ip string, dst_ip string, src_port int, "
        "dst_port int, protocol string, action string, bytes_sent bigint, bytes_recv bigint, rule string, "
        "interface string, raw string"
    ),
    "packets": (
        "capture string, pkt_no bigint, ts double, frame_len int, eth_type int, src_mac string, dst_mac string, "
        "src_ip string, dst_ip string, ip_proto int, ip_id int, ttl int, frag boolean, src_port int, dst_port int, "
        "tcp_flags int, tcp_window int, icmp_type int, icmp_code int, arp_op int, arp_spa string, arp_tpa string, "
        "arp_sha string, payload binary"
    ),
    "connections": (
        "capture string, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto string, "
        "service string, packets bigint, bytes_out bigint, bytes_in bigint, duration double, conn_state string"
    ),
    "dns_queries": "capture string, ts double, src_ip string, dst_ip string, query string, qtype string",
    "dns_responses": (
        "capture string, ts double, src_ip string, dst_ip string, query string, qtype string, answer string, "
        "rcode string"
    ),
    "http_requests": (
        "capture string, ts double, src_ip string, dst_ip string, method string, host string, path string, "
        "user_agent string, status_code int, content_type string, request_len bigint, response_len bigint"
    ),
    "tls_handshakes": (
        "capture string, ts double, src_ip string, dst_ip string, dst_port int, sni string, version string, "
        "cipher string, ja3 string, ja3s string, subject string, issuer string, validation_status string"
    ),
    "ot_transactions": (
        "capture string, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, "
        "unit_id int, function_code int, function_name string, pdu_type string, is_write boolean, "
        "is_control boolean, is_diagnostic boolean, is_exception boolean, exception_code int"
    ),
    "cleartext_creds": (
        "capture string, ts double, src_ip string, dst_ip string, port int, protocol string, description string"
    ),
    "icmp_errors": (
        "capture string, ts double, src_ip string, dst_ip string, icmp_type int, icmp_code int, description string"
    ),
    "loop_packets": "capture string, src_ip string, dst_ip string, proto string, ip_id int, ttl int, prev_ttl int",
    "control_plane": (
        "capture string, ts double, protocol string, msg_type string, src string, dst string, group_id int, "
        "state string, priority int, virtual_ip string, root_bridge string, area string, router_id string, "
        "as_number int"
    ),
    "weird_events": "capture string, ts double, name string, src_ip string, dst_ip string, addl string",
    "reports": "report_path string, name string, subdirectory string, text string",
    "iocs": (
        "report_path string, ioc_type string, value string, raw_value string, defanged boolean, context string, "
        "confidence string, priority string, related_mitre array<string>"
    ),
    "techniques": "technique_id string, name string, tactics array<string>, matrix string, url string",
    "technique_mappings": (
        "report_path string, technique_id string, technique_name string, tactic string, confidence string, "
        "report_context string, context_paths array<string>, mitre_validated boolean, tactic_mismatch boolean"
    ),
    "attack_paths": (
        "report_path string, path_no int, path_id string, steps array<struct<technique_id:string,"
        "technique_name:string,tactic:string,leads_to:array<string>>>"
    ),
    "chunks": (
        "report_path string, chunk_no int, refined_iocs array<struct<ioc_type:string,value:string,"
        "confidence:string,priority:string,context:string,related_mitre:array<string>,is_false_positive:boolean>>, "
        "additional_mitre_techniques array<struct<technique_id:string,technique_name:string,tactic:string,"
        "confidence:string,report_context:string>>, report_metadata map<string,string>, "
        "attack_graph struct<paths:array<struct<path_id:string,description:string,"
        "steps:array<struct<technique_id:string,technique_name:string,tactic:string,leads_to:array<string>>>>>,"
        "convergence_points:array<string>,branch_points:array<string>>"
    ),
    "stages": (
        "assessment_id string, attack_type string, stage_no int, name string, technique_claimed string, "
        "mitre_technique_id string, stage_present boolean, controls array<struct<control_name:string,"
        "control_type:string,effectiveness_rating:string,evidence_basis:string,independence_flag:boolean>>, "
        "assumptions array<string>, gaps_detected array<string>"
    ),
    "scenarios": "scenario_id string, name string, description string, source_type string, created_at string",
    "scenario_controls": (
        "scenario_id string, control_id string, name string, control_type string, implementation_status string, "
        "bypass_difficulty string, detection_capability string"
    ),
    "scenario_events": (
        "scenario_id string, event_id string, name string, sequence_order int, technique_id string, "
        "blocking_controls array<string>, detecting_controls array<string>"
    ),
    "inventory": "root string, priority int, workspace string, filename string, object_path string",
}


def struct_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select the canonical columns in order, null where the source has none."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_of(name).fields
        ]
    )


@dataclass
class TrafficTables:
    """One capture set as lazy tables; any table a source lacks may be ``None``."""

    connections: DataFrame | None = None
    packets: DataFrame | None = None
    dns_queries: DataFrame | None = None
    dns_responses: DataFrame | None = None
    http_requests: DataFrame | None = None
    tls_handshakes: DataFrame | None = None
    ot_transactions: DataFrame | None = None
    cleartext_creds: DataFrame | None = None
    icmp_errors: DataFrame | None = None
    control_plane: DataFrame | None = None
    weird_events: DataFrame | None = None

    def present(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}
