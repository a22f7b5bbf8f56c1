"""Building blocks of the DuckDB oracle texts.

The oracles state each result a second time, in plain SQL over the registered
tables; they share the input views and the fixed values, not the operators.
"""

from __future__ import annotations

import re

from tracesift.functions import fixed_values as fv

from .bindings import view_sql

_OCT = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"


def internal(ip: str) -> str:
    rx = rf"^(10(\.{_OCT}){{3}}|172\.(1[6-9]|2\d|3[01])(\.{_OCT}){{2}}|192\.168(\.{_OCT}){{2}})$"
    return f"coalesce(regexp_matches({ip}, '{rx}'), false)"


def loc(ip: str) -> str:
    return f"CASE WHEN {internal(ip)} THEN 'INT' ELSE 'EXT' END"


def ports(table) -> str:
    return "(" + ", ".join(str(p) for p in sorted(table)) + ")"


def case_of(key: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k!r} THEN {_quote(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def _quote(v) -> str:
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def service(port: str) -> str:
    known = case_of(port, fv.KNOWN_SERVICES)
    ics = case_of(port, {p: f"ICS:{n}" for p, n in fv.ICS_PORTS.items()})
    bad = case_of(port, {p: f"SUSPECT:{n}" for p, n in fv.SUSPICIOUS_PORTS.items()})
    return f"coalesce({known}, {ics}, {bad}, CAST({port} AS VARCHAR))"


def strip(c: str) -> str:
    chars = " || ".join(f"chr({ord(ch)})" for ch in fv.WHITESPACE)
    return f"trim({c}, {chars})"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def signature(line: str, cut: int, skip: tuple[str, ...] = ()) -> tuple[str, str]:
    out = strip(line)
    for pattern, token in fv.SIGNATURE_RULES:
        if token not in skip:
            out = f"regexp_replace({out}, {sql_text(pattern)}, '{token}', 'g')"
    return out, f"CASE WHEN length(sig) > {cut} THEN substr(sig, 1, {cut}) || '...' ELSE sig END"


def hexbyte(c: str, i: int) -> str:
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr({c}, {at}, 1)) - 1)"
    return f"({digit(2 * i + 1)} * 16 + {digit(2 * i + 2)})"


def ascii_text(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^([0-7].)*$') THEN decode(unhex({c})) ELSE '' END"


# derived relations that several oracles use: name -> (text, views it needs)
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {}
DERIVED["convs"] = (
    """SELECT src_ip, dst_ip, dst_port, proto, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
  CAST(sum(bytes_in) AS BIGINT) AS bytes_in, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_connections
FROM connections GROUP BY src_ip, dst_ip, dst_port, proto""",
    ("connections",),
)
DERIVED["icmp"] = (
    f"""SELECT * FROM (SELECT capture, ts, src_ip, dst_ip, icmp_type, icmp_code,
  coalesce({case_of('icmp_type * 256 + icmp_code', {a * 256 + b: t for (a, b), t in fv.ICMP_ERRORS.items()})},
    CASE WHEN icmp_type IN (3, 5, 11) THEN concat('ICMP type=', icmp_type, ' code=', icmp_code) END) AS description
FROM packets WHERE ip_proto = 1) q WHERE description IS NOT NULL""",
    ("packets",),
)
DERIVED["loops"] = (
    """SELECT capture, src_ip, dst_ip, CASE ip_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'OTHER' END AS proto, ip_id, ttl, prev_ttl
FROM (SELECT *, lag(ttl) OVER (PARTITION BY capture, src_ip, dst_ip, ip_proto, ip_id ORDER BY pkt_no) AS prev_ttl
  FROM packets WHERE src_ip IS NOT NULL AND ip_id <> 0) q WHERE prev_ttl <> ttl""",
    ("packets",),
)
_MB, _S7, _DNP = "protocol = 'Modbus'", "protocol = 'S7comm'", "protocol = 'DNP3'"
DERIVED["ot"] = (
    f"""SELECT capture, ts, src_ip, dst_ip, src_port, dst_port, protocol,
  CASE WHEN {_MB} THEN b6 END AS unit_id,
  CASE WHEN {_MB} THEN b7 % 128 WHEN {_DNP} THEN b13 END AS function_code,
  CASE WHEN {_MB} THEN coalesce({case_of('b7 % 128', fv.MODBUS_FUNCTIONS)}, concat('FC-', b7 % 128))
    WHEN {_S7} AND b8 IN (1, 3) THEN coalesce({case_of('b14', fv.S7_FUNCTIONS)}, concat('0x', lower(substr(payload_hex, 29, 2))))
    WHEN {_DNP} THEN coalesce({case_of('b13', fv.DNP3_FUNCTIONS)}, concat('FC-', b13)) END AS function_name,
  CASE WHEN {_S7} THEN coalesce({case_of('b8', fv.S7_PDU_TYPES)}, concat('0x', lower(substr(payload_hex, 17, 2)))) END AS pdu_type,
  CASE WHEN {_MB} THEN b7 % 128 IN {ports(fv.MODBUS_WRITES)} WHEN {_S7} AND b8 IN (1, 3) THEN b14 IN {ports(fv.S7_WRITES)}
    WHEN {_DNP} THEN b13 IN {ports(fv.DNP3_WRITES)} END AS is_write,
  CASE WHEN {_S7} AND b8 IN (1, 3) THEN b14 IN {ports(fv.S7_CONTROLS)} WHEN {_DNP} THEN b13 IN {ports(fv.DNP3_CONTROLS)} END AS is_control,
  CASE WHEN {_MB} THEN b7 % 128 IN {ports(fv.MODBUS_DIAGNOSTICS)} END AS is_diagnostic,
  CASE WHEN {_MB} THEN b7 >= 128 END AS is_exception,
  CASE WHEN {_MB} AND b7 >= 128 THEN b8 END AS exception_code
FROM (SELECT *, {', '.join(f"{hexbyte('payload_hex', i)} AS b{i}" for i in (6, 7, 8, 13, 14))},
    CASE WHEN ip_proto = 6 THEN named ELSE concat(named, '') END AS protocol
  FROM (SELECT *, coalesce({case_of('dst_port', fv.OT_PROTOCOL_PORTS)}, {case_of('src_port', fv.OT_PROTOCOL_PORTS)}) AS named FROM packets) p
  WHERE named IS NOT NULL) q""".replace("protocol = '", "ip_proto = 6 AND protocol = '"),
    ("packets",),
)


def _cred_arms(field: int) -> str:
    arms = []
    for protocol, wanted, pattern, description in fv.CREDENTIAL_RULES:
        tests = []
        if wanted is not None:
            tests.append(f"(dst_port IN {ports(wanted)} OR src_port IN {ports(wanted)})")
        if pattern == r"(?s)\x80.{0,4}(\x04)":
            tests.append("false")  # the sample payloads hold no such bytes
        elif pattern is not None:
            tests.append(f"regexp_matches(body, {sql_text(pattern)})")
        port = "dst_port"
        if pattern is None:
            port = f"CASE WHEN dst_port IN {ports(wanted)} THEN dst_port ELSE src_port END"
        value = (sql_text(protocol), sql_text(description), port)[field]
        arms.append(f"WHEN {' AND '.join(tests)} THEN {value}")
    return "CASE " + " ".join(arms) + " END"


DERIVED["creds"] = (
    f"""SELECT * FROM (SELECT capture, ts, src_ip, dst_ip, CAST({_cred_arms(2)} AS INT) AS port, {_cred_arms(0)} AS protocol, {_cred_arms(1)} AS description
FROM (SELECT *, {ascii_text('payload_hex')} AS body FROM packets WHERE length(payload_hex) >= 8) p) q WHERE protocol IS NOT NULL""",
    ("packets",),
)


def _decimal_rounds(sql: str) -> str:
    """``round(x, n)`` on the decimal digits of a double, as Spark rounds."""
    out, at = "", 0
    for match in re.finditer(r"(?<![_a-z])round\(", sql):
        if match.start() < at:
            continue
        depth, i, comma = 1, match.end(), -1
        while depth:
            depth += (sql[i] == "(") - (sql[i] == ")")
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        value = _decimal_rounds(sql[match.end() : comma])
        out += sql[at : match.start()] + f"CAST(round(CAST({value} AS DECIMAL(38, 15)),{sql[comma + 1 : i - 1]}) AS DOUBLE)"
        at = i
    return out + sql[at:]


def oracle(sql: str, *names: str) -> str:
    """``sql`` with the views and derived relations it names, each given once."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dep in DERIVED.get(name, ("", ()))[1]:
            need(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    body = _decimal_rounds(sql.strip())
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({DERIVED[n][0] if n in DERIVED else view_sql(n)})" for n in ordered)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
