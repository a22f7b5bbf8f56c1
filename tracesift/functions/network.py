"""Column expressions over addresses, ports and protocol numbers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PRIVATE = (
    rf"^(10\.{_OCTET}\.{_OCTET}\.{_OCTET}"
    rf"|172\.(1[6-9]|2[0-9]|3[01])\.{_OCTET}\.{_OCTET}"
    rf"|192\.168\.{_OCTET}\.{_OCTET})$"
)
_DOTTED_QUAD = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_internal(ip: Column | str) -> Column:
    """True for RFC 1918 IPv4 addresses; false for all else, null included.

    The prefix test goes first so that most external addresses never reach
    the regular expression.
    """
    ip = col(ip)
    prefixed = ip.startswith("10.") | ip.startswith("192.168.") | ip.startswith("172.")
    return F.coalesce(prefixed & ip.rlike(_PRIVATE), F.lit(False))


def location(ip: Column | str) -> Column:
    return F.when(is_internal(ip), "INT").otherwise("EXT")


def direction(src: Column | str, dst: Column | str, arrow: str = "->") -> Column:
    """``INT->EXT`` style label of a flow."""
    return F.concat(location(src), F.lit(arrow), location(dst))


def is_dotted_quad(ip: Column | str) -> Column:
    return F.coalesce(col(ip).rlike(_DOTTED_QUAD), F.lit(False))


def indicator_type(value: Column | str) -> Column:
    """``ip``, ``port`` (1-65535) or ``domain``, judged by shape."""
    value = F.trim(col(value))
    number = F.when(value.rlike(r"^\d{1,9}$"), value.try_cast("int"))
    return (
        F.when(is_dotted_quad(value), "ip")
        .when(number.between(1, 65535), "port")
        .otherwise("domain")
    )


def subnet24(ip: Column | str) -> Column:
    """``a.b.c.d`` -> ``a.b.c.0/24``; text without a dot is returned as is."""
    ip = col(ip)
    return F.when(ip.contains("."), F.regexp_replace(ip, r"\.[^.]*$", ".0/24")).otherwise(ip)


def network24(ip: Column | str) -> Column:
    """The first three dot-separated parts."""
    return F.substring_index(col(ip), ".", 3)


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed table, inlined as a literal map in the plan."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, default)


def port_in(port: Column | str, ports) -> Column:
    return F.coalesce(col(port).isin(*sorted(ports)), F.lit(False))


def _service_labels() -> dict[int, str]:
    labels = {p: f"SUSPECT:{n}" for p, n in fv.SUSPICIOUS_PORTS.items()}
    labels.update({p: f"ICS:{n}" for p, n in fv.ICS_PORTS.items()})
    labels.update(fv.KNOWN_SERVICES)
    return labels


def service_label(port: Column | str) -> Column:
    """Known name, else ``ICS:`` name, else ``SUSPECT:`` name, else the number."""
    port = col(port).cast("int")
    return lookup(port, _service_labels(), port.cast("string"))


def has_flag(flags: Column | str, bit: int) -> Column:
    return F.coalesce(col(flags).bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def protocol_of_number(ip_proto: Column | str) -> Column:
    ip_proto = col(ip_proto)
    return (
        F.when(ip_proto == 6, "TCP").when(ip_proto == 17, "UDP").when(ip_proto == 1, "ICMP").otherwise("OTHER")
    )


def protocol_name(proto: Column | str) -> Column:
    """Upper-case protocol name, ``TCP`` when the source gives none."""
    return F.upper(F.coalesce(col(proto), F.lit("tcp")))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient whose divisor is never below one."""
    return numerator / F.greatest(denominator, F.lit(1))


def icmp_description(icmp_type: Column | str, icmp_code: Column | str) -> Column:
    """Text of an ICMP error; null for messages that are no error."""
    t, c = col(icmp_type).cast("int"), col(icmp_code).cast("int")
    named = lookup(t * 256 + c, {kind * 256 + code: text for (kind, code), text in fv.ICMP_ERRORS.items()})
    other = F.when(
        t.isin(*fv.ICMP_ERROR_TYPES),
        F.concat(F.lit("ICMP type="), t.cast("string"), F.lit(" code="), c.cast("string")),
    )
    return F.coalesce(named, other)
