"""Industrial-protocol summaries and network zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import network as nw

from .ranking import first_per_key, top_n


def _count_where(flag: str):
    return F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("bigint"))


def by_protocol(ot: DataFrame) -> DataFrame:
    """Transactions, writes, controls, exceptions and diagnostics per protocol."""
    return ot.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("transactions"),
        _count_where("is_write").alias("writes"),
        _count_where("is_control").alias("controls"),
        _count_where("is_exception").alias("exceptions"),
        _count_where("is_diagnostic").alias("diagnostics"),
    )


def flagged(ot: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Transactions of one kind (write, control, exception, diagnostic), by time."""
    if kind not in ("write", "control", "exception", "diagnostic"):
        raise ValueError("kind must be write, control, exception or diagnostic")
    rows = ot.where(F.coalesce(F.col(f"is_{kind}"), F.lit(False))).select(
        "ts", "src_ip", "dst_ip", "dst_port", "protocol", F.coalesce("function_name", F.lit("?")).alias("function_name")
    )
    if limit is None:
        return rows
    return top_n(rows, limit, F.asc("ts"), F.asc("src_ip"), F.asc("dst_ip"), F.asc("dst_port"), F.asc("function_name"))


def endpoints(ot: DataFrame) -> DataFrame:
    """Distinct addresses that speak an industrial protocol, with location."""
    ends = ot.select(F.explode(F.array("src_ip", "dst_ip")).alias("host")).where(F.col("host").isNotNull()).distinct()
    return ends.select("host", nw.location("host").alias("location"))


def endpoint_totals(ot: DataFrame) -> DataFrame:
    return endpoints(ot).groupBy("location").agg(F.count(F.lit(1)).alias("endpoints"))


def writes_by_source(ot: DataFrame, top: int = 15) -> DataFrame:
    """Sources by number of write operations; protocol and function names are
    fixed lists, so their arrays are short."""
    writes = ot.where(F.coalesce("is_write", F.lit(False)))
    grouped = writes.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("writes"),
        F.countDistinct("dst_ip").alias("targets"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.array_sort(F.collect_set(F.coalesce("function_name", F.lit("?")))).alias("functions"),
    )
    return top_n(grouped, top, F.desc("writes"), F.asc("src_ip"))


def exceptions_by_function(ot: DataFrame, top: int = 10) -> DataFrame:
    failed = ot.where(F.coalesce("is_exception", F.lit(False)))
    grouped = failed.groupBy(
        F.coalesce("function_name", F.lit("?")).alias("function_name"),
        F.coalesce(F.col("exception_code").cast("string"), F.lit("?")).alias("exception_code"),
    ).agg(F.count(F.lit(1)).alias("cnt"))
    return top_n(grouped, top, F.desc("cnt"), F.asc("function_name"), F.asc("exception_code"))


def modbus_functions(ot: DataFrame) -> DataFrame:
    """Modbus function codes with counts, write / diagnostic mark and unit ids
    (a unit id is one byte)."""
    parsed = ot.where((F.col("protocol") == "Modbus") & F.col("function_code").isNotNull())
    mark = F.when(F.col("function_code").isin(*fv.MODBUS_DIAGNOSTICS), "DIAG").when(
        F.col("function_code").isin(*fv.MODBUS_WRITES), "WRITE"
    )
    return parsed.groupBy("function_code", F.coalesce("function_name", F.lit("?")).alias("function_name")).agg(
        F.count(F.lit(1)).alias("cnt"), F.array_sort(F.collect_set("unit_id")).alias("unit_ids")
    ).withColumn("mark", mark)


def credentials_by_protocol(creds: DataFrame) -> DataFrame:
    """Cleartext credential detections and distinct host pairs per protocol."""
    return creds.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("detections"),
        F.countDistinct("src_ip", "dst_ip").alias("pairs"),
        F.min("description").alias("description"),
    )


def credential_pairs(creds: DataFrame) -> DataFrame:
    return creds.groupBy("protocol", "src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("detections"))


# --- zones ---------------------------------------------------------------------------------


def host_zones(convs: DataFrame) -> DataFrame:
    """Zone of each address from the ports it serves and uses.

    One pass over the flow ends: the port sets are reduced to the five booleans
    the rules need, so no set is ever built.
    """
    port = F.col("dst_port")
    served = F.struct(F.col("dst_ip").alias("host"), F.lit(True).alias("served"), port.alias("port"))
    used = F.struct(F.col("src_ip").alias("host"), F.lit(False).alias("served"), port.alias("port"))
    scada = nw.port_in("port", fv.SCADA_PORTS)
    office = nw.port_in("port", fv.CORPORATE_PORTS + fv.DMZ_PORTS)
    rules = (
        convs.select(F.inline(F.array(used, served)))
        .where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(
            F.bool_or(F.col("served") & scada).alias("serves_ot"),
            F.bool_or(~F.col("served") & scada).alias("uses_ot"),
            F.bool_or(office).alias("office"),
            F.bool_or(F.col("served") & nw.port_in("port", fv.DMZ_PORTS)).alias("serves_dmz"),
        )
    )
    zone = (
        F.when(~nw.is_internal("host"), "External")
        .when(F.col("serves_ot") & F.col("uses_ot"), "SCADA")
        .when(F.col("serves_ot"), "CONTROL/FIELD")
        .when(F.col("uses_ot") & F.col("office"), "Corporate")
        .when(F.col("uses_ot"), "SCADA")
        .when(F.col("serves_dmz"), "DMZ")
        .otherwise("Corporate")
    )
    return rules.select("host", zone.alias("zone"))


def network_zones(zones: DataFrame) -> DataFrame:
    """Zone of each /24 by majority of its addresses; ties by zone order."""
    votes = (
        zones.where(F.size(F.split("host", r"\.")) == 4)
        .groupBy(nw.network24("host").alias("network"), "zone")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    order = nw.lookup(F.col("zone"), {zone: no for no, zone in enumerate(fv.ZONES)})
    ranked = votes.withColumn("_less", -F.col("votes")).withColumn("_order", order)
    return first_per_key(ranked, ["network"], "_less", "_order").select("network", "zone", "votes")


def network_pairs(convs: DataFrame) -> DataFrame:
    """Bytes between /24 networks, pair in text order, traffic inside one left out."""
    ends = convs.select(nw.network24("src_ip").alias("a"), nw.network24("dst_ip").alias("b"), "bytes_out")
    between = ends.where(F.col("a") != F.col("b"))
    return between.groupBy(F.least("a", "b").alias("network_a"), F.greatest("a", "b").alias("network_b")).agg(
        F.sum("bytes_out").alias("bytes")
    )


def zone_matrix(convs: DataFrame) -> DataFrame:
    """Bytes between zones; pairs inside one zone are left out."""
    nets = network_zones(host_zones(convs)).select("network", "zone")
    pairs = (
        network_pairs(convs)
        .join(nets.select(F.col("network").alias("network_a"), F.col("zone").alias("zone_a")), "network_a", "left")
        .join(nets.select(F.col("network").alias("network_b"), F.col("zone").alias("zone_b")), "network_b", "left")
        .withColumn("zone_a", F.coalesce("zone_a", F.lit("External")))
        .withColumn("zone_b", F.coalesce("zone_b", F.lit("External")))
    )
    crossing = pairs.where(F.col("zone_a") != F.col("zone_b"))
    return crossing.groupBy("zone_a", "zone_b").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("network_pairs"))

