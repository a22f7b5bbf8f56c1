"""Zeek JSON logs as canonical traffic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import network as nw
from tracesift.functions import text as tx
from tracesift.functions.times import zeek_time
from tracesift.schemas import TrafficTables, conform

_ENDS = ("id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p")
# every field is read as text: types differ between writers
LOG_FIELDS = {
    "conn": ("ts", *_ENDS, "proto", "service", "duration", "orig_bytes", "resp_bytes", "orig_ip_bytes",
             "resp_ip_bytes", "orig_pkts", "resp_pkts", "conn_state"),
    "dns": ("ts", *_ENDS, "query", "qtype_name", "qtype", "rcode_name", "rcode", "answers"),
    "ssl": ("ts", *_ENDS, "server_name", "version", "cipher", "ja3", "ja3s", "subject", "issuer", "validation_status"),
    "http": ("ts", *_ENDS, "method", "host", "uri", "user_agent", "status_code", "resp_mime_types",
             "request_body_len", "response_body_len"),
    "notice": ("ts", *_ENDS, "note", "msg", "sub", "src", "dst"),
    "weird": ("ts", *_ENDS, "name", "addl"),
}


def _schema(log: str) -> str:
    return ", ".join(f"`{f}` string" for f in LOG_FIELDS[log])


def parse_json_lines(lines: DataFrame, log: str, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of JSON log lines; blank lines, ``#`` lines and broken JSON are skipped."""
    text = tx.strip(column)
    good = lines.where((text != "") & ~text.startswith("#"))
    parsed = good.withColumn(
        "_j", F.from_json(text, _schema(log) + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    )
    parsed = parsed.where(F.col("_j").isNotNull() & F.col("_j._bad").isNull())
    return parsed.select(*keep, *[F.col(f"_j.`{f}`").alias(f) for f in LOG_FIELDS[log]])


def read_log(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """One log type of a folder tree; ``capture`` is the folder a file lies in."""
    reader = spark.read.schema(_schema(log)).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true")
    df = reader.option("pathGlobFilter", f"{log}*.log").json(folder)
    return df.withColumn("capture", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def _f(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(name: str) -> Column:
    return tx.empty_to_null(_f(name))


def _int(name: str, kind: str = "int") -> Column:
    return _f(name).try_cast("double").cast(kind)


def _captured(df: DataFrame) -> Column:
    return F.col("capture") if "capture" in df.columns else F.lit(None).cast("string")


def _ends(df: DataFrame) -> list[Column]:
    return [
        _captured(df).alias("capture"), zeek_time("ts").alias("ts"), _text("id.orig_h").alias("src_ip"),
        F.nullif(_int("id.orig_p"), F.lit(0)).alias("src_port"), _text("id.resp_h").alias("dst_ip"),
        F.nullif(_int("id.resp_p"), F.lit(0)).alias("dst_port"),
    ]


def connections(conn: DataFrame) -> DataFrame:
    """``conn.log``; payload bytes fall back to IP bytes when missing or zero."""

    def size(side: str) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.coalesce(F.nullif(_int(f"{side}_bytes", "bigint"), zero), F.nullif(_int(f"{side}_ip_bytes", "bigint"), zero), zero)

    count = lambda name: F.coalesce(_int(name, "bigint"), F.lit(0))
    return conform(
        conn.select(
            *_ends(conn), nw.protocol_name("proto").alias("proto"), _text("service").alias("service"),
            (count("orig_pkts") + count("resp_pkts")).alias("packets"), size("orig").alias("bytes_out"),
            size("resp").alias("bytes_in"), _f("duration").try_cast("double").alias("duration"),
            _text("conn_state").alias("conn_state"),
        ),
        "connections",
    )


def ot_services(conn: DataFrame) -> DataFrame:
    """Connections whose service is an industrial protocol."""
    rows = conn.where(F.lower("service").isin(*fv.OT_SERVICES))
    return conform(rows.select(*_ends(rows), F.upper("service").alias("protocol")), "ot_transactions")


def dns_queries(dns: DataFrame) -> DataFrame:
    rows = dns.where(_text("query").isNotNull())
    return conform(rows.select(*_ends(rows), "query", F.coalesce(_f("qtype_name"), _f("qtype")).alias("qtype")), "dns_queries")


def dns_responses(dns: DataFrame) -> DataFrame:
    """One row per answer, from the resolver to the client."""
    rows = dns.withColumn("answer", F.explode(F.from_json("answers", "array<string>")))
    return conform(
        rows.select(
            _captured(rows).alias("capture"), zeek_time("ts").alias("ts"), _text("id.resp_h").alias("src_ip"),
            _text("id.orig_h").alias("dst_ip"), _text("query").alias("query"),
            F.coalesce(_f("qtype_name"), _f("qtype")).alias("qtype"), "answer",
            F.coalesce(_f("rcode_name"), _f("rcode")).alias("rcode"),
        ),
        "dns_responses",
    )


def tls_handshakes(ssl: DataFrame) -> DataFrame:
    names = ("version", "cipher", "ja3", "ja3s", "subject", "issuer", "validation_status")
    return conform(
        ssl.select(*_ends(ssl), _text("server_name").alias("sni"), *[_text(n).alias(n) for n in names]), "tls_handshakes"
    )


def http_requests(http: DataFrame) -> DataFrame:
    mime = _f("resp_mime_types")
    first = F.when(mime.startswith("["), F.get_json_object(mime, "$[0]")).otherwise(mime)
    return conform(
        http.select(
            *_ends(http), *[_text(n).alias(n) for n in ("method", "host", "user_agent")], _text("uri").alias("path"),
            _int("status_code").alias("status_code"), first.alias("content_type"),
            F.coalesce(_int("request_body_len", "bigint"), F.lit(0)).alias("request_len"),
            F.coalesce(_int("response_body_len", "bigint"), F.lit(0)).alias("response_len"),
        ),
        "http_requests",
    )


def cleartext_creds(notice: DataFrame) -> DataFrame:
    """Notices about passwords in the clear; no user name or value is kept."""
    rows = notice.where(F.col("note").rlike("Password|Cleartext|HTTP::Basic"))
    return conform(
        rows.select(
            _captured(rows).alias("capture"), zeek_time("ts").alias("ts"),
            tx.empty_to_null(F.coalesce(_f("src"), _f("id.orig_h"))).alias("src_ip"),
            tx.empty_to_null(F.coalesce(_f("dst"), _f("id.resp_h"))).alias("dst_ip"),
            F.col("note").alias("protocol"), _text("sub").alias("description"),
        ),
        "cleartext_creds",
    )


def weird_events(weird: DataFrame) -> DataFrame:
    return conform(weird.select(*_ends(weird), _text("name").alias("name"), _text("addl").alias("addl")), "weird_events")


def load_zeek(spark: SparkSession, folder: str, logs: tuple[str, ...] = tuple(LOG_FIELDS)) -> TrafficTables:
    """All tables of a folder tree of Zeek logs (lazy)."""
    have = {log: read_log(spark, folder, log) for log in logs}
    make = lambda log, fn: fn(have[log]) if log in have else None
    return TrafficTables(
        connections=make("conn", connections), ot_transactions=make("conn", ot_services),
        dns_queries=make("dns", dns_queries), dns_responses=make("dns", dns_responses),
        tls_handshakes=make("ssl", tls_handshakes), http_requests=make("http", http_requests),
        cleartext_creds=make("notice", cleartext_creds), weird_events=make("weird", weird_events),
    )
