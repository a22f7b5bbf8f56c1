"""Queries over files: given tables written to the shared scratch folder and read back by the file sources.

Each writes its table as log, JSON or report files below ``spark.checkpoint.dir``
and runs the file reader on them, so that line numbers, listings, sizes and
layouts are checked from real files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.operators import firewall
from tracesift.session import ensure_checkpoint_dir
from tracesift.sources import inventory, lines, reports, sinks, zeek

from . import queries_logs, queries_traffic
from .bindings import Inputs
from .oracle_sql import oracle

QUERIES: dict[str, tuple] = {}

#: Lines of a log file and documents of a report, which bound a file and the task that writes it.
_LINES, _DOCS = 2000, 50
#: Folders over which the files of chunk results are dealt, each written by one task and moved as a whole.
_SHELVES = 256
#: Of files on a local disk: no checksum file beside each, which would cost as much as the file.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _scratch(x: Inputs) -> str:
    return f"{ensure_checkpoint_dir(x.spark)}/files-{uuid.uuid4().hex}"


def _log_files(x: Inputs) -> str:
    """The access lines in files of up to 2,000 lines, in order of their numbers."""
    folder = _scratch(x)
    number = F.floor((F.col("line_no") - 1) / _LINES).cast("string")
    rows = x.access_lines.select(F.concat(F.lit("log-"), number).alias("file"), "line_no", "line")
    rows = rows.repartition("file").sortWithinPartitions("file", "line_no")
    rows.select("file", "line").write.partitionBy("file").text(folder)
    return folder



def _file():
    return F.regexp_extract("file_path", "file=([^/]+)", 1).alias("file")



_LOGS_SQL = f"SELECT concat('log-', CAST(floor((line_no - 1) / {_LINES}) AS BIGINT)) AS file, line_no AS n, line FROM access_lines"
QUERIES["files_log_lines"] = (
    lambda x: lines.log_lines(x.spark, _log_files(x)).select(_file(), "line_no", "line"),
    oracle(f"SELECT file, row_number() OVER (PARTITION BY file ORDER BY n) AS line_no, line FROM ({_LOGS_SQL}) q", "access_lines"),
)


def _listing(x: Inputs) -> DataFrame:
    """Every second log lies in a folder ``old``."""
    files = inventory.file_inventory(x.spark, _log_files(x))
    no = F.regexp_extract("relative_path", r"^file=log-(\d+)/", 1)
    place = F.concat(F.when(no.cast("long") % 2 == 1, "old/").otherwise(""), F.lit("log-"), no)
    return inventory.directory_entries(files.select(place.alias("relative_path"), "length"))


_SIZES = f"SELECT file, sum(strlen(line) + 1) AS bytes, count(*) AS n FROM ({_LOGS_SQL}) q GROUP BY file"
_ODD = "CAST(split_part(file, '-', 2) AS BIGINT) % 2 = 1"
QUERIES["files_directory"] = (
    _listing,
    oracle(
        f"""SELECT file AS name, 'file' AS type, CAST(bytes AS BIGINT) AS size FROM ({_SIZES}) s WHERE NOT {_ODD}
UNION ALL SELECT DISTINCT 'old/', 'directory', CAST(NULL AS BIGINT) FROM ({_SIZES}) s WHERE {_ODD}""",
        "access_lines",
    ),
)
QUERIES["files_metadata"] = (
    lambda x: inventory.file_metadata(x.spark, _log_files(x)).select(_file(), "size_bytes", "line_count"),
    oracle(f"SELECT file, CAST(bytes AS BIGINT) AS size_bytes, n AS line_count FROM ({_SIZES}) s", "access_lines"),
)


def _zeek_folder(x: Inputs) -> str:
    """``conn.*.log`` files: Spark's own file names, given the names that Zeek gives."""
    folder = f"{_scratch(x)}/zeek"
    queries_traffic._zeek_lines(x, "conn").select("line").write.text(folder)
    path = x.spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(x.spark._jsc.hadoopConfiguration())
    for no, status in enumerate(system.globStatus(path(f"{folder}/part-*"))):
        system.rename(status.getPath(), path(f"{folder}/conn.{no}.log"))
    return folder


QUERIES["files_zeek_connections"] = (
    lambda x: zeek.connections(zeek.read_log(x.spark, _zeek_folder(x), "conn")).select(
        "capture", "ts", "src_ip", "dst_ip", F.coalesce("dst_port", F.lit(0)).alias("dst_port"), "proto", "packets", "bytes_out", "bytes_in"
    ),
    oracle(
        """SELECT 'zeek' AS capture, ts, src_ip, dst_ip, dst_port, proto, packets + 2 AS packets,
  CASE WHEN packets % 3 = 0 OR bytes_out = 0 THEN bytes_out + 40 ELSE bytes_out END AS bytes_out, bytes_in FROM connections""",
        "connections",
    ),
)


def _report_files(x: Inputs) -> str:
    """Reports of up to 50 documents, one file each, and one generated file, which is no report."""
    folder = _scratch(x)
    docs = x.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = F.floor(F.col("doc_id") / _DOCS)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda d: d["text"])
    rows = docs.groupBy(number.alias("report")).agg(F.array_join(texts, "\n\n").alias("text"))
    rows = rows.withColumn("vendor", F.concat(F.lit("v"), (F.col("report") % 4).cast("string")))
    rows.write.options(**_PLAIN).partitionBy("vendor", "report").text(folder)
    x.spark.range(1).select(F.lit("a summary")).write.options(**_PLAIN).text(f"{folder}/generated/summaries")
    return folder



def _no():
    return F.regexp_extract("report_path", r"report=(\d+)", 1).cast("long").alias("report")


_REPORTS_SQL = f"""SELECT CAST(floor(doc_id / {_DOCS}) AS BIGINT) AS report, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) || chr(10) AS text
FROM documents GROUP BY 1"""
QUERIES["files_reports"] = (
    lambda x: reports.read_reports(x.spark, _report_files(x)).select(
        _no(), "subdirectory", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest")
    ),
    oracle(f"SELECT report, concat('vendor=v', report % 4) AS subdirectory, length(text) AS chars, md5(text) AS digest FROM ({_REPORTS_SQL}) q"),
)


def _listed(x: Inputs) -> DataFrame:
    """Every third report has a summary."""
    found = reports.read_reports(x.spark, _report_files(x))
    path = F.concat(F.lit("generated/summaries/"), F.regexp_replace("report_path", r"\.[^./]*$", ""), F.lit(".md"))
    have = found.where(_no() % 3 == 0).select(path.alias("object_path"))
    return reports.list_reports(found, have).select(_no(), "depth", "chars", "has_summary")


QUERIES["files_report_list"] = (
    _listed,
    oracle(f"SELECT report, 2 AS depth, length(text) AS chars, report % 3 = 0 AS has_summary FROM ({_REPORTS_SQL}) q"),
)


def _exported(x: Inputs) -> DataFrame:
    """Results written in the export layout, one by one as JSON, and read by their folders."""
    folder = _scratch(x)
    build = queries_logs.QUERIES["fw_top_talkers"][0](x)
    sinks.export_results({"firewall": build, "denied": firewall.denied(x.fw_entries).groupBy("action").count()}, folder, "t1")
    schema = ", ".join(f"`{n}` {t}" for n, t in [*build.dtypes, ("exported_at", "timestamp"), ("source_tool", "string"), ("tag", "string")])
    read = x.spark.read.schema(schema).json(folder)
    return read.where("source_tool = 'firewall' AND tag = 't1' AND exported_at IS NOT NULL").select(*build.columns)


QUERIES["files_export"] = (_exported, queries_logs.QUERIES["fw_top_talkers"][1])


def _written(x: Inputs) -> DataFrame:
    folder = _scratch(x)
    build = queries_logs.QUERIES["fw_deny_windows"][0](x)
    sinks.write_result(build, folder, "parquet")
    return x.spark.read.parquet(folder)


QUERIES["files_result"] = (_written, queries_logs.QUERIES["fw_deny_windows"][1])


def _artifacts(x: Inputs) -> DataFrame:
    """Nested chunk results, one JSON document a report and file; no folder a report, which would cost more than its file."""
    folder = _scratch(x)
    names = [n for n, _ in x.chunks.dtypes]
    dealt = x.chunks.withColumn("shelf", F.pmod(F.xxhash64("report_path"), F.lit(_SHELVES))).repartition(_SHELVES, "shelf")
    whole = dealt.groupBy("shelf", "report_path").agg(F.to_json(F.collect_list(F.struct(*names))).alias("text"))
    whole.select("shelf", "text").write.partitionBy("shelf").options(maxRecordsPerFile=1, **_PLAIN).text(folder)
    return reports.read_artifacts(x.spark, folder).select(
        "report_path", "chunk_no", F.size("refined_iocs").cast("long").alias("indicators"),
        F.size("additional_mitre_techniques").cast("long").alias("mappings"), F.get("refined_iocs", 0)["value"].alias("first_value"),
    )


QUERIES["files_artifacts"] = (
    _artifacts,
    oracle(
        """SELECT report_path, chunk_no, i.n AS indicators, m.n AS mappings, first_value
FROM (SELECT report_path, chunk_no, count(*) AS n, min_by(value, pos) AS first_value FROM chunk_indicators GROUP BY 1, 2) i
JOIN (SELECT report_path, chunk_no, count(*) AS n FROM chunk_mappings GROUP BY 1, 2) m USING (report_path, chunk_no)""",
        "chunk_indicators", "chunk_mappings",
    ),
)
