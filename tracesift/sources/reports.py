"""Report text: corpus scan and HTML to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import text as tx
from tracesift.schemas import struct_of
from tracesift.session import few_listing_tasks
from tracesift.sources.inventory import relative_path

_GAP = "\ufdd0"
HIDDEN_ELEMENTS = ("script", "style", "nav", "footer", "header")


# --- corpus ----------------------------------------------------------------------------


def read_reports(spark: SparkSession, base: str, generated: str = "generated") -> DataFrame:
    """Reports below a folder, whole text each; ``generated/`` is left out."""
    glob = "*.{" + ",".join(fv.REPORT_SUFFIXES) + "}"
    with few_listing_tasks(spark):
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(base, wholetext=True)
    rows = raw.select(relative_path(F.col("_metadata.file_path"), base).alias("report_path"), F.col("value").alias("text"))
    parts = F.split("report_path", "/")
    return rows.where(F.get(parts, 0) != generated).select(
        "report_path", F.element_at(parts, -1).alias("name"),
        F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise("").alias("subdirectory"), "text",
    )


def list_reports(reports: DataFrame, summaries: DataFrame, folder: str = "generated/summaries") -> DataFrame:
    """Reports with size, depth and whether a summary exists for them.

    ``summaries`` lists existing files as ``object_path``; a report's summary is
    ``<folder>/<report path without suffix>.md``.
    """
    path = F.concat(F.lit(folder + "/"), F.regexp_replace("report_path", r"\.[^./]*$", ""), F.lit(".md"))
    have = summaries.select("object_path").distinct().withColumn("has_summary", F.lit(True))
    listed = reports.select(
        "report_path", "name", "subdirectory", (F.size(F.split("report_path", "/")) - 1).alias("depth"),
        F.length("text").alias("chars"), path.alias("object_path"),
    )
    return listed.join(have, "object_path", "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))


def read_artifacts(spark: SparkSession, paths: str | list[str], kind: str = "chunks") -> DataFrame:
    """Nested JSON result files, one document a file, in a canonical layout."""
    schema = struct_of(kind)
    with few_listing_tasks(spark):
        df = spark.read.schema(schema).json(paths, multiLine=True)
    return df.withColumn("report_path", F.coalesce("report_path", F.col("_metadata.file_path")))


# --- HTML --------------------------------------------------------------------------------


_REFERENCE = r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);"


def unescaped(text: Column) -> Column:
    """Character references decoded: numeric ones by their code point, named ones of the fixed table.

    Unknown names and references without a semicolon stay as they are.
    """
    names = F.create_map(*(F.lit(x) for pair in fv.NAMED_CHARACTERS.items() for x in pair))

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        digits = F.when(name.rlike("^#[xX]"), F.substring(name, 3, 10)).otherwise(F.substring(name, 2, 10))
        number = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.when(name.startswith("#"), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(
            F.try_element_at(names, name))
        return F.when((name != "") & char.isNotNull(), F.concat(char, F.substring(piece, F.length(name) + 3, F.length(piece)))).otherwise(piece)

    pieces = F.split(text, "(?=&)")
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def visible_text(markup: Column | str) -> Column:
    """Visible text of HTML: one line per text node, without hidden elements."""
    body = tx.col(markup) if isinstance(markup, str) else markup
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", _GAP)
    for element in HIDDEN_ELEMENTS:
        body = F.regexp_replace(body, rf"(?is)<{element}\b[^>]*>.*?</{element}\s*>", _GAP)
    body = F.regexp_replace(body, r"(?s)<[!/?a-zA-Z][^>]*>", _GAP)
    pieces = F.transform(F.split(unescaped(body), _GAP), tx.strip)
    return F.array_join(F.filter(pieces, lambda p: p != ""), "\n")


def html_reports(pages: DataFrame, key: str, markup: str, prefix: str = "") -> DataFrame:
    """HTML pages as reports."""
    path = F.concat(F.lit(prefix), F.col(key).cast("string"))
    return pages.select(
        path.alias("report_path"), path.alias("name"), F.lit("").alias("subdirectory"), visible_text(markup).alias("text")
    )
