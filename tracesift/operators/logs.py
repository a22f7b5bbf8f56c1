"""Log triage over ``log_lines(file_path, line_no, line)``.

Counts are true counts: where a sample stops early, the line that ends the
sample is not counted. Ties rank by first appearance (file, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesift.functions import fixed_values as fv
from tracesift.functions import text as tx

from .ranking import evaluated_once, positive, top_n, top_per_group, with_group_totals


def _where() -> Column:
    return F.struct("file_path", "line_no")


def resolve_pattern(name_or_regex: str) -> str:
    """A pattern by name (``IP``, ``LOGLEVEL`` ...) or the regex itself."""
    pattern = fv.LOG_PATTERNS.get(name_or_regex.upper(), name_or_regex)
    tx.group_count(pattern)
    return pattern


def first_lines(lines: DataFrame, sample_lines: int | None) -> DataFrame:
    """The first N lines of each file; all of them for ``None``."""
    return lines if sample_lines is None else lines.where(F.col("line_no") <= positive("sample_lines", sample_lines))


def non_blank(lines: DataFrame, sample_lines: int | None = None) -> DataFrame:
    """Stripped non-blank lines, optionally only the first N of each file."""
    kept = lines.withColumn("line", tx.strip("line")).where(F.col("line") != "")
    if sample_lines is None:
        return kept
    return top_per_group(kept, ["file_path"], sample_lines, F.col("line_no"))


def _extracted(lines: DataFrame, pattern: str, sample_lines: int | None) -> DataFrame:
    hits = evaluated_once(first_lines(lines, sample_lines), "value", tx.first_match("line", resolve_pattern(pattern)))
    return hits.where(F.col("value").isNotNull())


def value_frequency(lines: DataFrame, pattern: str, limit: int = 10, sample_lines: int | None = None) -> DataFrame:
    """Most frequent values a pattern extracts: value, cnt, first file and line."""
    counted = (
        _extracted(lines, pattern, sample_lines)
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min(_where()).alias("_first"))
    )
    top = top_n(counted, limit, F.desc("cnt"), F.asc("_first"))
    return top.select("value", "cnt", F.col("_first.file_path").alias("first_file"), F.col("_first.line_no").alias("first_line"))


def value_samples(
    lines: DataFrame, pattern: str, limit: int = 10, sample_lines: int | None = None, samples: int = 3
) -> DataFrame:
    """The first sample lines (200 characters) of each of the most frequent values."""
    top = value_frequency(lines, pattern, limit, sample_lines).select("value", "cnt")
    hits = _extracted(lines, pattern, sample_lines).join(top, "value")
    picked = top_per_group(hits, ["value"], samples, F.col("file_path"), F.col("line_no"), name="sample_no")
    return picked.select("value", "cnt", "sample_no", F.substring(tx.strip("line"), 1, 200).alias("sample"))


def frequency_totals(lines: DataFrame, pattern: str, sample_lines: int | None = None) -> DataFrame:
    """One row: lines read and lines the pattern matches."""
    hit = tx.first_match("line", resolve_pattern(pattern)).isNotNull()
    return first_lines(lines, sample_lines).agg(
        F.count(F.lit(1)).alias("lines_processed"),
        F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("matches_found"),
    )


def pattern_profile(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Matching lines and distinct values of many named patterns, in one pass.

    Each pattern runs once a line, also where several names share it.
    """
    named: dict[str, list[str]] = {}
    for name in names or fv.LOG_PATTERNS:
        named.setdefault(fv.LOG_PATTERNS[name], []).append(name)
    tagged = F.array(
        *[
            F.struct(F.lit(no).alias("_no"), tx.first_value("line", rx, fv.LOG_PATTERN_NEEDS.get(same[0], "")).alias("value"))
            for no, (rx, same) in enumerate(named.items())
        ]
    )
    hits = lines.select(F.inline(F.filter(tagged, lambda s: s["value"] != "")))
    per_value = hits.groupBy("_no", "value").agg(F.count(F.lit(1)).alias("n"))
    found = per_value.groupBy("_no").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("distinct_values"))
    every = F.array(*[F.array(*[F.lit(n) for n in same]) for same in named.values()])
    return found.select(F.explode(F.get(every, F.col("_no"))).alias("pattern"), "matches", "distinct_values")


def signature_discovery(
    lines: DataFrame,
    limit: int = 5,
    sample_lines: int | None = None,
    max_chars: int = 300,
    skip_rules: tuple[str, ...] = (),
) -> DataFrame:
    """Most frequent line structures: signature, cnt, percentage, first example,
    and (on each row) the number of lines and of distinct signatures."""
    signed = non_blank(lines, sample_lines).withColumn("signature", tx.signature("line", max_chars, skip_rules))
    grouped = signed.groupBy("signature").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(F.struct("file_path", "line_no", "line")).alias("_first"),
    )
    top = with_group_totals(
        grouped,
        limit,
        [F.desc("cnt"), F.asc("_first")],
        {"lines_processed": F.sum("cnt"), "unique_patterns": F.count(F.lit(1))},
    )
    return top.select(
        "signature",
        "cnt",
        F.round(F.col("cnt") / F.col("lines_processed") * 100, 1).alias("percentage"),
        F.col("_first.line").alias("example"),
        "lines_processed",
        "unique_patterns",
    )


def attack_pattern_scan(lines: DataFrame, limit: int = 5, sample_lines: int | None = None) -> DataFrame:
    """Quick structural scan: no UUID rule, signatures cut at 200 characters."""
    found = signature_discovery(lines, limit, sample_lines, max_chars=200, skip_rules=("<UUID>",))
    share = F.format_string("%.0f", F.bround(F.col("cnt") / F.col("lines_processed") * 100, 0))
    return found.select(
        F.concat(F.lit("["), share, F.lit("%] "), F.substring("signature", 1, 120)).alias("value"),
        "cnt",
        F.substring("example", 1, 200).alias("line"),
        "lines_processed",
    )


def section_scan(lines: DataFrame, workflow: str, limit: int = 10) -> DataFrame:
    """Top values of every section of a workflow, all patterns in one pass."""
    if workflow not in fv.WORKFLOW_SECTIONS:
        raise ValueError(f"unknown workflow {workflow!r}")
    tagged = F.array(
        *[
            F.struct(F.lit(no).alias("section_no"), F.lit(name).alias("section"), tx.first_match("line", rx).alias("value"))
            for no, (name, rx) in enumerate(fv.WORKFLOW_SECTIONS[workflow])
        ]
    )
    found = (
        lines.select("file_path", "line_no", F.explode(F.filter(tagged, lambda s: s["value"].isNotNull())).alias("_hit"))
        .groupBy("_hit.section_no", "_hit.section", "_hit.value")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min(_where()).alias("_first"))
    )
    top = top_per_group(found, ["section_no", "section"], limit, F.desc("cnt"), F.asc("_first"), name="rank")
    return top.select("section", "rank", "value", "cnt")


def address_activity(lines: DataFrame, ip: str, limit: int | None = None) -> DataFrame:
    """Lines naming an address, as ``L<n>: <text>``, in file order."""
    if not ip:
        raise ValueError("ip is required")
    hits = lines.where(F.col("line").contains(ip))
    text = F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), F.substring(tx.strip("line"), 1, 200))
    return top_n(hits, limit, F.col("file_path"), F.col("line_no")).select("file_path", "line_no", text.alias("line"))


def investigate_totals(lines: DataFrame, term: str) -> DataFrame:
    """One row: lines scanned and lines that contain the term."""
    hit = tx.contains_text("line", term)
    return lines.agg(
        F.count(F.lit(1)).alias("lines_scanned"),
        F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("total_matches"),
    )


def investigate_lines(lines: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """Lines that contain the term; optionally the first ones."""
    hits = top_n(lines.where(tx.contains_text("line", term)), limit, F.col("file_path"), F.col("line_no"))
    return hits.select("file_path", "line_no", tx.strip("line").alias("line"))


def _right_stripped(c: Column | str) -> Column:
    return F.regexp_replace(tx.col(c), r"\s+$", "")


def search(
    lines: DataFrame,
    query: str,
    mode: str = "text",
    max_results: int = 50,
    context_lines: int = 0,
    invert: bool = False,
) -> DataFrame:
    """First matching lines, with ``context_lines`` before and after as arrays.

    Context is fetched by an equi-join of each kept hit's neighbouring line
    numbers, so no file is gathered into one task.
    """
    if not query:
        raise ValueError("query is required")
    kept = lines.where(tx.matches("line", query, mode, invert))
    hits = top_n(kept, max_results, F.col("file_path"), F.col("line_no")).select(
        "file_path", F.col("line_no").alias("line_number"), _right_stripped("line").alias("text")
    )
    if context_lines <= 0:
        return hits
    wanted = hits.withColumn("_offset", F.explode(F.sequence(F.lit(-context_lines), F.lit(context_lines)))).select(
        "file_path", "line_number", "text", "_offset", (F.col("line_number") + F.col("_offset")).alias("line_no")
    )
    around = wanted.join(lines, ["file_path", "line_no"]).groupBy("file_path", "line_number", "text")
    neighbours = around.agg(
        F.array_sort(F.collect_list(F.struct("_offset", _right_stripped("line").alias("line")))).alias("_near")
    )

    def side(test) -> Column:
        return F.transform(F.filter("_near", test), lambda s: s["line"])

    return neighbours.select(
        "file_path",
        "line_number",
        "text",
        side(lambda s: s["_offset"] < 0).alias("context_before"),
        side(lambda s: s["_offset"] > 0).alias("context_after"),
    )


def search_totals(
    lines: DataFrame, query: str, mode: str = "text", max_results: int = 50, invert: bool = False
) -> DataFrame:
    """One row: lines scanned, matches, and whether ``search`` left some out."""
    hit = tx.matches("line", query, mode, invert)
    out = lines.agg(
        F.count(F.lit(1)).alias("lines_scanned"),
        F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("total_matches"),
    )
    return out.withColumn("truncated", F.col("total_matches") > max_results)


def read_segment(lines: DataFrame, offset_lines: int = 0, line_limit: int = 100) -> DataFrame:
    """A page of each file, with ``has_more`` telling whether lines follow it."""
    if offset_lines < 0:
        raise ValueError("offset_lines must not be negative")
    last = offset_lines + positive("line_limit", line_limit)
    near = lines.where((F.col("line_no") > offset_lines) & (F.col("line_no") <= last + 1))
    paged = near.withColumn("has_more", F.max("line_no").over(Window.partitionBy("file_path")) > last)
    return paged.where(F.col("line_no") <= last).select("file_path", "line_no", "line", "has_more")


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("line_count"))
