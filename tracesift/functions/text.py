"""Column expressions over log lines, names and report text.

Character classes are ASCII (``\\d``, ``\\w``), as in Java's default mode.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .network import col, lookup


def running_totals(numbers: Column, block: int = 256) -> Column:
    """The sums of the first 1, 2, ... elements of an array of integers.

    A fold that appends copies its array at each step. Done in blocks, and over the
    blocks' sums, the copies stay short: at 50,000 elements a two-hundredth of the work.
    """

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("all"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"] + x).alias("all"))
        return F.aggregate(part, start, step, lambda acc: acc["all"])

    count = F.ceil(F.size(numbers) / block).cast("int")
    cuts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    inner = F.transform(cuts, lambda b: sums(F.slice(numbers, b * block + 1, F.lit(block))))

    def joined(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), sums(F.transform(blocks, lambda x: F.element_at(x, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda x, more: F.transform(x, lambda v: v + more)))

    return F.get(F.transform(F.array(inner), joined), 0)


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(fv.WHITESPACE))


def java_pattern(pattern: str) -> str:
    """Accept ``(?P<name>...)`` groups by dropping the names."""
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def group_count(pattern: str) -> int:
    """Number of capturing groups; raises ``ValueError`` for a bad pattern."""
    try:
        return re.compile(pattern).groups
    except re.error as exc:
        raise ValueError(f"invalid pattern {pattern!r}: {exc}") from exc


def first_match(text: Column | str, pattern: str) -> Column:
    """Group 1 of the first match (the whole match if there is no group), else null."""
    group = 1 if group_count(pattern) else 0
    text, pattern = col(text), java_pattern(pattern)
    if group == 0:
        return F.regexp_substr(text, F.lit(pattern))
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def first_value(text: Column | str, pattern: str, needs: str = "") -> Column:
    """Group 1 of the first match, else empty text, for patterns whose group 1 is never empty.

    One run of the pattern instead of the two of ``first_match``, and none where
    the text lacks ``needs``, which every match holds.
    """
    text = col(text)
    found = F.regexp_extract(text, java_pattern(pattern), 1)
    return F.when(text.contains(needs), found).otherwise("") if needs else found


def contains_text(text: Column | str, needle: str) -> Column:
    return F.lower(col(text)).contains(needle.lower())


def matches(text: Column | str, query: str, mode: str = "text", invert: bool = False) -> Column:
    """Case-insensitive substring (``text``) or pattern (``regex``) test."""
    if mode not in ("text", "regex"):
        raise ValueError("mode must be 'text' or 'regex'")
    if mode == "regex":
        group_count(query)
        hit = col(text).rlike("(?i)" + java_pattern(query))
    else:
        hit = contains_text(text, query)
    return ~hit if invert else hit


def signature(line: Column | str, max_chars: int = 300, skip: tuple[str, ...] = ()) -> Column:
    """Structure of a line: variable parts become tokens, long results are cut."""
    text = strip(line)
    for pattern, token in fv.SIGNATURE_RULES:
        if token not in skip:
            text = F.regexp_replace(text, pattern, token)
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))).otherwise(text)


def refang(text: Column | str) -> Column:
    """Undo ``[.]``, ``hxxp``, ``[:]`` and ``[at]`` spellings of indicators."""
    out = F.replace(col(text), F.lit("[.]"), F.lit("."))
    out = F.regexp_replace(out, "(?i)hxxp", "http")
    out = F.replace(out, F.lit("[:]"), F.lit(":"))
    return F.regexp_replace(out, r"(?i)\[at\]", "@")


def refang_case_sensitive(text: Column | str) -> Column:
    """The correlator's shorter list: ``[.]``, ``[:]`` and lower-case ``hxxp``."""
    out = F.replace(col(text), F.lit("[.]"), F.lit("."))
    out = F.replace(out, F.lit("[:]"), F.lit(":"))
    return F.replace(out, F.lit("hxxp"), F.lit("http"))


def shannon_entropy(text: Column | str) -> Column:
    """Bits per character, 0 for empty text: one fold over the runs of the sorted characters."""
    text = col(text)
    total = F.length(text)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))

    def step(bits: Column, run: Column) -> Column:
        share = F.length(run) / total
        return bits - share * F.log2(share)

    return F.when(total > 0, F.aggregate(runs, F.lit(0.0), step)).otherwise(F.lit(0.0))


def domain_label(domain: Column | str) -> Column:
    """First label of names with three or more labels, else the whole name."""
    domain = col(domain)
    return F.when(F.size(F.split(domain, r"\.")) >= 3, F.substring_index(domain, ".", 1)).otherwise(domain)


def base_domain(domain: Column | str) -> Column:
    return F.substring_index(col(domain), ".", -2)


def subdomain(domain: Column | str) -> Column:
    """Everything before the last two labels; null when there are fewer than three."""
    labels = F.split(col(domain), r"\.")
    return F.when(F.size(labels) >= 3, F.concat_ws(".", F.slice(labels, F.lit(1), F.size(labels) - 2)))


def one_decimal(value: Column, unit: str = "") -> Column:
    """One decimal place, ties to even."""
    return F.format_string("%.1f" + unit, F.bround(value.cast("double"), 1))


def bytes_text(n: Column | str) -> Column:
    """``512 B``, ``1.5 KB``, ``2.0 MB``, ``3.1 GB``."""
    n = col(n)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, one_decimal(n / 1024, " KB"))
        .when(n < 1024**3, one_decimal(n / 1024**2, " MB"))
        .otherwise(one_decimal(n / 1024**3, " GB"))
    )


def bytes_text_scaled(n: Column | str, largest: str = "TB") -> Column:
    """One decimal in every unit, ``512.0 B`` up to the given largest unit."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    units = units[: units.index(largest) + 1]
    n = col(n)
    out = None
    for power, unit in enumerate(units[:-1]):
        text = one_decimal(n / F.lit(float(1024**power)), f" {unit}")
        test = F.abs(n) < 1024 ** (power + 1)
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.otherwise(one_decimal(n / F.lit(float(1024 ** (len(units) - 1))), f" {units[-1]}"))


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4).cast("int"))


def blended_token_estimate(prose: Column | str, data: Column | str) -> Column:
    """Four characters a token for prose, three for data, raised by 1.4."""
    p, d = F.floor(F.length(col(prose)) / 4), F.floor(F.length(col(data)) / 3)
    return F.floor((p + d) * F.lit(1.4)).cast("int")


def line_count(text: Column | str) -> Column:
    """Number of lines, a trailing line break not counting as another line."""
    text = col(text)
    body = F.regexp_replace(text, r"(\r\n|\r|\n)$", "")
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(body, r"\r\n|\r|\n")))


def page_count(text: Column | str) -> Column:
    """Pages of extracted page text: blank-line separators plus one."""
    return F.size(F.split(col(text), "\n\n"))


def report_type(path: Column | str) -> Column:
    path = F.lower(col(path))
    out = None
    for words, label in fv.REPORT_TYPES:
        test = path.contains(words[0])
        for word in words[1:]:
            test = test | path.contains(word)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(fv.DEFAULT_REPORT_TYPE)


def key_findings(text: Column | str, limit: int | None = None) -> Column:
    """Bullet lines longer than ten characters and numbered lines; optionally the first ``limit``."""
    lines = F.transform(F.split(col(text), "\n"), strip)
    bullet = r"^[-*] "
    numbered = r"^\d+[.)]\s(.+)"

    def finding(line: Column) -> Column:
        return F.when(line.rlike(bullet), strip(F.substring(line, 3, 1 << 30))).when(
            line.rlike(numbered), strip(F.regexp_extract(line, numbered, 1))
        )

    kept = F.filter(
        lines,
        lambda s: (s.rlike(bullet) & (F.length(finding(s)) > 10)) | (~s.rlike(bullet) & s.rlike(numbered)),
    )
    found = F.transform(kept, finding)
    return found if limit is None else F.slice(found, 1, limit)


def technique_ids(text: Column | str, limit: int | None = None) -> Column:
    """Distinct technique ids in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(col(text), F.lit(fv.TECHNIQUE_ID), F.lit(0)))
    return found if limit is None else F.slice(found, 1, limit)


def artifact_type(file_name: Column | str) -> Column:
    """Type of the rightmost known suffix (``auth.log.1`` is a log), else ``text``."""
    parts = F.split(F.substring_index(col(file_name), "/", -1), r"\.")
    suffixes = F.transform(F.reverse(F.slice(parts, 2, 1 << 20)), F.lower)
    known = F.filter(F.transform(suffixes, lambda s: lookup(s, fv.ARTIFACT_TYPES)), lambda t: t.isNotNull())
    return F.coalesce(F.get(known, 0), F.lit("text"))


def paragraph_chunks(text: Column | str, max_chars: int = 6000) -> Column:
    """Array of chunks made of whole paragraphs, each at most ``max_chars`` long
    unless one paragraph alone is longer."""
    text = col(text)
    paragraphs = F.split(text, "\n\n")
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("starts"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("used"))

    def step(acc: Column, para: Column) -> Column:
        # the array of chunk starts grows once a chunk, not once a paragraph
        need = F.length(para) + 2
        full = (acc["used"] + need > max_chars) & (acc["at"] > acc["first"])
        return F.struct(
            F.when(full, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
            (acc["at"] + 1).alias("at"),
            F.when(full, acc["at"]).otherwise(acc["first"]).alias("first"),
            F.when(full, need).otherwise(acc["used"] + need).alias("used"),
        )

    starts = F.aggregate(paragraphs, start, step, lambda a: F.concat(F.array(F.lit(0)), a["starts"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(paragraphs)))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    split_up = F.transform(spans, lambda s: F.array_join(F.slice(paragraphs, s["a"] + 1, s["b"] - s["a"]), "\n\n"))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(split_up)


def node_key(technique_id: Column | str, tactic: Column | str) -> Column:
    """``T1059|execution``; an empty tactic becomes ``unknown``."""
    tactic = col(tactic)
    slug = F.when(F.coalesce(tactic, F.lit("")) == "", "unknown").otherwise(
        F.replace(F.lower(tactic), F.lit(" "), F.lit("-"))
    )
    return F.concat_ws("|", col(technique_id), slug)


def empty_to_null(value: Column | str) -> Column:
    value = col(value)
    return F.when(value != "", value)
