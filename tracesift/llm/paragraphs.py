"""Removal of paragraphs and passages that repeat across documents: MinHash bands, exact Jaccard, components.

Whole paragraphs go through MinHash bands. A passage inside longer paragraphs, or
across line breaks, has no paragraph of its own to compare; it is found by local
minima: of the hashes of all runs of ``RUN`` words the smallest of every
``SPAN`` successive ones is kept, so that two texts that share ``RUN + SPAN - 1``
words share a kept run. From there the two texts are compared word by word, in
both directions, as far as they are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.llm import similar_sets
from tracesift.llm.common import marked, slices, strings, text_bytes
from tracesift.llm.textkernel import mix, newline_units, run_hashes, shingles, words
from tracesift.session import discard, written_once

#: Words of a run, and successive runs of which the smallest hash is kept: any 50 shared words hold a shared one.
RUN, SPAN = 20, 31

_RUNS = "doc_id long, print long, at int, step int, more int"
_STRETCHES = "doc_id long, kept boolean, lo int, hi int, line int, start long, end long, first_doc long, first_line int, copies long"
_PLACES = "doc_id long, paragraph int, start long, n_chars long, n_words int, rid long, bands array<long>"
#: Paragraphs that a task remembers, so as not to emit copies again; when full it starts anew.
REMEMBERED = 1 << 19


@dataclass
class _Lines:
    """The paragraphs of a slice of texts: who holds them, their words, shingles, places and prints."""

    ids: pa.Array
    numbers: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    shingle_ends: tuple[np.ndarray, np.ndarray]
    prints: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    text_starts: np.ndarray

    def minima(self, which: np.ndarray, count: int) -> np.ndarray:
        lo, hi = self.shingle_ends
        return np.stack([similar_sets.minima(self.hashes[lo[k] : hi[k]], count) for k in which]) if len(which) else np.zeros((0, count), np.uint64)


def _lines(batch: pa.RecordBatch, size: int, least_words: int) -> Iterator[_Lines]:
    texts, ids = strings(batch, "text"), batch.column(0)
    for lo, hi in slices(texts):
        data, offsets = text_bytes(texts, lo, hi)
        lines, owner = newline_units(data, offsets)
        found = words(data, lines)
        lengths = np.diff(found.first)
        chosen = np.flatnonzero(lengths >= max(least_words, 1))
        if not len(chosen):
            continue
        hashes, first = shingles(found.hashes, found.first, size)
        within = (np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * (2 * within + np.uint64(1)), dtype=np.uint64)))
        numbers = np.arange(len(owner)) - np.searchsorted(owner, owner)
        yield _Lines(ids.take(pa.array(owner[chosen] + lo)), numbers[chosen], lengths[chosen], hashes, (first[chosen], first[chosen + 1]),
                     mix(sums[first[chosen + 1]] - sums[first[chosen]]), found.starts[found.first[chosen]], found.ends[found.first[chosen + 1] - 1],
                     data, offsets[owner[chosen]])


def _longs(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _unseen(prints: np.ndarray, seen: set[int]) -> np.ndarray:
    """Where prints first occur that are not among the ``seen`` ones, which then hold them."""
    values, first = np.unique(prints, return_index=True)
    new = [v not in seen for v in values.tolist()]
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.update(values.tolist())
    return first[np.array(new, bool)]


def _placer(size: int, bands: int, rows: int, least_words: int):
    """The places of all paragraphs; with band keys where the print falls into the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _lines(batch, size, least_words):
                counted = np.zeros(len(part.prints), bool)
                counted[_unseen(part.prints, seen)] = True
                chosen = np.flatnonzero(counted & (mix(part.prints, 5) % np.uint64(similar_sets.SAMPLED) == 0))
                row = np.full(len(part.prints), -1)
                row[chosen] = np.arange(len(chosen))
                keys = _longs(similar_sets.band_keys(part.minima(chosen, bands * rows), bands, rows))
                chars = np.concatenate(([0], np.cumsum((part.data & 0xC0) != 0x80)))
                yield pa.RecordBatch.from_arrays(
                    [part.ids, pa.array(part.numbers, pa.int32()), pa.array(chars[part.begins] - chars[part.text_starts], pa.int64()),
                     pa.array(chars[part.ends] - chars[part.begins], pa.int64()), pa.array(part.lengths, pa.int32()),
                     pa.array(part.prints.view(np.int64)), keys.take(pa.array(row, mask=row < 0))],
                    names=["doc_id", "paragraph", "start", "n_chars", "n_words", "rid", "bands"])

    return run


def _keyer(size: int, bands: int, rows: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _lines(batch, size, least_words):
                fresh = _unseen(part.prints, seen)
                keys = similar_sets.band_keys(part.minima(fresh, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(part.prints[fresh].view(np.int64)), _longs(keys)], names=["rid", "bands"])

    return run


def _texter(size: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _lines(batch, size, least_words):
                fresh, raw = _unseen(part.prints, seen), part.data.tobytes()
                own = pa.array([raw[part.begins[k] : part.ends[k]].decode() for k in fresh], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(part.prints[fresh].view(np.int64)), own], names=["rid", "text"])

    return run


def _signed(texts: DataFrame, size: int, count: int) -> DataFrame:
    """``rid``, ``text``, ``sig`` of single paragraphs ``rid``, ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch, "text")
            for lo, hi in slices(column):
                found = words(*text_bytes(column, lo, hi))
                hashes, first = shingles(found.hashes, found.first, size)
                values = np.stack([similar_sets.minima(hashes[a:b], count) for a, b in zip(first[:-1], first[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column.slice(lo, hi - lo), _longs(similar_sets.packed(values))],
                                                 names=["rid", "text", "sig"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, text string, sig array<long>")


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` over every stretch of ``size`` values, by doubling."""
    out, done = values, 1
    while 2 * done <= size:
        out, done = pick(out[:-done], out[done:]), 2 * done
    n = len(values) - size + 1
    return out if done == size else pick(out[:n], out[size - done : size - done + n])


def local_minima(hashes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the runs that are smallest in some stretch of ``SPAN`` runs of one text."""
    n = len(hashes) - RUN + 1
    if n < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = run_hashes(hashes, RUN) | np.uint64(1)
    inside = unit[: n - SPAN + 1] == unit[SPAN + RUN - 2 :]
    least = np.where(inside, _sliding(runs, SPAN, np.minimum), np.uint64(0))
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)))
    kept = _sliding(padded, SPAN, np.maximum) == runs
    kept[1:] &= (runs[1:] != runs[:-1]) | (unit[1:n] != unit[: n - 1])
    places = np.flatnonzero(kept)
    return places, runs[places]


def progressions(owner: np.ndarray, prints: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows where evenly spaced places of one owner and print begin, their distance, and how many follow.

    A text that repeats a few words has a shared run at each of them; as one row they
    are no more rows than texts.
    """
    order = np.lexsort((places, prints, owner))
    same = np.zeros(len(order), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (prints[order][1:] == prints[order][:-1])
    gap = np.where(same, np.diff(places[order], prepend=0), 0)
    goes_on = same.copy()
    goes_on[1:] &= (gap[1:] == gap[:-1]) | ~same[:-1]
    begins = np.flatnonzero(~goes_on)
    more = np.diff(begins, append=len(order)) - 1
    return order[begins], np.where(more > 0, gap[np.minimum(begins + 1, len(order) - 1)], 0), more


def _run_finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = strings(batch, "text"), batch.column(0)
        for lo, hi in slices(texts):
            found = words(*text_bytes(texts, lo, hi))
            places, prints = local_minima(found.hashes, found.unit)
            if len(places):
                owner = found.unit[places]
                rows, step, more = progressions(owner, prints, places)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner[rows] + lo)), pa.array(prints[rows].view(np.int64)),
                     pa.array(places[rows] - found.first[owner[rows]], pa.int32()), pa.array(step, pa.int32()), pa.array(more, pa.int32())],
                    names=["doc_id", "print", "at", "step", "more"])


def _common(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """How many values before ``a[i]`` and ``b[j]``, and from them on, are equal; in steps of growing size."""
    before = after = 0
    step = 64
    while m := min(step, i - before, j - before):
        other = np.flatnonzero(a[i - before - m : i - before] != b[j - before - m : j - before])
        if len(other):
            before += m - 1 - int(other[-1])
            break
        before, step = before + m, 2 * step
    step = 64
    while m := min(step, len(a) - i - after, len(b) - j - after):
        other = np.flatnonzero(a[i + after : i + after + m] != b[j + after : j + after + m])
        if len(other):
            after += int(other[0])
            break
        after, step = after + m, 2 * step
    return before, after


class _Text:
    """The words of one text, and where stretches of them lie."""

    def __init__(self, text: str) -> None:
        self.data = np.frombuffer(text.encode(), np.uint8)
        self.words = words(self.data, np.array([0, len(self.data)]))
        self.chars = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        self.breaks = np.concatenate(([0], np.cumsum(self.data == 10)))

    def place(self, lo: int, hi: int) -> tuple[int, int, int]:
        """Line, first and last character of the words ``lo`` to ``hi``."""
        begin, end = self.words.starts[lo], self.words.ends[hi - 1]
        return int(self.breaks[begin]), int(self.chars[begin]), int(self.chars[end])


def _stretches(first: _Text, text: _Text, seeds: list[dict], alike: bool) -> Iterator[tuple[int, int, int, int]]:
    """(place in ``first``, place in ``text``, words, copies) of the whole equal stretch around every shared run; ``alike``: both are one text."""
    a, b = first.words.hashes, text.words.hashes
    ends: dict[int, int] = {}
    places = ((seed["at"] + k * seed["step"], seed["origin_at"], seed["copies"]) for seed in seeds for k in range(seed["more"] + 1))
    for j, i, copies in sorted(places):
        if alike and i == j or j < ends.get(j - i, 0):  # within the stretch before, which lies on the same diagonal
            continue
        before, after = _common(a, b, i, j)
        if after >= RUN:
            ends[j - i] = j + after
            yield i - before, j - before, before + after, copies


def _islands(found: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first word, end, least origin, most copies) of what overlaps or touches among (first word, end, origin, copies)."""
    held: tuple[int, int, int, int] | None = None
    for lo, hi, origin, copies in sorted(found):
        if held is not None and lo <= held[1]:
            held = held[0], max(held[1], hi), min(held[2], origin), max(held[3], copies)
            continue
        if held is not None:
            yield held
        held = lo, hi, origin, copies
    if held is not None:
        yield held


def _extender(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, first = None, None
    for batch in batches:
        rows = []
        for a, b, text_a, text_b, seeds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first is None or text_a != last:  # rows come sorted by the first text
                last, first = text_a, _Text(text_a)
            text = _Text(text_b)
            found = [(i, j, n, first.place(i, i + n)[0], copies) for i, j, n, copies in _stretches(first, text, seeds, a == b)]
            for lo, hi, line, copies in _islands([(i, i + n, line, copies) for i, _, n, line, copies in found]):
                rows.append((a, True, lo, hi, *first.place(lo, hi), a, line, copies))
            for lo, hi, line, copies in _islands([(j, j + n, line, copies) for _, j, n, line, copies in found]):
                rows.append((b, False, lo, hi, *text.place(lo, hi), a, line, copies))
        if rows:
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=[x.split()[0] for x in _STRETCHES.split(", ")])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage that documents share, overlapping and touching ones of one text merged.

    Columns as in ``repeated_paragraphs``; ``paragraph`` is the line where the
    passage begins. Shared runs are seeds: each is compared with the run's first
    occurrence, by id and place, which is kept, and both are extended word by
    word to the whole stretch that is equal. A word that is cut is thus equal to
    one at an earlier place; going on from there ends at one that stays.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    runs = written_once(texts.mapInArrow(_run_finder, _RUNS))
    shared = runs.groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc")
    places = written_once(runs.join(shared.select("print", "first_doc"), "print").dropDuplicates(["print", "doc_id", "at", "step", "more"]))
    discard(runs)
    first = places.groupBy("print").agg(F.min(F.when(F.col("doc_id") == F.col("first_doc"), F.col("at"))).alias("origin_at"), F.sum(F.col("more").cast("long") + 1).alias("copies"))
    pairs = written_once(places.join(first, "print").where("doc_id <> first_doc or at <> origin_at or more > 0").groupBy(
        F.col("first_doc").alias("a"), F.col("doc_id").alias("b")).agg(F.collect_list(F.struct("at", "step", "more", "origin_at", "copies")).alias("seeds")))
    discard(places)
    paired = marked(texts, "doc_id", pairs.select(F.explode(F.array("a", "b")))).where("_maybe")
    joined = pairs.join(paired.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(
        paired.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    stretches = joined.select("a", "b", "text_a", "text_b", "seeds").mapInArrow(_extender, _STRETCHES)
    longest = stretches.groupBy("doc_id", "kept", "lo").agg(
        F.max(F.struct("hi", "end")).alias("_last"), F.min("line").alias("line"), F.min("start").alias("start"),
        F.min(F.struct("first_doc", "first_line")).alias("_origin"), F.max("copies").alias("copies"))
    order = Window.partitionBy("doc_id", "kept").orderBy("lo")
    apart = F.coalesce(F.col("lo") > F.max("_last.hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = longest.withColumn("_new", apart.cast("int")).withColumn("_island", F.sum("_new").over(order)).groupBy("doc_id", "kept", "_island").agg(
        F.min("line").alias("paragraph"), F.min("start").alias("start"), (F.max("_last.end") - F.min("start")).alias("n_chars"),
        (F.max("_last.hi") - F.min("lo")).cast("int").alias("n_words"), F.min("_origin").alias("_origin"), F.max("copies").alias("copies"))
    return merged.select("doc_id", F.lit("passage").alias("kind"), "paragraph", "start", "n_chars", "n_words",
                         F.col("_origin.first_doc").alias("component_doc"), F.col("_origin.first_line").alias("component_paragraph"), "copies", "kept")


def repeated_texts(docs: DataFrame, **how) -> DataFrame:
    """The repeated paragraphs of ``docs``, and the passages that repeat in what is left without those that are cut.

    A passage's first occurrence is thus never inside a paragraph that is cut.
    ``start`` and ``n_chars`` are places in the whole text; a passage may go on
    behind a cut paragraph, whose words it does not count.
    """
    found = written_once(repeated_paragraphs(docs, **how))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    left = _cut_out(texts, found.where(~F.col("kept")), lambda cut: F.repeat(F.lit(" "), cut["length"].cast("int")))
    return found.unionByName(repeated_passages(written_once(left.select("doc_id", "text"))))


def repeated_paragraphs(docs: DataFrame, size: int = 5, percent: int = 80, least_words: int = 5, bands: int = 16, rows: int = 4) -> DataFrame:
    """One row per paragraph that occurs, word for word or similarly, in other documents too.

    Paragraphs are the lines of ``text`` with at least ``least_words`` words, by
    default all that hold a whole shingle. ``doc_id``, ``kind``,
    ``paragraph`` (the line's number from 0), ``start`` and ``n_chars`` (in
    characters of the text, without blanks at its ends), ``n_words``,
    ``component_doc`` and ``component_paragraph`` (the first occurrence in the
    group, by id and line), ``copies`` (rows of the group) and ``kept`` (true
    for the first occurrence; the others are to be removed).

    Paragraphs are linked if 100 * intersection >= ``percent`` * union of
    their ``size``-word shingles; groups are the components of the links that
    span at least two documents. 16 bands of 4 minima miss a pair at the
    threshold with probability 2e-4, and one at 0.9 with 6e-8. Equal word
    sequences are one class, known by a 64-bit print (two different ones share
    a print with probability 5e-20 a pair).

    Null and empty texts have no paragraphs; rows without id take no part.
    Repeated rows of one document are decided alike. An empty table gives no
    rows; further columns are ignored.
    """
    count = bands * rows
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = written_once(texts.mapInArrow(_placer(size, bands, rows, least_words), _PLACES))
    found = similar_sets.similar_components(
        texts.mapInArrow(_keyer(size, bands, rows, least_words), "rid long, bands array<long>"),
        texts.mapInArrow(_texter(size, least_words), "rid long, text string"), size, percent, count,
        sample=placed.where("bands is not null").select("rid", "bands").dropDuplicates(["rid"]), sign=lambda own: _signed(own, size, count))
    places = placed.select("doc_id", "paragraph", "start", "n_chars", "n_words", "rid").join(
        found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid")).drop("rid")
    groups = places.groupBy("component").agg(
        F.min("doc_id").alias("component_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("copies"),
        F.min(F.struct("doc_id", "paragraph"))["paragraph"].alias("component_paragraph")).where("component_doc <> last_doc")
    return places.join(groups, "component").select(
        "doc_id", F.lit("paragraph").alias("kind"), "paragraph", "start", "n_chars", "n_words", "component_doc", "component_paragraph", "copies",
        ((F.col("doc_id") == F.col("component_doc")) & (F.col("paragraph") == F.col("component_paragraph"))).alias("kept"))


def _cut_out(docs: DataFrame, spans: DataFrame, fill: Callable) -> DataFrame:
    """``docs`` with the ``spans`` of their texts replaced by ``fill``; ``_cut`` is null where there are none."""
    span = F.struct("start", F.col("n_chars").alias("length"))
    cuts = written_once(spans.groupBy(F.col("doc_id").alias("_cut_id")).agg(F.sort_array(F.collect_set(span)).alias("_cut")))
    told = marked(docs, "doc_id", cuts.select("_cut_id"))  # whole texts aren't shuffled
    joined = told.where("_maybe").join(cuts, F.col("doc_id") == F.col("_cut_id"), "left").unionByName(
        told.where("not _maybe").select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in cuts.dtypes))).drop("_maybe")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, cut):
        kept = F.when(cut["start"] > state["at"], F.substring("text", state["at"].cast("int") + 1, (cut["start"] - state["at"]).cast("int"))).otherwise("")
        return F.struct(F.greatest(state["at"], cut["start"] + cut["length"]).alias("at"), F.concat(state["out"], kept, fill(cut)).alias("out"))

    rest = F.aggregate("_cut", start, step, lambda s: F.concat(s["out"], F.substring("text", s["at"].cast("int") + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(rest))


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every repeated paragraph and passage but the first occurrence cut out of its text.

    All rows and columns stay; a text may become empty. Lines without words go
    from texts that are cut. ``n_chars``, if there, follows the new text.
    """
    joined = _cut_out(docs, repeated_texts(docs, **how).where(~F.col("kept")), lambda cut: F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    shorter = joined.withColumn("text", F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        shorter = shorter.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return shorter.select(docs.columns)
