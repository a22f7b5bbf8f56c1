"""Exact token counts of texts of any length by overlap resynchronisation.

A huge text is cut into overlapping chunks, which are encoded apart from each
other with offsets and spliced where both sides of an overlap begin a word of the
pre-tokenizer at the same place.

Why such a place x is stable: the pre-tokenizer scans from left to right, keeps
no state between matches and never looks back, so two scans that both begin a
match at x agree from there on. The left chunk's scan agrees with that of the
whole text up to its own end but for ``margin`` characters: a match depends on no
more than that many after it (the length of a special string, or a contraction).
So x begins a word of the whole text too, and words are encoded one by one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import slices, strings
from tracesift.session import written_once

#: Copies of a huge text's count, so that rows with the same text meet it in as many tasks.
_SALTS = 16


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def margin_of(path: str) -> int:
    """Characters before a chunk's end whose boundaries prove nothing: the longest special string, and a contraction."""
    return max([len(t.content) for t in _tokenizer(path).get_added_tokens_decoder().values()], default=0) + 3


#: A space after a visible ASCII character always begins a word of the pre-tokenizer, and no special string holds one.
_CUT = re.compile("(?<=[!-~])(?= )")
#: Units whose counts a worker keeps, and the characters of the longest kept; when full it starts anew.
_KEPT_UNITS, _KEPT_CHARS = 1_000_000, 64


@cache
def _kept(path: str) -> dict[str, int]:
    return {}


def _counts(path: str, texts: list[str]) -> list[int]:
    """The tokens of each text, as the sum over its units; each distinct short unit is encoded once a worker."""
    kept = _kept(path)
    if len(kept) > _KEPT_UNITS:
        kept.clear()
    cut = [_CUT.split(text) for text in texts]
    missing = list({unit for units in cut for unit in units if unit not in kept})
    new = dict(zip(missing, map(len, _tokenizer(path).encode_batch_fast(missing, add_special_tokens=False)), strict=True))
    kept.update((unit, n) for unit, n in new.items() if len(unit) <= _KEPT_CHARS)
    return [sum(kept[unit] if unit in kept else new[unit] for unit in units) for units in cut]


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch, "text")
            kept = batch.drop_columns(["text"])
            for lo, hi in slices(texts):
                counts = _counts(path, texts.slice(lo, hi - lo).to_pylist())
                yield kept.slice(lo, hi - lo).append_column("n_tokens", pa.array(counts, pa.int64()))

    return run


def _cutter(step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in strings(batch, "text"):
                text = text.as_py()
                key = sha256(text.encode()).hexdigest()
                count = max(1, -(-(len(text) - overlap) // step))
                for k in range(count):
                    piece = text[k * step : (k + 1) * step + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([k], pa.int64()), pa.array([k == count - 1]), pa.array([piece], pa.string())],
                        names=["key", "number", "last", "piece"])

    return run


def boundaries(path: str, piece: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of a piece's tokens, the places where words of the pre-tokenizer begin, and the tokens before each."""
    encoded = _tokenizer(path).encode(piece, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in encoded.word_ids], np.int64)
    first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.empty(0, np.int64)
    offsets = encoded.offsets
    return len(words), np.array([offsets[k][0] for k in first.tolist()], np.int64), first


_MARKS = pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))


def _marker(path: str, step: int, overlap: int):
    """Arrow function: each piece's two joints, the one after it with the piece's tokens, the one before it without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out: list[tuple] = []
            for key, number, last, piece in zip(rows["key"], rows["number"], rows["last"], rows["piece"], strict=True):
                total, at, before = boundaries(path, piece)
                tail = (at >= step) & (at <= len(piece) - margin_of(path))
                after = [{"at": int(x) - step, "tokens": total - int(t)} for x, t in zip(at[tail], before[tail], strict=True)]
                out.append((key, number, total, None if last else after, None))
                if number:
                    head = at < overlap
                    ahead = [{"at": int(x), "tokens": int(t)} for x, t in zip(at[head], before[head], strict=True)]
                    out.append((key, number - 1, 0, None, ahead))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), _MARKS, _MARKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "joint", "tokens", "after", "before"])

    return run


def _spliced(texts: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """``key``, ``n_tokens`` of every distinct text; null where some joint has no common boundary."""
    pieces = texts.mapInArrow(_cutter(step, overlap), "key string, number long, last boolean, piece string")
    marks = "array<struct<at:long,tokens:long>>"
    ends = pieces.dropDuplicates(["key", "number"]).mapInArrow(
        _marker(path, step, overlap), f"key string, joint long, tokens long, after {marks}, before {marks}")
    joints = ends.groupBy("key", "joint").agg(
        F.sum("tokens").alias("tokens"), F.max("after").alias("after"), F.max("before").alias("before"))
    x = F.array_min(F.array_intersect(F.transform("after", lambda m: m["at"]), F.transform("before", lambda m: m["at"])))
    joints = joints.withColumn("x", x)
    held = lambda side: F.get(F.filter(side, lambda m: m["at"] == F.col("x")), 0)["tokens"]
    twice = F.when(F.col("after").isNull(), F.lit(0)).otherwise(held("after") + held("before"))
    parts = joints.select("key", "tokens", twice.alias("twice"))
    whole = F.count("twice") == F.count(F.lit(1))
    return parts.groupBy("key").agg(F.when(whole, F.sum("tokens") - F.sum("twice")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, step: int = 1 << 15, overlap: int = 1 << 9) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` of every whole text, as the tokenizer at ``path`` encodes it.

    Special strings inside a text become special tokens, the tokenizer's default.
    Texts of up to ``step + overlap`` characters are encoded as they are. Longer
    ones are cut into chunks, which are shuffled, so that one huge text keeps many
    tasks busy; equal chunks of equal texts are encoded once. Where some overlap
    has no common boundary (one word over the whole of it), chunk and overlap of
    just those texts grow fourfold and they are done again, until a chunk is the
    text: every text gets its exact count. The vocabulary's pre-tokenizer must be
    one without state (byte-level), its special strings must not overlap.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each,
    null ids stay, further columns are ignored, an empty table gives no rows.
    """
    if overlap > step or overlap <= margin_of(path):
        raise ValueError("overlap must be above the margin and at most step")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    huge = rows.where(F.char_length("text") > step + overlap)
    short = rows.where(F.char_length("text") <= step + overlap).mapInArrow(_counter(path), "doc_id long, n_bytes long, n_tokens long")
    keyed = huge.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    counts: DataFrame | None = None
    waiting = huge.select("text")
    while True:
        found = written_once(_spliced(waiting, path, step, overlap))
        done = found.where("n_tokens is not null")
        counts = done if counts is None else counts.union(done)
        failed = found.where("n_tokens is null").select("key")
        if failed.isEmpty():
            break
        step, overlap = step * 4, overlap * 4
        waiting = keyed.join(failed, "key", "left_semi").select("text")
    copies = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = keyed.select("doc_id", "n_bytes", "key", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int").alias("_salt"))
    return short.union(salted.join(copies, ["key", "_salt"]).select("doc_id", "n_bytes", "n_tokens"))


def counted_documents(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``token_counts`` with ``over_limit``: more than ``limit`` tokens."""
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
