"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import fold, slices, strings, table, text_bytes, training_texts
from tracesift.llm.textkernel import words

#: Hashed word buckets, structure statistics, and size of the interaction vectors.
BUCKETS, STATS, RANK = 4096, 20, 8
#: Labelled documents that a fit reads at most.
SAMPLE = 10_000

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_CLASS[[ord(c) for c in "#$%&*|<>{}[]\\^~_=+@"]] = 4
_CLASS[[ord(c) for c in ".,;:!?\"'()-/"]] = 5
_CLASS[10] = 6


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def features(texts: pa.Array, metadata: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per range of texts: its first row, where each text's word entries begin, their buckets and values, and the statistics."""
    for lo, hi in slices(texts):
        data, offsets = text_bytes(texts, lo, hi)
        found = words(data, offsets)
        n = hi - lo
        count = np.diff(found.first)
        some = np.maximum(count, 1)
        keys, repeats = np.unique((found.unit.astype(np.uint64) << np.uint64(32)) | (found.hashes >> np.uint64(32)), return_counts=True)
        owner = (keys >> np.uint64(32)).astype(np.int64)
        first = np.searchsorted(owner, np.arange(n + 1))
        most = np.zeros(n)
        np.maximum.at(most, owner, repeats)
        values = np.log1p(repeats)
        values = values / np.sqrt(np.maximum(_sums(values**2, first), 1e-9))[owner]
        buckets = (keys % np.uint64(BUCKETS)).astype(np.int64)
        size = np.diff(offsets)
        kinds = _CLASS[data]
        part = [_sums(kinds == k, offsets) / np.maximum(size, 1) for k in range(7)]
        same = np.zeros(len(found.hashes), bool)
        same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (found.unit[1:] == found.unit[:-1])
        last = data[found.ends - 1] if len(data) else np.empty(0, np.uint8)
        lengths = found.ends - found.starts
        capital = kinds[found.starts] == 1 if len(data) else np.empty(0, bool)
        meta = np.where(np.isfinite(metadata[lo:hi]), metadata[lo:hi], 0)
        stats = np.stack([
            np.log1p(size), np.log1p(count), *part,
            _sums(lengths, found.first) / some, _sums(lengths == 1, found.first) / some,
            np.diff(first) / some, most / some, _sums(same, found.first) / some,
            _sums(_CLASS[last] == 4, found.first) / some, _sums(last == 33, found.first) / some, _sums(last == 46, found.first) / some,
            _sums(capital, found.first) / some, np.log1p(np.maximum(meta, 0)), np.log1p(np.maximum(meta, 0)) - np.log1p(size),
        ], axis=1)
        yield lo, first, buckets, values, stats


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + ½ Σ_f ((Σ_i v_if x_i)² - Σ_i v_if² x_i²))."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scores(self, first: np.ndarray, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """In time linear in the entries: three sums per text."""
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        scaled = self.standard(stats)
        linear = scaled @ self.weight[BUCKETS:] + np.bincount(owner, self.weight[buckets] * values, len(scaled))
        total, square = scaled @ self.factors[BUCKETS:], scaled**2 @ (self.factors[BUCKETS:] ** 2)
        for f in range(self.factors.shape[1]):
            part = self.factors[buckets, f] * values
            total[:, f] += np.bincount(owner, part, len(scaled))
            square[:, f] += np.bincount(owner, part**2, len(scaled))
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + 0.5 * (total**2 - square).sum(axis=1), -30, 30)))

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.spread, -4, 4) / 4


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, seed: int = 1) -> Machine:
    """Logistic loss by Adam over mini-batches; word entries are shrunk more than statistics."""
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows]).reshape(len(rows), STATS)
    machine = Machine(0.0, np.zeros(BUCKETS + STATS), rng.normal(0, 0.05, (BUCKETS + STATS, RANK)),
                      stats.mean(axis=0) if len(rows) else np.zeros(STATS), (stats.std(axis=0) if len(rows) else np.ones(STATS)) + 1e-3)
    if not len(rows):
        machine.factors[:] = 0
        return machine
    share = np.clip(labels.mean(), 0.01, 0.99)
    machine.bias = float(np.log(share / (1 - share)))
    scaled = machine.standard(stats)
    shrink = np.where(np.arange(BUCKETS + STATS) < BUCKETS, 1e-3, 1e-5)
    state = [np.array([machine.bias]), machine.weight, machine.factors]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), 128):
            batch = order[k : k + 128]
            x = np.zeros((len(batch), BUCKETS + STATS))
            for i, r in enumerate(batch):
                np.add.at(x[i], rows[r][0], rows[r][1])
            x[:, BUCKETS:] = scaled[batch]
            total = x @ state[2]
            squares = x**2
            raw = state[0][0] + x @ state[1] + 0.5 * (total**2 - squares @ state[2] ** 2).sum(axis=1)
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) / len(batch)
            grads = [np.array([off.sum()]), off @ x + shrink * state[1],
                     x.T @ (off[:, None] * total) - (off @ squares)[:, None] * state[2] + shrink[:, None] * state[2]]
            step += 1
            for p, g, (m, v) in zip(state, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    machine.bias = float(state[0][0])
    return machine


def _metadata(batch: pa.RecordBatch, name: str = "n_chars") -> np.ndarray:
    at = batch.schema.get_field_index(name)
    return batch.column(at).cast(pa.float64()).to_numpy(zero_copy_only=False) if at >= 0 else np.zeros(batch.num_rows)


def _prepared(docs: DataFrame, *extra: str) -> DataFrame:
    meta = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(*extra, F.col("text").cast("string").alias("text"), meta.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, most: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``most`` labelled documents outside the held-out fold.

    Features are built on the executors; the driver gets some hundred numbers
    per sampled document and runs the descent. Without labelled rows every score is 0.5.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, first, buckets, values, stats in features(strings(batch, "text"), _metadata(batch)):
                n = len(stats)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n),
                     pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(buckets, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.float32())),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * STATS, pa.int32()), pa.array(stats.ravel(), pa.float64()))],
                    names=["doc_id", "label", "buckets", "values", "stats"])

    chosen = training_texts(_prepared(docs, "doc_id"), labels, "quality" if "quality" in labels.columns else "label", most, parts, held)
    found = chosen.select(F.col("doc_id").cast("long"), F.col("_label").alias("label"), "text", "n_chars").mapInArrow(
        run, "doc_id long, label int, buckets array<int>, values array<float>, stats array<double>").toArrow().sort_by("doc_id")
    rows = list(zip(*(found.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("buckets", "values", "stats")), strict=True)) if found.num_rows else []
    return fit(rows, found.column("label").to_numpy().astype(float) if rows else np.empty(0))


def _all_scores(machine: Machine, batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows)
    for lo, *found in features(strings(batch, "text"), _metadata(batch)):
        out[lo : lo + len(found[-1])] = machine.scores(*found)
    return out


def scored(docs: DataFrame, machine: Machine, parts: int = 5, held: int = 0, least: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    Only ``text`` and the ``n_chars`` metadata enter a score. Null and empty
    texts are scored by their statistics alone. Repeated rows get equal scores;
    a null id stays null and is not held out. An empty table gives no rows;
    further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_all_scores(machine, batch))], names=["doc_id", "score"])

    out = _prepared(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, decided where they are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_all_scores(machine, batch) >= least))

    return docs.mapInArrow(run, docs.schema)


def score_documents(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scored(docs, train(docs, table(spark, folder, "labels")))
