"""Links between similar shingle sets: band candidates, b-bit estimates, exact checks, components.

The items are classes of equal sets, each with band keys and a packed
signature. Band keys are shuffled once. Groups are never expanded into all pairs: in each bucket members are
first tested against one hub; only buckets whose members still lie in several
components are then compared pairwise, in blocks of bounded size, and only
pairs between components whose finer signatures agree well enough leave the
join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracesift.llm.common import components, marked, slices, strings, text_bytes
from tracesift.llm.textkernel import LOWER_BYTES, mix, shingles, words
from tracesift.session import discard, written_once

#: Minima in a signature and low bits kept of each (16 to a long).
MINIMA, BITS = 128, 4
#: The same for the finer signatures of members compared pairwise (64 to a long).
FINE, FINE_BITS = 1536, 1
#: Members of a bucket that one join key may hold on either side.
BLOCK = 1024
#: Rounds over open buckets: members against another hub in all but the last, pairwise in the last.
HUB_ROUNDS = 2
#: Standard errors by which an estimate may fall short of the threshold.
MARGIN = 5.5
#: One of so many items is counted to find keys of large buckets; such a key has this many counted items at least.
SAMPLED, EVIDENCE = 64, 16
#: A bucket of a larger share of the items than one in so many is dealt over several tasks.
SHARE = 10_000

_A = mix(np.arange(FINE, dtype=np.uint64), 3) | np.uint64(1)
_B = mix(np.arange(FINE, dtype=np.uint64), 4)


def minima(hashes: np.ndarray, count: int = MINIMA) -> np.ndarray:
    """The smallest value of each of ``count`` hash functions over a set's hashes (not empty)."""
    out = np.full(count, 2**64 - 1, np.uint64)
    step = (MINIMA << 11) // count
    for k in range(0, len(hashes), step):
        part = hashes[None, k : k + step] * _A[:count, None] + _B[:count, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` minima, for sets in rows of ``values``."""
    grouped = values[:, : bands * rows].reshape(len(values), bands, rows)
    keys = np.zeros((len(values), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys + grouped[:, :, r], r + 20)
    return mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` bits of all (scrambled) minima, 64 // ``bits`` to a long, for sets in rows of ``values``."""
    low = (mix(values, 9) & np.uint64(2**bits - 1)).reshape(len(values), values.shape[1] * bits // 64, 64 // bits)
    shifts = np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_or.reduce(low << shifts, axis=2).view(np.int64)


def estimate(a: Column, b: Column, count: int, bits: int = BITS) -> Column:
    """Similarity from two packed signatures, corrected for minima that agree in their low bits by chance."""
    differing = F.lit(0)
    for k in range(count * bits // 64):
        x = a[k].bitwiseXOR(b[k])
        if bits == 4:  # one bit for each four of which any is set
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differing = differing + F.bit_count(x)
    chance = 1 / 2**bits
    return (1 - differing / F.lit(float(count)) - chance) / (1 - chance)


def least_estimate(threshold: float, count: int, bits: int = BITS) -> float:
    """The threshold less ``MARGIN`` standard errors of the estimate."""
    agree = threshold + (1 - threshold) / 2**bits
    return threshold - MARGIN * (agree * (1 - agree) / count) ** 0.5 / (1 - 1 / 2**bits)


def shingle_set(text: str, size: int) -> set:
    """The distinct shingles of a text; fewer words than ``size`` are one shingle, no words none."""
    words = text.encode().translate(LOWER_BYTES).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _verifier(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, set()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:  # rows come sorted by the hub
                    last, hub = a, shingle_set(a, size)
                other = shingle_set(b, size)
                both = len(hub & other)
                keep.append(100 * both >= percent * (len(hub) + len(other) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    kind = pairs.schema["a"].dataType.simpleString()
    joined = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(size, percent), f"a {kind}, b {kind}")


def _estimated(pairs: DataFrame, signatures: DataFrame, least: float, count: int) -> DataFrame:
    """The distinct pairs whose signatures allow the threshold."""
    return (
        pairs.distinct()
        .join(signatures.select(F.col("rid").alias("b"), F.col("sig").alias("sig_b")), "b")
        .join(signatures.select(F.col("rid").alias("a"), F.col("sig").alias("sig_a")), "a")
        .where(estimate(F.col("sig_a"), F.col("sig_b"), count) >= least)
        .select("a", "b")
    )


def _finely_signed(texts: DataFrame, size: int) -> DataFrame:
    """``rid``, ``fine`` (the finer signature), ``sig``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch, "text")
            for lo, hi in slices(column):
                found = words(*text_bytes(column, lo, hi))
                hashes, first = shingles(found.hashes, found.first, size)
                fine = packed(np.stack([minima(hashes[a:b], FINE) for a, b in zip(first[:-1], first[1:], strict=True)]), FINE_BITS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * fine.shape[1], pa.int32()), pa.array(fine.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, batch.column(2).slice(lo, hi - lo)], names=["rid", "fine", "sig"])

    kind = texts.schema["rid"].dataType.simpleString()
    return texts.select("rid", "text", "sig").mapInArrow(run, f"rid {kind}, fine array<long>, sig array<long>")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(len(column), -1)


def _agreeing(a: np.ndarray, b: np.ndarray, count: int, bits: int, least: float) -> np.ndarray:
    """Which packed signatures allow the threshold, by the estimate of ``estimate``."""
    x = a ^ b
    if bits == 4:
        x |= x >> np.uint64(1)
        x = (x | x >> np.uint64(2)) & np.uint64(0x1111111111111111)
    chance = 1 / 2**bits
    return (1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / count - chance) / (1 - chance) >= least


def _pairer(percent: int, count: int):
    """Pairs of one block (two chunks of about ``BLOCK`` members of a hub, or one with itself), compared a few rows at a time."""
    least, least_fine = least_estimate(percent / 100, count), least_estimate(percent / 100, FINE, FINE_BITS)

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("rid")
        _, group = np.unique(block["component"].to_numpy(), return_inverse=True)
        chunk, sig, fine = block["chunk"].to_numpy(), _matrix(block["sig"]), _matrix(block["fine"])
        n, between = len(block), block["lo"][0].as_py() != block["hi"][0].as_py()
        hub, hubs = block["hub"][0].as_py(), [frozenset(h) for h in block["hubs"].to_pylist()]
        found = []
        step = max(1, (1 << 18) // (n * sig.shape[1]))
        for k in range(0, n, step):
            top = min(k + step, n)
            apart = (group[k:top, None] != group[k:]) & np.triu(np.ones((top - k, n - k), bool), 1)
            if between:
                apart &= chunk[k:top, None] != chunk[k:]
            a, b = np.nonzero(apart & _agreeing(sig[k:top, None], sig[None, k:], count, BITS, least))
            for m in range(0, len(a), 1 << 14):
                x, y = a[m : m + (1 << 14)] + k, b[m : m + (1 << 14)] + k
                close = _agreeing(fine[x], fine[y], FINE, FINE_BITS, least_fine)
                found += [(i, j) for i, j in zip(x[close].tolist(), y[close].tolist(), strict=True) if min(hubs[i] & hubs[j]) == hub]
        rid = block["rid"]
        return pa.table({name: rid.take(pa.array([pair[side] for pair in found], pa.int64())) for side, name in enumerate("ab")})

    return run


def _block_pairs(members: DataFrame, signatures: DataFrame, percent: int, count: int) -> DataFrame:
    """Pairs between components, by joins of blocks of about ``BLOCK`` members of one hub's buckets with fine signatures.

    Members of all buckets of a hub meet once, however many buckets they share;
    of several shared hubs only the smallest gives the pair.
    """
    distinct = members.select("hub", "rid", "component").distinct()
    sizes = distinct.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    hubs = distinct.groupBy("rid").agg(F.collect_set("hub").alias("hubs"))
    rows = (
        distinct.join(sizes, "hub")
        .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")))
        .join(signatures.join(hubs, "rid"), "rid")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
        .select("hub", "rid", "component", "fine", "sig", "hubs", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    )
    kind = members.schema["rid"].dataType.simpleString()
    return rows.groupBy("hub", "lo", "hi").applyInArrow(_pairer(percent, count), f"a {kind}, b {kind}")


def _large_buckets(sample: DataFrame) -> DataFrame:
    """``key``, ``salts`` of the keys that hold more than one in ``SHARE`` of the sampled items.

    Every item has a fixed number of keys, so there are at most that number
    times ``SHARE`` of them, whatever the size of the data.
    """
    total = sample.agg(F.count("*").alias("total"))
    counts = sample.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= EVIDENCE)
    return counts.join(F.broadcast(total), F.col("n") * SHARE > F.col("total")).select(
        "key", F.ceil(F.col("n") * SHARE / F.col("total")).cast("int").alias("salts"))


def _members(items: DataFrame, sample: DataFrame) -> DataFrame:
    """``key``, ``hub`` (the smallest item), ``rid`` of all items in buckets of two or more, as a written table.

    The keys are shuffled once. Sorted by key and item, an item needs only the
    bucket's first and the next one, so no bucket is held in memory; those of
    ``_large_buckets`` are dealt over several tasks, and their hubs are found in a second step.
    """
    large = written_once(_large_buckets(sample))
    postings = items.select("rid", F.explode("bands").alias("key")).join(F.broadcast(large), "key", "left").select(
        "key", "rid", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int") + 1).otherwise(0).alias("salt"))
    order = Window.partitionBy("key", "salt").orderBy("rid")
    dealt = postings.select("key", "rid", "salt", F.first("rid").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("hub"),
                            F.lead("rid").over(order).alias("after"))
    last_copy = F.col("after").isNull() | (F.col("after") != F.col("rid"))
    shared = written_once(dealt.where(last_copy & ((F.col("salt") > 0) | (F.col("rid") != F.col("hub")) | F.col("after").isNotNull()))
                          .select("key", "rid", "salt", "hub"))
    tops = shared.where("salt > 0").groupBy("key").agg(F.min("rid").alias("top"))  # no more keys than in ``large``
    members = written_once(shared.join(F.broadcast(tops), "key", "left").select("key", F.coalesce("top", "hub").alias("hub"), "rid"))
    discard(shared)
    discard(large)
    return members


def similar_components(items: DataFrame, texts: DataFrame, size: int, percent: int, count: int = MINIMA, sample: DataFrame | None = None,
                       sign=None) -> DataFrame:
    """``node``, ``component`` of all items that have a similar other item.

    ``items``: ``rid`` (orderable) and ``bands``, read once; ``sample``: the
    same of about one in ``SAMPLED`` items; ``texts``: ``rid``, ``text`` and
    ``sig`` of ``count`` minima, which otherwise ``sign`` adds to the texts
    that share a bucket. Rows with the same ``rid`` are copies. Two
    items are linked if 100 * intersection >= ``percent`` * union of their
    distinct shingles of ``size`` words. The component is its smallest ``rid``.
    Large intermediates are deleted when done; the result is a written table.
    """
    least = least_estimate(percent / 100, count)
    if sample is None:
        sample = items.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLED)) == 0)
    members = _members(items, sample)
    if sign:  # texts as they are read, of which few may share a bucket
        texts = marked(texts, "rid", members.select("rid")).where("_maybe").drop("_maybe")
    held = texts.join(members.select("rid").distinct(), "rid", "left_semi").dropDuplicates(["rid"])
    needed = written_once(sign(held) if sign else held)
    signatures = needed.select("rid", "sig")

    def tested(pairs: DataFrame) -> DataFrame:
        return written_once(_verified(pairs, needed, size, percent))

    hubs = members.where(F.col("rid") != F.col("hub")).select(F.col("hub").alias("a"), F.col("rid").alias("b"))
    links = tested(_estimated(hubs, signatures, least, count))
    found = written_once(components(links))
    for turn in range(1, HUB_ROUNDS + 1):
        labelled = members.join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn(
            "component", F.coalesce("component", "rid"))
        open_keys = labelled.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"),
            F.min_by(F.struct("rid", "component"), F.xxhash64("rid", F.lit(turn))).alias("next")).where("lo <> hi and n > 2")
        mixed = written_once(labelled.join(open_keys.select("key", "next", "n"), "key").where(F.col("rid") != F.col("hub")))
        if mixed.isEmpty():
            discard(mixed)
            break
        if turn < HUB_ROUNDS:
            hubs = mixed.where(F.col("component") != F.col("next.component")).select(
                F.least("rid", "next.rid").alias("a"), F.greatest("rid", "next.rid").alias("b"))
            more = tested(_estimated(hubs, signatures, least, count))
        else:
            fine = written_once(_finely_signed(needed.join(mixed.select("rid").distinct(), "rid", "left_semi"), size))
            more = tested(_block_pairs(mixed, fine, percent, count))
            discard(fine)
        discard(mixed)
        if not more.isEmpty():
            stars = found.where(F.col("node") != F.col("component")).select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = written_once(components(stars.union(more)))
    discard(members)
    discard(needed)
    return found
