"""Top-k, first-wins and ordered-gap building blocks shared by the operators.

None of them puts one key's rows into one task: top-k per group prunes before
the shuffle, first-wins is an aggregate with map-side combine, and the gap and
change operators work on (key, time bucket) pieces and stitch piece summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracesift.functions.times import epoch_bucket
from tracesift.session import written_once


def positive(name: str, value: int) -> int:
    if value is None or value < 1:
        raise ValueError(f"{name} must be at least 1")
    return value


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that later filters and projections share.

    A filter on a plain computed column is pushed below the projection and so
    computes the column a second time; it is not pushed below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def top_n(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """First n rows by the order; all rows in that order for ``None``."""
    if n is None:
        return df.orderBy(*order)
    return df.orderBy(*order).limit(positive("n", n))


def ranked_top_n(df: DataFrame, n: int, *order: Column, name: str = "rank") -> DataFrame:
    """``top_n`` plus a 1-based rank; the window sees only the n kept rows."""
    return top_n(df, n, *order).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_per_group(df: DataFrame, keys: Sequence[str], n: int, *order: Column, name: str | None = None) -> DataFrame:
    """First n rows of each group; Spark prunes to n a group before it shuffles."""
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(rank) <= positive("n", n))
    return out if name else out.drop(rank)


def placed(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """``df`` sorted by keys and order over range partitions and written once, with
    each row's ``_bucket`` (its partition) and ``_place`` (ascending within it).

    A key with many rows spans several buckets. Rows equal in keys and order share
    one, so the order should be all but unique.
    """
    by = [*[F.asc(k) for k in keys], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written_once(
        rows.select("*", F.spark_partition_id().alias("_bucket"), F.monotonically_increasing_id().alias("_place"))
    )


def bucket_shifts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and bucket of ``placed`` rows: ``_shift``, which turns a place into the
    0-based rank within the key, and ``_size``, the key's rows.

    A prefix sum over the buckets of a key: one row per bucket, not per row.
    """
    pieces = rows.groupBy(*keys, "_bucket").agg(F.min("_place").alias("_from"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))
    return pieces.select(
        *keys, "_bucket", (before - F.col("_from")).alias("_shift"), F.sum("_n").over(whole).alias("_size")
    )


def with_shifts(rows: DataFrame, shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``placed`` rows next to their bucket's facts; keys may be null."""
    on = ["_bucket", *keys]
    facts = shifts.select(*[F.col(c).alias(f"_of_{c}") if c in on else F.col(c) for c in shifts.columns])
    same = F.col("_bucket") == F.col("_of__bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(facts, same).drop(*[f"_of_{c}" for c in on])


def numbered(df: DataFrame, keys: Sequence[str], *order: Column, name: str = "rank") -> DataFrame:
    """Every row with its exact 1-based rank within its key, however many rows a key has.

    Range partitions cut a key into buckets; a row's rank is its place in its
    bucket plus the rows of the key's earlier buckets. No window sees a whole key,
    unlike ``row_number``, which sorts it in one task. Without keys the whole table
    is numbered.
    """
    rows = placed(df, keys, *order)
    ranked = with_shifts(rows, bucket_shifts(rows, keys), keys)
    return ranked.select(*df.columns, (F.col("_place") + F.col("_shift") + 1).alias(name))


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key by the given columns."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("_first")
    )
    return picked.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def with_group_totals(
    df: DataFrame, n: int, order: Sequence[Column], totals: dict[str, Column], spread: int = 1024
) -> DataFrame:
    """Top n rows of ``df`` with totals over all its rows, in one pass.

    Rows are spread over ``spread`` slices; each slice yields its own top n and
    totals, so the last step handles at most ``spread * n`` rows.
    """
    positive("n", n)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    per_slice = Window.partitionBy("_slice")
    sliced = sliced.withColumn("_rank", F.row_number().over(per_slice.orderBy(*order)))
    for name, value in totals.items():
        sliced = sliced.withColumn(name, value.over(per_slice))
    kept = sliced.where(F.col("_rank") <= n)
    everything = Window.partitionBy()
    for name in totals:
        kept = kept.withColumn(name, F.sum(F.when(F.col("_rank") == 1, F.col(name))).over(everything))
    return kept.drop("_slice", "_rank").orderBy(*order).limit(n)


def gap_statistics(df: DataFrame, keys: Sequence[str], ts: str = "ts", bucket_seconds: float = 900.0) -> DataFrame:
    """Inter-arrival statistics per key: n, first, last, mean, deviation, largest gap.

    Gaps inside a time bucket come from ``lag`` over (key, bucket); gaps between
    buckets from a ``lag`` over one summary row per bucket. A key that owns a
    third of the rows is thus spread over its buckets.
    """
    keys = list(keys)
    pieces = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    inner = (
        df.where(F.col(ts).isNotNull())
        .select(*keys, ts)
        .withColumn("_bucket", epoch_bucket(ts, bucket_seconds))
        .withColumn("_gap", F.col(ts) - F.lag(ts).over(pieces))
        .groupBy(*keys, "_bucket")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
            F.count("_gap").alias("_gaps"),
            F.avg("_gap").alias("_gap_mean"),
            F.var_pop("_gap").alias("_gap_var"),
            F.max("_gap").alias("_gap_max"),
        )
    )
    whole_key = Window.partitionBy(*keys)
    by_bucket = whole_key.orderBy("_bucket")
    mean = (F.max("_last").over(whole_key) - F.min("_first").over(whole_key)) / F.nullif(
        F.sum("_n").over(whole_key) - 1, F.lit(0)
    )
    stitched = (
        inner.withColumn("_between", F.col("_first") - F.lag("_last").over(by_bucket))
        .withColumn("_mean", mean)
        .withColumn(
            "_squares",
            F.coalesce(F.col("_gaps") * (F.col("_gap_var") + F.pow(F.col("_gap_mean") - F.col("_mean"), 2)), F.lit(0.0))
            + F.coalesce(F.pow(F.col("_between") - F.col("_mean"), 2), F.lit(0.0)),
        )
    )
    return stitched.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.min("_first").alias("first_ts"),
        F.max("_last").alias("last_ts"),
        F.max("_mean").alias("mean_gap"),
        F.sqrt(F.sum("_squares") / F.nullif(F.sum("_n") - 1, F.lit(0))).alias("std_gap"),
        F.greatest(F.max("_gap_max"), F.max("_between")).alias("max_gap"),
    )


def value_changes(
    df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", tie: str | None = None, bucket_seconds: float = 900.0
) -> DataFrame:
    """Rows where a key's value differs from its previous one, with both values.

    Changes within a bucket and changes across a bucket edge are found
    separately, so a busy key is spread over its buckets.
    """
    keys = list(keys)
    tie = tie or value
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(ts).alias("ts"), F.col(value).alias("_to"), F.col(tie).alias("_tie")
    )
    rows = rows.withColumn("_bucket", epoch_bucket("ts", bucket_seconds))
    pieces = Window.partitionBy(*keys, "_bucket").orderBy("ts", "_tie")
    inside = rows.withColumn("_from", F.lag("_to").over(pieces)).where(F.col("_from") != F.col("_to"))
    order = F.struct("ts", "_tie")
    edges = rows.groupBy(*keys, "_bucket").agg(
        F.min("ts").alias("ts"), F.min_by("_to", order).alias("_to"), F.max_by("_to", order).alias("_last")
    )
    edges = edges.withColumn("_from", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")))
    edges = edges.where(F.col("_from") != F.col("_to"))
    both = inside.select(*keys, "ts", "_from", "_to").unionByName(edges.select(*keys, "ts", "_from", "_to"))
    return both.select(*keys, "ts", F.col("_from").alias("from_value"), F.col("_to").alias("to_value"))
