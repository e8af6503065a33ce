"""Exact ranks, exact-count choices and prefix sums that never order a whole table in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import materialize

# A side is broadcast only if the caller can prove it has at most this many rows.
BROADCAST_ROWS = 10_000


def broadcast_if(df: DataFrame, proven_rows: int | None) -> DataFrame:
    """Broadcast ``df`` if ``proven_rows`` bounds it; otherwise leave the choice to AQE."""
    if proven_rows is not None and proven_rows <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def distinct_bound(df: DataFrame, *columns: str) -> int | None:
    """The number of distinct values, measured, if it is small enough to broadcast; else None.

    Reads only these columns; each task sends its distinct values.
    """
    found = df.select(*columns).distinct().limit(BROADCAST_ROWS + 1).count()
    return found if found <= BROADCAST_ROWS else None


def hash_key(ids: Sequence[str], seed: int) -> Column:
    """A repeatable pseudo-random sort key; md5 of text has one value in every engine."""
    return F.md5(F.concat_ws("\x01", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def lowest_hash_cut(
    df: DataFrame,
    ids: Sequence[str],
    want: Callable[[Column], Column],
    seed: int = 42,
    digits: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The last key, in hash order, of an exact-count choice.

    Returns two one-row tables: the cut ``struct(hash, ids...)`` below which exactly
    ``want(total)`` rows lie, and the total. A histogram over ``16**digits`` hash prefixes finds
    the prefix that holds the cut; only that prefix's rows are ever ordered. ``ids`` must be
    unique, so no prefix can be hot.
    """
    key = df.select(hash_key(ids, seed).alias("h"), *ids)
    prefix = F.substring("h", 1, digits)
    counts = key.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # At most 16**digits rows reach this window.
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    edge = (
        counts.select(
            "prefix",
            (F.sum("n").over(upto) - F.col("n")).alias("before"),
            "n",
            F.sum("n").over(everything).alias("total"),
        )
        .withColumn("want", want(F.col("total")).cast("long"))
        .where((F.col("before") < F.col("want")) & (F.col("before") + F.col("n") >= F.col("want")))
        .select("prefix", (F.col("want") - F.col("before")).alias("need"))
    )
    # One row by construction: the prefix ranges do not overlap.
    in_edge = key.withColumn("prefix", prefix).join(F.broadcast(edge), "prefix")
    order = Window.partitionBy("prefix").orderBy("h", *ids)
    cut = (
        in_edge.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == F.col("need"))
        .select(F.struct("h", *ids).alias("cut"))
    )
    return cut, total


def at_or_below_cut(cut: DataFrame, ids: Sequence[str], seed: int = 42) -> Column:
    """True for the rows chosen by :func:`lowest_hash_cut`."""
    own = F.struct(hash_key(ids, seed).alias("h"), *[F.col(c) for c in ids])
    return F.coalesce(own <= cut.scalar(), F.lit(False))


def has_long_key(df: DataFrame, keys: Sequence[str], width: int) -> bool:
    """Whether a key has more than ``width`` rows. Runs a job that reads the key columns only."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] > width


def two_level_rank(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    width: int = 100_000,
    rank: str = "rank",
    total: str = "total",
) -> DataFrame:
    """Add ``rank`` (from 1, by ``position`` within ``keys``) and ``total``.

    Where a key has more than ``width`` rows, the table is range-partitioned by key and position
    and written; rows are numbered inside each range and shifted by the counts of the key's ranges
    before it. Ranges are even whatever the keys and positions are: sparse, dense or tied. Runs
    the jobs that measure the keys and write the ranges.
    """
    whole = Window.partitionBy(*keys)
    if not has_long_key(df, keys, width):
        number = F.row_number().over(whole.orderBy(position)).cast("long")
        return df.withColumns({rank: number, total: F.count(F.lit(1)).over(whole)})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(parts, *keys, position).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per key and range.
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_key_range"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(total),
    )
    same = F.col("_range") == F.col("_key_range")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(position))
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, same)
        .withColumn(rank, F.col("_inside") + F.col("_before"))
        .select(*df.columns, rank, total)
    )


def cuts_below(cuts: Column, value: Column, bits: int) -> Column:
    """How many of ``2**bits - 1`` sorted cuts lie below ``value``, by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at),
    )


def running_counts(
    counts: DataFrame,
    keys: Sequence[str],
    score: str,
    values: Sequence[str],
    slice_rows: int = 1_000_000,
) -> DataFrame:
    """Inclusive sums ``upto_*`` of ``values`` over descending ``score`` within ``keys``, their ``total_*``
    per key, and the ``_slice`` a row was summed in, rising in that order.

    ``counts`` holds one row per (keys, score); it is range-partitioned by them and written, once.
    There are as many ranges as it takes for about ``slice_rows`` rows each, whatever the keys and
    scores are; sums run inside a range and are shifted by the totals of the key's ranges before it. A
    table of no more than ``slice_rows`` rows is summed as it is.
    """
    spark, rows = counts.sparkSession, counts.count()
    if rows <= slice_rows:
        every, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc(score))
        upto = upto.rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns(
            {"_slice": F.lit(0)}
            | {f"total_{v}": F.sum(v).over(every) for v in values}
            | {f"upto_{v}": F.sum(v).over(upto) for v in values}
        )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // slice_rows))
    ranged = counts.repartitionByRange(parts, *keys, F.desc(score)).withColumn("_slice", F.spark_partition_id())
    ranged = materialize(ranged, "score-ranges")
    groups = [*keys, "_slice"]
    whole = Window.partitionBy(*keys)
    above = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per range, and one more per key.
    totals = ranged.groupBy(*groups).agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select(
        *groups,
        *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"_above_{v}") for v in values],
        *[F.sum(v).over(whole).alias(f"total_{v}") for v in values],
    )
    inside = Window.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumns({f"_in_{v}": F.sum(v).over(inside) for v in values})
        .join(offsets, groups)
        .select(
            *counts.columns,
            "_slice",
            *[F.col(f"total_{v}") for v in values],
            *[(F.col(f"_in_{v}") + F.col(f"_above_{v}")).alias(f"upto_{v}") for v in values],
        )
    )


def slices_with_carry(
    df: DataFrame, key: str, position: str, carry: int, width: int = 100_000
) -> DataFrame:
    """Cut each key into slices of ``width`` rows for windows that look back ``carry`` rows.

    Adds ``_slice`` and ``_carried``. Every slice after a key's first also receives, marked as
    carried, the ``carry`` rows before it, so a window over (key, _slice) sees what a window over
    the key would, and a key of any length is spread over many tasks. Slices go by rank, so a row
    knows by itself whether the next slice needs it. Runs the jobs of :func:`two_level_rank`.
    """
    width = max(width, carry, 1)
    if not has_long_key(df, [key], width):
        return df.withColumns({"_slice": F.lit(0).cast("long"), "_carried": F.lit(False)})
    ranked = two_level_rank(df, [key], position, width, "_rank", "_total")
    own = F.floor((F.col("_rank") - 1) / width)
    last = (own + 1) * width
    needed = (F.col("_rank") > last - carry) & (F.col("_total") > last)
    copies = F.when(needed, F.array(own, own + 1)).otherwise(F.array(own))
    return ranked.select(*df.columns, F.posexplode(copies).alias("_copy", "_slice")).select(
        *df.columns, "_slice", (F.col("_copy") == 1).alias("_carried")
    )
