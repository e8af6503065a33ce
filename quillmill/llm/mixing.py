"""Mixing sources to target weights along a curriculum, in built-in functions only.

Every source gets a target number of words; its documents, in the order of a hash of their ids,
are read again and again until the target is reached, so each document is taken a whole number of
times but for one per source. When a word comes up is set by the source's weight schedule: the
weight runs from a start to an end value over the training time 0 to 1, its integral is the share
of the target demanded so far, and inverting that share gives a document's position. The mix is
range-sorted by position.

Null and empty texts have size 0 and are never taken; a null source is a source of its own and
ranks last; ties of the hash fall to the id, the text and then to the staged row number, so
repeated rows are rows of their own. Rows without an id are ordered by a hash of their text and row
number, so that they spread like others. An empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Weight at the start and end of training, against the mean, for each entry of WEIGHTS.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
#: No source is read more often than this.
MOST_REPEATS = 3


def size_of(text: Column) -> Column:
    """Number of words."""
    bare = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(bare, common.SPACE + "+", "")).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Add ``weight_no`` and ``target`` to a table of ``source, source_size``.

    Shares above ``MOST_REPEATS`` times a source's size stop there, and the excess is shared again
    by weight until none is above. A round sums what is still open; the sums, one row, come to the
    driver.
    """
    ranked = common.global_rank(sizes, [F.asc_nulls_last("source")], "source_no", "mix-sources")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    most = F.lit(MOST_REPEATS) * F.col("source_size")
    ranked = ranked.withColumn("weight_no", (F.col("source_no") % len(WEIGHTS)).cast("int")).withColumn(
        "weight", F.get(weights, F.col("weight_no")).cast("long")
    )
    level, closed = 0.0, -1
    while True:
        # Rising level: what is closed at one level stays closed at the next.
        is_closed = most.cast("double") < F.lit(level) * F.col("weight")
        total, full, open_weight, now = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(is_closed, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~is_closed, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(is_closed, 1)), F.lit(0)),
        ).first()
        if now == closed or not open_weight:
            break
        level, closed = (total - full) / open_weight, now
    share = F.lit(level) * F.col("weight")
    return ranked.select("source", "source_size", "weight_no", F.least(share, most.cast("double")).alias("target"))


def position(share: Column, weight_no: Column) -> Column:
    """The time at which a source has given ``share`` of its target.

    The schedule ``a + (b - a) t``, scaled to a mean of 1, integrates to a quadratic; this is its
    inverse on 0 to 1.
    """
    a = F.get(F.array(*[F.lit(s[0] * 2 / (s[0] + s[1])) for s in SCHEDULES]), weight_no)
    b = F.get(F.array(*[F.lit(s[1] * 2 / (s[0] + s[1])) for s in SCHEDULES]), weight_no)
    root = F.sqrt(F.greatest(a * a + F.lit(2.0) * (b - a) * share, F.lit(0.0)))
    return F.when(a == b, share / a).otherwise((root - a) / (b - a))


def plan_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """``row, id, size, source_size, target, taken, before, weight_no`` per document; no texts.

    ``before`` counts the words of the source that come earlier in one reading. Running sums are
    taken in slices of the hash order, as many as the root of the row count, and shifted by the
    slices before, so a hot source spreads over many tasks. Runs a few small jobs. ``row_col``
    names a column that numbers the rows; without one they are numbered here.
    """
    text = common.text_of(text_col)
    # Rows without an id are placed by their text and number, or they would all have one place.
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    unnamed = F.concat_ws(" ", F.lit("null"), F.xxhash64(text).cast("string"), row.cast("string"))
    sized = df.select(
        row.alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        size_of(text).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), unnamed)).alias("h"),
        F.xxhash64(text).alias("t"),
    )
    sized = common.staged(sized, "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = common.staged(source_targets(sizes), "mix-targets")
    slices = max(1, math.isqrt(sized.count()))
    # The first 13 hex digits of the hash are a number below 2**52: its scaled value rises with it.
    scaled = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    sliced = sized.withColumn("slice", F.floor(scaled * slices).cast("long"))
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        F.col("source").alias("s_source"),
        F.col("slice").alias("s_slice"),
        F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("shift"),
    )
    inside = (
        Window.partitionBy("source", "slice").orderBy("h", "id", "t", "row").rowsBetween(Window.unboundedPreceding, -1)
    )
    running = sliced.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    per_source = targets.select(F.col("source").alias("t_source"), "source_size", "target", "weight_no")
    return (
        running.join(shifts, (F.col("slice") == F.col("s_slice")) & F.col("source").eqNullSafe(F.col("s_source")))
        .join(per_source, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("before", F.col("within") + F.col("shift"))
        .withColumn("taken", sum([reading(k) for k in range(1, MOST_REPEATS)], reading(0)))
        .select("row", "id", "size", "source_size", "target", "taken", "before", "weight_no")
    )


def reading(k: int) -> Column:
    """Words that reading ``k`` (from 0) of a planned document takes."""
    left = F.floor("target") - F.lit(k) * F.col("source_size") - F.col("before")
    return F.least(F.greatest(left, F.lit(0)), F.col("size")).cast("long")


def reading_position(k: int) -> Column:
    """When reading ``k`` of a planned document begins."""
    share = (F.lit(k) * F.col("source_size") + F.col("before")) / F.floor("target")
    return position(share, F.col("weight_no"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents in training order, one row per reading, with the columns of ``df``.

    A document that is read partly for the last time is emitted if at least half of it is wanted,
    so a source comes within half a document of its target. The input is staged once, to number
    its rows; then the texts travel to their rows of the plan and to their place in the order.
    """
    spark, columns = df.sparkSession, df.columns
    held = common.staged(df, "mix-documents", row="_mix_row")
    plan = plan_mix(held, id_col, text_col, source_col, row_col="_mix_row")
    readings = F.array(
        *[F.when((reading(k) > 0) & (2 * reading(k) >= F.col("size")), reading_position(k)) for k in range(MOST_REPEATS)]
    )
    placed = plan.select(F.col("row").alias("_mix_row"), F.explode(F.array_compact(readings)).alias("_mix_position"))
    return (
        held.join(placed, "_mix_row")
        .repartitionByRange(common.partitions(spark), "_mix_position", "_mix_row")
        .sortWithinPartitions("_mix_position", "_mix_row")
        .select(*columns)
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(common.documents(spark, sf_dir))
    return (
        plan.select(
            F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
            F.when(F.col("taken") > 0, F.round(F.abs(reading_position(0)), 9)).alias("position"),
        )
        .repartitionByRange(common.partitions(spark), F.asc_nulls_last("position"), "doc_id")
        .sortWithinPartitions(F.asc_nulls_last("position"), "doc_id")
    )
