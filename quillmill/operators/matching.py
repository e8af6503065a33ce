"""Answers per requirement level of a catalog of any size.

The items that fit a level are those that need no more than it: a prefix of the catalog in the order
of need. The largest and smallest of a prefix are running extremes. Its middle one by size is found
by counts: the catalog is cut into slices by need and into buckets by size, both of about the root of
its rows. A table of counts says how many items of each bucket lie before each slice, so a slice
knows in which bucket the middle of each of its levels lies, and which one there; and the bucket then
finds it among its own items. No task sees more than a slice, a bucket, or a row per slice.
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.ranking import two_level_rank
from quillmill.session import materialize

#: Least rows of a slice and of a bucket.
LEAST_ROWS = 1_000


def _buckets_of_middles(table: pa.Table) -> pa.Table:
    """For each level of a slice: the bucket its middle item is in, and its place in that bucket."""
    rows = table.sort_by("n").to_pylist()
    counts = np.zeros(1 + max(r["bucket"] for r in rows), np.int64)
    out = []
    for row in rows:
        counts[row["bucket"]] += row["before"]
        if row["n"] < 0:
            continue
        counts[row["bucket"]] += 1
        if row["ends"]:
            upto = np.cumsum(counts)
            middle = row["n"] // 2
            bucket = int(np.searchsorted(upto, middle, side="right"))
            out.append({"q_on": row["on"], "q_bucket": bucket, "upto": row["n"], "place": middle - int(upto[bucket - 1] if bucket else 0)})
    fields = [("q_on", pa.string()), ("q_bucket", pa.int64()), ("upto", pa.int64()), ("place", pa.int64())]
    return pa.Table.from_pylist(out, schema=pa.schema(fields))


def _middles(table: pa.Table) -> pa.Table:
    """For each level whose middle item is in a bucket: the size rank of that item."""
    sizes: list[int] = []
    out = []
    for row in table.sort_by([("n", "ascending"), ("place", "ascending")]).to_pylist():
        if row["place"] is None or row["place"] < 0:
            insort(sizes, row["rank"])
        else:
            out.append({"m_on": row["on"], "m_upto": row["n"], "m_rank": sizes[row["place"]]})
    fields = [("m_on", pa.string()), ("m_upto", pa.int64()), ("m_rank", pa.int64())]
    return pa.Table.from_pylist(out, schema=pa.schema(fields))


def deal_levels(held: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The items of each bucket, and the levels that ask for one of them, in pieces of at most twice
    ``width`` levels with all items of the bucket.

    The middle items of most levels are close to each other, so a few buckets are asked by nearly all.
    There are no more pieces than ``width`` goes into the levels, and one per bucket.
    """
    asked = asked.withColumn("slice", F.floor((F.col("n") - 1) / width).cast("long"))
    counts = asked.groupBy("on", "bucket", "slice").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("on", "bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    pieces = counts.withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / width).cast("long")).drop("c")
    last = pieces.groupBy("on", "bucket").agg(F.max("piece").alias("last"))
    # A row per bucket that is asked: about the root of the catalog.
    every = held.join(F.broadcast(last), ["on", "bucket"])
    every = every.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    columns = ["on", "bucket", "piece", "n", "rank", "place"]
    return every.select(*columns).unionByName(asked.join(pieces, ["on", "bucket", "slice"]).select(*columns))


def level_answers(offers: DataFrame) -> DataFrame:
    """``on, need, largest, smallest, middle`` per requirement level of ``offers(on, id, need, size,
    position)``, by the rules of the small catalog."""
    low = F.when(F.col("size").isNull() | F.isnan("size"), 0.0).otherwise(F.col("size"))
    high = F.when(F.col("size").isNull() | F.isnan("size"), 999.0).otherwise(F.col("size"))
    items = offers.select(
        "on",
        "need",
        F.struct(low.alias("size"), "position", "id").alias("by_size"),
        F.struct(F.col("need"), "position", "id").alias("by_need"),
        F.struct(low.alias("size"), (-F.col("position")).alias("position"), "id").alias("large"),
        F.struct(high.alias("size"), "position", "id").alias("small"),
    )
    items = materialize(items, "offers")
    width = max(LEAST_ROWS, math.isqrt(max(1, items.count())))
    ranked = two_level_rank(items, ["on"], "by_size", rank="rank", total="_t").drop("_t")
    ranked = two_level_rank(ranked, ["on"], "by_need", rank="n", total="_t").drop("_t")
    cut = lambda c: F.floor((F.col(c) - 1) / width).cast("long")
    ends = F.col("n") == F.max("n").over(Window.partitionBy("on", "need"))
    placed = materialize(ranked.withColumns({"slice": cut("n"), "bucket": cut("rank"), "ends": ends}), "offers-placed")

    # Running extremes: inside a slice, and over the slices before it.
    along = Window.partitionBy("on", "slice").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("on").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy("on", "slice").agg(F.max("large").alias("l"), F.min("small").alias("s"))
    tops = tops.select("on", "slice", F.max("l").over(earlier).alias("l"), F.min("s").over(earlier).alias("s"))
    extremes = (
        placed.select("on", "slice", "need", "n", "ends", F.max("large").over(along).alias("large"), F.min("small").over(along).alias("small"))
        .where("ends")
        .join(tops, ["on", "slice"])
        .select("on", "need", "n", F.greatest("large", "l")["id"].alias("largest"), F.least("small", "s")["id"].alias("smallest"))
    )

    # How many items of each bucket lie before each slice, and in it: about as many rows as items.
    cells = placed.groupBy("on", "slice", "bucket").agg(F.count(F.lit(1)).alias("c"))
    last = placed.groupBy("on").agg(F.max("slice").alias("slices"), F.max("bucket").alias("buckets"))
    grid = last.select("on", "buckets", F.explode(F.sequence(F.lit(0).cast("long"), "slices")).alias("slice"))
    grid = grid.select("on", "slice", F.explode(F.sequence(F.lit(0).cast("long"), "buckets")).alias("bucket"))
    counted = grid.join(cells, ["on", "slice", "bucket"], "left")
    down = Window.partitionBy("on", "bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(down), F.lit(0))
    heads = counted.select("on", "slice", F.lit(-1).cast("long").alias("n"), "bucket", before.alias("before"), F.lit(False).alias("ends"))
    own = placed.select("on", "slice", F.col("n").cast("long").alias("n"), "bucket", F.lit(0).cast("long").alias("before"), "ends")
    asked = heads.unionByName(own).groupBy("on", "slice").applyInArrow(
        _buckets_of_middles, "q_on string, q_bucket long, upto long, place long"
    )
    asked = asked.select(
        F.col("q_on").alias("on"), F.col("q_bucket").alias("bucket"), F.col("upto").alias("n"), F.lit(None).cast("long").alias("rank"), "place"
    )
    held = placed.select("on", "bucket", F.col("n").cast("long").alias("n"), F.col("rank").cast("long").alias("rank"), F.lit(-1).cast("long").alias("place"))
    dealt = deal_levels(held, materialize(asked, "levels-asked"), width)
    middles = dealt.groupBy("on", "bucket", "piece").applyInArrow(_middles, "m_on string, m_upto long, m_rank long")
    names = placed.select(F.col("on").alias("i_on"), F.col("rank").alias("i_rank"), F.col("by_size.id").alias("middle"))
    found = middles.join(names, (F.col("m_on") == F.col("i_on")) & (F.col("m_rank") == F.col("i_rank")))
    return extremes.join(found, (F.col("on") == F.col("m_on")) & (F.col("n") == F.col("m_upto"))).select(
        "on", "need", "largest", "smallest", "middle"
    )


def as_of(levels: DataFrame, values: DataFrame, at: str, answer: str) -> DataFrame:
    """``at, answer`` for each of the distinct ``values``: the answer of the highest level at or below it.

    Both are range-partitioned together; a range that begins between levels takes the last answer of
    the ranges before it, of which there is a row each.
    """
    spark = levels.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast(levels.schema[answer].dataType)
    both = levels.select(at, F.lit(0).alias("_kind"), answer).unionByName(
        values.select(at).distinct().select(at, F.lit(1).alias("_kind"), none.alias(answer))
    )
    ranged = materialize(both.repartitionByRange(parts, at, "_kind").withColumn("_range", F.spark_partition_id()), "levels")
    tops = ranged.where("_kind = 0").groupBy("_range").agg(F.max_by(answer, at).alias("_top"))
    every = ranged.select("_range").distinct().join(tops, "_range", "left")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_range", F.last("_top", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy(at, "_kind")
    seen = ranged.withColumn(answer, F.last(answer, ignorenulls=True).over(inside)).join(carried, "_range")
    return seen.where("_kind = 1").select(at, F.coalesce(answer, "_carried").alias(answer))
