"""What the operators share: reading, staged tables, even id ranges and Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from quillmill.session import materialize

#: The order key of a null id: below every other one.
NULL_ID = -(2**63)
#: The characters that separate words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def per_value(fn: Callable, result: str) -> Callable[..., Column]:
    """A column function from a Python function of one row's values, evaluated in Arrow batches.

    The result counts as non-deterministic, so that Catalyst never evaluates it a second time in
    a filter that it pushes down.
    """
    kind = _parse_datatype_string(result)
    arrow_type = to_arrow_type(kind)

    def one(values: pa.Array) -> pa.Array:
        return pa.array([fn(v) for v in values.to_pylist()], type=arrow_type)

    def two(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(list(map(fn, left.to_pylist(), right.to_pylist())), type=arrow_type)

    batch = two if fn.__code__.co_argcount == 2 else one
    batch.__annotations__ = dict.fromkeys(batch.__annotations__, pa.Array)
    return F.arrow_udf(batch, kind).asNondeterministic()


def staged(df: DataFrame, name: str, row: str | None = None) -> DataFrame:
    """``df`` as a written table in the shared folder, with a unique number per row if ``row``
    names a column for it. The numbers are fixed by the write, so every later read agrees."""
    if row is not None:
        df = df.withColumn(row, F.monotonically_increasing_id())
    return materialize(df, name)


def partitions(spark: SparkSession) -> int:
    """How many partitions the session deals shuffled rows to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_cuts(keys: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` rising values that cut the rows into ranges of like size.

    One row of that length comes to the driver; equal keys never fall into two ranges.
    """
    if parts < 2:
        return []
    fractions = [i / parts for i in range(1, parts)]
    cuts = keys.agg(F.percentile_approx(key, fractions, max(10_000, 20 * parts)).alias("cuts")).first()[0]
    return sorted(set(cuts or []))


def range_of(value: Column, cuts: list) -> Column:
    """How many of the rising ``cuts`` lie below ``value``, by bisection."""
    if not cuts:
        return F.lit(0)
    bits = len(cuts).bit_length()
    listed = F.lit(cuts)
    return F.aggregate(
        F.array(*[F.lit(1 << b) for b in reversed(range(bits))]),
        F.lit(0),
        lambda at, step: F.when(F.get(listed, at + step - 1) < value, at + step).otherwise(at),
    )


def global_rank(df: DataFrame, order: Iterable[Column], rank: str, name: str) -> DataFrame:
    """Add ``rank`` (from 0) in the global order of ``order`` without a one-task window.

    The rows are range-partitioned and staged; each range is numbered in place and shifted by the
    sizes of the ranges before it, of which there are as many as partitions.
    """
    order = list(order)
    spark = df.sparkSession
    ranged = staged(
        df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), name
    )
    sizes = ranged.groupBy("_range").count().collect()
    shift, shifts = 0, []
    for part, size in sorted((r["_range"], r["count"]) for r in sizes):
        shifts += [F.lit(part), F.lit(shift).cast("long")]
        shift += size
    if not shifts:
        return ranged.withColumn(rank, F.lit(0).cast("long")).drop("_range")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    before = F.get(F.map_values(F.map_filter(F.create_map(*shifts), lambda k, v: k == F.col("_range"))), F.lit(0))
    return ranged.withColumn(rank, inside + before).drop("_range")
