"""Importance resampling towards a target: array-scored weights, parallel sorting by regular sampling.

A text's features are its runs of one to three words, each in a bucket by its CRC. The counts of all
buckets, in the corpus and in the target, are arrays of bounded size; a bucket's gain is how much
likelier the target is to hold it. A document's weight is the sum of gains over its features, its
score adds noise that depends on nothing but its id (so the highest scores are a draw without
replacement, in proportion to the weights), and the highest scores get ranks.

Ranks come from parallel sorting by regular sampling. Every task sorts its rows to a run. Rows at
regular distances of each run, sorted, give the splitters. Each run is cut at the splitters and the
parts are exchanged; a segment sorts what it receives, where runs are merged and spill if they have
to. The counts of the segments, summed up, are the ranks their first rows get. Rows past the last
rank that is drawn are never exchanged. The order has no ties (score, then id, then the row itself),
so neither equal scores nor equal ids make a segment large.

Null and empty texts have no features, weight 0 and no rank. A null id draws as the empty id and
comes after the others in a tie; rows that repeat an id are ranked one by one, in the order of the
table. Only the columns that are named are read. An empty table gives an empty result, and an empty
target only counts the smoothing.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillmill.llm import common

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
#: Rows of a segment, at most about; and how many regular samples stand for a segment's rows.
SEGMENT_ROWS = 1_000_000
SAMPLES = 8
#: Bytes of a text that are cut into words at a time.
CHUNK_BYTES = 1 << 20
#: A-Z to lower case; every other ASCII character but digits and letters to a space.
_PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _word_blocks(text: str) -> Iterator[list[bytes]]:
    """The words in order, in blocks of bounded size."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + CHUNK_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def feature_buckets(text: str, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Per block of words how many there are, and the buckets of the features that end in it."""
    held: list[bytes] = []
    for block in _word_blocks(text):
        words = held + block
        new = len(block)
        spaced = [b" " + word for word in words]
        # A CRC goes on from the one of the words before.
        sums = list(map(crc32, words))
        ending = [sums[len(words) - new :]]
        for size in range(2, LONGEST_RUN + 1):
            sums = list(map(crc32, spaced[size - 1 :], sums))
            ending.append(sums[max(0, len(sums) - new) :])
        held = words[1 - LONGEST_RUN :]
        yield new, np.array([s for part in ending for s in part], np.uint32) % np.uint32(buckets)


def _counted(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, found in feature_buckets(text, buckets):
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; a task sends one row per bucket, the driver gets as many."""
    counted = texts.select(common.text_of(text_col).alias("text")).mapInArrow(_counted(buckets), "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier the target is to hold each bucket, add-one smoothed."""
    buckets = len(corpus)
    s_all, t_all = float(int(corpus.sum()) + buckets), float(int(target.sum()) + buckets)
    ratio = [((t + 1.0) * s_all) / ((s + 1.0) * t_all) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weigher(gain: np.ndarray) -> Callable[..., Column]:
    def weigh(text: str) -> dict:
        words = features = weight = 0
        for n, found in feature_buckets(text, len(gain)):
            words += n
            features += len(found)
            weight += int(gain[found].sum())
        return {"n_words": words, "n_features": features, "weight": weight}

    return common.per_value(weigh, "n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(
    docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text_col: str, seed: int
) -> DataFrame:
    """``id, n_words, n_features, weight, score`` per document."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    weighed = docs.select(F.col(id_col).alias("id"), _weigher(gain)(common.text_of(text_col)).alias("w")).select("id", "w.*")
    return weighed.withColumn("score", F.col("weight") + noise("id", seed))


#: The order of the ranks, as rising numbers.
_KEY = ["_score", "_null", "_id", "_row"]


def _keyed(df: DataFrame) -> DataFrame:
    number = F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long"))
    return df.select("*", (-F.col("score")).alias("_score"), F.col("id").isNull().cast("int").alias("_null"), number.alias("_id"))


def _segments(cuts: list[tuple]) -> Callable:
    """Adds to each batch how many of the rising cuts lie below each key."""
    scores = np.array([cut[0] for cut in cuts], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in _KEY]
            low, high = np.searchsorted(scores, key[0], "left"), np.searchsorted(scores, key[0], "right")
            for i in np.flatnonzero(low < high).tolist():
                low[i] = bisect_left(cuts, tuple(int(part[i]) for part in key), low[i], high[i])
            yield batch.append_column("segment", pa.array(low.astype(np.int32)))

    return run


def _ranked(before: list[int]) -> Callable:
    """Numbers the rows of each segment, which arrive in order, from where the ones before it end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, int] = {}
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            ranks = np.empty(len(segment), np.int64)
            for part in np.unique(segment).tolist():
                own = np.flatnonzero(segment == part)
                start = reached.get(part, before[part])
                ranks[own] = start + 1 + np.arange(len(own))
                reached[part] = start + len(own)
            yield batch.drop_columns(["rank"]).append_column("rank", pa.array(ranks))

    return run


def rank_highest(df: DataFrame, drawn: int) -> DataFrame:
    """``df`` with ``rank``: 1, 2, 3... of the ``drawn`` first of its rows with ``eligible``, in the order of
    falling ``score``, then rising ``id``. Others have none."""
    spark = df.sparkSession
    columns = df.columns
    no_rank = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return df.select("*", no_rank)
    numbered = _keyed(df).withColumn("_row", F.monotonically_increasing_id())
    runs = numbered.sortWithinPartitions(F.desc("eligible"), *_KEY).withColumn("_place", F.monotonically_increasing_id())
    runs = common.staged(runs, "sorted-runs")
    wanted = min(SEGMENT_ROWS, -(-drawn // common.partitions(spark)))
    step = max(1, wanted // SAMPLES)
    # The distance is regular inside a run; where a run starts depends on the run, so that short ones count too.
    run, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(2**33 - 1)
    regular = runs.where(F.col("eligible") & (F.pmod(place + F.pmod(F.xxhash64(run), F.lit(step)), F.lit(step)) == 0))
    sample = regular.select(*_KEY).toPandas()  # about SAMPLES rows a segment
    sample = sample.iloc[np.lexsort([sample[name] for name in reversed(_KEY)])]
    # Segments of the first rows only: the last one is open and holds all others.
    last = min(len(sample), 2 * SAMPLES + -(-(drawn + drawn // 8) // step))
    cuts = [tuple(map(int, row)) for row in sample.iloc[SAMPLES - 1 : last : SAMPLES].itertuples(index=False)]
    kept = [*columns, *_KEY]
    schema = runs.select(*kept).schema.add("segment", IntegerType())
    placed = common.staged(runs.select(*kept).mapInArrow(_segments(cuts), schema), "sorted-parts")
    counts = dict(placed.where("eligible").groupBy("segment").count().collect())
    before, total, used = [], 0, 0
    for segment in range(len(cuts) + 1):
        before.append(total)
        used += total < drawn
        total += counts.get(segment, 0)
    first = F.col("eligible") & (F.col("segment") < used)
    exchanged = placed.where(first).repartitionById(used, F.col("segment")).sortWithinPartitions("segment", *_KEY)
    ranked = exchanged.select(*columns, "segment", no_rank)
    ranked = ranked.mapInArrow(_ranked(before), ranked.schema).select(
        *columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    )
    return ranked.unionByName(placed.where(~first).select(*columns, no_rank))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs`` its id, ``n_words, n_features, weight, score`` and ``rank``, which those in the
    drawn share of the documents with at least ``least_words`` words have."""
    found = scored(docs, target, id_col, text_col, target_text_col, seed)
    found = common.staged(found.withColumn("eligible", F.col("n_words") >= least_words), "scored")
    rows = found.where("eligible").count()
    ranked = rank_highest(found, share[0] * rows // share[1])
    return ranked.drop("eligible").withColumnRenamed("id", id_col)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
