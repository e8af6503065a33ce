"""Streaming forms of the log monitor and of corpus preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.corpus import filter_pairs, synthesize_qa
from quillmill.operators.runs import log_signals
from quillmill.session import materialize


def log_health_stream(
    logs: DataFrame, window: str = "1 hour", delay: str = "10 minutes", run: str = "run_id", ts: str = "ts", msg: str = "msg"
) -> DataFrame:
    """OOM and NaN flags and loss figures per run and tumbling window of event time.

    Rows later than ``delay`` are dropped. State is one small row per open (window, run), and
    partial aggregation keeps a chatty run from becoming a hot key.
    """
    signals = logs.withWatermark(ts, delay).select(F.col(ts), F.col(run), *log_signals(F.col(msg)))
    return (
        signals.groupBy(F.window(ts, window), F.col(run))
        .agg(
            F.bool_or("oom").alias("oom_detected"),
            F.bool_or("nan").alias("nan_loss_detected"),
            F.count("loss").alias("losses"),
            F.avg("loss").alias("mean_loss"),
            F.count(F.lit(1)).alias("lines"),
        )
        .select(
            run,
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "oom_detected",
            "nan_loss_detected",
            "losses",
            "mean_loss",
            "lines",
        )
    )


def incremental_prepare(
    documents: DataFrame,
    id_col: str,
    ts: str,
    delay: str = "1 day",
    ratio: float = 0.1,
    goal: str = "",
    salts: int = 16,
) -> DataFrame:
    """Arriving texts as filtered, deduplicated pairs with a threshold split.

    Exact split sizes need the whole corpus, so a stream assigns each pair by its hash; equal
    pairs always land on the same side. Copies are dropped within ``delay`` of arrival, first
    inside ``salts`` parts and then across them, so a pair that floods the stream is spread
    before its copies meet. State holds a digest per pair, not its text.
    """
    stamped = documents.withWatermark(ts, delay)
    pairs = filter_pairs(synthesize_qa(stamped, id_col, goal, keep=[ts]))
    digest = F.sha2(F.concat_ws("\x01", "instruction", "output"), 256)
    part = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") / F.lit(float(16**8))
    keyed = pairs.withColumns({"digest": digest, "salt": F.pmod(F.xxhash64(id_col, "chunk"), F.lit(salts))})
    return (
        keyed.dropDuplicatesWithinWatermark(["digest", "salt"])
        .dropDuplicatesWithinWatermark(["digest"])
        .withColumn("split", F.when(part < ratio, "eval").otherwise("train"))
        .drop("digest", "salt")
    )


#: Batches of a ledger that lie beside each other before their digests are written as one.
LEDGER_BATCHES = 64


def _numbers(batch: DataFrame, folder: str, kind: str) -> list[int]:
    """The numbers of a ledger's complete parts of one kind."""
    context = batch.sparkSession.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(context._jsc.hadoopConfiguration())
    parts = store.globStatus(context._jvm.org.apache.hadoop.fs.Path(top, f"{kind}=*/_SUCCESS")) if store.exists(top) else []
    return sorted(int(part.getPath().getParent().getName().split("=")[1]) for part in parts)


def _seen(batch: DataFrame, batch_id: int, ledger: str) -> DataFrame:
    """``prefix, digest`` of all that batches before this one have brought: the newest base, and the
    batches that followed it."""
    base = max((n for n in _numbers(batch, ledger, "base") if n <= batch_id), default=None)
    later = [n for n in _numbers(batch, ledger, "batch") if (base is None or n >= base) and n < batch_id]
    parts = [f"{ledger}/base={base}"] * (base is not None) + [f"{ledger}/batch={n}" for n in later]
    spark, fields = batch.sparkSession, "digest string, prefix string"
    read = [spark.read.schema(fields).parquet(part) for part in parts]
    seen = spark.createDataFrame([], fields)
    for part in read:
        seen = seen.unionByName(part)
    return seen


def add_first_arrivals(
    batch: DataFrame, batch_id: int, path: str, ledger: str, keys: Sequence[str], order_by: Sequence[str]
) -> None:
    """Write the rows of a batch whose ``keys`` no earlier batch has brought to ``path``, and their
    digests to the ledger; among equal ones in the batch the first by ``order_by``.

    Only batches before this one count and a batch writes its own folders, so running it again, also
    after a crash at any point, leaves the same rows. The ledger is partitioned by the first two hex
    digits of the digests: a small batch reads the partitions it touches. Every LEDGER_BATCHES batches
    its parts are written as one; the parts it replaces are left for the owner of the folder.
    """
    told = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    keyed = batch.withColumn("digest", told).withColumn("prefix", F.left("digest", F.lit(2)))
    first = F.row_number().over(Window.partitionBy("digest").orderBy(*order_by))
    # Spark prunes to the first row of each window in every map task.
    firsts = materialize(keyed.withColumn("_no", first).where("_no = 1").drop("_no"), "arrivals")
    seen = _seen(batch, batch_id, ledger)
    if batch_id and batch_id % LEDGER_BATCHES == 0 and batch_id not in _numbers(batch, ledger, "base"):
        seen.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{ledger}/base={batch_id}")
        seen = _seen(batch, batch_id, ledger)
    touched = [r[0] for r in firsts.select("prefix").distinct().collect()]  # at most 256
    if len(touched) < 256:
        seen = seen.where(F.col("prefix").isin(touched))
    fresh = materialize(firsts.join(seen.select("digest"), "digest", "left_anti"), "first-arrivals")
    fresh.drop("digest", "prefix").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    fresh.select("digest", "prefix").repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{ledger}/batch={batch_id}")


def keep_first_arrivals(
    stream: DataFrame, path: str, ledger: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str]
) -> None:
    """Process all data that is there now: of rows with equal ``keys``, in whatever batch they arrive,
    ``path`` gets the first. Exact without a limit on lateness, unlike a watermark; the ledger grows by
    a digest per distinct row."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, n: add_first_arrivals(batch, n, path, ledger, keys, order_by))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def arriving_pairs(documents: DataFrame, id_col: str, goal: str = "") -> DataFrame:
    """Arriving texts as filtered pairs, for :func:`keep_first_arrivals`; row-local."""
    return filter_pairs(synthesize_qa(documents, id_col, goal))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all data that is there now into Parquet files at ``path``, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
