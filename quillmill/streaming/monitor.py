"""The log monitor as a stateful stream: first events and the trend of every run that has ended.

A run's state is its flags with their first messages, and a list of its losses with their line numbers.
A batch appends to the list and leaves what lies there in the state store, so that a batch and the end
of a run take a few calls of the store each, however far apart a run's lines lie. Whether the trend
improves depends on the halves of the losses in line order, and where the middle lies is known only when
the run has ended: a timer then reads the list, sixteen bytes per loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmill.operators.runs import line_signals
from quillmill.streaming.jobs import run_available

#: Losses of an entry of the list, at most.
BLOCK_LINES = 1_000
REPORT = (
    "run_id long, oom_detected boolean, nan_loss_detected boolean, oom_event string, nan_event string,"
    " losses long, first_half double, second_half double, trend string"
)


class RunMonitor(StatefulProcessor):
    """Gathers the lines of a run and reports on it once no line has come for ``quiet_ms`` of event time."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        first = "oom_seq long, oom_head string, nan_seq long, nan_head string, until long"
        self.facts = handle.getValueState("facts", first)
        self.losses = handle.getListState("losses", "seqs array<long>, losses array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.facts.get() if self.facts.exists() else (None, None, None, None, None)
        oom, nan, before = list(kept[0:2]), list(kept[2:4]), kept[4]
        until, entries = before, []
        for batch in rows:
            seq, loss = batch["seq"].to_numpy(), batch["loss"].to_numpy(dtype=float)
            for found, hit in ((oom, "oom"), (nan, "nan")):
                lines = np.flatnonzero(batch[hit].to_numpy(dtype=bool))
                if len(lines):
                    line = int(lines[seq[lines].argmin()])
                    if found[0] is None or seq[line] < found[0]:
                        found[:] = int(seq[line]), str(batch["head"].iloc[line])
            last = int(batch["ts_ms"].max()) + self.quiet_ms
            until = last if until is None else max(until, last)
            lost = ~np.isnan(loss) & ~pd.isna(seq)
            seq, loss = seq[lost].astype(np.int64), loss[lost]
            for at in range(0, len(seq), BLOCK_LINES):
                entries.append((seq[at : at + BLOCK_LINES].tolist(), loss[at : at + BLOCK_LINES].tolist()))
        if entries:
            self.losses.appendList(entries)
        # One timer per run: it moves with the last line.
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        if kept != (*oom, *nan, until):
            self.facts.update((*oom, *nan, until))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        facts = self.facts.get()
        entries = [(np.array(s, np.int64), np.array(v, float)) for s, v in self.losses.get()]
        seqs, losses = (np.concatenate([e[i] for e in entries] or [np.array([])]) for i in (0, 1))
        losses = losses[np.lexsort((losses, seqs))]
        total = len(losses)
        half = total // 2
        first, second = float(losses[:half].sum()), float(losses[half:].sum())
        means = (first / half if half else None, second / (total - half) if total else None)
        trend = None
        if total:
            trend = "unknown"
            if total >= 4:
                change = means[1] - means[0]
                trend = "improving" if change < -0.05 else "diverging" if change > 0.10 else "stable"
        row = {
            "run_id": key[0],
            "oom_detected": facts[0] is not None,
            "nan_loss_detected": facts[2] is not None,
            "oom_event": None if facts[0] is None else "OOM: " + facts[1],
            "nan_event": None if facts[2] is None else "NaN: " + facts[3],
            "losses": total,
            "first_half": means[0],
            "second_half": means[1],
            "trend": trend,
        }
        self.facts.clear()
        self.losses.clear()
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


def monitor_runs(
    logs: DataFrame, quiet: str = "1 hour", delay: str = "10 minutes", run: str = "run_id", ts: str = "ts", seq: str = "seq", msg: str = "msg"
) -> DataFrame:
    """A row per ended run of a log stream: flags, first messages and the trend of its losses, equal to
    those of the closed log. A run has ended when its last line is ``quiet`` behind the watermark; lines
    that come later begin it anew. Needs the RocksDB state store."""
    stamped = logs.withWatermark(ts, delay)
    signals = line_signals(stamped.withColumn("_ms", F.unix_millis(F.col(ts))), run, seq, msg, keep=[ts, "_ms"])
    rows = signals.select(F.col(run).cast("long").alias("run_id"), "seq", "oom", "nan", "loss", "head", ts, F.col("_ms").alias("ts_ms"))
    quiet_ms = int(logs.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {quiet})").first()[0])
    return rows.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunMonitor(quiet_ms), outputStructType=REPORT, outputMode="Append", timeMode="EventTime"
    )


def run_monitor(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all data that is there now of a stream of :func:`monitor_runs`, with the state store it needs."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run_available(stream, path, checkpoint)
    finally:
        spark.conf.set(name, before)
