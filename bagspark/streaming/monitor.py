"""Monitors over journal and metric streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bagspark.operators.history import line_slopes


def stream_journal_rates(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Slides, failures, patches and patches per second per (shard, tumbling window).

    ``ts`` must be a TIMESTAMP; rows later than the watermark are dropped.
    """
    per = stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "shard").agg(
        F.count_if("ok").alias("done"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_patches"))), F.lit(0)).alias("patches"),
    )
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return per.select(
        F.col("window.start").alias("window_start"), "shard", "done", "failed", "patches",
        (F.col("patches") / seconds).alias("patches_per_sec"),
    )


COUNTS = "shard bigint, done bigint, failed bigint, units bigint, finished boolean"


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shrink journal rows to one row of counts per shard and batch, ahead of the state shuffle."""
    for rows in batches:
        if len(rows):
            ok = rows["ok"].astype(bool)
            yield (
                rows.assign(done=ok.astype("int64"), failed=(~ok).astype("int64"), units=rows["n_patches"].where(ok, 0).astype("int64"))
                .groupby("shard", as_index=False)
                .agg(done=("done", "sum"), failed=("failed", "sum"), units=("units", "sum"), finished=("finished", "max"))
            )


def notifications(stream: DataFrame, every: int = 25) -> DataFrame:
    """(shard, kind, at, done, failed, units): one row whenever a shard's successes pass a multiple of
    ``every``, and one when a row says ``finished``."""

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, failed, units = state.get if state.exists else (0, 0, 0)
        before, finished = done, False
        for part in parts:
            done += int(part["done"].sum())
            failed += int(part["failed"].sum())
            units += int(part["units"].sum())
            finished = finished or bool(part["finished"].any())
        state.update((done, failed, units))
        marks = list(range((before // every + 1) * every, done + 1, every))
        rows = [(key[0], "progress", m, done, failed, units) for m in marks]
        if finished:
            rows.append((key[0], "finished", done, done, failed, units))
        yield pd.DataFrame(rows, columns=["shard", "kind", "at", "done", "failed", "units"])

    if "finished" not in stream.columns:
        stream = stream.withColumn("finished", F.lit(False))
    partial = stream.select("shard", "ok", "n_patches", "finished").mapInPandas(_partial_counts, COUNTS)
    return partial.groupBy("shard").applyInPandasWithState(
        count,
        "shard bigint, kind string, at bigint, done bigint, failed bigint, units bigint",
        "done bigint, failed bigint, units bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def stream_notify(
    stream: DataFrame, sink: Callable[[str], None], checkpoint: str, every: int = 25
) -> StreamingQuery:
    """Send each notification to ``sink`` from the executors; a failing sink never stops the run."""

    def send(rows: Iterator) -> None:
        for r in rows:
            try:
                word = "FINISHED " if r["kind"] == "finished" else ""
                sink(f"{word}[shard {r['shard']}] {r['at']} done, {r['failed']} failed, {r['units']} patches")
            except Exception:  # noqa: BLE001 - notifications are best effort
                pass

    return (
        notifications(stream, every)
        .writeStream.foreachBatch(lambda batch, _id: batch.foreachPartition(send))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


DECISIONS = (
    "run bigint, fold bigint, epoch bigint, improved boolean, best double, best_epoch bigint, smoothed double, "
    "slope double, num_bad bigint, stop boolean, reason string"
)
STOP_STATE = (
    "raw array<double>, smoothed array<double>, seen bigint, best double, best_epoch bigint, "
    "best_smoothed double, num_bad bigint, last_epoch bigint"
)


def stream_early_stop(
    stream: DataFrame,
    patience: int = 20,
    min_delta: float = 0.002,
    mode: str = "max",
    smooth_window: int = 5,
    plateau_window: int = 10,
    plateau_slope_below: float | None = 0.001,
    min_epochs: int = 20,
) -> DataFrame:
    """One stop decision per (run, fold, epoch, metric) event, with the rules of the batch operator.

    The state keeps the tails that the median and the slope need, the bests and the streak. Events
    of one micro-batch are put in epoch order; epochs not after the last one seen are dropped.
    """
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    sign = 1.0 if mode == "max" else -1.0
    width, tail, slopes = max(1, smooth_window), plateau_window, line_slopes()

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(parts)).sort_values("epoch")
        if state.exists:
            raw, smooth, seen, best, best_epoch, top, bad, last = state.get
            raw, smooth = list(raw), list(smooth)
        else:
            raw, smooth, seen, best, best_epoch, top, bad, last = [], [], 0, None, -1, None, 0, -(2**62)
        out = []
        for epoch, metric in zip(events["epoch"], events["metric"]):
            if epoch <= last:
                continue
            last, seen, value = int(epoch), seen + 1, float(metric) * sign
            raw = (raw + [value])[-width:]
            now = float(np.median(raw))
            smooth = (smooth + [now])[-tail:]
            slope = None
            if seen >= max(3, tail):
                slope = float(slopes(np.array([smooth]))[0]) * sign
            improved = best is None or value > best + min_delta
            if improved:
                best, best_epoch = value, last
            bad = 0 if top is None or now > top + min_delta else bad + 1
            top = now if top is None else max(top, now)
            reason = None
            if last >= min_epochs:
                if bad >= patience:
                    reason = "patience"
                elif plateau_slope_below is not None and slope is not None and abs(slope) < plateau_slope_below and bad >= patience // 2:
                    reason = "plateau"
            out.append((*key, last, improved, best * sign, best_epoch, now * sign, slope, bad, reason is not None, reason))
        state.update((raw, smooth, seen, best, best_epoch, top, bad, last))
        names = [f.split()[0] for f in DECISIONS.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        frame["slope"] = frame["slope"].astype("float64")
        yield frame

    keyed = stream.select(
        F.col("run").cast("bigint").alias("run"), F.col("fold").cast("bigint").alias("fold"),
        F.col("epoch").cast("bigint").alias("epoch"), F.col("metric").cast("double").alias("metric"),
    )
    return keyed.groupBy("run", "fold").applyInPandasWithState(
        judge, DECISIONS, STOP_STATE, "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over everything available into Parquet files and return them as a table."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
