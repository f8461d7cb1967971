"""Streams over landed copies of events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bagspark.queries.history import SLOPE
from bagspark.queries.registry import query, r6, tables
from bagspark.session import scratch_path
from bagspark.sources.landed import JOURNAL_SCHEMA
from bagspark.streaming import ingest as I
from bagspark.streaming import monitor as M


def journal_stream(spark, sf):
    src = scratch_path(spark, "journal")
    tables(spark, sf, "journal").withColumn("ts", F.col("ts").cast("timestamp")).write.json(src)
    return spark.readStream.schema(JOURNAL_SCHEMA).json(src)


@query(
    "stream_ingest",
    """SELECT slide_id, patch_idx, 'cls' AS pooling, 'accepted' AS outcome FROM patches_vec WHERE label <> 0
       UNION ALL SELECT slide_id, patch_idx, 'cls_mean', 'diverted' FROM patches_vec""",
    "patches_vec",
)
def stream_ingest(spark, sf):
    """Some rows land twice, most keys with both poolings in one batch; two chained runs with their own checkpoints take them in."""
    rows = tables(spark, sf, "patches_vec").select(
        "slide_id", "patch_idx", (F.col("patch_idx") * 448).alias("x"), F.lit(0).cast("bigint").alias("y"),
        F.lit("h-optimus-0").alias("encoder"),
        F.when(F.col("label") == 0, "cls_mean").when(F.col("label") == 2, "cls").alias("pooling"), "features",
    )
    src, store = scratch_path(spark, "arrivals"), scratch_path(spark, "store")
    rows.where("pooling = 'cls'").write.mode("append").parquet(src)
    I.stream_ingest(spark, src, store, scratch_path(spark, "ckpt")).awaitTermination()
    rows.unionByName(rows.withColumn("pooling", F.lit("cls_mean"))).write.mode("append").parquet(src)
    I.stream_ingest(spark, src, store, scratch_path(spark, "ckpt")).awaitTermination()
    kept = [
        spark.read.parquet(f"{store}/{part}").select("slide_id", "patch_idx", "pooling", F.lit(part).alias("outcome"))
        for part in ("accepted", "diverted")
    ]
    return kept[0].unionByName(kept[1])


@query(
    "stream_journal_rates",
    """WITH w AS (SELECT date_trunc('hour', ts) AS ws, shard, count(*) FILTER (WHERE ok) AS done, count(*) FILTER (WHERE NOT ok) AS failed,
                         CAST(coalesce(sum(n_patches) FILTER (WHERE ok), 0) AS BIGINT) AS patches FROM journal GROUP BY 1, 2)
       SELECT CAST(ws AS VARCHAR) AS window_start, shard, done, failed, patches, round(patches / 3600.0e0, 6) + 0.0 AS patches_per_sec
       FROM w WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM journal) - INTERVAL 1 HOUR""",
    "journal",
)
def stream_journal_rates(spark, sf):
    rates = M.stream_journal_rates(journal_stream(spark, sf))
    df = M.drain(rates, scratch_path(spark, "rates"), scratch_path(spark, "ckpt"))
    return df.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "shard", "done", "failed", "patches",
        r6("patches_per_sec").alias("patches_per_sec"),
    )


@query(
    "stream_notify",
    """WITH c AS (SELECT shard, count(*) FILTER (WHERE ok) AS done FROM journal GROUP BY shard)
       SELECT shard, 'progress' AS kind, unnest(range(25, done + 1, 25)) AS at FROM c""",
    "journal",
)
def stream_notify(spark, sf):
    df = M.drain(M.notifications(journal_stream(spark, sf)), scratch_path(spark, "notes"), scratch_path(spark, "ckpt"))
    return df.select("shard", "kind", "at")


@query(
    "stream_early_stop",
    f"""WITH {SLOPE}, b AS (SELECT *, max(smoothed) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM sl),
        i AS (SELECT *, CASE WHEN prev IS NULL OR smoothed > prev + 0.002e0 THEN epoch END AS imp FROM b),
        n AS (SELECT *, epoch - max(imp) OVER (PARTITION BY run ORDER BY epoch) AS num_bad FROM i)
        SELECT run, CAST(epoch AS BIGINT) AS epoch, round(smoothed, 9) + 0.0 AS smoothed, CAST(num_bad AS BIGINT) AS num_bad,
               CASE WHEN epoch < 20 THEN NULL WHEN num_bad >= 20 THEN 'patience' WHEN abs(slope) < 0.001 AND num_bad >= 10 THEN 'plateau' END AS reason FROM n""",
    "history",
)
def stream_early_stop(spark, sf):
    rows = tables(spark, sf, "history")
    src = scratch_path(spark, "metrics")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    df = M.drain(M.stream_early_stop(stream), scratch_path(spark, "decisions"), scratch_path(spark, "ckpt"))
    return df.select("run", "epoch", (F.round("smoothed", 9) + 0.0).alias("smoothed"), "num_bad", "reason")
