"""Streaming jobs on built-in operators.

Watermarks are ours (the feeds have none): ten minutes for observations, thirty seconds for ticks. Rows later
than that are dropped, which a batch run over the same files would keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from skytally.functions import messages as MS
from skytally.operators import ticks as T

OBSERVATION_DELAY = "10 minutes"
TICK_DELAY = "30 seconds"


def window_moves(ticks: DataFrame, seconds: int = 300, keys=("asset",), delay: str = TICK_DELAY) -> DataFrame:
    """Open, close, high, low per tumbling window, each emitted once when the watermark passes its end.

    Dropping the first, partial window of a series is left to the reader of the table (``T.window_moves`` rule):
    which window is first is known only with the whole series.
    """
    order = F.struct("us", "seq")
    good = ticks.filter("price > 0").withWatermark("ts", delay)
    w = good.groupBy(*keys, F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("ticks"))
    w = w.withColumn("window_us", F.unix_micros("w.start")).drop("w")
    w = w.withColumn("up_move", F.greatest(F.lit(0.0), F.col("high") - F.col("open"))).withColumn("down_move", F.greatest(F.lit(0.0), F.col("open") - F.col("low")))
    return w.filter("up_move > 0 OR down_move > 0")


def observed_extremes(obs: DataFrame, delay: str = OBSERVATION_DELAY) -> DataFrame:
    """Running high and low per station-local day (update mode). A corrected report with the same time
    overwrites: the last value per time is kept in the first aggregation, extremes come from the second."""
    dedup = obs.withWatermark("valid_utc", delay)
    return dedup.groupBy("station", "local_date", "epoch", "valid_utc").agg(F.max_by("whole_temp", "seq").alias("whole_temp"))


def fold_extremes(points: DataFrame) -> DataFrame:
    return points.groupBy("station", "local_date").agg(
        F.max("whole_temp").alias("high"), F.min("whole_temp").alias("low"), F.max("epoch").alias("latest_epoch"), F.count("*").alias("points"))


def message_prices(capture: DataFrame) -> DataFrame:
    """Landed capture envelopes to price rows."""
    raw = capture.filter("event_type = 'websocket_raw'").select("received_ms", F.col("raw").alias("message"))
    return MS.price_rows(raw)


def gated(ticks: DataFrame, windows: DataFrame, before: int = 120, length: int = 300) -> DataFrame:
    """Stream-static gate: ticks inside a report window of their asset. The tail is part of the window row,
    so it survives a refresh of the schedule."""
    return T.in_windows(ticks, windows, before, length)


def raw_while_active(capture: DataFrame, windows: DataFrame, length: int = 300) -> DataFrame:
    """Raw messages received while any window is active; text that cannot be parsed is kept too.

    Active spans are listed as whole seconds, one row each, and matched by equality.
    """
    seconds = windows.select(F.explode(F.sequence(F.col("expected_epoch"), F.col("expected_epoch") + length - 1)).alias("_s")).distinct()
    return capture.withColumn("_s", F.floor(F.col("received_ms") / 1000).cast("long")).join(seconds, "_s", "left_semi").drop("_s")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Process what is there and stop."""
    q = stream.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def merge_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: str) -> StreamingQuery:
    """Update-mode results as a table of batches; ``read_latest`` keeps the newest row per key. Each batch
    writes its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn(version, F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_latest(spark, path: str, keys: list[str], version: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/batch=*")
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(*keys, "r.*").drop(version)
