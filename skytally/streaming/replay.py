"""Replay a table through a streaming job: it lands in slices, and the job is started again after each.

Every start goes on from the checkpoint of the one before, so a replay also shows that nothing is lost or repeated over a
restart. Folders lie below the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from skytally import session
from skytally.streaming.jobs import run_once
from skytally.streaming.stateful import use_rocksdb


def slices(df: DataFrame, order: str, parts: int) -> list[DataFrame]:
    """``df`` cut by ranges of a number into about equal parts, in order."""
    cuts = df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01) if parts > 1 else []
    bounds = [None, *cuts, None]
    out = []
    for low, high in zip(bounds, bounds[1:]):
        part = df
        if low is not None:
            part = part.filter(F.col(order) >= low)
        if high is not None:
            part = part.filter((F.col(order) < high) | F.col(order).isNull()) if low is None else part.filter(F.col(order) < high)
        out.append(part)
    return out


def replay(df: DataFrame, order: str, job: Callable[[DataFrame], DataFrame], time: str | None = None, parts: int = 2, per_trigger: int | None = None, rocksdb: bool = True) -> DataFrame:
    """What ``job`` writes after all slices have landed.

    With ``time`` a last row of nulls with a time far ahead moves the watermark past all rows. ``per_trigger`` is the
    number of files of a trigger; without it a slice is one trigger.
    """
    spark = df.sparkSession
    if rocksdb:
        use_rocksdb(spark)
    root = f"{session.checkpoint_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    landing = f"{root}/in"
    landed = list(slices(df, order, parts))
    if time:
        end = df.agg((F.max(time) + F.expr("INTERVAL 3650 DAYS")).alias(time)).filter(F.col(time).isNotNull())
        landed.append(end.select(*[F.col(time) if c == time else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))
    for part in landed:
        part.write.mode("append").parquet(landing)
        reader = spark.readStream.schema(df.schema)
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger)
        run_once(job(reader.parquet(landing)), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")
