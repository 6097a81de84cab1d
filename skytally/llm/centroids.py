"""Clustering of vectors around centroids with an incremental distance matrix, in exact integers.

Components are turned into integers. For every vector its components, its squared length and its dot product with each
centroid are kept in a table. A round moves the centroids; the dot products then change by the nonzero component changes
of each centroid alone, and the nearest centroid is found anew from squared length - 2 dot product + the centroid's
squared length. Tasks add up the components of their vectors by cluster; the driver sees one row for each cluster.

A round's table is written below the shared checkpoint folder and takes the place of the one before, which is then
deleted: a lost executor costs a part of one round, and no more than two tables are kept.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out. Repeated
rows are vectors of their own. A vector without an id is assigned, but never a first centroid. Equal hashes order by
components. With fewer vectors than centroids each is one, without any the result is empty. Integers beyond 2 ** 26
either way would not fit exact sums and raise an error. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytally import session
from skytally.llm.common import column_types

#: Largest size of a component for which 64 squares of differences fit a long, and below which products are exact doubles.
LARGEST, EXACT = 1 << 26, 1 << 53


def whole_vectors(df: DataFrame, vector: str, size: int, scale: float) -> DataFrame:
    """Rows whose vector has ``size`` finite components, with their integers as ``__x``."""
    usable = (F.size(vector) == size) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")))
    return df.where(F.col(vector).isNotNull() & usable).withColumn("__x", scaled)


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products of rows; through doubles where every sum stays below 2 ** 53."""
    if len(x) and len(c) and int(np.abs(x).max()) * int(np.abs(c).max()) * x.shape[1] < EXACT:
        return (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return x @ c.T


def moved(x: np.ndarray, old: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after the centroids' change: each is corrected by its centroid's nonzero components alone."""
    out = old.copy()
    for k, row in enumerate(change):
        at = np.flatnonzero(row)
        if len(at):
            out[:, k] += dots(x[:, at], row[None, at])[:, 0]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))


def _round(state: DataFrame, size: int, centroids: np.ndarray, change: np.ndarray | None) -> DataFrame:
    """``state`` with dot products, nearest centroid and squared distance; without a change the products are made in full."""
    squares = (centroids * centroids).sum(1)
    keep = [x for x in state.columns if x not in ("__dots", "__cluster", "__distance")]
    source = state.select(*keep, *(["__dots"] if change is not None else []))
    schema = ", ".join([*column_types(state.select(*keep).schema.fields), "__dots array<long>", "__cluster int", "__distance long"])
    at = keep.index("__x"), keep.index("__norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at[0]), size)
            if change is None:
                if x.size and max(int(x.max()), -int(x.min())) > LARGEST:
                    raise ValueError(f"a component beyond {LARGEST} has no exact distances")
                products = dots(x, centroids)
            else:
                products = moved(x, _matrix(batch.column(len(keep)), len(centroids)), change)
            distance = squares[None, :] - 2 * products
            cluster = distance.argmin(1) if len(x) else np.zeros(0, np.int64)
            best = distance[np.arange(len(x)), cluster] + batch.column(at[1]).to_numpy()
            columns = [*batch.columns[: len(keep)], _lists(products), pa.array(cluster.astype(np.int32)), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "__dots", "__cluster", "__distance"])

    return source.mapInArrow(run, schema)


def _sums(state: DataFrame, size: int) -> dict[int, tuple[int, int, np.ndarray]]:
    """By cluster: vectors, summed distance, and summed components. A task gives one row for each of its clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            x, cluster, distance = _matrix(batch.column(0), size), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(cluster).tolist():
                some = cluster == k
                row = found.setdefault(k, [0, 0, np.zeros(size, np.int64)])
                row[0] += int(some.sum())
                row[1] += int(distance[some].sum())
                row[2] += x[some].sum(0)
        if found:
            keys = sorted(found)
            columns = [pa.array(keys, pa.int32()), pa.array([found[k][0] for k in keys]), pa.array([found[k][1] for k in keys]), _lists(np.stack([found[k][2] for k in keys]))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n", "d", "s"])

    parts = state.select("__x", "__cluster", "__distance").mapInArrow(run, "k int, n long, d long, s array<long>")
    rows = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.array(*(F.sum(F.col("s")[j]) for j in range(size))).alias("s")).collect()
    return {r["k"]: (r["n"], r["d"], np.array(r["s"], np.int64)) for r in rows}


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{session.checkpoint_dir(spark).rstrip('/')}/centroids-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _drop(df: DataFrame, path: str) -> None:
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def cluster(df: DataFrame, vector: str = "embedding", key: str = "vec_id", size: int = 64, scale: float = 256.0, centroids: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """Nearest of ``centroids`` centroids after ``rounds`` rounds.

    Returns key, cluster, distance (squared), cluster_inertia and inertia (distances summed over the cluster and over all)
    and centroid_sha256 (of the final centroid's components as decimal text joined by commas).
    """
    spark = df.sparkSession
    whole = whole_vectors(df.select(F.col(key).alias(key), F.col(vector).alias("__v")), "__v", size, scale)
    start = whole.select(F.col(key).alias("__key"), F.col("__x").cast("array<long>").alias("__x"))
    norm = F.aggregate("__x", F.lit(0).cast("long"), lambda a, v: a + v * v)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__key").cast("string")), 256)
    first = start.where(F.col("__key").isNotNull()).orderBy(name, "__x").limit(centroids).collect()
    at = np.array([r["__x"] for r in first], np.int64).reshape(-1, size)
    if not len(at):
        kind = df.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    small = F.forall("__x", lambda v: v.between(-LARGEST, LARGEST))
    state = start.withColumn("__norm", F.when(small, norm).otherwise(0))
    state, path = _kept(_round(state, size, at, None))
    for _ in range(rounds):
        found = _sums(state, size)
        new = at.copy()
        for k, (n, _, s) in found.items():
            new[k] = s // n
        after, after_path = _kept(_round(state, size, new, new - at))
        _drop(state, path)
        state, path, at = after, after_path, new
    found = _sums(state, size)
    total = sum(d for _, d, _ in found.values())
    said = [(k, d, total, hashlib.sha256(",".join(map(str, at[k].tolist())).encode()).hexdigest()) for k, (_, d, _) in found.items()]
    # One row for each centroid, whatever the input.
    about = F.broadcast(spark.createDataFrame(said, "__cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    joined = state.select("__key", "__cluster", "__distance").join(about, "__cluster")
    return joined.select(F.col("__key").alias(key), F.col("__cluster").alias("cluster"), F.col("__distance").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
