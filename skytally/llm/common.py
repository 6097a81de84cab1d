"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word patterns of the contracts.
SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shuffle files go once their query has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder that the session names and read it back.

    Cuts the lineage: a lost executor costs no more than the branch that reads the table. The shuffle files of the write
    go with its end.
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stage``, with the table's path, for ``discard``."""
    from skytally import session

    spark = df.sparkSession
    path = f"{session.checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table. Only for those whose last reader has been written to a table itself."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The runs of characters between separators; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def with_text(df: DataFrame, keep: tuple[str, ...], text: str, *more: Column) -> DataFrame:
    """The ``keep`` columns, ``more``, and the text as the last column, unless it is a field of a kept struct (``a.b``)."""
    inside = text.rsplit(".", 1)[0] in keep and "." in text
    return df.select(*keep, *more, *([] if inside else [F.col(text).cast("string").alias("__text")]))


def texts(batch, keep: tuple[str, ...], text: str):
    """The texts of a batch made by ``with_text``: a text that is kept goes to Python once."""
    if "." in text and text.rsplit(".", 1)[0] in keep:
        outer, inner = text.rsplit(".", 1)
        return batch.column(keep.index(outer)).field(inner)
    return batch.column(batch.num_columns - 1)


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text modulo ``by``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % by


def column_types(fields) -> list[str]:
    """Name and type of each column, as a schema in text wants them."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
