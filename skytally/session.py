"""Spark session settings this package relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job needs for right results; all can be set on a running session.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}
# The JVM never compiles a method of more than 8000 bytecodes. Wide expression lists are then better split into
# small methods than fused into one interpreted giant.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}
ADVISED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build(master: str = "local[8]", name: str = "skytally", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session; on a cluster the session is made by spark-submit and passed in."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {
        **REQUIRED,
        **COMPILED,
        **ADVISED,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on; leave sizing choices of the given session alone."""
    for key, value in {**REQUIRED, **COMPILED}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session, as in tests, may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^-].*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="skytally-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table that several branches of a job read into the shared checkpoint folder, and read it back.

    Runs a job. Each branch then scans only its columns instead of repeating the work above, and a lost executor
    costs no more than the branch.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
