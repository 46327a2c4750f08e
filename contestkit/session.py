"""Sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, name: str = "contestkit") -> SparkSession:
    """UTC, ANSI errors and adaptive execution; other settings stay the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.ansi.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored in the cluster's shared checkpoint folder, so that its lineage ends at files that survive a lost executor.

    Only a local session without ``spark.checkpoint.dir`` gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="contestkit-cut-"))
    return df.checkpoint()


def fresh(spark: SparkSession, name: str) -> str:
    """A folder in the cluster's shared storage that nothing else uses: below ``spark.checkpoint.dir``, or a local session's own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='contestkit-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
