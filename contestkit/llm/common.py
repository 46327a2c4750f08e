"""What the operators of this subpackage share: column picking, shared storage, batch sizes."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two numbers that are broadcast at most: about 32 MB.
BROADCAST_ROWS = 1_000_000

#: Keys that are broadcast at most by ``uneven_join``.
HOT_KEYS = 200_000

_own_dirs: dict[str, str] = {}


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, in this order.

    Other columns are dropped before any expression sees them, so extra columns cannot clash
    with internal names, not even ones that differ in case only.
    """
    columns = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"c{columns.index(n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own; on a cluster the setting is required,
    since executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        base = found.rsplit("/", 1)[0] if found else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="contestkit-"))
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/contestkit/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The lineage ends at files that survive a lost executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it is counted and within the bound; beyond it, a plain side of a shuffled join."""
    return F.broadcast(keys) if keys.count() <= most else keys


def uneven_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, rows: int) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row a ``key``, where some keys may hold much of ``left``.

    ``counts`` (key, n) tells how often ``left`` has each key of ``right``, ``rows`` how many rows it has. Keys with more than rows / HOT_KEYS
    uses, and twice at least, are HOT_KEYS at most: they are broadcast. Only if there are others are they joined by a shuffle, in which no key is large.
    """
    often = max(1, math.ceil(rows / HOT_KEYS))
    sized = right.join(counts, key) if "n" not in right.columns else right
    names = [c for c in sized.columns if c not in (key, "n")]
    hot = sized.filter(F.col("n") > often).drop("n")
    out = left.join(F.broadcast(hot), key, "left")
    rest = sized.filter(F.col("n") <= often).drop("n")
    if rest.take(1):
        out = out.join(rest.toDF(*[c if c == key else f"{c}_" for c in rest.columns]), key, "left")
        out = out.select(*[c for c in out.columns if c not in names and c[:-1] not in names], *[F.coalesce(c, f"{c}_").alias(c) for c in names])
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a ``stash`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared storage with all below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of bounded text, so that a batch of long texts needs no more memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and (total + n > most_bytes or i - begin >= most_rows):
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)


def is_zero(df: DataFrame) -> bool:
    """Whether there is no row at all."""
    return not df.take(1)
