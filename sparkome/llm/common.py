"""Helpers shared by the operators: shared work folder, written tables, hold-out rule, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space that separates words in the operators' contracts.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def col(name: str) -> Column:
    """A column by its literal name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of df as one, so that no name of theirs can clash; select("row.*") brings them back."""
    return F.struct(*[col(c) for c in df.columns]).alias("row")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a single machine, where that is unset (tests), a temporary one."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="sparkome-")
        sc.setCheckpointDir(configured)
        configured = sc.getCheckpointDir() or configured
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it back. Within scratch() it is removed at the end."""
    path = new_path(df.sparkSession, name)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within are removed when it ends, whether it ends well or not."""
    before = _made.set([])
    try:
        yield
    finally:
        made = _made.get() or []
        _made.reset(before)
        for path in made:
            remove(spark, path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives as a written table, without the tables that it was made from."""
    with scratch(spark):
        df = make()
        path = new_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids that are sent to every task; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """A table of a few narrow columns, to be broadcast if it has been counted and found small. It is read twice, so a written one."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_released = [-1]


def release() -> None:
    """Give back what earlier stages have left in a reused worker, once in each stage: allocators keep it otherwise, and stages add up."""
    import ctypes
    import gc

    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    stage = context.stageId() if context else -1
    if stage == _released[0]:
        return
    _released[0] = stage
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text leaves 2 modulo 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values only, so that samples are the same on every run."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)).cast("double")


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, chosen by a hash of `key`. Rows are counted first and thinned to about 2 n before they are ordered, so that tasks together don't send more of them, however many tasks there are."""
    share = min(1.0, (2.0 * n + 100) / max(1, df.select(key).count()))
    return df.where(uniform(F.col(key)) < share).orderBy(uniform(F.col(key)), key).limit(n)


def stratified(df: DataFrame, by: str, key: str, per_class: int, last: Column | None = None) -> DataFrame:
    """At most per_class rows of each value of `by`, chosen by a hash of `key`; rows of which `last` holds only where others don't suffice.

    The classes are counted first, so that the window that cuts each class only sees about twice as many rows as it keeps.
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_class + 100) / F.col("__n"))
    picked = df.withColumn("__u", uniform(F.col(key))).join(F.broadcast(counts), by).where(F.col("__u") < share)
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*([last] if last is not None else []), "__u", key)
    return picked.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_class).drop("__u", "__r", "__n")


def once(col: Column) -> Column:
    """col, marked as not deterministic, so that a filter on it isn't pushed below and computed anew from its inputs."""
    return F.when(F.spark_partition_id() >= 0, col)
