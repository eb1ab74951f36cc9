"""Helpers that the corpus operators share: shared-folder tables, skew-safe joins, names and batches."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as the inside of a character class (fixed value).
WS = r"\x20\x09-\x0D"
#: Bytes of texts that a Python worker deals with at once; a longer text is dealt with by itself, whole.
RUN_BYTES = 8 << 20

_here = threading.local()


def made() -> list[str]:
    """Paths in the shared folder that this thread has asked for and not deleted; other threads' tables are none of its."""
    if not hasattr(_here, "made"):
        _here.made = []
    return _here.made


#: Spark's setting for the bytes of an Arrow batch, its default, and what queries and pipeline stages ask for.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def prepared(spark: SparkSession) -> SparkSession:
    """`spark` with Arrow batches of at most BATCH_BYTES, unless they have been bounded already.

    The JVM keeps buffers of the size of its largest batches beside the heap. Queries and pipeline stages ask for this;
    operators leave the session as it is.
    """
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark


def let_go() -> None:
    """Give free memory back, in a Python worker that Spark may hand on to another stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of our own on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/checkpoints").rstrip("/") + "/refweave"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `intermediates` deletes if it is made within one."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made().append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives later plans the true size of the table, so that Spark
    broadcasts it only below spark.sql.autoBroadcastJoinThreshold.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def paths_of(df: DataFrame) -> set[str]:
    """Folders of the files that `df` reads, without scheme."""
    return {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in df.inputFiles()}


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        made().remove(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written within the block are deleted at its end, but those that a DataFrame put into the list reads."""
    first, keep = len(made()), []
    yield keep
    read = set().union(*map(paths_of, keep))
    remove(spark, [p for p in made()[first:] if p.split(":", 1)[-1].lstrip("/") not in read])


def delete(df: DataFrame) -> None:
    """Delete the tables in the shared folder that `df` reads, which nothing may need any more."""
    read = paths_of(df)
    remove(df.sparkSession, [p for p in made() if p.split(":", 1)[-1].lstrip("/") in read])


def clear(spark: SparkSession) -> None:
    """Delete all tables that this thread's operators have written to the shared folder, once no DataFrame of theirs is needed."""
    remove(spark, list(made()))


def private(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores in front as it takes to be none of the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str = "text") -> Column:
    """The column's text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join `left`, where one key may hold a third of all rows, to `right`, which has one row a key.

    The right key passes through a no-op expression, so that Spark deals both sides anew for this join; adaptive
    execution can then split the hot partitions of `left`, which it cannot where an aggregate sits right above the
    shuffle.
    """
    k = private(left, "_k")
    again = right.withColumn(k, F.concat(F.col(key).cast("string"), F.lit(""))).drop(key)
    return left.withColumn(k, F.col(key).cast("string")).join(again, k, how).drop(k)


def same_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def widths(column: pa.Array) -> list[int]:
    """Bytes of each row of a string, binary or list column, about."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        offsets = np.asarray(column.offsets)
        return (np.diff(offsets) * 4).tolist()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int32)
    return np.diff(offsets[column.offset : column.offset + len(column) + 1]).tolist()


def runs(*columns: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """[a, b) of stretches of rows that hold about `most` bytes in the columns together, one row at least."""
    a = total = b = 0
    for b, sizes in enumerate(zip(*map(widths, columns), strict=True)):
        size = sum(sizes)
        if b > a and total + size > most:
            yield a, b
            a, total = b, 0
        total += size
    if len(columns[0]):
        yield a, b + 1
