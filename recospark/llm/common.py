"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in runs of about so many bytes, whatever the Arrow batches hold.
CHUNK_BYTES = 4 << 20


#: Bytes of an Arrow batch between Spark and its Python workers, in place of Spark's own larger bound.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, so that long texts don't add up in the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches that gives unused memory back when a task ends, as workers live on and share an executor."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The named table below a data directory."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; only a local session (tests) gets a folder of its own where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="recospark-"))


#: A key is hot if it holds more than one row in HOT; so there are fewer than HOT of them, and they may be broadcast.
HOT = 1000


def join_skewed(rows: DataFrame, named: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to the one row of each key in `named`, whose column `count` is how many of the rows have the key.

    Rows of hot keys stay where they are and get their match from a broadcast; all others are shuffled.
    """
    total = named.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(named.filter(F.col(count) * HOT > total).drop(count))
    calm = named.filter(F.col(count) * HOT <= total).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(calm, key))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, which survives lost executors, and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, *by: str) -> DataFrame:
    """Write df as compressed Parquet below the shared checkpoint folder and read it back; for what is large.

    by: columns of few values whose rows are kept in files of their own. The files go when the application ends, or by
    discard.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"
    df.write.parquet(path, partitionBy=list(by) or None)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that materialise gave and that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more, such as a finished round's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(column: str, by: int) -> Column:
    """crc32 of an id's decimal text, modulo by; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]
