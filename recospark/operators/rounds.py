"""Work done for one part of the users at a time, so that disk holds the shuffles of one round and what the others gave."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds at most, as each reads what they share anew.
MOST = 8


def number(rows: int, size: int, most: int = MOST) -> int:
    """How many rounds of about `size` rows there are for so many rows."""
    return max(1, min(most, -(-rows // size)))


def part(user: str, n: int) -> Column:
    """The round of a user, 0 to n - 1; by another hash than shuffles use, so that a round's users reach all partitions."""
    return F.pmod(F.xxhash64(user), F.lit(n))


def _folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a local session gets one of its own where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="recospark-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4()}"


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    df.write.mode("append").parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)


def materialise(df: DataFrame) -> DataFrame:
    """df as Parquet below the shared checkpoint folder until the application ends; shuffles it took may go."""
    path, spark, schema = _folder(df.sparkSession), df.sparkSession, df.schema
    _write(df, path)
    _release(spark)
    written = spark.read.schema(schema).parquet(path)
    written.written_to = path
    return written


def rows_of(written: DataFrame) -> int:
    """The number of a materialised frame's rows, which its files name."""
    return written.count()


def by_round(spark: SparkSession, n: int, of: Callable[[int], DataFrame], *shared: DataFrame) -> DataFrame:
    """The rows of of(0) to of(n - 1), each written before the next is begun; `shared`: materialised, not needed after that.

    One round is not written but planned with what reads it.
    """
    if n == 1:
        return of(0)
    path, schema = _folder(spark), None
    for r in range(n):
        found = of(r)
        schema = found.schema
        _write(found, path)
        del found
        _release(spark)
    for df in shared:
        files, at = _path(spark, df.written_to)
        files.delete(at, True)
    return spark.read.schema(schema).parquet(path)
