"""Shared pieces: the input columns of a table, and staged tables in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from babelcask.session import checkpoint_dir


class Staging:
    """Intermediate tables of one call, in a folder of its own under ``spark.checkpoint.dir``.

    Every table is a parquet folder that all executors see, so a lost
    executor costs the recomputation of its running tasks only.  ``drop``
    removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm/{label}_{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text by the fixed pattern ``[^\\x20\\x09-\\x0D]+`` (SQL form)."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def bucketed(df: DataFrame, key: str, root: str, buckets: int) -> DataFrame:
    """``df`` written as a table bucketed by ``key``, without a shuffle: each task adds its rows to its buckets' files."""
    name = f"blocks_{uuid.uuid4().hex[:16]}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{root}/{name}").saveAsTable(name)
    out = df.sparkSession.table(name)
    out.schema  # resolved: the plan keeps files and buckets, the catalogue entry is not needed any more
    df.sparkSession.sql(f"DROP TABLE {name}")
    return out


def release_memory() -> None:
    """Give memory that is not in use any more back to the system.

    Spark keeps its Python workers for later tasks, and a worker keeps what its
    largest task has freed: it lies idle beside the next steps, which may run in the JVM alone.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; the end of each task releases memory."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()
    return whole
