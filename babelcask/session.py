"""Session settings and lineage cutting.

Lineage is cut with reliable ``checkpoint()`` into the shared folder the
cluster names in ``spark.checkpoint.dir``.  Only when that setting is absent
(tests, a laptop) do we pick a fresh scratch folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes per task of the text-to-gram step.  Counting keeps a row per
# (document, gram), at worst one per byte of text at some 150 bytes in each of
# the step's two hash maps and its sort, so a task's memory is bounded by this.
PART_TEXT_BYTES = 4 << 20


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "babelcask", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench; a cluster passes its own master."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the session's setting, else a fresh scratch one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # only when the cluster names no folder (tests, single machine)
        configured = tempfile.mkdtemp(prefix="babelcask-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def input_bytes(df: DataFrame) -> int:
    """Size of the largest relation ``df`` reads, from the optimiser's statistics (no job)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    largest = 0
    while leaves.hasNext():
        largest = max(largest, int(str(leaves.next().stats().sizeInBytes())))
    return largest


def work_partitions(df: DataFrame) -> int:
    """Partitions (and buckets) for hash-partitioning ``df``'s rows by document.

    One per ``spark.sql.files.maxPartitionBytes`` of the largest input (the
    granularity of Spark's own scan splits), at least the cluster's default
    parallelism, at most ``spark.sql.sources.bucketing.maxBuckets`` (the
    result is also the bucket count of the tables written by document).  The
    text-to-gram step is the heaviest per-document work, so its task size
    follows the data: 100 TB of input gets ~1 GB tasks, not
    ``spark.sql.shuffle.partitions``-sized ones, and a small input does not
    get hundreds of near-empty tasks.
    """
    spark = df.sparkSession
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = input_bytes(df)
    cap = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    if size >= int(spark._jsparkSession.sessionState().conf().defaultSizeInBytes()):
        # no statistics (an in-memory or RDD-backed input): the configured count
        return max(1, min(cap, max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))))
    want = -(-size // max(split, 1))
    return max(1, min(cap, max(spark.sparkContext.defaultParallelism, want)))


def text_partitions(df: DataFrame, bytes_col: str) -> int:
    """Partitions (and buckets) for counting the grams of texts whose sizes are in ``bytes_col``.

    One per ``PART_TEXT_BYTES`` of text as it is, not as its files are
    compressed, within the limits of ``work_partitions``: a task's memory does
    not grow with the input.  ``df`` should be a table that holds the sizes as a column, so
    that summing them reads no text.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.col(bytes_col).cast("long"))).first()[0] or 0
    cap = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return max(1, min(cap, max(spark.sparkContext.defaultParallelism, -(-size // PART_TEXT_BYTES))))


def bucketed_table(df: DataFrame, key: str, prefix: str = "t", partitioned: bool = False,
                   buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` in the checkpoint folder; read it back.

    Unlike a checkpoint, the table remembers that it is hash-partitioned by
    ``key`` into ``buckets`` buckets (default ``spark.sql.shuffle.partitions``),
    so joins and aggregations on ``key`` read it without a shuffle.  The write is a new
    folder per call; nothing is overwritten.
    """
    spark = df.sparkSession
    n = buckets or shuffle_partitions(spark)
    name = f"{prefix}_{uuid.uuid4().hex[:16]}"
    path = checkpoint_dir(spark).rstrip("/") + "/tables/" + name
    # one file per bucket: each task holds exactly one bucket; skip the
    # shuffle when the plan is already hash-partitioned by ``key`` into n
    src = df if partitioned else df.repartition(n, key)
    (src.write.format("parquet").bucketBy(n, key)
       .option("path", path).saveAsTable(name))
    return spark.table(name)


def cut_lineage(df: DataFrame, prefix: str = "t") -> DataFrame:
    """Write ``df`` as parquet in the checkpoint folder and return a plan that reads it.

    One job (an eager ``checkpoint()`` computes the plan twice: once to
    count, once to write).  The files are on the shared folder, so they
    survive the loss of the executors that wrote them, unlike cached or
    locally checkpointed blocks.  A new folder per call; nothing is overwritten.
    """
    spark = df.sparkSession
    path = checkpoint_dir(spark).rstrip("/") + f"/tables/{prefix}_{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return spark.read.parquet(path)
