import os
import re

from pyspark.sql import functions as F

from babelcask import session
from babelcask.plans import cascade, catalog
from babelcask.session import shuffle_partitions, work_partitions

SMALL = "/root/testdata/sf0.001"


def test_work_partitions_follow_input_size(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = work_partitions(df)
    assert base == spark.sparkContext.defaultParallelism      # tiny input: no near-empty tasks
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        many = work_partitions(df)
        assert many > shuffle_partitions(spark)                # grows with the data, not capped by the config
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(many - 1))
        assert work_partitions(df) == many - 1                 # but never above the bucket limit
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def _alike(spark, n, text):
    """``n`` equal texts: files far smaller than the texts."""
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))


def test_count_table_has_buckets_by_text_size(spark, scratch, monkeypatch):
    monkeypatch.setattr(session, "PART_TEXT_BYTES", 4000, raising=False)
    docs = _alike(spark, 400, "a few words " * 20).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    docs.write.parquet(f"{scratch}/documents.parquet")
    spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"),
                            (F.col("id") % 3 == 1).cast("int").alias("quality")).write.parquet(f"{scratch}/labels.parquet")
    cp = cascade.Corpus(spark, scratch)
    files = [re.search(r"_(\d{5})\.", os.path.basename(f)) for f in cp.features.inputFiles()]
    buckets = {int(m.group(1)) for m in files if m}
    assert max(buckets) < 400 * 240 // 4000 and len(buckets) > 20      # 24 buckets, perhaps not all with rows
    assert cp.features.agg(F.sum("n")).first()[0] == 400 * 20 * (1 + 3 + 5)     # grams of <a>, <few>, <words>


def test_prediction_has_parts_by_text_size(spark, monkeypatch):
    m = catalog.cascade_model(spark, SMALL)
    monkeypatch.setattr(session, "PART_TEXT_BYTES", 4000, raising=False)
    out = cascade.predict(m, _alike(spark, 400, "a few words " * 20))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[doc_id#\d+L?\], 24\b", plan)
    assert out.count() == 400 and out.select("predicted_language", "predicted_sentiment").distinct().count() == 1
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert cascade.predict(m, empty).count() == 2
