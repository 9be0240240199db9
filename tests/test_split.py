import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from babelcask.operators.ranking import bucketed_rank, md5_bucket
from babelcask.operators.split import ClassTooSmall, assign_split_and_fold, order_key


def _data(spark, sizes):
    rows, i = [], 0
    for cls, n in sizes.items():
        for _ in range(n):
            rows.append((i, cls))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, label string")


def test_split_sizes_follow_the_quota_rule(spark):
    sizes = {"a": 51, "b": 49, "c": 299}
    a = assign_split_and_fold(_data(spark, sizes), "label")
    counts = {(r["label"], r["split"]): r["count"] for r in a.groupBy("label", "split").count().collect()}
    n = sum(sizes.values())
    n_train = n - math.ceil(0.2 * n)
    assert sum(v for (c, s), v in counts.items() if s == "train") == n_train
    assert counts[("a", "train")] == 41 and counts[("b", "train")] == 39 and counts[("c", "train")] == 239


def test_folds_cover_every_row_once_and_balance(spark):
    sizes = {"x": 23, "y": 7, "z": 41}
    a = assign_split_and_fold(_data(spark, sizes), "label")
    assert a.count() == sum(sizes.values())
    assert a.select("doc_id").distinct().count() == a.count()
    per = a.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread"), F.countDistinct("fold").alias("folds")).collect()
    for r in per:
        assert r["spread"] <= 1
    assert {r["fold"] for r in a.select("fold").distinct().collect()} == set(range(5))


def test_assignment_independent_of_partitioning(spark):
    d = _data(spark, {"a": 30, "b": 70})
    a1 = {tuple(r) for r in assign_split_and_fold(d, "label").collect()}
    a2 = {tuple(r) for r in assign_split_and_fold(d.repartition(7), "label").collect()}
    assert a1 == a2


def test_bucketed_rank_equals_window(spark):
    d = _data(spark, {"a": 200, "b": 50}).withColumn("_h", order_key("doc_id"))
    got = bucketed_rank(d, ["label"], [F.col("_h"), F.col("doc_id")], md5_bucket("_h"))
    want = d.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id")))
    assert {tuple(r) for r in got.select("doc_id", "rank").collect()} == \
        {tuple(r) for r in want.select("doc_id", "rank").collect()}


def test_fine_buckets_give_the_same_assignment(spark):
    """A class split over many md5 buckets (here 4 rows per bucket) ranks exactly as one window."""
    d = _data(spark, {"a": 300, "b": 40, "c": 7})
    coarse = {tuple(r) for r in assign_split_and_fold(d, "label").collect()}
    fine = {tuple(r) for r in assign_split_and_fold(d, "label", bucket_rows=4).collect()}
    assert coarse == fine


def test_md5_bucket_bits_monotone(spark):
    d = _data(spark, {"a": 200}).withColumn("_h", order_key("doc_id"))
    rows = d.select("_h", md5_bucket("_h", 3).alias("b3"), md5_bucket("_h", 0).alias("b0"),
                    md5_bucket("_h").alias("b16")).orderBy("_h").collect()
    assert [r["b3"] for r in rows] == sorted(r["b3"] for r in rows) and max(r["b3"] for r in rows) <= 7
    assert {r["b0"] for r in rows} == {0}
    assert [r["b16"] for r in rows] == sorted(r["b16"] for r in rows)


def test_seeded_order_is_a_permutation_matching_the_window(spark):
    from babelcask.operators.split import seeded_order
    d = _data(spark, {"a": 120, "b": 30})
    got = {tuple(r) for r in seeded_order(d, "doc_id", bucket_rows=8).collect()}
    want = d.withColumn("_h", order_key("doc_id")).select(
        "doc_id", F.row_number().over(Window.orderBy("_h", "doc_id")).alias("position"))
    assert got == {tuple(r) for r in want.collect()}


def test_class_plan_of_very_many_rows(spark):
    """Products of row counts past 64 bits (counts put in as they would come out of the groupBy)."""
    from pyspark.sql import functions as F
    n, n_train = 10**11, 8 * 10**10
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(n_train).alias("t"), F.lit(n + 7).alias("a")).select(
        F.expr("CAST(CAST(n AS DECIMAL(19,0)) * CAST(t AS DECIMAL(18,0)) div a AS BIGINT)").alias("q"),
        F.expr("CAST(CAST(n AS DECIMAL(19,0)) * CAST(t AS DECIMAL(18,0)) % a AS BIGINT)").alias("r")).first()
    assert (row["q"], row["r"]) == divmod(n * n_train, n + 7)


def test_classes_too_small_are_errors(spark):
    with pytest.raises(ClassTooSmall, match="one row only"):
        assign_split_and_fold(_data(spark, {"a": 30, "b": 1}), "label")
    with pytest.raises(ClassTooSmall, match="test part"):
        assign_split_and_fold(_data(spark, {c: 2 for c in "abcdef"}), "label")
    with pytest.raises(ClassTooSmall, match="train part"):
        assign_split_and_fold(_data(spark, {c: 2 for c in "abcdef"}), "label", test_size=0.8)
    with pytest.raises(ClassTooSmall, match="folds"):
        assign_split_and_fold(_data(spark, {"a": 4, "b": 3}), "label", split_out=None)
    loose = assign_split_and_fold(_data(spark, {"a": 30, "b": 1}), "label", strict=False)
    assert loose.count() == 31
    # folds alone: a class smaller than the number of folds is allowed beside a large one
    assert assign_split_and_fold(_data(spark, {"a": 30, "b": 1}), "label", split_out=None).count() == 31


def test_null_classes_keep_their_rows(spark):
    d = _data(spark, {"a": 30, "b": 20})
    nulls = spark.range(100, 107).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("label"))
    a = {tuple(r) for r in assign_split_and_fold(d, "label").collect()}
    b = {tuple(r) for r in assign_split_and_fold(d.union(nulls), "label").collect()}
    assert b - a == {(i, None, None, None) for i in range(100, 107)} and a < b
    assert assign_split_and_fold(d.limit(0), "label").count() == 0
