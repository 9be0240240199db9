import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from babelcask.operators.encode import ClassDictionary, Dictionary


def test_fit_sorted_by_code_point(spark):
    df = spark.createDataFrame([("b",), ("a",), ("B",), ("a",), (None,)], "v string")
    d = ClassDictionary.fit(df, "v")
    assert d.classes == ("B", "a", "b")
    got = df.where("v is not null").select(d.encode("v").alias("i"), d.decode(d.encode("v")).alias("back")).collect()
    assert all(r["back"] is not None for r in got)


def test_unseen_value_is_an_error(spark):
    d = ClassDictionary(("a", "b"))
    df = spark.createDataFrame([("c",)], "v string")
    with pytest.raises(Exception):
        df.select(d.encode("v")).collect()


def test_null_stays_null(spark):
    d = ClassDictionary(("a", "b"))
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(d.encode("v")).first()[0] is None


def test_twenty_thousand_classes_round_trip(spark):
    n = 20_000
    # class i has one row, class 7 a third of all rows; a null among them
    df = spark.range(n).select("id", F.concat(F.lit("c\u00e9"), F.col("id").cast("string")).alias("v")).union(
        spark.range(n // 2).select(F.col("id") + n, F.lit("c\u00e97"))).union(spark.range(1).select(F.lit(-1), F.lit(None)))
    d = Dictionary.fit(df, "v")
    assert d.size == n
    want = {v: i for i, v in enumerate(sorted(f"c\u00e9{i}" for i in range(n)))}
    assert {r["value"]: r["idx"] for r in d.frame.collect()} == want
    for limit in (1 << 20, 100):                # by broadcast and by shuffle
        enc = d.encode(df, "v", "i", broadcast_rows=limit)
        back = d.decode(enc, "i", "back", broadcast_rows=limit).select("id", "v", "i", "back").collect()
        assert len(back) == n + n // 2 + 1
        assert all(r["v"] == r["back"] and r["i"] == want.get(r["v"]) for r in back)
        with pytest.raises(PySparkException, match="unseen label: nobody"):
            d.encode(df.union(spark.range(1).select("id", F.lit("nobody"))), "v", "i", broadcast_rows=limit).collect()
    plan = d.in_plan()
    assert plan.classes == tuple(sorted(want))
    assert spark.range(1).select(plan.decode(plan.encode(F.lit("c\u00e919999")))).first()[0] == "c\u00e919999"
    assert plan.table(spark).count() == n


def test_dictionary_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v string")
    d = Dictionary.fit(df, "v")
    assert d.size == 0 and d.encode(df, "v", "i").collect()[0]["i"] is None
