import math

from pyspark.sql import functions as F

from babelcask.functions import scores


def test_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([1, 3, 3],), ([5, 1, 5],), ([-2, -1, -7],)], "s array<bigint>")
    assert [r[0] for r in df.select(scores.argmax("s")).collect()] == [1, 0, 1]


def test_margin(spark):
    df = spark.createDataFrame([([10, 4, 7],)], "s array<bigint>")
    r = df.select(scores.margin("s", 0), scores.margin("s", 1), scores.margin("s", 2)).first()
    assert tuple(r) == (3, -6, -3)


def test_micro_log(spark):
    r = spark.range(1).select(scores.micro_log(F.lit(1), F.lit(4))).first()[0]
    assert r == round(math.log(0.25) * 1e6)


def test_constant_logs_equal_column_logs(spark):
    from pyspark.sql import functions as F

    from babelcask.functions.scores import micro_log
    from babelcask.operators.bayes import NO_ROWS_PRIOR, _ln_micro_many
    pairs = [(1, 7), (67, 87), (0, 5), (2.5, 3), (11, 9), (3027, 3980)]
    want = spark.range(1).select(*[micro_log(F.lit(a), F.lit(b)) for a, b in pairs]).first()
    # a class without rows: the fixed floor instead of the logarithm of zero
    assert _ln_micro_many(spark, pairs) == [NO_ROWS_PRIOR if v is None else int(v) for v in want]
