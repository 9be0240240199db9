import itertools

import numpy as np

from babelcask.operators import curves


def _ovr(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, class int, score double, pos long")


def _auc_pairs(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return round(tot / (len(pos) * len(neg)), 6)


def _roc_brute(scores, labels):
    """Distinct thresholds descending, cumulative counts, collinear points dropped, origin first."""
    order = sorted(set(scores), reverse=True)
    tps, fps = [], []
    for t in order:
        tps.append(sum(1 for s, y in zip(scores, labels) if s >= t and y))
        fps.append(sum(1 for s, y in zip(scores, labels) if s >= t and not y))
    keep = [0] + [i for i in range(1, len(order) - 1)
                  if (tps[i + 1] - 2 * tps[i] + tps[i - 1]) or (fps[i + 1] - 2 * fps[i] + fps[i - 1])] \
        + ([len(order) - 1] if len(order) > 1 else [])
    pts = {(None, 0, 0)} | {(order[i], tps[i], fps[i]) for i in keep}
    return pts


def test_auc_matches_pair_count_with_ties(spark):
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 6, 60).astype(float).tolist()
    labels = (rng.random(60) < 0.4).astype(int).tolist()
    df = _ovr(spark, [(i, 0, s, y) for i, (s, y) in enumerate(zip(scores, labels))])
    assert curves.roc_auc(curves.roc_table(df)).first()["auc"] == _auc_pairs(scores, labels)


def test_roc_points_match_brute_force(spark):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 15, 80).astype(float).tolist()
    labels = (rng.random(80) < 0.5).astype(int).tolist()
    df = _ovr(spark, [(i, 0, s, y) for i, (s, y) in enumerate(zip(scores, labels))])
    got = {(r["threshold"], r["tp"], r["fp"]) for r in curves.roc_points(curves.roc_table(df, rows_per_part=7)).collect()}
    assert got == _roc_brute(scores, labels)


def test_auc_null_without_negatives(spark):
    df = _ovr(spark, [(1, 0, 0.5, 1), (2, 0, 0.2, 1), (1, 1, 0.1, 0), (2, 1, 0.3, 1)])
    r = {x["class"]: x["auc"] for x in curves.roc_auc(curves.roc_table(df)).collect()}
    assert r[0] is None and r[1] == 1.0


def test_two_classes_one_vs_rest(spark):
    df = spark.createDataFrame([(1, [5, 1], 0), (2, [0, 4], 1), (3, [2, 2], 1)],
                               "doc_id long, s array<bigint>, y int")
    ovr = curves.one_vs_rest(df, "s", "y", 2)
    assert ovr.count() == 6
    r = {x["class"]: x["auc"] for x in curves.roc_auc(curves.roc_table(ovr)).collect()}
    assert r[0] == 1.0 and r[1] == 1.0


def test_range_running_sums_equal_window_on_clustered_scores(spark):
    """Scores packed in a narrow range (where a fixed value scale gives one bucket) stay exact and spread."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from babelcask.operators.ranking import range_running_sums
    rng = np.random.default_rng(11)
    rows = [(int(c), float(0.5 + rng.random() * 1e-6), int(rng.integers(0, 3))) for c in rng.integers(0, 2, 3000)]
    df = spark.createDataFrame(rows, "class int, score double, p long").groupBy("class", "score").agg(
        F.sum("p").alias("p"))
    got = range_running_sums(df, ["class"], [F.col("score").desc()], {"tp": F.col("p")}, n_parts=16)
    w = Window.partitionBy("class").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("tp", F.sum("p").over(w))
    assert {tuple(r) for r in got.select("class", "score", "tp").collect()} == \
        {tuple(r) for r in want.select("class", "score", "tp").collect()}
    # every range partition holds a share of the rows: no bucket takes the whole class
    sizes = df.repartitionByRange(16, "class", F.col("score").desc()).groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] < df.count() / 4


def test_one_running_sum_for_points_and_areas(spark):
    rng = np.random.default_rng(2)
    df = _ovr(spark, [(i, i % 3, float(rng.integers(0, 40)), int(rng.random() < 0.3)) for i in range(500)])
    table = curves.roc_table(df)
    for out in (curves.roc_points(table), curves.roc_auc(table)):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    one, many = table, curves.roc_table(df, rows_per_part=20)
    for f in (curves.roc_points, curves.roc_auc):
        assert sorted(map(str, f(one).collect())) == sorted(map(str, f(many).collect()))
