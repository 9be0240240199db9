from pyspark.sql import functions as F

from babelcask.operators import metrics


def _pairs(spark, pairs):
    return spark.createDataFrame(pairs, "y int, yhat int")


def test_weighted_prf_hand_case(spark):
    df = _pairs(spark, [(0, 0), (0, 0), (1, 0), (2, 2)])
    r = metrics.weighted_prf(df).first()
    assert r["accuracy"] == 0.75
    assert r["precision"] == 0.583333
    assert r["recall"] == 0.75
    assert r["f1"] == 0.65


def test_class_report_zero_division(spark):
    df = _pairs(spark, [(0, 0), (0, 0), (1, 0), (2, 2)])
    rep = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert set(rep) == {0, 1, 2}
    assert rep[1]["precision"] == 0.0 and rep[1]["recall"] == 0.0 and rep[1]["f1"] == 0.0
    assert rep[0]["precision"] == 0.666667 and rep[0]["recall"] == 1.0 and rep[0]["f1"] == 0.8
    assert rep[2]["support"] == 1


def test_class_only_predicted_is_reported(spark):
    df = _pairs(spark, [(0, 0), (0, 3)])
    rep = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert rep[3]["support"] == 0 and rep[3]["precision"] == 0.0


def test_report_totals(spark):
    df = _pairs(spark, [(0, 0), (0, 0), (1, 0), (2, 2)])
    t = {r["row"]: r for r in metrics.report_totals(df).collect()}
    assert t["accuracy"]["f1"] == 0.75 and t["accuracy"]["support"] == 4
    assert t["macro avg"]["recall"] == round((1 + 0 + 1) / 3, 6)
    assert t["weighted avg"]["f1"] == 0.65


def test_metrics_by_key(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("b", 1, 1)], "k string, y int, yhat int")
    r = {x["k"]: x for x in metrics.weighted_prf(df, by=["k"]).collect()}
    assert r["a"]["accuracy"] == 0.5 and r["b"]["accuracy"] == 1.0


def test_eval_loss_uniform(spark):
    # equal scores over 4 classes: loss is ln 4
    df = spark.createDataFrame([([0, 0, 0, 0], 2)], "scores array<bigint>, y_id int")
    assert metrics.eval_loss(df).first()[0] == round(1.3862943611198906, 6)


def test_full_report_holds_every_class_of_the_dictionary(spark):
    df = spark.createDataFrame([("en", "a", "a"), ("en", "a", "b"), ("fr", "b", "b")], "l string, y string, yhat string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "value string")
    got = {r["class"]: r for r in metrics.full_report(df, classes).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["c"]["f1"], got["c"]["support"], got["c"]["in_data"]) == (0.0, 0, False)
    assert (got["a"]["recall"], got["a"]["support"], got["a"]["in_data"]) == (0.5, 2, True)
    by = {(r["l"], r["class"]): (r["support"], r["in_data"]) for r in metrics.full_report(df, classes, by=["l"]).collect()}
    assert by == {("en", "a"): (2, True), ("en", "b"): (0, True), ("en", "c"): (0, False),
                  ("fr", "a"): (0, False), ("fr", "b"): (1, True), ("fr", "c"): (0, False)}
