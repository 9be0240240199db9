"""Saving and loading fitted models; results tables.

A fitted model is a folder: one parquet table per stage (keys, scores) and one
small JSON row per stage with its classes, keys, vocabulary size and priors.
Loading checks every part first and fails with one clear error, instead of
failing on the first missing file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelcask.operators.bayes import NaiveBayesModel
from babelcask.operators.encode import ClassDictionary
from babelcask.operators.trainer import TrainedModel
from babelcask.session import checkpoint_dir

STAGES = ("language", "sentiment")


class ModelNotTrained(FileNotFoundError):
    pass


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end (``_SUCCESS``), not only begun."""
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(conf).exists(p)


def _require(spark: SparkSession, parts: list[str]) -> None:
    missing = [p for p in parts if not _complete(spark, p)]
    if missing:
        raise ModelNotTrained("Model not trained: missing " + ", ".join(missing))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return checkpoint_dir(spark).rstrip("/") + f"/{kind}/{uuid.uuid4().hex}"


def _meta(model: NaiveBayesModel) -> str:
    return json.dumps({"classes": model.classes, "keys": model.keys, "rows": model.rows, "vocab": model.vocab,
                       "priors": model.priors, "slice_col": model.slice_col})


def save_stage(model: NaiveBayesModel, path: str) -> None:
    spark = model.table.sparkSession
    model.table.write.mode("error").parquet(f"{path}/table")
    spark.createDataFrame([(_meta(model),)], "meta string").coalesce(1).write.mode("error").text(f"{path}/meta")


def load_stage(spark: SparkSession, path: str) -> NaiveBayesModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return NaiveBayesModel(tuple(meta["classes"]), tuple(meta["keys"]), spark.read.parquet(f"{path}/table"),
                           meta["rows"], tuple(meta["vocab"]), tuple(tuple(p) for p in meta["priors"]), meta["slice_col"])


def save_cascade(model, path: str) -> str:
    save_stage(model.language, f"{path}/language")
    save_stage(model.sentiment, f"{path}/sentiment")
    return path


def load_cascade(spark: SparkSession, path: str):
    """Load a saved cascade; raise :class:`ModelNotTrained` naming every missing part."""
    from babelcask.plans.cascade import CascadeModel

    _require(spark, [f"{path}/{s}/{p}" for s in STAGES for p in ("table", "meta")])
    lang = load_stage(spark, f"{path}/language")
    sent = load_stage(spark, f"{path}/sentiment")
    return CascadeModel(lang, sent, ClassDictionary(lang.classes), ClassDictionary(sent.classes))


def save_baseline(model: NaiveBayesModel, path: str) -> str:
    save_stage(model, f"{path}/baseline")
    return path


def load_baseline(spark: SparkSession, path: str) -> tuple[NaiveBayesModel, ClassDictionary]:
    """Load a saved one-stage model with its class dictionary."""
    _require(spark, [f"{path}/baseline/{p}" for p in ("table", "meta")])
    model = load_stage(spark, f"{path}/baseline")
    return model, ClassDictionary(model.classes)


def save_trained(model: TrainedModel, path: str) -> str:
    """Regression, classes and losses of the iterative trainer."""
    spark = SparkSession.active()
    model.regression.write().save(f"{path}/regression")
    meta = json.dumps({"classes": model.classes.classes, "losses": model.losses, "slots": model.slots})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("error").text(f"{path}/meta")
    return path


def load_trained(spark: SparkSession, path: str) -> TrainedModel:
    _require(spark, [f"{path}/meta", f"{path}/regression/data", f"{path}/regression/metadata"])
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return TrainedModel(LogisticRegressionModel.load(f"{path}/regression"), ClassDictionary(tuple(meta["classes"])),
                        tuple(meta["losses"]), meta["slots"])


def write_results(predictions: DataFrame, metrics: DataFrame, path: str) -> tuple[str, str]:
    """Results as two parquet tables: per-row predictions and (metric, value) rows."""
    predictions.write.mode("error").parquet(f"{path}/predictions")
    metrics.write.mode("error").parquet(f"{path}/metrics")
    return f"{path}/predictions", f"{path}/metrics"


def metrics_rows(wide: DataFrame, names=("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """One-row metrics frame -> (metric, value) rows."""
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")
    ).select("m.metric", "m.value")
