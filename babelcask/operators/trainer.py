"""Iterative trainer and user-model hook.

``fit`` is the iterative counterpart of fine-tuning: multinomial logistic
regression (``pyspark.ml``) on sparse vectors, whose passes over the data are
``max_iter``; every pass leaves its loss.  The vectors are made from the
(document, gram, n) counts, not from texts: a gram goes to a slot of a feature
space of fixed size by its md5, counts add up per (document, slot), and one
row per document is written as a sparse vector, so a pass reads small numeric
rows back (and a lost executor costs reading them again), never strings.

``batch_scores`` runs a user's own model over Arrow batches with
``predict_batch_udf``: the model is built once per Python worker and fed
column batches, the Spark counterpart of a batched ``map`` with a forward pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from babelcask.operators.encode import ClassDictionary
from babelcask.session import checkpoint_dir

HASH_FEATURES = 1 << 18


def slot_of(gram, slots: int = HASH_FEATURES) -> Column:
    """Feature slot of a gram: the first 32 bits of its md5, modulo the size of the feature space."""
    return (F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def slot_counts(feats: DataFrame, ids=("doc_id",), slots: int = HASH_FEATURES) -> DataFrame:
    """(ids..., entries array<struct<slot, n>>) per document, sorted by slot; grams that share a slot add up.

    Both aggregations are by document: no shuffle of a count table that is bucketed by it.
    """
    some = F.col("gram").isNotNull()
    per_slot = feats.groupBy(*ids, F.when(some, slot_of("gram", slots)).alias("slot")).agg(F.sum("n").alias("n"))
    return per_slot.groupBy(*ids).agg(F.array_sort(F.collect_list(
        F.when(F.col("slot").isNotNull(), F.struct("slot", "n")))).alias("entries"))


def vectors(feats: DataFrame, ids=("doc_id",), slots: int = HASH_FEATURES) -> DataFrame:
    """(ids..., features): sparse vectors, written once in the shared folder and read back as such."""
    spark = feats.sparkSession
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(slots).alias("size"),
                      F.transform("entries", lambda e: e["slot"]).alias("indices"),
                      F.transform("entries", lambda e: e["n"].cast("double")).alias("values"))
    rows = slot_counts(feats, ids, slots).select(*ids, sparse.alias("features"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/vectors_{uuid.uuid4().hex[:16]}"
    rows.write.parquet(path)
    # a vector column is stored as this very struct, so the files read as vectors under a vector schema
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


@dataclass
class TrainedModel:
    """A fitted regression, its classes in order, and the loss before the first and after every pass."""
    regression: LogisticRegressionModel
    classes: ClassDictionary
    losses: tuple[float, ...]
    slots: int

    def predict(self, vecs: DataFrame, out: str = "predicted_label") -> DataFrame:
        scored = self.regression.transform(vecs)
        return scored.withColumn(out, self.classes.decode(F.col("prediction").cast("int"))).drop("prediction", "probability")


def fit(train: DataFrame, classes: ClassDictionary, label_col: str = "label", max_iter: int = 10, reg: float = 0.0) -> TrainedModel:
    """``train``: (label, features) rows of ``vectors``."""
    rows = train.select(classes.encode(label_col).cast("double").alias("label_idx"), "features")
    regression = LogisticRegression(featuresCol="features", labelCol="label_idx", family="multinomial",
                                    maxIter=max_iter, regParam=reg).fit(rows)
    return TrainedModel(regression, classes, tuple(regression.summary.objectiveHistory), regression.numFeatures)


def losses_frame(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """(pass, loss): one row before the first pass (0) and one per pass."""
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.losses)], "pass int, loss double")


def batch_scores(df: DataFrame, input_col: str, make_predict_fn: Callable, dim: int,
                 batch_size: int = 1024, out: str = "scores") -> DataFrame:
    """Scores of a user model on Arrow batches of ``input_col`` (an array column of length ``dim``)."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[dim]])
    return df.withColumn(out, udf(F.col(input_col)))


# Largest table of centroids that is handed to the workers.
MAX_CENTROID_BYTES = 64 << 20


def class_centroids(df: DataFrame, vector_col: str, label_col: str, max_bytes: int = MAX_CENTROID_BYTES) -> tuple[list, np.ndarray]:
    """(classes in order, their mean vectors): counted first, so what comes to the driver has a checked size."""
    rows = df.where(F.col(vector_col).isNotNull() & F.col(label_col).isNotNull())
    size = rows.agg(F.count_distinct(label_col).alias("k"), F.max(F.size(vector_col)).alias("dim")).first()
    k, dim = int(size["k"] or 0), int(size["dim"] or 0)
    if 8 * k * dim > max_bytes:
        raise ValueError(f"{k} centroids of {dim} numbers pass the limit of {max_bytes} bytes")
    means = rows.groupBy(label_col).agg(*[F.avg(F.col(vector_col)[i]).alias(f"c{i}") for i in range(dim)]).orderBy(label_col)
    got = means.collect()
    return [r[0] for r in got], np.array([list(r)[1:] for r in got], dtype=np.float64).reshape(k, dim)


def nearest_centroid_fn(centroids: np.ndarray) -> Callable:
    """A small user model: scores are minus the squared distance to each class centroid."""
    def make():
        c = np.asarray(centroids, dtype=np.float64)

        def predict(x: np.ndarray) -> np.ndarray:
            x = np.asarray(x, dtype=np.float64)
            d = (x * x).sum(1)[:, None] - 2.0 * x @ c.T + (c * c).sum(1)[None, :]
            return -d
        return predict
    return make
