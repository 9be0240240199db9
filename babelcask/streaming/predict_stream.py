"""Cascade prediction on a stream of documents.

Scoring is stateless per document, but it groups the (document, gram) rows
of each document back together; on a stream that grouping would need state.
Each micro-batch is a bounded DataFrame, so the batch plan runs inside
``foreachBatch`` with the fitted model as a static side, and the results are
written to a parquet sink.  The stream's checkpoint logs the input files of
each batch id before the batch runs, so a batch replayed after a failure has
the same input; each batch overwrites its own folder ``batch_id=<id>``, so a
replay replaces a partial or finished earlier attempt instead of adding its
rows a second time.  The sink is read as one table (``read_predictions``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from babelcask.plans.cascade import CascadeModel, predict

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def start_prediction_stream(spark: SparkSession, model: CascadeModel, source_dir: str, sink_dir: str,
                            checkpoint: str, schema: T.StructType = DOC_SCHEMA, available_now: bool = True,
                            max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        predict(model, batch).write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_predictions(spark: SparkSession, sink_dir: str, schema: T.StructType = DOC_SCHEMA) -> DataFrame:
    """Every batch of the sink: the stream's id, predicted_language, predicted_sentiment, batch_id.

    ``schema``: the stream's schema; a sink that no batch has written yet has no rows.
    """
    names = [*schema.fieldNames()[:1], "text"]
    columns = T.StructType([schema[names[0]], *(T.StructField(c, T.StringType()) for c in (
        "text", "predicted_language", "predicted_sentiment")), T.StructField("batch_id", T.LongType())])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink_dir)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(sink_dir)
