"""Streams: new files get the next sequence numbers, new answers are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import text as X
from quern.runtime import ship


def number_files(spark: SparkSession, folder: str, registry: str, checkpoint: str, pattern: str = "*.pdf", once: bool = True) -> StreamingQuery:
    """Watches a folder; each new file is entered in the registry (sequence, path) with the next number, by path within a
    batch. A batch that is run again after a failure enters nothing twice: it skips paths the registry has."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder).select("path", "length")

    def enter(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        try:
            known = s.read.schema("sequence long, path string").parquet(registry)
            top = known.agg(F.max("sequence")).collect()[0][0] or 0
            new = batch.select("path").distinct().join(known, "path", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            top, new = 0, batch.select("path").distinct()
        # a micro-batch of file names is small; its numbering is one sort
        new.select((F.row_number().over(Window.orderBy("path")) + top).cast("long").alias("sequence"), "path").write.mode("append").parquet(registry)

    writer = source.writeStream.foreachBatch(enter).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_answers(spark: SparkSession, folder: str, schema: str, log: str, checkpoint: str, lateness: str = "60 days", once: bool = True) -> StreamingQuery:
    """Answers arriving as parquet files are appended to the log by model family; a line logged again, with the same answer
    for the same article and model, within the lateness is dropped by its state, which the watermark bounds."""
    ship(spark)
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("family", X.family(F.col("model_name")))
    fresh = rows.withWatermark("logged_at", lateness).dropDuplicatesWithinWatermark(["venue", "article_title", "model_name", "answered_at", "answer"])
    writer = fresh.writeStream.format("parquet").partitionBy("family").option("path", log).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
