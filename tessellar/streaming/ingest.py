"""New files as a stream, and the review log's latest verdicts, kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.documents import elements


def new_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(path, body) of text files as they arrive."""
    return spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_batch).load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def extract_new(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Elements of new HTML files, appended as they arrive; what cannot be read is a row with its error."""
    rows = elements(new_files(spark, folder), ["path"], "body", "html")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_verdicts(log: DataFrame, anchor: str, at: str, late: str = "1 day") -> DataFrame:
    """Of a stream of reviews, the first within the watermark of each (anchor, time), so that a replay adds nothing."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark([anchor, at])


def counts_by_window(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"))


def keep_latest(batch: DataFrame, held: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For foreachBatch: held rows and a batch's, the last of each key."""
    rows = held.select(*by, *columns).unionByName(batch.select(*by, *columns))
    pick = F.max_by(F.struct(*[c for c in columns]), F.struct(*order)).alias("_r")
    return rows.groupBy(*by).agg(pick).select(*by, *[F.col("_r")[c].alias(c) for c in columns])
