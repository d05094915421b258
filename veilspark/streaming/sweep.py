"""The first sweep and routing counts over a stream of documents.

The sweep is a projection without state, so it runs as it is. Counts are windowed on event time with a watermark, so
state stays bounded and late rows beyond it are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.fusion import sweep


def document_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def swept(stream: DataFrame, text_col: str = "full_text") -> DataFrame:
    return sweep(stream, text_col)


def route_counts(stream: DataFrame, time_col: str, window: str = "1 day", late: str = "2 days", text_col: str = "full_text") -> DataFrame:
    """(start, route, n) per window of event time."""
    rows = swept(stream.withWatermark(time_col, late), text_col)
    return rows.groupBy(F.window(time_col, window).alias("w"), "route").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "route", "n")


def write_swept(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the swept rows; stops when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
