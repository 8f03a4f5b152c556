"""Streaming masks: a stateless map in append mode (STR1-3), and one time-windowed extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskloom.operators.detect import Detector
from maskloom.operators.structured import mask_json


def mask_stream(stream: DataFrame, column: str, detector: Detector, style: str = "tag", into: str = "masked") -> DataFrame:
    """A stream (or table) with a masked copy of a text column; batch and stream give the same rows."""
    return stream.withColumn(into, detector.mask(F.col(column), style))


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exactly-once Parquet output; with ``once`` the query ends when the input there is now is done."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def mask_jsonl_stream(stream: DataFrame, column: str, detector: Detector, path: str, checkpoint: str,
                      style: str = "tag", strict: bool = False) -> StreamingQuery:
    """JSON documents masked micro-batch by micro-batch; a batch's files appear whole or not at all (STR2)."""

    def put(batch: DataFrame, number: int) -> None:
        masked = mask_json(batch, column, detector, style, strict)
        masked.select(F.col(column).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finding_counts(stream: DataFrame, column: str, at: str, detector: Detector, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Extension: findings by entity and time window, with a watermark for late rows."""
    found = stream.withWatermark(at, late).select(at, F.explode(detector.findings(F.col(column))).alias("f"))
    return found.groupBy(F.window(at, window).alias("w"), F.col("f.entity").alias("entity")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "entity", "n")
