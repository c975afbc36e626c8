"""Captions as a stream: score, filter, drop urls seen within the watermark, append to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import curate


def accepted_captions(stream: DataFrame, time: str = "ts", late: str = "1 hour", mode: str = "strict") -> DataFrame:
    """``stream`` (caption, url and a time) filtered by score; the state holds the urls of ``late`` alone."""
    kept = curate.filtered(stream.withWatermark(time, late), mode=mode).where("accepted")
    return kept.where(F.col("url") != "").dropDuplicatesWithinWatermark(["url"])


def run(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Read Parquet files as they come and append what is accepted; the checkpoint resumes it."""
    stream = spark.readStream.schema(schema).parquet(source)
    return accepted_captions(stream, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
