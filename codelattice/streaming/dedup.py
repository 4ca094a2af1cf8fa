"""Streams of entry files: duplicates dropped within a watermark, so state stays bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ENTRY


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of entries as they arrive, with the time of arrival."""
    return spark.readStream.schema(ENTRY).parquet(path).withColumn("seen", F.current_timestamp())


def unique(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row for each entry within the delay; the key is a digest of the whole entry, so state doesn't hold values."""
    key = F.sha2(F.to_json(F.struct("source", "edge_kind", "target", "fact_name", F.base64("fact_value").alias("v"))), 384)
    return stream.withColumn("digest", key).withWatermark("seen", delay).dropDuplicatesWithinWatermark(["digest"]).drop("digest", "seen")
