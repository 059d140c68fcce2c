"""Fingerprints of text spans as they arrive.

The fingerprint reads one row at a time, so the batch expressions serve a
stream unchanged: no state, no watermark. Reconciliation itself needs all spans
of a drawing and stays a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from revlens.functions import text as X


def read_spans(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files of spans that land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def fingerprints(spans: DataFrame) -> DataFrame:
    return X.with_tokens(spans, "text", "s_")


def write_available(spans: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what has arrived since the last call, each file once."""
    fingerprints(spans).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
