"""Query op6: near-duplicates among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import embedding_dedup


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
