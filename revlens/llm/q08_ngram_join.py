"""Query op8: three-word shingle sets of all documents, linked at Jaccard 0.9 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import ngram_join


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join.join(docs, n=3, num=9, den=10).select("doc_id", "n_shingles", "component_id", "n_links")
