"""Query op1: the language of every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import language
from revlens.llm.folds import held_out


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    return language.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
