"""Query op9: a toxicity score for every whole text of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import toxicity
from revlens.llm.folds import held_out


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return toxicity.fit(docs.where(~held_out()), labels)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity.with_passages(docs, learned(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
