"""Query op7: document rates that bring language-by-quality domains to tempered weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import mixing


def domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table: language and quality of each labelled document."""
    quality = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality")
    return docs.select("doc_id", "lang").join(quality, "doc_id").where(F.col("lang").isNotNull()).select("doc_id", F.concat_ws(":", "lang", F.col("quality").cast("string")).alias("domain"))


def targets(natural: np.ndarray, domains: list[str]) -> np.ndarray:
    """Languages are tempered among texts of good quality; texts of poor quality keep their tokens."""
    good = np.array([not d.endswith(":0") for d in domains])
    goal = natural.copy()
    goal[good] = mixing.tempered(natural[good], [d for d, g in zip(domains, good, strict=True) if g])
    return goal


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    mixer = mixing.mix(docs, domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), target=targets)
    return mixing.assign(docs.select("doc_id", "text"), mixer).select("doc_id", "n_tokens", "domain", "rate", "copies")
