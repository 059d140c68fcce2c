"""Query op2: every whole text of documents, encoded and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from revlens.llm import byte_bpe

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path, offsets="offsets"), path, offsets="offsets"))
