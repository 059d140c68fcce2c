"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import q01_language, q02_byte_bpe, q03_secrets, q04_line_dedup, q05_suffix_dedup, q06_embedding_dedup, q07_mixing, q08_ngram_join, q09_toxicity, q10_media
from revlens.session import ship


def _shipped(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict:
    found = {
        "op1_language": q01_language.run,
        "op2_byte_bpe": q02_byte_bpe.run,
        "op3_secrets": q03_secrets.run,
        "op4_line_dedup": q04_line_dedup.run,
        "op5_suffix_dedup": q05_suffix_dedup.run,
        "op6_embedding_dedup": q06_embedding_dedup.run,
        "op7_mixing": q07_mixing.run,
        "op8_ngram_join": q08_ngram_join.run,
        "op9_toxicity": q09_toxicity.run,
        "op10_media": q10_media.run,
    }
    return {name: _shipped(run) for name, run in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": q03_secrets.SQL, "op4_line_dedup": q04_line_dedup.SQL}
