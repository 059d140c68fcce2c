"""The corpus pipeline: from raw documents to token ids.

Stages, each over all that its predecessor kept: documents with toxic passages
go; repeated three-line windows are cut, and a document that this empties goes;
one document of each group of near duplicates (five-word shingles, Jaccard 0.8
or more) stays; documents are repeated to bring language-by-quality domains to
tempered weights, each at least once; texts become token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import byte_bpe, line_dedup, mixing, ngram_join, q07_mixing, q09_toxicity, toxicity
from revlens.llm.q02_byte_bpe import VOCABULARY
from revlens.session import Scratch, ship

#: None: learned models, components and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below one half."""
    ship(spark)
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = q09_toxicity.learned(spark, raw, sf_dir)
    return toxicity.with_passages(docs, model, keep_text=True).where(F.col("score") < 0.5).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; n_chars follows the text."""
    done = line_dedup.dedup(docs, by_text=True)
    emptied = (F.col("n_removed") > 0) & (F.length("text") == 0)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(~emptied).withColumn("n_chars", changed).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one of least id, once. Id and text together are a document, nulls alike and last."""
    ship(spark)
    named = docs.withColumn("_doc", F.xxhash64("doc_id", "text"))
    joined = ngram_join.join(named.drop("doc_id"), doc_id="_doc", n=5, num=4, den=5).select(F.col("doc_id").alias("_doc"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_doc")).alias("first")
    kept = named.select("_doc", "doc_id").join(joined, "_doc").groupBy("component_id").agg(first).select(F.col("first._doc").alias("_doc"))
    return named.join(kept, "_doc", "left_semi").dropDuplicates(["_doc"]).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their fitted rates."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixer = mixing.mix(docs, q07_mixing.domains(docs, labels), target=q07_mixing.targets)
    mixed = mixing.assign(docs, mixer, keep_text=True)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the text by its ids, their number, the byte where each piece starts, and the digest of what the ids decode to."""
    ship(spark)
    path = public_tokenizers.path(VOCABULARY)
    decoded = byte_bpe.decode(byte_bpe.encode(docs, path, offsets="offsets"), path, out="decoded", offsets="offsets")
    return decoded.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2("decoded", 256)}).drop("decoded")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_domains),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
