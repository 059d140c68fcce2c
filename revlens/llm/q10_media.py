"""Query op10: recordings of all embeddings, those of ids divisible by 100 aligned against all.

The tables hold no audio. Each embedding is rendered as a row of chords of a
fifth of a second each, whose twelve tones have amplitudes from its components,
so that embeddings that are alike sound alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import media
from revlens.session import Scratch, arrow_rows

RATE, STEP, CHORDS = 4000, 800, 32


def _tones() -> np.ndarray:
    at = np.arange(STEP) / RATE
    return np.stack([np.sin(2 * np.pi * 220 * 2 ** (p / 12) * at) for p in range(12)])


def render(vector: list[float], tones: np.ndarray) -> bytes:
    """16-bit samples of the chords; each component drives several tones."""
    v = np.array(vector, dtype=float)
    v = v / np.sqrt((v**2).mean())
    part = (5 * np.arange(12)[None, :] + 7 * np.arange(CHORDS)[:, None]) % len(v)
    amplitude = np.exp(0.8 * np.clip(v[part], -3, 3))
    return ((amplitude / amplitude.sum(1, keepdims=True)) @ tones * 30000).astype("<i2").tobytes()


def audio_of(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding) with ``audio`` in place of the embedding; null where it is not a vector of finite numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tones = _tones()
        for batch in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):  # a recording is some 50 KB
            out = []
            for value in batch.column(1).to_pylist():
                if not value or any(x is None or not np.isfinite(x) for x in value) or not any(value):
                    out.append(None)
                    continue
                out.append(render(value, tones))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "audio"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, audio binary")


#: Matches of a row at most, about; a query with more has several rows.
BLOCK = 4096


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and block of its matches: lists of the classes matched, their offsets and bit errors, and rows of each class."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    spread = vectors.repartition(max(vectors.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    prints = media.fingerprint(audio_of(spread), rate=RATE)
    asks = F.col("vec_id") % 100 == 0
    with arrow_rows(spark, 128):
        found = Scratch(spark, "media").save(media.align(prints, asks, row_id="vec_id"), "found")
    sizes = found.groupBy("query_id").agg(F.count("*").alias("n_matches"))
    queries = vectors.where(asks).select(F.col("vec_id").alias("query_id")).join(sizes, "query_id", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    dealt = queries.join(found, "query_id", "left").withColumn("block", F.pmod(F.xxhash64("match_id"), F.ceil((F.col("n_matches") + 1) / F.lit(BLOCK))).cast("int"))
    match = F.when(F.col("match_id").isNotNull(), F.struct("match_id", "n_copies", "offset", "n_votes", "bit_error"))
    lists = dealt.groupBy("query_id", "n_matches", "block").agg(F.sort_array(F.collect_list(match)).alias("m"))
    return lists.select("query_id", "block", "n_matches", *[F.col(f"m.{c}").alias(c) for c in ("match_id", "n_copies", "offset", "bit_error")])
