"""The split between rows that models learn from and rows held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.session import Scratch


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What makes two rows the same to a sample: id and text, nulls alike."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text))


def least_hashed(rows: DataFrame, group: str, limit: int, groups: int) -> DataFrame:
    """Of each value of ``group``, the ``limit`` least distinct values of ``key`` (a hash), as group, ``key`` and ``rank``.

    Repeated keys count once, so rows that share an id or repeat take no other
    row's place. Only hashes below a threshold are ranked, set for each value so
    that about four times ``limit`` distinct ones pass; a value of few distinct
    keys has all of them ranked. More than ``groups`` values is an error: none
    is left out, and what this returns has ``limit * groups`` small rows at most.
    """
    rows = rows.where(F.col(group).isNotNull()).select(group, "key")
    counts = rows.groupBy(group).agg(F.approx_count_distinct("key").alias("n")).limit(groups + 1).collect()
    if len(counts) > groups:
        raise ValueError(f"more than {groups} values of {group}")
    tops = [(r[group], (1 << 63) - 1 if r["n"] <= 16 * limit else int(-(1 << 63) + 4 * limit / r["n"] * (1 << 64))) for r in counts]
    tops = rows.sparkSession.createDataFrame(tops, f"{group} {rows.schema[group].dataType.simpleString()}, top long")
    few = rows.join(F.broadcast(tops), group).where(F.col("key") <= F.col("top")).groupBy(group, "key").agg(F.lit(1).alias("one"))
    order = W.partitionBy(group).orderBy("key")
    return few.select(group, "key", F.row_number().over(order).alias("rank")).where(F.col("rank") <= limit)


def labelled_sample(docs: DataFrame, truth: DataFrame, group: str, limit: int, groups: int, scratch: Scratch) -> DataFrame:
    """Texts of the ``limit`` least hashed distinct rows of each value of ``group``: group, key, rank, text.

    ``docs`` (doc_id, text) meet ``truth`` (doc_id, group) by id and hash alone; no text is shuffled that is not chosen.
    """
    known = docs.select("doc_id", row_key().alias("key")).join(truth, "doc_id").select(group, "key")
    known = scratch.save(known.groupBy(group, "key").agg(F.lit(1).alias("one")).drop("one"), "known")
    chosen = F.broadcast(least_hashed(known, group, limit, groups))  # at most limit * groups small rows
    sample = docs.select("text", row_key().alias("key")).join(chosen, "key").groupBy(group, "key", "rank").agg(F.first("text").alias("text"))
    return sample
