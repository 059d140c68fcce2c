"""Line dedup by overlapping windows of consecutive lines, in column expressions only.

Each run of ``width`` consecutive lines is hashed to 128 bits; a window's first
place in the corpus is the least (doc_id, line). Every later place covers its
lines, and covered lines go. A line's first place in the corpus is never
covered, so no line is lost altogether.

Defined results: null texts stay null; texts of fewer lines than a window, and
windows of blank lines only, are left alone; a text all of whose lines are
covered becomes empty. Rows that repeat id and text are one place: they are
treated alike. A null id comes before all others. Other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import Scratch


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: str, width: int) -> Column:
    """Array of struct(line, h1, h2, blank) over an array column that is already materialised."""
    columns = [F.slice(lines, F.lit(k + 1), F.greatest(F.size(lines) - width + 1, F.lit(0))) for k in range(width)]
    zipped = F.arrays_zip(*[c.alias(f"l{k}") for k, c in enumerate(columns)])

    def at(z: Column, i: Column) -> Column:
        parts = [z[f"l{k}"] for k in range(width)]
        return F.struct(i.alias("line"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(width), *parts).alias("h2"), reduce(lambda a, b: a & b, [F.trim(p) == "" for p in parts]).alias("blank"))

    return F.filter(F.transform(zipped, at), lambda w: ~w["blank"])


def dedup(frame: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, by_text: bool = False) -> DataFrame:
    """``frame`` with its text deduplicated, ``n_lines`` and ``n_removed`` (long). ``by_text``: texts that share an id are documents of their own."""
    place = ["_id", "line", "_digest"] if by_text else ["_id", "line"]
    keyed = frame.select("*", F.xxhash64(text).alias("_digest"))
    # a generator of one row keeps the optimizer from splitting the text anew for every line
    split = keyed.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), "_digest", F.explode(F.array(_lines(F.col(text)))).alias("_lines"))
    places = split.select("_id", "_digest", F.explode(_windows("_lines", width)).alias("w"))
    # read twice below: once for the first places, once for the later ones
    places = Scratch(frame.sparkSession, "lines").save(places.select("_id", "_digest", F.col("w.line").alias("line"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")), "places")
    first = places.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"), F.max(F.struct(*place)).alias("last")).where(F.col("first") != F.col("last")).drop("last")
    later = places.join(first, ["h1", "h2"]).where(~F.struct(*place).eqNullSafe(F.col("first")))
    covered = later.groupBy("_id", "_digest", "line").agg(F.lit(1).alias("_one")).groupBy("_id", "_digest").agg(F.collect_list("line").alias("_starts"))
    covered = covered.select(F.col("_id").alias("_c_id"), F.col("_digest").alias("_c_digest"), "_starts")
    joined = keyed.join(covered, F.col(doc_id).eqNullSafe(F.col("_c_id")) & (F.col("_digest") == F.col("_c_digest")), "left")
    joined = joined.select("*", F.explode(F.array(F.when(F.col(text).isNotNull(), _lines(F.col(text))))).alias("_lines"))
    hidden = F.flatten(F.transform("_starts", lambda s: F.array(*[s + k for k in range(width)])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), hidden)
    joined = joined.select("*", F.explode(F.array(F.when(F.col("_starts").isNotNull(), kept))).alias("_kept"))
    shown = F.array_join(F.transform("_kept", lambda i: F.col("_lines")[i]), "\n")
    touched = F.col("_kept").isNotNull() & F.col(text).isNotNull()
    return joined.select(
        *[F.when(touched, shown).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in frame.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.when(touched, F.size("_lines") - F.size("_kept")).otherwise(0).cast("long").alias("n_removed"),
    )
