"""Balloons: numbered circles that tie inspection rows to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.functions import geometry as G

LOW, HIGH, GATE = 1, 200, 3


def digit_tokens(spans: DataFrame) -> DataFrame:
    """Tokens of spans that are plain numbers in range, each with its share of the span's box (t*)."""
    tokens = F.filter(F.split(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "), " "), lambda t: t != "")
    rows = spans.withColumn("_tokens", tokens).select("*", F.posexplode("_tokens").alias("token_pos", "token")).withColumn("n_tokens", F.size("_tokens")).drop("_tokens")
    rows = rows.where(F.col("token").rlike("^[0-9]+$") & F.coalesce(F.col("token").try_cast("int").between(LOW, HIGH), F.lit(False)))
    return rows.select("*", F.col("token").cast("int").alias("char_no"), *G.named(G.token_box(G.box(), F.col("token_pos"), F.col("n_tokens")), "t"))


def balloon_shape(b: G.Box) -> Column:
    w, h = b[2] - b[0], b[3] - b[1]
    return w.between(5, 50) & h.between(5, 50) & (w / h).between(0.3, 2.0)


def text_balloons(spans: DataFrame, circle: Column) -> DataFrame:
    """The text lane: number tokens of balloon shape with a circle around them."""
    rows = digit_tokens(spans).where(balloon_shape(G.box("t")) & circle)
    return rows.select("drawing_id", "page", F.col("span_ord").alias("det_ord"), "token_pos", "char_no", *[F.col(f"t{c}").alias(c) for c in G.CORNERS], F.lit("pdf_text").alias("method"), F.when(F.col("n_tokens") > 1, 0.85).otherwise(0.9).alias("confidence"))


def sparse_pages(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Pages on which the text lane found too few: only these go to the vision lane."""
    counts = hits.groupBy("drawing_id", "page").agg(F.count("*").alias("n"))
    return pages.join(counts, ["drawing_id", "page"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < GATE)


def detections(text_lane: DataFrame, vision_lane: DataFrame) -> DataFrame:
    return text_lane.unionByName(vision_lane, allowMissingColumns=True)


def dedupe(hits: DataFrame) -> DataFrame:
    """The most confident detection of each number; the first of equals; in order of first sighting."""
    first = F.min("det_ord").alias("seen_ord")
    best = F.max_by(F.struct("page_index", *G.CORNERS, "method", "confidence", "det_ord"), F.struct("confidence", -F.col("det_ord"))).alias("b")
    return hits.groupBy("drawing_id", "char_no").agg(first, best).select("drawing_id", "char_no", "seen_ord", "b.*")


def numbers_per_page(spans: DataFrame) -> DataFrame:
    order = W.partitionBy("drawing_id", "page").orderBy("span_ord", "token_pos")
    return digit_tokens(spans).withColumn("hit", F.row_number().over(order))
