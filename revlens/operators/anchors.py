"""Linking inspection rows to places on the old revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import geometry as G
from revlens.functions import text as X

CONTEXT_RADIUS, LEAST_SCORE = 150.0, 0.2


def latest_requirements(form3: DataFrame) -> DataFrame:
    """One row per characteristic: its last requirement at its first position."""
    return form3.groupBy("drawing_id", "char_no").agg(F.max_by("requirement", "row_ord").alias("requirement"), F.min("row_ord").alias("row_ord"))


def ballooned(form3: DataFrame, balloons: DataFrame) -> DataFrame:
    """Characteristics that have a balloon; others vanish."""
    b = balloons.select("drawing_id", "char_no", F.col("page_index").alias("page"), *G.named(G.box(), "b"))
    return latest_requirements(form3).join(b, ["drawing_id", "char_no"])


def page_extent(spans: DataFrame) -> DataFrame:
    return spans.groupBy("drawing_id", "block_id").agg(F.coalesce(F.max("x1"), F.lit(1000.0)).alias("page_w"), F.coalesce(F.max("y1"), F.lit(1000.0)).alias("page_h"))


def outside_title_block(spans: DataFrame) -> DataFrame:
    """Spans (joined with their page extent) that may hold a requirement: no title block, not long, not blank."""
    title = (F.col("y0") > F.col("page_h") * 0.85) | (F.col("x0") > F.col("page_w") * 0.80)
    return spans.where(~title & (F.length("text") <= 100) & (F.trim("text") != ""))


def scored_spans(linked: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """Every ballooned characteristic against its page's spans. A span's block id is compared with the balloon's page index."""
    page = outside_title_block(spans.join(page_extent(spans), ["drawing_id", "block_id"]))
    page = X.with_tokens(page, "text", "s_").select("drawing_id", F.col("block_id").alias("page"), "span_ord", "x0", "y0", "x1", "y1", "s_words")
    rows = X.with_tokens(linked, "requirement", "a_").select(*linked.columns, "a_words").join(page, ["drawing_id", "page"], how)
    bcx, bcy = G.center(G.box("b"))
    cx, cy = G.center(G.box())
    both = F.size(F.array_intersect("a_words", "s_words"))
    either = F.size("a_words") + F.size("s_words") - both  # both sides are without repetitions
    jaccard = F.when(either > 0, both / either).otherwise(0.0)
    near = F.lit(1.0) / (F.lit(1.0) + G.distance(cx, cy, bcx, bcy) / 100.0)
    return rows.withColumn("score", 0.5 * jaccard + 0.4 * near - 0.1 * G.size_penalty(G.box()))


def best_spans(scored: DataFrame) -> DataFrame:
    """The best span of each characteristic, the first of equals, if it scores above the least."""
    order = F.struct("score", (-F.col("span_ord")).alias("early"))
    place = F.struct("span_ord", "score", *G.named(G.box(), "r"))
    best = scored.groupBy("drawing_id", "char_no").agg(F.max_by(place, order).alias("best")).where(F.col("best.score") > LEAST_SCORE)
    return best.select("drawing_id", "char_no", F.col("best.span_ord").alias("req_ord"), F.col("best.score").alias("req_score"), *[F.col(f"best.r{c}").alias(f"r{c}") for c in G.CORNERS])


def with_best(linked: DataFrame, spans: DataFrame) -> DataFrame:
    """Characteristics, one row each, with their best span if any. Their columns go through the aggregation, so they are computed once."""
    order = F.when(F.col("span_ord").isNotNull(), F.struct("score", (-F.col("span_ord")).alias("early")))
    place = F.struct("span_ord", "score", *G.named(G.box(), "r"))
    rest = [c for c in linked.columns if c not in ("drawing_id", "char_no")]
    rows = scored_spans(linked, spans, "left").groupBy("drawing_id", "char_no").agg(F.any_value(F.struct(*rest)).alias("own"), F.max_by(place, order).alias("best"))
    best = F.when(F.col("best.score") > LEAST_SCORE, F.col("best"))
    rows = rows.withColumn("best", best)
    return rows.select("drawing_id", "char_no", "own.*", F.col("best.span_ord").alias("req_ord"), F.col("best.score").alias("req_score"), *[F.col(f"best.r{c}").alias(f"r{c}") for c in G.CORNERS])


def with_center(anchors: DataFrame) -> DataFrame:
    """Centre of the requirement, or of the balloon where none was found."""
    (rx, ry), (bx, by) = G.center(G.box("r")), G.center(G.box("b"))
    return anchors.withColumns({"acx": F.coalesce(rx, bx), "acy": F.coalesce(ry, by)})


def with_contexts(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """Anchors with the words of all spans near each, the requirement's own included. The narrow spans are repeated, an anchor goes through once."""
    places = X.with_tokens(spans, "text", "s_").select("drawing_id", F.col("block_id").alias("page"), "s_words", ((F.col("x0") + F.col("x1")) / 2).alias("scx"), ((F.col("y0") + F.col("y1")) / 2).alias("scy"))
    near = G.cell_join(places, anchors, ["drawing_id", "page"], ("scx", "scy"), ("acx", "acy"), CONTEXT_RADIUS, "left")
    close = lambda x: F.when(F.col("dist") <= CONTEXT_RADIUS, x)
    rest = [c for c in anchors.columns if c not in ("drawing_id", "char_no")]
    words = F.sort_array(F.array_distinct(F.flatten(F.collect_list(close(F.col("s_words"))))))
    rows = near.groupBy("drawing_id", "char_no").agg(F.any_value(F.struct(*rest)).alias("own"), words.alias("context_words"), F.count(close(F.lit(1))).alias("n_context"))
    return rows.select("drawing_id", "char_no", "own.*", "context_words", "n_context")


def found_anchors(form3: DataFrame, balloons: DataFrame, spans: DataFrame) -> DataFrame:
    """Anchors without context words: characteristic, balloon and requirement place (nullable)."""
    anchors = with_center(with_best(ballooned(form3, balloons), spans))
    return anchors.withColumn("requirement_norm", X.norm_text(F.col("requirement"))).withColumnRenamed("row_ord", "anchor_ord")


def build_anchors(form3: DataFrame, balloons: DataFrame, spans: DataFrame) -> DataFrame:
    """Anchors: characteristic, balloon, requirement place (nullable) and context words."""
    return with_contexts(found_anchors(form3, balloons, spans), spans)
