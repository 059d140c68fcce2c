"""Candidate places on the new revision and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.functions import geometry as G
from revlens.functions import text as X

SEARCH_RADIUS, CONTEXT_WINDOW, TOP_K = 144.0, 50.0, 5
HOMOGRAPHY = [f"h{i}{j}" for i in range(3) for j in range(3)]


def predicted(anchors: DataFrame, transforms: DataFrame) -> DataFrame:
    """Anchor centres carried to the new revision."""
    x, y = G.project(F.col("acx"), F.col("acy"), [F.col(h) for h in HOMOGRAPHY])
    return anchors.join(transforms.select("drawing_id", *HOMOGRAPHY), "drawing_id").withColumns({"px": x, "py": y}).drop(*HOMOGRAPHY)


def span_contexts(spans: DataFrame) -> DataFrame:
    """Words around each span within its block: once per span, whatever the number of anchors."""
    places = X.with_tokens(spans, "text", "s_").withColumns({"scx": (F.col("x0") + F.col("x1")) / 2, "scy": (F.col("y0") + F.col("y1")) / 2})
    other = places.select("drawing_id", "block_id", F.col("s_words").alias("o_words"), F.col("scx").alias("ocx"), F.col("scy").alias("ocy"))
    probe = spans.select("drawing_id", "block_id", "span_ord", ((F.col("x0") + F.col("x1")) / 2).alias("scx"), ((F.col("y0") + F.col("y1")) / 2).alias("scy"))
    near = G.grid_join(probe, other, ["drawing_id", "block_id"], ("scx", "scy"), ("ocx", "ocy"), CONTEXT_WINDOW).where(F.col("dist") > 0)
    words = near.groupBy("drawing_id", "span_ord").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("o_words")))).alias("near_words"))
    return places.join(words, ["drawing_id", "span_ord"], "left").withColumn("near_words", F.coalesce("near_words", F.array().cast("array<string>")))


def within_radius(anchors: DataFrame, places: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs by the places of the narrow ``spans``, which are repeated; what scoring reads of them joins afterwards. With ``how`` as left, anchors without a span in reach stay."""
    probe = spans.select("drawing_id", "span_ord", ((F.col("x0") + F.col("x1")) / 2).alias("_scx"), ((F.col("y0") + F.col("y1")) / 2).alias("_scy"))
    near = G.cell_join(probe, anchors, ["drawing_id"], ("_scx", "_scy"), ("px", "py"), SEARCH_RADIUS, how, within=True).drop("_scx", "_scy")
    return near.join(places, ["drawing_id", "span_ord"], how)


def numeric_overlap(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.when(F.size(b) == 0, 1.0).otherwise(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repetitions, so that their union need not be made to be counted."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def scored(pairs: DataFrame) -> DataFrame:
    """Score components; ``a_*`` are the anchor's tokens and ``s_*`` the span's."""
    c = F.col
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    pairs = pairs.withColumns({
        "location_score": 1.0 - F.least(c("dist") / SEARCH_RADIUS, F.lit(1.0)),
        "symbol_match": F.when(F.size("a_symbols") > 0, F.size(F.array_intersect("a_symbols", "s_symbols")) / F.greatest(F.size("a_symbols"), F.lit(1))).otherwise(0.0),
        "count_bonus": flag((F.size("a_counts") > 0) & (F.size("s_counts") > 0)),
        "numeric_overlap": numeric_overlap(c("a_numbers"), c("s_numbers")),
        "a_primary": F.array_max("a_numbers"), "s_primary": F.array_max("s_numbers"),
        "class_match": flag(c("a_kind") == c("s_kind")),
        "context_score": jaccard(c("context_words"), c("near_words")),
    })
    pairs = pairs.withColumns({
        "primary_match": flag(F.coalesce(c("a_primary") == c("s_primary"), F.lit(False))),
        "primary_penalty": F.when((F.size("s_numbers") > 0) & c("a_primary").isNotNull() & ~F.array_contains("s_numbers", c("a_primary")), 0.4).otherwise(0.0),
    })
    pairs = pairs.withColumn("text_score", 0.15 * c("symbol_match") + 0.15 * c("count_bonus") + 0.50 * c("numeric_overlap") + 0.10 * c("class_match") + 0.10 * c("primary_match"))
    total = 0.35 * c("location_score") + 0.50 * c("text_score") + 0.15 * c("context_score") - c("primary_penalty")
    return pairs.withColumn("total_score", F.greatest(F.lit(0.0), total))


def reasons(_: DataFrame | None = None) -> Column:
    """Why a candidate scored, as an array of sentences in fixed order."""
    c = F.col
    parts = F.array_compact(F.array(
        F.when(c("symbol_match") > 0, F.concat(F.lit("symbols: "), X.set_text(F.array_intersect("a_symbols", "s_symbols")))),
        F.when(c("count_bonus") > 0, F.concat(F.lit("counts: "), X.set_text(c("a_counts")), F.lit(" vs "), X.set_text(c("s_counts")))),
        F.when(c("numeric_overlap") > 0, F.concat(F.lit("numerics: "), (c("numeric_overlap") * 100).cast("int").cast("string"), F.lit("%"))),
        F.when(c("primary_match") > 0, F.concat(F.lit("primary="), X.float_text(c("a_primary")))),
    ))
    return F.array_compact(F.array(
        F.when(c("location_score") > 0, F.concat(F.lit("within "), F.call_function("format_number", G.millimetres(c("dist")), F.lit("0.0")), F.lit(" mm of predicted location"))),
        F.when(c("primary_penalty") > 0, F.concat(F.lit("primary value "), X.float_text(c("a_primary")), F.lit(" not found in span"))),
        F.when(F.size(parts) > 0, F.concat(F.lit("matched: "), F.array_join(parts, ", "))),
        F.when(c("context_score") > 0, F.concat(F.lit("context similarity: "), F.call_function("format_number", c("context_score"), F.lit("0.00")))),
    ))


def top_candidates(pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best ``k`` per anchor; equal scores in span order."""
    order = W.partitionBy("drawing_id", "char_no").orderBy(F.col("total_score").desc(), "span_ord")
    return pairs.withColumn("cand_rank", F.row_number().over(order)).where(F.col("cand_rank") <= k)


def all_pairs(anchors: DataFrame, places: DataFrame, transforms: DataFrame, spans: DataFrame | None = None, how: str = "inner", carried: tuple[str, ...] = ()) -> DataFrame:
    """Scored pairs of anchors and spans within the search radius. ``places`` are ``spans`` with their contexts; ``carried`` are further columns of the anchors."""
    kept = ["drawing_id", "char_no", "anchor_ord", "px", "py", "requirement", "context_words", *carried]
    near = within_radius(predicted(anchors, transforms).select(*kept), places.drop("s_norm", "s_words"), places if spans is None else spans, how)
    return scored(X.with_tokens(near, "requirement", "a_").drop("a_norm", "a_words"))


def candidates(anchors: DataFrame, spans: DataFrame, transforms: DataFrame, k: int = TOP_K) -> DataFrame:
    return top_candidates(all_pairs(anchors, span_contexts(spans), transforms, spans), k)
