"""What happened to each characteristic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.operators.assignment import SPAN_KEY
from revlens.operators.candidates import numeric_overlap

# Sentences that results carry.
REMOVED = "No candidate found within search window"
COUNT_CHANGED = "Count changed: "
VALUES_MATCH = "Numeric values match ("
COUNTS_MATCH = "Count tokens match: "
VALUES_CHANGED = "Numeric values changed (only "
SAME_PLACE = "Location strongly suggests same requirement"
OVERLAP = "Numeric overlap: "
WEAK = "Weak match confidence"
NEAR = "High location agreement after global alignment"
NEW_TEXT, NEW_MARKS = 'New requirement detected in Rev B: "', "Symbols: "


def _tests() -> dict[str, Column]:
    c = F.col
    changed = (F.size("a_counts") > 0) & (F.size("s_counts") > 0) & (F.sort_array("a_counts") != F.sort_array("s_counts"))
    return {"matched": c("matched"), "count_changed": changed, "count_missing": (F.size("a_counts") > 0) & (F.size("s_counts") == 0), "symbols_kept": F.size(F.array_except("a_symbols", "s_symbols")) == 0}


def classified(rows: DataFrame) -> DataFrame:
    """Adds status, confidence, branch, reasons and scores.

    ``rows`` have ``matched``, ``location_score``, ``context_score``, ``coverage``
    and the token sets ``a_*`` and ``s_*`` (null where not matched). The first
    true branch decides.
    """
    c, t = F.col, _tests()
    rows = rows.withColumn("ov", numeric_overlap(c("a_numbers"), c("s_numbers")))
    loc, ov = c("location_score"), c("ov")
    branch = (
        F.when(~t["matched"], "C1").when(t["count_changed"], "C2").when((ov >= 0.5) & t["symbols_kept"], "C3")
        .when((ov < 0.5) & t["symbols_kept"] & ~t["count_missing"], "C4").when(loc > 0.6, "C5").otherwise("C6")
    )
    rows = rows.withColumn("branch", branch)
    is_ = lambda b: c("branch") == b
    status = F.when(is_("C1"), "removed").when(is_("C2") | is_("C4"), "changed").when(is_("C3") | is_("C5"), "unchanged").otherwise("uncertain")
    confidence = (
        F.when(is_("C1"), F.least(F.lit(0.9), c("coverage"))).when(is_("C2"), 0.5 * loc + 0.3 * ov + 0.2).when(is_("C3"), 0.4 * loc + 0.4 * ov + 0.2)
        .when(is_("C4"), 0.4 * loc + 0.3 * ov + 0.2).when(is_("C5"), 0.6 * loc + 0.2 * ov).otherwise(0.5 * loc + 0.3 * ov)
    )
    percent = (ov * 100).cast("int").cast("string")
    numbers = lambda name: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(name), X.float_text), ", "), F.lit("]"))
    why = F.array_compact(F.array(
        F.when(is_("C1"), F.lit(REMOVED)),
        F.when(is_("C2"), F.concat(F.lit(COUNT_CHANGED), X.set_text(c("a_counts")), F.lit(" → "), X.set_text(c("s_counts")))),
        F.when(is_("C3"), F.concat(F.lit(VALUES_MATCH), percent, F.lit("% overlap)"))),
        F.when(is_("C3") & (F.size("a_counts") > 0) & (F.sort_array("a_counts") == F.sort_array("s_counts")), F.concat(F.lit(COUNTS_MATCH), X.set_text(c("a_counts")))),
        F.when(is_("C4"), F.concat(F.lit(VALUES_CHANGED), percent, F.lit("% overlap)"))),
        F.when(is_("C4"), F.concat(F.lit("Anchor: "), numbers("a_numbers"), F.lit(", Matched: "), numbers("s_numbers"))),
        F.when(is_("C5"), F.lit(SAME_PLACE)),
        F.when(is_("C5"), F.concat(F.lit(OVERLAP), percent, F.lit("%"))),
        F.when(is_("C6"), F.lit(WEAK)),
        F.when(~is_("C1") & (loc > 0.7), F.lit(NEAR)),
    ))
    score = lambda x: F.when(is_("C1"), 0.0).otherwise(x)
    return rows.withColumns({
        "status": status, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), "reasons": why,
        "scores": F.create_map(F.lit("location"), score(loc), F.lit("text"), score(ov), F.lit("context"), score(c("context_score"))),
    })


def classify(anchors: DataFrame, matches: DataFrame, coverage: float = 1.0) -> DataFrame:
    """Every anchor with its match, if any, classified."""
    found = matches.select("drawing_id", "char_no", F.lit(True).alias("matched"), "location_score", "context_score", "span_ord", "text", *SPAN_KEY, "s_counts", "s_symbols", "s_numbers")
    return classify_rows(anchors.select("drawing_id", "char_no", "anchor_ord", "requirement").join(found, ["drawing_id", "char_no"], "left"), coverage)


def classify_rows(rows: DataFrame, coverage: float = 1.0) -> DataFrame:
    """Anchors that have their match in the same row, ``matched`` being null where there is none."""
    tokens = X.with_tokens(rows, "requirement", "a_").drop("a_norm", "a_words")
    return classified(tokens.withColumns({"matched": F.coalesce("matched", F.lit(False)), "coverage": F.lit(coverage)}))


def looks_new(spans: DataFrame) -> DataFrame:
    """Spans that read like a requirement: numbers with a symbol or a count, and no revision word."""
    spans = X.with_tokens(spans.withColumn("_trimmed", F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), "_trimmed", "s_")
    marked = F.exists(F.array(*[F.lit(w) for w in X.REVISION_WORDS]), lambda w: F.contains(F.col("s_norm"), w))
    return spans.where((F.length("_trimmed") >= 3) & (F.size("s_numbers") > 0) & ((F.size("s_symbols") > 0) | (F.size("s_counts") > 0)) & ~marked)


def unmatched(spans: DataFrame, matches: DataFrame) -> DataFrame:
    return spans.join(matches.select("drawing_id", *SPAN_KEY).distinct(), ["drawing_id", *SPAN_KEY], "left_anti")


def added(spans: DataFrame, matches: DataFrame, anchors: DataFrame) -> DataFrame:
    """New characteristics, numbered in span order after the largest anchored number of the drawing."""
    last = anchors.groupBy("drawing_id").agg(F.max("char_no").alias("last"))
    rows = looks_new(unmatched(spans, matches)).join(last, "drawing_id", "left")
    order = W.partitionBy("drawing_id").orderBy("span_ord")
    bonus = lambda test, x: F.when(test, x).otherwise(0.0)
    confidence = F.lit(0.6) + bonus(F.size("s_symbols") > 0, 0.15) + bonus(F.size("s_counts") > 0, 0.15) + bonus(F.col("s_kind").isin("hole", "dimension", "fillet"), 0.1)
    counts = F.transform(F.regexp_extract_all("s_norm", F.lit(r"(?U)\b(\d+)\s*X\b"), F.lit(1)), lambda n: F.concat(n, F.lit("X")))
    why = F.array(F.concat(F.lit(NEW_TEXT), F.col("_trimmed"), F.lit('"')), F.concat(F.lit(NEW_MARKS), X.list_text(F.col("s_symbols")), F.lit(", Counts: "), X.list_text(counts)))
    return rows.withColumns({
        "char_no": (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("int"), "status": F.lit("added"), "confidence": F.least(confidence, F.lit(0.95)), "reasons": why,
        "scores": F.create_map(F.lit("location"), F.lit(0.0), F.lit("text"), F.lit(1.0), F.lit("context"), F.lit(0.0)),
    })


ITEM = ["drawing_id", "is_added", "item_ord", "char_no", "status", "confidence", "reasons", "scores", "span_ord", "x0", "y0", "x1", "y1"]


def old_items(classes: DataFrame) -> DataFrame:
    return classes.withColumns({"is_added": F.lit(0), "item_ord": F.col("anchor_ord")}).select(*ITEM)


def new_items(new: DataFrame) -> DataFrame:
    return new.withColumns({"is_added": F.lit(1), "item_ord": F.col("span_ord")}).select(*ITEM)


def items(classes: DataFrame, new: DataFrame) -> DataFrame:
    """All items: anchors in form order, then the added ones."""
    return old_items(classes).unionByName(new_items(new))


def status_counts(all_items: DataFrame) -> DataFrame:
    return all_items.groupBy("status").agg(F.count("*").alias("n"))


def coverage_metrics(form3: DataFrame, anchors: DataFrame, classes: DataFrame) -> DataFrame:
    """Per drawing: share of characteristics with an anchor, of anchors matched, and of anchors uncertain."""
    total = form3.groupBy("drawing_id").agg(F.countDistinct("char_no").alias("n_chars"))
    found = anchors.groupBy("drawing_id").agg(F.count("*").alias("n_anchors"))
    rates = classes.groupBy("drawing_id").agg(F.avg(F.col("matched").cast("double")).alias("match_rate"), F.avg((F.col("status") == "uncertain").cast("double")).alias("uncertain_rate"))
    joined = total.join(found, "drawing_id", "left").join(rates, "drawing_id", "left")
    return joined.withColumn("anchor_coverage", F.coalesce("n_anchors", F.lit(0)) / F.col("n_chars"))
