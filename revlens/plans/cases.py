"""Queries over literal cases and drawn rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import geometry as G
from revlens.functions import text as X
from revlens.operators import candidates, classification, packets, vision
from revlens.session import ship
from revlens.sources import pages

#: requirement, span (null: no match), location score, coverage.
CASES = [
    ("Ø 8.0 +0.1 -0.0", "Ø 8.0 +0.1 -0.0", 0.85, 1.0), ("R 2.5", "R 2.5", 0.9, 1.0), ("Ø 8.0 +0.1 -0.0", "Ø 8.5 +0.1 -0.0", 0.8, 1.0), ("Ø 10.0 +0.2 -0.1", "Ø 10.0 +0.3 -0.1", 0.75, 1.0),
    ("Ø 8.0", "R 12.5", 0.9, 1.0), ("DRAWING NOTES", "EDGE RADIUS", 0.85, 1.0), ("Ø 5.0", "Ø 5.0", 1.0, 1.0), ("Ø 5.0", "completely different text", 0.0, 1.0), ("Ø 6.0", "Ø 6.0", 0.7, 1.0), ("R 3.0", "R 3.5", 0.75, 1.0),
    ("Ø 9.0", "LENGTH 15.0", 0.8, 1.0), ("2X Ø8", "4X Ø8", 0.8, 1.0), ("Ø 1.0", None, 0.0, 1.0), ("Ø 1.0", None, 0.0, 0.7),
]
EXPECTED = ["unchanged:0.94", "unchanged:0.96", "unchanged:0.786667", "unchanged:0.766667", "unchanged:0.54", "unchanged:0.94", "unchanged:1.0", "uncertain:0.0", "unchanged:0.88", "changed:0.5", "unchanged:0.48", "changed:0.75", "removed:0.9", "removed:0.7"]


def classified_cases(spark):
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "case_id int, requirement string, span string, location_score double, coverage double")
    rows = rows.withColumns({"matched": F.col("span").isNotNull(), "context_score": F.lit(0.0)})
    return classification.classified(X.with_tokens(X.with_tokens(rows, "requirement", "a_"), "span", "s_"))


def registered(chain, table, query):
    def numbers(s, d):
        ship(s)
        return vision.recognised(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_size"), "p_partkey", "p_size")

    def measured(s, d):
        ship(s)
        return vision.measured(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_size"), "p_partkey", "p_size")

    def greys(s, d):
        ship(s)
        return vision.grey_values(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") % 256).cast("int").alias("b"), (F.col("l_suppkey") * 3 % 256).cast("int").alias("g"), (F.col("l_orderkey") % 256).cast("int").alias("r")).distinct())

    def cut(s, d):
        """A region of each part's drawn page, some of them beyond its edge or without area, as PNG; its size is read from the file."""
        ship(s)
        parts = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_size")
        boxes = parts.select("p_partkey", packets.snippet_name(F.col("p_partkey").cast("int"), "revA", F.lit(0)).alias("name"), (F.col("p_size") * 2).alias("x0"), F.lit(3).alias("y0"), (F.col("p_size") + 20).alias("x1"), F.lit(60).alias("y1"))
        size = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
        return vision.snippets(vision.drawn_rasters(parts, "p_partkey", "p_size"), boxes, ["p_partkey"]).select("p_partkey", "name", size(17).alias("w"), size(21).alias("h"), F.split("error", ":")[0].alias("error"))

    def ringed(s, d):
        """Projected centres of the old spans, at a fifth of a pixel a point."""
        ship(s)
        centre = G.project(*G.center(G.box()), [F.col(h) for h in candidates.HOMOGRAPHY])
        points = chain(s, d).boxes().select("drawing_id", *[F.round(c * 0.2, 6).alias(n) for c, n in zip(centre, "xy", strict=True)])
        return vision.overlays(points, 200, 240).select("drawing_id", "n_marked")

    def spans_again(s, d):
        spans = table(s, d, "spans_a").withColumns({"rev": F.lit("A"), "page": F.lit(0), "block_id": F.lit(0), "line_id": F.lit(0), "span_id": F.col("span_ord") - 1})
        return pages.text_spans(pages.page_json(spans))

    values = ", ".join(f"({k}, '{e.split(':')[0]}', {e.split(':')[1]}::DOUBLE)" for k, e in enumerate(EXPECTED))
    return {
        "C_classification_cases": (lambda s, d: classified_cases(s).select("case_id", "status", F.round("confidence", 6).alias("confidence")), f"SELECT * FROM (VALUES {values}) AS t(case_id, status, confidence)"),
        "V3_circle_detect": (lambda s, d: numbers(s, d).select("p_partkey", "circle"), "SELECT p_partkey, true AS circle FROM part"),
        "V6_template_match": (lambda s, d: numbers(s, d).where(F.col("digit") < 10).select("p_partkey", "digit"), "SELECT p_partkey, p_size::INT AS digit FROM part WHERE p_size < 10"),
        "V7_two_digit_split": (lambda s, d: numbers(s, d).where(F.col("digit") >= 10).select("p_partkey", "digit"), "SELECT p_partkey, p_size::INT AS digit FROM part WHERE p_size >= 10"),
        "B2_cv_balloons": (lambda s, d: numbers(s, d).where("circle and digit between 1 and 200").select("p_partkey", F.col("digit").alias("char_no")), "SELECT p_partkey, p_size::INT AS char_no FROM part"),
        "A10_best_digit": (lambda s, d: numbers(s, d).select("p_partkey", "digit"), "SELECT p_partkey, p_size::INT AS digit FROM part"),
        "F12_cv_range": (lambda s, d: numbers(s, d).where("digit between 1 and 200").select("p_partkey", "digit"), "SELECT p_partkey, p_size::INT AS digit FROM part WHERE p_size BETWEEN 1 AND 200"),
        "K2_snippet_sink": (cut, "SELECT p_partkey, format('char_{:03d}_revA_p0.png', p_partkey) AS name, CASE WHEN error IS NULL THEN x1 - x0 END AS w, CASE WHEN error IS NULL THEN 68 END AS h, error FROM (SELECT p_partkey, greatest(0, p_size * 2 - 10)::INT AS x0, least(68, p_size + 30)::INT AS x1, CASE WHEN p_size >= 20 THEN 'Invalid bbox' WHEN least(68, p_size + 30) <= greatest(0, p_size * 2 - 10) THEN 'Clamped bbox is empty' END AS error FROM part)"),
        "K3_debug_overlay_sink": (ringed, query("SELECT drawing_id, count(*) AS n_marked FROM (SELECT DISTINCT drawing_id, px + dx AS x, py + dy AS y FROM (SELECT s.drawing_id, trunc(round(0.2::DOUBLE * ((h00 * ((x0 + x1) / 2) + h01 * ((y0 + y1) / 2) + h02) / (h20 * ((x0 + x1) / 2) + h21 * ((y0 + y1) / 2) + h22)), 6))::BIGINT AS px, trunc(round(0.2::DOUBLE * ((h10 * ((x0 + x1) / 2) + h11 * ((y0 + y1) / 2) + h12) / (h20 * ((x0 + x1) / 2) + h21 * ((y0 + y1) / 2) + h22)), 6))::BIGINT AS py FROM spans_a s JOIN transforms USING (drawing_id)) CROSS JOIN (SELECT a.v AS dx, b.v AS dy FROM (SELECT unnest(range(-6, 7)) AS v) a, (SELECT unnest(range(-6, 7)) AS v) b WHERE abs(sqrt(a.v * a.v + b.v * b.v) - 5) <= 1)) WHERE x BETWEEN 0 AND 199 AND y BETWEEN 0 AND 239 GROUP BY drawing_id")),
        "V2_circle_validate": (lambda s, d: measured(s, d).select("p_partkey", "circle_ok"), "SELECT p_partkey, true AS circle_ok FROM part"),
        "V0_grayscale": (greys, "SELECT b, g, r, ((114 * b + 587 * g + 299 * r + 500) // 1000)::INT AS grey FROM (SELECT DISTINCT (l_partkey % 256)::INT AS b, (l_suppkey * 3 % 256)::INT AS g, (l_orderkey % 256)::INT AS r FROM lineitem)"),
        "V4_otsu_binarize": (lambda s, d: measured(s, d).select("p_partkey", "threshold", "n_ink"), None),
        "V5_largest_contour": (lambda s, d: measured(s, d).select("p_partkey", "region_w", "region_h"), None),
        "V8_crop_pixels": (lambda s, d: measured(s, d).select("p_partkey", "crop_w", "crop_h", "png_bytes"), None),
        "S7_text_span_scan": (lambda s, d: spans_again(s, d).select("drawing_id", "span_ord", "text", "x0", "y1", "span_id"), query("SELECT drawing_id, span_ord, text, x0, y1, span_ord - 1 AS span_id FROM spans_a")),
        "W5_ordinals": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_id", "line")).select("doc_id", F.col("line_id").cast("long").alias("line_id"), F.length("line").cast("long").alias("n")), "SELECT doc_id, i - 1 AS line_id, length(lines[i]) AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"),
    }
