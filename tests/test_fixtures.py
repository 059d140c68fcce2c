"""Literal cases: fingerprints, assignment, scoring, forms, rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.functions import geometry as G
from revlens.functions import text as X
from revlens.operators import alignment, assignment, candidates, classification, form3, packets, vision
from revlens.plans.cases import EXPECTED, classified_cases
from revlens.sources import pages, xlsx

FINGERPRINTS = [
    ("  length   12.5   mm  ", "LENGTH 12.5 MM", [], [], [12.5], "MM", "dimension"),
    ("2 X Ø8 mm holes", "2 X Ø8 MM HOLES", ["2X"], ["Ø"], [2, 8], "MM", "hole"),
    ("2X holes and 4 x threads", "2X HOLES AND 4 X THREADS", ["2X", "4X"], [], [2, 4], None, "hole"),
    ("Edge radius R2 mm", "EDGE RADIUS R2 MM", [], ["R"], [2], "MM", "fillet"),
    ("R 2.5 mm", "R 2.5 MM", [], [], [2.5], "MM", "fillet"),
    ("R.5 mm", "R.5 MM", [], ["R"], [5], "MM", "other"),
    ("Ø8 +/- 0.03 mm", "Ø8 +/- 0.03 MM", [], ["Ø"], [8, 0.03], "MM", "hole"),
    ("Thread M4-6H", "THREAD M4-6H", [], [], [4, 6], None, "hole"),
    ("Drawing notes: all dimensions in mm", "DRAWING NOTES: ALL DIMENSIONS IN MM", [], [], [], "MM", "note"),
    ("diameter 8mm", "DIAMETER 8MM", [], [], [8], None, "hole"),
    ("", "", [], [], [], None, "other"), ("   ", "", [], [], [], None, "other"), ("Ø8X", "Ø8X", [], ["Ø"], [8], None, "hole"), ("é2X", "É2X", [], [], [2], None, "other"),
    ("ø8", "Ø8", [], [], [8], None, "other"), ("THR. 5", "THR. 5", [], ["R"], [5], None, "other"), ("5.", "5.", [], [], [5], None, "other"), ("1.2.3", "1.2.3", [], [], [1.2, 3], None, "other"),
]


def test_fingerprints(spark):
    frame = spark.createDataFrame([(k, f[0]) for k, f in enumerate(FINGERPRINTS)], "k int, t string")
    for r in frame.select("k", X.fingerprint(F.col("t")).alias("f")).collect():
        _, norm, counts, symbols, numbers, unit, kind = FINGERPRINTS[r["k"]]
        f = r["f"]
        assert (f["norm_text"], f["count_tokens"], f["symbol_tokens"], [n["value"] for n in f["numeric_tokens"]], f["units"], f["pattern_class"]) == (norm, counts, symbols, numbers, unit, kind)


def test_sql_functions_agree(spark):
    X.register_sql(spark)
    got = spark.sql("select fp_norm('  2 x  ø8 ') n, fp_counts('2 X') c, fp_numbers('2 X 8.5') v").first()
    assert (got["n"], got["c"], got["v"]) == ("2 X Ø8", ["2X"], [2.0, 8.5])


def _edges(spark, rows):
    """(drawing, char, span number, score); rank by listing."""
    out = [(d, c, c, k, float(s), p, 0, 0, 0.0, 0.0, 1.0, 1.0) for k, (d, c, p, s) in enumerate(rows)]
    return spark.createDataFrame(out, "drawing_id int, anchor_ord int, char_no int, cand_rank int, total_score double, block_id int, line_id int, span_id int, x0 double, y0 double, x1 double, y1 double")


ASSIGNMENTS = [
    ([(1, 1, 0, 0.9), (1, 1, 1, 0.7), (1, 2, 0, 0.8), (1, 2, 2, 0.6)], {1: 0, 2: 2}),
    ([(1, 1, 0, 0.95), (1, 1, 1, 0.85), (1, 2, 0, 0.9), (1, 2, 1, 0.8), (1, 3, 1, 0.75)], {1: 0, 2: 1}),
    ([(1, 1, 0, 0.5), (1, 2, 0, 0.5)], {1: 0}),
    ([(1, 1, 0, 0.0)], {1: 0}),
]


@pytest.mark.parametrize("rows,want", ASSIGNMENTS)
def test_assignment(spark, rows, want):
    edges = _edges(spark, rows)
    got = edges.join(assignment.greedy(edges), ["drawing_id", "char_no", "cand_rank"]).collect()
    assert {r["char_no"]: r["block_id"] for r in got} == want


def test_fold_equals_dominant(spark):
    rng = np.random.default_rng(5)
    edges = _edges(spark, [(int(d), int(c), int(p), round(float(s), 1)) for d in range(6) for c in range(7) for p, s in zip(rng.integers(0, 6, 4), rng.random(4), strict=True)])
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(assignment.greedy(edges)) == key(assignment.dominant(edges))


def test_classification_cases(spark):
    got = [f"{r['status']}:{round(r['confidence'], 6)}" for r in classified_cases(spark).orderBy("case_id").collect()]
    assert got == EXPECTED


def test_scoring_fixture(spark):
    anchor = spark.createDataFrame([(1, 1, 1, "2x r 0.125", 5.0, 5.0, [])], "drawing_id int, char_no int, anchor_ord int, requirement string, acx double, acy double, context_words array<string>")
    spans = [("2X R 0.250", 5, 5), ("2X R 0.125", 100, 5), ("DRAWING NOTES", 6, 6), ("UNRELATED", 105, 5), ("FAR", 500, 5)]
    places = spark.createDataFrame([(1, k, t, x - 5.0, y - 5.0, x + 5.0, y + 5.0, k, 0, k) for k, (t, x, y) in enumerate(spans)], "drawing_id int, span_ord int, text string, x0 double, y0 double, x1 double, y1 double, block_id int, line_id int, span_id int")
    eye = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "drawing_id int, " + ", ".join(f"{h} double" for h in candidates.HOMOGRAPHY))
    got = candidates.candidates(anchor, places, eye).orderBy("cand_rank").collect()
    assert [(r["text"], round(r["total_score"], 6)) for r in got] == [("2X R 0.250", 0.65), ("2X R 0.125", 0.544097), ("DRAWING NOTES", 0.346563), ("UNRELATED", 0.156944)]
    why = candidates.candidates(anchor, places, eye).select("span_ord", candidates.reasons().alias("r")).where("span_ord = 1").first()["r"]
    assert why == ["within 33.5 mm of predicted location", "matched: counts: {'2X'} vs {'2X'}, numerics: 100%, primary=2.0"]


def test_grid_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-40, 40, (120, 2)) * 5)], "g int, k int, x double, y double")
    other = pts.select("g", F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    got = {(r["k"], r["k2"]) for r in G.grid_join(pts, other, ["g"], ("x", "y"), ("x2", "y2"), 50.0).collect()}
    p = np.array([(r["x"], r["y"]) for r in pts.orderBy("k").collect()])
    want = {(i, j) for i in range(120) for j in range(120) if np.hypot(*(p[i] - p[j])) <= 50}
    assert got == want


def _book(header, chars):
    cells = {(6, c): h for c, h in enumerate(header, 1)}
    for k, v in enumerate(chars):
        if v is not None:
            cells[(7 + k, 1)] = v
        cells[(7 + k, 4)] = f"R{k}"
    return xlsx.write_workbook({"Cover": {(1, 1): "x"}, "MyForm3Data": cells})


@pytest.mark.parametrize("chars,want", [([1, 2, None, 4], [1, 2]), ([None, 1], []), (["7", 7.0, "  7  "], [7, 7, 7]), ([1, "7A", "A7", 2], [1, 2]), ([1, 2, 1], [1, 2, 1])])
def test_forms_from_workbooks(spark, tmp_path, chars, want):
    (tmp_path / "part1.xlsx").write_bytes(_book(["Char No Number", "Reference Location Ref", "Characteristic Designator", "Requirement Req"], chars))
    rows = form3.characteristics(xlsx.form3_cells(spark, f"file://{tmp_path}/*.xlsx")).orderBy("row_ord").collect()
    assert [r["char_no"] for r in rows] == want
    assert all(r["drawing_id"] == "part1" and r["reference_location"] == "" for r in rows)


def test_form_without_sheet_fails(spark):
    cells = spark.createDataFrame([("a", 0, "Other", 1, 1, "x", "s")], "drawing_id string, sheet_ord int, sheet string, row_no int, col int, value string, vtype string")
    with pytest.raises(Exception, match="No Form 3 sheet"):
        form3.require_sheets(cells).collect()


def test_text_spans_count_skipped_blocks(spark):
    page = '{"blocks":[{"type":1},{"type":0,"lines":[{"spans":[{"text":"a","size":9,"bbox":[0,0,1,1]},{"text":" ","size":9,"bbox":[1,0,2,1]}]}]}]}'
    frame = spark.createDataFrame([("d", "A", 0, page)], "drawing_id string, rev string, page int, json string")
    got = [(r["span_ord"], r["text"], r["block_id"], r["span_id"]) for r in pages.text_spans(frame).orderBy("span_ord").collect()]
    assert got == [(1, "a", 1, 0), (2, " ", 1, 1)]


def test_inputs_are_validated():
    pages.validate_inputs("a.PDF", "b.pdf", "c.xlsx", lambda p: True)
    with pytest.raises(ValueError):
        pages.validate_inputs("a.txt", "b.pdf", "c.xlsx", lambda p: True)
    with pytest.raises(FileNotFoundError):
        pages.validate_inputs("a.pdf", "b.pdf", "c.xlsx", lambda p: False)


def test_rasters_and_crops(spark, tmp_path):
    image = np.arange(800 * 3 * 10, dtype=np.uint32).astype(np.uint8).reshape(10, 800, 3)
    (tmp_path / "p.ppm").write_bytes(b"P6\n800 10\n255\n" + image[:, :, ::-1].tobytes())
    r = pages.read_rasters(spark, f"file://{tmp_path}/p.ppm").first()
    assert (r["h"], r["w"]) == (10, 800) and bytes(r["data"]) == image.tobytes()
    page = np.zeros((800, 1000, 3), dtype=np.uint8)
    assert vision.crop(page, (100, 100, 200, 150), 20).shape == (90, 140, 3)
    assert vision.crop(page, (10, 10, 60, 60), 30).shape == vision.crop(page, (940, 740, 990, 790), 30).shape == (90, 90, 3)
    with pytest.raises(ValueError, match="Invalid bbox"):
        vision.crop(page, (200, 100, 200, 150), 0)
    with pytest.raises(ValueError, match="Clamped bbox is empty"):
        vision.crop(page, (0, 0, 1, 1), -5)
    with pytest.raises(ValueError):
        vision.png(np.zeros((0, 0, 3), dtype=np.uint8))
    assert vision.png(page)[:8] == b"\x89PNG\r\n\x1a\n"


def test_drawn_numbers_are_read():
    for n in (1, 8, 10, 37, 99):
        image = vision.drawn_balloon(n)
        (x, y, r), *_ = vision.circles(image, 10, 50, 30)
        k = int(r * 0.62)
        assert vision.recognise(image[y - k : y + k, x - k : x + k])[0] == n
    assert vision.recognise(np.full((30, 30), 255, dtype=np.uint8))[0] is None
    assert not vision.has_circle(np.full((40, 40), 255, dtype=np.uint8))


def test_ransac_finds_a_projective_map():
    rng = np.random.default_rng(2)
    h = np.array([[1.05, 0.02, 10], [-0.01, 0.98, 20], [1e-5, 2e-5, 1]])
    src = rng.uniform(0, 800, (150, 2))
    p = np.c_[src, np.ones(150)] @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[:40] = rng.uniform(0, 800, (40, 2))
    got, inside = alignment.ransac(src, dst)
    assert inside[40:].all() and np.abs(got - h).max() < 1e-3
    assert alignment.ransac(src[:3], dst[:3])[0] is None


def test_quality_gate(spark):
    bad = spark.createDataFrame([(10, 0.5, 20)], "inliers int, inlier_ratio double, n_matches int")
    with pytest.raises(Exception, match="Alignment failed"):
        alignment.require_quality(bad).collect()


def test_empty_drawings_give_empty_results(spark):
    edges = _edges(spark, []) if False else _edges(spark, [(1, 1, 0, 0.5)]).limit(0)
    assert assignment.greedy(edges).count() == 0 and assignment.dominant(edges).count() == 0
    items = spark.createDataFrame([], "drawing_id int, is_added int, item_ord int, status string")
    assert classification.status_counts(items).count() == 0 and packets.numbered(items).count() == 0


def test_overlay_rings_points_and_cuts_what_is_outside():
    page = np.full((40, 50, 3), 255, dtype=np.uint8)
    drawn = vision.overlay(page, np.array([[20.9, 15.2], [0, 0], [500, 500]]))
    assert (page == 255).all() and drawn.shape == page.shape
    want = {(x, y) for cx, cy in ((20, 15), (0, 0)) for x in range(50) for y in range(40) if abs(np.hypot(x - cx, y - cy) - 5) <= 1}
    assert {(int(x), int(y)) for y, x in zip(*np.nonzero((drawn == (0, 255, 0)).all(axis=2)), strict=True)} == want
    assert (vision.overlay(page, np.zeros((0, 2))) == page).all()


def test_snippets_are_cut_written_and_errors_kept(spark, tmp_path):
    page = np.arange(30 * 40 * 3, dtype=np.uint32).astype(np.uint8).reshape(30, 40, 3)
    pages = spark.createDataFrame([(1, 30, 40, page.tobytes())], "page int, h int, w int, data binary")
    boxes = [(1, "a.png", 5, 5, 10, 12), (1, "a.png", 5, 5, 10, 12), (1, "b.png", 7, 7, 7, 9), (1, "n.png", None, 1, 2, 3), (2, "c.png", 1, 1, 4, 4)]
    regions = spark.createDataFrame(boxes, "page int, name string, x0 int, y0 int, x1 int, y1 int")
    cut = vision.snippets(pages, regions, ["page"], pad=3)
    got = {(r["page"], r["name"]): (None if r["png"] is None else bytes(r["png"]), r["error"]) for r in cut.collect()}
    assert cut.count() == 5 and got[1, "a.png"] == (vision.png(page[2:15, 2:13]), None)
    assert all(got[k][0] is None and got[k][1] for k in ((1, "b.png"), (1, "n.png"), (2, "c.png")))
    assert vision.write_files(cut, str(tmp_path / "run" / "snippets")).count() == 2
    assert [f.name for f in (tmp_path / "run" / "snippets").iterdir()] == ["a.png"]
    assert (tmp_path / "run" / "snippets" / "a.png").read_bytes() == got[1, "a.png"][0]
