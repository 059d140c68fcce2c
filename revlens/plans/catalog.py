"""Registered queries of the drawing-revision operators, by operator id, and their SQL.

Queries run over whole tables: fingerprints over all documents, the drawing
operators over all drawings derived from ``lineitem`` and ``part``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import geometry as G
from revlens.functions import text as X
from revlens.operators import alignment, anchors, assignment, balloons, candidates, classification, evidence, form3, packets
from revlens.plans import cases, oracle
from revlens.plans.demo import once, table
from revlens.plans.oracle import D, query

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, run: Query, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql is not None:
        _SQL[name] = sql


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


class Chain:
    """The reconciliation chain over the derived drawings.

    Two narrow tables are written, once per application and folder: the items, and
    the anchors with the span that each got. Both are dealt out by drawing, and every
    step works on a drawing's rows where they lie, so a query computes only the columns
    that it returns and nothing of the steps between is shuffled or written.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = lambda name: table(spark, sf_dir, name)
        self.once = lambda name, frame: once(spark, sf_dir, name, frame)

    def balloons(self) -> DataFrame:
        return balloons.dedupe(self.t("hits"))

    def linked(self) -> DataFrame:
        return anchors.ballooned(self.t("form3"), self.balloons())

    def boxes(self) -> DataFrame:
        """Spans of the old revision with the balloon and the transform of their row."""
        b = self.balloons().select("drawing_id", F.col("char_no").alias("span_ord"), *G.named(G.box(), "b"))
        return self.t("spans_a").join(self.t("transforms"), "drawing_id").join(b, ["drawing_id", "span_ord"], "left")

    def found(self) -> DataFrame:
        """Anchors without their context words."""
        return anchors.found_anchors(self.t("form3"), self.balloons(), self.t("spans_a"))

    def anchors(self) -> DataFrame:
        return anchors.with_contexts(self.found(), self.t("spans_a"))

    def places(self) -> DataFrame:
        return candidates.span_contexts(self.t("spans_b"))

    def pairs(self, how: str = "inner", carried: tuple[str, ...] = ()) -> DataFrame:
        return candidates.all_pairs(self.anchors(), self.places(), self.t("transforms"), self.t("spans_b"), how, carried)

    def cands(self, how: str = "inner", carried: tuple[str, ...] = ()) -> DataFrame:
        return candidates.top_candidates(self.pairs(how, carried))

    def taken(self) -> DataFrame:
        """Anchors with the key and the scores of the span that each got, if any. Drawings with too many rows for one fold, which is known before any pair is made, are assigned in rounds."""
        kept = ("span_ord", "location_score", "context_score")
        places = tuple(f"{b}{c}" for b in "br" for c in G.CORNERS)
        own = ("anchor_ord", "page", "requirement", *places)

        def rows() -> DataFrame:
            cands = self.cands("left", ("page", *places))
            large = self.t("items").groupBy("drawing_id").agg(F.count("*").alias("n")).where(F.col("n") * candidates.TOP_K > assignment.FOLD_EDGES).select("drawing_id")
            if large.isEmpty():
                return assignment.greedy_anchors(cands, own, ("line_id", *kept))
            rounds = assignment.matches(self.cands().join(large, "drawing_id", "left_semi")).select("drawing_id", "char_no", "line_id", *kept)
            many = self.found().join(large, "drawing_id", "left_semi").select("drawing_id", "char_no", *own).join(rounds, ["drawing_id", "char_no"], "left")
            return assignment.greedy_anchors(cands.join(large, "drawing_id", "left_anti"), own, ("line_id", *kept)).unionByName(many)

        return self.once("taken", rows)

    def pairings(self) -> DataFrame:
        """Keys of the spans that anchors got."""
        return self.taken().where("span_ord is not null").select("drawing_id", "char_no", "span_ord", "line_id", "location_score", "context_score")

    def matched(self) -> DataFrame:
        """Assigned pairs with their span."""
        return self.pairings().join(self.t("spans_b"), ["drawing_id", "span_ord", "line_id"])

    def classes(self) -> DataFrame:
        """Tokens of the spans are read from their texts again."""
        spans = self.t("spans_b").withColumn("matched", F.lit(True))
        own = self.taken().drop("page", *[f"{b}{c}" for b in "br" for c in G.CORNERS]).join(spans, ["drawing_id", "span_ord", "line_id"], "left")
        return classification.classify_rows(X.with_tokens(own, "text", "s_").drop("s_norm", "s_words"))

    def added(self) -> DataFrame:
        return classification.added(self.t("spans_b"), self.matched(), self.taken())

    def items(self) -> DataFrame:
        return classification.items(self.classes(), self.added())

    def each(self, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``step(items, anchors)`` of the old items and of the added ones, whose numbers are above those of all anchors: joins before the union stay in place."""
        anchors = self.taken()
        return step(classification.old_items(self.classes()), anchors).unionByName(step(classification.new_items(self.added()), anchors.where(F.lit(False))))

    def regions(self) -> DataFrame:
        return self.each(lambda items, anchors: evidence.evidence(items, anchors, self.t("spans_a"), self.t("spans_b")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characteristics were unchanged, changed, removed, uncertain or added."""
    return classification.status_counts(Chain(spark, sf_dir).items())


# --- fingerprints over all documents -------------------------------------------------
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("*", F.explode(F.array(X.norm_text(F.col("text")))).alias("n"))


_N = oracle.norm("text")
_PARTS: dict[str, tuple[Callable[[], Column], str]] = {
    "P1_norm_text": (lambda: F.col("n"), _N),
    "P2_count_tokens": (lambda: F.array_join(X.count_tokens(F.col("n")), "|"), f"array_to_string({oracle.counts(_N)}, '|')"),
    "P3_type_tokens": (lambda: F.array_join(X.type_tokens(F.col("n")), "|"), f"array_to_string({oracle.types(_N)}, '|')"),
    "P4_symbol_tokens": (lambda: F.array_join(X.symbol_tokens(F.col("text"), F.col("n")), "|"), f"array_to_string({oracle.symbols('text', _N)}, '|')"),
    "P5_numeric_tokens": (lambda: F.array_join(F.transform(X.numeric_tokens(F.col("n")), lambda t: t["raw"]), "|"), f"array_to_string(regexp_extract_all({_N}, '{oracle.NUM}'), '|')"),
    "P6_units": (lambda: X.units(F.col("n")), oracle.units(_N)),
    "P7_pattern_class": (lambda: X.pattern_class(F.col("text"), F.col("n")), oracle.kind("text", _N)),
    "P8_word_tokens": (lambda: F.size(X.word_tokens(F.col("n"))).cast("long"), f"len({oracle.words(_N)})"),
    "P9_numeric_set": (lambda: F.size(X.numeric_set(F.col("n"))).cast("long"), f"len(list_distinct({oracle.numbers(_N)}))"),
    "P10_raw_numeric_strings": (lambda: F.array_join(F.array_sort(X.numeric_strings(F.col("text"))), "|"), f"array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{oracle.NUM}'))), '|')"),
}
for _name, (_col, _sql) in _PARTS.items():
    _add(_name, lambda s, d, c=_col: _documents(s, d).select("doc_id", c().alias("value")), f"SELECT doc_id, {_sql} AS value FROM documents")

# --- geometry over all derived boxes -------------------------------------------------
_BOXES = "SELECT s.drawing_id, s.span_ord, s.x0, s.y0, s.x1, s.y1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, h00, h01, h02, h10, h11, h12, h20, h21, h22 FROM spans_a s JOIN transforms USING (drawing_id) LEFT JOIN balloons b ON b.drawing_id = s.drawing_id AND b.char_no = s.span_ord"


_S, _B = (lambda: G.box()), (lambda: G.box("b"))
_H = lambda: [F.col(h) for h in candidates.HOMOGRAPHY]
_PX = "(h00 * {x} + h01 * {y} + h02) / (h20 * {x} + h21 * {y} + h22)"
_PY = "(h10 * {x} + h11 * {y} + h12) / (h20 * {x} + h21 * {y} + h22)"
_CX, _CY, _BX, _BY = "((x0 + x1) / 2)", "((y0 + y1) / 2)", "((bx0 + bx1) / 2)", "((by0 + by1) / 2)"
_ALL_X = [_PX.format(x=x, y=y) for x in ("x0", "x1") for y in ("y0", "y1")]
_ALL_Y = [_PY.format(x=x, y=y) for x in ("x0", "x1") for y in ("y0", "y1")]


def _sql_grown(b: list[str], w: float, h: float) -> list[str]:
    dx, dy = f"greatest(({w}{D} - (({b[2]}) - ({b[0]}))) / 2, 0.0{D})", f"greatest(({h}{D} - (({b[3]}) - ({b[1]}))) / 2, 0.0{D})"
    return [f"({b[0]}) - {dx}", f"({b[1]}) - {dy}", f"({b[2]}) + {dx}", f"({b[3]}) + {dy}"]


_U = ["least(x0, bx0)", "least(y0, by0)", "greatest(x1, bx1)", "greatest(y1, by1)"]
_HW = f"greatest({_CX} - x0, x1 - {_CX}, {_CX} - bx0, bx1 - {_CX}, 120.0{D})"
_HH = f"greatest({_CY} - y0, y1 - {_CY}, {_CY} - by0, by1 - {_CY}, 120.0{D})"
_NW, _NH = "(greatest(x1 - x0, bx1 - bx0) / 2)", "(greatest(y1 - y0, by1 - by0) / 2)"
_PAD = "(greatest(x1 - x0, y1 - y0) * 0.5)"
_PIX = [f"floor(x0 * (144 / 72.0{D}))::INT", f"floor(y0 * (144 / 72.0{D}))::INT", f"ceil(x1 * (144 / 72.0{D}))::INT", f"ceil(y1 * (144 / 72.0{D}))::INT"]
_W, _HT = 1000, 1200
_WIN = [f"greatest(0, {_PIX[0]} - 10)", f"greatest(0, {_PIX[1]} - 10)", f"least({_W}, {_PIX[2]} + 10)", f"least({_HT}, {_PIX[3]} + 10)"]
_CIR = [f"greatest(0, trunc({_CX} - 15.5{D})::INT) / (144 / 72.0{D})", f"greatest(0, trunc({_CY} - 15.5{D})::INT) / (144 / 72.0{D})", f"least({_W}, trunc({_CX} + 15.5{D})::INT) / (144 / 72.0{D})", f"least({_HT}, trunc({_CY} + 15.5{D})::INT) / (144 / 72.0{D})"]


def _crop() -> list[Column]:
    window, error = G.crop_window(G.to_pixels(_S(), 144), 10, F.lit(_W), F.lit(_HT))
    return [*[c.cast("double") for c in window], F.when(error.isNull(), 0.0).otherwise(1.0)]


_GEO: dict[str, tuple[Callable[[], list[Column]], list[str]]] = {
    "G1_bbox_center": (lambda: list(G.center(_S())), [_CX, _CY]),
    "G2_euclid": (lambda: [G.distance(*G.center(_S()), *G.center(_B()))], [oracle.dist(_CX, _CY, _BX, _BY)]),
    "G3_pdf_to_px": (lambda: [c.cast("double") for c in G.to_pixels(_S(), 144)], [f"{p}{D}" for p in _PIX]),
    "G4_bbox_union": (lambda: list(G.union(_S(), _B())), _U),
    "G5_combined_evidence": (lambda: list(G.combined_evidence(_S(), _B())), _sql_grown(_U, 50.0, 30.0)),
    "G6_project_point": (lambda: list(G.project(*G.center(_S()), _H())), [_PX.format(x=_CX, y=_CY), _PY.format(x=_CX, y=_CY)]),
    "G7_project_bbox": (lambda: list(G.project_box(_S(), _H())), [f"least({', '.join(_ALL_X)})", f"least({', '.join(_ALL_Y)})", f"greatest({', '.join(_ALL_X)})", f"greatest({', '.join(_ALL_Y)})"]),
    "G8_normalize_pair": (lambda: [c for b in G.same_size(_S(), _B()) for c in b], [f"{_CX} - {_NW}", f"{_CY} - {_NH}", f"{_CX} + {_NW}", f"{_CY} + {_NH}", f"{_BX} - {_NW}", f"{_BY} - {_NH}", f"{_BX} + {_NW}", f"{_BY} + {_NH}"]),
    "G9_size_penalty": (lambda: [G.size_penalty(_S())], [f"least((x1 - x0) * (y1 - y0) / 5000.0{D}, 0.3{D})"]),
    "G11_pad_bbox": (lambda: list(G.padded(_S())), [f"x0 - {_PAD}", f"y0 - {_PAD}", f"x1 + {_PAD}", f"y1 + {_PAD}"]),
    "G12_crop_window": (lambda: _crop(), [*[f"({w}){D}" for w in _WIN], f"CASE WHEN {_PIX[2]} <= {_PIX[0]} OR {_PIX[3]} <= {_PIX[1]} OR {_WIN[2]} <= {_WIN[0]} OR {_WIN[3]} <= {_WIN[1]} THEN 1.0{D} ELSE 0.0{D} END"]),
    "G13_revA_window": (lambda: list(G.window_around(_S(), _B())), [f"{_CX} - {_HW}", f"{_CY} - {_HH}", f"{_CX} + {_HW}", f"{_CY} + {_HH}"]),
    "G14_revA_fallback_window": (lambda: list(G.grown(_B(), 240.0, 240.0)), _sql_grown(["bx0", "by0", "bx1", "by1"], 240.0, 240.0)),
    "G15_same_line": (lambda: [F.when(G.same_line(_S(), (_B()[1] + _B()[3]) / 2, _B()[3] - _B()[1], 8.0), 1.0).otherwise(0.0)], [f"CASE WHEN abs({_CY} - {_BY}) <= 8 AND least(y1 - y0, by1 - by0) / greatest(y1 - y0, by1 - by0, 1.0{D}) >= 0.5 THEN 1.0{D} ELSE 0.0{D} END"]),
    "G16_pt_to_mm": (lambda: [G.millimetres(_S()[0])], [f"x0 * 25.4{D} / 72.0{D}"]),
    "G17_px_to_pdf": (lambda: list(G.circle_to_points(*G.center(_S()), F.lit(15.5), F.lit(_W), F.lit(_HT), 144)), _CIR),
}
for _name, (_cols, _sqls) in _GEO.items():
    _add(
        _name,
        lambda s, d, cols=_cols: Chain(s, d).boxes().where("bx0 is not null").select("drawing_id", "span_ord", *[r6(c).alias(f"v{i}") for i, c in enumerate(cols())]),
        query(f"SELECT drawing_id, span_ord, {', '.join(f'round({q}, 6) AS v{i}' for i, q in enumerate(_sqls))} FROM ({_BOXES}) WHERE bx0 IS NOT NULL"),
    )

_ALL = ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in zip(_ALL_X, _ALL_Y, strict=True))
_add(
    "A9_corner_extent",
    lambda s, d: Chain(s, d).boxes().select("drawing_id", "span_ord", *[r6(c).alias(f"v{i}") for i, c in enumerate(G.extent([G.project(F.col(x), F.col(y), _H()) for x in ("x0", "x1") for y in ("y0", "y1")]))]),
    query(f"SELECT drawing_id, span_ord, round(min(c.x), 6) AS v0, round(min(c.y), 6) AS v1, round(max(c.x), 6) AS v2, round(max(c.y), 6) AS v3 FROM (SELECT drawing_id, span_ord, unnest([{_ALL}]) AS c FROM ({_BOXES})) GROUP BY drawing_id, span_ord"),
)

# --- balloons ------------------------------------------------------------------------
_DIGITS = "SELECT doc_id, pos - 1 AS token_pos, tok::INT AS char_no, len(toks) AS n_tokens FROM (SELECT doc_id, toks, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda t: t <> '') AS toks FROM documents)) WHERE regexp_full_match(tok, '[0-9]+') AND length(ltrim(tok, '0')) BETWEEN 1 AND 3 AND try_cast(tok AS INT) BETWEEN 1 AND 200"
_SHAPE = "x1 - x0 BETWEEN 5 AND 50 AND y1 - y0 BETWEEN 5 AND 50 AND (x1 - x0) / (y1 - y0) BETWEEN 0.3 AND 2.0"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose text is a balloon number or two, one circle flag each."""
    return table(spark, sf_dir, "items").join(table(spark, sf_dir, "spans_a").drop("text"), ["drawing_id"]).where("ord = span_ord").select(
        "drawing_id", "span_ord", "x0", "y0", (F.col("x0") + 10.0 + F.col("size") % 50).alias("x1"), "y1", (F.col("k") % 3).alias("page"), (F.col("q") % 4 != 0).alias("circle_ok"),
        F.when(F.col("k") % 5 == 0, F.concat_ws(" ", "ord", "size")).when(F.col("k") % 5 == 1, F.concat(F.col("ord"), F.lit("A"))).otherwise((F.col("ord") + F.col("size") * 5).cast("string")).alias("text"),
    )


_NUMBERED = "numbered AS (SELECT i.drawing_id, span_ord, x0, y0, x0 + 10.0 + size % 50 AS x1, y1, k % 3 AS page, q % 4 <> 0 AS circle_ok, CASE WHEN k % 5 = 0 THEN concat(ord, ' ', size) WHEN k % 5 = 1 THEN concat(ord, 'A') ELSE (ord + size * 5)::VARCHAR END AS text FROM items i JOIN spans_a s ON s.drawing_id = i.drawing_id AND s.span_ord = i.ord)"
_TOKENS = "toks AS (SELECT *, x0 + (pos - 1) * w AS tx0, x0 + pos * w AS tx1 FROM (SELECT *, (x1 - x0) / len(parts) AS w, unnest(parts) AS tok, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT *, string_split(text, ' ') AS parts FROM numbered)))"
_LANE = "lane AS (SELECT drawing_id, page, span_ord AS det_ord, (pos - 1)::INT AS token_pos, tok::INT AS char_no, tx0 AS x0, y0, tx1 AS x1, y1, 'pdf_text' AS method, CASE WHEN len(parts) > 1 THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM toks WHERE regexp_full_match(tok, '[0-9]+') AND try_cast(tok AS INT) BETWEEN 1 AND 200 AND tx1 - tx0 BETWEEN 5 AND 50 AND y1 - y0 BETWEEN 5 AND 50 AND (tx1 - tx0) / (y1 - y0) BETWEEN 0.3 AND 2.0 AND circle_ok)"
_SPARSE = "sparse AS (SELECT p.drawing_id, p.page, coalesce(n, 0) AS n FROM (SELECT DISTINCT drawing_id, page FROM numbered) p LEFT JOIN (SELECT drawing_id, page, count(*) AS n FROM lane GROUP BY ALL) USING (drawing_id, page) WHERE coalesce(n, 0) < 3)"


def _with(final: str, *more: str) -> str:
    base = query(" ".join(more) + " " + final)
    head = base[: base.rindex("\n" + " ".join(more) + " " + final)]
    return f"{head}, {', '.join(more)}\n{final}"


def _lane(s: SparkSession, d: str) -> DataFrame:
    return balloons.text_balloons(_numbered(s, d), F.col("circle_ok"))


def _docs_as_spans(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return docs.withColumns({c: F.lit(v) for c, v in zip(G.CORNERS, (0.0, 0.0, 100.0, 10.0), strict=True)})


_add("P11_digit_token", lambda s, d: balloons.digit_tokens(_docs_as_spans(s, d)).select("doc_id", F.col("token_pos").cast("long").alias("token_pos"), "char_no", F.col("n_tokens").cast("long").alias("n_tokens")), _DIGITS)
_add("G10_token_sub_bbox", lambda s, d: balloons.digit_tokens(_numbered(s, d)).select("drawing_id", "span_ord", "token_pos", r6("tx0").alias("tx0"), r6("tx1").alias("tx1")), _with("SELECT drawing_id, span_ord, (pos - 1)::INT AS token_pos, round(tx0, 6) AS tx0, round(tx1, 6) AS tx1 FROM toks WHERE regexp_full_match(tok, '[0-9]+') AND try_cast(tok AS INT) BETWEEN 1 AND 200", _NUMBERED, _TOKENS))
_add("F8_balloon_shape", lambda s, d: table(s, d, "spans_a").where(balloons.balloon_shape((F.col("x0"), F.col("y0"), F.col("x0") + (F.col("x1") - F.col("x0")) / 2, F.col("y1")))).select("drawing_id", "span_ord"), query("SELECT drawing_id, span_ord FROM spans_a WHERE (x1 - x0) / 2 BETWEEN 5 AND 50 AND y1 - y0 BETWEEN 5 AND 50 AND (x1 - x0) / 2 / (y1 - y0) BETWEEN 0.3 AND 2.0"))
_add("B1_text_balloons", lambda s, d: _lane(s, d).select("drawing_id", "page", "det_ord", "token_pos", "char_no", "method", "confidence"), _with("SELECT drawing_id, page, det_ord, token_pos, char_no, method, confidence FROM lane", _NUMBERED, _TOKENS, _LANE))
_add("F11_cv_gate", lambda s, d: balloons.sparse_pages(_numbered(s, d).select("drawing_id", "page").distinct(), _lane(s, d)), _with("SELECT drawing_id, page, n FROM sparse", _NUMBERED, _TOKENS, _LANE, _SPARSE))
_add("U2_union_detections", lambda s, d: balloons.detections(table(s, d, "hits").where("method = 'pdf_text'"), table(s, d, "hits").where("method = 'cv'")).select("drawing_id", "det_ord", "char_no", "method", r6("confidence").alias("confidence")), query("SELECT drawing_id, det_ord, char_no, method, round(confidence, 6) AS confidence FROM hits"))
_add("A2_balloon_dedupe", lambda s, d: Chain(s, d).balloons().select("drawing_id", "char_no", "seen_ord", "method", "det_ord", r6("confidence").alias("confidence")), query("SELECT drawing_id, char_no, seen_ord, method, det_ord, round(confidence, 6) AS confidence FROM balloons"))
_add("S9_balloon_scan", lambda s, d: balloons.dedupe(balloons.detections(_lane(s, d).withColumnRenamed("page", "page_index"), balloons.sparse_pages(_numbered(s, d).select("drawing_id", "page").distinct(), _lane(s, d)).join(table(s, d, "hits").where("method = 'cv'").withColumnRenamed("page_index", "page"), ["drawing_id", "page"]).withColumnRenamed("page", "page_index").drop("n"))).select("drawing_id", "char_no", "seen_ord", "method"), _with("SELECT drawing_id, char_no, min(det_ord) AS seen_ord, arg_max(method, (confidence, -det_ord)) AS method FROM (SELECT drawing_id, char_no, det_ord, confidence, method FROM lane UNION ALL SELECT h.drawing_id, char_no, det_ord, confidence, method FROM hits h JOIN sparse s ON s.drawing_id = h.drawing_id AND s.page = h.page_index WHERE method = 'cv') GROUP BY drawing_id, char_no", _NUMBERED, _TOKENS, _LANE, _SPARSE))

# --- anchors -------------------------------------------------------------------------
_ONE = "drawing_id, char_no"
_extent = lambda s, d: table(s, d, "spans_a").join(anchors.page_extent(table(s, d, "spans_a")), ["drawing_id", "block_id"])
_scores = lambda s, d: anchors.scored_spans(Chain(s, d).linked(), table(s, d, "spans_a"))
_add("J1_form3_x_balloon", lambda s, d: Chain(s, d).linked().select("drawing_id", "char_no", "page", "requirement"), query("SELECT drawing_id, char_no, page, requirement FROM linked"))
_add("A1_page_extent", lambda s, d: anchors.page_extent(table(s, d, "spans_a")), query("SELECT drawing_id, block_id, page_w, page_h FROM extent"))
_add("F1_title_block", lambda s, d: _extent(s, d).where((F.col("y0") > F.col("page_h") * 0.85) | (F.col("x0") > F.col("page_w") * 0.80)).select("drawing_id", "span_ord"), query("SELECT drawing_id, span_ord FROM spans_a JOIN extent USING (drawing_id, block_id) WHERE y0 > 0.85::DOUBLE * page_h OR x0 > 0.80::DOUBLE * page_w"))
_add("F2_long_span", lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(F.length("text") <= 100).select("doc_id"), "SELECT doc_id FROM documents WHERE length(text) <= 100")
_add("F3_blank_span", lambda s, d: s.read.parquet(f"{d}/documents.parquet").where(F.trim("text") != "").select("doc_id"), "SELECT doc_id FROM documents WHERE trim(text) <> ''")
_add("F4_page_filter", lambda s, d: Chain(s, d).linked().join(table(s, d, "spans_a").select("drawing_id", F.col("block_id").alias("page"), "span_ord"), ["drawing_id", "page"]).select("drawing_id", "char_no", "span_ord"), query("SELECT l.drawing_id, char_no, span_ord FROM linked l JOIN spans_a s ON s.drawing_id = l.drawing_id AND s.block_id = l.page"))
_add("M1a_anchor_score", lambda s, d: _scores(s, d).select("drawing_id", "char_no", "span_ord", r6("score").alias("score")), query("SELECT drawing_id, char_no, span_ord, round(score, 6) AS score FROM anchor_scores"))
_add("A3_best_span", lambda s, d: anchors.best_spans(_scores(s, d)).select("drawing_id", "char_no", "req_ord", r6("req_score").alias("req_score")), query("SELECT drawing_id, char_no, req_ord, round(req_score, 6) AS req_score FROM best"))
_add("J2_anchor_best_span", lambda s, d: Chain(s, d).found().select("drawing_id", "char_no", "anchor_ord", "req_ord"), query("SELECT drawing_id, char_no, anchor_ord, req_ord FROM anchors"))
_add("J3_local_context", lambda s, d: Chain(s, d).anchors().select("drawing_id", "char_no", "n_context"), query("SELECT drawing_id, char_no, n_context FROM anchors"))
_add("F7_local_context_radius", lambda s, d: Chain(s, d).anchors().select("drawing_id", "char_no", F.array_join("context_words", " ").alias("words")), query("SELECT drawing_id, char_no, array_to_string(context_words, ' ') AS words FROM anchors"))
_add("A5_max_char_no", lambda s, d: Chain(s, d).found().groupBy("drawing_id").agg(F.max("char_no").alias("last")), query("SELECT drawing_id, max(char_no) AS last FROM anchors GROUP BY drawing_id"))

# --- candidates and scores -----------------------------------------------------------
_PAIR = ["drawing_id", "char_no", "span_ord"]
for _name, _cols in {
    "J4_radius_candidates": ["dist"], "F5_search_radius": ["dist"], "M1_location_score": ["location_score"], "M2_symbol_match": ["symbol_match"], "M3_count_bonus": ["count_bonus"], "M4_numeric_overlap": ["numeric_overlap"],
    "M5_primary_match": ["primary_match"], "M6_primary_penalty": ["primary_penalty"], "M7_class_match": ["class_match"], "M8_text_score": ["text_score"], "M9_context_score": ["context_score"], "M10_total_score": ["total_score"], "A4_primary_value": ["a_primary", "s_primary"],
}.items():
    _add(_name, lambda s, d, cols=_cols: Chain(s, d).pairs().select(*_PAIR, *[r6(c).alias(c) for c in cols]), query(f"SELECT {', '.join(_PAIR)}, {', '.join(f'round({c}, 6) AS {c}' for c in _cols)} FROM pairs"))
_context = lambda s, d: Chain(s, d).places()
_add("J5_candidate_context", lambda s, d: _context(s, d).select("drawing_id", "span_ord", F.size("near_words").alias("n_words")), query("SELECT drawing_id, span_ord, len(near_words)::INT AS n_words FROM places"))
_add("A6_token_union", lambda s, d: _context(s, d).select("drawing_id", "span_ord", F.array_join("near_words", " ").alias("words")), query("SELECT drawing_id, span_ord, array_to_string(near_words, ' ') AS words FROM places"))
_add("F6_context_window", lambda s, d: _context(s, d).where(F.size("near_words") > 0).select("drawing_id", "span_ord"), query("SELECT DISTINCT drawing_id, span_ord FROM span_near WHERE dist > 0 AND dist <= 50"))
_doc_pairs = lambda s, d: _documents(s, d).select("doc_id", X.word_tokens(F.col("n")).alias("ws")).alias("a").join(_documents(s, d).select((F.col("doc_id") - 1).alias("doc_id"), X.word_tokens(F.col("n")).alias("vs")), "doc_id")
_DOC_PAIRS = f"(SELECT a.doc_id, a.ws, b.ws AS vs FROM (SELECT doc_id, {oracle.words(_N)} AS ws FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, {oracle.words(_N)} AS ws FROM documents) b USING (doc_id))"
_add("A7_jaccard", lambda s, d: _doc_pairs(s, d).select("doc_id", r6(candidates.jaccard(F.col("ws"), F.col("vs"))).alias("jaccard")), f"SELECT doc_id, round({oracle.jaccard('ws', 'vs')}, 6) AS jaccard FROM {_DOC_PAIRS}")
_add("U3_token_intersect", lambda s, d: _doc_pairs(s, d).select("doc_id", F.size(F.array_intersect("ws", "vs")).cast("long").alias("both"), F.size(F.array_union("ws", "vs")).cast("long").alias("either")), f"SELECT doc_id, len(list_intersect(ws, vs)) AS both, len(list_distinct(list_concat(ws, vs))) AS either FROM {_DOC_PAIRS}")
_add("U4_token_subset", lambda s, d: Chain(s, d).pairs().select(*_PAIR, (F.size(F.array_except("a_symbols", "s_symbols")) == 0).alias("subset")), query(f"SELECT {', '.join(_PAIR)}, list_has_all(s_symbols, a_symbols) AS subset FROM pairs"))
_add("U5_set_equal", lambda s, d: Chain(s, d).pairs().select(*_PAIR, (F.array_sort("a_counts") == F.array_sort("s_counts")).alias("equal")), query(f"SELECT {', '.join(_PAIR)}, list_sort(a_counts) = list_sort(s_counts) AS equal FROM pairs"))
_add("W1_candidate_topk", lambda s, d: Chain(s, d).cands().select(*_PAIR, "cand_rank", r6("total_score").alias("total_score")), query(f"SELECT {', '.join(_PAIR)}, cand_rank::INT AS cand_rank, round(total_score, 6) AS total_score FROM cands"))
_SET = lambda x: f"'{{' || array_to_string(list_transform(list_sort({x}), lambda v: '''' || v || ''''), ', ') || '}}'"
_FLOAT = lambda x: f"CASE WHEN {x} = floor({x}) THEN {x}::HUGEINT::VARCHAR || '.0' ELSE {x}::VARCHAR END"
_REASON_PARTS = f"list_filter([CASE WHEN symbol_match > 0 THEN 'symbols: ' || {_SET('list_intersect(a_symbols, s_symbols)')} END, CASE WHEN count_bonus > 0 THEN 'counts: ' || {_SET('a_counts')} || ' vs ' || {_SET('s_counts')} END, CASE WHEN numeric_overlap > 0 THEN 'numerics: ' || trunc(numeric_overlap * 100)::INT || '%' END, CASE WHEN primary_match > 0 THEN 'primary=' || {_FLOAT('a_primary')} END], lambda x: x IS NOT NULL)"
_add(
    "M11_reasons",
    lambda s, d: Chain(s, d).cands().select(*_PAIR, F.array_join(candidates.reasons(), "; ").alias("reasons")),
    query(f"""SELECT {', '.join(_PAIR)}, array_to_string(list_filter([CASE WHEN location_score > 0 THEN format('within {{:.1f}} mm of predicted location', dist * 25.4{D} / 72.0{D}) END, CASE WHEN primary_penalty > 0 THEN 'primary value ' || {_FLOAT('a_primary')} || ' not found in span' END,
      CASE WHEN len({_REASON_PARTS}) > 0 THEN 'matched: ' || array_to_string({_REASON_PARTS}, ', ') END, CASE WHEN context_score > 0 THEN format('context similarity: {{:.2f}}', context_score) END], lambda x: x IS NOT NULL), '; ') AS reasons FROM cands"""),
)

# --- assignment and classification ---------------------------------------------------
_add("W2_edge_order", lambda s, d: assignment.ordered_edges(Chain(s, d).cands()).select(*_PAIR, F.col("edge_ord").cast("long").alias("edge_ord")), query(f"SELECT {', '.join(_PAIR)}, edge_ord FROM edges"))
_add("I1_greedy_assign", lambda s, d: Chain(s, d).matched().select(*_PAIR), query(f"SELECT {', '.join(_PAIR)} FROM matched"))
_add("J6_anchor_match", lambda s, d: Chain(s, d).classes().select("drawing_id", "char_no", "matched", "span_ord"), query("SELECT drawing_id, char_no, matched, span_ord FROM classes"))
for _k, _status in (("C1_removed", "C1"), ("C2_count_changed", "C2"), ("C3_unchanged", "C3"), ("C4_numeric_changed", "C4"), ("C5_location_unchanged", "C5"), ("C6_uncertain", "C6")):
    _add(_k, lambda s, d, b=_status: Chain(s, d).classes().where(F.col("branch") == b).select("drawing_id", "char_no", "status", r6("confidence").alias("confidence")), query(f"SELECT drawing_id, char_no, status, round(confidence, 6) AS confidence FROM classes WHERE branch = '{_status}'"))
_add("C7_location_reason", lambda s, d: Chain(s, d).classes().where(F.array_contains("reasons", "High location agreement after global alignment")).select("drawing_id", "char_no"), query("SELECT drawing_id, char_no FROM classes WHERE matched AND location_score > 0.7"))
_add("C8_clip", lambda s, d: Chain(s, d).classes().select("drawing_id", "char_no", "branch", r6("confidence").alias("confidence")), query("SELECT drawing_id, char_no, branch, round(confidence, 6) AS confidence FROM classes"))
_add("C9_scores_map", lambda s, d: Chain(s, d).classes().select("drawing_id", "char_no", *[r6(F.col("scores")[k]).alias(k) for k in ("location", "text", "context")]), query("SELECT drawing_id, char_no, CASE WHEN matched THEN round(location_score, 6) ELSE 0 END AS location, CASE WHEN matched THEN round(ov, 6) ELSE 0 END AS text, CASE WHEN matched THEN round(context_score, 6) ELSE 0 END AS context FROM classes"))
_LIST = lambda x: f"'[' || array_to_string(list_transform(list_sort({x}), lambda v: {_FLOAT('v')}), ', ') || ']'"
_PCT = "trunc(ov * 100)::INT"
oracle.CTES["class_reasons"] = f"""class_reasons AS (SELECT drawing_id, char_no, array_to_string(list_filter([CASE branch WHEN 'C1' THEN 'No candidate found within search window' WHEN 'C2' THEN 'Count changed: ' || {_SET('a_counts')} || ' → ' || {_SET('s_counts')}
      WHEN 'C3' THEN 'Numeric values match (' || {_PCT} || '% overlap)' WHEN 'C4' THEN 'Numeric values changed (only ' || {_PCT} || '% overlap)' WHEN 'C5' THEN 'Location strongly suggests same requirement' ELSE 'Weak match confidence' END,
      CASE WHEN branch = 'C3' AND len(a_counts) > 0 AND list_sort(a_counts) = list_sort(s_counts) THEN 'Count tokens match: ' || {_SET('a_counts')} WHEN branch = 'C4' THEN 'Anchor: ' || {_LIST('a_numbers')} || ', Matched: ' || {_LIST('s_numbers')} WHEN branch = 'C5' THEN 'Numeric overlap: ' || {_PCT} || '%' END,
      CASE WHEN matched AND location_score > 0.7 THEN 'High location agreement after global alignment' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM classes)"""
_add("C11_reasons", lambda s, d: Chain(s, d).classes().select("drawing_id", "char_no", F.array_join("reasons", "; ").alias("reasons")), query("SELECT * FROM class_reasons"))
_add("J7_unmatched_spans", lambda s, d: classification.unmatched(table(s, d, "spans_b"), Chain(s, d).matched()).select("drawing_id", "span_ord"), query("SELECT drawing_id, span_ord FROM free_spans"))
_add("U6_key_difference", lambda s, d: classification.unmatched(table(s, d, "spans_b"), Chain(s, d).matched()).groupBy("drawing_id").agg(F.count("*").alias("n")), query("SELECT drawing_id, count(*) AS n FROM free_spans GROUP BY drawing_id"))
_add("F9_added_filter", lambda s, d: classification.looks_new(table(s, d, "spans_b")).select("drawing_id", "span_ord"), query(f"SELECT drawing_id, span_ord FROM places WHERE length(trim(text)) >= 3 AND len(s_numbers) > 0 AND (len(s_symbols) > 0 OR len(s_counts) > 0) AND NOT regexp_matches({oracle.norm('text')}, 'ADDED|NEW|REVISED|DELETED')"))
_WORDS = lambda x: f"'[' || array_to_string(list_transform({x}, lambda v: '''' || v || ''''), ', ') || ']'"
oracle.CTES["added_reasons"] = f"""added_reasons AS (SELECT drawing_id, char_no, @TEXT@ || trim(text) || '"; ' || @MARKS@ || {_WORDS('s_symbols')} || ', Counts: ' || {_WORDS(oracle.counts(oracle.norm('text')))} AS reasons FROM added)""".replace("@TEXT@", f"'{classification.NEW_TEXT}'").replace("@MARKS@", f"'{classification.NEW_MARKS}'")
_add("C10_added", lambda s, d: Chain(s, d).added().select("drawing_id", "char_no", "span_ord", r6("confidence").alias("confidence"), F.array_join("reasons", "; ").alias("reasons")), query("SELECT a.drawing_id, a.char_no, a.span_ord, round(a.confidence, 6) AS confidence, reasons FROM added a JOIN added_reasons r ON r.drawing_id = a.drawing_id AND r.char_no = a.char_no"))
_add("W4_added_numbering", lambda s, d: Chain(s, d).added().select("drawing_id", "span_ord", "char_no"), query("SELECT drawing_id, span_ord, char_no FROM added"))
_ITEMS = ["drawing_id", "is_added", "item_ord", "char_no", "status"]
_add("U1_union_items", lambda s, d: Chain(s, d).items().select(*_ITEMS, r6("confidence").alias("confidence")), query(f"SELECT {', '.join(_ITEMS)}, round(confidence, 6) AS confidence FROM all_items"))
_add("W6_item_order", lambda s, d: packets.numbered(Chain(s, d).items()).select("drawing_id", "item_no", "char_no", "status"), query("SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY is_added, item_ord)::INT AS item_no, char_no, status FROM all_items"))
_add("A11_status_counts", flagship, query("SELECT status, count(*) AS n FROM all_items GROUP BY status"))
_add("A12_coverage_metrics", lambda s, d: classification.coverage_metrics(table(s, d, "form3"), Chain(s, d).taken(), Chain(s, d).classes()).select("drawing_id", *[r6(c).alias(c) for c in ("anchor_coverage", "match_rate", "uncertain_rate")]), query("SELECT drawing_id, round(coalesce(n_anchors, 0) / n_chars::DOUBLE, 6) AS anchor_coverage, round(match_rate, 6) AS match_rate, round(uncertain_rate, 6) AS uncertain_rate FROM (SELECT drawing_id, count(DISTINCT char_no) AS n_chars FROM form3 GROUP BY drawing_id) LEFT JOIN (SELECT drawing_id, count(*) AS n_anchors FROM anchors GROUP BY drawing_id) USING (drawing_id) LEFT JOIN (SELECT drawing_id, avg(matched::INT::DOUBLE) AS match_rate, avg((status = 'uncertain')::INT::DOUBLE) AS uncertain_rate FROM classes GROUP BY drawing_id) USING (drawing_id)"))

for _module in (form3, alignment, evidence, packets, cases):
    for _name, (_run, _sql) in _module.registered(Chain, table, query).items():
        _add(_name, _run, _sql)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
