"""Evidence regions of items on both revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import geometry as G
from revlens.functions import text as X

GAP, LINE, GROWTH = 20.0, 8.0, 150.0
FALLBACK_RADIUS, LEAST_DISTANCE = 200.0, 10.0


def adjacent(boxes: DataFrame, spans: DataFrame, line: float = LINE) -> DataFrame:
    """Spans on the line of each box (drawing_id, item, x0..y1), as ``s`` rows. Lines are cells twice as high as ``line``, of which a box touches two at most."""
    cell = lambda c: F.floor(c / F.lit(2 * line))
    sp = spans.select("drawing_id", "span_ord", *G.named(G.box(), "s")).withColumn("_line", cell((F.col("sy0") + F.col("sy1")) / 2))
    cy, height = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    boxes = boxes.select("*", F.explode(F.array_distinct(F.array(cell(cy - line), cell(cy + line)))).alias("_line"))
    return boxes.join(sp, ["drawing_id", "_line"]).drop("_line").where(G.same_line(G.box("s"), cy, height, line))


def expanded(boxes: DataFrame, spans: DataFrame, gap: float = GAP, line: float = LINE, growth: float = GROWTH) -> DataFrame:
    """Boxes grown over neighbours on their line: an ordered fold, since each absorbed span moves an edge.

    Growth beyond the limit falls back to half of it on both sides; then the
    absorbed spans that overlap stretch the box upwards and downwards. Adds
    e0..e3 and ``n_included``.
    """
    keys = ["drawing_id", "item"]
    rows = adjacent(boxes, spans, line).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("span_ord", "sx0", "sy0", "sx1", "sy1"))).alias("line_spans"))
    rows = boxes.join(rows, keys, "left")
    none = F.expr("array()").cast("array<struct<span_ord:int,sx0:double,sy0:double,sx1:double,sy1:double>>")
    start = F.struct(F.col("x0").alias("l"), F.col("x1").alias("r"), none.alias("kept"))

    def step(a, s):
        left, right = a["l"] - s["sx1"], s["sx0"] - a["r"]
        to_left, to_right = (left >= 0) & (left <= gap), (right >= 0) & (right <= gap)
        return F.struct(
            F.when(to_left, F.least(a["l"], s["sx0"])).otherwise(a["l"]).alias("l"),
            F.when(~to_left & to_right, F.greatest(a["r"], s["sx1"])).otherwise(a["r"]).alias("r"),
            F.when(to_left | to_right, F.concat(a["kept"], F.array(s))).otherwise(a["kept"]).alias("kept"),
        )

    rows = rows.withColumn("fold", F.aggregate(F.coalesce("line_spans", none), start, step))
    far = (F.col("fold.r") - F.col("fold.l")) - (F.col("x1") - F.col("x0")) > growth
    rows = rows.withColumns({"e0": F.when(far, F.col("x0") - growth / 2).otherwise(F.col("fold.l")), "e2": F.when(far, F.col("x1") + growth / 2).otherwise(F.col("fold.r"))})
    touching = F.filter("fold.kept", lambda s: (s["sx1"] >= F.col("e0")) & (s["sx0"] <= F.col("e2")))
    rows = rows.withColumns({
        "e1": F.aggregate(touching, F.col("y0"), lambda a, s: F.least(a, s["sy0"])), "e3": F.aggregate(touching, F.col("y1"), lambda a, s: F.greatest(a, s["sy1"])),
        "n_included": F.size("fold.kept"), "limited": far,
    })
    return rows.drop("fold", "line_spans")


def fallback_spans(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """For anchors (b* boxes, requirement): the near span that shares most number strings per distance."""
    bx, by = G.center(G.box("b"))
    probe = anchors.select("drawing_id", "char_no", X.numeric_strings(F.col("requirement")).alias("want"), bx.alias("bcx"), by.alias("bcy")).where(F.size("want") > 0)
    sp = spans.select("drawing_id", "span_ord", *G.named(G.box(), "f"), X.numeric_strings(F.col("text")).alias("have"), ((F.col("x0") + F.col("x1")) / 2).alias("fcx"), ((F.col("y0") + F.col("y1")) / 2).alias("fcy"))
    near = G.grid_join(probe, sp, ["drawing_id"], ("bcx", "bcy"), ("fcx", "fcy"), FALLBACK_RADIUS)
    near = near.withColumn("shared", F.size(F.array_intersect("want", "have"))).where("shared > 0")
    near = near.withColumn("value", F.col("shared") / F.greatest(F.col("dist"), F.lit(LEAST_DISTANCE)))
    best = F.max_by(F.struct("span_ord", "fx0", "fy0", "fx1", "fy1", "value"), F.struct("value", -F.col("span_ord"))).alias("b")
    return near.groupBy("drawing_id", "char_no").agg(best).select("drawing_id", "char_no", "b.*")


def evidence(items: DataFrame, anchors: DataFrame, spans_a: DataFrame, spans_b: DataFrame) -> DataFrame:
    """Both regions of every item; a region that an item does not have is null."""
    known = anchors.select("drawing_id", "char_no", "page", "requirement", *[f"b{c}" for c in G.CORNERS], *[f"r{c}" for c in G.CORNERS])
    fallback = fallback_spans(known.where("rx0 is null"), spans_a).drop("span_ord", "value")
    known = known.join(fallback, ["drawing_id", "char_no"], "left")
    notes = known.select("drawing_id", F.col("char_no").alias("item"), *[F.coalesce(f"r{c}", f"f{c}").alias(c) for c in G.CORNERS]).where("x0 is not null")
    grown_a = expanded(notes, spans_a).select("drawing_id", F.col("item").alias("char_no"), *[F.col(f"e{i}").alias(f"a{i}") for i in range(4)])
    known = known.join(grown_a, ["drawing_id", "char_no"], "left")
    note = tuple(F.col(f"a{i}") for i in range(4))
    window = [F.when(F.col("a0").isNotNull(), w).otherwise(g) for w, g in zip(G.window_around(note, G.box("b")), G.grown(G.box("b"), 240.0, 240.0), strict=True)]
    known = known.select("drawing_id", "char_no", "page", *[w.alias(f"wa{i}") for i, w in enumerate(window)])
    placed = items.where("x0 is not null").withColumn("item", F.col("char_no") * 2 + F.col("is_added"))
    grown_b = expanded(placed.select("drawing_id", "item", *G.CORNERS), spans_b).select("drawing_id", "item", *[F.col(f"e{i}").alias(f"wb{i}") for i in range(4)])
    rows = items.withColumn("item", F.col("char_no") * 2 + F.col("is_added")).join(grown_b, ["drawing_id", "item"], "left").join(known, ["drawing_id", "char_no"], "left")
    a, b = tuple(F.col(f"wa{i}") for i in range(4)), tuple(F.col(f"wb{i}") for i in range(4))
    both = F.col("wa0").isNotNull() & F.col("wb0").isNotNull()
    na, nb = G.same_size(a, b)
    sized = {f"ea{i}": F.when(both, na[i]).otherwise(a[i]) for i in range(4)} | {f"eb{i}": F.when(both, nb[i]).otherwise(b[i]) for i in range(4)}
    return rows.withColumns(sized).drop("item", *[f"w{r}{i}" for r in "ab" for i in range(4)])


def registered(chain, table, query):
    from revlens.plans.oracle import CTES, D, dist

    r = lambda c: F.round(c, 6)
    strings = lambda t: rf"list_distinct(regexp_extract_all({t}, '\d+\.?\d*'))"
    CTES["fallback"] = f"fallback AS (SELECT drawing_id, char_no, b.* FROM (SELECT drawing_id, char_no, arg_max(struct_pack(span_ord := span_ord, fx0 := x0, fy0 := y0, fx1 := x1, fy1 := y1, value := v), (v, -span_ord)) AS b FROM (SELECT *, shared / greatest(d, 10.0{D}) AS v FROM (SELECT c.drawing_id, c.char_no, s.span_ord, s.x0, s.y0, s.x1, s.y1, {dist('(s.x0 + s.x1) / 2', '(s.y0 + s.y1) / 2', '(bx0 + bx1) / 2', '(by0 + by1) / 2')} AS d, len(list_intersect({strings('c.requirement')}, {strings('s.text')})) AS shared FROM centered c JOIN spans_a s USING (drawing_id)) WHERE d <= 200 AND shared > 0) GROUP BY drawing_id, char_no))"
    CTES["line_pairs"] = f"line_pairs AS (SELECT b.drawing_id, b.span_ord AS item, b.x0, b.y0, b.x1, b.y1, s.span_ord, s.x0 AS sx0, s.y0 AS sy0, s.x1 AS sx1, s.y1 AS sy1, row_number() OVER (PARTITION BY b.drawing_id, b.span_ord ORDER BY s.span_ord) AS rn FROM spans_b b JOIN spans_b s USING (drawing_id) WHERE abs((s.y0 + s.y1) / 2 - (b.y0 + b.y1) / 2) <= 8 AND least(s.y1 - s.y0, b.y1 - b.y0) / greatest(s.y1 - s.y0, b.y1 - b.y0, 1.0{D}) >= 0.5)"
    CTES["fold"] = """fold AS (SELECT drawing_id, span_ord AS item, x0, y0, x1, y1, x0 AS l, x1 AS r, 0::BIGINT AS rn, [{'x0': 0::DOUBLE, 'y0': 0::DOUBLE, 'x1': 0::DOUBLE, 'y1': 0::DOUBLE}][1:0] AS kept FROM spans_b
      UNION ALL SELECT f.drawing_id, f.item, f.x0, f.y0, f.x1, f.y1, CASE WHEN l - sx1 BETWEEN 0 AND 20 THEN least(l, sx0) ELSE l END, CASE WHEN NOT (l - sx1 BETWEEN 0 AND 20) AND sx0 - r BETWEEN 0 AND 20 THEN greatest(r, sx1) ELSE r END, p.rn,
        CASE WHEN l - sx1 BETWEEN 0 AND 20 OR sx0 - r BETWEEN 0 AND 20 THEN list_append(kept, {'x0': sx0, 'y0': sy0, 'x1': sx1, 'y1': sy1}) ELSE kept END
      FROM fold f JOIN line_pairs p ON p.drawing_id = f.drawing_id AND p.item = f.item AND p.rn = f.rn + 1)"""
    CTES["folded"] = "folded AS (SELECT *, CASE WHEN (r - l) - (x1 - x0) > 150 THEN x0 - 75 ELSE l END AS e0, CASE WHEN (r - l) - (x1 - x0) > 150 THEN x1 + 75 ELSE r END AS e2 FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY drawing_id, item ORDER BY rn DESC) = 1))"
    CTES["expanded_b"] = "expanded_b AS (SELECT drawing_id, item, len(kept) AS n_included, e0, least(y0, coalesce(list_min(list_transform(list_filter(kept, lambda k: k.x1 >= e0 AND k.x0 <= e2), lambda k: k.y0)), y0)) AS e1, e2, greatest(y1, coalesce(list_max(list_transform(list_filter(kept, lambda k: k.x1 >= e0 AND k.x0 <= e2), lambda k: k.y1)), y1)) AS e3 FROM folded)"
    boxes = lambda s, d: table(s, d, "spans_b").select("drawing_id", F.col("span_ord").alias("item"), *G.CORNERS)

    regions = lambda s, d: chain(s, d).regions()

    return {
        "J9_adjacent_spans": (lambda s, d: adjacent(boxes(s, d), table(s, d, "spans_b")).select("drawing_id", "item", "span_ord"), query("SELECT drawing_id, item, span_ord FROM line_pairs")),
        "I2_bbox_fold": (lambda s, d: expanded(boxes(s, d), table(s, d, "spans_b")).select("drawing_id", "item", *[r(f"e{i}").alias(f"e{i}") for i in range(4)], F.col("n_included").cast("long").alias("n_included")), query("SELECT drawing_id, item, round(e0, 6) AS e0, round(e1, 6) AS e1, round(e2, 6) AS e2, round(e3, 6) AS e3, n_included FROM expanded_b")),
        "J10_fallback_span": (lambda s, d: fallback_spans(chain(s, d).linked(), table(s, d, "spans_a")).select("drawing_id", "char_no", "span_ord", r("value").alias("value")), query("SELECT drawing_id, char_no, span_ord, round(value, 6) AS value FROM fallback")),
        "F10_fallback_radius": (lambda s, d: fallback_spans(chain(s, d).linked(), table(s, d, "spans_a")).select("drawing_id", "char_no"), query("SELECT drawing_id, char_no FROM fallback")),
        "J8_item_anchor": (lambda s, d: chain(s, d).each(lambda items, anchors: items.join(anchors.select("drawing_id", "char_no", "page"), ["drawing_id", "char_no"], "left").select("drawing_id", "is_added", "char_no", "page")), query("SELECT i.drawing_id, is_added, i.char_no, page FROM all_items i LEFT JOIN anchors a ON a.drawing_id = i.drawing_id AND a.char_no = i.char_no")),
        "E1_evidence_builder": (lambda s, d: regions(s, d).select("drawing_id", "is_added", "char_no", *[r(f"ea{i}").alias(f"ea{i}") for i in range(4)], *[r(f"eb{i}").alias(f"eb{i}") for i in range(4)]), _evidence_sql(query, CTES, D)),
    }


def _evidence_sql(query, ctes, d):
    """The same regions as SQL: annotation folds on the old revision, span folds on the new one."""
    base = {k: ctes[k] for k in ("line_pairs", "fold", "folded", "expanded_b")}
    ctes["note_boxes"] = "note_boxes AS (SELECT c.drawing_id, c.char_no AS item, coalesce(rx0, fx0) AS x0, coalesce(ry0, fy0) AS y0, coalesce(rx1, fx1) AS x1, coalesce(ry1, fy1) AS y1 FROM centered c LEFT JOIN fallback f ON c.rx0 IS NULL AND f.drawing_id = c.drawing_id AND f.char_no = c.char_no WHERE coalesce(rx0, fx0) IS NOT NULL)"
    ctes["line_pairs_n"] = base["line_pairs"].replace("line_pairs AS", "line_pairs_n AS").replace("b.span_ord", "b.item").replace("spans_b b JOIN spans_b s", "note_boxes b JOIN spans_a s")
    ctes["fold_n"] = base["fold"].replace("fold AS", "fold_n AS").replace("span_ord AS item, x0", "item, x0").replace("FROM spans_b", "FROM note_boxes").replace("fold f JOIN line_pairs p", "fold_n f JOIN line_pairs_n p")
    ctes["folded_n"] = base["folded"].replace("folded AS", "folded_n AS").replace("FROM fold ", "FROM fold_n ")
    ctes["expanded_n"] = base["expanded_b"].replace("expanded_b AS", "expanded_n AS").replace("FROM folded", "FROM folded_n")
    cx, cy = "((n.e0 + n.e2) / 2)", "((n.e1 + n.e3) / 2)"
    hw = f"greatest({cx} - n.e0, n.e2 - {cx}, {cx} - bx0, bx1 - {cx}, 120.0{d})"
    hh = f"greatest({cy} - n.e1, n.e3 - {cy}, {cy} - by0, by1 - {cy}, 120.0{d})"
    gx, gy = f"greatest((240.0{d} - (bx1 - bx0)) / 2, 0.0{d})", f"greatest((240.0{d} - (by1 - by0)) / 2, 0.0{d})"
    side = lambda w, g: f"CASE WHEN n.e0 IS NOT NULL THEN {w} ELSE {g} END"
    ctes["window_a"] = f"window_a AS (SELECT c.drawing_id, c.char_no, {side(f'{cx} - {hw}', f'bx0 - {gx}')} AS wa0, {side(f'{cy} - {hh}', f'by0 - {gy}')} AS wa1, {side(f'{cx} + {hw}', f'bx1 + {gx}')} AS wa2, {side(f'{cy} + {hh}', f'by1 + {gy}')} AS wa3 FROM centered c LEFT JOIN expanded_n n ON n.drawing_id = c.drawing_id AND n.item = c.char_no)"
    ctes["both_windows"] = "both_windows AS (SELECT i.drawing_id, i.is_added, i.char_no, wa0, wa1, wa2, wa3, b.e0 AS wb0, b.e1 AS wb1, b.e2 AS wb2, b.e3 AS wb3 FROM all_items i LEFT JOIN window_a a ON a.drawing_id = i.drawing_id AND a.char_no = i.char_no LEFT JOIN expanded_b b ON b.drawing_id = i.drawing_id AND b.item = i.span_ord)"
    w, h = "(greatest(wa2 - wa0, wb2 - wb0) / 2)", "(greatest(wa3 - wa1, wb3 - wb1) / 2)"
    parts = []
    for r in "ab":
        mid_x, mid_y = f"((w{r}0 + w{r}2) / 2)", f"((w{r}1 + w{r}3) / 2)"
        for i, v in enumerate((f"{mid_x} - {w}", f"{mid_y} - {h}", f"{mid_x} + {w}", f"{mid_y} + {h}")):
            parts.append(f"round(CASE WHEN wa0 IS NOT NULL AND wb0 IS NOT NULL THEN {v} ELSE w{r}{i} END, 6) AS e{r}{i}")
    ctes["regions"] = f"regions AS (SELECT drawing_id, is_added, char_no, {', '.join(parts)} FROM both_windows)"
    return query("SELECT * FROM regions")
