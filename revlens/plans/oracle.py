"""The operators again, as DuckDB SQL over common table expressions."""

from __future__ import annotations

from revlens.functions.text import TYPE_WORDS
from revlens.plans.demo import CTES as DEMO

NUM = r"\d+\.?\d*"


def norm(t: str) -> str:
    return rf"trim(regexp_replace(upper(replace({t}, 'ß', 'SS')), '\s+', ' ', 'g'))"


def ascii_letters(n: str) -> str:
    return rf"regexp_replace({n}, '[^\PL\x00-\x7F]', 'Q', 'g')"


def counts(n: str) -> str:
    return rf"list_transform(regexp_extract_all({ascii_letters(n)}, '\b(\d+)\s*X\b', 1), lambda x: x || 'X')"


def types(n: str) -> str:
    return f"list_filter([{', '.join(repr(w) for w in TYPE_WORDS)}], lambda w: contains({n}, w))"


def symbols(t: str, n: str) -> str:
    return rf"list_filter([CASE WHEN contains({t}, 'Ø') THEN 'Ø' END, CASE WHEN regexp_matches({n}, 'R[\d.]') THEN 'R' END], lambda x: x IS NOT NULL)"


def numbers(n: str) -> str:
    return f"list_transform(regexp_extract_all({n}, '{NUM}'), lambda x: x::DOUBLE)"


def units(n: str) -> str:
    a = ascii_letters(n)
    return "CASE " + " ".join(rf"WHEN regexp_matches({a}, '\b{u}\b') THEN '{u}'" for u in ("MM", "IN", "DEG")) + " END"


def kind(t: str, n: str) -> str:
    has = lambda *ws: " OR ".join(f"contains({n}, '{w}')" for w in ws)
    return (
        rf"CASE WHEN {has('NOTES')} THEN 'note' WHEN {has('THREAD')} OR regexp_matches({n}, '[MG]\d+') THEN 'hole' WHEN {has('RADIUS')} OR starts_with({n}, 'R ') THEN 'fillet' "
        f"WHEN {has('DIAMETER', 'COUNTERBORE', 'COUNTERSINK')} OR contains({t}, 'Ø') THEN 'hole' WHEN {has('THRU ALL')} THEN 'hole' WHEN {has('LENGTH', 'DEPTH', 'ANGLE')} THEN 'dimension' ELSE 'other' END"
    )


def words(n: str) -> str:
    return f"list_distinct(list_filter(string_split({n}, ' '), lambda w: w <> ''))"


def tokens(text: str, p: str) -> str:
    n = norm(text)
    return f"list_distinct({counts(n)}) AS {p}counts, {symbols(text, n)} AS {p}symbols, list_distinct({numbers(n)}) AS {p}numbers, {words(n)} AS {p}words, {kind(text, n)} AS {p}kind"


def dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt((({ax}) - ({bx})) * (({ax}) - ({bx})) + (({ay}) - ({by})) * (({ay}) - ({by})))"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a})::DOUBLE WHEN len({b}) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} > 0 THEN len(list_intersect({a}, {b})) / {union}::DOUBLE ELSE 0.0::DOUBLE END"


D = "::DOUBLE"
PAIRS_TOTAL = f"greatest(0.0{D}, 0.35{D} * location_score + 0.50{D} * text_score + 0.15{D} * context_score - primary_penalty)"
TEXT_SCORE = f"0.15{D} * symbol_match + 0.15{D} * count_bonus + 0.50{D} * numeric_overlap + 0.10{D} * class_match + 0.10{D} * primary_match"
EMPTY = "[]::VARCHAR[]"

CTES: dict[str, str] = DEMO | {
    "balloons": "balloons AS (SELECT drawing_id, char_no, min(det_ord) AS seen_ord, unnest(arg_max(struct_pack(page_index := page_index, x0 := x0, y0 := y0, x1 := x1, y1 := y1, method := method, confidence := confidence, det_ord := det_ord), (confidence, -det_ord))) FROM hits GROUP BY drawing_id, char_no)",
    "linked": "linked AS (SELECT f.drawing_id, f.char_no, f.row_ord AS anchor_ord, f.requirement, b.page_index AS page, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM form3 f JOIN balloons b USING (drawing_id, char_no))",
    "extent": "extent AS (SELECT drawing_id, block_id, coalesce(max(x1), 1000.0) AS page_w, coalesce(max(y1), 1000.0) AS page_h FROM spans_a GROUP BY drawing_id, block_id)",
    "usable": "usable AS (SELECT s.* FROM spans_a s JOIN extent e USING (drawing_id, block_id) WHERE NOT (y0 > 0.85::DOUBLE * page_h OR x0 > 0.80::DOUBLE * page_w) AND length(text) <= 100 AND trim(text) <> '')",
    "anchor_scores": f"""anchor_scores AS (SELECT *, 0.5{D} * jac + 0.4{D} * (1.0{D} / (1.0{D} + {dist("(x0 + x1) / 2", "(y0 + y1) / 2", "(bx0 + bx1) / 2", "(by0 + by1) / 2")} / 100.0{D})) - 0.1{D} * least((x1 - x0) * (y1 - y0) / 5000.0{D}, 0.3{D}) AS score
      FROM (SELECT l.*, s.span_ord, s.x0, s.y0, s.x1, s.y1, {jaccard(words(norm("l.requirement")), words(norm("s.text")))} AS jac FROM linked l JOIN usable s ON s.drawing_id = l.drawing_id AND s.block_id = l.page))""",
    "best": "best AS (SELECT drawing_id, char_no, req.* FROM (SELECT drawing_id, char_no, arg_max(struct_pack(req_ord := span_ord, req_score := score, rx0 := x0, ry0 := y0, rx1 := x1, ry1 := y1), (score, -span_ord)) AS req FROM anchor_scores GROUP BY drawing_id, char_no) WHERE req.req_score > 0.2)",
    "centered": "centered AS (SELECT l.*, req_ord, req_score, rx0, ry0, rx1, ry1, coalesce((rx0 + rx1) / 2, (bx0 + bx1) / 2) AS acx, coalesce((ry0 + ry1) / 2, (by0 + by1) / 2) AS acy FROM linked l LEFT JOIN best USING (drawing_id, char_no))",
    "anchor_near": f"anchor_near AS (SELECT c.drawing_id, c.char_no, s.span_ord, {words(norm('s.text'))} AS ws FROM centered c JOIN spans_a s ON s.drawing_id = c.drawing_id AND s.block_id = c.page WHERE {dist('(s.x0 + s.x1) / 2', '(s.y0 + s.y1) / 2', 'acx', 'acy')} <= 150.0)",
    "anchors": f"anchors AS (SELECT c.*, coalesce(context_words, {EMPTY}) AS context_words, coalesce(n_context, 0) AS n_context FROM centered c LEFT JOIN (SELECT drawing_id, char_no, list_sort(list_distinct(flatten(list(ws)))) AS context_words, count(*) AS n_context FROM anchor_near GROUP BY drawing_id, char_no) USING (drawing_id, char_no))",
    "predicted": "predicted AS (SELECT a.*, (h00 * acx + h01 * acy + h02) / (h20 * acx + h21 * acy + h22) AS px, (h10 * acx + h11 * acy + h12) / (h20 * acx + h21 * acy + h22) AS py FROM anchors a JOIN transforms USING (drawing_id))",
    "span_near": f"span_near AS (SELECT a.drawing_id, a.span_ord, b.span_ord AS other_ord, {words(norm('b.text'))} AS ws, {dist('(b.x0 + b.x1) / 2', '(b.y0 + b.y1) / 2', '(a.x0 + a.x1) / 2', '(a.y0 + a.y1) / 2')} AS dist FROM spans_b a JOIN spans_b b ON a.drawing_id = b.drawing_id AND a.block_id = b.block_id)",
    "places": f"places AS (SELECT s.*, {tokens('s.text', 's_')}, coalesce(near_words, {EMPTY}) AS near_words FROM spans_b s LEFT JOIN (SELECT drawing_id, span_ord, list_sort(list_distinct(flatten(list(ws)))) AS near_words FROM span_near WHERE dist > 0 AND dist <= 50 GROUP BY drawing_id, span_ord) USING (drawing_id, span_ord))",
    "pairs0": f"pairs0 AS (SELECT p.drawing_id, p.char_no, p.anchor_ord, p.requirement, p.context_words, p.px, p.py, {tokens('p.requirement', 'a_')}, s.span_ord, s.text, s.block_id, s.line_id, s.span_id, s.x0, s.y0, s.x1, s.y1, s.s_counts, s.s_symbols, s.s_numbers, s.s_kind, s.near_words, {dist('(s.x0 + s.x1) / 2', '(s.y0 + s.y1) / 2', 'px', 'py')} AS dist FROM predicted p JOIN places s USING (drawing_id))",
    "pairs1": f"""pairs1 AS (SELECT *, 1.0{D} - least(dist / 144.0{D}, 1.0{D}) AS location_score, CASE WHEN len(a_symbols) > 0 THEN len(list_intersect(a_symbols, s_symbols)) / greatest(len(a_symbols), 1){D} ELSE 0.0{D} END AS symbol_match,
      CASE WHEN len(a_counts) > 0 AND len(s_counts) > 0 THEN 1.0{D} ELSE 0.0{D} END AS count_bonus, {overlap("a_numbers", "s_numbers")} AS numeric_overlap, list_max(a_numbers) AS a_primary, list_max(s_numbers) AS s_primary,
      CASE WHEN a_kind = s_kind THEN 1.0{D} ELSE 0.0{D} END AS class_match, {jaccard("context_words", "near_words")} AS context_score FROM pairs0 WHERE dist <= 144.0)""",
    "pairs2": f"""pairs2 AS (SELECT *, CASE WHEN coalesce(a_primary = s_primary, false) THEN 1.0{D} ELSE 0.0{D} END AS primary_match,
      CASE WHEN len(s_numbers) > 0 AND a_primary IS NOT NULL AND NOT list_contains(s_numbers, a_primary) THEN 0.4{D} ELSE 0.0{D} END AS primary_penalty FROM pairs1)""",
    "pairs3": f"pairs3 AS (SELECT *, {TEXT_SCORE} AS text_score FROM pairs2)",
    "pairs": f"pairs AS (SELECT *, {PAIRS_TOTAL} AS total_score FROM pairs3)",
    "cands": "cands AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, char_no ORDER BY total_score DESC, span_ord) AS cand_rank FROM pairs) WHERE cand_rank <= 5)",
    "edges": "edges AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY total_score DESC, anchor_ord, cand_rank) AS edge_ord FROM cands)",
    "walk": """walk AS (SELECT drawing_id, 0::BIGINT AS edge_ord, []::INT[] AS chars, [{'b': 0, 'l': 0, 's': 0, 'x0': 0::DOUBLE, 'y0': 0::DOUBLE, 'x1': 0::DOUBLE, 'y1': 0::DOUBLE}][1:0] AS keys, NULL::INT AS char_no, NULL::BIGINT AS cand_rank FROM (SELECT DISTINCT drawing_id FROM edges)
      UNION ALL
      SELECT e.drawing_id, e.edge_ord, CASE WHEN free THEN list_append(chars, e.char_no) ELSE chars END, CASE WHEN free THEN list_append(keys, key) ELSE keys END, CASE WHEN free THEN e.char_no END, CASE WHEN free THEN e.cand_rank END
      FROM (SELECT e.*, w.chars, w.keys, {'b': block_id, 'l': line_id, 's': span_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} AS key,
              NOT list_contains(w.chars, e.char_no) AND NOT list_contains(w.keys, {'b': block_id, 'l': line_id, 's': span_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) AS free
            FROM walk w JOIN edges e ON e.drawing_id = w.drawing_id AND e.edge_ord = w.edge_ord + 1) e)""",
    "matched": "matched AS (SELECT e.* FROM edges e JOIN walk w ON w.drawing_id = e.drawing_id AND w.char_no = e.char_no AND w.cand_rank = e.cand_rank)",
    "rows0": f"""rows0 AS (SELECT a.drawing_id, a.char_no, a.anchor_ord, a.requirement, {tokens("a.requirement", "a_")}, m.char_no IS NOT NULL AS matched, m.location_score, m.context_score, m.span_ord, m.text, m.block_id, m.line_id, m.span_id, m.x0, m.y0, m.x1, m.y1, m.s_counts, m.s_symbols, m.s_numbers
      FROM anchors a LEFT JOIN matched m ON m.drawing_id = a.drawing_id AND m.char_no = a.char_no)""",
    "rows1": f"""rows1 AS (SELECT *, CASE WHEN matched THEN {overlap("a_numbers", "s_numbers")} END AS ov, len(a_counts) > 0 AND len(s_counts) > 0 AND list_sort(a_counts) <> list_sort(s_counts) AS count_changed,
      len(a_counts) > 0 AND len(s_counts) = 0 AS count_missing, list_has_all(s_symbols, a_symbols) AS symbols_kept FROM rows0)""",
    "rows2": "rows2 AS (SELECT *, CASE WHEN NOT matched THEN 'C1' WHEN count_changed THEN 'C2' WHEN ov >= 0.5 AND symbols_kept THEN 'C3' WHEN ov < 0.5 AND symbols_kept AND NOT count_missing THEN 'C4' WHEN location_score > 0.6 THEN 'C5' ELSE 'C6' END AS branch FROM rows1)",
    "classes": f"""classes AS (SELECT *, CASE branch WHEN 'C1' THEN 'removed' WHEN 'C2' THEN 'changed' WHEN 'C4' THEN 'changed' WHEN 'C3' THEN 'unchanged' WHEN 'C5' THEN 'unchanged' ELSE 'uncertain' END AS status,
      greatest(0.0{D}, least(1.0{D}, CASE branch WHEN 'C1' THEN 0.9{D} WHEN 'C2' THEN 0.5{D} * location_score + 0.3{D} * ov + 0.2{D} WHEN 'C3' THEN 0.4{D} * location_score + 0.4{D} * ov + 0.2{D}
        WHEN 'C4' THEN 0.4{D} * location_score + 0.3{D} * ov + 0.2{D} WHEN 'C5' THEN 0.6{D} * location_score + 0.2{D} * ov ELSE 0.5{D} * location_score + 0.3{D} * ov END)) AS confidence FROM rows2)""",
    "free_spans": "free_spans AS (SELECT s.* FROM places s WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.drawing_id = s.drawing_id AND m.block_id = s.block_id AND m.line_id = s.line_id AND m.span_id = s.span_id AND m.x0 = s.x0 AND m.y0 = s.y0 AND m.x1 = s.x1 AND m.y1 = s.y1))",
    "new_spans": f"new_spans AS (SELECT * FROM free_spans WHERE length(trim(text)) >= 3 AND len(s_numbers) > 0 AND (len(s_symbols) > 0 OR len(s_counts) > 0) AND NOT regexp_matches({norm('text')}, 'ADDED|NEW|REVISED|DELETED'))",
    "added": f"""added AS (SELECT n.*, (coalesce(last_no, 0) + row_number() OVER (PARTITION BY n.drawing_id ORDER BY span_ord))::INT AS char_no,
      least(0.6{D} + CASE WHEN len(s_symbols) > 0 THEN 0.15{D} ELSE 0.0{D} END + CASE WHEN len(s_counts) > 0 THEN 0.15{D} ELSE 0.0{D} END + CASE WHEN s_kind IN ('hole', 'dimension', 'fillet') THEN 0.1{D} ELSE 0.0{D} END, 0.95{D}) AS confidence
      FROM new_spans n LEFT JOIN (SELECT drawing_id, max(char_no) AS last_no FROM anchors GROUP BY drawing_id) USING (drawing_id))""",
    "all_items": """all_items AS (SELECT drawing_id, 0 AS is_added, anchor_ord AS item_ord, char_no, status, confidence, span_ord, x0, y0, x1, y1 FROM classes
      UNION ALL SELECT drawing_id, 1, span_ord, char_no, 'added', confidence, span_ord, x0, y0, x1, y1 FROM added)""",
}


def query(final: str) -> str:
    """``final`` behind all the common table expressions that lead to it."""
    needed: set[str] = set()

    def need(text: str) -> None:
        import re

        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(CTES[name])

    need(final)
    return "WITH RECURSIVE " + ",\n".join(CTES[n] for n in CTES if n in needed) + "\n" + final
