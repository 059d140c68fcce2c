"""Inspection forms: from a table of cells to a table of characteristics.

Cells: drawing_id, sheet_ord, sheet, row_no, col, value, vtype (n number, s text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER_ROW = 6
# Field, words its header must hold, column where none does.
FIELDS = [
    ("char_no", ["char", "no", "number"], 1),
    ("reference_location", ["reference", "location", "ref"], 2),
    ("characteristic_designator", ["characteristic", "designator"], 3),
    ("requirement", ["requirement", "req"], 4),
]
SHEET_MARKS = ["Form3", "F3"]


def selected_sheets(cells: DataFrame) -> DataFrame:
    """First sheet of each drawing whose name holds a mark."""
    named = cells.where(F.contains("sheet", F.lit(SHEET_MARKS[0])) | F.contains("sheet", F.lit(SHEET_MARKS[1])))
    return named.groupBy("drawing_id").agg(F.min_by("sheet", "sheet_ord").alias("sheet"))


def require_sheets(cells: DataFrame) -> DataFrame:
    """Like :func:`selected_sheets`, but fails on a drawing without such a sheet."""
    every = cells.select("drawing_id").distinct().join(selected_sheets(cells), "drawing_id", "left")
    return every.withColumn("sheet", F.coalesce("sheet", F.raise_error(F.lit("No Form 3 sheet found")).cast("string")))


def header_map(cells: DataFrame) -> DataFrame:
    """Column of each field: the first header, left to right, with all of the field's words, else the fallback."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*[F.lit(w) for w in ws]).alias("words"), F.lit(c).alias("fallback")) for f, ws, c in FIELDS])
    headers = cells.where(F.col("row_no") == HEADER_ROW).select("drawing_id", "col", F.lower(F.trim("value")).alias("header"), F.explode(fields).alias("f"))
    hits = headers.where(F.forall("f.words", lambda w: F.contains(F.col("header"), w))).groupBy("drawing_id", F.col("f.field").alias("field")).agg(F.min("col").alias("col"))
    every = cells.select("drawing_id").distinct().select("drawing_id", F.explode(fields).alias("f")).select("drawing_id", "f.field", "f.fallback")
    return every.join(hits, ["drawing_id", "field"], "left").select("drawing_id", "field", F.coalesce("col", "fallback").alias("col"))


def integer(value: Column, vtype: Column) -> Column:
    """Numbers truncate toward zero; text counts if it is an integer with blanks around; else null."""
    whole = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    number = value.try_cast("double")
    return F.when(vtype == "n", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("int")).when(whole.rlike(r"^[+-]?[0-9]+$"), whole.try_cast("int"))


def data_rows(cells: DataFrame) -> DataFrame:
    """Rows below the header up to the first without a number, their fields as columns."""
    fields = cells.where(F.col("row_no") > HEADER_ROW).join(header_map(cells), ["drawing_id", "col"])
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    rows = fields.groupBy("drawing_id", "row_no").agg(*[pick(f, "value").alias(f) for f, *_ in FIELDS], pick("char_no", "vtype").alias("vtype"))
    last = cells.groupBy("drawing_id").agg(F.max("row_no").alias("last")).where(F.col("last") > HEADER_ROW)
    dense = last.select("drawing_id", F.explode(F.sequence(F.lit(HEADER_ROW + 1), F.col("last"))).alias("row_no"))
    rows = dense.join(rows, ["drawing_id", "row_no"], "left").withColumn("blank", (F.coalesce(F.trim("char_no"), F.lit("")) == "").cast("int"))
    ended = F.sum("blank").over(W.partitionBy("drawing_id").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("ended", ended).where("ended = 0").drop("ended", "blank")


def characteristics(cells: DataFrame) -> DataFrame:
    """Form rows: rows whose number is no integer are skipped; blank texts are empty, not null."""
    chosen = cells.join(selected_sheets(cells), ["drawing_id", "sheet"])
    rows = data_rows(chosen).withColumn("number", integer(F.col("char_no"), F.col("vtype"))).where("number is not null")
    text = [F.coalesce(F.trim(f), F.lit("")).alias(f) for f, *_ in FIELDS[1:]]
    return rows.select("drawing_id", F.col("row_no").alias("row_ord"), F.col("number").alias("char_no"), *text)


def debug_json(rows: DataFrame) -> DataFrame:
    """One JSON array per drawing of its form rows, in row order."""
    item = F.struct("row_ord", F.to_json(F.struct("char_no", *[f for f, *_ in FIELDS[1:]])).alias("j"))
    ordered = rows.groupBy("drawing_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return ordered.select("drawing_id", F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: i["j"]), ","), F.lit("]")).alias("json"))


_HEADS = {1: "Char No Number", 2: "Reference Location Ref", 3: "Characteristic Designator", 4: "Requirement Req"}
_DATA = {1: "CASE WHEN q = 50 THEN '' WHEN k % 11 = 0 THEN '7A' WHEN k % 11 = 1 THEN concat('  ', CAST(ord AS STRING), ' ') WHEN k % 11 = 2 THEN concat(CAST(ord AS STRING), '.0') ELSE CAST(ord AS STRING) END", 2: "concat('LOC ', CAST(q AS STRING))", 3: "concat('KEY', CAST(d AS STRING))", 4: "concat(' R', CAST(size AS STRING), ' ')"}
_COL = "CASE WHEN drawing_id % 3 = 0 AND {c} = 2 THEN 3 WHEN drawing_id % 3 = 0 AND {c} = 3 THEN 2 ELSE {c} END"
#: Cells derived from the orders: two columns swapped on every third drawing, unknown headers on every fifth.
CELLS = (
    "SELECT DISTINCT drawing_id, 0 AS sheet_ord, 'Cover' AS sheet, 1 AS row_no, 1 AS col, 'x' AS value, 's' AS vtype FROM items "
    + " ".join(f"UNION ALL SELECT DISTINCT drawing_id, 1, 'MyForm3Data', 6, {_COL.format(c=c)}, CASE WHEN drawing_id % 5 = 0 THEN 'Column' ELSE '{h}' END, 's' FROM items" for c, h in _HEADS.items())
    + " "
    + " ".join(f"UNION ALL SELECT drawing_id, 1, 'MyForm3Data', 6 + ord, {_COL.format(c=c)}, {v}, {'CASE WHEN k % 11 IN (0, 1) THEN ' + repr('s') + ' ELSE ' + repr('n') + ' END' if c == 1 else repr('s')} FROM items" for c, v in _DATA.items())
)


def registered(chain, table, query):
    from revlens.plans.oracle import CTES

    def cells(s, d):
        c = chain(s, d)
        return c.once("cells", lambda: s.sql(CELLS.replace("FROM items", "FROM {items}"), items=c.t("items")))

    CTES["cells"] = f"cells AS ({CELLS})"
    CTES["chosen"] = "chosen AS (SELECT * FROM cells JOIN (SELECT drawing_id, arg_min(sheet, sheet_ord) AS sheet FROM cells WHERE contains(sheet, 'Form3') OR contains(sheet, 'F3') GROUP BY drawing_id) USING (drawing_id, sheet))"
    CTES["heads"] = "heads AS (SELECT drawing_id, col, lower(trim(value)) AS header FROM chosen WHERE row_no = 6)"
    CTES["mapped"] = "mapped AS (" + " UNION ALL ".join(f"SELECT drawing_id, '{f}' AS field, coalesce(min(CASE WHEN {' AND '.join(f'contains(header, {w!r})' for w in ws)} THEN col END), {c}) AS col FROM heads GROUP BY drawing_id" for f, ws, c in FIELDS) + ")"
    CTES["form_rows"] = "form_rows AS (SELECT *, sum(CASE WHEN trim(coalesce(char_no, '')) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY drawing_id ORDER BY row_no) AS ended FROM (SELECT drawing_id, row_no, " + ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f, *_ in FIELDS) + ", max(vtype) FILTER (field = 'char_no') AS vtype FROM chosen JOIN mapped USING (drawing_id, col) WHERE row_no > 6 GROUP BY drawing_id, row_no))"
    CTES["coerced"] = "coerced AS (SELECT drawing_id, row_no AS row_ord, CASE WHEN vtype = 'n' THEN trunc(try_cast(char_no AS DOUBLE))::INT WHEN regexp_full_match(trim(char_no), '[+-]?[0-9]+') THEN trim(char_no)::INT END AS char_no, trim(reference_location) AS reference_location, trim(characteristic_designator) AS characteristic_designator, trim(requirement) AS requirement FROM form_rows WHERE ended = 0)"
    sheet = lambda s, d: cells(s, d).join(selected_sheets(cells(s, d)), ["drawing_id", "sheet"])
    coerced = lambda s, d: chain(s, d).once("characteristics", lambda: characteristics(cells(s, d)))
    return {
        "S2_sheet_select": (lambda s, d: selected_sheets(cells(s, d)), query("SELECT DISTINCT drawing_id, sheet FROM chosen")),
        "S3_header_map": (lambda s, d: header_map(sheet(s, d)), query("SELECT drawing_id, field, col FROM mapped")),
        "S4_row_scan": (lambda s, d: data_rows(sheet(s, d)).select("drawing_id", "row_no", "char_no"), query("SELECT drawing_id, row_no, char_no FROM form_rows WHERE ended = 0")),
        "S5_cell_coerce": (coerced, query("SELECT * FROM coerced WHERE char_no IS NOT NULL")),
        "S6_debug_json": (lambda s, d: debug_json(coerced(s, d)), query("""SELECT drawing_id, '[' || string_agg(concat('{"char_no":', char_no, ',"reference_location":"', reference_location, '","characteristic_designator":"', characteristic_designator, '","requirement":"', requirement, '"}'), ',' ORDER BY row_ord) || ']' AS json FROM coerced WHERE char_no IS NOT NULL GROUP BY drawing_id""")),
    }
