"""The packet of a drawing: one nested JSON document, and the run it belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SNIPPETS = "snippets"


def numbered(items: DataFrame) -> DataFrame:
    """Items in packet order: anchors as in the form, then the added ones."""
    order = W.partitionBy("drawing_id").orderBy("is_added", "item_ord")
    return items.withColumn("item_no", F.row_number().over(order))


def snippet_name(char_no: Column, revision: str, page: Column) -> Column:
    return F.format_string(f"char_%03d_{revision}_p%d.png", char_no, page)


def run_id(part: Column, when: Column, *paths: Column) -> Column:
    """Part, time and a digest of the input paths."""
    return F.concat_ws("_", part, F.date_format(when, "yyyy-MM-dd'T'HH-mm-ss"), F.substring(F.sha2(F.concat(*paths), 256), 1, 8))


def output_items(rows: DataFrame) -> DataFrame:
    """Items (with evidence regions ea*, eb* and page) as the packet has them."""

    def side(prefix: str, revision: str, page: Column) -> Column:
        box = F.array(*[F.col(f"{prefix}{i}") for i in range(4)])
        image = F.concat(F.lit(f"{SNIPPETS}/"), snippet_name(F.col("char_no"), revision, page))
        return F.when(F.col(f"{prefix}0").isNotNull(), F.struct(page.alias("page"), box.alias("bbox"), image.alias("image_path")))

    item = F.struct("char_no", "status", "confidence", "reasons", "scores", side("ea", "revA", F.col("page")).alias("revA"), side("eb", "revB", F.lit(0)).alias("revB"))
    return rows.select("drawing_id", "is_added", "item_ord", item.alias("item"))


def packets(rows: DataFrame, run: Column, inputs: Column) -> DataFrame:
    """One row per drawing: drawing_id and the packet as JSON."""
    place = lambda i: F.struct(i["is_added"], i["item_ord"])
    order = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    ordered = F.array_sort(F.collect_list(F.struct("is_added", "item_ord", "item")), order)
    docs = output_items(rows).groupBy("drawing_id").agg(F.transform(ordered, lambda i: i["item"]).alias("items"))
    return docs.select("drawing_id", F.to_json(F.struct(run.alias("run_id"), inputs.alias("inputs"), "items")).alias("packet"))


def write_packets(docs: DataFrame, path: str) -> None:
    """One JSON line per drawing, in a folder that must not exist yet."""
    docs.select("packet").write.mode("errorifexists").text(path)


ITEM_SCHEMA = "run_id string, inputs map<string,string>, items array<struct<char_no:int,status:string,confidence:double,reasons:array<string>,scores:map<string,double>,revA:struct<page:int,bbox:array<double>,image_path:string>,revB:struct<page:int,bbox:array<double>,image_path:string>>>"


def registered(chain, table, query):
    rows = lambda s, d: chain(s, d).regions()

    def packed(s, d):
        inputs = F.create_map(F.lit("revA"), F.lit("a.pdf"), F.lit("revB"), F.lit("b.pdf"))
        return packets(rows(s, d), F.concat(F.lit("run_"), F.col("drawing_id")), inputs)

    def regions() -> list[Column]:
        sides = [F.col(f"i.rev{r.upper()}.{f}").alias(f"{r}_{f}") for r in "ab" for f in ("page", "image_path")]
        return sides + [F.round(F.col(f"i.rev{r.upper()}.bbox")[k], 6).alias(f"e{r}{k}") for r in "ab" for k in range(4)]

    def read_back(s, d):
        p = packed(s, d).select("drawing_id", F.from_json("packet", ITEM_SCHEMA).alias("p"))
        p = p.select("drawing_id", "p.run_id", F.posexplode("p.items").alias("item_no", "i"))
        return p.select("drawing_id", "run_id", "item_no", "i.char_no", "i.status", F.round("i.confidence", 6).alias("confidence"), F.array_join("i.reasons", "; ").alias("reasons"), *regions())

    def projected(s, d):
        items = output_items(rows(s, d)).select("drawing_id", "is_added", F.col("item").alias("i"))
        return items.select("drawing_id", "is_added", "i.char_no", "i.status", *regions())

    name = lambda r, page: f"CASE WHEN e{r}0 IS NOT NULL THEN format('snippets/char_{{:03d}}_rev{r.upper()}_p{{}}.png', i.char_no, {page}) END AS {r}_image_path"
    sql_sides = f"CASE WHEN ea0 IS NOT NULL THEN a.page END AS a_page, {name('a', 'a.page')}, CASE WHEN eb0 IS NOT NULL THEN 0 END AS b_page, {name('b', 0)}, " + ", ".join(f"e{r}{k}" for r in "ab" for k in range(4))
    sql_rows = "all_items i JOIN regions e ON e.drawing_id = i.drawing_id AND e.is_added = i.is_added AND e.char_no = i.char_no LEFT JOIN anchors a ON a.drawing_id = i.drawing_id AND a.char_no = i.char_no"
    sql_why = "LEFT JOIN class_reasons c ON i.is_added = 0 AND c.drawing_id = i.drawing_id AND c.char_no = i.char_no LEFT JOIN added_reasons n ON i.is_added = 1 AND n.drawing_id = i.drawing_id AND n.char_no = i.char_no"
    return {
        "P12_output_projection": (projected, query(f"SELECT i.drawing_id, i.is_added, i.char_no, status, {sql_sides} FROM {sql_rows}")),
        "K1_packet_sink": (read_back, query(f"SELECT i.drawing_id, concat('run_', i.drawing_id) AS run_id, (row_number() OVER (PARTITION BY i.drawing_id ORDER BY i.is_added, i.item_ord) - 1)::INT AS item_no, i.char_no, status, round(confidence, 6) AS confidence, coalesce(c.reasons, n.reasons) AS reasons, {sql_sides} FROM {sql_rows} {sql_why}")),
        "K2_snippet_names": (lambda s, d: table(s, d, "form3").select("drawing_id", snippet_name(F.col("char_no"), "revA", F.col("char_no") % 3).alias("name")), query("SELECT drawing_id, format('char_{:03d}_revA_p{}.png', char_no, char_no % 3) AS name FROM form3")),
        "K4_run_dir": (lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", run_id(F.lit("part1"), F.col("o_orderdate").cast("timestamp"), F.lit("/a/"), F.col("o_orderkey").cast("string")).alias("run_id")), "SELECT o_orderkey, concat('part1_', strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H-%M-%S'), '_', substring(sha256(concat('/a/', o_orderkey)), 1, 8)) AS run_id FROM orders"),
        "K5_progress_log": (lambda s, d: (lambda c: c.t("form3").agg(F.count("*").alias("n")).select(F.lit("form3").alias("stage"), "n").unionByName(c.balloons().agg(F.count("*").alias("n")).select(F.lit("balloons").alias("stage"), "n")).unionByName(c.anchors().agg(F.count("*").alias("n")).select(F.lit("anchors").alias("stage"), "n")))(chain(s, d)), query("SELECT 'form3' AS stage, count(*) AS n FROM form3 UNION ALL SELECT 'balloons', count(*) FROM balloons UNION ALL SELECT 'anchors', count(*) FROM anchors")),
    }
