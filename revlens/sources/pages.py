"""Text spans of pages, from page dictionaries in JSON, and page rasters."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = "struct<blocks:array<struct<type:int,lines:array<struct<spans:array<struct<text:string,size:double,bbox:array<double>>>>>>>>"


def text_spans(pages: DataFrame) -> DataFrame:
    """Spans of ``pages`` (drawing_id, rev, page, json) with block, line and span numbers.

    Blocks that are no text are dropped but counted, so numbers stay those of
    the page; blank spans stay. ``span_ord`` is the reading order on the page.
    """
    rows = pages.select("drawing_id", "rev", "page", F.posexplode(F.from_json("json", PAGE)["blocks"]).alias("block_id", "block")).where(F.col("block.type") == 0)
    rows = rows.select("drawing_id", "rev", "page", "block_id", F.posexplode("block.lines").alias("line_id", "line"))
    rows = rows.select("drawing_id", "rev", "page", "block_id", "line_id", F.posexplode("line.spans").alias("span_id", "span"))
    order = W.partitionBy("drawing_id", "rev", "page").orderBy("block_id", "line_id", "span_id")
    box = [F.col("span.bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("drawing_id", "rev", "page", F.row_number().over(order).alias("span_ord"), F.col("span.text").alias("text"), *box, F.col("span.size").alias("font_size"), "block_id", "line_id", "span_id")


def page_json(spans: DataFrame) -> DataFrame:
    """The inverse, for spans numbered without gaps: one page dictionary per drawing, revision and page."""
    span = F.struct("span_id", F.struct("text", F.col("font_size").alias("size"), F.array("x0", "y0", "x1", "y1").alias("bbox")).alias("s"))
    lines = spans.groupBy("drawing_id", "rev", "page", "block_id", "line_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    line = F.struct("line_id", F.struct(F.transform("spans", lambda s: s["s"]).alias("spans")).alias("l"))
    blocks = lines.groupBy("drawing_id", "rev", "page", "block_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    block = F.struct("block_id", F.struct(F.lit(0).alias("type"), F.transform("lines", lambda x: x["l"]).alias("lines")).alias("b"))
    pages = blocks.groupBy("drawing_id", "rev", "page").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    return pages.select("drawing_id", "rev", "page", F.to_json(F.struct(F.transform("blocks", lambda x: x["b"]).alias("blocks"))).alias("json"))


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Binary PPM files (P6) as rows of path, h, w, c and BGR bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind, *size = raw.split(None, 3)[:3]
                w, h = map(int, size)
                body = raw[len(raw) - w * h * 3 :]
                if kind != b"P6":
                    raise ValueError(f"not a binary PPM file: {file}")
                bgr = np.frombuffer(body, dtype=np.uint8).reshape(h, w, 3)[:, :, ::-1].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([3], pa.int32()), pa.array([bgr], pa.binary())], names=["path", "h", "w", "c", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, h int, w int, c int, data binary")


def validate_inputs(rev_a: str, rev_b: str, form3: str, exists) -> None:
    """Each path must exist, by the caller's test, and have its kind's ending."""
    for path, ending in ((rev_a, ".pdf"), (rev_b, ".pdf"), (form3, ".xlsx")):
        if not exists(path):
            raise FileNotFoundError(path)
        if PurePosixPath(path).suffix.lower() != ending:
            raise ValueError(f"{path} does not end in {ending}")
