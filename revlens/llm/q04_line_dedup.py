"""Query op4: repeated three-line windows of documents, later occurrences removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import line_dedup


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
places AS (SELECT rid, doc_id, i, lines[i] AS a, lines[i + 1] AS b, lines[i + 2] AS c FROM (SELECT *, unnest(range(1, len(lines) - 1)) AS i FROM docs)),
windows AS (SELECT * FROM places WHERE trim(a) <> '' OR trim(b) <> '' OR trim(c) <> ''),
firsts AS (SELECT a, b, c, min((doc_id, i)) AS first_place FROM windows GROUP BY a, b, c HAVING count(*) > 1),
covered AS (SELECT DISTINCT rid, i + k AS i FROM windows JOIN firsts USING (a, b, c), range(3) AS t(k) WHERE (doc_id, i) <> first_place),
lines AS (SELECT rid, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
kept AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM lines ANTI JOIN covered USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines), 0) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""
