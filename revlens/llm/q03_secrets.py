"""Query op3: secrets in every whole text of documents; a source is an owner and a document a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import secrets


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return secrets.digests(secrets.scan(docs))


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT rid, {order} AS kind_order, '{kind}' AS kind, value, start_at + gap_sum + len_before AS start_at, start_at + gap_sum + len_before + len AS end_at
  FROM (SELECT rid, i, 0 AS start_at, list_extract(values_, i) AS value, length(list_extract(whole, i)) AS len,
          list_sum([length(g) for g in gaps[1:i]])::BIGINT AS gap_sum,
          coalesce(list_sum([length(w) for w in whole[1:i-1]]), 0)::BIGINT AS len_before
        FROM (SELECT rid, whole, values_, gaps, unnest(range(1, len(whole) + 1)) AS i
              FROM (SELECT rid, regexp_extract_all(body, '{quoted}') AS whole, regexp_extract_all(body, '{quoted}', {group}) AS values_,
                           string_split_regex(body, '{quoted}') AS gaps FROM docs)))
  WHERE length(value) >= {least}"""


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS body FROM documents),
base AS ({" UNION ALL ".join(_spans(k, n, p, g, m) for n, (k, p, g, m) in enumerate(secrets.BASE_KINDS))}),
wide AS (SELECT w.* FROM ({_spans(secrets.RARE[0], 3, *secrets.RARE[1:])}) w
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.start_at < w.end_at AND w.start_at < b.end_at)),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM wide),
owners AS (SELECT value, count(DISTINCT d.owner) AS n_owners, count(DISTINCT (d.owner, d.doc_id)) AS n_repositories FROM everything e JOIN docs d USING (rid) GROUP BY value),
judged AS (SELECT e.*, o.n_owners <= 1 AND o.n_repositories <= {secrets.MAX_REPOSITORIES} AS live, o.n_repositories FROM everything e JOIN owners o USING (value)),
kept AS (SELECT * FROM judged WHERE kind <> 'rare' OR live),
widest AS (SELECT rid, max(n_repositories)::BIGINT AS n_repositories FROM judged GROUP BY rid),
told AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', start_at, ':', end_at), ',' ORDER BY start_at, kind_order) FILTER (kind <> 'rare') AS base_spans,
  string_agg(concat(kind, ':', start_at, ':', end_at), ',' ORDER BY start_at, kind_order) AS spans,
  count(*) FILTER (kind = 'rare') AS n_rare, count(*) FILTER (kind <> 'rare' AND live) AS n_live, count(*) FILTER (kind <> 'rare' AND NOT live) AS n_shared
  FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_rare, 0) AS n_rare, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_repositories, 0) AS n_repositories
FROM docs LEFT JOIN told USING (rid) LEFT JOIN widest USING (rid)
"""
