from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .minhash import near_duplicates
from .spark_io import load


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles, similarity 0.8."""
    return near_duplicates(load(spark, sf_dir, "documents"), size=2, num=80, den=100)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p WHERE 100 * k >= 80 * (nx + ny - k)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (
  SELECT doc_id, doc_id AS c FROM s
  UNION
  SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.doc_id
), least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, component_id = s.doc_id AS kept
FROM s JOIN least USING (doc_id)
"""
