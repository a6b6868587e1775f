"""Query and SQL of the mixing operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing


def op9_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_id,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
filling AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_over,
         CAST(sum(weight) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight
  FROM ranked),
level AS (
  SELECT left_over, open_weight FROM filling WHERE left_over * weight <= cap * open_weight ORDER BY cap / weight, source_id LIMIT 1),
goals AS (
  SELECT f.source, f.source_size, f.source_id,
         CASE WHEN f.left_over * f.weight <= f.cap * f.open_weight
              THEN CAST(l.left_over * f.weight AS DOUBLE) / l.open_weight ELSE CAST(f.cap AS DOUBLE) END AS target
  FROM filling f, level l),
queued AS (
  SELECT row_number() OVER () AS rid, s.doc_id, s.size, s.h, g.source_size, g.target,
         CAST(sum(s.size) OVER (PARTITION BY g.source_id ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT rid, size, doc_id, h, e, CAST(upto + source_size * e AS DOUBLE) / target AS t
  FROM queued, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND target > 0),
cut AS (
  SELECT rid, sum(size) OVER (ORDER BY t, h, doc_id, e, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM copies),
taken AS (
  SELECT rid, count(*) AS n FROM cut WHERE used <= (SELECT sum(size) FROM sized) GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(t.n, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.rid = t.rid
"""
