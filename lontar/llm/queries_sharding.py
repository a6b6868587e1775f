"""Query and SQL of the sharding operator."""

from pyspark.sql import DataFrame, SparkSession

from . import sharding


#: Shards that a loader reads at once; small, so that tables of a few megabytes are split too.
LIMIT_BYTES = 64 << 10


def op6_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharding.shards(docs.select("doc_id", "text"), LIMIT_BYTES).select("doc_id", "n_bytes", "shard_depth", "shard", "shard_page")


OP6_SQL = f"""
WITH sized AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
same AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n_bytes) - 1 AS nth, sum(n_bytes) OVER (PARTITION BY h) AS all_bytes,
         greatest(1, {LIMIT_BYTES} // greatest(1, max(n_bytes) OVER (PARTITION BY h))) AS fit
  FROM sized),
levels AS (
  SELECT s.*, d.depth, sum(s.n_bytes) OVER (PARTITION BY d.depth, s.h >> (60 - d.depth)) AS bucket_bytes
  FROM same s, (SELECT CAST(unnest(range(0, 61)) AS INT) AS depth) d),
placed AS (
  SELECT doc_id, n_bytes, h, nth, coalesce(min(depth) FILTER (WHERE bucket_bytes <= {LIMIT_BYTES}), 60) AS depth,
         CASE WHEN any_value(all_bytes) > {LIMIT_BYTES} THEN nth // any_value(fit) ELSE 0 END AS page
  FROM levels GROUP BY doc_id, n_bytes, h, nth)
SELECT doc_id, n_bytes, CAST(depth AS INT) AS shard_depth, '' || substr(lpad(bin(h), 60, '0'), 1, depth) AS shard, CAST(page AS INT) AS shard_page
FROM placed
"""
