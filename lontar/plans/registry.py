"""Queries of registry, queue and review over the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.operators import records, store


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _queue(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as documents in the queue, their priorities as sources; some numbers, years and sources are unknown."""
    key = F.col("o_orderkey")
    orders = _read(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(F.col("o_orderstatus") == "F", "processing").when(F.col("o_orderstatus") == "O", "downloaded").otherwise("parsed").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("first_source_id"),
        F.when(key % 11 > 0, F.year("o_orderdate")).alias("sort_tahun"), F.when(key % 13 > 0, (key % 500).cast("int")).alias("sort_nomor"), F.when(key % 7 > 0, (key % 30).cast("int")).alias("total_pages"), (key % 4).cast("int").alias("attempts"), F.col("o_orderdate").alias("created_at"),
    )
    sources = spark.range(1, 5).select(F.col("id").cast("int").alias("source_id"), (F.lit(500) - F.col("id") * 100).cast("int").alias("priority"))
    return orders, sources


def o02_claim_order(spark, sf_dir):
    """The whole queue in order of claims."""
    documents, sources = _queue(spark, sf_dir)
    ranked = records.claim(documents, sources, "processing", "downloaded", "created_at", pages="asc")
    return ranked.select("id", "status", "priority", "total_pages", "sort_tahun", "sort_nomor")


def o01_claim_top(spark, sf_dir):
    """The next ten to claim: a top-k."""
    documents, sources = _queue(spark, sf_dir)
    return records.claim(documents, sources, "processing", "downloaded", "created_at", limit=10).select("id", "status", "priority")


def k01_register_once(spark, sf_dir):
    """Addresses of pages registered once: those of even pages are known."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([^?#]*)", 1).alias("download_url"))
    return records.insert_new(pages.where("page_id % 2 = 0").select("download_url").distinct(), pages, "download_url", "page_id").select("page_id", "download_url")


def k02_upsert_page(spark, sf_dir):
    """Turns of conversations as pages, read again with other text from turn 1 on; edited text stays."""
    turns = _read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number")).agg(F.max("text").alias("ocr_text"))
    old = turns.select("document_id", "page_number", "ocr_text", F.when(F.col("page_number") % 2 == 0, F.lit("edited")).alias("edited_text"))
    new = turns.where("page_number >= 1").select("document_id", "page_number", F.upper("ocr_text").alias("ocr_text"), F.lit(None).cast("string").alias("edited_text"), F.lit(1).alias("seq"))
    return records.upsert(old, new.union(new.withColumn("ocr_text", F.lower("ocr_text")).withColumn("seq", F.lit(2))), ["document_id", "page_number"], ["edited_text"], "seq")


def k03_fill(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    new = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.upper("p_name"))
    return parts.select("p_partkey", records.fill(F.col("p_name"), new).alias("p_name"))


def k04_content_duplicates(spark, sf_dir):
    documents = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("pdf_sha256"), F.when(F.col("doc_id") % 17 == 0, "failed").otherwise("downloaded").alias("status"))
    return records.mark_duplicates(documents, "pdf_sha256", "id", "duplikat_isi").select("id", "status", "duplicate_of", "reject_reason")


def k05_identity_duplicates(spark, sf_dir):
    """Parts with one brand, type and size are one regulation; unknown keys are not compared."""
    key = F.when(F.col("p_size") > 1, F.concat_ws("|", "p_brand", "p_type", "p_size"))
    documents = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), key.alias("canonical_key"), F.lit("processing").alias("status"))
    return records.mark_duplicates(documents, "canonical_key", "id", "duplikat_peraturan").select("id", "status", "duplicate_of", "reject_reason")


def k06_attempts(spark, sf_dir):
    documents, _ = _queue(spark, sf_dir)
    return records.failed(documents.withColumn("reject_reason", F.lit(None).cast("string")), "pending", "unduh_gagal").select("id", "status", "attempts", "reject_reason")


def k08_requeue(spark, sf_dir):
    documents, _ = _queue(spark, sf_dir)
    return records.requeue(documents, "processing", "downloaded").groupBy("status").agg(F.count("*").alias("documents"))


def k18_reparse(spark, sf_dir):
    """Orders as documents, their years as verdicts, line items as nodes."""
    documents = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("parsed").alias("status"))
    snapshots = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.year("o_orderdate") == 1995, "FAIL").otherwise("SUCCESS").alias("status"))
    nodes = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    again, kept, left = records.reparse(documents, snapshots, nodes)
    counts = left.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("nodes"))
    parsed = kept.select(F.col("document_id").alias("id"), F.lit(True).alias("has_snapshot"))
    return again.join(counts, "id", "left").join(parsed, "id", "left").select("id", "status", F.coalesce("nodes", F.lit(0).cast("long")).alias("nodes"), F.coalesce("has_snapshot", F.lit(False)).alias("has_snapshot"))


def _flags(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("id"), (F.col("l_returnflag") == "A").alias("resolved"), F.when(F.col("l_linestatus") == "O", "needs_review").otherwise("info").alias("severity"), F.col("l_shipdate").alias("created_at"))


def a01_review_queue(spark, sf_dir):
    return records.review_queue(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), _flags(spark, sf_dir))


def v02_open_flags(spark, sf_dir):
    return records.open_flags(_flags(spark, sf_dir)).select("document_id", "id", "severity", "created_at")


def j01_priority(spark, sf_dir):
    documents, sources = _queue(spark, sf_dir)
    joined = documents.join(sources, documents.first_source_id == sources.source_id, "left")
    return joined.groupBy(F.coalesce("priority", F.lit(records.NO_PRIORITY)).alias("priority")).agg(F.count("*").alias("documents"), F.sum("total_pages").alias("pages"))


def a08_audit(spark, sf_dir):
    """Counts of tables, all with all."""
    return store.audit({table: _read(spark, sf_dir, table) for table in ("customer", "documents", "orders", "pages")})


QUERIES = {f.__name__: f for f in (o02_claim_order, o01_claim_top, k01_register_once, k02_upsert_page, k03_fill, k04_content_duplicates, k05_identity_duplicates, k06_attempts, k08_requeue, k18_reparse, a01_review_queue, v02_open_flags, j01_priority, a08_audit)}
_QUEUE = """documents_ AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'processing' WHEN 'O' THEN 'downloaded' ELSE 'parsed' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INT) AS first_source_id,
 CASE WHEN o_orderkey % 11 > 0 THEN year(o_orderdate) END AS sort_tahun, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderkey % 500 AS INT) END AS sort_nomor, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 30 AS INT) END AS total_pages,
 CAST(o_orderkey % 4 AS INT) AS attempts, o_orderdate AS created_at FROM orders),
sources_ AS (SELECT CAST(x AS INT) AS source_id, CAST(500 - x * 100 AS INT) AS priority FROM (SELECT unnest(range(1, 5)) AS x)),
queue_ AS (SELECT d.*, coalesce(s.priority, 1000) AS priority FROM documents_ d LEFT JOIN sources_ s ON d.first_source_id = s.source_id)"""
_DUP = "SELECT id, CASE WHEN d THEN 'duplicate' ELSE status END AS status, CASE WHEN d THEN w END AS duplicate_of, CASE WHEN d THEN '{1}' END AS reject_reason FROM (SELECT x.*, m.w, coalesce(live AND m.w <> id, false) AS d FROM ({0}) x LEFT JOIN (SELECT k, min(id) AS w FROM ({0}) WHERE live GROUP BY k) m ON x.k = m.k)"
ORACLE_SQL = {
    "o02_claim_order": f"WITH {_QUEUE} SELECT id, status, priority, total_pages, CAST(sort_tahun AS INT) AS sort_tahun, sort_nomor FROM queue_ WHERE status IN ('processing', 'downloaded')",
    "o01_claim_top": f"WITH {_QUEUE} SELECT id, status, priority FROM queue_ WHERE status IN ('processing', 'downloaded') ORDER BY (status = 'processing') DESC, priority, sort_tahun DESC NULLS LAST, sort_nomor DESC NULLS LAST, created_at, id LIMIT 10",
    "k01_register_once": "WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS download_url FROM pages) SELECT min(page_id) AS page_id, download_url FROM p WHERE download_url NOT IN (SELECT download_url FROM p WHERE page_id % 2 = 0) GROUP BY download_url",
    "k02_upsert_page": "SELECT conv_id AS document_id, turn AS page_number, CASE WHEN turn >= 1 THEN lower(upper(max(text))) ELSE max(text) END AS ocr_text, CASE WHEN turn % 2 = 0 THEN 'edited' END AS edited_text FROM conversations GROUP BY conv_id, turn",
    "k03_fill": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS p_name FROM part",
    "k04_content_duplicates": _DUP.format("SELECT doc_id AS id, sha256(text) AS k, CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'downloaded' END AS status, doc_id % 17 <> 0 AS live FROM documents", "duplikat_isi"),
    "k05_identity_duplicates": _DUP.format("SELECT p_partkey AS id, CASE WHEN p_size > 1 THEN p_brand || '|' || p_type || '|' || p_size END AS k, 'processing' AS status, true AS live FROM part", "duplikat_peraturan"),
    "k06_attempts": f"WITH {_QUEUE} SELECT id, CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, CAST(attempts + 1 AS INT) AS attempts, CASE WHEN attempts + 1 >= 3 THEN 'unduh_gagal' END AS reject_reason FROM documents_",
    "k08_requeue": f"WITH {_QUEUE} SELECT CASE WHEN status = 'processing' THEN 'downloaded' ELSE status END AS status, count(*) AS documents FROM documents_ GROUP BY 1",
    "k18_reparse": "SELECT o_orderkey AS id, CASE WHEN year(o_orderdate) = 1995 THEN 'ocr_done' ELSE 'parsed' END AS status, CASE WHEN year(o_orderdate) = 1995 THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS nodes, year(o_orderdate) <> 1995 AS has_snapshot FROM orders",
    "a01_review_queue": "SELECT o_orderkey AS id, count(l_orderkey) FILTER (l_returnflag <> 'A') AS open_flags, count(l_orderkey) FILTER (l_returnflag <> 'A' AND l_linestatus = 'O') AS needs_review, max(l_shipdate) AS last_flag_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "v02_open_flags": "SELECT l_orderkey AS document_id, l_linenumber AS id, CASE WHEN l_linestatus = 'O' THEN 'needs_review' ELSE 'info' END AS severity, l_shipdate AS created_at FROM lineitem WHERE l_returnflag <> 'A'",
    "j01_priority": f"WITH {_QUEUE} SELECT priority, count(*) AS documents, CAST(sum(total_pages) AS BIGINT) AS pages FROM queue_ GROUP BY 1",
    "a08_audit": "SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'pages', count(*) FROM pages",
}
