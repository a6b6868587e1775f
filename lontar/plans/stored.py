"""Queries of stored pages, changes of state, parse results, engines and their answers over the plain tables, with SQL
written by hand from what the operators are to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import text
from lontar.operators import engines, images, records, store, tree

NOW = "timestamp'2024-05-06 07:08:09'"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _now():
    return F.expr(NOW)


def _pages(spark, sf_dir) -> DataFrame:
    """Turns of conversations as stored pages."""
    turns = _read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number")).agg(F.max("text").alias("ocr_text"))
    d, p = F.col("document_id"), F.col("page_number")
    return turns.select(
        d, p, "ocr_text", F.when((d + p) % 5 == 0, F.concat(F.lit("disunting "), p)).alias("edited_text"), ((d + p) % 7 == 0).alias("is_empty"), (p % 4 == 0).alias("is_truncated"), F.when(p % 2 == 0, p / 100.0).alias("ink_ratio"),
        F.when(p % 3 == 0, d % 50 + 0.5).alias("cropped_pct"), F.when((d + p) % 3 > 0, (100 + d % 3 * 50).cast("int")).alias("dpi_pakai"), F.when(p % 5 > 0, (p * 10).cast("int")).alias("duration_ms"), F.array(F.concat(F.lit("n"), p)).alias("notes"),
    )


def _documents(spark, sf_dir) -> DataFrame:
    """Orders as documents; some know their pages, source of text and kind."""
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "ocr_done").when(k % 4 == 1, "parsed").when(k % 4 == 2, "processing").otherwise("downloaded")
    return _read(spark, sf_dir, "orders").select(
        k.alias("id"), status.alias("status"), (k % 4).cast("int").alias("attempts"), F.substring("o_orderpriority", 1, 1).cast("int").alias("first_source_id"), F.when(k % 11 > 0, F.year("o_orderdate")).alias("sort_tahun"),
        F.when(k % 13 > 0, (k % 500).cast("int")).alias("sort_nomor"), F.when(k % 5 > 0, (k % 30).cast("int")).alias("total_pages"), F.when(k % 3 == 0, "pdftotext").alias("text_source"), F.when(k % 6 < 4, F.col("o_orderdate")).alias("classified_at"),
        F.when(k % 7 > 0, "QANUN").alias("jenis"), F.when(k % 9 == 0, "diktum").otherwise("pasal_ayat").alias("struktur"), F.col("o_orderdate").alias("ocr_completed_at"), F.lit(None).cast("string").alias("last_error"), F.lit(True).alias("is_peraturan"),
        F.lit(None).cast("string").alias("reject_reason"), F.lit(None).cast("string").alias("parse_status"), F.when(k % 4 == 1, F.col("o_orderdate")).alias("parsed_at"),
    )


def _sources(spark) -> DataFrame:
    return spark.range(1, 5).select(F.col("id").cast("int").alias("source_id"), (F.lit(500) - F.col("id") * 100).cast("int").alias("priority"))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by document into as many parts as shuffles have: few bytes are not put together into a few large tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _nodes(spark, sf_dir) -> DataFrame:
    """Line numbers of an order as the nodes of a document, as a binary tree."""
    n = _dealt(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") - 1).cast("long").alias("node_idx")), "document_id").distinct()
    i = F.col("node_idx")
    return n.select("document_id", "node_idx", F.when(i > 0, F.floor((i - 1) / 2)).otherwise(-1).cast("long").alias("parent_idx"), F.when(i % 3 == 0, "pasal").when(i % 3 == 1, "diktum").otherwise("ayat").alias("node_type"), F.concat(F.lit("isi "), i).alias("content"))


def _flags(spark, sf_dir) -> DataFrame:
    """One flag for each line number of an order."""
    n = _nodes(spark, sf_dir)
    number = F.col("document_id") * 10 + F.col("node_idx")
    return n.select(number.alias("id"), "document_id", F.shiftleft("document_id", store.NODE_BITS).alias("node_id"), (F.col("node_idx") == 0).alias("resolved"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("string").alias("resolved_note"))


def p04_effective_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("document_id", "page_number", store.effective_text().alias("text"))


def s14_saved_pages(spark, sf_dir):
    return store.saved_pages(_pages(spark, sf_dir)).withColumn("notes", F.array_join("notes", ","))


def s15_page_range(spark, sf_dir):
    return store.page_range(_pages(spark, sf_dir), 2, 4).select("document_id", F.array_join("texts", "\f").alias("texts"))


def s16_lookups(spark, sf_dir):
    return store.lookups(_documents(spark, sf_dir), _pages(spark, sf_dir))


def p05_first_page(spark, sf_dir):
    return store.first_filled_page(_pages(spark, sf_dir))


def _wanted(spark, sf_dir) -> DataFrame:
    documents = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id")).distinct()
    return documents.select("document_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page_number"))


def j07_has_page(spark, sf_dir):
    return store.has_page(_wanted(spark, sf_dir), _pages(spark, sf_dir))


def st6_missing_pages(spark, sf_dir):
    return store.missing_pages(_wanted(spark, sf_dir), _pages(spark, sf_dir))


def a06_page_counts(spark, sf_dir):
    return store.page_counts(_documents(spark, sf_dir), _pages(spark, sf_dir))


def o03_parse_claims(spark, sf_dir):
    """The next fifty to parse, with their place, their pages and the one of four workers that has them."""
    return store.claim_for_parse(_documents(spark, sf_dir), _sources(spark), _pages(spark, sf_dir), 50, 4)


def o02_claim_places(spark, sf_dir):
    """The place of every waiting document among those of its state and priority."""
    documents = _documents(spark, sf_dir).where("status in ('processing', 'downloaded')")
    joined = documents.join(_sources(spark), documents.first_source_id == F.col("source_id"), "left").withColumn("priority", F.coalesce("priority", F.lit(records.NO_PRIORITY)))
    return records.claim_places(joined, "processing", "ocr_completed_at", "asc").select("id", "status", "priority", "place")


def k07_requeue_some(spark, sf_dir):
    return store.requeue(_documents(spark, sf_dir), F.col("id") % 10 == 3, "downloaded").select("id", "status", "attempts")


def k09_reject(spark, sf_dir):
    return store.reject(_documents(spark, sf_dir), F.col("id") % 10 == 6, F.concat(F.lit("surat "), "id"), _now()).select("id", "status", "is_peraturan", "reject_reason", "last_error", "classified_at")


def k10_complete(spark, sf_dir):
    done = store.complete(_documents(spark, sf_dir), F.col("status") == "processing", (F.col("id") % 40).cast("int"), _now())
    elected = done.where("id % 2 = 0").select("id", F.lit("mupdf").alias("text_source"))
    return store.set_text_source(done, elected).select("id", "status", "total_pages", "ocr_completed_at", "text_source")


def p15_interrupted(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in ("canceled", "deadline_exceeded", "load_error", "bad_pdf")])
    return store.interrupted(_documents(spark, sf_dir).withColumn("error", F.get(kinds, (F.col("id") % 5).cast("int")))).select("id", "error", "status", "attempts")


def k11_insert_parse(spark, sf_dir):
    """Documents whose recognition is done get a parse; those parsed before are there already."""
    documents = _documents(spark, sf_dir)
    results = documents.where("status = 'ocr_done'").select(F.col("id").alias("document_id"), F.when(F.col("id") % 8 == 0, "FAIL").otherwise("SUCCESS").alias("status"), F.lit("{}").alias("report"))
    old = documents.where("status = 'parsed'").select(F.col("id").alias("document_id"), F.lit("SUCCESS").alias("status"), F.lit("{}").alias("report"), "parsed_at")
    nodes = _nodes(spark, sf_dir).join(results.select("document_id"), "document_id", "left_semi")
    flags = nodes.where("node_idx < 2").select("document_id", (F.col("node_idx") - 1).alias("node_idx"), F.lit("diagnose").alias("source"), F.lit("X").alias("code"), F.lit("info").alias("severity"), "content").withColumnRenamed("content", "message")
    out = store.insert_parse(documents, old, results, nodes, flags, _now())
    by = lambda name, *agg: out[name].groupBy(F.col("document_id").alias("id")).agg(*agg)
    joined = out["documents"].select("id", "status", "parse_status", "parsed_at").join(by("nodes", F.count("*").alias("nodes"), F.sum("parent_id").alias("parents")), "id", "left")
    joined = joined.join(by("review_flags", F.count("*").alias("flags"), F.sum("node_id").alias("flagged")), "id", "left")
    return joined.join(by("parse_snapshots", F.count("*").alias("snapshots")), "id", "left")


def k12_insert_relations(spark, sf_dir):
    """Parts as citations found by documents, after those of small parts were there."""
    found = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.lit("disebut").alias("type"), text.citation_key(F.col("p_type"), F.col("p_size").cast("string"), F.lit("2001")).alias("key"))
    return store.insert_relations(found.where("document_id % 10 = 0"), found.where("document_id % 10 > 4").select("key", "type", "document_id"))


def k13_resolve_flags(spark, sf_dir):
    flags = _flags(spark, sf_dir)
    notes = flags.where("id % 3 = 0").select("id", F.concat(F.lit("selesai "), "id").alias("note"))
    return store.resolve_flags(flags, notes, _now()).select("id", "resolved", "resolved_at", "resolved_note")


def k17_reset(spark, sf_dir):
    tables = {"documents": _documents(spark, sf_dir), "document_pages": _pages(spark, sf_dir), "nodes": _nodes(spark, sf_dir), "review_flags": _flags(spark, sf_dir), "sources": _sources(spark)}
    return store.audit(store.reset(tables))


def _taken_back(spark, sf_dir, hit) -> DataFrame:
    documents = _dealt(_documents(spark, sf_dir).select("id", "status", "parsed_at", "struktur"), "id")
    snapshots = documents.where("status = 'parsed'").select(F.col("id").alias("document_id"), F.when(F.col("id") % 3 == 0, "FAIL").otherwise("SUCCESS").alias("status"))
    # nodes are counted before they meet the documents: one row a document is sorted and joined
    counted = _nodes(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("nodes"))
    again, kept, left = store.reparse(documents, hit(documents, snapshots), snapshots, counted)
    counts = left.select(F.col("document_id").alias("id"), "nodes")
    return again.select("id", "status", "parsed_at").join(counts, "id", "left").join(kept.select(F.col("document_id").alias("id"), F.lit(True).alias("snapshot")), "id", "left")


def k18_by_structure(spark, sf_dir):
    return _taken_back(spark, sf_dir, lambda documents, _: store.by_structure(documents))


def k18_by_verdict(spark, sf_dir):
    return _taken_back(spark, sf_dir, lambda _, snapshots: store.by_verdict(snapshots))


def k18_by_ids(spark, sf_dir):
    return _taken_back(spark, sf_dir, lambda documents, _: documents.where("id % 20 = 5").select("id"))


def t04_cascades(spark, sf_dir):
    """Every fourth document goes with its nodes and flags; of the others every root node goes and flags let go of it."""
    gone = _documents(spark, sf_dir).where("id % 4 = 3")
    left = store.delete_documents(gone, {"nodes": store.node_ids(_nodes(spark, sf_dir)), "review_flags": _flags(spark, sf_dir)})
    nodes, flags = store.delete_nodes(left["nodes"].where("node_idx = 0 and document_id % 3 = 0"), left["nodes"], left["review_flags"])
    counted = nodes.groupBy("document_id").agg(F.count("*").alias("nodes"))
    told = flags.groupBy("document_id").agg(F.count("*").alias("flags"), F.count("node_id").alias("held"))
    return told.join(counted, "document_id", "left")


def t05_edits(spark, sf_dir):
    nodes = store.node_ids(_nodes(spark, sf_dir)).select("id", "node_type", "content", F.when(F.col("node_idx") == 1, "bab").alias("original_node_type"), (F.col("node_idx") == 1).alias("is_edited"))
    edits = nodes.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "bab").alias("node_type"), F.concat("content", F.lit(" baru")).alias("content"))
    return store.edit_nodes(nodes, edits)


def w02_sparse_order(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "node_idx", F.nullif("parent_idx", F.lit(-1)).alias("parent_idx"), F.lit("batang_tubuh").alias("section"), "node_type")
    return tree.sparse_order(nodes).select("doc_id", "node_idx", "order_index")


def u02_closure(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "node_idx", F.nullif("parent_idx", F.lit(-1)).alias("parent_idx"))
    return tree.closure(nodes).select("doc_id", "node_idx", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def a14_registered(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([^?#]*)", 1).alias("download_url"), (F.col("page_id") % 5).alias("source_id"))
    return store.registered(pages.where("page_id % 3 = 0").select("download_url").distinct(), pages, "download_url", "page_id", "source_id")


def s05_sources(spark, sf_dir):
    """Suppliers' nations as sources, by code."""
    from lontar.sources import listing

    sources = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("code"), F.concat(F.lit("https://"), F.lower("n_name")).alias("endpoint_url"), F.lit("integrasi").alias("source_type"), F.lit("{}").alias("source_config"))
    return listing.sources(sources).select("place", "id", "code", "source_type")


def s07_fetch(spark, sf_dir):
    """Pages of which some link to a file that is a PDF, or not, or is not there."""
    pages = _read(spark, sf_dir, "pages")
    k = F.col("page_id")
    link = F.concat(F.lit('<a href="/f'), k, F.lit('.pdf">'))
    body = F.when(k % 6 == 0, "%PDF-1.4 x").when(k % 6 == 1, F.lit("hanya teks")).when(k % 6 == 2, "<html>tanpa tautan</html>").otherwise(F.concat(F.lit("<html>"), link, F.lit("</html>")))
    responses = pages.select(F.when(k % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("https://a.id/p/"), k)).alias("url"), F.lit("application/octet-stream").alias("content_type"), body.alias("body"))
    followed = pages.where(k % 6 > 3).select(F.concat(F.lit("https://a.id/f"), k, F.lit(".pdf")).alias("url"), F.lit("").alias("content_type"), F.when(k % 6 == 4, "%PDF-1.7").otherwise("<html>").alias("body"))
    return engines.fetched(responses, followed).where("trim(url) <> ''").unionByName(engines.fetched(responses, followed).where("trim(url) = ''").distinct())


def _fails_on_threes(value: str, page: int) -> str:
    if page % 3 == 0:
        raise ValueError("unreadable")
    return "baca " + value


def s12_readable_pages(spark, sf_dir):
    """An engine that fails on every third page."""
    return engines.read_texts(_pages(spark, sf_dir).select("document_id", "page_number", "ocr_text"), "ocr_text", _fails_on_threes, "page_number").select("document_id", "page_number", "text")


def _empty_at_first(image: bytes, max_tokens: int, attempt: int) -> tuple[str, bool]:
    said = image.decode()
    return ("" if len(said) % 4 == 0 and attempt == 1 or len(said) % 8 == 0 else said[:max_tokens], len(said) > max_tokens)


def i05_recognise(spark, sf_dir):
    """Parts' names as page images; some are blank, some give nothing at first, some never."""
    k = F.col("p_partkey")
    pages = _read(spark, sf_dir, "part").select(k.alias("document_id"), F.lit(1).alias("page_number"), F.encode("p_name", "UTF-8").alias("image"), (k % 10 / 10000.0).alias("ink_ratio"), F.lit(30).alias("width"), (k % 40).cast("int").alias("height"), F.when(k % 2 == 0, 1200).alias("full_area"))
    return engines.recognise(pages, _empty_at_first, 12).select("document_id", "ocr_text", "is_empty", "is_truncated", "cropped_pct", F.size("notes").alias("n_notes"))


def w17_resolution(spark, sf_dir):
    """Events of a user as pages, their values as sharpness."""
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("page_number"), (F.col("value") * 1e7).alias("blur_score"))
    return images.page_resolution(events).select("document_id", "page_number", "dpi")


def m07_page_source(spark, sf_dir):
    d = _documents(spark, sf_dir)
    k = F.col("id")
    layer, other = F.when(k % 5 == 0, " isi ").when(k % 5 == 1, " x "), F.when(k % 7 == 0, "teks")
    return d.select("id", engines.page_source(layer, other, F.when(k % 3 == 0, "lampiran").otherwise("penjelasan"), k % 10 / 10000.0, k % 2 == 0).alias("page_source"))


def m07_layer_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("document_id", "page_number", F.when(F.col("page_number") % 3 > 0, F.col("ocr_text")).when(F.col("page_number") % 2 > 0, " \n").alias("text"))
    return engines.layer_pages(pages, "mupdf").withColumn("notes", F.array_join("notes", ","))


def _said(*pairs: tuple[str, object]):
    """A model's answer around a JSON object."""
    body = F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in pairs]))
    return F.when(F.col("id") % 6 == 5, "maaf").otherwise(F.concat(F.lit("Jawaban:\n```json\n"), body, F.lit("\n```")))


def m01_gate(spark, sf_dir):
    raw = _said(("produk_hukum", F.col("id") % 2 == 0), ("alasan", F.concat(F.lit("  karena \n"), F.col("id"), F.lit(" "), F.repeat(F.lit("x"), (F.col("id") % 400).cast("int")))))
    return _documents(spark, sf_dir).select("id", engines.gate_answer(raw).alias("a")).select("id", "a.*")


def m02_identity(spark, sf_dir):
    k = F.col("id")
    raw = _said(("jenis", "QANUN"), ("instansi_tertulis", F.when(k % 4 == 0, "Bupati  Pidie").when(k % 4 == 1, "...").otherwise("KOTA SABANG,")), ("nomor", F.concat(k, F.lit("/2019"))), ("tahun", F.when(k % 3 == 0, "2019").when(k % 3 == 1, "1999 M").otherwise("1750")), ("tentang", F.when(k % 2 == 0, "<judul>").otherwise(" Hal\n Lain ")))
    return _documents(spark, sf_dir).select("id", engines.identity_answer(raw).alias("a")).select("id", "a.*")


def m03_signing(spark, sf_dir):
    """The block a model read fills up the one read by rule."""
    k = F.col("id")
    raw = _said(("ditetapkan_di", "Banda  Aceh"), ("ditetapkan_tanggal", F.concat(k % 28 + 1, F.lit(" Mei 2019"))), ("ditetapkan_oleh", "..."), ("diundangkan_di", "Sabang"))
    certain = F.struct(*[(F.when(k % 2 == 0, "Jantho").otherwise("") if f == "ditetapkan_di" else F.lit("")).alias(f) for f in engines.SIGNING])
    told = _documents(spark, sf_dir).select("id", engines.merged_signing(certain, engines.signing_answer(raw)).alias("a"))
    return told.select("id", "a.*")


def m04_review(spark, sf_dir):
    """Recorded answers of reviews, for two documents of three."""
    documents = _documents(spark, sf_dir)
    answers = documents.where("id % 3 > 0").select("id", _said(("bermasalah", F.col("id") % 2 == 0), ("penjelasan", F.concat(F.lit("baris "), F.col("id")))).alias("raw"))
    return engines.recorded(documents.select("id"), answers, "id").select("id", engines.review_answer(F.col("raw")).alias("a")).select("id", "a.*")


def f26_cut(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", text.cut(F.concat(F.lit(" "), "p_name", F.lit(" \n\t"), "p_type"), 20).alias("cut"))


def f28_year(spark, sf_dir):
    return _documents(spark, sf_dir).select("id", text.year_or_empty((F.lit(1700) + F.col("id") % 500).cast("string")).alias("year"))


def f33_clean_pages(spark, sf_dir):
    """Line numbers of an order as lines that say themselves several times over."""
    lines = _nodes(spark, sf_dir).groupBy("document_id").agg(F.sort_array(F.collect_list("node_idx")).alias("n"))
    said = F.array_join(F.flatten(F.transform("n", lambda i: F.array_repeat(F.concat(F.lit("baris "), i), (i + 1).cast("int")))), "\n")
    return lines.select("document_id", text.let(said, engines.cleaned).alias("c")).select("document_id", "c.*")


def f47_prefer(spark, sf_dir):
    k = F.col("id")
    return _documents(spark, sf_dir).select("id", text.prefer(F.when(k % 3 == 0, "").when(k % 3 == 1, "aturan"), F.when(k % 2 == 0, "model")).alias("value"))


def f50_notes(spark, sf_dir):
    ms = F.col("id") * 997
    return _documents(spark, sf_dir).select("id", text.crop_note((F.col("id") % 100).cast("double")).alias("crop"), text.duration(ms).alias("took"))


QUERIES = {
    f.__name__: f
    for f in (
        p04_effective_text, s14_saved_pages, s15_page_range, s16_lookups, p05_first_page, j07_has_page, st6_missing_pages, a06_page_counts, o03_parse_claims, o02_claim_places, k07_requeue_some, k09_reject, k10_complete, p15_interrupted,
        k11_insert_parse, k12_insert_relations, k13_resolve_flags, k17_reset, k18_by_structure, k18_by_verdict, k18_by_ids, t04_cascades, t05_edits, w02_sparse_order, u02_closure, a14_registered, s05_sources, s07_fetch, s12_readable_pages,
        i05_recognise, w17_resolution, m07_page_source, m07_layer_pages, m01_gate, m02_identity, m03_signing, m04_review, f26_cut, f28_year, f33_clean_pages, f47_prefer, f50_notes,
    )
}

_P = """WITH pages_ AS (SELECT document_id, page_number, ocr_text, CASE WHEN (document_id + page_number) % 5 = 0 THEN 'disunting ' || page_number END AS edited_text, (document_id + page_number) % 7 = 0 AS is_empty, page_number % 4 = 0 AS is_truncated
  FROM (SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page_number, max(text) AS ocr_text FROM conversations GROUP BY 1, 2))"""
_D = f"""documents_ AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'ocr_done' WHEN 1 THEN 'parsed' WHEN 2 THEN 'processing' ELSE 'downloaded' END AS status, CAST(o_orderkey % 4 AS INT) AS attempts,
  CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3', '4') THEN 500 - CAST(left(o_orderpriority, 1) AS INT) * 100 ELSE 1000 END AS priority, CASE WHEN o_orderkey % 11 > 0 THEN year(o_orderdate) END AS y, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 500 END AS n,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 30 AS INT) END AS total_pages, CASE WHEN o_orderkey % 3 = 0 THEN 'pdftotext' END AS text_source, o_orderdate, o_orderkey % 6 < 4 AS classified,
  CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate END AS parsed_at FROM orders)"""
_N = "nodes_ AS (SELECT DISTINCT l_orderkey AS document_id, CAST(l_linenumber - 1 AS BIGINT) AS i FROM lineitem)"
_T = f"CAST({NOW.replace('timestamp', '')} AS TIMESTAMP)"
_TEXT = "coalesce(edited_text, ocr_text)"


def _back(hit: str) -> str:
    return f"""WITH {_D}, {_N}, h AS (SELECT *, {hit} AS hit FROM documents_) SELECT id, CASE WHEN hit THEN 'ocr_done' ELSE status END AS status, CASE WHEN NOT hit THEN parsed_at END AS parsed_at,
      CASE WHEN NOT hit THEN (SELECT nullif(count(*), 0) FROM nodes_ WHERE document_id = id) END AS nodes, CASE WHEN NOT hit AND status = 'parsed' THEN true END AS snapshot FROM h"""


ORACLE_SQL = {
    "p04_effective_text": f"{_P} SELECT document_id, page_number, {_TEXT} AS text FROM pages_",
    "s14_saved_pages": f"""{_P} SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS INT) AS "at", {_TEXT} AS text, is_empty, is_truncated, CASE WHEN page_number % 2 = 0 THEN page_number / 100.0 ELSE 0.0 END::DOUBLE AS ink_ratio,
      CASE WHEN page_number % 3 = 0 THEN document_id % 50 + 0.5 ELSE 0 END::DOUBLE AS cropped_pct, CAST(CASE WHEN (document_id + page_number) % 3 > 0 THEN 100 + document_id % 3 * 50 ELSE 0 END AS INT) AS dpi_pakai,
      CAST(CASE WHEN page_number % 5 > 0 THEN page_number * 10 ELSE 0 END AS INT) AS duration_ms, 'n' || page_number AS notes FROM pages_""",
    "s15_page_range": f"{_P} SELECT document_id, string_agg({_TEXT}, chr(12) ORDER BY page_number) AS texts FROM pages_ WHERE page_number IN (2, 3, 4) GROUP BY document_id",
    "s16_lookups": f"""{_P}, {_D} SELECT d.id, coalesce(d.total_pages, 0) AS total_pages, d.total_pages IS NOT NULL AS known_pages, CASE WHEN d.id % 3 = 0 THEN 'pdftotext' ELSE '' END AS text_source, d.classified,
      CAST(CASE WHEN p.document_id IS NOT NULL AND (d.id + 1) % 3 > 0 THEN 100 + d.id % 3 * 50 ELSE 0 END AS INT) AS dpi_page1, {_TEXT} AS page1_text FROM documents_ d LEFT JOIN pages_ p ON p.document_id = d.id AND p.page_number = 1""",
    "p05_first_page": f"{_P} SELECT document_id, page_number, text FROM (SELECT document_id, page_number, {_TEXT} AS text, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS r FROM pages_ WHERE NOT is_empty AND {_TEXT} <> '') WHERE r = 1",
    "j07_has_page": f"{_P}, w AS (SELECT DISTINCT conv_id AS document_id, CAST(n AS INT) AS page_number FROM conversations, (SELECT unnest(range(1, 5)) AS n)) SELECT w.*, EXISTS (SELECT 1 FROM pages_ p WHERE p.document_id = w.document_id AND p.page_number = w.page_number) AS has FROM w",
    "st6_missing_pages": f"{_P}, w AS (SELECT DISTINCT conv_id AS document_id, CAST(n AS INT) AS page_number FROM conversations, (SELECT unnest(range(1, 5)) AS n)) SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM pages_ p WHERE p.document_id = w.document_id AND p.page_number = w.page_number)",
    "a06_page_counts": f"{_P} SELECT o_orderkey AS id, (SELECT count(*) FROM pages_ WHERE document_id = o_orderkey) AS pages FROM orders",
    "o03_parse_claims": f"""{_P}, {_D} SELECT id, CASE WHEN id % 7 > 0 THEN 'QANUN' ELSE '' END AS jenis, (SELECT count(*) FROM pages_ WHERE document_id = id) AS num_pages, CAST(r AS INT) AS nth, CAST((r - 1) % 4 AS INT) AS worker
      FROM (SELECT *, row_number() OVER (ORDER BY priority, y DESC NULLS LAST, n DESC NULLS LAST, o_orderdate, id) AS r FROM documents_ WHERE status = 'ocr_done') WHERE r <= 50""",
    "o02_claim_places": f"WITH {_D} SELECT id, status, CAST(priority AS INT) AS priority, CAST(row_number() OVER (PARTITION BY status, priority ORDER BY total_pages NULLS LAST, y DESC NULLS LAST, n DESC NULLS LAST, o_orderdate, id) AS INT) AS place FROM documents_ WHERE status IN ('processing', 'downloaded')",
    "k07_requeue_some": f"WITH {_D} SELECT id, CASE WHEN id % 10 = 3 THEN 'downloaded' ELSE status END AS status, attempts FROM documents_",
    "k09_reject": f"WITH {_D} SELECT id, CASE WHEN r THEN 'rejected' ELSE status END AS status, NOT r AS is_peraturan, CASE WHEN r THEN 'bukan_peraturan' END AS reject_reason, CASE WHEN r THEN 'surat ' || id END AS last_error, CASE WHEN r THEN {_T} WHEN classified THEN o_orderdate END AS classified_at FROM (SELECT *, id % 10 = 6 AS r FROM documents_)",
    "k10_complete": f"WITH {_D} SELECT id, CASE WHEN id % 4 = 2 THEN 'ocr_done' ELSE status END AS status, CASE WHEN id % 4 = 2 THEN CAST(id % 40 AS INT) ELSE total_pages END AS total_pages, CASE WHEN id % 4 = 2 THEN {_T} ELSE o_orderdate END AS ocr_completed_at, CASE WHEN id % 2 = 0 THEN 'mupdf' ELSE text_source END AS text_source FROM documents_",
    "p15_interrupted": f"""WITH {_D} SELECT id, CASE id % 5 WHEN 0 THEN 'canceled' WHEN 1 THEN 'deadline_exceeded' WHEN 2 THEN 'load_error' WHEN 3 THEN 'bad_pdf' END AS error,
      CASE WHEN id % 5 < 3 THEN 'downloaded' WHEN id % 5 = 3 AND attempts >= 2 THEN 'failed' WHEN id % 5 = 3 THEN 'downloaded' ELSE status END AS status, CAST(attempts + CASE WHEN id % 5 = 3 THEN 1 ELSE 0 END AS INT) AS attempts FROM documents_""",
    "k11_insert_parse": f"""WITH {_D}, {_N} SELECT id, CASE WHEN id % 4 = 0 THEN 'parsed' ELSE status END AS status, CASE WHEN id % 8 = 0 THEN 'FAIL' WHEN id % 4 = 0 THEN 'SUCCESS' END AS parse_status, CASE WHEN id % 4 = 0 THEN {_T} ELSE parsed_at END AS parsed_at, k.nodes, k.parents, nullif(k.flags, 0) AS flags,
      CASE WHEN k.flags = 2 THEN id * 1048576 END AS flagged, CASE WHEN id % 4 < 2 THEN 1 END AS snapshots FROM documents_ LEFT JOIN (SELECT document_id, count(*) AS nodes, CAST(sum(CASE WHEN i > 0 THEN document_id * 1048576 + (i - 1) // 2 END) AS BIGINT) AS parents,
      count(*) FILTER (i < 2) AS flags FROM nodes_ WHERE document_id % 4 = 0 GROUP BY 1) k ON k.document_id = id""",
    "k12_insert_relations": "SELECT p_partkey AS document_id, 'disebut' AS type, replace(replace(lower(p_type), ' ', '_'), '-', '_') || '|' || p_size || '|2001' AS key FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 10 > 4",
    "k13_resolve_flags": f"WITH {_N}, f AS (SELECT document_id * 10 + i AS id, i = 0 AS resolved FROM nodes_) SELECT id, resolved OR id % 3 = 0 AS resolved, CASE WHEN id % 3 = 0 THEN {_T} END AS resolved_at, CASE WHEN id % 3 = 0 THEN 'selesai ' || id END AS resolved_note FROM f",
    "k17_reset": "SELECT name, CASE name WHEN 'sources' THEN 4 ELSE 0 END AS rows FROM (SELECT unnest(['documents', 'document_pages', 'nodes', 'review_flags', 'sources']) AS name)",
    "k18_by_structure": _back("id % 9 = 0 AND status = 'parsed'"),
    "k18_by_verdict": _back("status = 'parsed' AND id % 3 = 0"),
    "k18_by_ids": _back("id % 20 = 5"),
    "t04_cascades": f"WITH {_N} SELECT document_id, count(*) AS flags, CASE WHEN document_id % 3 > 0 OR count(*) FILTER (i = 0) = 0 THEN count(*) ELSE 0 END AS held, nullif(count(*) - CASE WHEN document_id % 3 = 0 THEN count(*) FILTER (i = 0) ELSE 0 END, 0) AS nodes FROM nodes_ WHERE document_id % 4 <> 3 GROUP BY document_id",
    "t05_edits": f"""WITH {_N}, t AS (SELECT document_id * 1048576 + i AS id, i, CASE i % 3 WHEN 0 THEN 'pasal' WHEN 1 THEN 'diktum' ELSE 'ayat' END AS k FROM nodes_)
      SELECT id, CASE WHEN id % 4 = 0 THEN 'bab' ELSE k END AS node_type, 'isi ' || i || CASE WHEN id % 2 = 0 THEN ' baru' ELSE '' END AS content, CASE WHEN i = 1 THEN 'bab' ELSE k END AS original_node_type, i = 1 OR id % 2 = 0 AS is_edited FROM t""",
    "w02_sparse_order": f"WITH {_N} SELECT document_id AS doc_id, i AS node_idx, 1000 * row_number() OVER (PARTITION BY document_id, CASE WHEN i > 0 THEN (i - 1) // 2 END, i % 3 = 2 ORDER BY i) AS order_index FROM nodes_",
    "u02_closure": f"""WITH RECURSIVE {_N}, t AS (SELECT document_id AS doc_id, i AS node_idx, 0 AS depth, CAST(i AS VARCHAR) AS path FROM nodes_ WHERE i = 0
      UNION ALL SELECT n.document_id, n.i, t.depth + 1, t.path || '/' || n.i FROM nodes_ n JOIN t ON n.document_id = t.doc_id AND n.i > 0 AND (n.i - 1) // 2 = t.node_idx) SELECT * FROM t""",
    "a14_registered": """WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS u FROM pages), k AS (SELECT min(page_id) AS page_id FROM p WHERE u NOT IN (SELECT u FROM p WHERE page_id % 3 = 0) GROUP BY u)
      SELECT p.page_id % 5 AS source_id, count(k.page_id) AS registered, count(*) - count(k.page_id) AS skipped FROM p LEFT JOIN k USING (page_id) GROUP BY 1""",
    "s05_sources": "SELECT CAST(row_number() OVER (ORDER BY lower(n_name)) AS INT) AS place, n_nationkey AS id, lower(n_name) AS code, 'integrasi' AS source_type FROM nation",
    "s07_fetch": """WITH p AS (SELECT page_id AS k, CASE WHEN page_id % 7 = 0 THEN ' ' ELSE 'https://a.id/p/' || page_id END AS url FROM pages), q AS (SELECT k, url, k % 6 AS m, url = ' ' AS none FROM p)
      SELECT url, CASE m WHEN 0 THEN 'pdf' WHEN 1 THEN 'not_pdf' WHEN 2 THEN 'no_link' WHEN 4 THEN 'via_link' ELSE 'link_not_pdf' END AS outcome, CASE WHEN m > 2 THEN 'https://a.id/f' || k || '.pdf' ELSE '' END AS link FROM q WHERE NOT none
      UNION ALL SELECT DISTINCT ' ', 'no_url', CASE WHEN m > 2 THEN '/f' || k || '.pdf' ELSE '' END FROM q WHERE none""",
    "s12_readable_pages": f"{_P} SELECT document_id, page_number, CASE WHEN page_number % 3 = 0 THEN '' ELSE 'baca ' || ocr_text END AS text FROM pages_",
    "i05_recognise": """SELECT p_partkey AS document_id, CASE WHEN b OR n % 8 = 0 THEN '' ELSE left(p_name, 12) END AS ocr_text, b AS is_empty, NOT b AND n > 12 AS is_truncated, CASE WHEN p_partkey % 2 = 0 THEN 100 - 30 * (p_partkey % 40) * 100 / 1200 ELSE 0.0 END::DOUBLE AS cropped_pct,
      CAST(CASE WHEN b THEN 1 WHEN n % 4 > 0 THEN (n > 12)::INT ELSE 2 * (n > 12)::INT + (n % 8 = 0)::INT END AS INT) AS n_notes FROM (SELECT *, p_partkey % 10 < 4 AS b, length(p_name) AS n FROM part)""",
    "w17_resolution": "SELECT user_id AS document_id, event_id AS page_number, CASE WHEN v >= 50 THEN 100 WHEN v >= 5 THEN 150 ELSE 200 END AS dpi FROM (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events)",
    "m07_page_source": f"WITH {_D} SELECT id, CASE WHEN id % 5 = 0 THEN 'pdftotext' WHEN id % 7 = 0 THEN 'mupdf' WHEN id % 10 < 4 THEN 'blank' WHEN id % 3 = 0 OR id % 2 = 1 THEN 'vision' ELSE 'tesseract' END AS page_source FROM documents_",
    "m07_layer_pages": f"""{_P} SELECT document_id, page_number, t AS ocr_text, trim(t, ' ' || chr(10)) = '' AS is_empty, CASE WHEN trim(t, ' ' || chr(10)) = '' THEN 'halaman kosong pada lapisan teks PDF' ELSE 'diambil dari lapisan teks PDF (mupdf) — tidak di-OCR; lihat documents.text_source' END AS notes
      FROM (SELECT *, CASE WHEN page_number % 3 > 0 THEN ocr_text WHEN page_number % 2 > 0 THEN ' ' || chr(10) ELSE '' END AS t FROM pages_)""",
    "m01_gate": f"WITH {_D} SELECT id, CASE WHEN id % 6 < 5 THEN id % 2 = 0 END AS ok, CASE WHEN id % 6 < 5 THEN left(trim('karena ' || id || ' ' || repeat('x', id % 400)), 300) END AS reason FROM documents_",
    "m02_identity": f"""WITH {_D} SELECT id, CASE WHEN a THEN 'QANUN' END AS jenis, CASE WHEN a THEN CASE id % 4 WHEN 0 THEN 'Bupati Pidie' WHEN 1 THEN '' ELSE 'KOTA SABANG,' END END AS instansi_tertulis, CASE WHEN a THEN CASE id % 4 WHEN 0 THEN 'KABUPATEN PIDIE' WHEN 1 THEN '' ELSE 'KOTA SABANG' END END AS wilayah,
      CASE WHEN a THEN id || '/2019' END AS nomor, CASE WHEN a THEN CAST(id AS INT) END AS nomor_urut, CASE WHEN a THEN CASE id % 3 WHEN 0 THEN '2019' WHEN 1 THEN '1999' ELSE '' END END AS tahun, CASE WHEN a THEN CASE WHEN id % 2 = 0 THEN '' ELSE 'Hal Lain' END END AS tentang FROM (SELECT *, id % 6 < 5 AS a FROM documents_)""",
    "m03_signing": f"""WITH {_D} SELECT id, CASE WHEN id % 2 = 0 THEN 'Jantho' WHEN a THEN 'Banda Aceh' ELSE '' END AS ditetapkan_di, CASE WHEN a THEN (id % 28 + 1) || ' Mei 2019' ELSE '' END AS ditetapkan_tanggal, '' AS ditetapkan_oleh, '' AS ditetapkan_oleh_nama,
      CASE WHEN a THEN 'Sabang' ELSE '' END AS diundangkan_di, '' AS diundangkan_tanggal, '' AS diundangkan_oleh, '' AS diundangkan_oleh_nama FROM (SELECT *, id % 6 < 5 AS a FROM documents_)""",
    "m04_review": f"WITH {_D} SELECT id, CASE WHEN a THEN id % 2 = 0 END AS problem, CASE WHEN a THEN 'baris ' || id END AS explanation FROM (SELECT *, id % 6 < 5 AND id % 3 > 0 AS a FROM documents_)",
    "f26_cut": r"SELECT p_partkey, left(trim(regexp_replace(p_name || ' ' || p_type, '\s+', ' ', 'g')), 20) AS cut FROM part",
    "f28_year": f"WITH {_D} SELECT id, CASE WHEN 1700 + id % 500 BETWEEN 1800 AND 2099 THEN CAST(1700 + id % 500 AS VARCHAR) ELSE '' END AS year FROM documents_",
    "f33_clean_pages": f"WITH {_N} SELECT document_id, string_agg(rtrim(repeat('baris ' || i || chr(10), least(i + 1, 3)), chr(10)), chr(10) ORDER BY i) AS text, CAST(sum(greatest(i - 2, 0)) AS INT) AS removed FROM nodes_ GROUP BY 1",
    "f47_prefer": f"WITH {_D} SELECT id, CASE WHEN id % 3 = 1 THEN 'aturan' WHEN id % 2 = 0 THEN 'model' END AS value FROM documents_",
    "f50_notes": f"""WITH {_D} SELECT id, CASE WHEN id % 100 = 0 THEN '' ELSE ' · dipotong -' || id % 100 || '%' END AS crop, CASE WHEN s >= 3600 THEN s // 3600 || 'h' ELSE '' END || CASE WHEN s >= 60 THEN s // 60 % 60 || 'm' ELSE '' END || s % 60 || 's' AS took FROM (SELECT id, (id * 997 + 500) // 1000 AS s FROM documents_)""",
}
