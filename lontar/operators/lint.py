"""Checks of a parse: gaps, orphans, empty articles, leaked anchors, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions import fixed, text


def gaps(values: DataFrame, *keys: str) -> DataFrame:
    """(keys, missing) from rows (keys, v): the whole numbers that lie between the smallest and largest v and do not
    occur, in order and joined by commas; keys without any are left out."""
    distinct = values.where("v is not null").select(*keys, "v").distinct()
    after = distinct.withColumn("w", F.lead("v").over(Window.partitionBy(*keys).orderBy("v"))).where("w - v > 1")
    each = after.select(*keys, F.explode(F.sequence(F.col("v") + 1, F.col("w") - 1)).alias("x"))
    return each.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("x")).cast("array<string>"), ", ").alias("missing"))


def amended(nodes: DataFrame) -> DataFrame:
    """(doc_id) of documents whose title or decision says they amend another."""
    return nodes.where(F.col("section").isin("judul", "penetapan") & F.col("content").rlike(fixed.AMENDMENT)).select("doc_id").distinct()


def article_gaps(nodes: DataFrame) -> DataFrame:
    """(doc_id, missing) over the article numbers of bodies; amending documents are left out."""
    numbers = nodes.where("section = 'batang_tubuh' and node_type = 'pasal'").select("doc_id", text.number_prefix(F.col("pasal")).alias("v"))
    return gaps(numbers.join(amended(nodes), "doc_id", "left_anti"), "doc_id")


def verse_gaps(nodes: DataFrame) -> DataFrame:
    """(doc_id, pasal, missing) over the verse numbers of each article."""
    numbers = nodes.where("section = 'batang_tubuh' and node_type = 'ayat' and pasal is not null").select("doc_id", "pasal", text.number_prefix(F.col("ayat")).alias("v"))
    return gaps(numbers, "doc_id", "pasal")


def unknown_articles(nodes: DataFrame) -> DataFrame:
    """(doc_id, pasal) that explanations name and the body, which has articles, does not."""
    articles = nodes.where("node_type = 'pasal' and pasal is not null")
    body = articles.where("section = 'batang_tubuh'").select("doc_id", "pasal")
    told = articles.where("section = 'penjelasan_pasal'").select("doc_id", "pasal").distinct()
    return told.join(body.select("doc_id").distinct(), "doc_id", "left_semi").join(body.distinct(), ["doc_id", "pasal"], "left_anti")


def empty_articles(nodes: DataFrame) -> DataFrame:
    """(doc_id, pasal) of articles with neither text nor verses."""
    body = nodes.where("section = 'batang_tubuh' and node_type in ('pasal', 'ayat') and pasal is not null")
    article, order = F.col("node_type") == "pasal", F.col("node_idx")
    seen = body.groupBy("doc_id", "pasal").agg(
        F.max(article & (text.strip(F.col("content")) != "")).alias("has_text"), F.min(F.when(article, order)).alias("first"), F.max(F.when(~article, order)).alias("last_verse")
    )
    return seen.where("first is not null and not has_text and coalesce(last_verse < first, true)").select("doc_id", "pasal")


def leaks(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_idx, section, node_type, found) of nodes whose first section anchor is not at their start."""
    at = F.regexp_instr("content", F.lit(fixed.ANCHOR_LEAK))
    return nodes.where(at > 1).select("doc_id", "node_idx", "section", "node_type", F.regexp_extract("content", fixed.ANCHOR_LEAK, 0).alias("found"))


def statistics(nodes: DataFrame) -> DataFrame:
    """Counts of a document's nodes."""
    body = F.col("section") == "batang_tubuh"
    kind = lambda k: F.col("node_type") == k
    return nodes.groupBy("doc_id").agg(
        F.count("*").alias("total_nodes"), F.count_distinct("section").alias("sections_found"), F.count_if(kind("bab")).alias("bab"), F.count_if(kind("bagian")).alias("bagian"),
        F.count_if(kind("paragraf")).alias("paragraf"), F.count_if(kind("pasal") & body).alias("pasal"), F.count_if(kind("diktum") & body).alias("diktum"), F.count_if(kind("ayat") & body).alias("ayat"),
        F.count_if(kind("item")).alias("item_preamble"), F.count_if(F.col("section") == "narasi").alias("narasi"), F.count_if(F.col("orphan").isNotNull()).alias("node_warnings"),
    )


def issues(nodes: DataFrame, section_warnings: DataFrame) -> DataFrame:
    """(doc_id, code, message), one row for each issue; all need review."""
    said = lambda df, code, message: df.select("doc_id", F.lit(code).alias("code"), message.alias("message"))
    stats = statistics(nodes)
    parts = [
        said(section_warnings, "DOC_WARNING", F.col("message")),
        said(stats.where("node_warnings > 0"), "NODE_WARNINGS", F.format_string("%d node memiliki warning (mis. teks tak terstruktur/orphan)", "node_warnings")),
        said(stats.where("pasal = 0 and diktum = 0 and narasi = 0"), "NO_PASAL", F.lit("Tidak ada satupun Pasal maupun Diktum terdeteksi di batang tubuh")),
        said(article_gaps(nodes), "PASAL_GAP", F.concat(F.lit("Pasal tidak berurutan, kemungkinan hilang: "), "missing")),
        said(verse_gaps(nodes), "AYAT_GAP", F.concat(F.lit("Pasal "), "pasal", F.lit(": Ayat tidak berurutan, kemungkinan hilang: "), "missing")),
        said(unknown_articles(nodes), "PENJELASAN_ORPHAN", F.concat(F.lit("Penjelasan menyebut Pasal "), "pasal", F.lit(" yang tidak ada di batang tubuh"))),
        said(empty_articles(nodes), "EMPTY_PASAL", F.concat(F.lit("Pasal "), "pasal", F.lit(" tidak memiliki teks, ayat, maupun huruf (kemungkinan gagal parse)"))),
        said(leaks(nodes), "ANCHOR_LEAK", F.concat(F.lit("Node ["), "section", F.lit("/"), "node_type", F.lit('] memuat penanda section ("'), "found", F.lit('") di tengah teksnya'))),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def verdicts(nodes: DataFrame, section_warnings: DataFrame) -> DataFrame:
    """(doc_id, status, n_issues): FAIL without any article, dictum or narrative, else WARNING with issues."""
    counted = issues(nodes, section_warnings).groupBy("doc_id").agg(F.count("*").alias("n_issues"))
    joined = statistics(nodes).join(counted, "doc_id", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0).cast("long")))
    status = F.when(F.expr("pasal = 0 and diktum = 0 and narasi = 0"), "FAIL").when(F.col("n_issues") > 0, "WARNING").otherwise("SUCCESS")
    return joined.select("doc_id", status.alias("status"), "n_issues")
