"""Citations of other regulations in nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions import fixed, text

#: Kinds of regulation in citations, in the order they are tried.
CITED = [
    "Undang-Undang Dasar", "Undang-Undang", "Peraturan Pemerintah Pengganti Undang-Undang", "Peraturan Pemerintah", "Peraturan Presiden",
    "Peraturan Menteri", "Peraturan Lembaga Negara", "Peraturan Daerah", "Peraturan Kepala Daerah", "Peraturan Desa", "Peraturan Gubernur",
    "Peraturan Bupati", "Peraturan Walikota", "Peraturan Wali Kota", "Qanun Aceh", "Qanun", "Keputusan Presiden", "Instruksi Presiden", "Keputusan Menteri",
]
CITATION = "(?i)(" + "|".join(CITED) + r")((?:\s+[^,;.()]{1,50}?)?)\s+Nomor\s+([0-9]+[A-Za-z]?)\s+Tahun\s+([0-9]{4})(?:\s+[Tt]entang\s+([^.;]{3,200}))?"


def citations(nodes: DataFrame) -> DataFrame:
    """(doc_id, doc_order, at, section, type, confidence, key, jenis, instansi, nomor, tahun, tentang, kutipan): every
    citation in every node. The pattern's groups come out of one pass over the whole matches."""
    body = F.trim("content")
    each = nodes.where(body != "").select("doc_id", "doc_order", "section", body.alias("body"), F.posexplode(F.regexp_extract_all(body, F.lit(CITATION), F.lit(0))).alias("at", "m"))
    part = lambda n: text.squeeze(F.regexp_extract("m", CITATION, n))
    title = text.strip(F.regexp_replace(F.regexp_replace(part(5), fixed.TITLE_TAIL, ""), r"[ ,;:.]+$", ""))
    quiet = F.col("section").isin("penjelasan_umum", "penjelasan_pasal")
    kind = F.when(F.col("section") == "mengingat", "dasar_hukum").when(quiet, "disebut").when(F.col("body").rlike(fixed.REVOKES), "mencabut").when(F.col("body").rlike(fixed.AMENDS), "mengubah").otherwise("disebut")
    quote = text.squeeze(F.col("body"))
    d = each.select(
        "doc_id", "doc_order", "at", "section", kind.alias("type"), F.upper(part(1)).alias("jenis"), F.upper(part(2)).alias("instansi"), part(3).alias("nomor"), part(4).alias("tahun"), title.alias("tentang"),
        F.when(F.length(quote) > 400, F.concat(F.left(quote, F.lit(400)), F.lit("..."))).otherwise(quote).alias("kutipan"),
    )
    return d.withColumn("confidence", F.when(F.col("type") == "disebut", "perlu_review").otherwise("tinggi")).withColumn("key", text.citation_key(F.col("jenis"), F.col("nomor"), F.col("tahun")))


def relations(found: DataFrame) -> DataFrame:
    """The first citation of each type and key of a document; mere mentions go where the same key is cited otherwise.
    Both are windows over one dealing by document and key."""
    first = F.row_number().over(Window.partitionBy("doc_id", "key", "type").orderBy("doc_order", "at")) == 1
    strong = F.max(F.col("type") != "disebut").over(Window.partitionBy("doc_id", "key"))
    return found.withColumn("_first", first).withColumn("_strong", strong).where("_first and not (type = 'disebut' and _strong)").drop("_first", "_strong")


def resolve(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """relations with target_document_id: the smallest id of documents (id, key) with the cited key, else null."""
    targets = documents.groupBy("key").agg(F.min("id").alias("target_document_id"))
    return relations.join(targets, "key", "left")
