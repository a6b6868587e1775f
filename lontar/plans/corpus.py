"""A legal corpus made from the orders and lineitem tables: one document for each order.

The lines are given once, as SQL over an order (d, y year, s status, g priority digit) or over a line number of an
order (d, p, a, c, f); the DataFrame and the SQL text are both made from that list. Every arm has its place k, s in the
document and its page."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of documents, by the order's key; the others are of the first.
KINDS = ["QANUN ACEH", "PERATURAN BUPATI ACEH BARAT", "KEPUTUSAN WALI KOTA BANDA ACEH", "UNDANG-UNDANG REPUBLIK INDONESIA", "PERATURAN DPRK SABANG", "INSTRUKSI GUBERNUR ACEH", "SURAT EDARAN MENTERI DALAM NEGERI"]
KIND_OF = "case " + " ".join(f"when d % 13 = {k} then '{name}'" for k, name in enumerate(KINDS) if k) + f" else '{KINDS[0]}' end"
#: Documents without any structure, and those that decide in dictums.
NARRATIVE, DECISION = "d % 31 = 0", "d % 29 = 0 and d % 31 <> 0"
#: (k, s, page, text, condition) for each order; conditions of lines of regulations are completed below.
ORDER_LINES = [
    (0, 0, 1, KIND_OF, "true"),
    (0, 1, 1, "'NOMOR ' || cast(d as string) || case when d % 19 = 0 then '/' || cast(y as string) else ' TAHUN ' || cast(y as string) end", "true"),
    (0, 2, 1, "'TENTANG'", "true"),
    (0, 3, 1, "case when g = '2' then 'PERUBAHAN ATAS QANUN CONTOH' else '**CONTOH  PENGELOLAAN**' end", "true"),
    (0, 4, 1, "''", "true"),
    (0, 5, 1, "''", "g = '5'"),
    (0, 6, 1, "'Menimbang : a. bahwa perlu ditetapkan aturan;'", "true"),
    (0, 7, 1, "'b. bahwa hal itu penting;'", "g <> '3'"),
    (0, 8, 1, "'Mengingat :'", "true"),
    (0, 9, 1, "'1. Undang-Undang Nomor ' || cast(d % 40 + 1 as string) || ' Tahun ' || cast(y - 3 as string) || ' tentang Contoh;'", "true"),
    (0, 10, 1, "'Memperhatikan : Peraturan Daerah Nomor 5 Tahun 2001 tentang Uji;'", "g = '3'"),
    (0, 11, 1, "case when g = '4' then 'MEMUTUSKAAN:' else 'MEMUTUSKAN:' end", "true"),
    (0, 12, 1, "'Menetapkan : QANUN TENTANG CONTOH'", "true"),
    (0, 13, 1, "'BAB I KETENTUAN UMUM'", "g in ('1', '5')"),
    (0, 14, 1, "'Bagian Kesatu Umum'", "g = '1'"),
    (0, 15, 1, "'Paragraf 1 Ruang Lingkup'", "g = '1' and d % 3 = 0"),
    (0, 16, 1, "'Bagian Kedua Belas Tugas'", "g = '5'"),
    (0, 17, 1, "'Paragraf 2'", "g = '5' and d % 3 = 0"),
    (96, 0, 5, "'- 5 -'", "true"),
    (97, 0, 5, "'Ketentuan penutup berla'", "true"),
    (98, 0, 6, "'Ketentuan penutup berlaku sejak tanggal diundangkan.'", "true"),
    (98, 1, 6, "'Qanun Nomor 2 Tahun 1999 tentang Lama dicabut dan dinyatakan tidak berlaku.'", "s = 'F'"),
    (99, 0, 6, "'Ditetapkan di Banda Aceh'", "true"),
    (99, 1, 6, "'pada tanggal 7 Januari ' || cast(y as string)", "true"),
    (99, 2, 6, "'GUBERNUR ACEH,'", "true"),
    (99, 3, 6, "''", "true"),
    (99, 4, 6, "'ttd.'", "s = 'O'"),
    (99, 5, 6, "'NAMA PEJABAT'", "true"),
    (100, 0, 7, "'PENJELASAN'", "s = 'F'"),
    (100, 1, 7, "'I. UMUM'", "s = 'F'"),
    (100, 2, 7, "'Uraian umum tentang Qanun Nomor 2 Tahun 1999.'", "s = 'F'"),
    (100, 3, 7, "'II. PASAL DEMI PASAL'", "s = 'F'"),
    (100, 4, 7, "'Pasal 1'", "s = 'F'"),
    (100, 5, 7, "'Cukup jelas.'", "s = 'F'"),
    (100, 6, 7, "'Pasal 9'", "s = 'F'"),
    (100, 7, 7, "'Ayat (1)'", "s = 'F'"),
    (100, 8, 7, "'Cukup jelas.'", "s = 'F'"),
    (101, 0, 8, "'LAMPIRAN QANUN ACEH'", "s = 'O'"),
    (101, 1, 8, "''", "s = 'O'"),
    (101, 2, 8, "'A. Daftar isi'", "s = 'O'"),
    (101, 3, 8, "'isi lampiran'", "s = 'O'"),
]
ORDER_LINES = [(k, s, page, text, f"({w}) and not ({NARRATIVE})") for k, s, page, text, w in ORDER_LINES]
ORDER_LINES += [
    (1, 0, 1, "'SURAT KETERANGAN'", NARRATIVE),
    (1, 1, 1, "''", NARRATIVE),
    (1, 2, 1, "'Dengan ini kami terangkan hal ' || cast(d as string) || '.'", NARRATIVE),
    (1, 3, 1, "'1. rincian satu'", NARRATIVE),
    (1, 4, 1, "'sambungan rincian'", NARRATIVE),
    (1, 5, 1, "''", NARRATIVE),
    (1, 6, 1, "'Demikian agar maklum.'", NARRATIVE),
    (1, 7, 2, "'KESATU : Menetapkan hal pertama.'", DECISION),
    (1, 8, 2, "'a. butir diktum'", DECISION),
    (1, 9, 2, "'KEDUA : Keputusan ini berlaku.'", DECISION),
    (1, 10, 2, "'Pasal 8'", "d % 23 = 0 and d % 29 <> 0 and d % 31 <> 0"),
]
#: (s, text, condition) for each line number p of an order; k is p, three numbers to a page from page 2.
ITEM_LINES = [
    (0, "'- salinan ' || cast(d as string) || ' -'", "p in (1, 4, 7)"),
    (1, "'Pasal ' || cast(p as string)", "true"),
    (2, "'( l ) Bagian ke ' || cast(a as string) || ' berlaku.'", "true"),
    (3, "'(3) Ketentuan lain, MENIMBANG hal itu.'", "f = 'R'"),
    (4, "'a. butir pertama'", "c > 1"),
    (5, "'1. rincian'", "c > 1 and f = 'A'"),
    (6, "'sambungan  kalimat'", "f = 'N'"),
]
#: Only regulations that decide in articles have lines of line numbers; those on page 1 come before.
ITEM_LINES = [(s, text, f"({w}) and not ({NARRATIVE}) and not ({DECISION})") for s, text, w in ITEM_LINES]


def _made(arms: list, row: str = "") -> str:
    """SQL of the array of (k, s, page, text) of the arms (k, s, page, text, condition) that apply. The arms name values by
    single letters: columns, or fields of `row`."""

    def of(sql: str) -> str:
        plain = lambda part: re.sub(r"\b([acfgpsy])\b", rf"{row}.\1", part) if row else part
        return "'".join(part if i % 2 else plain(part) for i, part in enumerate(sql.split("'")))

    each = [f"case when {of(w)} then named_struct('k', cast({of(k)} as long), 's', {s}, 'page', cast({of(page)} as long), 'text', {of(t)}) end" for k, s, page, t, w in arms]
    return f"array_compact(array({', '.join(each)}))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines): a row for each document, lines an array of (k, s, page, text) in order.

    Only the numbers and letters that lines are made of are dealt, not the lines. The number of partitions is given, as
    few bytes are dealt for the work to come."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("d"), F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderstatus").alias("s"), F.substring("o_orderpriority", 1, 1).alias("g"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("d"), F.col("l_linenumber").cast("long").alias("p"), F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("f"))
    heads = orders.repartition(parts, "d").groupBy("d").agg(F.collect_list(F.struct("y", "s", "g")).alias("o"))
    bodies = items.repartition(parts, "d").groupBy("d", "p").agg(F.min("a").alias("a"), F.count("*").alias("c"), F.min("f").alias("f")).groupBy("d").agg(F.collect_list(F.struct("p", "a", "c", "f")).alias("i"))
    order_arms = [(str(k), s, str(page), t, w) for k, s, page, t, w in ORDER_LINES]
    item_arms = [("p", s, "2 + floor((p - 1) / 3)", t, w) for s, t, w in ITEM_LINES]
    each = lambda rows, arms: F.expr(f"flatten(transform({rows}, x -> {_made(arms, 'x')}))")
    made = F.concat(each("o", order_arms), F.coalesce(each("i", item_arms), F.array()))
    return heads.join(bodies, "d", "left").select(F.col("d").alias("doc_id"), F.sort_array(made).alias("lines"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, line_no, text): the lines of a document lie together, in order."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("at", "x")).select("doc_id", "x.page", (F.col("at") + 1).cast("long").alias("line_no"), "x.text")


def page_texts(spark: SparkSession, sf_dir: str, *pages: int) -> DataFrame:
    """(doc_id, page, text) of those pages of each document, or of all."""
    held = documents(spark, sf_dir)
    numbers = F.array_distinct("lines.page")
    wanted = F.filter(numbers, lambda n: n.isin(*pages)) if pages else numbers
    each = held.select("doc_id", "lines", F.explode(wanted).alias("page"))
    return each.select("doc_id", "page", F.array_join(F.transform(F.filter("lines", lambda x: x["page"].eqNullSafe(F.col("page"))), lambda x: x["text"]), "\n").alias("text"))


def sql() -> str:
    """The same rows as SQL with CTEs li, o, raw and corpus."""
    text = lambda t: t.replace("as string", "as varchar")
    arms = [f"SELECT d, CAST({k} AS BIGINT) AS k, {s} AS s, CAST({page} AS BIGINT) AS page, {text(t)} AS t FROM o WHERE {w}" for k, s, page, t, w in ORDER_LINES]
    arms += [f"SELECT d, p, {s}, CAST(2 + floor((p - 1) / 3) AS BIGINT), {text(t)} FROM li WHERE {w}" for s, t, w in ITEM_LINES]
    return f"""
o AS (SELECT o_orderkey AS d, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS g FROM orders),
li AS (SELECT l_orderkey AS d, CAST(l_linenumber AS BIGINT) AS p, min(l_partkey) AS a, count(*) AS c, min(l_returnflag) AS f
       FROM lineitem WHERE l_orderkey IN (SELECT d FROM o) GROUP BY 1, 2),
raw AS ({" UNION ALL ".join(arms)}),
corpus AS (SELECT d AS doc_id, page, CAST(row_number() OVER (PARTITION BY d ORDER BY k, s) AS BIGINT) AS line_no, t AS text FROM raw)"""
