"""Queries of scalar functions over the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import fixed, identity, text, urls
from lontar.operators import parse

from . import corpus, oracle
from .oracle import quoted, stripped


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def f35_normalize_url(spark, sf_dir):
    dirty = F.concat(F.regexp_replace("url", "^http", "HTTP"), F.when(F.col("url").contains("?"), "&utm_source=a&b=1#top").otherwise("?utm_source=a&b=1#top"))
    return _read(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"), urls.normalize_url(dirty).alias("dirty_url"))


def f36_source_code(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", urls.source_code(F.col("url")).alias("code"), urls.source_code(F.concat(F.lit("https://www.jdih."), F.regexp_extract("url", "^https?://([^/:]*)", 1), F.lit(":8080/x"))).alias("port_code"))


def f37_sanitize(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", urls.sanitize(F.col("text")).alias("name"))


def s08_pdf_link(spark, sf_dir):
    linked = F.regexp_replace("html", 'href="(/[^"]*)"', 'href="$1.pdf?v=1"')
    return _read(spark, sf_dir, "pages").select("page_id", urls.pdf_link(linked, F.col("url")).alias("link"))


def s09_sniff(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", urls.sniff(F.lit("application/octet-stream"), F.col("html")).alias("kind"), urls.sniff(F.lit("application/pdf"), F.concat(F.lit("%PDF-1.7"), "html")).alias("pdf_kind"))


def s06_retry(spark, sf_dir):
    d = _read(spark, sf_dir, "events").select("event_id", (F.lit(200) + F.col("event_id") % 4 * 100 + F.when(F.col("event_id") % 7 == 0, 29).otherwise(0)).alias("status"), (F.col("event_id") % 5).alias("attempt"))
    return d.select("event_id", "status", "attempt", urls.retry(F.col("status"), F.col("attempt")).alias("action"))


def f39_file_name(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", urls.file_name(F.col("text").cast("binary")).alias("name"))


def f17_numbers(spark, sf_dir):
    c = F.concat(F.col("o_orderpriority"), F.lit(" No. "), F.col("o_orderkey").cast("string"), F.lit("/2019"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.first_number(c).alias("nomor_urut"), text.sort_number(F.regexp_replace(c, "^[0-9]-", "0-")).alias("sort_nomor"), text.number_prefix(c).alias("prefix"))


def f14_area(spark, sf_dir):
    names = F.array(*[F.lit(a) for a in fixed.AREAS])
    forms = F.array(*[F.lit(x) for x in ("", "BUPATI ", "Gubernur ", "WALIKOTA ", "DPRK ", "PROVINSI ", "KOTA ")])
    written = F.concat(F.element_at(forms, (F.col("o_orderkey") % 7 + 1).cast("int")), F.regexp_replace(F.element_at(names, (F.col("o_custkey") % 25 + 1).cast("int")), "^(KABUPATEN|KOTA) ", ""), F.lit(" ,"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", identity.area(written).alias("wilayah"))


def f25_citation_key(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", text.citation_key(F.col("p_type"), F.col("p_size").cast("string"), F.lit(" 2001 ")).alias("key"))


def f01_fix_line(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return d.select("doc_id", "at", text.let(text.fix_line(F.col("line")), text.fix_anchor).alias("line"))


def f20_identity(spark, sf_dir):
    return _pages(spark, sf_dir, 1).select("doc_id", identity.identity(F.col("page_text")).alias("i")).select("doc_id", "i.*")


def f21_signing(spark, sf_dir):
    return _pages(spark, sf_dir, 6).select("doc_id", identity.signing(F.col("page_text")).alias("s")).select("doc_id", "s.*")


def _pages(spark, sf_dir, page: int) -> DataFrame:
    """Text of one page of each corpus document."""
    return corpus.page_texts(spark, sf_dir, page).select("doc_id", F.col("text").alias("page_text"))


def m05_decide(spark, sf_dir):
    """Orders as pages: status and priority as what regular expressions, gate, anchors and model say."""
    d = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.substring("o_orderpriority", 1, 1).cast("int").alias("g"))
    k = F.col("o_orderkey")
    return d.select("o_orderkey", identity.decide(F.col("s") == "P", F.when(k % 5 > 0, F.col("s") == "O"), F.col("g") == 1, k % 2 == 0, F.col("g") > 3).alias("decision"))


#: Letters of a page into which whole texts of documents are cut.
PAGE_LETTERS = 1000


def _text_pages(spark, sf_dir) -> DataFrame:
    """All texts of documents, cut into pages, letters beyond ASCII as question marks."""
    # one pass over each text: pages cut out one by one would read it from the start for each
    plain = F.regexp_replace("text", r"[^\x00-\x7f]", "?")
    pages = F.regexp_extract_all(plain, F.lit(rf"(?s).{{1,{PAGE_LETTERS}}}"), F.lit(0))
    d = _read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.posexplode(pages).alias("k", "a"))
    return d.select("doc_id", (F.col("k") + 1).alias("page"), "a")


def f30_compare(spark, sf_dir):
    """Every page of every document against a version of it with other digits, more letters or in reverse."""
    b = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("a", "[0-9]", "7")).when(F.col("doc_id") % 3 == 1, F.regexp_replace("a", "th", "TH ")).otherwise(F.reverse("a"))
    d = _text_pages(spark, sf_dir).withColumn("b", b).select("doc_id", "page", text.compare(F.col("a"), F.col("b")).alias("c"))
    return d.select("doc_id", "page", F.round("c.similarity", 6).alias("similarity"), "c.digits_equal", "c.trusted")


def w09_token_runs(spark, sf_dir):
    """Lines with each third token said seven times over."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    noisy = F.regexp_replace("line", r"^(\S+) (\S+) ", "$1 $2 $2 $2 $2 $2 $2 $2 ")
    return d.select("doc_id", "at", text.clamp_tokens(noisy).alias("line"))


def p01_ranges(spark, sf_dir):
    from lontar.operators.records import in_range, parse_range

    d = _read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 20).alias("pages"))
    years, pages = parse_range("1994-1996"), parse_range("-5")
    return d.where(F.col("y").isNotNull() & in_range(F.col("y"), *years)).where(F.col("pages").isNull() | in_range(F.col("pages"), *pages)).select("o_orderkey", "y", "pages")


def f46_fulltext(spark, sf_dir):
    """How many documents and times each token has."""
    return text.token_counts(_read(spark, sf_dir, "documents"), "doc_id", "text")


def f19_area_of_kind(spark, sf_dir):
    """Every kind, with names of areas after it."""
    kinds, names = (F.array(*[F.lit(x) for x in some]) for some in (fixed.KINDS, ("REPUBLIK INDONESIA", "ACEH", "ACEH BARAT", "BANDA ACEH", "PIDIE ", "", "KOTA SABANG", "LANGSA", "KABUPATEN BIREUEN", "JAWA  TIMUR")))
    k = F.col("o_orderkey")
    d = _read(spark, sf_dir, "orders").select(k, F.element_at(kinds, (k % len(fixed.KINDS) + 1).cast("int")).alias("jenis"), F.element_at(names, (F.floor(k / 32) % 10 + 1).cast("int")).alias("instansi"))
    return d.select("o_orderkey", "jenis", "instansi", identity.area_of_kind(F.col("jenis"), F.col("instansi")).alias("wilayah"))


def p08_anchors(spark, sf_dir):
    """What stands on each page of the corpus, and whether it looks like one of a legal document."""
    return parse.page_marks(corpus.documents(spark, sf_dir))


_URL = stripped("{0}")
_TRACK = ", ".join(quoted(t) for t in fixed.TRACKING)
_P = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _normal(c: str) -> str:
    part = lambda n: f"regexp_extract({c}, {quoted(_P)}, {n})"
    pairs = f"list_filter(string_split({part(4)}, '&'), lambda p: p <> '' AND NOT list_contains([{_TRACK}], string_split(p, '=')[1]))"
    query = f"array_to_string(list_transform(list_sort(list_transform({pairs}, lambda p, i: {{'k': string_split(p, '=')[1], 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}})), lambda x: x.p), '&')"
    return f"CASE WHEN {part(1)} <> '' THEN lower({part(1)}) || ':' ELSE '' END || CASE WHEN {part(2)} <> '' THEN '//' || lower({part(2)}) ELSE '' END || {part(3)} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


def _sane(c: str) -> str:
    edge = quoted(r"^[._-]+|[._-]+$")
    t = f"regexp_replace(regexp_replace(regexp_replace({stripped(c)}, '[^\\p{{L}}\\p{{N}}._-]+', '_', 'g'), '_{{2,}}', '_', 'g'), {edge}, '', 'g')"
    return f"coalesce(nullif(CASE WHEN length({t}) > 120 THEN regexp_replace(substr({t}, 1, 120), {edge}, '', 'g') ELSE {t} END, ''), 'dokumen')"


def _code(c: str) -> str:
    authority = f"regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({authority}, '^([^:]*)', 1)), '^www\\.', ''), '^jdih\\.', '')"
    suffix = "(" + "|".join(s.replace(".", r"\.") for s in fixed.HOST_SUFFIXES) + ")$"
    port = f"regexp_extract({authority}, ':([0-9]+)$', 1)"
    return _sane(f"replace(regexp_replace({host}, {quoted(suffix)}, ''), '.', '_') || CASE WHEN {port} IN ('', '80', '443') THEN '' ELSE '_' || {port} END")


_AREA_FORMS = "['', 'BUPATI ', 'Gubernur ', 'WALIKOTA ', 'DPRK ', 'PROVINSI ', 'KOTA ']"
_AREA_LIST = "[" + ", ".join(quoted(a) for a in fixed.AREAS) + "]"
_TIDY = lambda c: f"regexp_replace(regexp_replace(upper({stripped(c)}), '\\s+', ' ', 'g'), '^[ ,.]+|[ ,.]+$', '', 'g')"
_ACEH = lambda n: f"CASE WHEN contains({n}, 'ACEH') AND NOT starts_with({n}, 'KABUPATEN ') AND NOT starts_with({n}, 'KOTA ') THEN 'PEMERINTAH ACEH' WHEN {n} = '' THEN '' ELSE 'PROVINSI ' || {n} END"
_COMPARE_TEXT = lambda c: f"regexp_replace({c}, '[^\\x00-\\x7f]', '?', 'g')"
_FLAT_TEXT = lambda c: f"lower({stripped(f'''regexp_replace({c}, '{chr(92)}s+', ' ', 'g')''')})"

def _page_sql(page: int) -> str:
    return f"WITH {corpus.sql()}, p AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS page FROM corpus WHERE page = {page} GROUP BY doc_id)"


_HEAD = lambda n: f"regexp_extract(raw, {quoted(identity.DATED)}, {n})"
_SQUEEZED = lambda c: stripped(f"regexp_replace({c}, '\\s+', ' ', 'g')")
_BARE = lambda n: f"regexp_extract(raw, {quoted(identity.UNDATED)}, {n})"
_EITHER = lambda a, b: f"CASE WHEN dated THEN {_HEAD(a)} ELSE {_BARE(b)} END"
_IDENTITY = f"""{_page_sql(1)}, q AS (SELECT doc_id, regexp_replace(page, {quoted("(?s)" + fixed.MENIMBANG + ".*")}, '') AS raw, regexp_matches(page, {quoted(fixed.MENIMBANG)}) AS opened FROM p),
r AS (SELECT doc_id, CASE WHEN opened THEN raw ELSE '' END AS raw, opened AND regexp_matches(raw, {quoted(identity.DATED)}) AS dated FROM q),
h AS (SELECT doc_id, {_SQUEEZED(f"upper({_EITHER(1, 1)})")} AS jenis, {_TIDY(_EITHER(2, 2))} AS area, {stripped(_EITHER(3, 3))} AS nomor,
  CASE WHEN dated THEN {_HEAD(4)} ELSE coalesce(regexp_extract_all({_BARE(3)}, {quoted(identity.YEAR)})[-1], '') END AS tahun,
  {stripped("array_to_string(list_transform(string_split(regexp_replace(" + _EITHER(5, 4) + r", '(?s)\r?\n\s*\r?\n.*', ''), chr(10)), lambda x: " + stripped("x") + "), ' ')")} AS tentang FROM r),
w AS (SELECT *, CASE jenis WHEN 'UNDANG-UNDANG' THEN 'NASIONAL' WHEN 'SURAT EDARAN MENTERI' THEN 'NASIONAL' WHEN 'PERATURAN BUPATI' THEN 'KABUPATEN ACEH BARAT' WHEN 'KEPUTUSAN WALI KOTA' THEN 'KOTA BANDA ACEH'
  WHEN 'PERATURAN DPRK' THEN 'KOTA SABANG' WHEN '' THEN '' ELSE 'PEMERINTAH ACEH' END AS wilayah FROM h)
SELECT doc_id, jenis, wilayah, nomor, coalesce(TRY_CAST(nullif(regexp_extract(nomor, '[0-9]+', 0), '') AS INT), 0) AS nomor_urut, tahun, tentang,
  CASE WHEN jenis <> '' AND wilayah <> '' AND nomor <> '' AND tahun <> '' THEN jenis || '|' || wilayah || '|' || nomor || '|' || tahun END AS canonical_key,
  list_contains([{", ".join(quoted(k) for k in fixed.KINDS)}], jenis) AND list_contains({_AREA_LIST}, wilayah) AND nomor <> '' AND tahun <> '' AND tentang <> '' AS accepted FROM w"""
_PLACE = lambda pattern, n: _SQUEEZED(f"regexp_replace(regexp_extract(page, {quoted(pattern)}, {n}), '^[ \\t\\r\\n,.:]+|[ \\t\\r\\n,.:]+$', '', 'g')")
_SIGNING = f"""{_page_sql(6)}, s AS (SELECT doc_id, page, regexp_extract_all(page, {quoted(identity.SIGNER)}, 1) AS offices,
  list_filter(list_transform(string_split(string_split_regex(page, {quoted(identity.SIGNER)})[2], chr(10))[1:6], lambda x: {stripped("x")}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^ttd\\.?$'))[1] AS line FROM p),
n AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z][A-Z.\'\'\\s]{{2,60}}[A-Z.]$') AND NOT regexp_matches(line, '(?i)^(salinan|tembusan|distribusi)\\b') THEN {_TIDY("line")} ELSE '' END AS name FROM s)
SELECT doc_id, {_PLACE(identity.SIGNED, 1)} AS ditetapkan_di, {_PLACE(identity.SIGNED, 2)} AS ditetapkan_tanggal, coalesce({_TIDY("offices[1]")}, '') AS ditetapkan_oleh, coalesce(name, '') AS ditetapkan_nama,
  '' AS diundangkan_di, '' AS diundangkan_tanggal, '' AS diundangkan_oleh, '' AS diundangkan_nama, regexp_matches(page, '(?i)ditetapkan\\s+di') AS marked,
  {_PLACE(identity.SIGNED, 1)} = '' OR {_PLACE(identity.SIGNED, 2)} = '' OR coalesce(name, '') = '' AS needs_model FROM n"""

_PAGES_SQL = f"""text_pages AS (SELECT doc_id, CAST(k + 1 AS INT) AS page, regexp_replace(substr(text, k * {PAGE_LETTERS} + 1, {PAGE_LETTERS}), '[^\\x00-\\x7f]', '?', 'g') AS a
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // {PAGE_LETTERS} + 1)) AS k FROM documents WHERE text <> ''))"""

QUERIES = {f.__name__: f for f in (f35_normalize_url, f36_source_code, f37_sanitize, s08_pdf_link, s09_sniff, s06_retry, f39_file_name, f17_numbers, f14_area, f25_citation_key, f01_fix_line, f20_identity, f19_area_of_kind, p08_anchors, f21_signing, m05_decide, f30_compare, w09_token_runs, p01_ranges, f46_fulltext)}
_AREA_NAMES = "['REPUBLIK INDONESIA', 'ACEH', 'ACEH BARAT', 'BANDA ACEH', 'PIDIE', '', 'KOTA SABANG', 'LANGSA', 'KABUPATEN BIREUEN', 'JAWA TIMUR']"
_AREA_WRITTEN = _AREA_NAMES.replace("'PIDIE'", "'PIDIE '").replace("'JAWA TIMUR'", "'JAWA  TIMUR'")
ORACLE_SQL = {
    "f19_area_of_kind": f"""WITH d AS (SELECT o_orderkey, [{", ".join(quoted(k) for k in fixed.KINDS)}][o_orderkey % {len(fixed.KINDS)} + 1] AS jenis, {_AREA_WRITTEN}[o_orderkey // 32 % 10 + 1] AS instansi, {_AREA_NAMES}[o_orderkey // 32 % 10 + 1] AS n FROM orders)
      SELECT o_orderkey, jenis, instansi, CASE WHEN jenis IN ('UNDANG-UNDANG', 'PERATURAN PEMERINTAH', 'PERATURAN PEMERINTAH PENGGANTI UNDANG-UNDANG') OR jenis LIKE '%PRESIDEN' OR jenis LIKE '%MENTERI' THEN 'NASIONAL'
        WHEN jenis LIKE '%DPRA' THEN 'PEMERINTAH ACEH' WHEN jenis LIKE '%DPRK' THEN CASE n WHEN 'KOTA SABANG' THEN n WHEN 'KABUPATEN BIREUEN' THEN n WHEN 'ACEH BARAT' THEN 'KABUPATEN ACEH BARAT' WHEN 'PIDIE' THEN 'KABUPATEN PIDIE' WHEN 'BANDA ACEH' THEN 'KOTA BANDA ACEH' WHEN 'LANGSA' THEN 'KOTA LANGSA' ELSE 'KABUPATEN ' || n END
        WHEN jenis LIKE '%BUPATI' THEN 'KABUPATEN ' || n WHEN jenis LIKE '%WALI KOTA' THEN 'KOTA ' || n
        WHEN jenis LIKE '%GUBERNUR' THEN CASE WHEN n IN ('ACEH', 'ACEH BARAT', 'BANDA ACEH') THEN 'PEMERINTAH ACEH' WHEN n = '' THEN '' ELSE 'PROVINSI ' || n END
        WHEN n IN ('KOTA SABANG', 'KABUPATEN BIREUEN', '') THEN n WHEN n IN ('ACEH', 'ACEH BARAT', 'BANDA ACEH') THEN 'PEMERINTAH ACEH' ELSE 'PROVINSI ' || n END AS wilayah FROM d""",
    "p08_anchors": f"""WITH {corpus.sql()}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS t FROM corpus GROUP BY 1, 2), r AS (SELECT *, {" OR ".join(oracle.has("t", x) for x in fixed.RECITALS)} OR regexp_matches(t, '(?im)^(kesatu|pertama|kedua|ketiga|keempat)\\s*:') AS recital FROM p)
      SELECT doc_id, page, recital, {oracle.has("t", fixed.PENJELASAN)} AS explanation, {oracle.has("t", fixed.LAMPIRAN)} AS appendix, recital OR {oracle.has("t", fixed.PASAL_ANYWHERE)} OR {oracle.has("t", fixed.BAB_ANYWHERE)} OR {oracle.has("t", fixed.TITLE_ANYWHERE)} AS looks_legal FROM r""",
    "m05_decide": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'accepted' WHEN NOT (o_orderkey % 5 > 0 AND o_orderstatus = 'O') AND NOT starts_with(o_orderpriority, '1') THEN CASE WHEN o_orderkey % 2 = 0 THEN 'next_page' ELSE 'rejected' END
      WHEN o_orderpriority >= '4' OR starts_with(o_orderpriority, '1') THEN 'accepted_by_model' ELSE 'rejected' END AS decision FROM orders""",
    "f20_identity": _IDENTITY,
    "f21_signing": _SIGNING.replace("\\'\\'", "''"),
    "f35_normalize_url": f"SELECT page_id, {_normal('url')} AS url, {_normal('dirty')} AS dirty_url FROM (SELECT page_id, url, regexp_replace(url, '^http', 'HTTP') || CASE WHEN contains(url, '?') THEN '&utm_source=a&b=1#top' ELSE '?utm_source=a&b=1#top' END AS dirty FROM pages)",
    "f36_source_code": f"SELECT page_id, {_code('url')} AS code, {_code('u')} AS port_code FROM (SELECT page_id, url, 'https://www.jdih.' || regexp_extract(url, '^https?://([^/:]*)', 1) || ':8080/x' AS u FROM pages)",
    "f37_sanitize": f"SELECT doc_id, {_sane('text')} AS name FROM documents",
    "s08_pdf_link": f"SELECT page_id, CASE WHEN l = '' THEN '' WHEN regexp_matches(l, '^https?://') THEN l WHEN starts_with(l, '/') THEN o || l ELSE o || '/' || l END AS link FROM (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS o, regexp_extract(regexp_replace(html, 'href=\"(/[^\"]*)\"', 'href=\"\\1.pdf?v=1\"', 'g'), {quoted(fixed.HREF_PDF)}, 1) AS l FROM pages)",
    "s09_sniff": "SELECT page_id, CASE WHEN starts_with(html, '%PDF') THEN 'pdf' WHEN starts_with(lower(ltrim(substr(html, 1, 512))), '<!doctype html') OR starts_with(lower(ltrim(substr(html, 1, 512))), '<html') THEN 'html' ELSE 'other' END AS kind, 'pdf' AS pdf_kind FROM pages",
    "s06_retry": "SELECT event_id, status, attempt, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN (status >= 500 OR status = 429) AND attempt <= 3 THEN 'retry' ELSE 'fail' END AS action FROM (SELECT event_id, 200 + event_id % 4 * 100 + CASE WHEN event_id % 7 = 0 THEN 29 ELSE 0 END AS status, event_id % 5 AS attempt FROM events)",
    "f39_file_name": "SELECT doc_id, sha256(text) || '.pdf' AS name FROM documents",
    "f17_numbers": "SELECT o_orderkey, CAST(coalesce(TRY_CAST(nullif(regexp_extract(c, '[0-9]+', 0), '') AS INT), 0) AS INT) AS nomor_urut, nullif(TRY_CAST(nullif(regexp_extract(regexp_replace(c, '^[0-9]-', '0-'), '[0-9]+', 0), '') AS INT), 0) AS sort_nomor, TRY_CAST(nullif(regexp_extract(c, '^([0-9]+)', 1), '') AS INT) AS prefix FROM (SELECT o_orderkey, o_orderpriority || ' No. ' || o_orderkey || '/2019' AS c FROM orders)",
    "f14_area": f"""SELECT o_orderkey, CASE WHEN starts_with(s, 'BUPATI ') THEN 'KABUPATEN ' || substr(s, 8) WHEN starts_with(s, 'GUBERNUR ') THEN {_ACEH("substr(s, 10)")} WHEN starts_with(s, 'WALIKOTA ') THEN 'KOTA ' || substr(s, 10)
      WHEN starts_with(s, 'DPRK ') THEN CASE WHEN list_contains({_AREA_LIST}, substr(s, 6)) THEN substr(s, 6) WHEN list_contains({_AREA_LIST}, 'KABUPATEN ' || substr(s, 6)) THEN 'KABUPATEN ' || substr(s, 6) WHEN list_contains({_AREA_LIST}, 'KOTA ' || substr(s, 6)) THEN 'KOTA ' || substr(s, 6) ELSE 'KABUPATEN ' || substr(s, 6) END
      WHEN starts_with(s, 'PROVINSI ') THEN {_ACEH("substr(s, 10)")} WHEN starts_with(s, 'KOTA ') OR starts_with(s, 'KABUPATEN ') THEN s ELSE {_ACEH("s")} END AS wilayah
      FROM (SELECT o_orderkey, {_TIDY(f"{_AREA_FORMS}[o_orderkey % 7 + 1] || regexp_replace({_AREA_LIST}[o_custkey % 25 + 1], '^(KABUPATEN|KOTA) ', '') || ' ,'")} AS s FROM orders)""",
    "f25_citation_key": f"SELECT p_partkey, replace(regexp_replace(lower({stripped('p_type')}), '\\s+', '_', 'g'), '-', '_') || '|' || p_size || '|2001' AS key FROM part",
    "f01_fix_line": f"WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS place, unnest(string_split(text, chr(10))) AS line FROM documents), r AS ({oracle.fix_line('line', 'l', 'doc_id, place')}) SELECT doc_id, place AS at, text AS line FROM ({oracle.fix_anchor('r', 'doc_id, place')})",
    "f30_compare": f"""WITH {_PAGES_SQL}, c AS (SELECT doc_id, page, {_FLAT_TEXT("a")} AS x, {_FLAT_TEXT("b")} AS y FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(a, '[0-9]', '7', 'g') WHEN doc_id % 3 = 1 THEN regexp_replace(a, 'th', 'TH ', 'g') ELSE reverse(a) END AS b FROM text_pages)),
      s AS (SELECT doc_id, page, CASE WHEN greatest(strlen(x), strlen(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(strlen(x), strlen(y)) END AS s, regexp_extract_all(x, '(\\d+)', 1) = regexp_extract_all(y, '(\\d+)', 1) AS d FROM c)
      SELECT doc_id, page, round(s, 6) AS similarity, d AS digits_equal, s >= 0.95 AND d AS trusted FROM s""",
    "w09_token_runs": """WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS place, regexp_replace(unnest(string_split(text, chr(10))), '^(\\S+) (\\S+) ', '\\1 \\2 \\2 \\2 \\2 \\2 \\2 \\2 ') AS line FROM documents),
      t AS (SELECT doc_id, place, line, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS ts FROM l), u AS (SELECT doc_id, place, unnest(ts) AS w, unnest(range(0, len(ts))) AS k FROM t),
      v AS (SELECT *, sum(CASE WHEN w IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, place ORDER BY k) AS island FROM (SELECT *, lag(w) OVER (PARTITION BY doc_id, place ORDER BY k) AS p FROM u)),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, place, island ORDER BY k) AS r FROM v), j AS (SELECT doc_id, place, string_agg(w, ' ' ORDER BY k) AS s, count(*) AS c FROM n WHERE r <= 4 GROUP BY 1, 2)
      SELECT t.doc_id, t.place AS at, CASE WHEN len(ts) > 4 AND c < len(ts) THEN s ELSE line END AS line FROM t LEFT JOIN j USING (doc_id, place)""",
    "p01_ranges": "SELECT * FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 20 END AS pages FROM orders) WHERE y BETWEEN 1994 AND 1996 AND (pages IS NULL OR pages <= 5)",
    "f46_fulltext": "SELECT token, count(*) AS documents, CAST(sum(c) AS BIGINT) AS times FROM (SELECT token, doc_id, count(*) AS c FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents) WHERE token <> '' GROUP BY 1, 2) GROUP BY 1",
}
