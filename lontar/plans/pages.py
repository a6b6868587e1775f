"""Queries of recognition, images, sources and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import fixed, text
from lontar.operators import images, recognition
from lontar.sources import listing
from lontar.streaming import queue

from . import corpus, oracle


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def f34_degenerate(spark, sf_dir):
    return recognition.degenerate(_read(spark, sf_dir, "documents"))


def w08_line_runs(spark, sf_dir):
    """Each line of the documents said five times over."""
    said = F.flatten(F.transform(F.split("text", "\n", -1), lambda x: F.array_repeat(x, 5)))
    return _read(spark, sf_dir, "documents").select("doc_id", F.explode(text.clamp_lines(said)).alias("x")).select("doc_id", "x.at", "x.text")


def m06_text_source(spark, sf_dir):
    """All pages of all documents; the layers are wrong in one digit, one letter or nothing."""
    from . import scalars

    d = scalars._text_pages(spark, sf_dir).select("doc_id", "page", "a", F.concat("a", F.lit(" x 12")).alias("ocr"))
    layer = F.when(F.col("doc_id") % 3 == 0, F.concat("a", F.lit(" x 13"))).when(F.col("doc_id") % 3 == 1, F.concat("a", F.lit(" y 12"))).otherwise("")
    return recognition.elect(d.withColumn("layer", layer).withColumn("other", F.when(F.col("doc_id") % 2 == 0, F.col("ocr"))))


def w15_tiers(spark, sf_dir):
    pages = corpus.page_texts(spark, sf_dir, 6, 7, 8)
    return recognition.tiers(pages).select("doc_id", F.col("page").cast("int").alias("page"), "tier")


def w16_accepted_page(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page")).agg(F.max("text").alias("text"))
    return recognition.accepted_page(turns, F.length("text") % 2 == 0)


def s11_form_feed(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.lit(3).alias("from_page"), F.lit(4).alias("n_pages"), F.replace("text", F.lit("\n"), F.lit("\f")).alias("raw"))
    return recognition.form_feed_pages(d)


def f27_answers(spark, sf_dir):
    """Answers of a model around JSON, made of the properties of events."""
    raw = F.concat(F.lit("Jawaban:\n"), F.when(F.col("event_id") % 5 > 0, F.col("props")).otherwise("tidak ada"), F.lit("\nselesai"))
    d = _read(spark, sf_dir, "events").select("event_id", recognition.answer(raw, "k long").alias("a"), recognition.output_cap(F.col("event_id")).cast("long").alias("cap"))
    return d.select("event_id", F.col("a.k").alias("k"), "cap")


def s03_listing(spark, sf_dir):
    """Pages as records of a JSON listing."""
    record = F.struct(F.col("page_id").cast("string").alias("idData"), F.concat(F.lit("Nomor "), "page_id").alias("noPeraturan"), F.when(F.col("page_id") % 3 > 0, F.lit("Tahun 2019")).alias("tahun_pengundangan"), F.when(F.col("page_id") % 5 > 0, F.regexp_extract("url", "^([^?#]*)", 1)).alias("urlDownload"))
    bodies = _read(spark, sf_dir, "pages").groupBy((F.col("page_id") % 10).alias("g")).agg(F.to_json(F.collect_list(record)).alias("body"))
    return listing.remote_documents(listing.parse(bodies))


def i01_measures(spark, sf_dir):
    """Embeddings as 8 by 8 grids of luminance."""
    d = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 32767)).alias("pixels"))
    m = d.select("vec_id", images.measures(F.col("pixels"), F.lit(8)).alias("m")).select("vec_id", "m.*")
    return m.select("vec_id", F.round("ink_ratio", 6).alias("ink_ratio"), "top", "bottom", "left", "right", images.is_blank(F.col("ink_ratio")).alias("blank"))


def i02_blur(spark, sf_dir):
    d = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 32767)).alias("pixels"))
    m = d.select("vec_id", images.measures(F.col("pixels"), F.lit(8))["blur_score"].alias("blur"))
    return m.select("vec_id", F.round(F.col("blur") * 1296, 0).alias("blur"), images.resolution(F.col("blur")).alias("dpi"))


def i02_large_pages(spark, sf_dir):
    """Pages of 640 by 700 dots for some orders, above the size from which only some dots are looked at: ruled by an order's key."""
    k = F.col("o_orderkey")
    # dot x of row y is (7 y + 13 x + k % 97) % 101: every row is a part of the same longer one, from where it starts, and
    # rows say themselves again after 101
    ruled = F.array(*[F.lit(13 * x % 101 * 600) for x in range(640 + 101)])
    start = lambda y: ((y * 7 + k % 97) * 70 % 101 + 1).cast("int")  # noqa: E731  (13 * 70 % 101 = 1)
    rows = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda y: F.slice(ruled, start(y), F.lit(640)))
    dots = text.let(rows, lambda r: F.flatten(F.slice(F.flatten(F.array_repeat(r, 7)), 1, 700)))
    d = _spread(_read(spark, sf_dir, "orders").where(k % 500 == 0).select("o_orderkey"), "o_orderkey").select(k, dots.alias("pixels"))
    m = d.select("o_orderkey", images.measures(F.col("pixels"), F.lit(640)).alias("m"))
    return m.select("o_orderkey", F.round("m.ink_ratio", 6).alias("ink_ratio"), F.round(F.col("m.blur_score") / 1000, 0).cast("long").alias("blur"), images.resolution(F.col("m.blur_score")).alias("dpi"))


def i03_crop(spark, sf_dir):
    """Parts as pages of 60 by 80 dots with a block of ink and up to two specks of dirt."""
    k = F.col("p_partkey")
    white = lambda n: F.array_repeat(F.lit(65535), n)
    left, right, high = (15 + k % 7).cast("int"), (26 + k % 23).cast("int"), F.when(k % 11 > 0, 2 + k % 40).otherwise(0).cast("int")
    inked = F.concat(white(left), F.array_repeat(F.lit(0), right - left), white(60 - right))
    first, last = F.when(k % 3 > 0, 0).otherwise(65535), F.when(k % 3 > 1, 0).otherwise(65535)
    dots = F.concat(F.array(first), white(60 * 20 - 1), F.flatten(F.array_repeat(inked, high)), white((60 - high) * 60 - 1), F.array(last))
    d = _spread(_read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k, images.box(dots, F.lit(60)).alias("m"))
    return d.select("p_partkey", "m.top", "m.bottom", "m.left", "m.right", images.cropped_percent(F.col("m.right") - F.col("m.left"), F.col("m.bottom") - F.col("m.top"), F.lit(4800)).alias("cropped"))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly: a few bytes of each stand for much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _events(spark, sf_dir) -> DataFrame:
    where, name = f"{sf_dir}/events.parquet".rsplit("/", 1)
    schema = _read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(where)


def _place(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def st7_parse_once(spark, sf_dir):
    """Users as documents that are ready to parse when a first event of type purchase comes, whatever comes later."""
    place = _place(spark)
    ready = queue.parse_once(_events(spark, sf_dir).select(F.col("user_id").alias("id"), (F.col("event_id") % 3 == 0).alias("ready")))
    return queue.drain(ready, f"{place}/out", f"{place}/state").select("id")


def st6_page_stream(spark, sf_dir):
    """Events as read pages, some read again: each is stored once."""
    place = _place(spark)
    pages = _events(spark, sf_dir).select(F.col("user_id").alias("document_id"), (F.col("event_id") % 40).alias("page_number"))
    return queue.drain(queue.pages_once(pages), f"{place}/out", f"{place}/state").select("document_id", "page_number")


def st4_register_stream(spark, sf_dir):
    place = _place(spark)
    stream = queue.register_once(_events(spark, sf_dir).select(F.concat_ws("/", "user_id", "event_type").alias("download_url")))
    return queue.drain(stream, f"{place}/out", f"{place}/state").select("download_url")


def st5_status_machine(spark, sf_dir):
    place = _place(spark)
    event = F.when(F.col("event_id") % 5 == 0, "fail").when(F.col("event_id") % 7 == 0, "interrupted").otherwise("ok")
    stream = queue.status_machine(_events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), event.alias("event")))
    return queue.drain(stream, f"{place}/out", f"{place}/state", "update").select("id", "status", "attempts", "seen")


def _text_pages_sql() -> str:
    from . import scalars

    return scalars._PAGES_SQL


QUERIES = {f.__name__: f for f in (f34_degenerate, w08_line_runs, m06_text_source, w15_tiers, w16_accepted_page, s11_form_feed, f27_answers, s03_listing, i01_measures, i02_blur, i02_large_pages, i03_crop, st4_register_stream, st5_status_machine, st6_page_stream, st7_parse_once)}
_PIXELS = "list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 32767) AS BIGINT))"
ORACLE_SQL = {
    "f34_degenerate": """WITH t AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS t FROM documents), c AS (SELECT doc_id, t, count(*) AS n FROM t WHERE t <> '' GROUP BY 1, 2),
      w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS top, count(*) AS "distinct" FROM c GROUP BY 1), l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents),
      s AS (SELECT doc_id, sum(n) AS n_lines, max(CASE WHEN l <> '' THEN n END) AS top_line FROM (SELECT doc_id, l, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1)
      SELECT doc_id, tokens, top, "distinct", tokens >= 40 AND (top / tokens > 0.5 OR "distinct" / tokens < 0.05 OR (n_lines >= 20 AND top_line > 15)) AS degenerate FROM w JOIN s USING (doc_id)""",
    "w15_tiers": f"""WITH {corpus.sql()}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS text FROM corpus WHERE page IN (6, 7, 8) GROUP BY 1, 2),
      r AS (SELECT doc_id, page, max(CASE WHEN {oracle.has("text", fixed.LAMPIRAN)} THEN 2 WHEN {oracle.has("text", fixed.PENJELASAN)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM p)
      SELECT doc_id, CAST(page AS INT) AS page, CASE k WHEN 2 THEN 'lampiran' WHEN 1 THEN 'penjelasan' ELSE '' END AS tier FROM r""",
    "i02_blur": f"""WITH p AS (SELECT vec_id, unnest({_PIXELS}) AS v, unnest(range(0, 64)) AS k FROM embeddings), g AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, v FROM p),
      l AS (SELECT a.vec_id, 4 * a.v - u.v - d.v - e.v - w.v AS z FROM g a JOIN g u ON u.vec_id = a.vec_id AND u.y = a.y - 1 AND u.x = a.x JOIN g d ON d.vec_id = a.vec_id AND d.y = a.y + 1 AND d.x = a.x
        JOIN g e ON e.vec_id = a.vec_id AND e.y = a.y AND e.x = a.x + 1 JOIN g w ON w.vec_id = a.vec_id AND w.y = a.y AND w.x = a.x - 1)
      SELECT vec_id, round(var_pop(z) * 1296, 0) AS blur, CASE WHEN var_pop(z) >= 5e8 THEN 100 WHEN var_pop(z) >= 5e7 THEN 150 ELSE 200 END AS dpi FROM l GROUP BY vec_id""",
    "w16_accepted_page": "WITH t AS (SELECT conv_id AS doc_id, turn AS page, max(text) AS text FROM conversations GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS n FROM t WHERE trim(text) <> '') SELECT doc_id, min(page) AS page FROM f WHERE n <= 2 AND length(text) % 2 = 0 GROUP BY 1",
    "s11_form_feed": "SELECT doc_id, CAST(3 + k AS INT) AS page, coalesce(string_split(text, chr(10))[k + 1], '') AS text FROM documents, (SELECT CAST(unnest(range(0, 4)) AS INT) AS k)",
    "f27_answers": "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(props ->> '$.k' AS BIGINT) END AS k, CAST(least(floor(event_id * 1.5) + 256, 4096) AS BIGINT) AS cap FROM events",
    "s03_listing": "SELECT regexp_extract(url, '^([^?#]*)', 1) AS download_url, CASE WHEN page_id % 3 > 0 THEN 2019 END AS sort_tahun, nullif(CAST(page_id AS INT), 0) AS sort_nomor FROM pages WHERE page_id % 5 > 0",
    "i01_measures": f"SELECT vec_id, round(len(list_filter(p, lambda x: x < 40000)) / 64, 6) AS ink_ratio, CAST(0 AS INT) AS top, CAST(8 AS INT) AS bottom, CAST(0 AS INT) AS left, CAST(8 AS INT) AS right, len(list_filter(p, lambda x: x < 40000)) / 64 < 0.0004 AS blank FROM (SELECT vec_id, {_PIXELS} AS p FROM embeddings)",
    "i02_large_pages": """WITH g AS (SELECT o_orderkey, x, y, (y * 7 + x * 13 + o_orderkey % 97) % 101 * 600 AS v FROM orders, (SELECT unnest(range(0, 640)) AS x), (SELECT unnest(range(0, 700)) AS y) WHERE o_orderkey % 500 = 0),
      i AS (SELECT o_orderkey, round(avg((v < 40000)::INT), 6) AS ink_ratio FROM g WHERE x % 3 = 0 AND y % 3 = 0 GROUP BY 1), e AS (SELECT * FROM g WHERE x % 2 = 0 AND y % 2 = 0),
      l AS (SELECT o_orderkey, x, y, 4 * v - lag(v) OVER r - lead(v) OVER r AS h, v, lag(v) OVER c + lead(v) OVER c AS w FROM e WINDOW r AS (PARTITION BY o_orderkey, y ORDER BY x), c AS (PARTITION BY o_orderkey, x ORDER BY y)),
      b AS (SELECT o_orderkey, var_pop(h - w) AS b FROM l GROUP BY 1) SELECT o_orderkey, ink_ratio, CAST(round(b / 1000) AS BIGINT) AS blur, CASE WHEN b >= 5e8 THEN 100 WHEN b >= 5e7 THEN 150 ELSE 200 END AS dpi FROM b JOIN i USING (o_orderkey)""",
    "i03_crop": """WITH d AS (SELECT p_partkey AS k, x, y FROM part, (SELECT unnest(range(0, 60)) AS x), (SELECT unnest(range(0, 80)) AS y)
        WHERE (p_partkey % 11 > 0 AND x BETWEEN 15 + p_partkey % 7 AND 25 + p_partkey % 23 AND y BETWEEN 20 AND 21 + p_partkey % 40) OR (p_partkey % 3 > 0 AND x = 0 AND y = 0) OR (p_partkey % 3 > 1 AND x = 59 AND y = 79)),
      rows_ AS (SELECT k, y, count(*) AS n FROM d GROUP BY 1, 2), cols_ AS (SELECT k, x, count(*) AS n FROM d GROUP BY 1, 2), total_ AS (SELECT k, count(*) AS n FROM d GROUP BY 1),
      boxes AS (SELECT least_, r.k, r.a, r.b, c.a AS c, c.b AS d FROM (SELECT unnest([2, 1]) AS least_) z,
        LATERAL (SELECT k, min(y) AS a, max(y) AS b FROM rows_ WHERE n >= least_ GROUP BY k) r, LATERAL (SELECT k, min(x) AS a, max(x) AS b FROM cols_ WHERE n >= least_ GROUP BY k) c WHERE r.k = c.k),
      held AS (SELECT b.*, least((SELECT sum(n) FROM rows_ w WHERE w.k = b.k AND y BETWEEN b.a AND b.b), (SELECT sum(n) FROM cols_ w WHERE w.k = b.k AND x BETWEEN b.c AND b.d)) >= 0.995 * t.n AS good FROM boxes b JOIN total_ t USING (k)),
      chosen AS (SELECT k, a, b, c, d, row_number() OVER (PARTITION BY k ORDER BY least_ DESC) AS r FROM held h WHERE (least_ = 2 AND good) OR (least_ = 1 AND EXISTS (SELECT 1 FROM held o WHERE o.k = h.k AND o.least_ = 2))),
      padded AS (SELECT k, greatest(0, a - 12) AS t, least(80, b + 13) AS u, greatest(0, c - 12) AS l, least(60, d + 13) AS r FROM chosen WHERE r = 1),
      kept AS (SELECT * FROM padded WHERE r - l >= 16 AND u - t >= 8 AND (u - t) * (r - l) / 4800 <= 0.98)
      SELECT p_partkey, CAST(coalesce(t, 0) AS INT) AS top, CAST(coalesce(u, 80) AS INT) AS bottom, CAST(coalesce(l, 0) AS INT) AS left, CAST(coalesce(r, 60) AS INT) AS right, 100 - coalesce((u - t) * (r - l), 4800) * 100 / 4800 AS cropped FROM part LEFT JOIN kept ON k = p_partkey""",
    "st6_page_stream": "SELECT DISTINCT user_id AS document_id, event_id % 40 AS page_number FROM events",
    "st7_parse_once": "SELECT DISTINCT user_id AS id FROM events WHERE event_id % 3 = 0",
    "st4_register_stream": "SELECT DISTINCT user_id || '/' || event_type AS download_url FROM events",
    "m06_text_source": f"""WITH {_text_pages_sql()} SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND min(strlen(trim(regexp_replace(a || ' x 12', '\\s+', ' ', 'g')))) >= 20 THEN 'pdftotext' WHEN doc_id % 2 = 0 THEN 'mupdf' ELSE 'ocr' END AS text_source
      FROM text_pages WHERE page <= 2 GROUP BY doc_id""",
    "w08_line_runs": """WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS k, unnest(string_split(text, chr(10))) AS line FROM documents),
      t AS (SELECT doc_id, k, line, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS ts FROM l), u AS (SELECT doc_id, k, unnest(ts) AS w, unnest(range(0, len(ts))) AS i FROM t),
      v AS (SELECT *, sum(CASE WHEN w IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY i) AS island FROM (SELECT *, lag(w) OVER (PARTITION BY doc_id, k ORDER BY i) AS p FROM u)),
      m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, island ORDER BY i) AS r FROM v), j AS (SELECT doc_id, k, string_agg(w, ' ' ORDER BY i) AS s, count(*) AS c FROM m WHERE r <= 4 GROUP BY 1, 2),
      y AS (SELECT t.doc_id, t.k, CASE WHEN len(ts) > 4 AND c < len(ts) THEN s ELSE line END AS text FROM t LEFT JOIN j USING (doc_id, k)),
      x AS (SELECT doc_id, CAST(k * 5 + n AS INT) AS "at", text FROM y, (SELECT unnest(range(0, 5)) AS n)),
      r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM trim(text) OR trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "at") AS run FROM (SELECT *, lag(trim(text)) OVER (PARTITION BY doc_id ORDER BY "at") AS p FROM x)),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY "at") AS nth FROM r) SELECT doc_id, "at", text FROM n WHERE nth <= 3""",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
