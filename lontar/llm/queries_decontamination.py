"""Query and SQL of the decontamination operator."""

from pyspark.sql import DataFrame, SparkSession

from . import decontamination as d


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = d.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "item_words", "covered", "n_windows")


def _tokens(table: str, key: str) -> str:
    t = "regexp_replace(coalesce(text, ''), '\\x01', ' ', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9])[.,]([0-9])', '\\1_\\2', 'g')"
    t = f"regexp_replace({t}, '([0-9])(\\p{{L}})', '\\1 \\2', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '([\\p{{L}}0-9,;:] )(\\p{{Lu}}\\p{{Ll}})', '\\1' || chr(1) || '\\2', 'g')"
    words = f"list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}_\\x01]+'), lambda w: w <> '')"
    units = ", ".join(f"'{u}'" for u in d.UNITS)
    return f"""
SELECT key, pos, w, CASE WHEN w < chr(2) THEN '{d.NAME}' WHEN w < ':' THEN '{d.NUM}'
         WHEN prev >= '0' AND prev < ':' AND w IN ({units}) THEN '{d.UNIT}' ELSE w END AS c
FROM (SELECT key, pos, w, lag(w) OVER (PARTITION BY key ORDER BY pos) AS prev
      FROM (SELECT {key} AS key, unnest({words}) AS w, generate_subscripts({words}, 1) AS pos FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL))"""


_LAST = d.WINDOW - 1
OP2_SQL = f"""
WITH dt AS MATERIALIZED ({_tokens("documents", "doc_id")}),
bt AS MATERIALIZED ({_tokens("benchmark", "item_id")}),
dw AS (SELECT key, pos, list(c) OVER w AS g FROM dt WINDOW w AS (PARTITION BY key ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_LAST} FOLLOWING)),
bw AS (SELECT key, pos, n, list(c) OVER w AS g
       FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM bt)
       WINDOW w AS (PARTITION BY key ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_LAST} FOLLOWING)),
hit AS (SELECT dw.key AS doc_id, bw.key AS item_id, bw.n AS item_words, bw.pos AS item_at, dw.pos - bw.pos AS shift
        FROM dw JOIN bw ON dw.g = bw.g WHERE len(bw.g) = {d.WINDOW}),
words AS (SELECT DISTINCT doc_id, item_id, item_words, shift, item_at + unnest(range(0, {d.WINDOW})) AS item_at FROM hit),
slots AS (
  SELECT x.doc_id, x.item_id, x.shift, count(DISTINCT (b.w, t.w)) AS np, count(DISTINCT b.w) AS na
  FROM words x JOIN bt b ON b.key = x.item_id AND b.pos = x.item_at JOIN dt t ON t.key = x.doc_id AND t.pos = x.item_at + x.shift
  WHERE b.c IN ('{d.NUM}', '{d.NAME}', '{d.UNIT}') GROUP BY ALL),
aligned AS (
  SELECT c.doc_id, c.item_id, c.item_words, c.shift, c.covered, n.n_windows, coalesce(s.np = s.na, true) AS consistent
  FROM (SELECT doc_id, item_id, item_words, shift, count(*) AS covered FROM words GROUP BY ALL) c
  JOIN (SELECT doc_id, item_id, shift, count(DISTINCT item_at) AS n_windows FROM hit GROUP BY ALL) n USING (doc_id, item_id, shift)
  LEFT JOIN slots s USING (doc_id, item_id, shift)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY consistent DESC, covered DESC, shift) AS r FROM aligned)
SELECT doc_id, item_id, CAST(item_words AS INT) AS item_words, CAST(covered AS INT) AS covered, n_windows
FROM best WHERE r = 1 AND consistent AND covered >= item_words * {d.COVERAGE}
"""
