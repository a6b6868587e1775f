"""Clean-up of recognised text and the choice between extractions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions import fixed, text
from lontar.functions.text import _SPACE


def clamp_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, page, at, text) with token runs cut and, of equal lines in a row, at most three left; at keeps the order.
    A blank line ends a run."""
    order = Window.partitionBy("doc_id", "page").orderBy("at")
    d = lines.withColumn("text", text.clamp_tokens(F.col("text"))).withColumn("_key", text.strip(F.col("text")))
    before = [F.col("_key") == F.lag("_key", n).over(order) for n in range(1, fixed.MAX_LINE_RUN + 1)]
    again = F.col("_key") != ""
    for same in before:
        again = again & F.coalesce(same, F.lit(False))
    return d.withColumn("_again", again).where(F.coalesce(~F.col("_again"), F.lit(True))).drop("_key", "_again")


def degenerate(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tokens, top, distinct, degenerate) of documents (key, text): mostly one token, very few different ones, or
    many lines with one of them over and over. Texts meet by key, and are counted there."""
    texts = documents.where("text is not null").groupBy(key).agg(F.collect_list("text").alias("texts"))
    return texts.select(key, _counted(F.col("texts")).alias("c")).where("c.tokens > 0").select(key, "c.*")


def _counted(texts: Column) -> Column:
    """struct(tokens, top, distinct, degenerate) of the texts of a document."""

    @F.pandas_udf("tokens long, top long, distinct long, degenerate boolean")
    def run(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for held in parts:
            tokens, said = Counter(), Counter()
            for t in held:
                tokens.update(t.encode().split())  # bytes are split at ASCII spaces alone
                said.update(line.strip(_SPACE) for line in t.split("\n"))
            n, top, n_lines = tokens.total(), max(tokens.values(), default=0), said.total()
            top_line = max((k for line, k in said.items() if line), default=0)
            odd = n > 0 and (top / n > 0.5 or len(tokens) / n < 0.05 or (n_lines >= 20 and top_line > 15))
            rows.append((n, top, len(tokens), n >= fixed.MIN_TOKENS and odd))
        return pd.DataFrame(rows, columns=["tokens", "top", "distinct", "degenerate"])

    return run(texts)


def elect(pages: DataFrame) -> DataFrame:
    """(doc_id, text_source) from pages (doc_id, page, ocr, layer, other): the first engine whose text of pages 1 and 2
    can be trusted against recognition, else recognition."""
    looked = pages.where("page in (1, 2)")
    good = lambda c: text.trusted(F.col("ocr"), F.coalesce(c, F.lit(""))).alias(c)
    both = looked.select("doc_id", good("layer"), good("other")).groupBy("doc_id").agg(F.min("layer").alias("layer"), F.min("other").alias("other"))
    return both.select("doc_id", F.when(F.col("layer"), "pdftotext").when(F.col("other"), "mupdf").otherwise("ocr").alias("text_source"))


def tiers(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) with tier: what a page is read with, raised for all pages after the one on which the
    explanation or the appendix begins."""
    order = Window.partitionBy("doc_id").orderBy("page")
    rank = F.when(F.col("text").rlike(fixed.LAMPIRAN), 2).when(F.col("text").rlike(fixed.PENJELASAN), 1).otherwise(0)
    before = F.max(rank).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("tier", F.element_at(F.array(F.lit(""), F.lit("penjelasan"), F.lit("lampiran")), F.coalesce(before, F.lit(0)) + 1))


def accepted_page(pages: DataFrame, accepted: Column, window: int = 2) -> DataFrame:
    """(doc_id, page) of the first page among the first `window` with text that is accepted."""
    filled = pages.where(text.strip(F.col("text")) != "").withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    return filled.where(F.col("_nth") <= window).where(accepted).groupBy("doc_id").agg(F.min("page").alias("page"))


def form_feed_pages(dumps: DataFrame) -> DataFrame:
    """(doc_id, page, text) from (doc_id, from_page, n_pages, raw): exactly n_pages pages, cut or filled with blanks; a
    blank page at the end is what the last form feed leaves."""
    parts = F.split(F.coalesce("raw", F.lit("")), "\f", -1)
    n = F.col("n_pages").cast("int")
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    return dumps.select("doc_id", "from_page", F.posexplode(padded).alias("at", "text")).select("doc_id", (F.col("from_page") + F.col("at")).alias("page"), "text")


def output_cap(tokens: Column, most: int = 4096) -> Column:
    """Tokens a model may write for so many it reads."""
    return F.least(F.floor(tokens * 1.5) + 256, F.lit(most))


def answer(raw: Column, schema: str) -> Column:
    """The JSON object in a model's answer, from its first brace to its last, decoded; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema)
