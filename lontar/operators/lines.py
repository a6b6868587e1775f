"""Pages to clean lines.

All rules of a document look at its own lines only, so the lines are dealt by doc_id once and every window and
aggregate below reuses that exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions import fixed, text

def by_doc():
    return Window.partitionBy("doc_id")


def in_order():
    return by_doc().orderBy("line_no")


def explode_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) to (doc_id, page, line_no, text): lines in order, numbered over the document."""
    each = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "text"))
    number = F.row_number().over(by_doc().orderBy("page", "at"))
    return each.select("doc_id", F.col("page").cast("long").alias("page"), number.cast("long").alias("line_no"), "text")


def classified(lines: DataFrame) -> DataFrame:
    """lines with repaired text and the structural match m and whether boundary rules spare them (firm)."""
    # one step after the other: each expression uses the last one's result many times
    made = lines.withColumn("text", text.fix_line(F.col("text"))).withColumn("text", text.fix_anchor(F.col("text"))).withColumn("m", text.structural(F.col("text")))
    return made.withColumn("firm", text.looks_structural(F.col("text"), F.col("m.kind")))


def boilerplate(lines: DataFrame) -> DataFrame:
    """lines with n_pages of the document, on_pages their text stands on, and boiler: headers and footers, on 40 % of the
    pages or more of a document of three or more."""
    same = Window.partitionBy("doc_id", "text")
    counted = lines.withColumn("n_pages", F.max("page").over(by_doc())).withColumn("on_pages", F.size(F.collect_set("page").over(same)).cast("long"))
    often = F.col("on_pages") >= F.floor((F.col("n_pages") * 4 + 9) / 10)
    return counted.withColumn("boiler", (F.col("text") != "") & (F.col("n_pages") >= fixed.MIN_PAGES) & often & ~F.col("firm"))


def collapse_blanks(lines: DataFrame) -> DataFrame:
    """One of several blank lines in a row stays, and none at the end of a document."""
    blank = F.col("text") == ""
    again = blank & F.coalesce(F.lag("text").over(in_order()) == "", F.lit(False))
    kept = lines.withColumn("_again", again).where(~F.col("_again")).drop("_again")
    last = F.max(F.when(~blank, F.col("line_no"))).over(by_doc())
    return kept.withColumn("_last", last).where(F.col("line_no") <= F.col("_last")).drop("_last")


def drop_cut_lines(lines: DataFrame) -> DataFrame:
    """A line that the first line of the next page repeats in full goes."""
    after, page = F.lead("text").over(in_order()), F.lead("page").over(in_order())
    cut = (page != F.col("page")) & (F.octet_length("text") >= fixed.MIN_OVERLAP) & ~F.col("firm") & F.startswith(F.lower(after), F.lower("text"))
    return lines.withColumn("_cut", F.coalesce(cut, F.lit(False))).where(~F.col("_cut")).drop("_cut")


def drop_repeated_heads(lines: DataFrame) -> DataFrame:
    """A structural line goes if the next line with text is on another page and opens the same thing."""
    near = Window.partitionBy("doc_id", F.col("text") == "").orderBy("line_no")
    after = F.lead(F.struct("page", "m.kind", "m.label")).over(near)
    same = (after["page"] != F.col("page")) & (F.col("m.kind") != "none") & (F.col("m.label") != "") & (after["kind"] == F.col("m.kind")) & (after["label"] == F.col("m.label"))
    return lines.withColumn("_same", (F.col("text") != "") & F.coalesce(same, F.lit(False))).where(~F.col("_same")).drop("_same")


def stitch(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text) to the clean lines (doc_id, idx, page, line_no, text, m): idx counts from 0."""
    found = boilerplate(classified(lines.repartition("doc_id")))
    found = found.where(~F.col("boiler") & ~((F.col("text") != "") & text.furniture(F.col("text"), F.col("firm"))))
    found = drop_repeated_heads(drop_cut_lines(collapse_blanks(found)))
    return found.select("doc_id", (F.row_number().over(in_order()) - 1).cast("long").alias("idx"), "page", "line_no", "text", "m")
