"""Clean lines to sections.

The bounds of a document are minima over its lines, from one aggregate over the exchange the lines already have, joined
back on it; each line then meets every section whose range holds it by a filter on a small array. Ranges may overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions import fixed, text

#: Sections in the order of their nodes.
SECTIONS = ["judul", "menimbang", "mengingat", "memperhatikan", "penetapan", "batang_tubuh", "narasi", "penjelasan_umum", "penjelasan_pasal", "lampiran"]


def by_doc():
    return Window.partitionBy("doc_id")


def _after(at: str, *later: str) -> Column:
    """Smallest of the later bounds that lies after `at`, else the end."""
    return F.coalesce(F.least(F.col("n"), *[F.when(F.col(x) > F.col(at), F.col(x)) for x in later]), F.col("n"))


#: Anchors that a bound is the first of, and the letters their lines begin with.
_ANCHORS = {"menimbang": (fixed.MENIMBANG, "Mm"), "mengingat": (fixed.MENGINGAT, "Mm"), "memperhatikan": (fixed.MEMPERHATIKAN, "Mm"), "memutuskan": (fixed.MEMUTUSKAN, "Mm"), "menetapkan": (fixed.MENETAPKAN, "Mm"), "penjelasan": (fixed.PENJELASAN, "Pp")}
_TOLD = {"umum": (fixed.UMUM, "IiUu"), "pasal_demi": (fixed.PASAL_DEMI, "IiPp"), "told_pasal": (fixed.PASAL_ANYWHERE, "Pp")}


def bounds(lines: DataFrame) -> DataFrame:
    """Clean lines with the places of the anchors (null: none), body start and end, n and has_pasal.

    A document's few lines with anchors and its blank lines are gathered once; all bounds are worked out on those."""
    line, kind = F.col("text"), F.col("m.kind")
    plain_next = F.coalesce((F.lead("text").over(by_doc().orderBy("idx")) != "") & (F.lead("m.kind").over(by_doc().orderBy("idx")) == "none"), F.lit(False))
    marked = lines.withColumn("_plain", plain_next)
    places = lambda condition: F.sort_array(F.collect_list(F.when(condition, F.col("idx"))))
    found = {name: places(text.starts(line, letters) & line.rlike(pattern)) for name, (pattern, letters) in (_ANCHORS | _TOLD).items()}
    found |= {"lampiran": F.min(F.when(text.starts(line, "L") & line.rlike(fixed.LAMPIRAN), F.col("idx"))), "blank": places(line == ""), "opened": places(kind.isin("bab", "pasal", "diktum"))}
    # what follows a line matters for lines of a decision only
    decides = text.starts(line, "Mm") & (line.rlike(fixed.MENETAPKAN) | line.rlike(fixed.MEMUTUSKAN)) & F.col("_plain")
    by = marked.groupBy("doc_id").agg(F.count("*").alias("total"), *[v.alias(f"_{k}") for k, v in found.items()], places(decides).alias("_goes_on"))

    def first(name: str, *conditions) -> Column:
        return F.array_min(F.filter(f"_{name}", lambda i: (i < F.col("n")) & F.coalesce(*[c(i) for c in conditions], F.lit(False)) if conditions else i < F.col("n")))

    blank_after = lambda at: F.coalesce(F.array_min(F.filter("_blank", lambda i: (i > F.col(at)) & (i < F.col("n")))), F.col("n"))
    wrap = lambda at: F.when(F.array_contains("_goes_on", F.col(at)) & (F.col(at) + 1 < F.col("n")), blank_after(at)).otherwise(F.col(at) + 1)
    d = by.withColumn("lampiran", F.col("_lampiran")).withColumn("n", F.coalesce("lampiran", "total"))
    d = d.withColumns({name: first(name) for name in ("menimbang", "mengingat", "memperhatikan", "memutuskan", "penjelasan", "opened")})
    d = d.withColumn("has_pasal", F.size("_told_pasal") > 0)
    d = d.withColumns({"menetapkan": first("menetapkan", lambda i: i >= F.coalesce("memutuskan", F.lit(0))), "last_opening": F.greatest("menimbang", "mengingat", "memperhatikan")})
    start = F.when(F.col("menetapkan").isNotNull(), wrap("menetapkan")).when(F.col("memutuskan").isNotNull(), wrap("memutuskan"))
    start = start.otherwise(F.coalesce(F.col("opened"), F.when(F.col("last_opening").isNotNull(), blank_after("last_opening"))))
    told = lambda i: i >= F.col("penjelasan")
    d = d.withColumns({"body": start, "body_end": F.coalesce("penjelasan", "n"), **{name: first(name, told) for name in _TOLD}})
    kept = ["doc_id", "total", "n", "has_pasal", "menimbang", "mengingat", "memperhatikan", "memutuskan", "menetapkan", "opened", "penjelasan", "lampiran", "body", "body_end", *_TOLD]
    return lines.join(d.select(kept), "doc_id")


def ranges() -> Column:
    """Array of (seg, section, start, end) of a document, from the columns of bounds()."""
    c = F.col

    def seg(section: str, start: Column, end: Column, when: Column) -> Column:
        number = SECTIONS.index(section) + 1
        return F.when(when & (start < end), F.struct(F.lit(number).alias("seg"), F.lit(section).alias("section"), start.alias("start"), end.alias("end")))

    there = lambda name: c(name).isNotNull()
    first = F.coalesce(F.least("menimbang", "mengingat", "memperhatikan", "memutuskan"), c("body"))
    narrative = c("body").isNull() & ~there("menimbang") & ~there("mengingat") & ~there("memperhatikan") & ~there("memutuskan") & ~there("menetapkan")
    decided = F.when(c("body") > c("memutuskan"), c("body")).otherwise(c("memutuskan") + 1)
    umum_from = F.when(c("umum") < c("pasal_demi"), c("umum")).otherwise(c("penjelasan"))
    by_pasal = there("pasal_demi") | (~there("umum") & there("told_pasal"))
    general_end = F.coalesce("pasal_demi", "n")
    return F.array_compact(
        F.array(
            seg("judul", F.lit(0).cast("long"), first, there("menimbang") | there("mengingat") | there("memperhatikan") | there("memutuskan") | there("body")),
            seg("menimbang", c("menimbang"), _after("menimbang", "mengingat", "memutuskan", "body"), there("menimbang")),
            seg("mengingat", c("mengingat"), _after("mengingat", "memperhatikan", "memutuskan", "body"), there("mengingat")),
            seg("memperhatikan", c("memperhatikan"), _after("memperhatikan", "memutuskan", "body"), there("memperhatikan")),
            seg("penetapan", c("memutuskan"), F.least(decided, c("n")), there("memutuskan")),
            seg("batang_tubuh", c("body"), c("body_end"), there("body")),
            seg("narasi", F.lit(0).cast("long"), c("body_end"), narrative),
            seg("penjelasan_umum", F.when(there("pasal_demi"), umum_from).otherwise(F.coalesce("umum", "penjelasan")), general_end, there("penjelasan") & (there("pasal_demi") | there("umum") | ~there("told_pasal"))),
            seg("penjelasan_pasal", F.coalesce("pasal_demi", "penjelasan"), c("n"), there("penjelasan") & by_pasal),
            seg("lampiran", c("lampiran"), c("total"), there("lampiran")),
        )
    )


def segments(bounded: DataFrame) -> DataFrame:
    """(doc_id, seg, section, start, end), one row for each section."""
    return bounded.where("idx = 0").select("doc_id", F.explode(ranges()).alias("s")).select("doc_id", "s.*")


def segment_lines(bounded: DataFrame) -> DataFrame:
    """(doc_id, seg, section, idx, page, text, m): each line once for every section that holds it."""
    held = F.filter(ranges(), lambda s: (s["start"] <= F.col("idx")) & (F.col("idx") < s["end"]))
    return bounded.select("doc_id", "idx", "page", "text", "m", F.explode(held).alias("s")).select("doc_id", "s.seg", "s.section", "idx", "page", "text", "m")


def section_warnings(bounded: DataFrame) -> DataFrame:
    """(doc_id, message) of sections that documents with articles lack, and of documents without a body."""
    c = F.col
    narrative = F.coalesce("body", "menimbang", "mengingat", "memperhatikan", "memutuskan", "menetapkan").isNull()
    no_body = ~F.coalesce(c("body") < c("body_end"), F.lit(False)) & ~narrative
    missing = [F.when(c(a).isNull() & c("has_pasal"), F.lit(f"Section '{w}' tidak ditemukan")) for a, w in (("menimbang", "Menimbang"), ("mengingat", "Mengingat"), ("memutuskan", "MEMUTUSKAN/Menetapkan"))]
    said = F.array_compact(F.array(*missing, F.when(no_body, F.lit("Batang tubuh (Pasal-pasal) tidak terdeteksi"))))
    return bounded.where("idx = 0").select("doc_id", F.explode(said).alias("message"))
