"""Section lines to nodes.

A sequential parser keeps registers that lines write and clear; here each register is the last non-null event in a
running window over a section's lines. All windows share one partitioning and order, so a section is sorted once. Node
numbers are running counts of opening lines, node texts ordered folds of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions import fixed, text
from lontar.functions.rules import FIELD_LINE, HEAD, VERSE_WORD

FLAT = ["menimbang", "mengingat", "memperhatikan"]
BODY = ["batang_tubuh", "penjelasan_pasal"]
STEP = 1000


def by_segment():
    return Window.partitionBy("doc_id", "seg")


def in_order():
    return by_segment().orderBy("idx", "sub")


def upto():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _register(*events: tuple[Column, Column]) -> Column:
    """Last of the events up to here: the first condition that holds on a line gives its value, '' clears."""
    value = None
    for condition, v in events:
        value = F.when(condition, v) if value is None else value.when(condition, v)
    return F.coalesce(F.last(value, ignorenulls=True).over(upto()), F.lit(""))


def _prepared(lines: DataFrame) -> DataFrame:
    """Lines with text, told whether a blank line or the start of the section precedes; heads of recitals that go on
    after their colon are two lines."""
    section, line = F.col("section"), F.col("text")
    silent = (line == "") | ((section == "penjelasan_umum") & (line.rlike(fixed.PENJELASAN) | line.rlike(fixed.UMUM)))
    d = lines.withColumn("silent", silent).withColumn("fresh", F.coalesce(F.lag("silent").over(by_segment().orderBy("idx")), F.lit(True)))
    d = d.where(~F.col("silent") & ~((section == "penjelasan_pasal") & line.rlike(fixed.PASAL_DEMI)))
    head = section.isin(FLAT) & (line.rlike(fixed.MENIMBANG) | line.rlike(fixed.MENGINGAT) | line.rlike(fixed.MEMPERHATIKAN))
    rest = text.strip(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
    whole = F.struct(F.lit(0).alias("sub"), line.alias("text"), F.col("m").alias("m"), head.alias("head"), F.lit(False).alias("item"))
    more = F.struct(F.lit(1).alias("sub"), rest.alias("text"), text.structural(rest).alias("m"), F.lit(False).alias("head"), F.lit(True).alias("item"))
    parts = F.when(head & (rest != ""), F.array(whole, more)).otherwise(F.array(whole))
    return d.select("doc_id", "seg", "section", "idx", "page", "fresh", F.explode(parts).alias("x")).select("doc_id", "seg", "section", "idx", "page", "fresh", "x.*")


def _events(d: DataFrame) -> DataFrame:
    """ev: what a line does to the registers, with its label and text."""
    section, line, kind = F.col("section"), F.col("text"), F.col("m.kind")
    in_body, in_told = section == "batang_tubuh", section == "penjelasan_pasal"
    d = d.withColumn("closing", in_body & F.coalesce(F.max(line.rlike(fixed.CLOSING)).over(upto()), F.lit(False)))
    verse = in_told & line.rlike(VERSE_WORD)
    label = F.when(verse, F.lower(F.replace(F.regexp_extract(line, VERSE_WORD, 1), F.lit(" "), F.lit("")))).otherwise(F.col("m.label"))
    content = F.when(verse, text.strip(F.regexp_extract(line, VERSE_WORD, 2))).otherwise(F.col("m.text"))
    ev = F.when(in_body & ~F.col("closing"), kind).when(verse, "ayat").when(in_told & kind.isin("pasal", "ayat", "huruf", "angka"), kind).otherwise("none")
    return d.withColumn("ev", ev).withColumn("label", label).withColumn("content", content)


def _registers(d: DataFrame) -> DataFrame:
    ev, label, none = F.col("ev"), F.col("label"), F.lit("")
    d = d.withColumn("bab", _register((ev == "bab", F.concat(F.lit("BAB "), label))))
    d = d.withColumn("bagian", _register((ev == "bagian", F.concat(F.lit("Bagian "), label)), (ev == "bab", none)))
    d = d.withColumn("paragraf", _register((ev == "paragraf", label), (ev.isin("bab", "bagian"), none)))
    d = d.withColumn("pasal", _register((ev == "pasal", label), (ev.isin("bab", "bagian", "paragraf", "diktum"), none)))
    d = d.withColumn("diktum", _register((ev == "diktum", label), (ev.isin("bab", "bagian", "paragraf", "pasal"), none)))
    d = d.withColumn("ayat", _register((ev == "ayat", label), (ev.isin("bab", "bagian", "paragraf", "pasal", "diktum"), none)))
    folded = (ev == "huruf") & ((F.col("pasal") != "") | (F.col("diktum") != ""))
    d = d.withColumn("fold_huruf", folded)
    d = d.withColumn("huruf", _register((F.col("fold_huruf"), label), (ev.isin("bab", "bagian", "paragraf", "pasal", "diktum", "ayat"), none)))
    return d.withColumn("fold_angka", (ev == "angka") & (F.col("huruf") != ""))


def _opened(d: DataFrame) -> DataFrame:
    """type of the node a line opens (null: none), and the piece it adds."""
    section, line, kind, ev = F.col("section"), F.col("text"), F.col("m.kind"), F.col("ev")
    upper = F.upper(line)
    greeting = upper.contains("RAHMAT TUHAN") | (upper.contains("PRESIDEN") & upper.contains("REPUBLIK INDONESIA") & (F.octet_length(line) < 60)) | upper.startswith("DENGAN ")
    d = d.withColumn("title_type", F.when(greeting, "pembukaan").otherwise("judul")).withColumn("field", line.rlike(FIELD_LINE))
    first = F.row_number().over(in_order()) == 1
    turn = F.coalesce((F.lag("title_type").over(in_order()) != F.col("title_type")) | F.lag("field").over(in_order()), F.lit(True))
    numbered = kind.isin("huruf", "angka")
    head = line.rlike(HEAD)
    kind_of = (
        F.when((section == "judul") & (F.col("fresh") | F.col("field") | turn), F.col("title_type"))
        .when(section.isin(FLAT) & F.col("head"), "section_header")
        .when(section.isin(FLAT) & (F.col("item") | numbered), "item")
        .when((section == "penetapan") & (line.rlike(fixed.MEMUTUSKAN) | line.rlike(fixed.MENETAPKAN) | first), "penetapan")
        .when(section.isin(BODY) & ev.isin("bab", "bagian", "paragraf", "pasal", "ayat", "diktum"), ev)
        .when(F.col("closing") & (F.col("fresh") | line.rlike(fixed.CLOSING)), "paragraf_isi")
        .when((section == "narasi") & numbered, "item")
        .when((section == "narasi") & (F.col("fresh") | first), "paragraf_isi")
        .when(section.isin("penjelasan_umum", "lampiran") & (head | F.col("fresh") | first), "paragraf_isi")
    )
    d = d.withColumn("node_type", kind_of)
    labelled = lambda mark: F.concat(mark, F.when(F.col("content") != "", F.concat(F.lit(" "), F.col("content"))).otherwise(""))
    opens = F.col("node_type").isNotNull()
    piece = (
        F.when(opens & F.col("node_type").isin("bab", "bagian", "paragraf"), F.col("m.title"))
        .when(opens & (F.col("node_type") == "pasal"), "")
        .when(opens & F.col("node_type").isin("ayat", "diktum"), F.col("content"))
        .when(opens & (F.col("node_type") == "item"), F.when(numbered, F.col("m.text")).otherwise(line))
        .when(opens & (section == "penjelasan_umum") & head, F.regexp_extract(line, HEAD, 2))
        .when(F.col("fold_huruf"), labelled(F.concat(F.col("label"), F.lit("."))))
        .when(F.col("fold_angka"), labelled(F.concat(F.lit("("), F.col("label"), F.lit(")"))))
        .otherwise(line)
    )
    between = F.when(F.col("fold_huruf") | F.col("fold_angka"), "\n").otherwise(" ")
    return d.withColumn("piece", piece).withColumn("between", between).withColumn("node_no", F.sum(opens.cast("long")).over(upto()))


def node_lines(segment_lines: DataFrame) -> DataFrame:
    """Every line with text with its registers, node number and piece."""
    return _opened(_registers(_events(_prepared(segment_lines))))


def nodes(segment_lines: DataFrame) -> DataFrame:
    """(doc_id, node_idx, doc_order, section, node_type, labels..., content, start_page, end_page, orphan, flags).

    Empty labels are null. orphan is text that stood before a section's first node: kept on that node, or on the last
    where the first is a closing one. doc_order steps by 1000 in section order."""
    d = node_lines(segment_lines)
    bodied = F.col("section").isin(BODY) & ~F.col("closing")
    section = F.when(F.col("closing"), "penutup").otherwise(F.col("section"))
    keep = lambda c: F.when(bodied, F.nullif(F.col(c), F.lit(""))).alias(c)
    item = F.when(F.col("node_type") == "item", F.col("m.label"))
    numbered = lambda kind: F.when((F.col("node_type") == "item") & (F.col("m.kind") == kind), item)
    opening = F.struct("idx", "sub", section.alias("section"), "node_type", *[keep(c) for c in ("bab", "bagian", "paragraf", "pasal", "ayat", "diktum")], numbered("huruf").alias("huruf"), numbered("angka").alias("angka"))
    folded = F.aggregate(F.sort_array(F.collect_list(F.struct("idx", "sub", "between", "piece"))), F.lit(""), lambda a, x: F.when(x["piece"] == "", a).when(a == "", x["piece"]).otherwise(F.concat(a, x["between"], x["piece"])))
    # only lines before the first node are loose; those of other nodes are not gathered a second time
    loose = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("node_no") == 0, F.struct("idx", "sub", "text")))), lambda x: x["text"]), "\n")
    made = d.groupBy("doc_id", "seg", "node_no").agg(F.min(opening).alias("o"), folded.alias("content"), loose.alias("loose"), F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    whole = Window.partitionBy("doc_id", "seg")
    before = F.max(F.when(F.col("node_no") == 0, F.col("loose"))).over(whole)
    first = F.max(F.when(F.col("node_no") == 1, F.col("o.section"))).over(whole)
    last = F.max("node_no").over(whole)
    holder = F.when(first == "penutup", last).otherwise(F.lit(1))
    made = made.withColumn("orphan", F.when(F.col("node_no") == holder, before)).where("node_no > 0")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "node_no"))
    kind, sec = F.col("o.node_type"), F.col("o.section")
    return made.select(
        "doc_id", (at - 1).cast("long").alias("node_idx"), (at * STEP).cast("long").alias("doc_order"), sec.alias("section"), kind.alias("node_type"),
        "o.bab", "o.bagian", "o.paragraf", "o.pasal", "o.ayat", "o.diktum", "o.huruf", "o.angka", "content", "start_page", "end_page", "orphan",
        (kind.isin("pasal", "ayat", "diktum") & (sec == "batang_tubuh")).alias("is_dictum"),
        (kind.isin("judul", "pembukaan", "penetapan", "bab", "bagian", "paragraf", "section_header") | ((kind == "paragraf_isi") & (sec == "penutup"))).alias("is_title"),
        (sec == "lampiran").alias("is_appendix"),
    )


def loose_lines(segment_lines: DataFrame) -> DataFrame:
    """(doc_id, section, text) of sections in which no line opens a node."""
    d = node_lines(segment_lines).withColumn("most", F.max("node_no").over(by_segment())).where("most = 0")
    return d.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "sub", "text"))), lambda x: x["text"]), "\n").alias("text"))


def parents(nodes: DataFrame, compat: bool = False) -> DataFrame:
    """nodes with parent_idx, the nearest open ancestor of the same run of a section (null: none), own label and path, the
    indexes from the root to the node.

    A paragraf hangs under its bagian or bab; with compat under the paragraf before it (without path)."""
    order = Window.partitionBy("doc_id").orderBy("node_idx")
    turned = F.coalesce(F.lag("section").over(order) != F.col("section"), F.lit(True))
    d = nodes.withColumn("_part", F.sum(turned.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("doc_id", "_part").orderBy("node_idx").rowsBetween(Window.unboundedPreceding, -1)
    kind, at, none = F.col("node_type"), F.col("node_idx"), F.lit(-1).cast("long")

    def last(kind_of: str, *cleared: str) -> Column:
        return F.nullif(F.last(F.when(kind == kind_of, at).when(kind.isin(*cleared), none) if cleared else F.when(kind == kind_of, at), ignorenulls=True).over(earlier), none)

    bab, bagian = last("bab"), last("bagian", "bab")
    paragraf, pasal = last("paragraf", "bab", "bagian"), last("pasal", "bab", "bagian", "paragraf")
    over = F.coalesce(bagian, bab)
    parent = F.when(kind == "bagian", bab).when(kind == "paragraf", F.coalesce(paragraf, over) if compat else over).when(kind == "pasal", F.coalesce(paragraf, over)).when(kind == "ayat", pasal)
    own = F.when(kind == "bab", F.col("bab")).when(kind == "bagian", F.col("bagian")).when(kind == "paragraf", F.col("paragraf")).when(kind == "pasal", F.col("pasal")).when(kind == "ayat", F.col("ayat")).when(kind == "diktum", F.col("diktum"))
    d = d.withColumns({"parent_idx": parent, "label": own})
    if not compat:
        open_ = [F.when(kind.isin("bagian", "paragraf", "pasal", "ayat"), bab), F.when(kind.isin("paragraf", "pasal", "ayat"), bagian), F.when(kind.isin("pasal", "ayat"), paragraf), F.when(kind == "ayat", pasal)]
        d = d.withColumn("path", F.when(F.col("parent_idx").isNull(), F.array(at)).otherwise(F.array_compact(F.array(*open_, at))))
    return d.drop("_part")
