"""Documents parsed in one pass: what the windows give step by step, in batches that cut anywhere, and dealt once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lontar.functions import rules, text
from lontar.operators import lines, lint, nodes, parse, parsed, segments, store, tree
from lontar.plans import catalog

ODD = [
    "QANUN ACEH", "NOMOR 3 TAHUN 2019", "TENTANG", "PERUBAHAN KEDUA ATAS HAL", "DENGAN RAHMAT TUHAN", "PRESIDEN REPUBLIK INDONESIA", "", "", " \t", "Menimbang : a. bahwa hal;", "menimbang", "MENINBANG :", "b. bahwa  ini;", "Mengingat : 1. Undang-Undang;", "2) lagi;",
    "Memperhatikan :", "MEMPERHATIKAN : KEDUA : isi", "MEMUTUSKAN:", "MEMUTUSKAAN :", "Menetapkan : QANUN", "menetapkan :", "BAB I UMUM", "BAB IV", "BAB 2", "BABAK baru", "Bagian Kesatu Umum", "Bagian Kedua Belas", "bagian ini", "Paragraf 1 Ruang", "paragraf 2",
    "Pasal 1", "Pasal 4", "pasal 27 A", "Pasal IX", "Pasal 99999999999", "Pasal 3 ayat (2)", "(1) satu", "( l ) satu", "(lO) x", "(3a) MENIMBANG lagi", "(1l) x", "()", "a. butir", "aa. butir", "A. Daftar", "1. rincian", "12) rincian", "KESATU : hal", "KEDUA", "Kesatuan Republik",
    "sambungan", "sambungan kalimat panjang", "sambungan kal", "Isi LAMPIRAN dan MEMUTUSKAN", "\"kutip\" \\ garis", "huruf é dan ß", "IV. Bab lain", "XXXVIII. Jauh", "Ayat (2) Cukup jelas.", "ayat ( 3 b )", "Cukup jelas.", "PENJELASAN", "Penjelasan", "PENJELASANNYA", "I. UMUM", "UMUM",
    "II. PASAL DEMI PASAL", "PASAL DEMI PASAL", "LAMPIRAN I", "Lampiran I", "LAMPIRANNYA", "Ditetapkan di Jantho", "DIUNDANGKAN DI Jantho", "Lembaran Daerah", "Agar setiap orang", "- 5 -", "12", "Halaman 3", "----", "***", "**tebal**", "## Judul", "```sql", "|---|---|", "www.jdih.go.id", "Pasal .../ 3",
    "kop surat", "kop surat", "kop surat", "berla", "berlaku", "BERLAKU SEJAK", None,
]


@pytest.fixture(scope="module")
def odd(spark):
    deal = random.Random(7)
    rows = []
    for d in range(300):
        page, kind = 1, d % 4
        for n in range(deal.choice([0, 1, 2, 5, 20, 60, 200])):
            page += deal.random() < 0.2
            rows.append((None if d == 299 else d, None if deal.random() < 0.01 else page, n * 2, deal.choice(ODD if kind else ODD[:55])))
    deal.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, page long, line_no long, text string").repartition(5, "line_no").cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(a.columns)
    want, got = ([repr(tuple(r)) for r in x.collect()] for x in (a, b))
    assert sorted(want) == sorted(got) and want


def stepwise(odd):
    return nodes.nodes(segments.segment_lines(segments.bounds(lines.stitch(odd))))


def test_rules(spark):
    tried = [x for x in ODD if x is not None]
    df = spark.createDataFrame([(x,) for x in tried], "x string").select("x", text.let(text.fix_line(F.col("x")), text.fix_anchor).alias("t")).select("x", "t", text.structural(F.col("t")).alias("m"))
    for r in df.select("x", "t", "m", text.looks_structural(F.col("t"), F.col("m.kind")).alias("firm"), text.furniture(F.col("t"), F.lit(False)).alias("furniture")).collect():
        assert rules.repaired(r.x) == r.t, r.x
        kind, label, title, rest = rules.structural(r.t)
        assert (kind, label, title, rest) == tuple(r.m), r.x
        bits = rules.told(r.t)[5]
        assert bool(bits & rules.BIT["FIRM"]) == r.firm, r.x
        assert bool(bits & rules.BIT["FURNITURE"]) == (r.furniture and not (r.firm and "..." in r.t)), r.x


def test_lines(odd):
    same(lines.stitch(odd).selectExpr("doc_id", "idx", "page", "line_no", "text", "m.kind", "m.label", "m.title", "m.text as rest"), parse.clean_lines(odd))
    same(lines.classified(odd).selectExpr("doc_id", "page", "line_no", "text", "m.kind", "m.label", "m.title", "m.text as rest"), parse.marked_lines(odd))
    same(lines.boilerplate(lines.classified(odd)).where("boiler").select("doc_id", "text", "on_pages", "n_pages").distinct(), parse.boilerplate(odd))
    same(store.gate(lines.stitch(odd)), parse.gate(odd))


def test_segments_and_nodes(odd):
    same(segments.segments(segments.bounds(lines.stitch(odd))).select("doc_id", "seg", "section", "start", "end"), parse.segments(odd))
    same(stepwise(odd), parse.nodes(odd))
    same(stepwise(odd).select("doc_id", "content"), parse.nodes(odd, "doc_id", "content"))


def test_trees(odd):
    made = nodes.parents(stepwise(odd)).cache()
    same(made.select("doc_id", "node_idx", "section", "node_type", "parent_idx", "label"), parsed.parents(odd))
    same(tree.outline(made), parsed.outline(odd))
    same(tree.nested(made), parsed.nested(odd))
    edited = made.withColumn("label", F.when(F.col("node_type") == "pasal", F.concat("label", F.lit("A"))).otherwise(F.col("label")))
    same(tree.cascade(edited, "pasal", "pasal").where("pasal is not null").select("doc_id", "node_idx", "node_type", "pasal"), parsed.cascade(odd, "pasal", lambda kind, label: label + "A" if kind == "pasal" else label))


def test_checks(odd):
    made, bounded = stepwise(odd).cache(), segments.bounds(lines.stitch(odd))
    for name in ("article_gaps", "verse_gaps", "unknown_articles", "empty_articles", "leaks", "statistics"):
        same(getattr(lint, name)(made), getattr(parsed, name)(odd))
    told = lint.issues(made, segments.section_warnings(bounded)).cache()
    same(told, parsed.issues(odd))
    same(lint.verdicts(made, segments.section_warnings(bounded)), parsed.verdicts(odd))
    same(store.review_flags(told, made), store.answered_flags(parsed.flags(odd).withColumn("answer", F.lit(None).cast("struct<about string, explanation string>"))))


@pytest.mark.parametrize("size", [1, 3, 50, 10**6])
def test_batches_cut_anywhere(monkeypatch, size):
    """Documents come out whole however lines are cut into batches."""
    monkeypatch.setattr(parse, "BATCH", size)
    docs = [["Pasal 1", "isi"] * n for n in (1, 0, 4, 2, 30, 1)]
    flat = [(d, 1, n, x) for d, held in enumerate(docs) for n, x in enumerate(held)]
    columns = [pa.array(v) for v in zip(*flat)]
    whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "line_no", "text"])
    cut = [whole.slice(i, 7) for i in range(0, whole.num_rows, 7)]
    listed = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([[{"page": 1, "text": x} for x in held] for held in docs])], ["doc_id", "lines"])
    for parts, nested in ((cut, False), ([listed.slice(0, 2), listed.slice(2)], True)):
        found = {}
        for c in parse._batches(iter(parts), nested):
            ids = c.ids.to_pylist()
            for d in np.unique(c.doc):
                assert ids[d] not in found
                found[ids[d]] = [c.texts[t] for t in c.text[c.doc == d]]
        assert found == {d: held for d, held in enumerate(docs) if held}


PLANNED = {
    "F1": "d01_issues", "F2": "d01_status", "F3": "d04_orphan_refs", "F5": "t03_cascade", "F6": "t06_tree_json", "F7": "t07_outline", "F8": "v01_flags", "F9": "w18_pasal_gap", "F10": "a03_statistics", "F11": "d03_ayat_gap", "F12": "d06_empty_pasal", "F14": "d05_anchor_leak",
    "F15": "j15_resolve", "F16": "r01_citations", "F17": "r03_relations", "F18": "t01_parents", "F19": "x02_segments", "F20": "x09_nodes", "F22": "x01_lines", "F25": "a02_boilerplate", "F27": "p06_gate", "F28": "f05_structural",
}


@pytest.mark.parametrize("finding", PLANNED)
def test_lines_are_not_dealt(spark, finding):
    """Orders and line numbers are dealt once by document, never their lines; nodes are not kept, and no window looks at lines."""
    df = catalog.QUERIES[PLANNED[finding]](spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "InMemoryRelation" not in plan
    below = plan[plan.index("MapInArrow") :]
    assert "Window" not in below and below.count("RepartitionByExpression") == 2


def test_page_marks(odd):
    """What is told of pages in batches is what the functions of text tell of them."""
    t = F.col("t")
    pages = odd.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    same(pages.select("doc_id", "page", (text.has_recital(t) | text.has_dictum(t)).alias("recital"), text.has_explanation(t).alias("explanation"), text.has_appendix(t).alias("appendix"), text.looks_legal(t).alias("looks_legal")), parse.page_marks(odd))
