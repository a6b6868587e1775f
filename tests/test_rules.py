"""Rules of lines, sections, nodes and records on hand-written cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lontar.functions import identity, text, urls
from lontar.operators import citations, images, lines, lint, nodes, recognition, records, segments
from lontar.sources import listing, settings
from lontar.streaming import queue


def parsed(spark, *pages):
    df = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(pages)], "doc_id long, page int, text string")
    return segments.bounds(lines.stitch(lines.explode_pages(df)))


def made(spark, *pages):
    return nodes.nodes(segments.segment_lines(parsed(spark, *pages))).orderBy("node_idx").collect()


def texts(spark, *pages):
    df = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(pages)], "doc_id long, page int, text string")
    return [r.text for r in lines.stitch(lines.explode_pages(df)).orderBy("idx").collect()]


def one(spark, expression, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expression(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "line, kind, label",
    [
        ("Pasal I", "pasal", "I"), ("Pasal 27 A", "pasal", "27A"), ("pasal 3 ayat (2)", "none", ""), ("BAB IV PENUTUP", "bab", "IV"), ("(1a) isi", "ayat", "1a"), ("Bagian Kedua Belas Tugas", "bagian", "12"),
        ("Bagian ini berlaku", "none", ""), ("a. butir", "huruf", "a"), ("12) butir", "angka", "12"), ("KEDUA : isi", "diktum", "KEDUA"), ("Kesatuan Republik", "diktum", "KESATUAN REPUBLIK"), ("Paragraf 2 Umum", "paragraf", "2"),
    ],
)
def test_structural(spark, line, kind, label):
    m = one(spark, text.structural, line)
    assert (m.kind, m.label) == (kind, label)


@pytest.mark.parametrize("line, want", [("( l ) isi", "(1) isi"), ("(lO) x", "(10) x"), ("(1l) x", "(1l) x"), ("**tebal**", "tebal"), ("## Judul", "Judul"), ("```", ""), ("|---|---|", ""), ("  a  b ", "a b")])
def test_fix_line(spark, line, want):
    assert one(spark, text.fix_line, line) == want


@pytest.mark.parametrize("line, want", [("MENINBANG :", "MENIMBANG :"), ("MEMUTUSKAAN:", "MEMUTUSKAN:"), ("Menimbang hal", "Menimbang hal"), ("MENI :", "MENI :")])
def test_fix_anchor(spark, line, want):
    assert one(spark, text.fix_anchor, line) == want


def test_page_boundaries(spark):
    assert texts(spark, "Satu\nKEDUA : .../2", "KEDUA : isi penuh") == ["Satu", "KEDUA : isi penuh"]
    assert texts(spark, "awal\nKetentuan berla", "Ketentuan berlaku umum") == ["awal", "Ketentuan berlaku umum"]
    assert texts(spark, "kop\na1", "kop\na2", "kop\na3") == ["a1", "a2", "a3"]
    assert texts(spark, "a\n\n- 5 -\n\nb\n\n") == ["a", "", "b"]


def test_sections(spark):
    found = {r.section: (r.start, r.end) for r in segments.segments(parsed(spark, "QANUN\nMenimbang : x\nMengingat : y\nMEMUTUSKAN:\nMenetapkan : QANUN\nTENTANG HAL\n\nPasal 1\nIsi.\nLAMPIRAN\ndaftar")).collect()}
    assert found == {"judul": (0, 1), "menimbang": (1, 2), "mengingat": (2, 3), "penetapan": (3, 6), "batang_tubuh": (6, 9), "lampiran": (9, 11)}
    assert [r.section for r in segments.segments(parsed(spark, "Lampiran I dalam Peraturan\nkalimat")).collect()] == ["narasi"]


def test_body(spark):
    body = [n for n in made(spark, "Menimbang : x\nMEMUTUSKAN:\nMenetapkan : Y\n\nsisa\nBAB I UMUM\nPasal 1\nIsi\nlanjut\n(1) ayat satu\na. butir\n1. rinci\nPasal 2\nDitetapkan di Banda Aceh\npada tanggal") if n.section in ("batang_tubuh", "penutup")]
    assert [(n.node_type, n.content) for n in body] == [("bab", "UMUM"), ("pasal", "Isi lanjut"), ("ayat", "ayat satu\na. butir\n(1) rinci"), ("pasal", ""), ("paragraf_isi", "Ditetapkan di Banda Aceh pada tanggal")]
    assert body[0].orphan == "sisa" and body[2].bab == "BAB I" and body[2].pasal == "1" and body[4].pasal is None
    order = [n.doc_order for n in body]
    assert order == sorted(order)


def test_lint(spark):
    df = spark.createDataFrame(made(spark, "Menimbang : x\nMEMUTUSKAN:\nMenetapkan : Y\n\nPasal 1\n(1) a\n(3) b MENIMBANG c\nPasal 4\nPasal 5\nisi\nPENJELASAN\nPASAL DEMI PASAL\nPasal 9\nJelas"), "doc_id long, node_idx long, doc_order long, section string, node_type string, bab string, bagian string, paragraf string, pasal string, ayat string, diktum string, huruf string, angka string, content string, start_page long, end_page long, orphan string, is_dictum boolean, is_title boolean, is_appendix boolean")
    assert [r.missing for r in lint.article_gaps(df).collect()] == ["2, 3"]
    assert [(r.pasal, r.missing) for r in lint.verse_gaps(df).collect()] == [("1", "2")]
    assert [r.pasal for r in lint.unknown_articles(df).collect()] == ["9"]
    assert [r.pasal for r in lint.empty_articles(df).collect()] == ["4"]
    assert [r.found for r in lint.leaks(df).collect()] == ["MENIMBANG"]
    up = {r.node_idx: r.parent_idx for r in nodes.parents(df).collect()}
    assert all(p is None or p < i for i, p in up.items())


def test_citations(spark):
    df = spark.createDataFrame([(1, 1000, "mengingat", "Undang-Undang Nomor 11 Tahun 2006 tentang Pemerintahan Aceh;"), (1, 2000, "batang_tubuh", "Qanun Nomor 3 Tahun 2001 tentang Masa Berlaku Izin dicabut."), (1, 3000, "penjelasan_umum", "Undang-Undang Nomor 11 Tahun 2006")], "doc_id long, doc_order long, section string, content string")
    found = citations.relations(citations.citations(df)).orderBy("doc_order").collect()
    assert [(r.type, r.key, r.tentang) for r in found] == [("dasar_hukum", "undang_undang|11|2006", "Pemerintahan Aceh"), ("mencabut", "qanun|3|2001", "Masa Berlaku Izin")]


def test_identity(spark):
    page = "QANUN ACEH\nNOMOR 11/2013\nTENTANG\nKEHUTANAN\nDAN HUTAN\n\nMenimbang : Qanun Nomor 1 Tahun 1999"
    found = one(spark, identity.identity, page)
    assert (found.jenis, found.wilayah, found.nomor, found.tahun, found.tentang, found.accepted) == ("QANUN", "PEMERINTAH ACEH", "11/2013", "2013", "KEHUTANAN DAN HUTAN", True)
    signed = one(spark, identity.signing, "Ditetapkan di Banda Aceh\npada tanggal, 7 Januari 2026\nGUBERNUR ACEH,\n\nttd.\nNAMA PEJABAT")
    assert (signed.ditetapkan_di, signed.ditetapkan_tanggal, signed.ditetapkan_nama, signed.needs_model) == ("Banda Aceh", "7 Januari 2026", "NAMA PEJABAT", False)


def test_urls(spark):
    assert one(spark, urls.normalize_url, " HTTPS://Www.Example.go.id/A?b=2&utm_source=x&a=1#top ") == "https://www.example.go.id/A?a=1&b=2"
    assert one(spark, urls.source_code, "https://www.jdih.acehprov.go.id:8080/x") == "acehprov_8080"
    assert one(spark, urls.sanitize, " //a b// ") == "a_b"
    assert one(spark, urls.pdf_link, '<a href="/x/y.PDF?v=1">', "https://h/a/b") == "https://h/x/y.PDF?v=1"


def test_compare(spark):
    long = "kalimat yang sama " * 5
    assert one(spark, text.compare, long + "10", long + "11").trusted is False
    assert one(spark, text.compare, "", "").similarity == 1.0
    assert one(spark, text.clamp_tokens, "a b b b b b b c") == "a b b b b c"


def test_records(spark):
    assert [records.parse_range(t) for t in ("5-10", "10", "5-", "-10", "x", "9-3")] == [(5, 10), (10, 10), (5, 0), (0, 10), (0, 0), (0, 0)]
    docs = spark.createDataFrame([(1, "pending", 1, None), (2, "pending", 2, None)], "id long, status string, attempts int, reject_reason string")
    assert [(r.status, r.attempts, r.reject_reason) for r in records.failed(docs, "pending", "unduh_gagal").orderBy("id").collect()] == [("pending", 2, None), ("failed", 3, "unduh_gagal")]
    assert queue.advance("downloading", 2, "fail") == ("failed", 3) and queue.advance("parsing", 0, "interrupted") == ("ocr_done", 0)


def test_settings(tmp_path):
    f = tmp_path / "env"
    f.write_text("# c\nexport DATA_DIR='x y'\nPAGE_COUNT_ORDER=desc\n")
    got = settings.load(str(f), {"PAGE_COUNT_ORDER": "asc"})
    assert (got["DATA_DIR"], got["PAGE_COUNT_ORDER"], got["TESSERACT_LANG"]) == ("x y", "asc", "ind")


def test_listing(spark, tmp_path):
    f = tmp_path / "list.json"
    f.write_text('[{"urlDownload": "HTTP://A.id/x.pdf", "noPeraturan": "Nomor 7", "tahun_pengundangan": 2019}, {"judul": "tanpa"}]')
    found = listing.remote_documents(listing.open_source(spark, "integrasi", path=f"file://{f}")).collect()
    assert [tuple(r) for r in found] == [("http://a.id/x.pdf", 2019, 7)]
    with pytest.raises(ValueError):
        listing.open_source(spark, "other")


def test_images():
    import numpy as np

    grid = np.full((100, 100), 65535)
    grid[40:50, 40:60] = 0
    assert images.crop(grid) == (28, 62, 28, 72) and images.ink_ratio(grid) == 0.02 and images.blur_score(grid) > 0
    assert images.crop(np.full((10, 10), 0)) == (0, 10, 0, 10)


def test_recognition(spark):
    lines_ = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(["a"] * 6 + ["", "", "b"])], "doc_id long, page int, at int, text string")
    assert [r.text for r in recognition.clamp_lines(lines_).orderBy("at").collect()] == ["a", "a", "a", "", "", "b"]
    dumps = spark.createDataFrame([(1, 5, 3, "x\fy\f")], "doc_id long, from_page int, n_pages int, raw string")
    assert [(r.page, r.text) for r in recognition.form_feed_pages(dumps).orderBy("page").collect()] == [(5, "x"), (6, "y"), (7, "")]


def test_large_images_and_dirt():
    """Measures of large images by their definition, and crops that pass over dirt."""
    rnd = np.random.default_rng(3)
    for shape in ((640, 700), (641, 701), (650, 641), (8, 8), (3, 9), (2, 9)):
        g, step = rnd.integers(0, 65536, shape), 2 if shape[0] * shape[1] > 400_000 else 1
        f = g.astype(float)
        lap = [f[y - step, x] + f[y + step, x] + f[y, x - step] + f[y, x + step] - 4 * f[y, x] for y in range(step, shape[0] - step, step) for x in range(step, shape[1] - step, step)]
        want = float(np.var(lap)) if lap and min(shape) >= 3 else 0.0
        assert abs(images.blur_score(g) - want) <= 1e-9 * max(1.0, want)
    page = np.full((1000, 800), 65535)
    page[400:440, 300:500] = 0
    page[2, 3] = 0
    assert images.crop(page) == (388, 452, 288, 512)
    page[:200:7, 10:14] = 0
    assert images.crop(page)[0] == 0 and images.crop(page)[2] == 0
    dot = np.full((100, 100), 65535)
    dot[0, 0] = 0
    assert images.crop(dot) == (0, 100, 0, 100) and images.crop(np.full((30, 90), 0)) == (0, 30, 0, 90)


def test_area_of_kind(spark):
    for jenis, instansi, want in (("PERATURAN BUPATI", "Aceh Barat", "KABUPATEN ACEH BARAT"), ("KEPUTUSAN WALI KOTA", "BANDA ACEH", "KOTA BANDA ACEH"), ("UNDANG-UNDANG", "REPUBLIK INDONESIA", "NASIONAL"), ("PERATURAN DPRK", "LANGSA", "KOTA LANGSA"), ("QANUN", "ACEH", "PEMERINTAH ACEH"), ("QANUN", "KABUPATEN PIDIE", "KABUPATEN PIDIE")):
        assert one(spark, identity.area_of_kind, jenis, instansi) == want


def test_parse_is_written_once(spark):
    from lontar.operators import store

    documents = spark.createDataFrame([(1, "ocr_done", None, None)], "id long, status string, parse_status string, parsed_at timestamp")
    snapshots = spark.createDataFrame([], "document_id long, status string, report string, parsed_at timestamp")
    nodes = spark.createDataFrame([(1, 0, -1, "bab"), (1, 1, 0, "pasal")], "document_id long, node_idx long, parent_idx long, node_type string")
    flags = spark.createDataFrame([(1, 1, "parser_warning", "NODE_WARNING", "needs_review", "x"), (1, -1, "diagnose", "Y", "needs_review", "y")], "document_id long, node_idx long, source string, code string, severity string, message string")
    results = spark.createDataFrame([(1, "SUCCESS", "{}")], "document_id long, status string, report string")
    out = store.insert_parse(documents, snapshots, results, nodes, flags, F.current_timestamp())
    assert out["documents"].first().status == "parsed"
    ids = {r.node_type: (r.id, r.parent_id) for r in out["nodes"].collect()}
    assert ids["bab"][1] is None and ids["pasal"][1] == ids["bab"][0]
    assert {r.code: r.node_id for r in out["review_flags"].collect()} == {"NODE_WARNING": ids["pasal"][0], "Y": None}
    for again in ((out["parse_snapshots"], results), (snapshots, results.union(results))):
        with pytest.raises(ValueError):
            store.insert_parse(documents, again[0], again[1], nodes, flags, F.current_timestamp())


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    where, state, out = (f"file://{tmp_path}/{x}" for x in ("in", "state", "out"))
    spark.range(10).write.parquet(where)
    stream = spark.readStream.schema("id long").parquet(where)
    assert queue.drain(stream, out, state).count() == 10
    import shutil

    shutil.rmtree(tmp_path / "state" / "commits")
    assert queue.drain(stream, out, state).count() == 10
