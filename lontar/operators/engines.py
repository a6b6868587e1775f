"""Recognition engines, PDF readers and language models as pluggable functions, and what is done with their answers.

An engine is a Python callable that is sent to the executors and called for each row of an Arrow batch; it may hold a
model that is loaded when it is first called (see once()). Where answers were recorded, recorded() joins them instead.
What comes back is worked on as Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lontar.functions import fixed, identity
from lontar.functions import text as tx

from . import images
from .recognition import answer

#: Letters that make a text layer a text; tokens an engine may write for a page; its language.
LAYER_LETTERS, PAGE_TOKENS, LANGUAGE = 3, 2048, "ind"
#: Bytes kept of the fields of an answer.
WIDE, LONG, NARROW, REASON = 120, 500, 60, 300

_MADE: dict[int, object] = {}


def once(make: Callable[[], object], key: int = 0) -> object:
    """What make() gives, made once in each worker process: for models that take long to load."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def read_texts(rows: DataFrame, column: str, engine: Callable[..., str | None], *arguments: str, strict: bool = False) -> DataFrame:
    """rows with text: what the engine reads from a column (and the further argument columns). A row on which the engine
    fails has an empty text; with strict the job fails."""
    schema = StructType([*rows.schema.fields, StructField("text", StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(*values):
            try:
                return engine(*values) or ""
            except Exception:
                if strict:
                    raise
                return ""

        for part in parts:
            yield part.assign(text=[one(*v) for v in part[[column, *arguments]].itertuples(index=False)])

    return rows.mapInPandas(run, schema)


def recognise(pages: DataFrame, engine: Callable[[bytes, int, int], tuple[str, bool]], max_tokens: int = PAGE_TOKENS) -> DataFrame:
    """pages (document_id, page_number, image, ink_ratio, width, height, full_area) as stored pages: (document_id,
    page_number, ocr_text, is_empty, is_truncated, ink_ratio, cropped_pct, notes).

    engine(image, max_tokens, attempt) gives a text and whether it was cut off. Blank pages are not read. An empty text
    is asked for once more. Runs of tokens and lines are cut, and texts that mostly repeat themselves are noted."""
    schema = "document_id long, page_number int, ink_ratio double, cropped_pct double, raw string, attempts int, cut_first boolean, cut_again boolean"
    columns = [f.split()[0] for f in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p in part.itertuples(index=False):
                text, attempts, first, again = "", 0, False, False
                if p.ink_ratio >= images.BLANK:
                    (text, first), attempts = engine(p.image, max_tokens, 1), 1
                    if not (text or "").strip():
                        (text, again), attempts = engine(p.image, max_tokens, 2), 2
                area = p.full_area
                cropped = 100 - p.width * p.height * 100 / area if area and area > 0 else 0.0
                rows.append((p.document_id, p.page_number, p.ink_ratio, cropped, text or "", attempts, bool(first), bool(again)))
            yield pd.DataFrame(rows, columns=columns).astype({"page_number": "int32", "attempts": "int32"})

    asked = pages.select("document_id", "page_number", "image", "ink_ratio", "width", "height", "full_area").mapInPandas(run, schema)
    blank, read = F.col("attempts") == 0, tx.strip(F.col("raw")) != ""
    notes = F.array_compact(
        F.array(
            F.when(blank, F.lit("halaman kosong (tanpa teks) — OCR dilewati")), F.when(F.col("cut_first"), F.lit("keluaran OCR terpotong (batas token) — teks halaman mungkin tidak lengkap")),
            F.when((F.col("attempts") == 1) & degenerate_text(F.col("raw")), F.lit("keluaran OCR didominasi pengulangan — perlu ditinjau")), F.when(F.col("cut_again"), F.lit("keluaran OCR terpotong pada percobaan kedua")),
            F.when((F.col("attempts") == 2) & ~read, F.lit("OCR menghasilkan teks kosong (2 percobaan)")),
        )
    )
    trimmed = (removed_lines(F.col("raw")) > 0) | degenerate_text(F.col("raw"))
    text = F.when(F.coalesce(trimmed, F.lit(False)), clean_text(F.col("raw"))).otherwise(F.col("raw"))
    return asked.select("document_id", "page_number", text.alias("ocr_text"), blank.alias("is_empty"), (F.col("cut_first") | F.col("cut_again")).alias("is_truncated"), "ink_ratio", "cropped_pct", notes.alias("notes"))


def clean_text(raw: Column) -> Column:
    """A recognised text with runs of tokens cut, and, of equal lines in a row, at most three left; blank lines end a run."""
    kept = F.transform(tx.clamp_lines(F.split(raw, "\n", -1)), lambda x: x["text"])
    return F.when(tx.strip(raw) == "", raw).otherwise(F.array_join(kept, "\n"))


def cleaned(raw: Column) -> Column:
    """struct(text, removed) of clean_text() and removed_lines(), which reads the text once."""
    count = lambda c: F.size(F.split(c, "\n", -1))
    return tx.let(clean_text(raw), lambda t: F.struct(t.alias("text"), F.when(tx.strip(raw) == "", 0).otherwise(count(raw) - count(t)).alias("removed")))


def removed_lines(raw: Column) -> Column:
    """How many lines clean_text() takes out."""
    count = lambda c: F.size(F.split(c, "\n", -1))
    return F.when(tx.strip(raw) == "", 0).otherwise(count(raw) - count(clean_text(raw)))


def degenerate_text(raw: Column) -> Column:
    """Whether a page's text is mostly one token, has very few different ones or says one line over and over. For texts
    of a page; recognition.degenerate() counts with groups and is for long ones."""
    tokens = F.filter(F.split(raw, r"\s+"), lambda t: t != "")
    lines = F.transform(F.split(raw, "\n", -1), tx.strip)
    said = F.filter(lines, lambda x: x != "")
    n = F.size(tokens)
    most = lambda a: F.coalesce(F.array_max(F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)))), F.lit(0))
    odd = (most(tokens) / n > 0.5) | (F.size(F.array_distinct(tokens)) / n < 0.05) | ((F.size(lines) >= 20) & (most(said) > 15))
    return (n >= fixed.MIN_TOKENS) & odd


def page_source(layer: Column, other: Column, tier: Column, ink: Column, cheap: Column) -> Column:
    """Where a page's text comes from: the first text layer with some letters, else nothing for a blank page, else the
    vision model for appendices or where the cheap engine is missing, else the cheap engine."""
    some = lambda c: F.length(tx.strip(F.coalesce(c, F.lit("")))) >= LAYER_LETTERS
    return F.when(some(layer), "pdftotext").when(some(other), "mupdf").when(images.is_blank(ink), "blank").when((tier == "lampiran") | ~cheap, "vision").otherwise("tesseract")


def layer_pages(layers: DataFrame, engine: str) -> DataFrame:
    """(document_id, page_number, text) of an elected text layer as stored pages with their notes."""
    empty = tx.strip(F.coalesce("text", F.lit(""))) == ""
    note = F.when(empty, "halaman kosong pada lapisan teks PDF").otherwise(f"diambil dari lapisan teks PDF ({engine}) — tidak di-OCR; lihat documents.text_source")
    return layers.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("ocr_text"), empty.alias("is_empty"), F.array(note).alias("notes"))


def ask(rows: DataFrame, column: str, model: Callable[[str], str]) -> DataFrame:
    """rows with raw: the model's answer to a column."""
    schema = StructType([*rows.schema.fields, StructField("raw", StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(raw=[model(t or "") for t in part[column]])

    return rows.mapInPandas(run, schema)


def recorded(rows: DataFrame, answers: DataFrame, *keys: str) -> DataFrame:
    """rows with raw from recorded answers (keys, raw), null where there is none."""
    return rows.join(answers.select(*keys, "raw"), list(keys), "left")


def _field(a: Column, name: str, most: int) -> Column:
    return F.coalesce(tx.let(tx.cut(a[name], most), tx.placeholder), F.lit(""))


def gate_answer(raw: Column) -> Column:
    """struct(ok, reason) of the answer whether a page is of a legal document; null for an answer without JSON."""
    told = lambda a: F.when(a.isNotNull(), F.struct(F.coalesce(a["produk_hukum"], F.lit(False)).alias("ok"), F.coalesce(tx.cut(a["alasan"], REASON), F.lit("")).alias("reason")))
    return tx.let(answer(raw, "produk_hukum boolean, alasan string"), told)


def identity_answer(raw: Column) -> Column:
    """struct of the identity that a model read, with its area, number and year worked out; null without JSON."""

    def fields(a: Column) -> Column:
        return F.when(a.isNotNull(), F.struct(*[_field(a, f, n).alias(f) for f, n in (("jenis", WIDE), ("instansi_tertulis", WIDE), ("nomor", NARROW), ("tentang", LONG))], tx.cut(a["tahun"], 4).alias("tahun")))

    def told(f: Column) -> Column:
        return F.when(f.isNotNull(), F.struct(
            f["jenis"].alias("jenis"), f["instansi_tertulis"].alias("instansi_tertulis"), identity.area(f["instansi_tertulis"]).alias("wilayah"), f["nomor"].alias("nomor"), tx.first_number(f["nomor"]).alias("nomor_urut"),
            F.coalesce(tx.year_or_empty(f["tahun"]), F.lit("")).alias("tahun"), f["tentang"].alias("tentang"),
        ))

    # the answer is decoded once, and so is each field cut
    return tx.let(tx.let(answer(raw, "jenis string, instansi_tertulis string, nomor string, tahun string, tentang string"), fields), told)


#: Fields of the signing block and the bytes kept of each.
SIGNING = {"ditetapkan_di": WIDE, "ditetapkan_tanggal": NARROW, "ditetapkan_oleh": WIDE, "ditetapkan_oleh_nama": WIDE, "diundangkan_di": WIDE, "diundangkan_tanggal": NARROW, "diundangkan_oleh": WIDE, "diundangkan_oleh_nama": WIDE}


def signing_answer(raw: Column) -> Column:
    """struct of the eight fields of a signing block that a model read; null without JSON."""
    fields = lambda a: F.when(a.isNotNull(), F.struct(*[_field(a, f, n).alias(f) for f, n in SIGNING.items()]))
    return tx.let(answer(raw, ", ".join(f"{f} string" for f in SIGNING)), fields)


def merged_signing(certain: Column, model: Column) -> Column:
    """The signing block read by rule, filled up from the model's."""
    both = F.struct(certain.alias("certain"), model.alias("model"))
    return tx.let(both, lambda b: F.struct(*[F.coalesce(tx.prefer(b["certain"][f], b["model"][f]), F.lit("")).alias(f) for f in SIGNING]))


def review_answer(raw: Column) -> Column:
    """struct(problem, explanation) of a review; null without JSON. It never changes what was reviewed."""
    told = lambda a: F.when(a.isNotNull(), F.struct(F.coalesce(a["bermasalah"], F.lit(False)).alias("problem"), F.coalesce(tx.cut(a["penjelasan"], LONG), F.lit("")).alias("explanation")))
    return tx.let(answer(raw, "bermasalah boolean, penjelasan string"), told)


def fetched(responses: DataFrame, followed: DataFrame) -> DataFrame:
    """(url, outcome, link) of responses (url, content_type, body): pdf, via_link where a page's first link gives one in
    followed (url, content_type, body), else link_not_pdf, no_link, not_pdf or no_url. Bodies stay where they are."""
    from lontar.functions import urls

    kind = urls.sniff(F.col("content_type"), F.col("body"))
    link = F.when(kind == "html", urls.pdf_link(F.col("body"), F.col("url"))).otherwise("")
    first = responses.select("url", F.when(tx.strip(F.coalesce("url", F.lit(""))) == "", "none").otherwise(kind).alias("kind"), link.alias("link"))
    then = followed.groupBy(F.col("url").alias("link")).agg(F.max(urls.sniff(F.col("content_type"), F.col("body")) == "pdf").alias("got"))
    outcome = F.when(F.col("kind") == "none", "no_url").when(F.col("kind") == "pdf", "pdf").when(F.col("kind") != "html", "not_pdf").when(F.col("link") == "", "no_link").when(F.coalesce("got", F.lit(False)), "via_link").otherwise("link_not_pdf")
    return first.join(then, "link", "left").select("url", outcome.alias("outcome"), "link")
