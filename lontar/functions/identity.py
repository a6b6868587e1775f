"""Identity of a regulation from its first page, and the signing block, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import first_number, identity_key, let, squeeze, strip, tidy

#: Kinds as a pattern, in the order they are tried, and the identity patterns.
KIND = (
    r"UNDANG-UNDANG|PERATURAN\s+PEMERINTAH\s+PENGGANTI\s+UNDANG-UNDANG|PERATURAN\s+PEMERINTAH|PERATURAN\s+PRESIDEN|PERATURAN\s+MENTERI|PERATURAN\s+DAERAH|"
    r"PERATURAN\s+GUBERNUR|PERATURAN\s+BUPATI|PERATURAN\s+WALI\s*KOTA|PERATURAN\s+KEPALA\s+DAERAH|PERATURAN\s+DESA|PERATURAN\s+DPRA|PERATURAN\s+DPRK|"
    r"KEPUTUSAN\s+PRESIDEN|KEPUTUSAN\s+MENTERI|KEPUTUSAN\s+GUBERNUR|KEPUTUSAN\s+BUPATI|KEPUTUSAN\s+WALI\s*KOTA|KEPUTUSAN\s+PIMPINAN\s+DPRA|"
    r"KEPUTUSAN\s+PIMPINAN\s+DPRK|KEPUTUSAN\s+DPRA|KEPUTUSAN\s+DPRK|INSTRUKSI\s+PRESIDEN|INSTRUKSI\s+MENTERI|INSTRUKSI\s+GUBERNUR|INSTRUKSI\s+BUPATI|"
    r"INSTRUKSI\s+WALI\s*KOTA|SURAT\s+EDARAN\s+MENTERI|SURAT\s+EDARAN\s+GUBERNUR|SURAT\s+EDARAN\s+BUPATI|SURAT\s+EDARAN\s+WALI\s*KOTA|QANUN"
)
#: Kinds that know no area.
NATIONAL = ["UNDANG-UNDANG", "PERATURAN PEMERINTAH", "PERATURAN PEMERINTAH PENGGANTI UNDANG-UNDANG"]
DATED = rf"(?is)({KIND})(?:\s+([A-Z][A-Z\s]*?))?\s*NOMOR\s+([0-9][0-9A-Za-z./\s-]*?)\s+TAHUN\s+([0-9]{{4}})\s+TENTANG\s+(.+)"
UNDATED = rf"(?is)({KIND})(?:\s+([A-Z][A-Z\s]*?))?\s*NOMOR\s+([0-9][0-9A-Za-z./\s-]*?)\s+TENTANG\s+(.+)"
OFFICE = r"(?im)^(GUBERNUR|BUPATI|WALI\s*KOTA|PRESIDEN|MENTERI|PIMPINAN\s+DPRA|PIMPINAN\s+DPRK|DPRA|DPRK)\s+([A-Z][A-Z\s]*?)\s*,\s*$"
YEAR = r"(?:1[89]|20)[0-9]{2}"
COUNCIL, COUNCIL_LOCAL = r"(?i)DEWAN\s+PERWAKILAN\s+RAKYAT\s+ACEH\b", r"(?i)DEWAN\s+PERWAKILAN\s+RAKYAT\s+(?:KABUPATEN|KOTA)\b"
SIGNED = r"(?i)ditetapkan\s+di\s*:?\s*([A-Za-z][A-Za-z\s.']{1,40}?)\s*\n\s*pada\s+tanggal\s*[:,]?\s*([0-9]{1,2}\s+\p{L}+\s+[0-9]{4})"
PROMULGATED = r"(?i)diundangkan\s+di\s*:?\s*([A-Za-z][A-Za-z\s.']{1,40}?)\s*\n\s*pada\s+tanggal\s*[:,]?\s*([0-9]{1,2}\s+\p{L}+\s+[0-9]{4})"
SIGNER = r"(?m)^\s*((?:GUBERNUR|BUPATI|WALI\s*KOTA|SEKRETARIS\s+DAERAH|PJ\.?\s+GUBERNUR|PENJABAT\s+GUBERNUR)[A-Z\s.]*),\s*$"


def header(page: Column) -> Column:
    """struct(found, jenis, instansi, nomor, tahun, tentang, struktur, before_2011) of a first page. Only what stands
    before Menimbang counts; pages without it give nothing."""
    opened = page.rlike(fixed.MENIMBANG)
    head = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, rf"(?s){fixed.MENIMBANG}.*", ""), COUNCIL, "DPRA"), COUNCIL_LOCAL, "DPRK")
    # each value is worked out once, and those of patterns that do not count not at all
    return let(F.struct(opened.alias("opened"), F.when(opened, head).otherwise(F.when(page.isNotNull(), "")).alias("raw")), _head)


def _head(p: Column) -> Column:
    raw, opened = p["raw"], p["opened"]
    form = F.when(opened & raw.rlike(DATED), 1).when(opened & raw.rlike(UNDATED), 2).when(opened & raw.rlike(OFFICE), 3).otherwise(0)

    def taken(form: Column) -> Column:
        take = lambda a, b, c=F.lit(""): F.when(form == 1, F.regexp_extract(raw, DATED, a) if a else F.lit("")).when(form == 2, F.regexp_extract(raw, UNDATED, b) if b else F.lit("")).when(form == 3, c).otherwise("")
        year = F.when(form == 1, F.regexp_extract(raw, DATED, 4))
        title = strip(F.array_join(F.transform(F.split(F.regexp_replace(take(5, 4), r"(?s)\r?\n\s*\r?\n.*", ""), "\n"), strip), " "))
        return F.struct(form.alias("form"), take(1, 1).alias("jenis"), take(2, 2, F.regexp_extract(raw, OFFICE, 2)).alias("instansi"), strip(take(3, 3)).alias("nomor"), year.alias("tahun"), title.alias("tentang"))

    def told(t: Column) -> Column:
        year = F.coalesce(t["tahun"], F.try_element_at(F.regexp_extract_all(t["nomor"], F.lit(YEAR), F.lit(0)), F.lit(-1)), F.lit(""))
        kind = F.when(raw.rlike(fixed.DIKTUM_ANYWHERE), "diktum").when(raw.rlike(fixed.PASAL_ANYWHERE), "pasal_ayat").otherwise("unknown")
        return let(year, lambda y: F.struct(
            (t["form"] > 0).alias("found"), squeeze(t["jenis"]).alias("jenis"), squeeze(t["instansi"]).alias("instansi"), t["nomor"].alias("nomor"), y.alias("tahun"),
            t["tentang"].alias("tentang"), F.when(opened, kind).otherwise("").alias("struktur"), F.coalesce(F.nullif(y, F.lit("")).try_cast("int").between(1, 2010), F.lit(False)).alias("before_2011"),
        ))

    return let(form, lambda f: let(taken(f), told))


def _province(name: Column) -> Column:
    return let(tidy(name), lambda n: F.when(n.contains("ACEH") & ~n.startswith("KABUPATEN ") & ~n.startswith("KOTA "), "PEMERINTAH ACEH").when(n == "", "").otherwise(F.concat(F.lit("PROVINSI "), n)))


def _local(name: Column) -> Column:
    return let(name, _known_local)


def _known_local(name: Column) -> Column:
    district, city = F.concat(F.lit("KABUPATEN "), name), F.concat(F.lit("KOTA "), name)
    return F.when(name.isin(fixed.AREAS), name).when(district.isin(fixed.AREAS), district).when(city.isin(fixed.AREAS), city).otherwise(district)


def area(written: Column) -> Column:
    """Canonical area of an office or area as written."""
    return let(tidy(written), _area)


def _area(s: Column) -> Column:
    rest = lambda p: tidy(F.regexp_extract(s, p, 1))
    rules = [
        (r"^(?:PRESIDEN|MENTERI)\b", lambda p: F.lit("NASIONAL")), (r"^(?:PIMPINAN )?DPRA$", lambda p: F.lit("PEMERINTAH ACEH")), (r"^(?:PIMPINAN )?DPRK (.+)$", lambda p: _local(rest(p))),
        (r"^GUBERNUR (.+)$", lambda p: _province(rest(p))), (r"^BUPATI (.+)$", lambda p: F.concat(F.lit("KABUPATEN "), rest(p))), (r"^WALI ?KOTA (.+)$", lambda p: F.concat(F.lit("KOTA "), rest(p))),
        (r"^KABUPATEN (.+)$", lambda p: F.concat(F.lit("KABUPATEN "), rest(p))), (r"^KOTA (.+)$", lambda p: F.concat(F.lit("KOTA "), rest(p))), (r"^PRO[VP]INSI (.+)$", lambda p: _province(rest(p))),
    ]
    out = F.when(s == "", "")
    for pattern, value in rules:
        out = out.when(s.rlike(pattern), value(pattern))
    return out.otherwise(_province(s))


def area_of_kind(jenis: Column, instansi: Column) -> Column:
    """Canonical area of a regulation, by the office its kind ends with: after an office stands only the name of its
    area. Acts and government regulations are national; kinds without an office name the area themselves."""
    return let(F.struct(jenis.alias("jenis"), tidy(instansi).alias("name")), lambda x: _area_of_kind(x["jenis"], x["name"]))


def _area_of_kind(jenis: Column, name: Column) -> Column:
    out = F.when(jenis.isin(NATIONAL), "NASIONAL")
    for office, value in (
        ("DPRA", F.lit("PEMERINTAH ACEH")), ("DPRK", _local(name)), ("GUBERNUR", _province(name)), ("BUPATI", F.concat(F.lit("KABUPATEN "), name)), ("WALI KOTA", F.concat(F.lit("KOTA "), name)),
        ("PRESIDEN", F.lit("NASIONAL")), ("MENTERI", F.lit("NASIONAL")),
    ):
        out = out.when(jenis.endswith(office), value)
    return out.otherwise(area(name))


def kind(written: Column) -> Column:
    return F.replace(squeeze(F.upper(written)), F.lit("WALIKOTA"), F.lit("WALI KOTA"))


def identity(page: Column) -> Column:
    """struct(jenis, wilayah, nomor, nomor_urut, tahun, tentang, canonical_key, accepted): accepted if kind and area are
    known and number, year and title are there."""

    def told(x: Column) -> Column:
        k, a, h = x["k"], x["a"], x["h"]
        whole = k.isin(fixed.KINDS) & a.isin(fixed.AREAS) & (h["nomor"] != "") & (h["tahun"] != "") & (h["tentang"] != "")
        return F.struct(k.alias("jenis"), a.alias("wilayah"), h["nomor"].alias("nomor"), first_number(h["nomor"]).alias("nomor_urut"), h["tahun"].alias("tahun"), h["tentang"].alias("tentang"), identity_key(k, a, h["nomor"], h["tahun"]).alias("canonical_key"), whole.alias("accepted"))

    named = lambda h: let(kind(h["jenis"]), lambda k: F.struct(k.alias("k"), area_of_kind(k, h["instansi"]).alias("a"), h.alias("h")))
    return let(let(header(page), named), told)


def signing(page: Column) -> Column:
    """struct of place, date, office and name of enactment and promulgation, marked and needs_model. A name is the first
    line within six after the office that is neither blank nor the mark of a signature, if it looks like a name."""
    return let(page, lambda p: let(_blocks(p), _signed))


def _blocks(page: Column) -> Column:
    """struct(signed, promulgated, offices, names, enacted, announced): what signing() is told from, each once."""
    at = lambda p, n: squeeze(F.regexp_replace(F.regexp_extract(page, p, n), r"^[ \t\r\n,.:]+|[ \t\r\n,.:]+$", ""))
    names = F.transform(F.slice(F.split(page, SIGNER), 2, 2), lambda t: F.get(F.filter(F.slice(F.transform(F.split(t, "\n"), strip), 1, 6), lambda b: (b != "") & ~b.rlike(r"(?i)^ttd\.?$")), F.lit(0)))
    looks = lambda n: n.rlike(r"^[A-Z][A-Z.'\s]{2,60}[A-Z.]$") & ~n.rlike(r"(?i)^(salinan|tembusan|distribusi)\b")
    enacted, announced = page.rlike(r"(?i)ditetapkan\s+di"), page.rlike(r"(?i)diundangkan\s+di")
    return F.struct(
        F.struct(at(SIGNED, 1).alias("place"), at(SIGNED, 2).alias("date")).alias("signed"), F.struct(at(PROMULGATED, 1).alias("place"), at(PROMULGATED, 2).alias("date")).alias("promulgated"),
        F.transform(F.regexp_extract_all(page, F.lit(SIGNER), F.lit(1)), tidy).alias("offices"), F.transform(names, lambda n: F.coalesce(F.when(looks(n), tidy(n)), F.lit(""))).alias("names"), enacted.alias("enacted"), announced.alias("announced"),
    )


def _signed(b: Column) -> Column:
    of = lambda name, i: F.coalesce(F.get(b[name], F.lit(i)), F.lit(""))
    bare = lambda block, name: (block["place"] == "") | (block["date"] == "") | (name == "")
    needs = (b["enacted"] & bare(b["signed"], of("names", 0))) | (b["announced"] & bare(b["promulgated"], of("names", 1)))
    return F.struct(
        b["signed"]["place"].alias("ditetapkan_di"), b["signed"]["date"].alias("ditetapkan_tanggal"), of("offices", 0).alias("ditetapkan_oleh"), of("names", 0).alias("ditetapkan_nama"),
        b["promulgated"]["place"].alias("diundangkan_di"), b["promulgated"]["date"].alias("diundangkan_tanggal"), of("offices", 1).alias("diundangkan_oleh"), of("names", 1).alias("diundangkan_nama"),
        (b["enacted"] | b["announced"]).alias("marked"), needs.alias("needs_model"),
    )


def decide(accepted: Column, gate: Column, recital: Column, waiting: Column, known: Column) -> Column:
    """What becomes of a document after a page: identity read without a model is accepted; a page that the gate turns
    down and that has no recital anchor waits for the next one or, after the window, is rejected; a model's identity is
    accepted if kind and area are known or a recital anchor vouches for the page."""
    turned_down = ~F.coalesce(gate, F.lit(False)) & ~recital
    return F.when(accepted, "accepted").when(turned_down & waiting, "next_page").when(turned_down, "rejected").when(F.coalesce(known, F.lit(False)) | recital, "accepted_by_model").otherwise("rejected")
