"""Word lists, constants and patterns that results depend on. Patterns hold in Java and RE2 alike."""

# Structural lines.
BAB = r"^BAB\s+([IVXLCDM]+|[0-9]+)\b\s*(.*)$"
PARAGRAF = r"^(?i:paragraf)\s+([0-9]+)\b\s*(.*)$"
PASAL = r"^(?i:pasal)\s+([0-9]+\s*[A-Za-z]?|[IVXLCDM]+)\s*$"
AYAT = r"^\(\s*([0-9]+\s*[a-zA-Z]?)\s*\)\s*(.*)$"
BAGIAN = r"^(?i:bagian)\s+(.+?)\s*$"
HURUF = r"^([a-z]{1,2}|[A-Z])\.\s+(.*)$"
ANGKA = r"^([0-9]+)[.\)]\s+(.*)$"
DIKTUM = r"^([A-Za-z]+(?:\s+[A-Za-z]+)?)\s*(?::\s*(.*))?$"
#: Ordinal words and their numbers.
ORDINALS = {
    "kesatu": "1", "pertama": "1", "kedua": "2", "ketiga": "3", "keempat": "4", "kelima": "5", "keenam": "6", "ketujuh": "7",
    "kedelapan": "8", "kesembilan": "9", "kesepuluh": "10", "kesebelas": "11", "kedua belas": "12", "ketiga belas": "13",
    "keempat belas": "14", "kelima belas": "15", "keenam belas": "16", "ketujuh belas": "17", "kedelapan belas": "18",
    "kesembilan belas": "19", "kedua puluh": "20",
}
# Section anchors.
MENIMBANG = r"(?im)^\s*Menimbang\s*:?"
MENGINGAT = r"(?im)^\s*Mengingat\s*:?"
MEMPERHATIKAN = r"(?im)^\s*Memperhatikan\s*:?"
MEMUTUSKAN = r"(?im)^\s*MEMUTUSKAN\s*:?"
MENETAPKAN = r"(?im)^\s*Menetapkan\s*:"
PENJELASAN = r"(?im)^\s*PENJELASAN\b"
PASAL_DEMI = r"(?im)^\s*(?:I{1,3}\.\s*)?PASAL\s+DEMI\s+PASAL\b"
UMUM = r"(?im)^\s*(?:I\.\s*)?UMUM\s*$"
LAMPIRAN = r"(?m)^\s*LAMPIRAN\b"
PASAL_ANYWHERE = r"(?im)^\s*Pasal\s+(?:[0-9]+|[IVXLCDM]+)\b"
BAB_ANYWHERE = r"(?im)^\s*BAB\s+[IVXLCDM]+\b"
TITLE_ANYWHERE = r"(?i)(UNDANG-UNDANG|PERATURAN DAERAH|PERATURAN KEPALA DAERAH|PERATURAN DESA|PERATURAN LEMBAGA NEGARA|PERATURAN PEMERINTAH|PERATURAN PRESIDEN|PERATURAN MENTERI|PERATURAN GUBERNUR|PERATURAN BUPATI|PERATURAN WALI ?KOTA|QANUN)\b[\s\S]{0,80}?\bNOMOR\b"
#: Any of RECITALS, tried at once.
RECITAL = r"(?im)^\s*(?:Me(?:nimbang|ngingat|mperhatikan|mutuskan|netapkan\s*:))"
RECITALS = [MENIMBANG, MENGINGAT, MEMPERHATIKAN, MEMUTUSKAN, MENETAPKAN]
YEAR = r"^(1[89]|20)[0-9]{2}$"
DIKTUM_ANYWHERE = r"(?im)^\s*(KESATU|KEDUA|KETIGA)\s*:"
CLOSING = r"(?i)^(ditetapkan\s+di|diundangkan\s+di|agar\s+setiap\s+orang|lembaran\s+(negara|daerah)\b|tambahan\s+lembaran|berita\s+(negara|daerah)\b|tambahan\s+berita)"
# Page furniture.
PAGE_NUMBER = r"^[-–—\s]*\d{1,4}[-–—\s]*$"
PAGE_LABEL = r"(?i)^(halaman|hlm|page)\s*\.?\s*\d+"
RULE_LINE = r"^[-_=.·•\s]{3,}$"
WATERMARK = r"(?i)^\s*(https?://|www\.)?[a-z0-9.-]*\.(go\.id|ac\.id|co\.id|or\.id)\S*\s*$"
CATCHWORD = r"(?i)^.{0,40}\.\.\.\s*/\s*\d{1,4}\s*$"
# Repairs of recognised text.
CODE_FENCE = r"^`{3,}[a-zA-Z]*$"
HEADING = r"^#{1,6}\s+"
BOLD = r"(\*\*|__)(.+?)(\*\*|__)"
TABLE_RULE = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$"
VERSE_ONE = r"^\(\s*[lIi]\s*\)"
VERSE_MIXED = r"^\((\s*[0-9lIi]+\s*[a-zA-Z]?\s*)\)"
#: Words that a misread section anchor is drawn to, in order of preference.
ANCHORS = ["MENIMBANG", "MENGINGAT", "MEMUTUSKAN", "MENETAPKAN", "MEMPERHATIKAN", "PENJELASAN"]
# Boilerplate needs 3 pages and this share of them; a boundary line needs 6 bytes.
MIN_PAGES, MIN_OVERLAP = 3, 6
# Repeated output of recognition.
MAX_LINE_RUN, MAX_TOKEN_RUN, MIN_TOKENS = 3, 4, 40
# Comparison of two extractions.
TRUSTED = 0.95
# Lint.
AMENDMENT = r"(?i)PERUBAHAN\s+(?:KEDUA\s+|KETIGA\s+|KEEMPAT\s+)?ATAS\b"
ANCHOR_LEAK = r"\b(LAMPIRAN|MEMUTUSKAN|MENIMBANG|MENGINGAT)\b|(Memperhatikan|Menetapkan)\s*:"
# Citations.
REVOKES = r"(?i)\b(dicabut|tidak berlaku|dinyatakan tidak berlaku|mencabut)\b"
AMENDS = r"(?i)\b(diubah|perubahan atas|perubahan kedua atas|perubahan ketiga atas|mengubah)\b"
TITLE_TAIL = r"(?i)\s+(dicabut|diubah|dinyatakan|sebagaimana|menjadi|dihapus|mulai berlaku|dan dinyatakan|sebagai berikut)\b.*$"
# URLs.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "PHPSESSID", "phpsessid", "sessionid", "_ga"]
HOST_SUFFIXES = [".go.id", ".ac.id", ".co.id", ".or.id", ".id", ".com", ".net", ".org"]
HREF_PDF = r"""(?i)href="([^"]+\.pdf(?:\?[^"]*)?)\""""
#: Areas known by name.
AREAS = [
    "NASIONAL", "PEMERINTAH ACEH", "KABUPATEN ACEH BARAT", "KABUPATEN ACEH BARAT DAYA", "KABUPATEN ACEH BESAR",
    "KABUPATEN ACEH JAYA", "KABUPATEN ACEH SELATAN", "KABUPATEN ACEH SINGKIL", "KABUPATEN ACEH TAMIANG",
    "KABUPATEN ACEH TENGAH", "KABUPATEN ACEH TENGGARA", "KABUPATEN ACEH TIMUR", "KABUPATEN ACEH UTARA",
    "KABUPATEN BENER MERIAH", "KABUPATEN BIREUEN", "KABUPATEN GAYO LUES", "KABUPATEN NAGAN RAYA", "KABUPATEN PIDIE",
    "KABUPATEN PIDIE JAYA", "KABUPATEN SIMEULUE", "KOTA BANDA ACEH", "KOTA LANGSA", "KOTA LHOKSEUMAWE", "KOTA SABANG",
    "KOTA SUBULUSSALAM",
]
#: Kinds of regulation.
KINDS = [
    "UNDANG-UNDANG", "PERATURAN PEMERINTAH PENGGANTI UNDANG-UNDANG", "PERATURAN PEMERINTAH", "PERATURAN PRESIDEN",
    "PERATURAN MENTERI", "QANUN", "PERATURAN GUBERNUR", "PERATURAN BUPATI", "PERATURAN WALI KOTA",
    "PERATURAN KEPALA DAERAH", "PERATURAN DPRA", "PERATURAN DPRK", "KEPUTUSAN PRESIDEN", "KEPUTUSAN MENTERI",
    "KEPUTUSAN GUBERNUR", "KEPUTUSAN BUPATI", "KEPUTUSAN WALI KOTA", "KEPUTUSAN DPRA", "KEPUTUSAN DPRK",
    "KEPUTUSAN PIMPINAN DPRA", "KEPUTUSAN PIMPINAN DPRK", "INSTRUKSI PRESIDEN", "INSTRUKSI MENTERI",
    "INSTRUKSI GUBERNUR", "INSTRUKSI BUPATI", "INSTRUKSI WALI KOTA", "SURAT EDARAN MENTERI", "SURAT EDARAN GUBERNUR",
    "SURAT EDARAN BUPATI", "SURAT EDARAN WALI KOTA", "SURAT EDARAN",
]


def ordinal_pattern() -> str:
    """The ordinal words, longer ones first, at the start of a text in any case."""
    return "(?i)^(" + "|".join(sorted(ORDINALS, key=lambda w: (-len(w), w))) + ")"
