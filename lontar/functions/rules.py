"""Rules of single lines for the Arrow batches of operators.parse: what functions.text says of a line as Columns, told
here of a Python string. Patterns are those of `fixed`; letters, digits and spaces in them are ASCII."""

from __future__ import annotations

import re
from functools import lru_cache

from . import fixed
from .text import _SPACE, ORDINAL_LETTERS

#: Codes of the kinds of a line.
KINDS = ["none", "bab", "bagian", "paragraf", "pasal", "ayat", "diktum", "huruf", "angka"]
CODE = {k: i for i, k in enumerate(KINDS)}
#: A numbered head of explanations and appendices, a verse in words, lines of a title.
HEAD, VERSE_WORD = r"^([IVXLCDM]+|[A-Z])\.\s+(.+)$", r"^(?i:ayat)\s*\(\s*([0-9]+\s*[a-zA-Z]?)\s*\)\s*(.*)$"
FIELD_LINE = r"(?i)^(NOMOR\b|TENTANG$)"
#: Bits of what is told of a line.
_NAMES = ["FIRM", "FURNITURE", "BLANK", "MENIMBANG", "MENGINGAT", "MEMPERHATIKAN", "MEMUTUSKAN", "MENETAPKAN", "PENJELASAN", "UMUM", "PASAL_DEMI", "ARTICLE", "LAMPIRAN", "CLOSING", "VERSE", "HEAD", "FIELD", "GREETING"]
BIT = {name: 1 << i for i, name in enumerate(_NAMES)}
_RE = {name: re.compile(getattr(fixed, name), re.ASCII) for name in dir(fixed) if name.isupper() and isinstance(getattr(fixed, name), str)}
_RE |= {"HEAD_LINE": re.compile(HEAD, re.ASCII), "VERSE_WORD": re.compile(VERSE_WORD, re.ASCII), "FIELD_LINE": re.compile(FIELD_LINE, re.ASCII)}
_ORDINAL, _BEHIND = re.compile(fixed.ordinal_pattern(), re.ASCII), re.compile(r"^[^:]*:(.*)$", re.ASCII)
_WIDE, _WORD, _ALONE = re.compile(r"[ \t]{2,}"), re.compile(r"^[ \t]*([A-Za-z]+)"), re.compile(r"^[ \t]*[A-Za-z]{4,}[ \t]*(:.*)?$")
_MISREAD = str.maketrans("lIO", "110")


def _verse(plain: str) -> str:
    if _RE["VERSE_ONE"].search(plain):
        return _RE["VERSE_ONE"].sub("(1)", plain)
    m = _RE["VERSE_MIXED"].search(plain)
    if not m:
        return plain
    inner = m[1].strip(_SPACE)
    head, tail = inner[:-1], inner[-1:]
    kept = tail and tail in "lIO" and any("0" <= x <= "9" for x in head)
    return f"({head.translate(_MISREAD)}{tail if kept else tail.translate(_MISREAD)}){plain[m.end():]}"


@lru_cache(1 << 16)
def _near(word: str) -> str | None:
    """The anchor that a word in capitals is a misreading of."""
    best = None
    for i, a in enumerate(fixed.ANCHORS):
        row = list(range(len(a) + 1))
        for n, x in enumerate(word, 1):
            before, row[0] = row[0], n
            for j, y in enumerate(a, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        best = min(best or (row[-1], i), (row[-1], i))
    a = fixed.ANCHORS[best[1]]
    return a if 1 <= best[0] <= (2 if len(a) >= 10 else 1) else None


def fixed_line(raw: str) -> str:
    """fix_line of text."""
    t = raw.strip(_SPACE)
    if "  " in t or "\t" in t:
        t = _WIDE.sub(" ", t)
    plain = _RE["HEADING"].sub("", t) if t.startswith("#") else t
    if "**" in t or "__" in t:
        plain = _RE["BOLD"].sub(r"\2", plain)
    plain = plain.strip(_SPACE)
    if (t.startswith("```") and _RE["CODE_FENCE"].search(t)) or ("--" in t and _RE["TABLE_RULE"].search(t)):
        plain = ""
    elif plain.startswith("("):
        plain = _verse(plain)
    return plain


def repaired(raw: str) -> str:
    """fix_line and fix_anchor of text."""
    plain = fixed_line(raw)
    if _ALONE.search(plain):
        m = _WORD.search(plain)
        if len(m[1]) <= 15 and (a := _near(m[1].upper())):  # the longest anchor has 13 letters
            plain = plain[: m.start(1)] + a + plain[m.end(1) :]
    return plain


def _ordinal(t: str) -> str:
    m = _ORDINAL.search(t.strip(_SPACE))
    return fixed.ORDINALS[m[1].lower()] if m else ""


def structural(c: str) -> tuple[str, str, str, str]:
    """kind, label, title and text of a line."""
    first = c[:1]
    if first == "B" and (m := _RE["BAB"].search(c)):
        return "bab", m[1].strip(_SPACE).upper(), m[2].strip(_SPACE), ""
    if first in ("P", "p"):
        if m := _RE["PARAGRAF"].search(c):
            return "paragraf", m[1], m[2].strip(_SPACE), ""
        if m := _RE["PASAL"].search(c):
            return "pasal", m[1].replace(" ", "").upper(), "", ""
    if first == "(" and (m := _RE["AYAT"].search(c)):
        return "ayat", m[1].replace(" ", "").lower(), "", m[2].strip(_SPACE)
    if first in ("B", "b") and (m := _RE["BAGIAN"].search(c)):
        bagian = m[1].strip(_SPACE)
        if label := _ordinal(bagian):
            return "bagian", label, _ORDINAL.sub("", bagian).strip(_SPACE), ""
    if "." in c[1:3] and (m := _RE["HURUF"].search(c)):
        return "huruf", m[1].lower(), "", m[2].strip(_SPACE)
    if first and first in "0123456789" and (m := _RE["ANGKA"].search(c)):
        return "angka", m[1], "", m[2].strip(_SPACE)
    if first and first in ORDINAL_LETTERS and (m := _RE["DIKTUM"].search(c)) and _ordinal(m[1]):
        return "diktum", m[1].strip(_SPACE).upper(), "", (m[2] or "").strip(_SPACE)
    return "none", "", "", ""


_BY_LETTER = {
    "M": ["MENIMBANG", "MENGINGAT", "MEMPERHATIKAN", "MEMUTUSKAN", "MENETAPKAN"], "P": ["PENJELASAN", "PASAL_DEMI", "ARTICLE"], "I": ["UMUM", "PASAL_DEMI"], "U": ["UMUM"], "L": ["LAMPIRAN", "CLOSING"],
    "D": ["CLOSING"], "A": ["CLOSING", "VERSE"], "T": ["CLOSING", "FIELD"], "B": ["CLOSING"], "N": ["FIELD"],
}
_PATTERN = {"ARTICLE": "PASAL_ANYWHERE", "VERSE": "VERSE_WORD", "FIELD": "FIELD_LINE"}
_TRIED = {k: [(BIT[n], _RE[_PATTERN.get(n, n)]) for n in names] for k, names in _BY_LETTER.items()}
_TRIED |= {k.lower(): v for k, v in _TRIED.items()}
_SPARED = BIT["MENIMBANG"] | BIT["MENGINGAT"] | BIT["MEMUTUSKAN"] | BIT["PENJELASAN"]


def _furniture(c: str, firm: bool) -> bool:
    first = c[0]
    return bool(
        (first in "-–—0123456789" and _RE["PAGE_NUMBER"].search(c))
        or (first in "HhPp" and _RE["PAGE_LABEL"].search(c))
        or (first in "-_=.·•" and _RE["RULE_LINE"].search(c))
        or (".id" in c.lower() and _RE["WATERMARK"].search(c))
        or (not firm and "..." in c and _RE["CATCHWORD"].search(c))
    )


def told(c: str) -> tuple[str, int, str, str, str, int]:
    """(text, code of its kind, label, title, rest, bits) of a repaired line."""
    if c == "":
        return "", 0, "", "", "", BIT["BLANK"]
    kind, label, title, rest = structural(c)
    bits = 0
    for bit, pattern in _TRIED.get(c[0], ()):
        if pattern.search(c):
            bits |= bit
    if kind != "none" or bits & _SPARED:
        bits |= BIT["FIRM"]
    if _furniture(c, bool(bits & BIT["FIRM"])):
        bits |= BIT["FURNITURE"]
    if "A" <= c[0] <= "Z" and "." in c and _RE["HEAD_LINE"].search(c):
        bits |= BIT["HEAD"]
    upper = c.upper()
    if upper.startswith("DENGAN ") or "RAHMAT TUHAN" in upper or ("PRESIDEN" in upper and "REPUBLIK INDONESIA" in upper and len(c.encode()) < 60):
        bits |= BIT["GREETING"]
    return c, CODE[kind], label, title, rest, bits


def behind(c: str) -> str:
    """What stands behind the colon of a line."""
    m = _BEHIND.search(c)
    return m[1].strip(_SPACE) if m else ""


def verse_in_words(c: str) -> tuple[str, str]:
    """Label and text of a verse in words."""
    m = _RE["VERSE_WORD"].search(c)
    return m[1].replace(" ", "").lower(), m[2].strip(_SPACE)


def head_text(c: str) -> str:
    """What stands behind a numbered head."""
    return _RE["HEAD_LINE"].search(c)[2]


def has_dictum(raw: str) -> bool:
    """has_dictum of text."""
    return any(structural(fixed_line(x))[0] == "diktum" for x in raw.split("\n"))
