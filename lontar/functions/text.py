"""Scalar functions on lines and texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import edits, fixed

#: White space, that of Unicode included.
_SPACE = "\t\n\x0b\f\r \x85\xa0"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it: as a Column alone it would be repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """White space off both ends, Unicode spaces included."""
    return F.btrim(c, F.lit(_SPACE))


def starts(c: Column, letters: str) -> Column:
    """Whether a text begins with one of these letters: told before a pattern is tried that could only match there."""
    return F.substring(c, 1, 1).isin(*letters)


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, ends stripped."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def fix_verse(inner: Column) -> Column:
    """Letters misread in a verse number: l and I to 1, O to 0, but for a last letter that follows a digit."""

    def fixed_up(t: Column) -> Column:
        head, tail = F.substring(t, F.lit(1), F.greatest(F.length(t) - 1, F.lit(0))), F.right(t, F.lit(1))
        kept = head.rlike("[0-9]") & tail.rlike("[lIO]")
        return F.concat(F.translate(head, "lIO", "110"), F.when(kept, tail).otherwise(F.translate(tail, "lIO", "110")))

    return let(strip(inner), fixed_up)


def fix_line(c: Column) -> Column:
    """A recognised line without outer space, markdown and misread verse numbers. Fences and table rules: empty."""

    def verse(plain: Column) -> Column:
        inner = F.regexp_extract(plain, fixed.VERSE_MIXED, 1)
        return (
            F.when(~plain.startswith("("), plain)
            .when(plain.rlike(fixed.VERSE_ONE), F.regexp_replace(plain, fixed.VERSE_ONE, "(1)"))
            .when(plain.rlike(fixed.VERSE_MIXED), F.concat(F.lit("("), fix_verse(inner), F.lit(")"), F.regexp_replace(plain, fixed.VERSE_MIXED, "")))
            .otherwise(plain)
        )

    def line(t: Column) -> Column:
        # most lines have nothing to repair, which is told without a pattern
        flat = F.when(t.startswith("#"), F.regexp_replace(t, fixed.HEADING, "")).otherwise(t)
        plain = strip(F.when(t.contains("**") | t.contains("__"), F.regexp_replace(flat, fixed.BOLD, "$2")).otherwise(flat))
        empty = (t.startswith("```") & t.rlike(fixed.CODE_FENCE)) | (t.contains("--") & t.rlike(fixed.TABLE_RULE))
        return F.when(empty, "").otherwise(F.when(starts(plain, "("), let(plain, verse)).otherwise(plain))

    spaced = strip(c)
    return let(F.when(spaced.contains("  ") | spaced.contains("\t"), F.regexp_replace(spaced, r"[ \t]{2,}", " ")).otherwise(spaced), line)


def fix_anchor(c: Column) -> Column:
    """A section anchor misread by one letter (two for words of ten or more) at the start of a line, alone or before a
    colon, is put right; the nearest anchor wins, then the earlier in the list."""

    def drawn(near: Column) -> Column:
        fits = (near["d"] >= 1) & (near["d"] <= F.when(F.length(near["a"]) >= 10, 2).otherwise(1))
        return F.when(fits, F.concat(F.regexp_extract(c, r"^([ \t]*)", 1), near["a"], F.regexp_replace(c, r"^[ \t]*[A-Za-z]+", ""))).otherwise(c)

    word = F.upper(F.regexp_extract(c, r"^[ \t]*([A-Za-z]+)", 1))
    near = let(word, lambda w: F.array_min(F.array(*[F.struct(F.levenshtein(w, F.lit(a)).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(fixed.ANCHORS)])))
    return F.when(c.rlike(r"^[ \t]*[A-Za-z]{4,}[ \t]*(:.*)?$"), let(near, drawn)).otherwise(c)


def ordinal(c: Column) -> Column:
    """Number of the ordinal word a text begins with, as text; empty without."""
    numbers = F.create_map(*[F.lit(x) for pair in fixed.ORDINALS.items() for x in pair])
    return F.coalesce(numbers[F.lower(F.regexp_extract(strip(c), fixed.ordinal_pattern(), 1))], F.lit(""))


#: Letters that ordinal words begin with.
ORDINAL_LETTERS = "".join(sorted({x for w in fixed.ORDINALS for x in (w[0], w[0].upper())}))


def structural(c: Column) -> Column:
    """struct(kind, label, title, text) of a stripped line; kind none if it is not structural."""
    none = F.lit("")

    def made(kind: str, label: Column, title: Column = none, text: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), title.alias("title"), text.alias("text"))

    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(c, pattern, n)

    close = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    bagian = strip(part(fixed.BAGIAN, 1))
    head = part(fixed.DIKTUM, 1)
    return (
        F.when(starts(c, "B") & c.rlike(fixed.BAB), made("bab", F.upper(strip(part(fixed.BAB, 1))), strip(part(fixed.BAB, 2))))
        .when(starts(c, "Pp") & c.rlike(fixed.PARAGRAF), made("paragraf", part(fixed.PARAGRAF, 1), strip(part(fixed.PARAGRAF, 2))))
        .when(starts(c, "Pp") & c.rlike(fixed.PASAL), made("pasal", F.upper(close(part(fixed.PASAL, 1)))))
        .when(starts(c, "(") & c.rlike(fixed.AYAT), made("ayat", F.lower(close(part(fixed.AYAT, 1))), text=strip(part(fixed.AYAT, 2))))
        .when(starts(c, "Bb") & c.rlike(fixed.BAGIAN) & (ordinal(bagian) != ""), made("bagian", ordinal(bagian), strip(F.regexp_replace(bagian, fixed.ordinal_pattern(), ""))))
        .when(F.substring(c, 2, 2).contains(".") & c.rlike(fixed.HURUF), made("huruf", F.lower(part(fixed.HURUF, 1)), text=strip(part(fixed.HURUF, 2))))
        .when(starts(c, "0123456789") & c.rlike(fixed.ANGKA), made("angka", part(fixed.ANGKA, 1), text=strip(part(fixed.ANGKA, 2))))
        .when(starts(c, ORDINAL_LETTERS) & c.rlike(fixed.DIKTUM) & (ordinal(head) != ""), made("diktum", F.upper(strip(head)), text=strip(part(fixed.DIKTUM, 2))))
        .otherwise(made("none", none))
    )


def looks_structural(c: Column, kind: Column) -> Column:
    """Whether boilerplate and boundary rules leave a line alone."""
    anchors = [fixed.MENIMBANG, fixed.MENGINGAT, fixed.MEMUTUSKAN, fixed.PENJELASAN]
    found = c.rlike(anchors[0])
    for a in anchors[1:]:
        found = found | c.rlike(a)
    return (kind != "none") | (starts(c, "MmPp") & found)


def furniture(c: Column, structural_line: Column) -> Column:
    """Page numbers, page labels, rules, site marks and catchwords of a stripped line."""
    number = starts(c, "-–—0123456789") & c.rlike(fixed.PAGE_NUMBER)
    label, rule = starts(c, "HhPp") & c.rlike(fixed.PAGE_LABEL), starts(c, "-_=.·•") & c.rlike(fixed.RULE_LINE)
    mark = F.lower(c).contains(".id") & c.rlike(fixed.WATERMARK)
    return number | label | rule | mark | (c.contains("...") & c.rlike(fixed.CATCHWORD) & ~structural_line)


def number_prefix(c: Column) -> Column:
    """Leading digits as a number, null without."""
    return F.nullif(F.regexp_extract(c, "^([0-9]+)", 1), F.lit("")).try_cast("int")


def first_number(c: Column) -> Column:
    """First run of digits as a number, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "[0-9]+", 0), F.lit("")).try_cast("int"), F.lit(0))


def sort_number(c: Column) -> Column:
    """First run of digits as a number above 0, else null."""
    return F.nullif(first_number(c), F.lit(0))


def _flat(c: Column) -> Column:
    return F.lower(squeeze(c))


def _same_digits(x: Column, y: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)) == F.regexp_extract_all(y, F.lit(r"(\d+)"), F.lit(1))


def compare(a: Column, b: Column) -> Column:
    """struct(similarity, digits_equal, trusted) of two extractions of a page: one minus the edit distance in letters
    over the longer length in bytes, of texts in lower case with single spaces; digit runs must agree in order."""

    def told(p: Column) -> Column:
        x, y = p["x"], p["y"]
        longest = F.greatest(F.octet_length(x), F.octet_length(y))
        similarity = F.when(longest == 0, 1.0).otherwise(1 - p["d"] / longest)
        return let(F.struct(similarity.alias("s"), _same_digits(x, y).alias("d")), lambda r: F.struct(r["s"].alias("similarity"), r["d"].alias("digits_equal"), ((r["s"] >= fixed.TRUSTED) & r["d"]).alias("trusted")))

    x, y = _flat(a), _flat(b)
    return let(F.struct(x.alias("x"), y.alias("y"), edits.distance(x, y).alias("d")), told)


def trusted(a: Column, b: Column) -> Column:
    """compare()'s trusted alone: the distance only of texts that are not the same and of which all else agrees."""
    far = lambda p: F.abs(F.length(p["x"]) - F.length(p["y"])) > F.greatest(F.octet_length(p["x"]), F.octet_length(p["y"])) * (1 - fixed.TRUSTED) + 1
    both = F.struct(_flat(a).alias("x"), _flat(b).alias("y"))
    asked = let(both, lambda p: F.when(_same_digits(p["x"], p["y"]) & (p["x"] != p["y"]) & ~far(p), p))

    def told(p: Column) -> Column:
        x, y = p["b"]["x"], p["b"]["y"]
        near = F.coalesce(1 - p["d"] / F.greatest(F.octet_length(x), F.octet_length(y)) >= fixed.TRUSTED, F.lit(False))
        return F.when(x.isNotNull() & y.isNotNull(), ((x == y) & _same_digits(x, y)) | near)

    return let(F.struct(both.alias("b"), edits.distance(asked["x"], asked["y"]).alias("d")), told)


#: Five equal tokens in a row or more, told without going back; and the same between single spaces, the first four apart.
_LONG_RUN = r"(?<!\S)(\S++)(?:\s++\1(?!\S)){4}+"
_REST_OF_RUN = r"(?<!\S)(\S++)((?: \1(?!\S)){3}+)(?: \1(?!\S))++"


def clamp_tokens(line: Column) -> Column:
    """At most four equal tokens in a row on lines of more than four; lines without such runs keep their spaces."""
    spaced = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(line.rlike(_LONG_RUN), F.regexp_replace(spaced, _REST_OF_RUN, "$1$2")).otherwise(line)


def clamp_lines(lines: Column) -> Column:
    """Array of (at, text) of an array of lines with token runs cut and, of equal lines in a row, at most three left; a
    blank line ends a run. A line goes if the three before it are the same, so none waits for another."""

    def kept(p: Column) -> Column:
        keys = p["keys"]
        before = lambda i, n: F.get(keys, i - n)
        again = lambda k, i: (k != "") & (k == before(i, 1)) & (k == before(i, 2)) & (k == before(i, 3))
        each = F.transform(p["lines"], lambda x, i: F.when(~F.coalesce(again(F.get(keys, i), i), F.lit(False)), F.struct(i.alias("at"), x.alias("text"))))
        return F.array_compact(each)

    return let(F.transform(lines, clamp_tokens), lambda x: let(F.struct(x.alias("lines"), F.transform(x, strip).alias("keys")), kept))


def tidy(c: Column) -> Column:
    """Upper case, single spaces, no spaces, commas or full stops at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(strip(c)), r"\s+", " "), r"^[ ,.]+|[ ,.]+$", "")


def placeholder(c: Column) -> Column:
    """Empty for an answer that only repeats a placeholder."""
    return F.when(c.rlike(r"^\s*(\.\.\.|<[^>]*>)\s*$"), "").otherwise(c)


def citation_key(kind: Column, number: Column, year: Column) -> Column:
    return F.concat_ws("|", F.replace(F.regexp_replace(F.lower(strip(kind)), r"\s+", "_"), F.lit("-"), F.lit("_")), F.lower(strip(number)), strip(year))


def identity_key(*parts: Column) -> Column:
    """Parts joined by a bar, null if any is empty."""
    whole = parts[0] != ""
    for p in parts[1:]:
        whole = whole & (p != "")
    return F.when(whole, F.concat_ws("|", *parts))


def cut(c: Column, most: int) -> Column:
    """Single spaces, and at most so many bytes; a letter cut in half is dropped."""
    whole = F.encode(squeeze(c), "UTF-8")
    return F.regexp_replace(F.decode(F.substring(whole, 1, most), "UTF-8"), "�+$", "")


def year_or_empty(c: Column) -> Column:
    """A year from 1800 to 2099, else empty."""
    return F.when(c.rlike(fixed.YEAR), c).otherwise("")


def prefer(a: Column, b: Column) -> Column:
    """The first value unless it is empty or null."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def has_article(c: Column) -> Column:
    return c.rlike(fixed.PASAL_ANYWHERE)


def has_recital(c: Column) -> Column:
    """Whether an anchor of the recitals or of the decision begins a line."""
    return c.rlike(fixed.RECITAL)


def has_explanation(c: Column) -> Column:
    return c.rlike(fixed.PENJELASAN)


def has_appendix(c: Column) -> Column:
    return c.rlike(fixed.LAMPIRAN)


def has_dictum(page: Column) -> Column:
    """Whether a line of a page, repaired, is an item of a decision."""
    # such an item begins with an ordinal word; marks of bold text may stand within it
    may = page.rlike("(?i)" + "|".join(w for w in fixed.ORDINALS if " " not in w)) | page.contains("**") | page.contains("__")
    found = F.exists(F.transform(F.split(page, "\n", -1), fix_line), lambda line: structural(line)["kind"] == "diktum")
    return F.when(may, found).otherwise(F.when(page.isNotNull(), False))


def looks_legal(pages: Column) -> Column:
    """A loose look at joined pages: an article, a chapter, an anchor, a title with a number or an item of a decision."""
    return has_article(pages) | pages.rlike(fixed.BAB_ANYWHERE) | has_recital(pages) | pages.rlike(fixed.TITLE_ANYWHERE) | has_dictum(pages)


def crop_note(percent: Column) -> Column:
    """What was cut off a page, in words; empty below one percent."""
    return F.when(percent < 1, "").otherwise(F.format_string(" · dipotong -%.0f%%", percent))


def duration(ms: Column) -> Column:
    """A duration to the second as 4s, 1m5s or 1h0m9s."""
    s = F.floor((ms + 500) / 1000)
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.concat(F.when(h > 0, F.concat(h, F.lit("h"))).otherwise(""), F.when(s >= 60, F.concat(m, F.lit("m"))).otherwise(""), rest.cast("string"), F.lit("s"))


def token_counts(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(token, documents, times): in how many documents each lower-case token of letters and digits is, and how often."""
    d = documents.select(key, F.explode(F.split(F.lower(column), r"[^\p{L}\p{N}]+")).alias("token")).where("token <> ''")
    return d.groupBy("token", key).count().groupBy("token").agg(F.count("*").alias("documents"), F.sum("count").alias("times"))
