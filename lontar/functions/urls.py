"""URL functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import strip

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, tracking parameters dropped, the others sorted by key (equal keys in
    their order). Values of unreserved letters stay as they are."""
    u = strip(url)
    part = lambda n: F.regexp_extract(u, _PARTS, n)
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(fixed.TRACKING))
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p"))))
    query = F.array_join(F.transform(keyed, lambda x: x["p"]), "&")
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise("")
    host = F.when(part(2) != "", F.concat(F.lit("//"), F.lower(part(2)))).otherwise("")
    return F.concat(scheme, host, part(3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def sanitize(c: Column) -> Column:
    """A name for files: other characters than letters, digits and ._- become one _, none at the ends, at most 120
    characters, dokumen if nothing is left."""
    edge = r"^[._-]+|[._-]+$"
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), r"[^\p{L}\p{N}._-]+", "_"), "_{2,}", "_"), edge, "")
    t = F.when(F.length(t) > 120, F.regexp_replace(F.substring(t, 1, 120), edge, "")).otherwise(t)
    return F.when(t == "", "dokumen").otherwise(t)


def source_code(endpoint: Column) -> Column:
    """Short code of an endpoint: host without www., jdih. and one known suffix, dots as _, and an unusual port."""
    authority = F.regexp_extract(endpoint, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^([^:]*)", 1))
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    host = F.when(host == "", F.lower(endpoint)).otherwise(host)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^jdih\.", "")
    suffix = "(" + "|".join(s.replace(".", r"\.") for s in fixed.HOST_SUFFIXES) + ")$"
    host = F.replace(F.regexp_replace(host, suffix, ""), F.lit("."), F.lit("_"))
    host = F.when(strip(host) == "", "sumber").otherwise(host)
    return sanitize(F.concat(host, F.when((port == "") | port.isin("80", "443"), "").otherwise(F.concat(F.lit("_"), port))))


def pdf_link(html: Column, base: Column) -> Column:
    """First link to a PDF in a page, made absolute against the origin of base; empty without."""
    link = F.regexp_extract(html, fixed.HREF_PDF, 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(link == "", "").when(link.rlike("^https?://"), link).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(origin, F.lit("/"), link))


def sniff(content_type: Column, body: Column) -> Column:
    """pdf, html or other, by magic bytes and content type."""
    start, kind = F.lower(F.ltrim(F.substring(body, 1, 512))), F.lower(content_type)
    return F.when(body.startswith("%PDF"), "pdf").when(kind.contains("html") | start.startswith("<!doctype html") | start.startswith("<html"), "html").otherwise("other")


def retry(status: Column, attempt: Column, most: int = 3) -> Column:
    """What to do after a response: ok, wait and try again, or fail; a null status is a broken connection."""
    again = status.isNull() | (status >= 500) | (status == 429)
    return F.when(status.between(200, 299), "ok").when(again & (attempt <= most), "retry").otherwise("fail")


def file_name(content: Column) -> Column:
    return F.concat(F.sha2(content, 256), F.lit(".pdf"))
