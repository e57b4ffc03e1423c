"""URLs and HTML pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import squash

HIDDEN = r"(?is)<(script|style|nav|footer|header)\b[^>]*>.*?</\1\s*>"
ASSETS = r"\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|svg)$"


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation and tags; entities of the five usual characters read."""
    text = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), "(?s)<[^>]+>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"(?U)[\s ]+", " "))


def links(html: Column) -> Column:
    """Targets of a page's links in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1))


def absolute(link: Column, base: Column) -> Column:
    """A link as an absolute URL: full, scheme-less, of the host, or of the page's folder."""
    host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(?:/.*/|/)?)", 1)
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(host, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def canonical_url(url: Column) -> Column:
    """Scheme (https if none), lower-case host, path with single slashes and one at its end, query; no fragment."""
    plain = F.regexp_replace(url, "#.*$", "")
    part = lambda i: F.regexp_extract(plain, r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?]*))?([^?]*)(\?.*)?$", i)
    path = F.regexp_replace(F.concat(part(3), F.lit("/")), "/+", "/")
    return F.concat(F.when(part(1) == "", "https").otherwise(part(1)), F.lit("://"), F.lower(part(2)), path, part(4))


def url_path(url: Column) -> Column:
    """Path in lower case without a slash at its end."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", ""))


def in_scope(url: Column, host: str, allow: tuple[str, ...] = ("/",), deny: tuple[str, ...] = ()) -> Column:
    """Whether a URL is a page of the host below an allowed path, no denied one and no asset."""
    at = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    last = F.regexp_extract(F.lower(F.regexp_replace(path, "/+$", "")), r"([^/]*)$", 1)
    test = (at == host) & ~last.rlike(ASSETS) & (~last.contains(".") | last.rlike(r"\.html?$"))
    some = lambda prefixes: F.coalesce(*(F.when(path.startswith(p), True) for p in prefixes), F.lit(False)) if prefixes else F.lit(False)
    return test & some(allow) & ~some(deny)


def file_name(url: Column) -> Column:
    """Name of the file that a page is saved under."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1), "^/+|/+$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    base = F.regexp_replace(F.replace(F.when(path == "", "root").otherwise(path), F.lit("/"), F.lit("__")), "[^A-Za-z0-9._-]+", "_")
    return F.concat(base, F.when(query == "", "").otherwise(F.concat(F.lit("__q_"), F.substring(F.sha1(query.cast("binary")), 1, 8))))


def dedup_key(year: Column, code: Column, title: Column, url: Column) -> Column:
    """SHA-1 that names a course of a bulletin page."""
    path = F.trim(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    return F.sha1(F.concat_ws("|", F.trim(year), F.upper(squash(code)), F.upper(squash(title)), path).cast("binary"))
