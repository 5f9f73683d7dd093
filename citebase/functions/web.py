"""URL and HTML expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_title(html: Column) -> Column:
    """Text of the title element; null when absent or blank."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """Text outside script and style elements and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def hrefs(html: Column) -> Column:
    """Targets of the anchors in order, duplicates kept; quoted either way or not at all."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))


def host(url: Column) -> Column:
    """Lower-cased host of an absolute URL, without port and credentials; null otherwise."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def robots_url(url: Column) -> Column:
    return F.when(host(url).isNotNull(), F.concat(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1), F.lit("/robots.txt")))


def crawl_prefix(url: Column) -> Column:
    """Scheme, host and whole path of the start page, with a slash at the end."""
    return F.concat(F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "/+$", ""), F.lit("/"))


def without_dots(path: Column) -> Column:
    """An absolute path with its dot segments carried out and empty ones left out; never above the root."""
    names = F.filter(F.split(path, "/"), lambda x: x != "")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(names, F.array().cast("array<string>"), step)
    folder = path.rlike(r"/\.{0,2}$") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """A link against its page, without fragment and query; null for other schemes, empty links and places on the page.

    Dot segments of relative links are carried out; a link that is a query only leads to the page itself.
    """
    link = F.trim(href)
    clean = F.regexp_replace(link, r"[?#].*$", "")
    page = F.regexp_replace(base, r"[?#].*$", "")
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.substring(page, F.length(origin) + 1, F.length(page)), r"[^/]*$", "")
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(clean == "", page)
        .when(F.lower(clean).rlike(r"^https?://"), clean)
        .when(clean.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), clean))
        .when(clean.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(clean.startswith("/"), F.concat(origin, without_dots(clean)))
        .otherwise(F.concat(origin, without_dots(F.concat(F.lit("/"), folder, clean))))
    )


#: Endings of files that are no pages.
NO_PAGES = r"(?i)\.(?:pdf|jpg|jpeg|png|gif|svg|zip|doc|docx|xls|xlsx)$"


def first_segment(url: Column, prefix: str) -> Column:
    """First path segment below a prefix; null for other URLs."""
    return F.when(url.startswith(prefix), F.nullif(F.regexp_extract(F.substring(url, F.lit(len(prefix) + 1), F.length(url)), r"^([^/?#]+)", 1), F.lit("")))
