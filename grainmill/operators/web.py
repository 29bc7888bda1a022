"""Web pages: clean text and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R

_LINK = r'(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'


def clean_text(html: Column) -> Column:
    """Without scripts, styles and tags, white space collapsed; entities stay."""
    x = F.regexp_replace(html, r"(?is)<(script|style).*?>.*?</\1>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(x, r"[\t-\r\x1c-\x20\x85\xa0]+", " "))


def decode_href(value: Column) -> Column:
    """Entities resolved, named and numeric ones, a redirection's target taken, percent escapes decoded.

    The text library that Spark ships knows the entities of HTML 4 that end in a semicolon; values without any are left alone.
    """
    named = F.java_method(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), F.replace(value, F.lit("&apos;"), F.lit("&#39;")))
    x = F.when(value.contains("&"), named).otherwise(value)
    target = F.regexp_extract(x, r'uddg=([^&"]+)', 1)
    x = F.when(target != "", target).otherwise(x)
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def links(html: Column, most: int = 8, pattern: str = _LINK) -> Column:
    """The first ``most`` links with a title, as structs (title, url)."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inner"))
    titled = F.transform(found, lambda l: F.struct(F.trim(F.regexp_replace(F.regexp_replace(l["inner"], r"<[^>]+>", ""), r"\s+", " ")).alias("title"), decode_href(l["href"]).alias("url")))
    return F.slice(F.filter(titled, lambda l: l["title"] != ""), 1, most)


def paired_results(titles: Column, urls: Column) -> Column:
    """Titles and links of a suggestion service, as long as the shorter of the two."""
    return F.slice(F.arrays_zip(titles.alias("title"), urls.alias("url")), F.lit(1), F.least(F.size(titles), F.size(urls)))


def first_non_empty(*sources: Column) -> Column:
    """The result of the first source that has any."""
    return F.coalesce(*[F.when(F.size(s) > 0, s) for s in sources])


def search_results(html: Column, most: int = 8) -> Column:
    """Struct (source, results) of the first kind of result page that gives any link; null if none does."""
    found = None
    for name, pattern in reversed(R.RESULT_LINKS):
        own = links(html, most, pattern)
        found = F.when(F.size(own) > 0, F.struct(F.lit(name).alias("source"), own.alias("results"))).otherwise(found)
    return found


def result_list(found: Column) -> Column:
    """Results as numbered lines under a heading; null without results."""
    lines = F.transform(found["results"], lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["title"], F.lit(" — "), r["url"]))
    return F.concat(F.lit("Web search results ("), found["source"], F.lit("):\n"), F.array_join(lines, "\n"))
