"""Columns read from raw HTML and URLs, all native expressions. Null html reads as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns; both Java's and RE2's syntax, and free of quotes.
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>"
TAG = r"<[^>]+>"
ENTITY = r"(?i)&[a-z#0-9]+;"
TOKEN = r"\S*[A-Za-z0-9]\S*"
HREF = r"(?is)<a\s[^>]*?href=.([^<>\s\x22\x27]*)"
HOST = r"^[A-Za-z]+://([^/?#:]+)"
PATH = r"^[A-Za-z]+://[^/?#]+([^?#]*)"

def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " "), ENTITY, " ")


def words_in_html(html: Column) -> Column:
    """Tokens with an ASCII letter or digit in the visible text."""
    return F.regexp_count(visible_text(html), F.lit(TOKEN)).cast("long")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, PATH, 1)
    return F.when(path == "", "/").otherwise(path)


def links(pages: DataFrame) -> DataFrame:
    """page_id, host, href of each link, in any order; fragments and empty targets are no links."""
    href = F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href")
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), href)
    return found.where("href <> '' and not startswith(href, '#')")
