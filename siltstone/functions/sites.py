"""Sitemaps, collection names, counts of test cases: all as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of test files' languages, what begins a test case in them, modifiers of a case, runners.
PYTHON_CASE = r"(?m)^\s*(?:async\s+)?def\s+test_\w+\s*\("
GO_CASE = r"(?m)^func\s+Test\w+\s*\("
SCRIPT_CASE = r"(?:^|[^\w.$])(?:it|test)(?:\.(?:only|skip|todo|concurrent|fails|serial))?\s*\(\s*['\"`]"
SCRIPT_TABLE = r"(?:^|[^\w.$])(?:it|test)\.each\s*[(`]"


def sitemap(xml: Column) -> Column:
    """kind (index, urlset or unknown) and locs, the addresses of a sitemap's text; null text is unknown, without addresses."""
    xml = F.coalesce(xml, F.lit(""))
    kind = F.when(xml.rlike(r"(?i)<sitemapindex[\s>]"), "index").when(xml.rlike(r"(?i)<urlset[\s>]"), "urlset").otherwise("unknown")
    locs = F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.struct(kind.alias("kind"), F.transform(locs, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))).alias("locs"))


def collection_name(model: Column) -> Column:
    """The collection that a document model's name implies: its lower-case plural."""
    low = F.lower(model)
    return (
        F.when(low.rlike("(?:x|ch|ss|sh)$"), F.concat(low, F.lit("es"))).when(low.endswith("s"), low)
        .when(low.rlike("(?:[^aeiouy]|qu)y$"), F.regexp_replace(low, "y$", "ies")).otherwise(F.concat(low, F.lit("s")))
    )


def case_count(path: Column, source: Column) -> Column:
    """Test cases declared in a file; in scripts comments don't count, and a table of cases is one. Null source has none."""
    source = F.coalesce(source, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//.*$", "$1")
    count = lambda text, shape: F.regexp_count(text, F.lit(shape))
    return F.when(path.endswith(".py"), count(source, PYTHON_CASE)).when(path.endswith(".go"), count(source, GO_CASE)).otherwise(count(bare, SCRIPT_CASE) + count(bare, SCRIPT_TABLE))
