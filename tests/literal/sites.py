"""Named queries on sitemaps, collection names and test cases; the SQL is the expected rows, written on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import sites
from .findings import _rows
from .measured import Query

# text, kind, addresses joined by a space
SITEMAPS = [
    ("<urlset><url><loc> https://a.test/?x=1&amp;y=2 </loc></url><url><LOC>https://a.test/b</LOC></url></urlset>", "urlset", "https://a.test/?x=1&y=2 https://a.test/b"),
    ("<sitemapindex xmlns='s'><sitemap><loc>https://a.test/s.xml</loc></sitemap></sitemapindex>", "index", "https://a.test/s.xml"),
    ("<html><loc>two words</loc></html>", "unknown", ""), ("", "unknown", ""), (None, "unknown", ""),
]
# model, collection
MODELS = [("User", "users"), ("Box", "boxes"), ("Class", "classes"), ("News", "news"), ("Company", "companies"), ("Day", "days"), ("Colloquy", "colloquies"), ("Branch", "branches")]
# path, source, cases
CASES = [
    ("a.test.ts", "it('a', f); test.only(\"b\", f)\n// it('c')\n/* test('d') */ x.it('e'); test.each([1])('f', f); commit('g')", 3), ("a.test.ts", "const u = 'https://x'; it('b', f)", 1),
    ("test_a.py", "def test_a():\n  async def test_b ():\ndef helper():", 2), ("a_test.go", "func TestA(t *T) {}\n func TestB(t *T) {}", 1), ("b.spec.js", None, 0),
]


def _frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame([r[: columns.count(",") + 1] for r in rows], columns)


def sitemap_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _frame(spark, SITEMAPS, "body string").select("body", sites.sitemap(F.col("body")).alias("s"))
    return found.select("body", "s.kind", F.array_join("s.locs", " ").alias("locs"))


def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, MODELS, "model string").withColumn("collection", sites.collection_name(F.col("model")))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, CASES, "path string, source string").withColumn("cases", sites.case_count(F.col("path"), F.col("source")))


QUERIES: dict[str, Query] = {q.__name__: q for q in (sitemap_texts, collection_names, test_cases)}

ORACLE_SQL: dict[str, str] = {
    "sitemap_texts": _rows("body, kind, locs", SITEMAPS),
    "collection_names": _rows("model, collection", MODELS),
    "test_cases": _rows("path, source, cases", CASES),
}
