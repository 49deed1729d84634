"""Test suites: Gherkin steps, outlines, step links, locators and their quality, coverage of a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a step line of a feature file.
STEP = r"^(Given|When|Then|And|But|\*)\s+(.*)$"
BINS = ["<0.4", "0.4-0.6", "0.6-0.8", "0.8-0.9", ">=0.9"]


def gherkin_steps(lines: DataFrame) -> DataFrame:
    """file, n, keyword, text of the steps of numbered lines (file, n, line); And, But and * take the keyword before them, Given at first."""
    line = F.trim("line")
    steps = lines.select("file", "n", F.regexp_extract(line, STEP, 1).alias("word"), F.trim(F.regexp_extract(line, STEP, 2)).alias("text")).where("word <> ''")
    own = F.when(~F.col("word").isin("And", "But", "*"), F.col("word"))
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("file", "n", F.coalesce(F.last(own, ignorenulls=True).over(before), F.lit("Given")).alias("keyword"), "text")


def outline_rows(steps: DataFrame, examples: DataFrame) -> DataFrame:
    """file, row, n, text: each step (file, n, text) once for each example row (file, row, names, cells), `<name>` filled in."""
    met = steps.join(examples, "file")
    pairs = F.arrays_zip("names", "cells")
    filled = F.aggregate(pairs, F.col("text"), lambda t, p: F.replace(t, F.concat(F.lit("<"), p["names"], F.lit(">")), p["cells"]))
    return met.select("file", "row", "n", filled.alias("text"))


def step_links(steps: DataFrame, definitions: DataFrame) -> DataFrame:
    """estate, text, d: the first definition (estate, d, pattern) that a distinct step text (estate, text) matches; null if none."""
    distinct = steps.select("estate", "text").distinct()
    hits = distinct.join(definitions, "estate").where(F.expr("text rlike pattern")).groupBy("estate", "text").agg(F.min("d").alias("d"))
    return distinct.join(hits, ["estate", "text"], "left")


def locator_confidence(strategy: Column, value: Column) -> Column:
    """How stable a legacy locator is, 0 to 1; null for XPath, which this table of cases doesn't read."""
    v = F.trim(value)
    digits, ids = v.rlike(r"\d{3,}"), r"^(?::|j_id|gwt-uid|ext-|yui_|ember\d|react-select-\d)"
    utility = v.rlike(r"(?:^|\s)(?:col|row|btn|mt|mb|p|m|px|py|text|d|w|h|flex|grid|bg)-")
    test_id = v.rlike(r"^\[(?:data-testid|data-test|data-qa|data-cy)=[^\]]+\]$")
    chained = v.rlike(r":nth-child\(|:nth-of-type\(|>\s*\w+\s*>\s*\w+\s*>")
    return (
        F.when(strategy == "id", F.when(v.rlike(r"\s") | (v == ""), 0.3).when(digits | v.rlike(ids), 0.5).otherwise(0.95))
        .when(strategy == "testId", 0.95)
        .when(strategy.isin("name", "text"), 0.85)
        .when(strategy == "linkText", 0.9)
        .when(strategy == "partialLinkText", 0.8)
        .when(strategy == "className", F.when(v == "", 0.1).when(utility, 0.5).otherwise(0.65))
        .when(strategy == "tagName", 0.5)
        .when(strategy == "css", F.when(test_id, 0.95).when(chained, 0.5).when(digits, 0.55).otherwise(0.8))
    )


def locator_histogram(locators: DataFrame) -> DataFrame:
    """bin, n of locators (strategy, value) by confidence; all five bins, also empty ones."""
    c = F.col("confidence")
    bin_ = F.when(c < 0.4, BINS[0]).when(c < 0.6, BINS[1]).when(c < 0.8, BINS[2]).when(c < 0.9, BINS[3]).otherwise(BINS[4])
    rated = locators.select(locator_confidence(F.col("strategy"), F.col("value")).alias("confidence")).where("confidence is not null")
    counted = rated.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = locators.sparkSession.createDataFrame([(b,) for b in BINS], "bin string")
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shared_locators(locators: DataFrame) -> DataFrame:
    """strategy, value, n_files of locators (file, strategy, value) that several files use."""
    used = locators.groupBy("strategy", "value").agg(F.count_distinct("file").alias("n_files"))
    return used.where("n_files > 1")


def derived_locator(role: Column, name: Column, label: Column, placeholder: Column, text: Column, test_id: Column, tag: Column, id_: Column, name_attr: Column) -> Column:
    """The strategy that reads best for an element: role and name, label, placeholder, text, test id, bare role, then CSS."""
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    named = given(name) | given(label) | given(text)
    return (
        F.when(given(role) & named, "role").when(given(label), "label").when(given(placeholder), "placeholder")
        .when(given(text) & tag.isin("a", "button", "summary", "label", "span", "div", "li", "p"), "text")
        .when(given(test_id), "testid").when(given(role) & ~role.isin("link", "button") & ~given(id_) & ~given(name_attr), "role").otherwise("css")
    )


def unique_names(names: DataFrame) -> DataFrame:
    """page, n, name: the k-th equal name (page, n, name) of a page gets its number, from 2 on."""
    k = F.row_number().over(Window.partitionBy("page", "name").orderBy("n"))
    return names.withColumn("k", k).select("page", "n", F.when(F.col("k") > 1, F.concat("name", F.col("k").cast("string"))).otherwise(F.col("name")).alias("name"))


def coverage(steps: DataFrame) -> DataFrame:
    """estate, total, converted, percent of suites (estate, total, todos); one decimal, halves up, 0 without steps."""
    sums = steps.groupBy("estate").agg(F.sum("total").alias("total"), F.sum(F.col("total") - F.col("todos")).alias("converted"))
    return sums.withColumn("percent", F.when(F.col("total") > 0, F.floor(1000.0 * F.col("converted") / F.col("total") + 0.5) / 10).otherwise(0.0))


def base_url(visits: DataFrame) -> DataFrame:
    """estate, origin: the most frequent origin of visits (estate, n, origin), those of an API last, of equal ones the first seen."""
    counted = visits.groupBy("estate", "origin").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("first"))
    return counted.groupBy("estate").agg(F.min_by("origin", F.struct(F.contains("origin", F.lit("//api.")), -F.col("n"), "first")).alias("origin"))
