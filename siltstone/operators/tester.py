"""Findings of a crawled test run and of a converted test estate, from their landed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the findings below say; a page that takes longer than this is slow, and three times as long very slow.
SLOW_MS = 3000


def _count(n: Column, one: str) -> Column:
    """A number and its noun, in the plural unless it is one."""
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


def _first_three(rows: DataFrame, text: Column, *more: Column) -> DataFrame:
    """run, path, total, detail (the first three texts by n) and further aggregates of each page's rows; only those three are gathered."""
    place = F.row_number().over(Window.partitionBy("run", "path").orderBy("n", text))
    first = rows.select("run", "path", "n", text.alias("t"), place.alias("place")).where("place <= 3").groupBy("run", "path").agg(F.array_sort(F.collect_list(F.struct("place", "t"))).alias("three"))
    counted = rows.groupBy("run", "path").agg(F.count(F.lit(1)).alias("total"), *more)
    return counted.join(first, ["run", "path"]).withColumn("detail", F.array_join(F.transform("three", lambda x: x["t"]), " | ")).drop("three")


def run_findings(runs: DataFrame, pages: DataFrame, broken: DataFrame, errors: DataFrame, requests: DataFrame, elements: DataFrame) -> DataFrame:
    """run, severity, category, title, detail of each finding of each run.

    `runs` is (run, start_url), `pages` (run, path, load_ms, bare_forms, bare_controls, images_without_alt, has_h1, has_landmark),
    `broken` (run, url, status, error, referrer), and errors, requests and elements the rows of pages, numbered by n. Each is reduced
    by page before it is joined, so a page or run of any size is counted where its rows lie. Null counts and marks
    give no finding; an empty table gives none but that a run has no page.
    """
    row = lambda severity, category, title, detail: F.struct(severity.alias("severity"), F.lit(category).alias("category"), title.alias("title"), detail.alias("detail"))
    say, on = F.lit, F.concat(F.lit(" on "), F.col("path"))
    links = broken.select("run", F.when(F.col("status") == 0, row(
        say("high"), "navigation", F.concat(say("Navigation failed: "), "url"), F.concat(F.coalesce("error", say("unknown error")), say(" (linked from "), "referrer", say(")"))
    )).otherwise(row(
        F.when(F.col("status") >= 500, "high").otherwise("medium"), "broken-link", F.concat(say("Broken link ("), F.col("status").cast("string"), say("): "), "url"), F.concat(say("Linked from "), "referrer")
    )).alias("f"))
    shown = F.concat_ws(" ", F.col("status").cast("string"), "method", "url")
    console = _first_three(errors, F.col("message")).select("run", row(say("medium"), "console-error", F.concat(_count(F.col("total"), "console error"), on), F.col("detail")).alias("f"))
    failed = _first_three(requests, shown, F.max("status").alias("worst")).select("run", row(
        F.when(F.col("worst") >= 500, "medium").otherwise("low"), "failed-request", F.concat(_count(F.col("total"), "failed network request"), on), F.col("detail")
    ).alias("f"))
    ms, forms, controls, images = (F.col(c) for c in ("load_ms", "bare_forms", "bare_controls", "images_without_alt"))
    none = F.lit(None).cast("string")
    of_page = F.array(
        F.when(ms > SLOW_MS, row(F.when(ms > 3 * SLOW_MS, "high").otherwise("medium"), "performance", F.concat(say("Slow page load ("), ms.cast("string"), say(" ms)"), on), say(f"Threshold is {SLOW_MS} ms"))),
        F.when(forms > 0, row(say("medium"), "accessibility", F.concat(_count(forms, "form"), say(" with unlabeled controls"), on), F.concat(
            _count(controls, "control"), say(" lack a <label>, aria-label or placeholder; screen readers and getByLabel() cannot target them"))))
        .when(controls > 0, row(say("low"), "accessibility", F.concat(_count(controls, "unlabeled form control"), say(" outside a form"), on), none)),
        F.when(images > 0, row(say("low"), "accessibility", F.concat(_count(images, "image"), say(" without alt text"), on), say('Add alt="" for decorative images or a description for meaningful ones'))),
        F.when(~F.col("has_h1"), row(say("low"), "structure", F.concat(say("No <h1>"), on), say("Every page should have exactly one level-1 heading; the smoke test cannot assert on a heading until one exists"))),
        F.when(~F.col("has_landmark"), row(say("low"), "accessibility", F.concat(say("No landmark regions"), on), say("Add <main>, <nav>, <header> or <footer> (or the equivalent roles) so assistive tech can navigate by region"))),
    )
    of_pages = pages.select("run", F.explode(F.filter(of_page, lambda x: x.isNotNull())).alias("f"))
    weak = elements.groupBy("run", "path").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") == "low").alias("low")).where("low > 0 and low >= 0.5 * total")
    weak = weak.select("run", row(say("info"), "testability", F.concat(F.col("low").cast("string"), say("/"), F.col("total").cast("string"), say(" interactive elements"), on, say(" lack an accessible name or test id")), say(
        "Page-object locators fell back to CSS; add accessible names or data-testid attributes")).alias("f"))
    empty = runs.join(pages.select("run").distinct(), "run", "left_anti").select("run", row(say("critical"), "navigation", say("No page could be rendered"), F.concat(
        say("The start URL "), "start_url", say(" did not produce a renderable page; check the URL, network access and authentication"))).alias("f"))
    every = links
    for part in (console, failed, of_pages, weak, empty):
        every = every.unionByName(part)
    return every.select("run", "f.*")


def run_summary(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """run, pages, slow, avg_ms (rounded, halves up), locators of each run with pages."""
    timed = pages.groupBy("run").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("load_ms") > SLOW_MS).alias("slow"), F.floor(F.avg("load_ms") + 0.5).alias("avg_ms"))
    found = elements.groupBy("run").agg(F.count(F.lit(1)).alias("locators"))
    return timed.join(found, "run", "left").fillna(0, ["locators"])


def estate_findings(locators: DataFrame, todos: DataFrame, waits: DataFrame, untested: DataFrame, duplicates: DataFrame, most_duplicates: int = 50) -> DataFrame:
    """estate, severity, category, title, detail of each finding of a converted estate.

    `locators` (estate, strategy, value, confidence, note, code) are those of low confidence, `todos` (estate, raw, place) and `waits` (estate, raw) the statements that
    can't be converted and the sleeps removed, `untested` (estate, test) tests without an assertion, `duplicates` (estate, strategy, value, file, n)
    the places of locators with `n`, their order; of those in several files the first `most_duplicates` of an estate by first place are told, as a report's top list.
    """
    made = lambda df, severity, category, detail, *title: df.select("estate", severity.alias("severity"), F.lit(category).alias("category"), F.concat(*title).alias("title"), detail.alias("detail"))
    cut = lambda c, n=80: F.substring(c, 1, n)
    severity = F.when(F.col("confidence") < 0.4, "high").otherwise("medium")
    brittle = made(locators, severity, "locator", F.concat(F.coalesce("note", F.lit("low confidence")), F.lit(" -> generated "), "code"), F.lit("Brittle locator ("), "strategy", F.lit("): "), cut("value"))
    open_ = made(todos, F.lit("medium"), "conversion", F.concat(F.lit("in "), "place"), F.lit("Unconvertible: "), cut("raw"))
    flaky = made(waits, F.lit("low"), "flakiness", F.lit("Playwright auto-waits; the sleep was replaced with a NOTE comment."), F.lit("Hard wait removed: "), cut("raw"))
    bare = made(untested, F.lit("low"), "quality", F.lit(None).cast("string"), F.lit("Test without assertion: "), "test")
    files = duplicates.groupBy("estate", "strategy", "value", "file").agg(F.min("n").alias("n"))
    several = files.groupBy("estate", "strategy", "value").agg(F.min("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("n", "file"))), lambda f: f["file"]).alias("files")).where(F.size("files") > 1)
    first = several.withColumn("k", F.row_number().over(Window.partitionBy("estate").orderBy("n"))).where(F.col("k") <= most_duplicates)
    told = F.array_join("files", ", ")
    twice = made(first, F.lit("low"), "duplication", told, F.lit("Locator duplicated in "), F.size("files").cast("string"), F.lit(" files: "), "strategy", F.lit("="), cut("value", 60))
    return brittle.unionByName(open_).unionByName(flaky).unionByName(bare).unionByName(twice)
