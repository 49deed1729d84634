"""Page rules as one table of predicates; findings, severities, area scores and fix plans from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import facts, graph
from .checks import findings

# Severity weights; ids, areas, severities and predicates (SQL over page_view's columns) of the rules; what fixes take, `medium` where nothing is said.
WEIGHTS = {"critical": 40, "high": 18, "medium": 8, "low": 3, "info": 0}
RULES = [
    ("seo.missing-title", "search", "'high'", "title = ''"),
    ("seo.long-title", "search", "'low'", "length(title) > 65"),
    ("seo.missing-description", "search", "'medium'", "description = ''"),
    ("seo.missing-canonical", "search", "'low'", "canonical = ''"),
    ("seo.missing-h1", "search", "'medium'", "n_h1 = 0"),
    ("seo.multiple-h1", "search", "'low'", "n_h1 > 1"),
    ("seo.hash-routes", "search", "'high'", "n_hash_routes > 0"),
    ("seo.images-missing-alt", "search", "'low'", "n_missing_alt > 0"),
    ("ai.structured-data-invalid", "ai-visibility", "'medium'", "n_json_ld_errors > 0"),
    ("ai.content-needs-javascript", "ai-visibility", "'high'", "words < 50"),
    (
        "build.scaffold-title", "build", "'high'",
        "lower(title) in ('vite + react', 'vite + react + ts', 'vite app', 'react app', 'create next app', 'lovable app', "
        "'lovable generated project', 'my v0 project', 'v0 app', 'bolt', 'my google ai studio app', 'replit', 'document', 'untitled')",
    ),
    ("ai.nosnippet", "ai-visibility", "'high'", "nosnippet"),
    ("seo.noindex", "search", "case when path = '/' then 'critical' else 'high' end", "noindex and not private"),
    ("seo.canonical-to-home", "search", "'high'", "path <> '/' and canonical_host = host and canonical like '%://' || host || '/'"),
    ("seo.canonical-other-host", "search", "case when staging then 'info' else 'high' end", "canonical_host <> '' and canonical_host <> host"),
    ("build.placeholder-content", "build", "'medium'", "n_placeholders > 0"),
    ("build.mixed-content", "build", "'medium'", "https and n_http_resources > 0"),
    ("build.secret-in-javascript", "build", "'critical'", "secret_in_script"),
    ("build.public-browser-keys", "build", "'info'", "public_key_in_script"),
]
# ... and those of a site's home page alone
HOME_RULES = [
    ("seo.missing-lang", "search", "'low'", "lang = ''"),
    ("seo.missing-viewport", "search", "'medium'", "not has_viewport"),
    ("seo.missing-open-graph", "search", "'low'", "not has_og"),
    ("ai.no-structured-data", "ai-visibility", "'medium'", "n_json_ld = 0"),
    ("build.no-favicon", "build", "'low'", "not has_icon"),
    ("build.builder-fingerprints", "build", "'low'", "signs <> ''"),
]
AREAS = ["ai-visibility", "search", "build", "design", "readiness"]
#: What a sign of a template takes from the score of design, whatever its severity.
DESIGN_SIGN = 6
EFFORTS = ["quick", "medium", "project"]
QUICK = (
    "seo.missing-title seo.missing-description seo.long-title seo.duplicate-titles seo.duplicate-descriptions seo.missing-h1 seo.multiple-h1 seo.missing-lang seo.missing-viewport "
    "seo.missing-canonical seo.canonical-to-home seo.canonical-other-host seo.missing-open-graph seo.images-missing-alt seo.noindex ai.nosnippet build.no-favicon build.scaffold-title "
    "build.placeholder-content build.builder-fingerprints readiness.no-analytics readiness.form-submit-unverified readiness.focus-outline-removed readiness.no-contact-details "
    "readiness.no-business-identity readiness.competing-calls-to-action design.emoji-headings design.em-dash-density design.hover-opacity"
).split()
PROJECT = ["ai.content-needs-javascript", "seo.hash-routes", "build.secret-in-javascript", "build.public-browser-keys", "readiness.many-third-parties", "design.untouched-shadcn"]


def homes(view: DataFrame) -> DataFrame:
    """Of each host the row of its home page: that of path /, else that of least page_id. No join: the row is kept by the grouping."""
    columns = [c for c in view.columns if c != "host"]
    first = F.min_by(F.struct(*columns), F.struct(F.col("path") != "/", "page_id")).alias("home")
    return view.groupBy("host").agg(first).select("host", "home.*")


def page_findings(view: DataFrame) -> DataFrame:
    """page_id, host, rule, area, severity: a row for each rule that a page of `view` (`elements.page_view`) breaks, HOME_RULES on home pages only."""
    ids = ["page_id", "host"]
    return findings(view, ids, RULES).unionByName(findings(homes(view), ids, HOME_RULES))


def shared_values(view: DataFrame) -> DataFrame:
    """host, rule, value, n_pages: titles and descriptions on several pages of a host."""
    kinds = F.array(*(F.struct(F.lit(f"seo.duplicate-{c}s").alias("rule"), F.col(c).alias("value")) for c in ("title", "description")))
    values = view.select("host", F.inline(kinds)).where("value <> ''")
    return values.groupBy("host", "rule", "value").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages > 1")


def failed_checks(pages: DataFrame, view: DataFrame, page_facts: DataFrame) -> DataFrame:
    """host, rule, area, severity, n_pages of page rules, shared values, linked pages that aren't there, readiness and signs of templates; a check fails once a site.

    `view` and `page_facts` are those of `pages`, written. Checks of a site as a whole have no pages.
    """
    shared = shared_values(view).groupBy("host", "rule").agg(F.sum("n_pages").alias("n_pages"))
    missing = graph.broken_links(pages).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).withColumn("rule", F.lit("seo.broken-internal-pages"))
    more = shared.unionByName(missing).select("host", "rule", F.lit("search").alias("area"), F.lit("medium").alias("severity"), "n_pages")
    ready = facts.site_findings(page_facts).withColumn("n_pages", F.lit(0).cast("long"))
    return site_findings(page_findings(view).unionByName(facts.design_findings(page_facts))).unionByName(more).unionByName(ready)


def severity_counts(found: DataFrame) -> DataFrame:
    """severity, findings: all severities, also those without findings."""
    spark = found.sparkSession
    all_ = spark.createDataFrame([(s,) for s in WEIGHTS], "severity string")
    counted = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def weight(severity: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), severity)


def site_findings(found: DataFrame) -> DataFrame:
    """host, rule, area, severity, n_pages: a check fails once a site, on so many pages, with its heaviest severity."""
    heaviest = F.max_by("severity", weight(F.col("severity"))).alias("severity")
    return found.groupBy("host", "rule", "area").agg(heaviest, F.count(F.lit(1)).alias("n_pages"))


def area_scores(view: DataFrame, failed: DataFrame) -> DataFrame:
    """host, area, score, grade: 100 less the weights of failed checks (in design, DESIGN_SIGN each), 0 at least; areas without findings have 100."""
    hosts = view.select("host").distinct().select("host", F.explode(F.array(*map(F.lit, AREAS))).alias("area"))
    lost = failed.groupBy("host", "area").agg(F.sum(F.when(F.col("area") == "design", DESIGN_SIGN).otherwise(weight(F.col("severity")))).alias("lost"))
    score = F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("long")
    scored = hosts.join(lost, ["host", "area"], "left").select("host", "area", score.alias("score"))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return scored.withColumn("grade", grade)


def effort(rule: Column) -> Column:
    return F.when(rule.isin(QUICK), "quick").when(rule.isin(PROJECT), "project").otherwise("medium")


def fix_plan(failed: DataFrame) -> DataFrame:
    """host, position, rule, effort, n_pages: each site's failed checks, heaviest first, then the quickest, then by area (in the order of AREAS) and name."""
    plan = failed.withColumn("effort", effort(F.col("rule")))
    place = lambda column, order: F.array_position(F.array(*map(F.lit, order)), F.col(column))
    order = Window.partitionBy("host").orderBy(weight(F.col("severity")).desc(), place("effort", EFFORTS), place("area", AREAS), "rule")
    return plan.select("host", F.row_number().over(order).cast("long").alias("position"), "rule", "effort", "n_pages")


def shared_titles(view: DataFrame) -> DataFrame:
    """title, n_pages, first_page of titles on several pages."""
    grouped = view.where("title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))
    return grouped.where("n_pages > 1")
