"""Repository tables: sizes, churn, activity, environment names, packages, vendors, routes, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Folders whose second segment names the bucket, languages by file endings.
CONTAINERS = ["src", "app", "apps", "packages", "services", "lib", "libs"]
LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "py": "Python", "go": "Go", "rb": "Ruby", "sql": "SQL", "css": "Styles", "html": "HTML"}


def bucket(path: Column) -> Column:
    """The first folder, or the first two below a conventional container; (root) for a file at the top."""
    parts = F.split(path, "/")
    two = F.concat(parts[0], F.lit("/"), F.get(parts, F.lit(1)))
    return F.when(F.size(parts) == 1, "(root)").when(parts[0].isin(*CONTAINERS) & (F.size(parts) > 2), two).otherwise(parts[0])


def language(path: Column) -> Column:
    """By the ending; null for other files, declarations and minified ones."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(~path.rlike(r"\.d\.ts$|\.min\.(?:js|css)$"), F.try_element_at(known, F.regexp_extract(path, r"\.([a-z]+)$", 1)))


def size_rollup(files: DataFrame) -> DataFrame:
    """language, folder, files, lines of source files (path, lines): by language, by folder and in all, in one pass of grouping sets."""
    named = files.select(language(F.col("path")).alias("language"), bucket(F.col("path")).alias("folder"), "lines").where("language is not null")
    sets = named.groupingSets([["language"], ["folder"], []], "language", "folder")
    return sets.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def commits(log: DataFrame) -> DataFrame:
    """repo, at, added, deleted, path of a numbered log (repo, n, line): an `@time` line, then `added<TAB>deleted<TAB>path` lines.

    A rename counts for its new path; binary files count no lines.
    """
    order = Window.partitionBy("repo").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.startswith("line", F.lit("@")), F.struct("n", F.trim(F.substring("line", 2, 100)).alias("at")))
    parts = F.split("line", "\t", 3)
    braces = F.regexp_replace(F.regexp_replace(parts[2], r"\{.* => (.*)\}", "$1"), "//", "/")
    path = F.regexp_replace(braces, "^.* => ", "")
    rows = log.withColumn("c", F.last(head, ignorenulls=True).over(order)).where(F.rlike("line", F.lit(r"^(?:\d+|-)\t(?:\d+|-)\t.")))
    return rows.select("repo", F.col("c.n").alias("commit"), F.col("c.at").alias("at"), F.expr("try_cast(split(line, '\\t')[0] as long)").alias("added"), F.expr("try_cast(split(line, '\\t')[1] as long)").alias("deleted"), path.alias("path"))


def churn(log: DataFrame, most: int = 25) -> DataFrame:
    """repo, folder, commits, added, deleted of each repository's folders with most changed lines."""
    rows = commits(log).withColumn("folder", bucket(F.col("path")))
    folders = rows.groupBy("repo", "folder").agg(F.count_distinct("commit").alias("commits"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy((F.col("added") + F.col("deleted")).desc(), "folder"))
    return folders.withColumn("place", place).where(F.col("place") <= most).drop("place")


def commits_by_month(log: DataFrame, months: int = 12) -> DataFrame:
    """repo, month, commits of the last months with commits; months are those of the commit's own clock."""
    heads = log.where("startswith(line, '@')").select("repo", F.substring(F.trim(F.substring("line", 2, 100)), 1, 7).alias("month"))
    counted = heads.groupBy("repo", "month").agg(F.count(F.lit(1)).alias("commits"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("month")))
    return counted.withColumn("place", place).where(F.col("place") <= months).drop("place")


def env_names(uses: DataFrame) -> DataFrame:
    """repo, name, in_code, in_template, status (documented, undocumented, unused, or no-template where a repository has none) of uses (repo, name, source)."""
    has = lambda s: F.max(F.col("source") == s)
    named = uses.groupBy("repo", "name").agg(has("code").alias("in_code"), has("template").alias("in_template"), has("ci").alias("in_ci"))
    templates = uses.groupBy("repo").agg(has("template").alias("any_template"))
    status = (
        F.when(~F.col("any_template"), "no-template").when(F.col("in_code") & ~F.col("in_template"), "undocumented")
        .when(F.col("in_template") & ~F.col("in_code") & ~F.col("in_ci"), "unused").otherwise("documented")
    )
    return named.join(templates, "repo").select("repo", "name", "in_code", "in_template", status.alias("status"))


def nearest_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, package: the deepest package folder (dir, '' at the top) at or above each file. Ancestors meet packages by equality."""
    parts = F.split("path", "/")
    depths = F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")
    above = files.select("path", depths).withColumn("dir", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/"))
    return above.join(packages, "dir").groupBy("path").agg(F.max_by("dir", "depth").alias("package"))


def shared_vendors(uses: DataFrame) -> DataFrame:
    """vendor, repos, n_repos of vendors (repo, vendor) that several repositories use."""
    used = uses.groupBy("vendor").agg(F.array_sort(F.collect_set("repo")).alias("repos"))
    return used.withColumn("n_repos", F.size("repos").cast("long")).where("n_repos > 1").select("vendor", F.array_join("repos", ",").alias("repos"), "n_repos")


def unguarded_routes(routes: DataFrame, covers: DataFrame) -> DataFrame:
    """repo, path of API routes (repo, path, has_auth) without a check of their own or a middleware prefix (repo, prefix) over them.

    Routes for signing in, health, webhooks and schedules need none.
    """
    open_ = routes.where(~F.coalesce("has_auth", F.lit(False)) & ~F.rlike("path", F.lit("(?i)/(?:auth|health|healthz|webhooks?|cron)(?:/|$)")))
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("prefix")
    covered = open_.select("repo", "path", above).join(covers.select("repo", F.regexp_replace("prefix", "/$", "").alias("prefix")).distinct(), ["repo", "prefix"], "left_semi").select("repo", "path").distinct()
    return open_.select("repo", "path").join(covered, ["repo", "path"], "left_anti")


# Gaps of a repository's measured facts; id, area, severity and predicate (SQL).
GAPS = [
    ("secrets.committed-secret-file", "secrets", "'high'", "secret_files > 0"),
    ("webhooks.unverified", "webhooks", "'high'", "unverified_webhooks > 0"),
    ("tests.failing", "tests", "'high'", "tests_failed > 0"),
    ("tests.none", "tests", "'medium'", "test_files = 0"),
    ("jobs.cron-unauthenticated", "jobs", "'medium'", "open_crons > 0"),
    ("auth.unguarded-api-routes", "auth", "'medium'", "open_routes > 0"),
    ("env.no-example", "env", "'medium'", "not has_template and env_names > 0"),
    ("env.undocumented", "env", "'low'", "has_template and undocumented > 0"),
    ("ci.none", "ci", "'low'", "workflows = 0"),
    ("deps.no-lockfile", "deps", "'low'", "packages > 0 and lockfiles = 0"),
    ("docs.no-readme", "docs", "'low'", "not has_readme"),
    ("security.no-rate-limit", "security", "'low'", "api_routes > 0 and not rate_limit"),
    ("security.no-headers", "security", "'low'", "api_routes > 0 and not security_headers"),
    ("deploy.docker-root", "deploy", "'low'", "root_images > 0"),
    ("integrations.unlisted-hosts", "integrations", "'info'", "other_hosts > 0"),
    ("repo.symlinks", "repo", "'info'", "symlinks > 0"),
]


def portfolio(repos: DataFrame) -> DataFrame:
    """owner, repos, endpoints, monthly_usd (cents, halves up), stores of repos (owner, repo, endpoints, monthly_usd, stores)."""
    stores = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("stores")))), ",")
    usd = F.floor(F.coalesce(F.sum("monthly_usd"), F.lit(0.0)) * 100 + 0.5) / 100
    return repos.groupBy("owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("endpoints").alias("endpoints"), usd.alias("monthly_usd"), stores.alias("stores"))
