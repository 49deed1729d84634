"""Named queries on measurements that no common table holds: small literal tables, the same rows in the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators import checks, design, layout, readiness, repo, suites

Query = Callable[[SparkSession, str], DataFrame]


class Rows:
    """Literal rows: text of VALUES and of the column names, good for both engines."""

    def __init__(self, columns: str, values: str):
        self.columns, self.values = columns, values

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.sql(f"select * from values {self.values} as t({self.columns})")

    @property
    def sql(self) -> str:
        return f"(values {self.values}) t({self.columns})"


def facts(key: str, clean: dict[str, str], broken: dict[str, dict[str, str]]) -> Rows:
    """A row of clean facts changed in some columns for each key."""
    lines = ["(" + ", ".join([f"'{k}'", *(change.get(c, v) for c, v in clean.items())]) + ")" for k, change in broken.items()]
    return Rows(", ".join([key, *clean]), ", ".join(lines))


VIEWS = Rows("page, width, scroll_width", "(1, 360, 360), (1, 390, 390), (1, 480, 520), (1, 768, 769), (1, 1024, 1024), (2, 360, 400), (2, 390, 420), (2, 480, 520), (2, 768, 768), (3, 480, 483), (3, 1024, 1027), (3, 1280, 1290)")
TARGETS = Rows(
    "page, width, n, sel, x, y, w, h",
    "(1, 390, 0, 'a', 0, 0, 50, 50), (1, 390, 1, 'b', 40, 40, 50, 50), (1, 390, 2, 'c', 5, 5, 10, 10), (1, 390, 3, 'd', 90, 90, 400, 400), (1, 390, 4, 'e', 300, 300, 300, 300), (2, 390, 0, 'a', 0, 0, 50, 50), (2, 390, 1, 'b', 50, 0, 44, 43)",
)
CLIPPED = Rows("page, width, sel, ellipsis", "(1, 360, 'p', false), (1, 360, 'h2', true), (2, 390, 'td', false)")
LINKS = Rows(
    "page, width, href, text, region",
    "(1, 1440, '/a', 'A', 'main'), (1, 1440, '/b', 'B', 'main'), (1, 1440, '/c', 'C', 'nav'), (1, 1440, '', 'D', 'footer'), (1, 360, '/a', 'A', 'main'), (2, 1440, '/b', 'B', 'main'), (3, 1440, '/q', 'Q', 'footer'), (3, 360, '/z', 'Z', 'main')",
)
IMAGES = Rows("page, src, natural_width, render_width", "(1, 'a', 800, 400), (1, 'b', 799, 400), (2, 'c', 1000, 300), (2, 'd', 10, 0)")
STOPS = Rows("gradient, colour", "(1, '#7c3aed'), (1, '#3b82f6'), (2, '#7c3aed'), (2, '#ec4899'), (3, '#808080'), (3, '#0000ff'), (4, '#6366f1'), (4, '#8b5cf6'), (4, '#2563eb')")
SPACINGS = Rows("page, value", "(1, 4), (1, 8), (1, 12), (1, 13), (2, 5), (2, 10), (2, 15), (3, 6), (3, 7), (3, 11), (3, 18), (3, 17)")
FONTS = Rows("page, family, n", "(1, 'Inter', 70), (1, 'Georgia', 30), (2, 'Arial', 5), (2, 'Geist', 5), (3, 'Lora', 1), (3, 'Geist', 2)")
PAIRS = Rows("page, n, fg, bg, size, bold", "(1, 0, '#777777', '#ffffff', 16, false), (1, 1, '#aaaaaa', '#ffffff', 16, false), (1, 2, '#000000', '#ffffff', 16, false), (2, 0, '#8899aa', '#99aabb', 24, false), (2, 1, '#aaaaaa', '#ffffff', 12, true), (2, 2, '#aaaaaa', '#ffffff', 12, false)")
REQUESTS = Rows("site, origin", "('s', 'https://www.googletagmanager.com'), ('s', 'https://js.stripe.com'), ('s', 'https://js.stripe.com'), ('s', 'https://cdn.other.net'), ('t', 'https://Connect.Facebook.net'), ('t', 'https://fonts.gstatic.com'), ('t', 'https://o1.ingest.sentry.io')")
POLICY_LINKS = Rows("site, n, href, text", "('s', 0, 'https://s/legal?x=cookie', 'Legal'), ('s', 1, '/privacy-policy', 'Read'), ('s', 2, '/p2', 'Our Privacy'), ('s', 3, '/tos', null), ('t', 0, '/returns', 'Money back'), ('t', 1, 'https://cookie.net/', 'Home'), ('t', 2, '/a', 'Delete your account')")
COPY = Rows("id, body", "(1, 'Add to cart now'), (2, 'Nothing here'), (3, 'from 5 per month'), (4, null), (5, 'resubscribed')")
FORMS = Rows(
    "form, fields, has_action, has_handler, novalidate, required, labelled, captcha, honeypot, password",
    "(1, 3, true, false, false, 1, 3, true, false, false), (2, 2, false, false, true, 0, 1, false, false, false), (3, 2, false, true, false, 0, 2, false, false, true), (4, 0, false, false, false, 0, 0, false, false, false), (5, 1, true, false, false, 1, 0, false, false, false)",
)
ADDRESSES = Rows("url", "('https://A.example.com/x/#top'), ('http://a.example.com'), ('https://a.example.com/?q=1#z'), ('mailto:a@b.c'), ('https://a.example.com/pic.PNG'), ('http://localhost:3000/login'), ('https://x.vercel.app/admin/'), ('https://staging.x.org/loginx')")
FILES = Rows("path, lines", "('src/a/x.ts', 10), ('src/a/y.tsx', 5), ('src/main.py', 7), ('lib/z.d.ts', 9), ('README.md', 3), ('tools/run.py', 2), ('index.html', 4), ('web/app.min.js', 1)")
LOG = Rows(
    "repo, n, line",
    "('r', 1, '@2024-03-01T10:00:00+02:00'), ('r', 2, '3\t1\tsrc/a/x.ts'), ('r', 3, '-\t-\tlogo.png'), ('r', 4, ''), ('r', 5, '@2024-02-10T10:00:00Z'), ('r', 6, '2\t0\tsrc/{a => b}/x.ts'), ('r', 7, '1\t1\told.txt => src/a/new.ts'), ('q', 1, '@2023-12-31T23:59:00-05:00'), ('q', 2, '5\t5\tdocs/i.md'), ('r', 8, '4\t4\tsrc/a/z.ts')",
)
ENV = Rows("repo, name, source", "('r', 'A', 'code'), ('r', 'A', 'template'), ('r', 'B', 'code'), ('r', 'C', 'template'), ('r', 'D', 'ci'), ('r', 'D', 'template'), ('q', 'A', 'code')")
PATHS = Rows("path", "('packages/ui/src/b.ts'), ('packages/ui2/c.ts'), ('x.ts'), ('apps/web/app/page.tsx')")
PACKAGES = Rows("dir", "(''), ('packages/ui'), ('apps'), ('apps/web')")
VENDORS = Rows("repo, vendor", "('r', 'stripe'), ('q', 'stripe'), ('r', 'redis'), ('r', 'redis'), ('p', 'stripe')")
ROUTES = Rows("repo, path, has_auth", "('r', '/api/users', false), ('r', '/api/admin/x', false), ('r', '/api/health', false), ('r', '/api/pay', true), ('q', '/api/users', null), ('q', '/api/adminx', false)")
COVERS = Rows("repo, prefix", "('r', '/api/admin'), ('q', '/api/admin/')")
REPOS = Rows("owner, repo, endpoints, monthly_usd, store", "('o', 'r', 3, 1.005, 'pg'), ('o', 'q', 2, 10.25, 'redis'), ('p', 'z', 0, 0.0, 'pg'), ('o', 's', 1, 2.0, 'pg')")
FEATURE = Rows(
    "file, n, line",
    "('f', 1, 'Feature: x'), ('f', 2, '  And early'), ('f', 3, 'Given a <user>'), ('f', 4, ' And b'), ('f', 5, 'Scenario: y'), ('f', 6, '* c'), ('f', 7, 'Then d'), ('f', 8, 'But  e <n> <user>'), ('g', 1, 'When z')",
)
EXAMPLES = Rows("file, row, name1, cell1, name2, cell2", "('f', 1, 'user', 'ann', 'n', '7'), ('f', 2, 'user', 'bob', 'n', '<x>')")
DEFINITIONS = Rows("estate, d, pattern", "('e', 1, '^a user .+$'), ('e', 2, '^a user ann$'), ('e', 3, '^total is ([0-9]+)$'), ('k', 1, '.*')")
TEXTS = Rows("estate, text", "('e', 'a user ann'), ('e', 'total is 12'), ('e', 'total is x'), ('k', 'any'), ('e', 'a user ann')")
LOCATORS = Rows(
    "file, strategy, value",
    "('a', 'id', 'login'), ('b', 'id', 'login'), ('a', 'id', 'x1234'), ('a', 'id', 'a b'), ('a', 'className', 'btn-primary'), ('c', 'className', 'card'), ('a', 'css', 'div > p > a > b'), ('a', 'css', '[data-qa=go]'), ('b', 'name', 'q'), ('c', 'name', 'q'), ('a', 'tagName', 'tr'), ('a', 'xpath', '//a'), ('a', 'linkText', 'Go'), ('a', 'css', '.c789')",
)
ELEMENTS = Rows(
    "el, role, name, label, placeholder, text, test_id, tag, id, name_attr",
    "(1, 'button', 'Save', null, null, null, null, 'button', null, null), (2, null, null, 'Mail', null, null, null, 'input', null, null), (3, null, null, ' ', 'Search', null, null, 'input', null, null), (4, null, null, null, null, 'Hi', null, 'p', null, null), (5, null, null, null, null, 'Hi', 't', 'h2', null, null), (6, 'grid', null, null, null, null, null, 'div', null, null), (7, 'link', null, null, null, null, null, 'a', 'x', null)",
)
NAMES = Rows("page, n, name", "(1, 1, 'x'), (1, 2, 'x'), (1, 3, 'x2'), (2, 1, 'x'), (1, 4, 'x')")
SUITES = Rows("estate, total, todos", "('e', 7, 1), ('e', 5, 0), ('k', 0, 0)")
VISITS = Rows("estate, n, origin", "('e', 1, 'https://api.x.org'), ('e', 2, 'https://api.x.org'), ('e', 3, 'https://b.org'), ('e', 4, 'https://a.org'), ('k', 1, 'https://api.x.org')")
CLEAN_SITE = {c: "200" for c in ("robots_status", "llms_status")} | {c: "0" for c in ("citation_bots_denied", "blocked_agents", "llms_problems", "sitemaps_elsewhere", "sitemap_broken", "source_maps", "missing_headers", "trackers", "forms", "focus_suppressed", "fake_buttons", "third_parties")}
CLEAN_SITE |= {c: "false" for c in ("home_blocked", "googlebot_denied", "env_public", "commercial", "bare_404")} | {c: "true" for c in ("https", "http_redirects", "has_privacy", "has_terms", "has_cookies", "has_banner", "has_refund", "has_deletion", "has_email", "has_phone", "has_company")}
CLEAN_SITE |= {c: "1" for c in ("sitemap_urls", "analytics", "home_ctas", "live_pages", "design_pages", "responsive_pages", "readiness_pages")} | {"random_status": "404"}
SITES = facts("site", CLEAN_SITE, {
    "clean": {},
    "bots": {"citation_bots_denied": "2", "blocked_agents": "1", "googlebot_denied": "true", "llms_problems": "1", "random_status": "200"},
    "files": {"robots_status": "404", "citation_bots_denied": "2", "llms_status": "404", "sitemap_urls": "0", "env_public": "true", "source_maps": "3", "http_redirects": "false", "missing_headers": "1", "sitemap_broken": "2"},
    "shop": {"commercial": "true", "trackers": "1", "has_privacy": "false", "has_terms": "false", "has_cookies": "false", "has_banner": "false", "has_refund": "false", "has_deletion": "false", "analytics": "0", "home_ctas": "5", "third_parties": "8"},
    "bare": {"has_email": "false", "has_phone": "false", "has_company": "false", "home_ctas": "0", "bare_404": "true", "focus_suppressed": "1", "fake_buttons": "2", "robots_status": "cast(null as int)", "sitemaps_elsewhere": "1"},
    "person": {"has_company": "false", "design_pages": "0", "responsive_pages": "0", "readiness_pages": "0"},
    "down": {"live_pages": "0"},
})
CLEAN_DESIGN = {c: "0" for c in "violet_blue gradient_texts emoji_headings tell_fonts border_cards glass icon_rows lucide shadcn fades hover_opacity spacings off_scale serif_italics buzzwords dashes dashes_per_1000 low_contrast".split()} | {c: "false" for c in ("badge", "beam", "dark", "grain")}
DESIGNS = facts("page", CLEAN_DESIGN, {
    "clean": {"spacings": "7", "off_scale": "1", "border_cards": "2", "dashes": "2", "dashes_per_1000": "9"},
    "tells": {c: "50" for c in CLEAN_DESIGN if CLEAN_DESIGN[c] == "0"} | {"badge": "true", "beam": "true", "grain": "true"},
    "dark": {"dark": "true", "low_contrast": "1"},
})
CLEAN_LIVE = {"home": "false", "rendered_words": "100", "raw_words": "100", "rendered_title": "'t'", "raw_title": "'t'", "rendered_h1": "1", "raw_h1": "1", "rendered_json_ld": "0", "raw_json_ld": "0", "load_ms": "8000", "console_errors": "0", "failed_requests": "0", "js_bytes": "1000000"}
LIVES = facts("page", CLEAN_LIVE, {
    "clean": {}, "home": {"home": "true", "raw_words": "29"}, "edge": {"raw_words": "30"}, "short": {"rendered_words": "10", "raw_words": "4"},
    "scripted": {"raw_title": "''", "raw_h1": "0", "rendered_json_ld": "2", "load_ms": "8001", "console_errors": "1", "failed_requests": "2", "js_bytes": "3000001"},
    "lost": {"rendered_words": "cast(null as int)", "rendered_title": "cast(null as varchar(9))", "js_bytes": "1000001"},
})
CLEAN_REPO = {c: "0" for c in "secret_files unverified_webhooks tests_failed open_crons open_routes undocumented root_images other_hosts symlinks".split()} | {c: "1" for c in "test_files env_names workflows packages lockfiles api_routes".split()} | {c: "true" for c in "has_template has_readme rate_limit security_headers".split()}
GAPS = facts("repo", CLEAN_REPO, {
    "clean": {}, "worst": {c: {"0": "1", "1": "0", "true": "false"}[v] for c, v in CLEAN_REPO.items()},
    "mixed": {"has_template": "false", "undocumented": "2", "lockfiles": "0", "rate_limit": "false"},
    "local": {"api_routes": "0", "rate_limit": "false", "security_headers": "false", "undocumented": "1"},
})


def _on(rows: Rows, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(rows.frame(spark))


def _on_two(one: Rows, two: Rows, make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(one.frame(spark), two.frame(spark))


def url_readings(addresses: DataFrame) -> DataFrame:
    url = F.col("url")
    return addresses.select(
        "url", urls.normalised(url).alias("normalised"), urls.origin(url).alias("origin"), urls.crawlable(url, F.lit("https://a.example.com")).alias("crawlable"),
        urls.staging(url).alias("staging"), urls.private_path(F.regexp_extract(url, urls.PATH, 1)).alias("private"),
    )


def outline(spark: SparkSession, folder: str) -> DataFrame:
    examples = EXAMPLES.frame(spark).select("file", "row", F.array("name1", "name2").alias("names"), F.array("cell1", "cell2").alias("cells"))
    return suites.outline_rows(suites.gherkin_steps(FEATURE.frame(spark)), examples)


def derived(elements: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in "role name label placeholder text test_id tag id name_attr".split()]
    return elements.select("el", suites.derived_locator(*columns).alias("strategy"))


QUERIES: dict[str, Query] = {
    "width_overflow": _on(VIEWS, layout.overflow),
    "breakpoint_gaps": _on(VIEWS, layout.breakpoint_gaps),
    "tap_target_small": _on(TARGETS, layout.small_targets),
    "tap_target_overlap": _on(TARGETS, layout.overlapping_targets),
    "clipped_text": _on(CLIPPED, layout.clipped_text),
    "vanished_links": _on(LINKS, layout.vanished_links),
    "oversized_images": _on(IMAGES, layout.oversized_images),
    "violet_blue_gradients": _on(STOPS, design.violet_blue),
    "spacing_off_scale": _on(SPACINGS, design.off_scale),
    "dominant_fonts": _on(FONTS, design.fonts),
    "worst_contrast": _on(PAIRS, design.worst_contrast),
    "third_party_kinds": _on(REQUESTS, readiness.third_parties),
    "policy_links": _on(POLICY_LINKS, readiness.policies),
    "commercial_intent": _on(COPY, lambda d: d.select("id", readiness.commercial(F.col("body")).alias("commercial"))),
    "form_problems": _on(FORMS, readiness.form_problems),
    "site_checks": _on(SITES, lambda d: checks.findings(d, ["site"], checks.SITE)),
    "design_checks": _on(DESIGNS, lambda d: checks.findings(d, ["page"], checks.DESIGN)),
    "live_checks": _on(LIVES, lambda d: checks.findings(d, ["page"], checks.LIVE)),
    "repo_gaps": _on(GAPS, lambda d: checks.findings(d, ["repo"], repo.GAPS)),
    "url_readings": _on(ADDRESSES, url_readings),
    "size_rollup": _on(FILES, repo.size_rollup),
    "git_churn": _on(LOG, repo.churn),
    "commits_by_month": _on(LOG, repo.commits_by_month),
    "env_names": _on(ENV, repo.env_names),
    "nearest_package": _on_two(PATHS, PACKAGES, repo.nearest_package),
    "shared_vendors": _on(VENDORS, repo.shared_vendors),
    "unguarded_routes": _on_two(ROUTES, COVERS, repo.unguarded_routes),
    "portfolio_totals": _on(REPOS, lambda d: repo.portfolio(d.withColumn("stores", F.array("store")).withColumn("monthly_usd", F.col("monthly_usd").cast("double")))),
    "gherkin_steps": _on(FEATURE, suites.gherkin_steps),
    "outline_rows": outline,
    "step_links": _on_two(TEXTS, DEFINITIONS, suites.step_links),
    "std_locators": _on(LOCATORS, lambda d: d.select("file", "strategy", "value", suites.locator_confidence(F.col("strategy"), F.col("value")).alias("confidence"))),
    "locator_histogram": _on(LOCATORS, suites.locator_histogram),
    "duplicate_locators": _on(LOCATORS, suites.shared_locators),
    "derived_locators": _on(ELEMENTS, derived),
    "unique_names": _on(NAMES, suites.unique_names),
    "coverage_pct": _on(SUITES, suites.coverage),
    "base_url_mode": _on(VISITS, suites.base_url),
}

_OVER = f"scroll_width - width > {layout.TOLERANCE}"
_IN = lambda xs: ", ".join(repr(x) for x in xs)
_HEX = lambda c, k: f"('0x' || substr({c}, {2 + 2 * k}, 2))::int / 255.0::double"
_RGB = ", ".join(f"{_HEX('colour', k)} as {n}" for k, n in enumerate("rgb"))
_LIGHT = lambda c: " + ".join(f"{w} * case when {_HEX(c, k)} <= 0.03928 then {_HEX(c, k)} / 12.92 else pow(({_HEX(c, k)} + 0.055) / 1.055, 2.4) end" for k, w in enumerate((0.2126, 0.7152, 0.0722)))
_KIND = "case " + " ".join(f"when regexp_matches(origin, '(?i){p}') then '{k}'" for p, k in readiness.TRACKERS) + " else 'other' end"
_LINK_PATH = "regexp_replace(href, '^[A-Za-z]+://[^/?#]+|[?#].*$', '', 'g')"
_LANG = "case " + " ".join(f"when ending = '{e}' then '{name}'" for e, name in repo.LANGUAGES.items()) + " end"
_BUCKET = f"case when not contains(path, '/') then '(root)' when split_part(path, '/', 1) in ({_IN(repo.CONTAINERS)}) and len(string_split(path, '/')) > 2 then split_part(path, '/', 1) || '/' || split_part(path, '/', 2) else split_part(path, '/', 1) end"
_SOURCES = f"select *, {_LANG} as language, {_BUCKET} as folder from (select *, regexp_extract(path, '[.]([a-z]+)$', 1) as ending from {FILES.sql}) where not regexp_matches(path, '[.]d[.]ts$|[.]min[.](js|css)$')"
_COMMITS = (
    f"select repo, c, {_BUCKET} as folder, try_cast(split_part(line, chr(9), 1) as bigint) as added, try_cast(split_part(line, chr(9), 2) as bigint) as deleted from (select repo, c, line, "
    "regexp_replace(replace(regexp_replace(split_part(line, chr(9), 3), '\\{.* => (.*)\\}', '\\1'), '//', '/'), '^.* => ', '') as path from "
    f"(select *, count(*) filter (where starts_with(line, '@')) over (partition by repo order by n) as c from {LOG.sql}) where regexp_matches(line, '^(\\d+|-)\\t(\\d+|-)\\t.'))"
)
_STEPS = (
    f"select file, n, coalesce(last_value(case when word not in ('And', 'But', '*') then word end ignore nulls) over (partition by file order by n rows between unbounded preceding and current row), 'Given') as keyword, text "
    f"from (select file, n, regexp_extract(trim(line), '{suites.STEP}', 1) as word, trim(regexp_extract(trim(line), '{suites.STEP}', 2)) as text from {FEATURE.sql}) where word <> ''"
)
_CONFIDENCE = (
    "case strategy when 'id' then case when regexp_matches(v, '\\s') or v = '' then 0.3 when regexp_matches(v, '\\d{3,}|^(:|j_id|gwt-uid|ext-|yui_|ember\\d|react-select-\\d)') then 0.5 else 0.95 end "
    "when 'testId' then 0.95 when 'name' then 0.85 when 'text' then 0.85 when 'linkText' then 0.9 when 'partialLinkText' then 0.8 when 'tagName' then 0.5 "
    "when 'className' then case when v = '' then 0.1 when regexp_matches(v, '(^|\\s)(col|row|btn|mt|mb|p|m|px|py|text|d|w|h|flex|grid|bg)-') then 0.5 else 0.65 end "
    "when 'css' then case when regexp_matches(v, '^\\[(data-testid|data-test|data-qa|data-cy)=[^\\]]+\\]$') then 0.95 when regexp_matches(v, ':nth-child\\(|:nth-of-type\\(|>\\s*\\w+\\s*>\\s*\\w+\\s*>') then 0.5 "
    "when regexp_matches(v, '\\d{3,}') then 0.55 else 0.8 end end::double"
)
_RATED = f"select file, strategy, value, {_CONFIDENCE} as confidence from (select *, trim(value) as v from {LOCATORS.sql})"
_INSIDE = lambda o, i: f"({i}.x >= {o}.x and {i}.y >= {o}.y and {i}.x + {i}.w <= {o}.x + {o}.w and {i}.y + {i}.h <= {o}.y + {o}.h)"

ORACLE_SQL: dict[str, str] = {
    "width_overflow": f"select page, width, scroll_width - width as overflow_px from {VIEWS.sql} where {_OVER}",
    "breakpoint_gaps": f"with v as (select page, width, {_OVER} as o from {VIEWS.sql}) select page, width from v where width in ({_IN(layout.BETWEEN)}) and o "
    f"and not coalesce((select arg_max(o, width) from v u where u.page = v.page and u.width < v.width and u.width in ({_IN(layout.NAMED)})), false) "
    f"and not coalesce((select arg_min(o, width) from v u where u.page = v.page and u.width > v.width and u.width in ({_IN(layout.NAMED)})), false)",
    "tap_target_small": f"select page, width, sel, w, h from {TARGETS.sql} where w < {layout.LEAST_TAP} or h < {layout.LEAST_TAP}",
    "tap_target_overlap": f"with t as (select * from {TARGETS.sql}) select a.page, a.width, a.sel as a, b.sel as b from t a join t b on a.page = b.page and a.width = b.width and a.n < b.n "
    f"and a.x + a.w > b.x and b.x + b.w > a.x and a.y + a.h > b.y and b.y + b.h > a.y where not {_INSIDE('a', 'b')} and not {_INSIDE('b', 'a')}",
    "clipped_text": f"select page, width, sel from {CLIPPED.sql} where not ellipsis",
    "vanished_links": f"with l as (select * from {LINKS.sql}) select page, href, text from l w where width = 1440 and region <> 'nav' and href <> '' and page in (select page from l where width = 360) "
    "and not exists (select 1 from l s where s.width = 360 and s.page = w.page and s.href = w.href)",
    "oversized_images": f"select page, src, floor(natural_width / render_width * 10 + 0.5) / 10 as ratio from {IMAGES.sql} where render_width > 0 and natural_width / render_width >= 2",
    "violet_blue_gradients": f"with c as (select gradient, {_RGB} from {STOPS.sql}), d as (select *, greatest(r, g, b) as hi, greatest(r, g, b) - least(r, g, b) as d from c), h as (select gradient, "
    "floor(case when d = 0 then 0 when hi = r then (g - b) / d % 6 when hi = g then (b - r) / d + 2 else (r - g) / d + 4 end * 60 + 0.5) as h from d where hi > 0 and d / hi >= 0.15), "
    "w as (select gradient, case when h < 0 then h + 360 else h end as h from h) select gradient, count(*) as hues from w group by 1 having bool_or(h between 250 and 290) and bool_or(h between 200 and 250)",
    "spacing_off_scale": f"with c as (select page, step, count(*) filter (where value % step <> 0) as off, count(*) as n from {SPACINGS.sql} cross join (values (4), (5), (6), (8)) s(step) group by 1, 2) "
    "select page, step, floor(off / n * 100 + 0.5) / 100 as share from c qualify row_number() over (partition by page order by off, step) = 1",
    "dominant_fonts": f"with f as (select *, sum(n) over (partition by page) as total from {FONTS.sql}) select page, family, floor(n / total * 100 + 0.5) / 100 as share, lower(family) in ({_IN(design.TELL_FONTS)}) as tell "
    "from f qualify row_number() over (partition by page order by n desc, family) = 1",
    "worst_contrast": f"with l as (select *, {_LIGHT('fg')} as a, {_LIGHT('bg')} as b from {PAIRS.sql}), r as (select *, floor((greatest(a, b) + 0.05) / (least(a, b) + 0.05) * 100 + 0.5) / 100 as ratio from l) "
    "select page, row_number() over (partition by page order by ratio, n) as position, n, ratio from r where ratio < case when size >= 24 or (bold and size >= 18.66) then 3.0 else 4.5 end qualify position <= 10",
    "third_party_kinds": f"select *, kind in ({_IN(readiness.GATED)}) as tracking from (select distinct site, origin, {_KIND} as kind from {REQUESTS.sql})",
    "policy_links": "select site, policy, arg_min(href, n) as href from ("
    + " union all ".join(f"select site, n, href, '{k}' as policy from {POLICY_LINKS.sql} where regexp_matches({_LINK_PATH}, '(?i){p}') or coalesce(regexp_matches(text, '(?i){p}'), false)" for k, p in readiness.POLICIES.items())
    + ") group by 1, 2",
    "commercial_intent": f"select id, coalesce(regexp_matches(body, '{readiness.COMMERCE}'), false) as commercial from {COPY.sql}",
    "form_problems": f"with f as (select * from {FORMS.sql} where fields > 0) select form, 'unverifiable-submit' as kind from f where not has_action and not has_handler union all select form, 'no-validation' from f where novalidate and required = 0 "
    "union all select form, 'no-required' from f where not novalidate and required = 0 union all select form, 'unlabelled' from f where labelled < fields union all select form, 'no-spam-protection' from f where not captcha and not honeypot and fields >= 2 and not password",
    "site_checks": checks.findings_sql(SITES.sql, ["site"], checks.SITE),
    "design_checks": checks.findings_sql(DESIGNS.sql, ["page"], checks.DESIGN),
    "live_checks": checks.findings_sql(LIVES.sql, ["page"], checks.LIVE),
    "repo_gaps": checks.findings_sql(GAPS.sql, ["repo"], repo.GAPS),
    "url_readings": "select * from (values ('https://A.example.com/x/#top', 'https://a.example.com/x', 'https://a.example.com', true, false, false), ('http://a.example.com', 'http://a.example.com/', 'http://a.example.com', false, false, false), "
    "('https://a.example.com/?q=1#z', 'https://a.example.com/?q=1', 'https://a.example.com', true, false, false), ('mailto:a@b.c', null, '', false, false, false), ('https://a.example.com/pic.PNG', 'https://a.example.com/pic.PNG', 'https://a.example.com', false, false, false), "
    "('http://localhost:3000/login', 'http://localhost:3000/login', 'http://localhost:3000', false, true, true), ('https://x.vercel.app/admin/', 'https://x.vercel.app/admin', 'https://x.vercel.app', false, true, true), "
    "('https://staging.x.org/loginx', 'https://staging.x.org/loginx', 'https://staging.x.org', false, true, false)) t(url, normalised, origin, crawlable, staging, private)",
    "size_rollup": f"with s as ({_SOURCES}) select language, folder, count(*) as files, coalesce(sum(lines), 0)::bigint as lines from s where language is not null group by grouping sets ((language), (folder), ())",
    "git_churn": f"with c as ({_COMMITS}), f as (select repo, folder, count(distinct c) as commits, coalesce(sum(added), 0)::bigint as added, coalesce(sum(deleted), 0)::bigint as deleted from c group by 1, 2) "
    "select * from f qualify row_number() over (partition by repo order by added + deleted desc, folder) <= 25",
    "commits_by_month": f"select repo, substr(line, 2, 7) as month, count(*) as commits from {LOG.sql} where starts_with(line, '@') group by 1, 2 qualify row_number() over (partition by repo order by month desc) <= 12",
    "env_names": f"with e as (select * from {ENV.sql}), n as (select repo, name, bool_or(source = 'code') as in_code, bool_or(source = 'template') as in_template, bool_or(source = 'ci') as ci from e group by 1, 2) select repo, name, in_code, in_template, "
    "case when repo not in (select repo from e where source = 'template') then 'no-template' when in_code and not in_template then 'undocumented' when in_template and not in_code and not ci then 'unused' else 'documented' end as status from n",
    "nearest_package": f"select path, arg_max(dir, length(dir)) as package from {PATHS.sql} join (select * from {PACKAGES.sql}) p on dir = '' or starts_with(path, dir || '/') group by 1",
    "shared_vendors": f"select vendor, string_agg(distinct repo, ',' order by repo) as repos, count(distinct repo) as n_repos from {VENDORS.sql} group by 1 having count(distinct repo) > 1",
    "unguarded_routes": f"select repo, path from {ROUTES.sql} where not coalesce(has_auth, false) and not regexp_matches(path, '(?i)/(auth|health|healthz|webhooks?|cron)(/|$)') "
    f"and not exists (select 1 from (select repo as r, rtrim(prefix, '/') as p from {COVERS.sql}) c where c.r = repo and (path = p or starts_with(path, p || '/')))",
    "portfolio_totals": f"select owner, count(*) as repos, sum(endpoints)::bigint as endpoints, floor(sum(monthly_usd::double) * 100 + 0.5) / 100 as monthly_usd, string_agg(distinct store, ',' order by store) as stores from {REPOS.sql} group by 1",
    "gherkin_steps": _STEPS,
    "outline_rows": f"select s.file, row, n, replace(replace(text, '<' || name1 || '>', cell1), '<' || name2 || '>', cell2) as text from ({_STEPS}) s join (select * from {EXAMPLES.sql}) e on s.file = e.file",
    "step_links": f"with s as (select distinct estate, text from {TEXTS.sql}) select s.estate, s.text, min(d) as d from s left join (select * from {DEFINITIONS.sql}) p on p.estate = s.estate and regexp_matches(s.text, p.pattern) group by 1, 2",
    "std_locators": _RATED,
    "locator_histogram": f"with r as ({_RATED}) select b.bin, count(r.confidence) as n from (values ('<0.4', 0.0, 0.4), ('0.4-0.6', 0.4, 0.6), ('0.6-0.8', 0.6, 0.8), ('0.8-0.9', 0.8, 0.9), ('>=0.9', 0.9, 9.0)) b(bin, lo, hi) "
    "left join r on r.confidence >= b.lo::double and r.confidence < b.hi::double group by 1",
    "duplicate_locators": f"select strategy, value, count(distinct file) as n_files from {LOCATORS.sql} group by 1, 2 having count(distinct file) > 1",
    "derived_locators": f"with e as (select el, tag, {', '.join(f'''coalesce(trim({c}), '') as {c}''' for c in 'role name label placeholder text test_id id name_attr'.split())} from {ELEMENTS.sql}) select el, case when role <> '' and name || label || text <> '' then 'role' "
    "when label <> '' then 'label' when placeholder <> '' then 'placeholder' when text <> '' and tag in ('a', 'button', 'summary', 'label', 'span', 'div', 'li', 'p') then 'text' when test_id <> '' then 'testid' "
    "when role not in ('', 'link', 'button') and id || name_attr = '' then 'role' else 'css' end as strategy from e",
    "unique_names": f"select page, n, case when k > 1 then name || k else name end as name from (select *, row_number() over (partition by page, name order by n) as k from {NAMES.sql})",
    "coverage_pct": f"select estate, sum(total)::bigint as total, sum(total - todos)::bigint as converted, case when sum(total) > 0 then floor(1000.0::double * sum(total - todos) / sum(total) + 0.5) / 10 else 0.0 end as percent from {SUITES.sql} group by 1",
    "base_url_mode": f"with c as (select estate, origin, count(*) as k, min(n) as first from {VISITS.sql} group by 1, 2) select estate, origin from c qualify row_number() over (partition by estate order by contains(origin, '//api.'), k desc, first) = 1",
}
