"""Named queries on test runs, converted estates, paths and names; their SQL or expected rows are written on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import names
from siltstone.operators import tester
from .measured import Query, Rows

RUNS = Rows("run, start_url", "('r1', 'https://a.test/'), ('r2', 'https://b.test/'), ('r3', 'https://c.test/')")
RUN_PAGES = Rows(
    "run, path, load_ms, bare_forms, bare_controls, images_without_alt, has_h1, has_landmark",
    "('r1', '/', 18, 0, 0, 0, true, true), ('r1', '/slow', 3001, 1, 1, 2, true, true), ('r1', '/slower', 9001, 2, 5, 1, false, true), ('r1', '/exact', 3000, 0, 1, 0, true, false), ('r1', '/verge', 9000, 0, 3, 0, true, true), ('r3', '/', 1201, 0, 0, 0, false, false)",
)
BROKEN = Rows("run, url, status, error, referrer", "('r1', 'https://a.test/x', 404, null, '/'), ('r1', 'https://a.test/y', 503, null, '/slow'), ('r1', 'https://a.test/z', 0, 'net::ERR', '/'), ('r2', 'https://b.test/', 0, null, 'start')")
ERRORS = Rows("run, path, n, message", "('r1', '/', 1, 'one'), ('r1', '/slow', 1, 'a'), ('r1', '/slow', 4, 'd'), ('r1', '/slow', 3, 'c'), ('r1', '/slow', 2, 'b')")
REQUESTS = Rows("run, path, n, status, method, url", "('r1', '/', 1, 404, 'GET', '/p.png'), ('r1', '/slow', 1, 404, 'GET', '/q'), ('r1', '/slow', 2, 500, 'POST', '/r')")
ELEMENTS = Rows("run, path, n, confidence", "('r1', '/', 1, 'high'), ('r1', '/', 2, 'low'), ('r1', '/slow', 1, 'low'), ('r1', '/slow', 2, 'medium'), ('r1', '/slow', 3, 'high'), ('r3', '/', 1, 'low')")

WEAK = Rows("estate, strategy, value, confidence, note, code", "('e', 'xpath', '//div[3]/a', 0.3, 'positional', 'a()'), ('e', 'css', '.c', 0.4, null, 'b()'), ('f', 'css', '#' || repeat('x', 100), 0.59, null, 'c()')")
TODOS = Rows("estate, raw, place", "('e', 'driver.magic()', 'LoginTest'), ('f', repeat('y', 81), 't')")
WAITS = Rows("estate, raw", "('e', 'Thread.sleep(500);')")
UNTESTED = Rows("estate, test", "('e', 'logs in'), ('f', 'opens')")
PLACES = Rows("estate, strategy, value, file, n", "('e', 'id', 'user', 'B.java', 1), ('e', 'id', 'user', 'A.java', 2), ('e', 'id', 'user', 'B.java', 3), ('e', 'id', 'pass', 'A.java', 4), ('f', 'css', repeat('z', 70), 'a.py', 1), ('f', 'css', repeat('z', 70), 'b.py', 2)")

# path, whether it may hold credentials, whether it is of a test: by the definitions of these kinds
PATHS = [
    ("a/.env", True, False), ("a/.env.local", True, False), (".env.example", False, False), ("prod.env", True, False), ("deploy/Server.PEM", True, False), ("credentials", True, False), ("secrets.yaml", True, False),
    ("service-account-1.json", True, False), ("serviceaccount.json", True, False), ("home/.npmrc", True, False), ("src/secretary.ts", False, False), ("src/env.ts", False, False), ("tests/a.ts", False, True),
    ("src/__tests__/b.js", False, True), ("src/a.test.tsx", False, True), ("src/a.spec.mjs", False, True), ("pkg/test_a.py", False, True), ("pkg/a_test.go", False, True), ("latest/a.ts", False, False), ("e2e/.env.sample", False, True),
]
# glob, path, whether it matches
GLOBS = [
    ("**/*.java", "A.java", True), ("**/*.java", "x/y/A.java", True), ("*.java", "x/A.java", False), ("src/**", "src/a/b", True), ("a?.ts", "ab.ts", True), ("a?.ts", "a/.ts", False), ("*.{ts,js}", "a.js", True),
    ("*.{ts,js}", "a.jsx", False), ("a.b", "axb", False), ("x/**/y", "x/y", True), ("x/**/y", "x/1/2/y", True), ("(a)+[b]", "(a)+[b]", True), ("**", "any/thing", True), ("*", "", True), ("a{b", "a{b", True), ("a}", "a}", True), ("a}{b", "a}{b", True), ("x.{a*,b}", "x.a*", True), ("x.{a*,b}", "x.ac", False), ("x.{a.b}", "x.a-b", False), ("{}", "", True), ("a", "a\n", False), ("\\d/*", "/d/x", True),
]


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tester.run_findings(*(t.frame(spark) for t in (RUNS, RUN_PAGES, BROKEN, ERRORS, REQUESTS, ELEMENTS)))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tester.run_summary(RUN_PAGES.frame(spark), ELEMENTS.frame(spark))


def estate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tester.estate_findings(*(t.frame(spark) for t in (WEAK, TODOS, WAITS, UNTESTED, PLACES)))


def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return spark.createDataFrame([(p,) for p, *_ in PATHS], "path string").select("path", names.secret_like(path).alias("secret_like"), names.test_path(path).alias("test"))


def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(g, p) for g, p, _ in GLOBS], "pattern string, path string")
    return rows.select("pattern", "path", F.rlike("path", names.glob_regex(F.col("pattern"))).alias("matches"))


def _text(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool | int) else "'" + str(value).replace("'", "''") + "'"


def _rows(columns: str, rows: list[tuple]) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({columns})"


_PLURAL = "case when {0} = 1 then '' else 's' end"

QUERIES: dict[str, Query] = {q.__name__: q for q in (run_findings, run_summary, estate_findings, path_kinds, glob_matches)}

ORACLE_SQL: dict[str, str] = {
    "run_findings": f"""
with p as (select * from {RUN_PAGES.sql}), b as (select * from {BROKEN.sql}), e as (select * from {ERRORS.sql}), q as (select * from {REQUESTS.sql}), l as (select * from {ELEMENTS.sql})
select run, 'high' as severity, 'navigation' as category, 'Navigation failed: ' || url as title, coalesce(error, 'unknown error') || ' (linked from ' || referrer || ')' as detail from b where status = 0
union all select run, case when status < 500 then 'medium' else 'high' end, 'broken-link', 'Broken link (' || status || '): ' || url, 'Linked from ' || referrer from b where status <> 0
union all select run, 'medium', 'console-error', count(*) || ' console error' || {_PLURAL.format('count(*)')} || ' on ' || path, array_to_string(list(message order by n)[1:3], ' | ') from e group by run, path
union all select run, case when max(status) >= 500 then 'medium' else 'low' end, 'failed-request', count(*) || ' failed network request' || {_PLURAL.format('count(*)')} || ' on ' || path, array_to_string(list(status || ' ' || method || ' ' || url order by n)[1:3], ' | ') from q group by run, path
union all select run, case when load_ms > 9000 then 'high' else 'medium' end, 'performance', 'Slow page load (' || load_ms || ' ms) on ' || path, 'Threshold is 3000 ms' from p where load_ms > 3000
union all select run, 'medium', 'accessibility', bare_forms || ' form' || {_PLURAL.format('bare_forms')} || ' with unlabeled controls on ' || path, bare_controls || ' control' || {_PLURAL.format('bare_controls')} || ' lack a <label>, aria-label or placeholder; screen readers and getByLabel() cannot target them' from p where bare_forms > 0
union all select run, 'low', 'accessibility', bare_controls || ' unlabeled form control' || {_PLURAL.format('bare_controls')} || ' outside a form on ' || path, null from p where bare_forms = 0 and bare_controls > 0
union all select run, 'low', 'accessibility', images_without_alt || ' image' || {_PLURAL.format('images_without_alt')} || ' without alt text on ' || path, 'Add alt="" for decorative images or a description for meaningful ones' from p where images_without_alt > 0
union all select run, 'low', 'structure', 'No <h1> on ' || path, 'Every page should have exactly one level-1 heading; the smoke test cannot assert on a heading until one exists' from p where not has_h1
union all select run, 'low', 'accessibility', 'No landmark regions on ' || path, 'Add <main>, <nav>, <header> or <footer> (or the equivalent roles) so assistive tech can navigate by region' from p where not has_landmark
union all select run, 'info', 'testability', count(*) filter (confidence = 'low') || '/' || count(*) || ' interactive elements on ' || path || ' lack an accessible name or test id', 'Page-object locators fell back to CSS; add accessible names or data-testid attributes' from l group by run, path having 2 * count(*) filter (confidence = 'low') >= count(*)
union all select run, 'critical', 'navigation', 'No page could be rendered', 'The start URL ' || start_url || ' did not produce a renderable page; check the URL, network access and authentication' from {RUNS.sql} where run not in (select run from p)""",
    "run_summary": f"select run, count(*) as pages, count(*) filter (load_ms > 3000) as slow, floor(avg(load_ms) + 0.5)::bigint as avg_ms, coalesce(any_value(k), 0) as locators from {RUN_PAGES.sql} left join (select run, count(*) as k from {ELEMENTS.sql} group by 1) using (run) group by 1",
    "estate_findings": f"""
select estate, case when confidence < 0.4 then 'high' else 'medium' end as severity, 'locator' as category, 'Brittle locator (' || strategy || '): ' || left(value, 80) as title, coalesce(note, 'low confidence') || ' -> generated ' || code as detail from {WEAK.sql}
union all select estate, 'medium', 'conversion', 'Unconvertible: ' || left(raw, 80), 'in ' || place from {TODOS.sql}
union all select estate, 'low', 'flakiness', 'Hard wait removed: ' || left(raw, 80), 'Playwright auto-waits; the sleep was replaced with a NOTE comment.' from {WAITS.sql}
union all select estate, 'low', 'quality', 'Test without assertion: ' || test, null from {UNTESTED.sql}
union all select estate, 'low', 'duplication', 'Locator duplicated in ' || count(*) || ' files: ' || strategy || '=' || left(value, 60), string_agg(file, ', ' order by n) from (select estate, strategy, value, file, min(n) as n from {PLACES.sql} group by all) group by estate, strategy, value having count(*) > 1""",
    "path_kinds": _rows("path, secret_like, test", PATHS),
    "glob_matches": _rows("pattern, path, matches", GLOBS),
}
