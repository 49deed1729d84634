"""Named queries on the readiness and design of sites, by facts read from their pages, and on all failed checks; their SQL reads the facts by patterns and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import BUZZWORDS
from ..operators import checks, elements, facts, rules
from ..operators import readiness as ready
from ..sources.tables import table, written
from .pages import _BODY, _CLEAN, _HOST, _PATH, _SCRIPTS, _TOKENS, _WEIGHT, _WITH, _plain

Query = Callable[[SparkSession, str], DataFrame]
SITE_COLUMNS = [
    "host", *(f"has_{p}" for p in ready.POLICIES), "commercial", "has_banner", "analytics", "fake_buttons", "focus_suppressed", "forms", "has_email", "has_phone", "has_company", "home_ctas", "third_parties", "trackers",
]
SIGNS = ["emoji_headings", "lucide", "shadcn", "buzzwords", "dashes", "dashes_per_1000", "hover_opacity"]


def page_facts(spark: SparkSession, folder: str) -> DataFrame:
    return written(facts.page_facts(table(spark, folder, "pages")), "facts")


def site_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each host."""
    return facts.site_facts(page_facts(spark, folder)).select(*SITE_COLUMNS)


def site_readiness(spark: SparkSession, folder: str) -> DataFrame:
    """Readiness checks that a host fails."""
    return facts.site_findings(page_facts(spark, folder))


def design_signs(spark: SparkSession, folder: str) -> DataFrame:
    """Signs of templates on each page, counted."""
    return facts.page_facts(table(spark, folder, "pages")).select("page_id", "host", *SIGNS)


def _checked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The view of the pages and the failed checks of their sites; view and facts are written once."""
    pages = table(spark, folder, "pages")
    view = written(elements.page_view(pages), "view")
    return view, rules.failed_checks(pages, view, page_facts(spark, folder))


def site_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All checks that a host fails."""
    return _checked(spark, folder)[1]


def area_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and grades of each host by area."""
    return rules.area_scores(*_checked(spark, folder))


def fix_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What to mend first on each host."""
    return rules.fix_plan(_checked(spark, folder)[1])


QUERIES: dict[str, Query] = {q.__name__: q for q in (site_facts, site_readiness, design_signs, site_findings, area_scores, fix_plan)}

# --- the same in SQL

_ANCHORS = "regexp_extract_all(c, '(?is)<a\\s.*?(?:</a>|$)')"
_HREF = "regexp_extract(x, '(?i)\\shref=[\\x22\\x27]?([^\\x22\\x27>\\s]*)', 1)"
_TEXT = "regexp_replace(x, '<[^>]*>', '', 'g')"
_any = lambda test: f"len(list_filter({_ANCHORS}, lambda x: {test})) > 0"
_policy = lambda p: _any(f"regexp_matches(regexp_replace({_HREF}, '^[A-Za-z]+://[^/?#]+|[?#].*$', '', 'g'), '(?i){p}') or regexp_matches({_TEXT}, '(?i){p}')")
_SOURCES = "regexp_extract_all(c, '(?is)<(?:script|iframe)\\s[^>]*src=[\\x22\\x27]?([^\\x22\\x27>\\s]*)', 1) || regexp_extract_all(c, '(?is)<link\\s[^>]*rel=[\\x22\\x27]?(?:stylesheet|preconnect)[^>]*href=[\\x22\\x27]?([^\\x22\\x27>\\s]*)', 1)"
_STYLES = "array_to_string(regexp_extract_all(coalesce(html, ''), '(?is)<style[^>]*>(.*?)(?:</style|$)', 1), chr(10))"
_FACTS = f"""
    with {_TOKENS},
    foot as (select page_id, string_agg(case when step = 0 then tok else ' ' end, '' order by k) filter (in_footer > 0 or name = 'footer') as foot,
        count(*) filter (((is_link or (name = 'button' and step = 1)) and in_nav = 0 and in_header = 0)) as ctas from regions group by 1),
    c as (select page_id, url, html, {_CLEAN} as c, {_SCRIPTS} as inline, {_STYLES} as styles from pages),
    t as (select c.*, {_plain(_BODY)} as said, {_SOURCES} as loaded, left({_plain("coalesce(foot, " + _BODY + ")")}, {facts.FOOTER}) as foot, coalesce(ctas, 0) as ctas from c left join foot using (page_id)),
    origins as (select page_id, lower(regexp_extract(u, '^(?i:https?)://[^/?#]+', 0)) as origin, lower(regexp_extract(url, '^(?i:https?)://[^/?#]+', 0)) as own from (select page_id, url, unnest(loaded) as u from t)),
    page_facts as (select page_id, {_HOST} as host, {_PATH} as path, {", ".join(f"{_policy(p)} as has_{name}" for name, p in ready.POLICIES.items())},
        coalesce(regexp_matches(said, '{ready.COMMERCE}'), false) or {_any(f"regexp_matches({_HREF}, '{ready.COMMERCE_HREF}')")} as commercial,
        {" + ".join(f"regexp_matches(array_to_string(loaded, ' ') || chr(10) || inline, '{p}')::bigint" for p in facts.ANALYTICS)} as analytics,
        regexp_matches(array_to_string(loaded, ' ') || ' ' || regexp_extract(c, '(?is)<html[^>]*class=[\\x22\\x27]([^\\x22\\x27]*)', 1), '{facts.CONSENT}') as has_banner,
        len(regexp_extract_all(c, '(?i)<form[\\s>]')) as forms, case when ctas = 0 then 0 end as home_ctas,
        regexp_matches(foot, '{facts.EMAIL}') or {_any(f"starts_with({_HREF}, 'mailto:')")} as has_email, regexp_matches(foot, '{facts.PHONE}') or {_any(f"starts_with({_HREF}, 'tel:')")} as has_phone,
        regexp_matches(foot, '{facts.COMPANY}') as has_company,
        case when regexp_matches(styles, ':focus-visible[^{{]*\\{{[^}}]*outline') then 0 else len(regexp_extract_all(replace(styles, ':focus-visible', ''), ':focus[^{{]*\\{{[^}}]*outline\\s*:\\s*(?:none|0)')) end as focus_suppressed,
        len(list_filter(regexp_extract_all(c, '(?is)<(?:div|span|li)\\s[^>]*onclick[^>]*'), lambda x: not regexp_matches(x, '(?i)role=.?button|tabindex'))) as fake_buttons, said, c, styles from t)
"""
_SITES = f"""{_FACTS}, site_facts as (
    select host, {", ".join(f"bool_or({c}) as {c}" for c in (*(f"has_{p}" for p in ready.POLICIES), "commercial", "has_banner"))}, sum(analytics)::bigint as analytics, sum(fake_buttons)::bigint as fake_buttons,
        sum(focus_suppressed)::bigint as focus_suppressed, sum(forms)::bigint as forms, {", ".join(f"arg_min({c}, (path <> '/', page_id)) as {c}" for c in ("has_email", "has_phone", "has_company"))},
        max(home) as home_ctas, any_value(third_parties) as third_parties, any_value(trackers) as trackers
    from (select *, case when row_number() over (partition by host order by path <> '/', page_id) = 1 then home_ctas end as home,
        (select count(distinct origin) from origins o join page_facts q using (page_id) where q.host = p.host and origin not in ('', own)) as third_parties,
        (select count(distinct origin) from origins o join page_facts q using (page_id) where q.host = p.host and origin not in ('', own)
            and regexp_matches(origin, '(?i){"|".join(p for p, kind in ready.TRACKERS if kind in ready.GATED)}')) as trackers from page_facts p) group by host)
"""

ORACLE_SQL: dict[str, str] = {
    "site_facts": _SITES + f"select {', '.join(SITE_COLUMNS)} from site_facts",
    # no given page has a form
    "site_readiness": _SITES + checks.findings_sql("site_facts", ["host"], [c for c in facts.SITE_CHECKS if c not in facts.FORMS]),
    "design_signs": f"""{_FACTS}, heads as (select page_id, count(*) as n from (select page_id, unnest(regexp_extract_all(c, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]', 1)) as h from page_facts)
            where regexp_matches(h, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{FE0F}}\\x{{2190}}-\\x{{21FF}}\\x{{2B00}}-\\x{{2BFF}}]') group by 1),
        w as (select *, len(regexp_extract_all(said, '—')) as dashes, len(regexp_extract_all(said, '\\S*[A-Za-z0-9]\\S*')) as words from page_facts)
        select w.page_id, host, coalesce(n, 0) as emoji_headings, len(regexp_extract_all(c, '(?i)<svg\\s[^>]*class=.[^\\x22\\x27]*lucide')) as lucide,
            len(regexp_extract_all(c, '(?i)class=.[^\\x22\\x27]*\\b(?:bg-background|text-foreground|bg-muted|text-muted-foreground|border-input|ring-offset-background|bg-primary|text-primary-foreground)\\b')) as shadcn,
            {" + ".join(f"contains(lower(said), '{b}')::bigint" for b in BUZZWORDS)} as buzzwords, dashes, case when words > 0 then floor(dashes / words * 10000 + 0.5) / 10 else 0.0 end as dashes_per_1000,
            len(list_filter(string_split(styles, '}}'), lambda r: regexp_matches(r, ':hover[^{{]*\\{{[^}}]*opacity\\s*:') and regexp_matches(r, '(?i)button|\\.btn|a[:.\\s]'))) as hover_opacity
        from w left join heads using (page_id)""",
}

_ALL = f"""{_WITH}, ready as (select * from ({ORACLE_SQL["site_readiness"]})), signs as (select * from ({ORACLE_SQL["design_signs"]})),
    looks as ({checks.findings_sql("signs", ["page_id", "host"], facts.DESIGN_CHECKS)}),
    every as (select * from site union all select host, rule, area, severity, 0 from ready union all select host, rule, area, arg_max(severity, {_WEIGHT}), count(*) from looks group by 1, 2, 3)
"""
_EFFORT = f"case when rule in ({', '.join(map(repr, rules.QUICK))}) then 'quick' when rule in ({', '.join(map(repr, rules.PROJECT))}) then 'project' else 'medium' end"
ORACLE_SQL |= {
    "site_findings": _ALL + "select * from every",
    "area_scores": f"""{_ALL}, lost as (select host, area, sum(case when area = 'design' then 6 else {_WEIGHT} end) as lost from every group by all),
        scored as (select h.host, a.area, greatest(0, 100 - coalesce(lost, 0))::bigint as score from (select distinct host from page_view) h
            cross join (values {", ".join(f"('{a}')" for a in rules.AREAS)}) a(area) left join lost on lost.host = h.host and lost.area = a.area)
        select *, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade from scored""",
    "fix_plan": f"""{_ALL}, plan as (select *, {_EFFORT} as effort from every) select host, row_number() over (partition by host order by {_WEIGHT} desc,
        list_position({rules.EFFORTS}, effort), list_position({rules.AREAS}, area), rule) as position, rule, effort, n_pages from plan""",
}
