"""Named queries on what stands on pages and how pages link; their SQL reads the html by patterns and windows instead of a stack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text
from ..functions.markup import BLOCKS
from ..operators import checks, crawl, elements, rules
from ..sources.tables import table, written

Query = Callable[[SparkSession, str], DataFrame]


def _on_view(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(elements.page_view(table(spark, folder, "pages")))


def _on_both(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """For what reads the view several times: it is written once."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        pages = table(spark, folder, "pages")
        return make(pages, written(elements.page_view(pages), "view"))

    return query


def _on_pages(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(table(spark, folder, "pages"))


QUERIES: dict[str, Query] = {
    "page_view": _on_view(lambda view: view),
    "page_rules": _on_both(lambda pages, view: rules.page_findings(view)),
    "findings_by_severity": _on_both(lambda pages, view: rules.severity_counts(rules.page_findings(view))),
    "shared_values": _on_view(rules.shared_values),
    "duplicate_titles": _on_view(rules.shared_titles),
    "link_regions": _on_pages(elements.link_regions),
    "heading_outline": _on_pages(elements.headings),
    "block_texts": _on_pages(elements.blocks),
    "page_crawl": _on_pages(crawl.page_crawl),
}

# --- the same in SQL

_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
#: Comments and what scripts, styles and their like hold are left out; their tags stay. A tag that the page's end cuts off goes too.
_CLEAN = "regexp_replace(coalesce(html, ''), '(?is)<!--.*?(-->|$)', '', 'g')"
for _tag in ("script", "style", "noscript", "template", "textarea"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)(<{_tag}\\b[^>]*>).*?(</{_tag}\\s*>|$)', '\\1', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '<[^>]*$', '')"


def _plain(text: str) -> str:
    """Entities of the given pages read, white space squeezed."""
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{name}', '{char}')"
    return f"trim(regexp_replace(regexp_replace({text}, '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


def _first(pattern: str, body: str = "c") -> str:
    return f"regexp_extract({body}, '{pattern}', 1)"


def _count(pattern: str, body: str = "c") -> str:
    return f"len(regexp_extract_all({body}, '{pattern}'))"


def _valued(tag: str, key: str, value: str) -> str:
    """The value of attribute `value` of the first `tag` with attribute `key`, in either order and any quoting."""
    found = f"regexp_extract(c, '(?is)<{tag}\\b[^>]*\\s{key}[\\s/>][^>]*|<{tag}\\b[^>]*\\s{key}>?', 0)"
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({found}, '(?is)\\s{value}\\s*=\\s*{quote}', 1), '')" for quote in ("\\x22([^\\x22]*)", "\\x27([^\\x27]*)", "([^\\s\\x22\\x27>]+)")) + ", '')"


_meta = lambda name: _plain(_valued("meta", f"{'property' if ':' in name else 'name'}=[\\x22\\x27]?{name}[\\x22\\x27]?", "content"))
_CANONICAL = _valued("link", "rel=[\\x22\\x27]?canonical[\\x22\\x27]?", "href")
_ROBOTS = f"concat_ws(', ', nullif({_meta('robots')}, ''), nullif({_meta('googlebot')}, ''))"
_BLOCK = "|".join(sorted(BLOCKS))
_BODY = "regexp_replace(regexp_replace(regexp_extract(c, '(?is)<body\\b[^>]*>(.*)', 1), '(?i)</?(?:br|" + _BLOCK + ")(?:\\s[^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g')"
_SCRIPTS = "array_to_string(regexp_extract_all(coalesce(html, ''), '(?is)<script[^>]*>(.*?)(?:</script|$)', 1), chr(10))"
_NAMED = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1))"
_STAGING = " or ".join(
    f"regexp_matches(regexp_replace({_NAMED}, ':\\d+$', ''), '{p}')"
    for p in (
        "^(localhost|127\\.\\d+\\.\\d+\\.\\d+|10\\.\\d+\\.\\d+\\.\\d+|192\\.168\\.\\d+\\.\\d+|\\[::1\\])$", "(^|\\.)(staging|preview|dev|test)\\.",
        "\\.(vercel\\.app|netlify\\.app|pages\\.dev|lovable\\.app|lovableproject\\.com|bolt\\.host|replit\\.app|github\\.io|web\\.app|onrender\\.com)$",
    )
)
_PRIVATE = "login|signin|sign-in|log-in|register|signup|sign-up|auth|account|dashboard|admin|checkout|cart|billing|forgot-password|reset-password|verify|logout|onboarding|profile|settings"
_shipped = lambda severity: " or ".join(f"regexp_matches(s, '{p}')" for level, p in text.SECRETS.values() if level == severity)
_VIEW = f"""
    with c as (select page_id, url, html, {_CLEAN} as c, {_SCRIPTS} as s from pages),
    t as (select *, {_plain(_BODY)} as copy, {_CANONICAL} as canonical, {_ROBOTS} as robots from c)
    select page_id, {_HOST} as host, {_PATH} as path, {_plain(_first("(?is)<title[^>]*>(.*?)(?:</title|$)"))} as title, lower({_first("(?is)<html[^>]*\\slang=[\\x22\\x27]?([A-Za-z-]+)")}) as lang,
        {_meta("description")} as description, canonical, lower(regexp_extract(canonical, '^[A-Za-z]+://([^/?#:]+)', 1)) as canonical_host,
        {_count("\\S*[A-Za-z0-9]\\S*", "copy")} as words, coalesce(starts_with(lower(url), 'https:'), false) as https, coalesce({_STAGING}, false) as staging,
        coalesce(regexp_matches({_PATH}, '(?i)(^|/)({_PRIVATE})(/|$)'), false) as private, {" + ".join(f"regexp_matches(left(copy, 3000), '{p}')::bigint" for p in text.PLACEHOLDERS.values())} as n_placeholders,
        len(list_filter(regexp_extract_all(c, '(?is)<h1\\b[^>]*>(.*?)(?:</h1|$)', 1), lambda x: trim(x) <> '')) as n_h1, {_count("(?i)<h[1-6][\\s>]")} as n_headings, {_count("(?i)<img[\\s/>]")} as n_images,
        len(list_filter(regexp_extract_all(c, '(?is)<img[\\s/][^>]*'), lambda x: not regexp_matches(x, '(?i)\\salt[\\s=/]|\\srole=.?presentation|\\saria-hidden=.?true'))) as n_missing_alt,
        {_count("(?is)<a\\s[^>]*href=[\\x22\\x27]?#!?/")} as n_hash_routes, {_count("(?is)<script[^>]*application/ld.json")} as n_json_ld,
        len(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<script[^>]*application/ld.json[^>]*>(.*?)</script', 1), lambda x: not json_valid(x))) as n_json_ld_errors,
        {_count("(?is)<(?:img|script|iframe|audio|video|source)\\s[^>]*src=[\\x22\\x27]?http://")} as n_http_resources, regexp_matches(c, '(?is)<meta[^>]+name=.?viewport') as has_viewport,
        {_meta("og:title")} <> '' and {_meta("og:image")} <> '' as has_og, regexp_matches(c, '(?is)<link[^>]+rel=[^>]*icon') as has_icon,
        regexp_matches(robots, '(?i)\\bnoindex\\b') as noindex, regexp_matches(robots, '(?i)\\bnosnippet\\b|max-snippet\\s*:\\s*0\\b') as nosnippet,
        concat_ws('; ', {", ".join(f"case when regexp_matches(coalesce(html, ''), '{p.replace(chr(39), "\\x27")}') then '{e}' end" for _, p, e in elements.BUILDER_SIGNS)}) as signs,
        {_shipped("critical")} as secret_in_script, {_shipped("info")} as public_key_in_script
    from t
"""
_WEIGHT = "case severity " + " ".join(f"when '{s}' then {w}" for s, w in rules.WEIGHTS.items()) + " end"
_SHARED = " union all ".join(f"select host, 'seo.duplicate-{c}s' as rule, {c} as value, count(*) as n_pages from page_view where {c} <> '' group by all having count(*) > 1" for c in ("title", "description"))
_HREF = "(?is)<a\\s[^>]*?href=.([^<>\\s\\x22\\x27]*)"
_GONE = (
    f"select host, count(*) as n_pages from (select distinct {_HOST} as host, regexp_extract(href, '^([^?#]*)', 1) as path from (select url, unnest(regexp_extract_all(html, '{_HREF}', 1)) as href from pages) "
    f"where starts_with(href, '/')) w where not exists (select 1 from pages where {_HOST} = w.host and {_PATH} = w.path) group by 1"
)
_WITH = f"""
    with page_view as ({_VIEW}), home_view as (select * from page_view qualify row_number() over (partition by host order by path <> '/', page_id) = 1),
    findings as ({checks.findings_sql("page_view", ["page_id", "host"], rules.RULES)} union all {checks.findings_sql("home_view", ["page_id", "host"], rules.HOME_RULES)}),
    site as (select host, rule, area, arg_max(severity, {_WEIGHT}) as severity, count(*) as n_pages from findings group by 1, 2, 3
        union all select host, rule, 'search', 'medium', sum(n_pages)::bigint from ({_SHARED}) group by host, rule union all select host, 'seo.broken-internal-pages', 'search', 'medium', n_pages from ({_GONE}))
"""
# tags and texts of a page in order, with the number of open elements of a name before each
_NAMES = ("nav", "main", "article", "aside", "header", "footer", "a")
_TOKENS = f"""
    tokens as (select page_id, unnest(l) as tok, generate_subscripts(l, 1) as k from
        (select page_id, regexp_extract_all(regexp_replace({_CLEAN}, '(?is)<title\\b[^>]*>.*?(</title\\s*>|$)', '', 'g'), '(?s)<[^>]*>|[^<]+') as l from pages)),
    named as (select *, lower(regexp_extract(tok, '^</?([A-Za-z0-9]+)', 1)) as name, case when tok like '</%' then -1 when tok like '<%' then 1 else 0 end as step from tokens),
    placed as (select *, name = 'a' and step = 1 and regexp_matches(tok, '(?i)\\shref=') as is_link,
        {", ".join(f"sum(case when name = '{n}' then step else 0 end) over w as in_{n}" for n in _NAMES)} from named window w as (partition by page_id order by k)),
    regions as (select *, case {" ".join(f"when in_{n} > 0 then '{n}'" for n in _NAMES[:-1])} else '' end as region from placed)
"""

ORACLE_SQL: dict[str, str] = {
    "page_view": _VIEW,
    "page_rules": _WITH + "select * from findings",
    "findings_by_severity": _WITH
    + f"select t.severity, count(f.rule) as findings from (values {', '.join(f"('{s}')" for s in rules.WEIGHTS)}) t(severity) left join findings f on f.severity = t.severity group by 1",
    "shared_values": _WITH + _SHARED,
    "duplicate_titles": _WITH + "select title, count(*) as n_pages, min(page_id) as first_page from page_view where title <> '' group by title having count(*) > 1",
    "link_regions": f"""
        with {_TOKENS}, numbered as (select *, sum(is_link::int) over (partition by page_id order by k) as n from regions)
        select page_id, (n - 1)::int as place, max(region) filter (is_link) as region, coalesce(max(regexp_extract(tok, '(?i)\\shref=[\\x22\\x27]?([^\\x22\\x27>]*)', 1)) filter (is_link), '') as href,
            {_plain("coalesce(string_agg(tok, '' order by k) filter (step = 0 and in_a > 0), '')")} as text from numbered where n > 0 group by page_id, n
    """,
    "heading_outline": f"""
        with found as (select page_id, unnest(l) as h, generate_subscripts(l, 1) as k from (select page_id, regexp_extract_all({_CLEAN}, '(?is)<h[1-6](?:\\s[^>]*)?>.*?(?:</h[1-6]>|$)') as l from pages)),
        read as (select page_id, k, substr(h, 3, 1)::int as level, {_plain("regexp_replace(h, '<[^>]*>', '', 'g')")} as text from found),
        ranked as (select page_id, (row_number() over (partition by page_id order by k) - 1)::int as place, level, text from read where text <> '')
        select *, (select max(place) from ranked u where u.page_id = r.page_id and u.place < r.place and u.level < r.level) as under from ranked r
    """,
    "block_texts": f"""
        with {_TOKENS}, cut as (select *, sum((step <> 0 and name in ({", ".join(f"'{b}'" for b in sorted(BLOCKS))}))::int) over (partition by page_id order by k) as run from regions),
        runs as (select page_id, run, max(region) as region, {_plain("string_agg(case when step = 0 then tok when name = 'br' then ' ' else '' end, '' order by k)")} as text from cut group by 1, 2)
        select page_id, (row_number() over (partition by page_id order by run) - 1)::int as place, region, {_count("\\S*[A-Za-z0-9]\\S*", "text")} as words, text from runs where text <> ''
    """,
}
