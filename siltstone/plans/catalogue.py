"""The named queries on the common tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import graph, readiness, runs
from ..sources.tables import table
from . import pages, relations, reports
from . import readiness as sites

Query = Callable[[SparkSession, str], DataFrame]


def _of(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(table(spark, folder, name))


def placeholder_hits(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(text.labels(F.col("text"), text.PLACEHOLDERS)).alias("label"))


def buzzword_hits(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(text.buzzwords(F.col("text"))).alias("phrase"))


def secret_hits(docs: DataFrame) -> DataFrame:
    # one pass tells which texts have any credential's shape; few do
    found = docs.where(F.col("text").rlike(text.ANY_SECRET)).select("doc_id", F.inline(text.secrets(F.col("text"))))
    return found.select("doc_id", "kind", "severity", text.redact(F.col("value")).alias("preview"))


def dash_density(docs: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    dashes = docs.select("doc_id", F.regexp_count(body, F.lit("—")).cast("long").alias("dashes"), F.regexp_count(body, F.lit(html.TOKEN)).cast("long").alias("words"))
    return dashes.withColumn("per_1000", F.when(F.col("words") > 0, F.floor(F.col("dashes") / F.col("words") * 10000 + 0.5) / 10).otherwise(0.0))


def page_urls(pages: DataFrame) -> DataFrame:
    """page_id, href and readings of each page's own URL and of its links; crawlable from the page's origin."""
    url, of = F.col("url"), urls.origin(F.col("page"))
    return graph.addresses(pages).select(
        "page_id", "href", urls.normalised(url).alias("normalised"), urls.origin(url).alias("origin"), (urls.crawlable(url, of) & (of != "")).alias("crawlable"),
        urls.staging(url).alias("staging"), urls.private_path(F.regexp_extract(url, urls.PATH, 1)).alias("private"),
    )


def page_commerce(pages: DataFrame) -> DataFrame:
    """page_id, commercial: by the visible text or by a link's address."""
    body = F.coalesce("html", F.lit(""))
    paid = F.exists(F.regexp_extract_all(body, F.lit(html.HREF), 1), lambda h: h.rlike(readiness.COMMERCE_HREF))
    words = F.regexp_replace(html.visible_text(body), r"\s+", " ")
    return pages.select("page_id", (readiness.commercial(words) | paid).alias("commercial"))


QUERIES: dict[str, Query] = {
    "page_links": _of("pages", html.links),
    "broken_links": _of("pages", graph.broken_links),
    "page_reach": _of("pages", graph.page_reach),
    "page_urls": _of("pages", page_urls),
    "page_commerce": _of("pages", page_commerce),
    "placeholder_hits": _of("documents", placeholder_hits),
    "buzzword_hits": _of("documents", buzzword_hits),
    "secret_hits": _of("documents", secret_hits),
    "dash_density": _of("documents", dash_density),
    "run_status_latest": _of("events", runs.latest_status),
    "activity_by_day": _of("events", runs.activity),
    "queue_depth": _of("events", runs.queue_depth),
} | pages.QUERIES | relations.QUERIES | sites.QUERIES | reports.QUERIES


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_BODY = "coalesce(html, '')"
_VISIBLE = f"regexp_replace(regexp_replace(regexp_replace({_BODY}, '{html.HIDDEN}', ' ', 'g'), '{html.TAG}', ' ', 'g'), '{html.ENTITY}', ' ', 'g')"
_HOST = f"lower(regexp_extract(url, '{html.HOST}', 1))"
_PATH = f"case when regexp_extract(url, '{html.PATH}', 1) = '' then '/' else regexp_extract(url, '{html.PATH}', 1) end"
_SERVER = f"regexp_replace(regexp_extract(url, '{urls.HOST_PORT}', 1), ':\\d+$', '')"
_LINKS = f"select * from (select page_id, {_HOST} as host, unnest(regexp_extract_all(html, '{html.HREF}', 1)) as href from pages) where href <> '' and not starts_with(href, '#')"
_SECRETS = " union all ".join(
    f"select doc_id, {k} as k, '{kind}' as kind, '{severity}' as severity, unnest(regexp_extract_all(text, '{p}')) as value from documents" for k, (kind, (severity, p)) in enumerate(text.SECRETS.items())
)
_ORIGIN = lambda u: f"lower(regexp_extract({u}, '{urls.ORIGIN}', 0))"
_WHOLE = (
    f"case when regexp_matches(href, '{urls.SCHEME}') then href when starts_with(href, '//') then regexp_extract(page, '^[A-Za-z]+:', 0) || href when starts_with(href, '/') then regexp_extract(page, '{urls.ORIGIN}', 0) || href "
    f"when starts_with(href, '?') then regexp_replace(page, '[?#].*$', '') || href else regexp_extract(page, '{urls.ORIGIN}', 0) || coalesce(nullif(regexp_replace(regexp_extract(page, '{urls.PATH}', 1), '[^/]*$', ''), ''), '/') || href end"
)
_FOLDED = (
    f"case when regexp_matches(w, '{urls.ORIGIN}') then regexp_extract(w, '{urls.ORIGIN}', 0) || list_reduce(list_prepend('', string_split(regexp_extract(w, '{urls.PATH}', 1), '/')[2:]), "
    "lambda a, x: case x when '..' then regexp_replace(a, '/[^/]*$', '') when '.' then a else a || '/' || x end) || regexp_extract(w, '[?#].*$', 0) else w end"
)
_ADDRESSES = (
    f"select page_id, url as page, url as href, url from pages union all select page_id, page, href, {_FOLDED} "
    f"from (select *, {_WHOLE} as w from (select page_id, url as page, unnest(regexp_extract_all(html, '{html.HREF}', 1)) as href from pages) where href <> '' and not starts_with(href, '#'))"
)
_NORMAL = lambda u: (
    f"case when {_ORIGIN(u)} <> '' then {_ORIGIN(u)} || coalesce(nullif(regexp_replace(regexp_extract({u}, '{urls.PATH}', 1), '([^/])/$', '\\1'), ''), '/') || regexp_extract(regexp_replace({u}, '#.*$', ''), '[?].*$', 0) end"
)
_CRAWLED = f"{_ORIGIN('url')} = {_ORIGIN('page')} and not regexp_matches(regexp_extract(url, '{urls.PATH}', 1), '{urls.ASSET}')"

# all pages of a site are starts here, so what is found by links is not there
_CRAWL = f"""
    with own as (select {_ORIGIN('url')} as origin, {_NORMAL('url')} as node, page_id, url as page, html from pages where {_ORIGIN('url')} <> ''),
    there as (select * from own qualify row_number() over (partition by origin, node order by page_id) = 1),
    starts as (select origin, node, min(place) as place from (select origin, node, page_id as place from there union all select distinct origin, origin || '/', -1 from there) group by all),
    queue as (select *, row_number() over (partition by origin order by place, node) - 1 as position, count(*) over (partition by origin) as n from starts),
    told as (select q.*, page, html, coalesce(sum((page is not null)::int) over (partition by origin order by position rows between unbounded preceding and 1 preceding), 0) as earlier from queue q left join there using (origin, node)),
    first as (select *, case when position >= 115 or earlier >= 15 then 'skipped' when page is not null then 'visited' else 'broken' end as state from told),
    pages_of as (select origin, any_value(n) as n, count(*) filter (state = 'visited') as pages from first group by 1),
    hrefs as (select origin, position, node as referrer, page, unnest(l) as href, generate_subscripts(l, 1) as spot from (select *, regexp_extract_all(html, '{html.HREF}', 1) as l from first where state = 'visited')),
    whole as (select *, {_WHOLE} as w from hrefs where href <> '' and not starts_with(href, '#')), links as (select *, {_FOLDED} as url from whole),
    found as (select origin, {_NORMAL('url')} as node, referrer, position as parent, spot from links where {_CRAWLED} qualify row_number() over (partition by origin, {_NORMAL('url')} order by position, spot) = 1),
    fresh as (select f.*, n + row_number() over (partition by origin order by parent, spot) - 1 as place, pages from found f join pages_of using (origin) where not exists (select 1 from starts s where s.origin = f.origin and s.node = f.node))
    select origin, position, node, 0 as depth, null::varchar as referrer, state from first
    union all select origin, place, node, 1, referrer, case when place >= 115 or pages >= 15 then 'skipped' else 'broken' end from fresh
"""

_NEAR = f"""
    with own as (select {_NORMAL('url')} as node, page_id, url as page, html from pages where {_ORIGIN('url')} <> ''),
    there as (select * from own qualify row_number() over (partition by node order by page_id) = 1),
    hrefs as (select node as src, page, unnest(regexp_extract_all(html, '{html.HREF}', 1)) as href from there), whole as (select *, {_WHOLE} as w from hrefs where href <> '' and not starts_with(href, '#')),
    edges as (select distinct src, {_NORMAL('url')} as dst from (select *, {_FOLDED} as url from whole) where {_CRAWLED} and src <> {_NORMAL('url')}),
    one as (select src as start, dst as node, row_number() over (partition by src order by dst) as a from edges),
    two as (select start, dst as node, a, row_number() over (partition by start, o.node order by dst) as b from one o join edges e on e.src = o.node where o.a < 40),
    found as (select distinct src as start, src as node, 0 as a, 0 as b, 0 as hop from edges union all select start, node, a, 0, 1 from one union all select start, node, a, b, 2 from two),
    kept as (select * from found qualify row_number() over (partition by start, node order by hop, a, b) = 1)
    select start, node, (row_number() over (partition by start order by hop, a, b) - 1)::int as place from kept qualify place < 40
"""

ORACLE_SQL: dict[str, str] = {
    "page_crawl": _CRAWL,
    "page_neighbourhoods": _NEAR,
    "page_links": _LINKS,
    "broken_links": f"with links as ({_LINKS}), wanted as (select host, regexp_extract(href, '^([^?#]*)', 1) as href, count(*) as n_links from links where starts_with(href, '/') group by 1, 2) "
    f"select * from wanted w where not exists (select 1 from pages where {_HOST} = w.host and {_PATH} = w.href)",
    "page_reach": f"with recursive e as (select distinct {_NORMAL('page')} as src, {_NORMAL('url')} as dst from ({_ADDRESSES}) where {_CRAWLED} and {_ORIGIN('page')} <> ''), "
    f"r(origin, node, depth) using key (node) as (select distinct {_ORIGIN('url')}, {_ORIGIN('url')} || '/', 0 from pages where {_ORIGIN('url')} <> '' "
    "union select origin, dst, min(depth + 1) from r join e on src = node where not exists (select 1 from recurring.r s where s.node = dst) group by all) select origin, node, depth from r",
    "page_urls": f"select page_id, href, {_NORMAL('url')} as normalised, {_ORIGIN('url')} as origin, {_CRAWLED} and {_ORIGIN('page')} <> '' as crawlable, "
    + " or ".join(f"regexp_matches({_SERVER}, '{p}')" for p in (urls.LOCAL, urls.STAGE, urls.PREVIEW))
    + f" as staging, regexp_matches(regexp_extract(url, '{urls.PATH}', 1), '{urls.PRIVATE}') as private from ({_ADDRESSES})",
    "page_commerce": f"select page_id, regexp_matches(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g'), '{readiness.COMMERCE}') or len(list_filter(regexp_extract_all({_BODY}, '{html.HREF}', 1), lambda h: regexp_matches(h, '{readiness.COMMERCE_HREF}'))) > 0 as commercial from pages",
    "placeholder_hits": " union all ".join(f"select doc_id, '{label}' as label from documents where regexp_matches(text, '{p}')" for label, p in text.PLACEHOLDERS.items()),
    "buzzword_hits": " union all ".join(f"select doc_id, '{b}' as phrase from documents where contains(lower(text), '{b}')" for b in text.BUZZWORDS),
    "secret_hits": f"with found as ({_SECRETS}), one as (select doc_id, value, arg_min(kind, k) as kind, arg_min(severity, k) as severity from found group by 1, 2) "
    "select doc_id, kind, severity, left(value, 6) || '…(' || length(value) || ' chars)' as preview from one",
    "dash_density": f"with n as (select doc_id, {_count("coalesce(text, '')", '—')} as dashes, {_count("coalesce(text, '')", html.TOKEN)} as words from documents) "
    "select *, case when words > 0 then floor(dashes / words * 10000 + 0.5) / 10 else 0.0 end as per_1000 from n",
    "run_status_latest": "select user_id, arg_max(event_type, (ts, event_id)) as status, count(*) as n_events from events group by 1",
    "activity_by_day": "select ts::date as day, event_type, count(*) as n_events, count(distinct user_id) as n_users from events group by 1, 2",
    "queue_depth": "select event_id, sum(case event_type when 'view' then 1 when 'click' then -1 else 0 end) over (partition by user_id order by ts, event_id)::bigint as depth from events",
} | pages.ORACLE_SQL | relations.ORACLE_SQL | sites.ORACLE_SQL | reports.ORACLE_SQL
