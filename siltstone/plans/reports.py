"""Named queries that reports are made of: findings on the wire, lists, counts before the newest event, totals, parsed properties, sentences, statements, names of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import elements, numbering, reports, rules, scripts
from ..sources.tables import table, written
from . import pages, readiness
from .pages import _SCRIPTS, _VIEW, _WEIGHT
from .readiness import _ALL, _EFFORT
from .relations import _PASCAL

Query = Callable[[SparkSession, str], DataFrame]
WINDOWS = (1, 7, 30)


def wire_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of each host as they go out, with the first pages that show them."""
    own = table(spark, folder, "pages")
    view, sights = written(elements.page_view(own), "view"), readiness.page_facts(spark, folder)
    return reports.wire_findings(view, sights, written(rules.failed_checks(own, view, sights), "failed"))


def page_rows(html: DataFrame) -> DataFrame:
    """A row of the report for each page, with what it lacks."""
    view = elements.page_view(html)
    lacks = {"no_h1": F.col("n_h1") == 0, "no_description": F.col("description") == "", "no_canonical": F.col("canonical") == "", "thin": F.col("words") < 50}
    return view.select("page_id", "host", "path", "title", "words", *(c.alias(n) for n, c in lacks.items()), sum((c.cast("int") for c in lacks.values()), F.lit(0)).alias("n_lacks"))


def newest_events(events: DataFrame) -> DataFrame:
    """The five newest events of each user, newest first."""
    return reports.newest(events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id", 5).select("user_id", "place", "event_id", "event_type", "ts")


def event_windows(events: DataFrame) -> DataFrame:
    """Events of each type in the days before the newest one, and days and months that have some."""
    return reports.before_newest(events, ["event_type"], "ts", WINDOWS)


def event_totals(events: DataFrame) -> DataFrame:
    """Numbers and hundredths of events by day and type, with the totals of each and of all."""
    return reports.totals(events.select(F.to_date("ts").alias("day"), "event_type", "value"), ["day", "event_type"], F.round(F.col("value") * 100).cast("long"))


def tolerant(text: Column) -> Column:
    """The JSON of a text; null for null, blank or ill-formed text."""
    return F.try_parse_json(text)


def event_props(events: DataFrame) -> DataFrame:
    """The property k of each event, whether its properties are an object, and how many they are; ill-formed ones have none."""
    read = events.select("event_id", tolerant(F.col("props")).alias("v"), "props")
    kind = F.schema_of_variant("v")
    size = F.size(F.json_object_keys(F.when(F.col("v").isNotNull(), F.col("props"))))
    return read.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("is_object"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("n_props"))


def document_sentences(docs: DataFrame) -> DataFrame:
    """Number of sentences of each text and the words of its longest; a sentence ends at a mark that white space and a capital follow."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])[ \t\r\n\f]+(?=[A-Z])"), lambda s: s.rlike(r"[^ \t\r\n\f]"))
    words = F.transform(parts, lambda s: F.regexp_count(s, F.lit(r"[^ \t\r\n\f]+")))
    return docs.select("doc_id", F.size(parts).cast("long").alias("n_sentences"), F.coalesce(F.array_max(words), F.lit(0)).cast("long").alias("longest"))


def link_names(html: DataFrame) -> DataFrame:
    """Names for a page's links, as properties of a class: by their texts, unique on the page."""
    named = elements.link_regions(html).select("page_id", "place", names.property_name(F.col("text"), "Link").alias("base"))
    return numbering.unique_names(named, "page_id", "place", "base")


def _of(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(table(spark, folder, name))


QUERIES: dict[str, Query] = {
    "wire_findings": wire_findings,
    "page_rows": _of("pages", page_rows),
    "newest_events": _of("events", newest_events),
    "event_windows": _of("events", event_windows),
    "event_totals": _of("events", event_totals),
    "event_props": _of("events", event_props),
    "document_sentences": _of("documents", document_sentences),
    "link_names": _of("pages", link_names),
    "script_statements": _of("pages", scripts.script_statements),
}

# --- the same in SQL

_LINKS_SQL = pages.ORACLE_SQL["link_regions"]
_CAMEL = f"lower(substr({_PASCAL}, 1, 1)) || substr({_PASCAL}, 2)"
ORACLE_SQL: dict[str, str] = {
    "wire_findings": f"""{_ALL}, plan as (select *, {_EFFORT} as effort from every),
        ranked as (select *, row_number() over (partition by host order by {_WEIGHT} desc, list_position({rules.EFFORTS}, effort), list_position({rules.AREAS}, area), rule) as position from plan),
        broken as (select page_id, host, rule from findings union all select page_id, host, rule from looks),
        placed as (select b.host, rule, path, row_number() over (partition by b.host, rule order by b.page_id, path) as k from broken b join page_view v on v.page_id = b.page_id and v.host = b.host),
        shown as (select host, rule, string_agg(path, chr(10) order by k) filter (k <= 12) as pages, count(*) filter (k > 12) as more from placed group by 1, 2)
        select r.host, position, r.rule as id, area, severity, effort, case effort when 'quick' then 'under an hour' when 'medium' then 'half a day' else 'a day or more' end as effort_label,
            (case when area = 'design' then 6 else {_WEIGHT} end)::bigint as points, pages, coalesce(more, 0) as more from ranked r left join shown s on s.host = r.host and s.rule = r.rule""",
    "page_rows": f"""with v as ({_VIEW}) select page_id, host, path, title, words, n_h1 = 0 as no_h1, description = '' as no_description, canonical = '' as no_canonical, words < 50 as thin,
        (n_h1 = 0)::int + (description = '')::int + (canonical = '')::int + (words < 50)::int as n_lacks from v""",
    "newest_events": "select user_id, (row_number() over w)::int as place, event_id, event_type, ts from events window w as (partition by user_id order by ts desc nulls last, event_id desc) qualify place <= 5",
    "event_windows": f"""with e as (select event_type, ts, (select max(ts) from events) - ts as age from events where ts is not null)
        select event_type, {", ".join(f"count(*) filter (age <= interval {n} days) as last_{n}" for n in WINDOWS)}, count(distinct ts::date) as days, count(distinct date_trunc('month', ts)) as months from e group by 1""",
    "event_totals": """select ts::date as day, event_type, grouping(ts::date, event_type)::bigint as level, count(*) as n, sum(round(value * 100)::bigint)::bigint as total from events group by cube (ts::date, event_type)""",
    "event_props": """with e as (select event_id, case when json_valid(props) then props end as p from events) select event_id, json_extract(p, '$.k')::bigint as k, coalesce(json_type(p) = 'OBJECT', false) as is_object,
        coalesce(len(json_keys(p)), 0) as n_props from e""",
    "document_sentences": """with s as (select doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n\\f]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_matches(s, '[^ \\t\\r\\n\\f]')) as l from documents)
        select doc_id, len(l) as n_sentences, coalesce(list_max(list_transform(l, lambda s: len(regexp_extract_all(s, '[^ \\t\\r\\n\\f]+')))), 0) as longest from s""",
    "link_names": f"""
        with recursive links as ({_LINKS_SQL}), named as (select page_id, place, {_CAMEL.format("substr(trim(substr(text, 1, 80)), 1, 40)")} as b from links),
        based as (select page_id, place, case when regexp_matches(n, '^[0-9]') then 'el' || n else n end as base from (select *, case when lower(b) like '%link' then b else b || 'Link' end as n from named)),
        p as (select *, row_number() over (partition by page_id order by place) as k from based),
        given as (select page_id, 0::bigint as k, null::int as place, null::varchar as base, null::varchar as name, []::varchar[] as taken from (select distinct page_id from p)
            union all select p.page_id, p.k, p.place, p.base, n.name, list_append(taken, n.name) from given r join p on p.page_id = r.page_id and p.k = r.k + 1,
                lateral (select list_filter(list_transform(range(1, len(r.taken) + 2), lambda i: case when i = 1 then p.base else p.base || i end), lambda x: not list_contains(r.taken, x))[1] as name) n)
        select page_id, place, base, name from given where k > 0""",
    # no given script has a semicolon in a string or bracket
    "script_statements": f"""
        with s as (select page_id, string_split({_SCRIPTS}, ';') as l from pages), u as (select page_id, unnest(l) as t, generate_subscripts(l, 1) as k from s),
        t as (select page_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) as text, k from u where trim(t) <> ''), c as (select *, nullif(regexp_extract(text, '^([A-Za-z_$][A-Za-z0-9_$.]*)\\s*\\(', 1), '') as call from t)
        select page_id, (row_number() over (partition by page_id order by k) - 1)::int as place, text, call,
            case when call is not null and text like '%)' then case when regexp_matches(text, '\\(\\s*\\)$') then 0 else len(regexp_extract_all(text, ',')) + 1 end end::int as arguments from c""",
}
