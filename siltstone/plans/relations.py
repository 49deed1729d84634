"""Named queries on orders within groups, streams, graphs, patterns and constraints; their SQL goes by recursion, ASOF joins and plain comparisons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.html import host_of, path_of
from ..operators import admission, constraints, crawl, graph, intervals, numbering, ordered, patterns
from ..operators.constraints import Rules
from ..sources.tables import table
from ..streaming import states, windows
from ..streaming.tables import finished, table_stream

Query = Callable[[SparkSession, str], DataFrame]


def last_before_error(spark: SparkSession, folder: str) -> DataFrame:
    """Each error with the last other event of its user at or before it."""
    events = table(spark, folder, "events")
    errors, others = events.where("event_type = 'error'").select("user_id", "ts", "event_id"), events.where("event_type <> 'error'")
    return ordered.as_of(errors, others, ["user_id"], "ts", "event_id", ["event_id", "event_type", "ts"])


def event_admission(events: DataFrame) -> DataFrame:
    """When a gate of two slots a user would admit the events in order, each taking its value in hours (to a hundredth): microseconds waited, and the end."""
    jobs = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.round(F.col("value") * 100).cast("long") * 36_000_000).alias("work"))
    met = admission.admitted(jobs, "user_id", "event_id", "at", "work", 2).join(jobs.select(F.col("event_id").alias("e"), "at"), F.col("event_id") == F.col("e"))
    return met.select("user_id", "event_id", (F.col("started") - F.col("at")).alias("waited"), "ended")


LINE_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def order_spans(lines: DataFrame) -> DataFrame:
    """Ranks of an order's lines, each a span of days from its shipping, as many as its quantity, above the earlier lines that it overlaps."""
    day = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("long")
    spans = lines.select("l_orderkey", *LINE_ORDER, day.alias("lo"), (day + F.col("l_quantity").cast("long")).alias("hi"))
    return intervals.overlap_ranks(spans, "l_orderkey", LINE_ORDER, "lo", "hi").select("l_orderkey", *LINE_ORDER, "rank")


def attached_turns(conversations: DataFrame) -> DataFrame:
    """Turns of others than the user, with the user's turn that opens them and the two turns before."""
    found = ordered.attached(conversations, "conv_id", "turn", F.col("role") == "user", ["role", "text"])
    before = F.array_join(F.transform("before", lambda b: F.concat(F.coalesce(b["role"], F.lit("")), F.lit(": "), F.coalesce(b["text"], F.lit("")))), "\n")
    return found.select("conv_id", "turn", "role", "opener", "place", F.md5(before).alias("before_md5"))


def page_classes(pages: DataFrame) -> DataFrame:
    """Names of pages by their paths, unique within a host."""
    based = pages.select(host_of(F.col("url")).alias("host"), "page_id", names.pascal_case(path_of(F.col("url"))).alias("base"))
    return numbering.unique_names(based, "host", "page_id", "base")


def page_neighbourhoods(pages: DataFrame) -> DataFrame:
    """What two steps of links reach from each page, at most 40 addresses."""
    linked = crawl.linked_pages(pages)
    return graph.neighbourhoods(linked.select(F.col("node").alias("src"), F.explode("links").alias("dst")))


RULES = {
    "orders": Rules(("o_orderkey", "o_custkey", "o_orderdate"), {"status": "o_orderstatus in ('F', 'O', 'P')", "price": "o_totalprice >= 100000"}, {"o_custkey": ("customer", "c_custkey")}),
    "lineitem": Rules(("l_orderkey",), {"discount": "l_discount between 0 and 0.09", "quantity": "l_quantity >= 1"}, {"l_orderkey": ("orders", "o_orderkey"), "l_suppkey": ("supplier", "s_suppkey")}),
    "customer": Rules(("c_name",), {"balance": "c_acctbal >= 0"}, {"c_nationkey": ("nation", "n_nationkey")}),
    "events": Rules(("ts", "user_id"), {"type": "event_type in ('view', 'click', 'purchase', 'signup')", "value": "value >= 0"}),
    "documents": Rules(("doc_id", "lang"), {"length": "n_chars = length(text)", "words": "length(text) >= 100"}, {"doc_id": ("labels", "doc_id")}),
    "labels": Rules(("doc_id",), {"quality": "quality in (0, 1)", "toxic": "toxic in (0, 1)"}, {"doc_id": ("documents", "doc_id")}),
}


def constraint_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and violations by table and rule; some of the rules are meant to be broken."""
    tables = {t: table(spark, folder, t) for t in {*RULES, *(other for r in RULES.values() for other, _ in r.foreign.values())}}
    found = [constraints.counted(tables[t], rules, tables).select(F.lit(t).alias("table"), "rule", "n_rows", "n_bad") for t, rules in RULES.items()]
    return reduce(DataFrame.unionByName, found)


def benchmark_in_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages that stand whole in documents."""
    return patterns.holding(table(spark, folder, "documents"), table(spark, folder, "benchmark"), "doc_id", "item_id")


def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's run as a stream of its events leaves it."""
    return states.latest(finished(states.run_states(table_stream(spark, folder, "events")), "run-states"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users that the stream's watermark has closed by its end."""
    return finished(windows.sessions(table_stream(spark, folder, "events"), "2 hours"), "sessions")


def view_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Views and the clicks of the same user up to an hour later, by a join of two streams."""
    of = lambda kind: table_stream(spark, folder, "events").where(F.col("event_type") == kind)
    return finished(windows.followed_by(of("view"), of("click"), 3600), "view-clicks")


def page_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of all pages from their addresses: class of the path, slug, property name and collapsed text, and what ids of the like would be taken for."""
    url = F.coalesce("url", F.lit(""))
    path = F.regexp_extract(url, "^[a-z]+://[^/?#]*(.*)$", 1)
    last = F.regexp_extract(path, "([^/?#]*)/?([?#].*)?$", 1)
    return table(spark, folder, "pages").select(
        "page_id", names.page_class(path).alias("class_name"), names.slug(url).alias("slug"), names.camel_case(last).alias("property"),
        names.collapsed(F.translate(path, "/-", "  ")).alias("words"), last.rlike(names.TEST_ID).alias("test_id"), last.rlike(names.GENERATED_ID).alias("generated"),
    )


def _of(name: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(table(spark, folder, name))


QUERIES: dict[str, Query] = {
    "last_before_error": last_before_error,
    "event_admission": _of("events", event_admission),
    "order_spans": _of("lineitem", order_spans),
    "attached_turns": _of("conversations", attached_turns),
    "page_classes": _of("pages", page_classes),
    "page_neighbourhoods": _of("pages", page_neighbourhoods),
    "constraint_counts": constraint_counts,
    "benchmark_in_documents": benchmark_in_documents,
    "run_states": run_states,
    "event_sessions": event_sessions,
    "view_clicks": view_clicks,
    "page_names": page_names,
}

# --- the same in SQL

_NTH = "row_number() over (partition by l_orderkey order by " + ", ".join(LINE_ORDER) + ")"
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
_PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
_PASCAL = "array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '')"


def _rule_sql() -> str:
    parts = []
    for t, rules in RULES.items():
        bad = [f"{c} is null" for c in rules.not_null] + [f"not ({check})" for check in rules.checks.values()]
        bad += [f"{c} is not null and not exists (select 1 from {other} where {key} = t.{c})" for c, (other, key) in rules.foreign.items()]
        parts += [f"select '{t}' as \"table\", '{name}' as rule, count(*) as n_rows, count(*) filter ({b}) as n_bad from {t} t" for name, b in zip(rules.names, bad, strict=True)]
    return " union all ".join(parts)


_US, _HOUR = "epoch_us(ts)", 3_600_000_000
_LEGAL = " or ".join(f"(s = '{a}' and asked in ({', '.join(f"'{b}'" for b in bs)}))" for a, bs in states.LEGAL.items())
_SQUEEZED = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+', ' ', 'g')) || ' '"

ORACLE_SQL: dict[str, str] = {
    "last_before_error": """
        with e as (select * from events where event_type = 'error'), o as (select * from events where event_type <> 'error' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1)
        select e.user_id, e.ts, e.event_id, o.event_id as last_event_id, o.event_type as last_event_type, o.ts as last_ts from e asof left join o on e.user_id = o.user_id and e.ts >= o.ts
    """,
    # one event after the other, with the times at which the two slots are free
    "event_admission": f"""
        with recursive j as (select user_id, event_id, {_US} as at_, round(value * 100)::bigint * 36000000 as work, row_number() over (partition by user_id order by ts, event_id) as k from events),
        r as (select user_id, 0::bigint as k, null::bigint as event_id, null::bigint as at_, null::bigint as started, null::bigint as ended, [0, 0]::bigint[] as free from (select distinct user_id from j)
            union all select user_id, k, event_id, at_, started, started + work, list_sort([free[2], started + work]) from
                (select j.*, free, greatest(j.at_, free[1]) as started from r join j on j.user_id = r.user_id and j.k = r.k + 1))
        select user_id, event_id, started - at_ as waited, ended from r where k > 0
    """,
    # the longest chain of overlapping lines, each after the one before
    "order_spans": f"""
        with recursive s as (select l_orderkey, {", ".join(LINE_ORDER)}, {_NTH} as k, l_shipdate::date as lo, l_shipdate::date + l_quantity::int as hi from lineitem),
        edges as (select a.l_orderkey, a.k as earlier, b.k as later from s a join s b on a.l_orderkey = b.l_orderkey and a.k < b.k and a.lo < b.hi and b.lo < a.hi),
        chains as (select l_orderkey, k, 0 as rank from s union select c.l_orderkey, later, rank + 1 from chains c join edges e on e.l_orderkey = c.l_orderkey and earlier = c.k)
        select l_orderkey, {", ".join(LINE_ORDER)}, rank::int as rank from s join (select l_orderkey, k, max(rank) as rank from chains group by all) using (l_orderkey, k)
    """,
    "attached_turns": """
        with t as (select *, row_number() over w as r, coalesce(role, '') || ': ' || coalesce(text, '') as said from conversations window w as (partition by conv_id order by turn)),
        b as (select *, concat_ws(chr(10), lag(said, 2) over w, lag(said) over w) as b from t window w as (partition by conv_id order by turn))
        select conv_id, turn, role, (select max(u.turn) from t u where u.conv_id = b.conv_id and u.r < b.r and u.role = 'user') as opener,
            r - (select max(u.r) from t u where u.conv_id = b.conv_id and u.r < b.r and u.role = 'user') as place, md5(b) as before_md5
        from b where role is distinct from 'user'
    """,
    # one page after the other, with the names taken so far
    "page_classes": f"""
        with recursive p as (select {_HOST} as host, page_id, {_PASCAL.format(_PATH)} as base, row_number() over (partition by {_HOST} order by page_id) as k from pages),
        named as (select host, 0::bigint as k, null::bigint as page_id, null::varchar as base, null::varchar as name, []::varchar[] as taken from (select distinct host from p)
            union all select p.host, p.k, p.page_id, p.base, n.name, list_append(taken, n.name) from named r join p on p.host = r.host and p.k = r.k + 1,
                lateral (select list_filter(list_transform(range(1, len(r.taken) + 2), lambda i: case when i = 1 then p.base else p.base || i end), lambda x: not list_contains(r.taken, x))[1] as name) n)
        select host, page_id, base, name from named where k > 0
    """,
    "constraint_counts": _rule_sql(),
    "benchmark_in_documents": f"""
        with d as (select doc_id, {_SQUEEZED} as t from documents), b as (select item_id, {_SQUEEZED} as t from benchmark where trim(text) <> '')
        select item_id, doc_id, sum(len(list_filter(range(1, length(d.t)), lambda i: substr(d.t, i, length(b.t)) = b.t)))::bigint as n_found from d join b on contains(d.t, b.t) group by all
    """,
    "run_states": f"""
        with recursive e as (select user_id, {_US} as us, case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in states.ASKED.items())} end as asked,
            row_number() over (partition by user_id order by ts, event_id) as k from events where ts is not null and user_id is not null),
        r as (select distinct user_id, 0::bigint as k, 'none' as state, 0::bigint as since, 0::bigint as illegal, 0::bigint as timeouts from e
            union all select user_id, k, case when legal then asked else s end, case when legal then us else since end, illegal + (not legal)::bigint, timeouts + late::bigint from
                (select *, coalesce({_LEGAL}, false) as legal from (select *, case when late then 'timed out' else state end as s from
                    (select e.*, state, since, illegal, timeouts, state in ('queued', 'running') and us > since + {12 * _HOUR} as late from r join e on e.user_id = r.user_id and e.k = r.k + 1)))),
        last as (select *, state in ('queued', 'running') and since + {12 * _HOUR} < (select max(us) // 1000 * 1000 - {_HOUR} from e) as late from r qualify row_number() over (partition by user_id order by k desc) = 1)
        select user_id, case when late then 'timed out' else state end as state, k as n_events, illegal, timeouts + late::bigint as timeouts, case when k > illegal then make_timestamp(since) end as since from last
    """,
    "event_sessions": f"""
        with e as (select *, ts > lag(ts) over (partition by user_id order by ts) + interval 2 hours as fresh from events where ts is not null),
        s as (select *, sum(coalesce(fresh, true)::int) over (partition by user_id order by ts, event_id) as k from e)
        select user_id, min(ts) as begin, max(ts) + interval 2 hours as "end", count(*) as n_events from s group by user_id, k having epoch_us(max(ts)) + {2 * _HOUR} <= (select max({_US}) - {_HOUR} from events)
    """,
    "view_clicks": """
        select v.user_id, v.event_id as first_id, c.event_id as second_id, v.ts as first_ts, c.ts as second_ts
        from events v join events c on c.user_id = v.user_id and c.ts between v.ts and v.ts + interval 1 hour where v.event_type = 'view' and c.event_type = 'click'
    """,
    "page_names": f"""
with u as (select page_id, coalesce(url, '') as url, regexp_extract(coalesce(url, ''), '^[a-z]+://[^/?#]*(.*)$', 1) as path from pages),
x as (select *, regexp_extract(path, '([^/?#]*)/?([?#].*)?$', 1) as last, {_PASCAL.format("regexp_replace(regexp_extract(path, '^[^?#]*'), '(?i)\\.[a-z0-9]+$', '')")} as made from u),
y as (select *, {_PASCAL.format('last')} as property_of, trim(regexp_replace(translate(path, '/-', '  '), '\\s+', ' ', 'g')) as spaced,
  left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60) as slugged from x)
select page_id, case when regexp_matches(made, '^[0-9]') then 'Page' else '' end || case when made = '' then 'Home' else made end || 'Page' as class_name, case when slugged = '' then 'app' else slugged end as slug,
  lower(property_of[1]) || property_of[2:] as property, case when spaced <> '' then trim(left(spaced, 80)) end as words,
  regexp_matches(last, '(?i)^(test|qa|e2e|tid|testid|data-test|cy)[-_:]|[-_](test|testid|qa)$') as test_id,
  regexp_matches(last, '(?i)^:|^(ember|react|mui|css|sc|jss|svelte|chakra|radix)[-_]?[a-z0-9]{{3,}}$|^[a-f0-9]{{8,}}$|[0-9]{{4,}}') as generated from y""",
}
