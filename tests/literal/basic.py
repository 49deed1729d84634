"""Colours, cron lines, conversion states, a search and robots.txt groups on literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import values
from siltstone.operators import graph, robots

COLOURS = "('#000000', '#ffffff', 16.0, false), ('#777777', '#ffffff', 16.0, false), ('#777777', '#ffffff', 24.0, false), ('#8899aa', '#99aabb', 19.0, true), ('#0000ff', '#ffffff', 12.0, false)"
CRONS = (
    "('*/5 * * * *'), ('* * * * *'), ('7 * * * *'), ('30 */6 * * *'), ('5 4 * * *'), ('0 9 * * 1'), ('0 9 * * 7'), ('15 8 * * 1-5'), ('0 0 1 * *'), ('0 0 1 1 *'), ('@daily'), ('1 2 3')"
)
BODIES = "(0, 0), (4, 0), (4, 1), (4, 2), (4, 4), (1, 1)"
EDGES = "('/', '/a'), ('/', '/b'), ('/a', '/c'), ('/b', '/c'), ('/c', '/d'), ('/d', '/e'), ('/x', '/y')"
PROBES = "('s', 'GPTBot', '/'), ('s', 'Other', '/private/x'), ('s', 'Other', '/private/open'), ('t', 'Other', '/'), ('s', 'Other', '/file.pdf')"
ROBOTS = ["User-agent: GPTBot", "Disallow: /", "", "User-agent: *  # all others", "Disallow: /private", "Allow: /private/open", "Disallow: /*.pdf$", "Disallow:"]


def _literal(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """Literal rows, as they stand in the SQL."""
    return spark.sql(f"select * from values {rows} as t({columns})")


def contrast(spark: SparkSession, folder: str) -> DataFrame:
    rows = _literal(spark, COLOURS, "fg, bg, size, bold").withColumn("size", F.col("size").cast("double"))
    rated = rows.withColumn("ratio", values.contrast_ratio(F.col("fg"), F.col("bg")))
    return rated.select("fg", "bg", "ratio", (F.col("ratio") < values.contrast_threshold(F.col("size"), F.col("bold"))).alias("fails"))


def cron_text(spark: SparkSession, folder: str) -> DataFrame:
    return _literal(spark, CRONS, "expr").select("expr", values.describe_cron(F.col("expr")).alias("reading"))


def conversion_status(spark: SparkSession, folder: str) -> DataFrame:
    return _literal(spark, BODIES, "total, todos").select("total", "todos", values.conversion_status(F.col("total"), F.col("todos")).alias("status"))


def crawl_frontier(spark: SparkSession, folder: str) -> DataFrame:
    return graph.reach(_literal(spark, EDGES, "src, dst"), spark.createDataFrame([("/",)], "node string"), 3)


def robots_access(spark: SparkSession, folder: str) -> DataFrame:
    return robots.access(spark.createDataFrame([("s", "\n".join(ROBOTS))], "site string, text string"), _literal(spark, PROBES, "site, token, path"))


QUERIES = {
    "contrast_failures": contrast,
    "cron_text": cron_text,
    "conversion_status": conversion_status,
    "crawl_frontier": crawl_frontier,
    "robots_access": robots_access,
}

_LUMINANCE = lambda c: " + ".join(
    f"{w} * case when v{k}{c} <= 0.03928 then v{k}{c} / 12.92 else pow((v{k}{c} + 0.055) / 1.055, 2.4) end" for k, w in enumerate((0.2126, 0.7152, 0.0722))
)
_CHANNELS = ", ".join(f"('0x' || substr({c}, {2 + 2 * k}, 2))::int / 255.0::double as v{k}{c}" for c in ("fg", "bg") for k in range(3))

ORACLE_SQL = {
    "contrast_failures": f"with t as (select *, {_CHANNELS} from (values {COLOURS}) t(fg, bg, size, bold)), l as (select *, {_LUMINANCE('fg')} as a, {_LUMINANCE('bg')} as b from t), "
    "r as (select *, floor((greatest(a, b) + 0.05) / (least(a, b) + 0.05) * 100 + 0.5) / 100 as ratio from l) "
    "select fg, bg, ratio, ratio < case when size >= 24 or (bold and size >= 18.66) then 3.0 else 4.5 end as fails from r",
    "cron_text": f"with t as (select expr, string_split(expr, ' ') as f from (values {CRONS}) t(expr)), p as (select expr, len(f) as n, f[1] as mi, f[2] as h, f[3] as dom, f[4] as mon, f[5] as dow, "
    "lpad(f[2], 2, '0') || ':' || lpad(f[1], 2, '0') || ' UTC' as clock from t) select expr, case when n <> 5 then expr "
    "when regexp_full_match(mi, '\\*/\\d+') and h || dom || mon || dow = '****' then 'every ' || substr(mi, 3) || ' minutes' when mi || h || dom || mon || dow = '*****' then 'every minute' "
    "when regexp_full_match(mi, '\\d+') and h || dom || mon || dow = '****' then 'hourly at :' || lpad(mi, 2, '0') "
    "when regexp_full_match(mi, '\\d+') and regexp_full_match(h, '\\*/\\d+') and dom || mon || dow = '***' then 'every ' || substr(h, 3) || ' hours at :' || lpad(mi, 2, '0') "
    "when not regexp_full_match(mi || h, '\\d+') then expr when dom || mon || dow = '***' then 'daily at ' || clock "
    "when dom || mon = '**' and regexp_full_match(dow, '\\d+') then 'weekly on ' || (['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'])[try_cast(dow as int) % 7 + 1] || ' at ' || clock "
    "when dom || mon = '**' and dow = '1-5' then 'weekdays at ' || clock when regexp_full_match(dom, '\\d+') and mon || dow = '**' then 'monthly on day ' || dom || ' at ' || clock else expr end as reading from p",
    "conversion_status": f"select total, todos, case when total = 0 then 'manual' when todos = 0 then 'converted' when todos * 2 >= total then 'manual' else 'partial' end as status from (values {BODIES}) t(total, todos)",
    "crawl_frontier": f"with recursive e as (select * from (values {EDGES}) t(src, dst)), r as (select '/' as node, 0 as depth union select dst, depth + 1 from r join e on src = node where depth < 3) "
    "select node, min(depth) as depth from r group by node",
    "robots_access": "select * from (values ('s', 'GPTBot', '/', false, 'exact'), ('s', 'Other', '/private/x', false, 'star'), ('s', 'Other', '/private/open', true, 'star'), "
    "('t', 'Other', '/', true, 'none'), ('s', 'Other', '/file.pdf', false, 'star')) t(site, token, path, allowed, matched_by)",
}
