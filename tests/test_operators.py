import base64

import duckdb
from pyspark.sql import functions as F

from siltstone.functions import html, text
from siltstone.operators import elements, graph, robots, rules
from siltstone.plans import catalogue
from siltstone.streaming.runs import activity_stream


def test_words_in_html(spark):
    rows = [("<p>one two <b>&amp;</b> - 3</p><script>no no</script>",), ("",), ("<style>x</style>é1",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(html.words_in_html(F.col("h"))).collect()]
    assert got == [3, 0, 1]


def test_secrets_belong_to_the_first_pattern(spark):
    key = "sk-ant-" + "a" * 40
    found = spark.createDataFrame([(f"x {key} y {key} AKIA{'A' * 16}",), (None,)], "t string").select(text.secrets(F.col("t")).alias("s")).collect()
    assert [(x.kind, x.value) for x in found[0].s] == [("Anthropic API key", key), ("AWS access key id", "AKIA" + "A" * 16)]


def jwt(payload: bytes) -> str:
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join([part(b'{"alg":"HS256"}'), part(payload), "s" * 20])


def test_service_role_tokens(spark):
    good = [jwt(b'{"iss":"supabase","role":"service_role"}'), jwt('{"name":"\u00fe\u00ff\u00bf?>~","role":"service_role"}'.encode()), jwt(b'{"x":"\xff\xfe","role":"service_role"}')]
    head, body, tail = good[0].split(".")
    good.append(f"{head}.{body}.{tail}x")
    bad = [jwt(p) for p in (b'{"role":"anon","a":"service_role"}', b'{"iss":"supabase"}', b'{"role":["service_role"]}', b'{"a":{"role":"service_role"}}', b'{"role":"service_role"')]
    bad += [f"{head}.{body[:-9]}.{tail}", f"{head}.eyJ{'A' * 14}.{tail}", f"{head}.{tail}"]
    assert len(f"eyJ{'A' * 14}") % 4 == 1
    rows = [(k, f"a {t} b {t}") for k, t in enumerate(good + bad)] + [(99, None), (100, f"AKIA{'A' * 16} {good[0]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, catalogue.secret_hits(docs).collect()))
    kind = "Supabase service_role key"
    want = [(k, kind, "critical", f"eyJhbG…({len(t)} chars)") for k, t in enumerate(good)] + [(100, kind, "critical", f"eyJhbG…({len(good[0])} chars)"), (100, "AWS access key id", "critical", "AKIAAA…(20 chars)")]
    assert got == sorted(want)

    # the same tokens by SQL of its own: DuckDB decodes and reads the JSON
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?)", rows)
    found = duck.sql("""
        with t as (select distinct doc_id, unnest(regexp_extract_all(text, '\\beyJ[\\w-]{10,}[.]eyJ[\\w-]{10,}[.][\\w-]{10,}')) as v from documents),
        p as (select *, translate(split_part(v, '.', 2), '-_', '+/') as b from t),
        j as (select *, try(decode(from_base64(rpad(b, ((length(b) + 3) // 4 * 4)::int, '=')))) as j from p)
        select doc_id, left(v, 6) || '…(' || length(v) || ' chars)' from j where json_valid(j) and json_extract_string(j, '$.role') = 'service_role'
    """).fetchall()
    # row 2's payload is not all UTF-8, which DuckDB's decode() refuses and the reference replaces
    assert sorted(found) == [(k, preview) for k, what, _, preview in got if what == kind and k != 2]


def test_page_rules_on_null_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", None), (2, None, "<title>x</title>")], "page_id long, url string, html string")
    assert rules.page_findings(elements.page_view(pages)).where("page_id = 1 and rule = 'seo.missing-title'").count() == 1
    assert rules.page_findings(elements.page_view(pages.where("false"))).count() == 0
    assert {r.severity: r.findings for r in rules.severity_counts(rules.page_findings(elements.page_view(pages.where("false")))).collect()} == dict.fromkeys(rules.WEIGHTS, 0)


def test_robots_groups(spark):
    texts = spark.createDataFrame([("s", "User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: *\nDisallow: /\nAllow: /ok$")], "site string, text string")
    probes = spark.createDataFrame([("s", "A", "/x/1"), ("s", "b", "/y"), ("s", "c", "/ok"), ("s", "c", "/okay"), ("u", "c", "/")], "site string, token string, path string")
    got = {(r.token, r.path): (r.allowed, r.matched_by) for r in robots.access(texts, probes).collect()}
    assert got == {("A", "/x/1"): (False, "exact"), ("b", "/y"): (True, "exact"), ("c", "/ok"): (True, "star"), ("c", "/okay"): (False, "star"), ("c", "/"): (True, "none")}


def test_reach_with_a_loop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = {r.node: r.depth for r in graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_activity_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = activity_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="400 days")
    query = stream.writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("activity").collect())) == sorted(map(tuple, activity_stream(events).collect()))


def test_pages_are_read_whole(spark):
    link = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    rows = [
        (1, "https://A.org/", link("/b/", "c?q=1#t", "mailto:x@y.z", "/p.png", "//a.org/d/../e", "http://a.org/no", "https://o.org/no", "#f")),
        (2, "https://a.org/b", link("./f/./g", "../h", "?page=2", "/")),
        *((10 + k, f"https://a.org/n{k}", link(f"n{k + 1}")) for k in range(5)),
        (3, "https://a.org/b?page=2", link("n0")),
        (4, "https://a.org/alone", link("/cart/x") + "<p>text</p>"),
        (5, "http://localhost:3000/login#x", "<p>Buy <b>now</b></p>"),
        (6, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {"page_reach": graph.page_reach(pages), "page_urls": catalogue.page_urls(pages), "page_commerce": catalogue.page_commerce(pages)}
    reached = {r.node.removeprefix("https://a.org"): r.depth for r in got["page_reach"].collect() if r.origin == "https://a.org"}
    assert reached == {"/": 0, "/b": 1, "/c?q=1": 1, "/e": 1, "/f/g": 2, "/h": 2, "/b?page=2": 2} | {f"/n{k}": 3 + k for k in range(6)}
    assert {r.page_id for r in got["page_commerce"].collect() if r.commercial} == {4, 5}
    duck = duckdb.connect()
    duck.execute("create table pages (page_id bigint, url varchar, html varchar)")
    duck.executemany("insert into pages values (?, ?, ?)", rows)
    for name, frame in got.items():
        want = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(frame.columns) == sorted(want.columns)
        assert sorted(map(repr, frame.select(*want.columns).collect())) == sorted(map(repr, frame.sparkSession.createDataFrame(want.fetchall(), frame.select(*want.columns).schema).collect()))


def test_attributes_in_any_order_and_quoting(spark):
    rows = [
        ("<link rel=\"canonical\" href=\"https://a.test/1\"><meta name='description' content='it\"s one'>", "https://a.test/1", 'it"s one'),
        ("<link href='https://a.test/2' rel=canonical><meta content=\" two \" name=\"description\">", "https://a.test/2", "two"),
        ("<LINK HREF=https://a.test/3 REL='canonical'/><meta property=description content=x>", "https://a.test/3", ""),
        ("<link rel=icon href=/i.ico><p>", "", ""),
        (None, "", ""),
    ]
    pages = spark.createDataFrame([(k, "https://a.test/", h) for k, (h, _, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: (r.canonical, r.description) for r in elements.page_view(pages).collect()}
    assert got == {k: (c, d) for k, (_, c, d) in enumerate(rows)}


def test_run_findings_of_empty_tables(spark):
    """A run without pages is one critical finding; nothing else comes of empty tables."""
    from siltstone.operators import tester
    from literal import findings

    tables = [t.frame(spark) for t in (findings.RUNS, findings.RUN_PAGES, findings.BROKEN, findings.ERRORS, findings.REQUESTS, findings.ELEMENTS)]
    none = [t.where("false") for t in tables[1:]]
    got = tester.run_findings(tables[0], *none).collect()
    assert sorted((r.run, r.severity, r.category) for r in got) == [(f"r{k}", "critical", "navigation") for k in (1, 2, 3)]
    assert tester.run_findings(tables[0].where("false"), *none).count() == 0
