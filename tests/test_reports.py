"""Statements of scripts, names, lists, windows, totals and parsed properties on odd rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.functions import names
from siltstone.operators import elements, facts, reports, rules, scripts
from siltstone.plans import reports as queries


@pytest.mark.parametrize("source, want", [
    ("", []), (" ; ;", []), ("a()", [("a()", "a", 0)]), ("f( )", [("f( )", "f", 0)]), ("f(1, g(2, 3), [4, 5], '),');x", [("f(1, g(2, 3), [4, 5], '),')", "f", 4), ("x", None, None)]),
    ("var s = \"a;b\"; // c;d\nt = `x;${y};`", [('var s = "a;b"', None, None), ("t = `x;${y};`", None, None)]), ("if (a) { b; c() } d()", [("if (a) { b; c() }", "if", 1), ("d()", "d", 0)]),
    ("a)); b(1)", [("a))", None, None), ("b(1)", "b", 1)]), ("a /* ; ' */ + 1; 4 / 2;'open\nnext;", [("a + 1", None, None), ("4 / 2", None, None), ("'open next", None, None)]),
    ("o.p.q(function(){return 1;}, 2)", [("o.p.q(function(){return 1;}, 2)", "o.p.q", 2)]), ("f(1", [("f(1", "f", None)]), (r"s = 'it\'s; x'; y", [(r"s = 'it\'s; x'", None, None), ("y", None, None)]),
])
def test_statements(source, want):
    assert list(scripts.statements(source)) == want


def test_statements_are_read_in_linear_time():
    for text in ("(" * 300000, "'" * 300000, "`" * 300001, "/*" * 200000, "\"\\" * 200000, "a;" * 200000, "{}" * 200000, "f(" * 150000 + ")" * 150000):
        assert sum(1 for _ in scripts.statements(text)) >= 0


def test_statements_of_pages(spark):
    rows = [(1, "<script>a(1);b</script><script type='application/ld+json'>{\"x\":1}</script><script src=x.js>no()</script><script type=module>c()</script>"), (2, None), (3, "<p>a();</p>"), (1, "<script>z")]
    got = scripts.script_statements(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, html string, call string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 0, "a(1)", "a", 1), (1, 1, "b", None, None), (1, 2, "c()", "c", 0), (1, 0, "z", None, None)], key=repr)


def test_property_names(spark):
    rows = [("Contact us", "contactUsLink"), ("Quick link", "quickLink"), ("3 more", "el3MoreLink"), ("", "Link"), (None, "Link"), ("x" * 60, "x" * 40 + "Link"), ("Ünder  way", "nderWayLink"), ("!!", "Link")]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(names.property_name(F.col("t"), "Link")).collect()
    assert [r[0] for r in got] == [n for _, n in rows]
    assert spark.createDataFrame([("de",)], "t string").select(names.property_name(F.col("t"), "fault")).first()[0] == "defaultEl"


def test_lists_windows_and_totals(spark):
    at = lambda h: datetime(2024, 3, 1) + timedelta(hours=h)
    rows = [("hot", at(k % 50), k, float(k)) for k in range(300)] + [("old", at(-24 * 40), 900, None), ("old", None, 901, 2.0), (None, at(49), 902, 1.0)]
    frame = spark.createDataFrame(rows, "g string, ts timestamp, id long, v double")
    got = reports.newest(frame, ["g"], "ts", "id", 3).collect()
    assert [(r.id) for r in sorted((r for r in got if r.g == "hot"), key=lambda r: r.place)] == [299, 249, 199] and sorted(r.id for r in got if r.g == "old") == [900, 901]
    windows = {r.g: (r.last_1, r.last_30, r.days, r.months) for r in reports.before_newest(frame, ["g"], "ts", (1, 30)).collect()}
    assert windows == {"hot": (150, 300, 3, 1), "old": (0, 0, 1, 1), None: (1, 1, 1, 1)}
    shown = {r.g: (r.first, r.more) for r in reports.capped(frame, ["g"], ["id"], "id", 4).collect()}
    assert shown == {"hot": ([0, 1, 2, 3], 296), "old": ([900, 901], 0), None: ([902], 0)}
    totals = {(r.g, r.level): (r.n, r.total) for r in reports.totals(frame, ["g"], F.col("v").cast("long")).collect()}
    assert totals == {("hot", 0): (300, sum(range(300))), ("old", 0): (2, 2), (None, 0): (1, 1), (None, 1): (303, sum(range(300)) + 3)}
    none = frame.where("false")
    assert reports.newest(none, ["g"], "ts", "id", 3).count() == reports.before_newest(none, ["g"], "ts", (1,)).count() == reports.capped(none, ["g"], ["id"], "id", 4).count() == 0


def test_tolerant_properties_and_sentences(spark):
    rows = [(1, '{"k": 5, "x": {"y": 1}}'), (2, "{bad"), (3, None), (4, ""), (5, "[1, 2]"), (6, '{"k": "no"}'), (7, "{}"), (8, '"k"')]
    got = {r.event_id: (r.k, r.is_object, r.n_props) for r in queries.event_props(spark.createDataFrame(rows, "event_id long, props string")).collect()}
    assert got == {1: (5, True, 2), 2: (None, False, 0), 3: (None, False, 0), 4: (None, False, 0), 5: (None, False, 0), 6: (None, True, 1), 7: (None, True, 0), 8: (None, False, 0)}
    texts = [(1, "One two. Three! four? Five"), (2, None), (3, " \n"), (4, "no end"), (5, "A. B. C"), (6, "End.\n\nNext one here")]
    got = {r.doc_id: (r.n_sentences, r.longest) for r in queries.document_sentences(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2), 2: (0, 0), 3: (0, 0), 4: (1, 2), 5: (3, 1), 6: (2, 3)}


def test_findings_on_the_wire(spark):
    rows = [(k, f"https://a.test/{k}", "<p>x</p>") for k in range(20)] + [(50, "https://b.test/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    view, sights = elements.page_view(pages).cache(), facts.page_facts(pages).cache()
    got = {(r.host, r.id): r for r in reports.wire_findings(view, sights, rules.failed_checks(pages, view, sights)).collect()}
    title = got["a.test", "seo.missing-title"]
    assert (title.severity, title.effort, title.effort_label, title.points, title.more) == ("high", "quick", "under an hour", 18, 8)
    assert title.pages == "\n".join(f"/{k}" for k in range(12))
    assert got["b.test", "seo.missing-lang"].pages == "/" and got["b.test", "readiness.no-terms"].pages is None
    order = [r for r in sorted((r for r in got.values() if r.host == "a.test"), key=lambda r: r.position)]
    weights = [rules.WEIGHTS[r.severity] for r in order]
    assert weights == sorted(weights, reverse=True) and [r.position for r in order] == list(range(1, len(order) + 1))
