"""Operators on orders, graphs, pages and streams against plain Python, on hot keys, nulls and empty tables."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.functions.markup import parsed
from siltstone.operators import admission, constraints, crawl, elements, facts, graph, intervals, numbering, ordered, patterns, rules
from siltstone.streaming import states, tables, windows


def walked(links, starts, most_pages, broken_visits):
    queue, seen, pages, out = deque((s, 0, None) for s in starts), set(starts), 0, []
    for k in range(10**6):
        if not queue:
            return out
        node, depth, referrer = queue.popleft()
        over = pages >= most_pages or k >= most_pages + broken_visits
        out.append((k, node, depth, referrer, "skipped" if over else "visited" if node in links else "broken"))
        if not over and node in links:
            pages += 1
            for target in links[node]:
                if target not in seen:
                    seen.add(target)
                    queue.append((target, depth + 1, node))


@pytest.mark.parametrize("whole", [10**6, 100, 0])
def test_crawl_in_order_with_a_budget(spark, whole):
    rng = random.Random(5)
    data, starts, want = [], [], []
    for s, n in enumerate((1, 4, 60, 150)):
        names = [f"{s}/{k}" for k in range(n)]
        links = {x: list(dict.fromkeys(rng.choices(names, k=rng.randint(0, 5)))) for x in names if rng.random() < 0.8}
        first = rng.sample(names, min(2, n))
        data += [(f"s{s}", a, b) for a, b in links.items()]
        starts += [(f"s{s}", x, k) for k, x in enumerate(first)]
        want += [(f"s{s}", *r) for r in walked(links, first, 12, 6)]
    linked = spark.createDataFrame([*data, (None, "x", ["y"])], "origin string, node string, links array<string>")
    begin = spark.createDataFrame([*starts, (None, "x", 0), ("s9", "only", 3)], "origin string, node string, place long")
    got = crawl.crawl(linked, begin, 12, 6, whole)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*want, ("s9", 0, "only", 0, None, "broken")], key=repr)
    assert crawl.crawl(linked.where("false"), begin.where("false"), 12, 6, whole).count() == 0


def test_crawl_of_a_chain_takes_few_jobs(spark):
    rows = [(k, f"https://a.test/{k}" if k else "https://a.test/", f"<a href='/{k + 1}'>n</a>") for k in range(500)]
    linked = crawl.linked_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    starts = linked.where("page_id = 0").select("origin", "node", F.lit(0).cast("long").alias("place"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = crawl.crawl(linked, starts, 400, 10).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "other")
    assert [(r.node, r.depth, r.state) for r in sorted(got, key=lambda r: r.position)] == [
        (f"https://a.test/{k or ''}", k, "visited" if k < 400 else "skipped") for k in range(401)
    ]
    assert jobs <= 60


def test_dealt_tables_stay_where_they_are(spark):
    from siltstone.sources.tables import dealt, setting

    edges = dealt(spark.range(1000).select(F.struct(F.lit("o").alias("origin"), F.col("id").cast("string").alias("node")).alias("page"), F.lit("x").alias("links")), "page")
    asked = spark.range(990, 1010).select(F.struct(F.lit("o").alias("origin"), F.col("id").cast("string").alias("node")).alias("key"))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        met = asked.join(edges, F.col("key") == F.col("page"), "left")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert met.where("links is not null").count() == 10
    # the side asked for is shuffled and sorted, the dealt one is neither
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_seeds_and_links_of_pages(spark):
    rows = [(2, "https://a.test/x", "<a href='/y#t'>1</a><a href='/y'>2</a><a href='/p.png'>3</a>"), (1, "https://a.test/x", "<a href='z'>4</a>"), (3, "https://A.test/y/", None), (4, None, "x"), (None, "https://b.test/q?a=1", "")]
    got = crawl.page_crawl(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    # of the two rows of /x that of the lesser page_id counts
    assert [(r.node[8:], r.depth, r.state) for r in sorted(got, key=lambda r: (r.origin, r.position))] == [
        ("a.test/", 0, "broken"), ("a.test/x", 0, "visited"), ("a.test/y", 0, "visited"), ("a.test/z", 1, "broken"), ("b.test/", 0, "broken"), ("b.test/q?a=1", 0, "visited"),
    ]


def test_elements_of_odd_pages(spark):
    page = parsed("<nav><a href=/x>X <b>y</b></a></nav><main><ul><li>1<li>2</ul><p>a<p>b</div></p>c<script>'</p><a href=q>'</script></main><!-- <a href=c> --><A HREF='d>e'>&lt;z</A><a href=cut")
    assert [(e.tag, e.region) for e in page.elements] == [
        ("nav", "nav"), ("a", "nav"), ("b", "nav"), ("main", "main"), ("ul", "main"), ("li", "main"), ("li", "main"), ("p", "main"), ("p", "main"), ("script", "main"), ("a", ""),
    ]
    assert [t for _, _, t in page.runs] == ["X y", "1", "2", "a", "b", "c", "<z"]
    assert [(e.attributes["href"], e.text) for e in page.elements if e.tag == "a"] == [("/x", "X y"), ("d>e", "<z")]
    for text in (None, "", "<", "<<", "</", "<a", "<!--", "<p>" * 30000, "</p>" * 30000, '<a b="' * 30000, "<b>" * 3000 + "<p>x" * 3000):
        parsed(text)
    rows = [(1, "http://a.test/", "<h2>b</h2><h1>A</h1><h3>c</h3><h2>d</h2><h3> </h3><h3>e</h3>"), (2, None, None)]
    pages = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "page_id long, url string, html string, place long")
    assert [(r.place, r.level, r.text, r.under) for r in elements.headings(pages).collect()] == [(0, 2, "b", None), (1, 1, "A", None), (2, 3, "c", 1), (3, 2, "d", 1), (4, 3, "e", 3)]
    assert elements.blocks(pages.where("false")).count() == elements.elements(pages.where("false")).count() == elements.link_regions(pages).count() == 0


def test_rules_of_home_pages_and_scripts(spark):
    whole = "<html lang=en><meta name=viewport content=w><link rel='shortcut icon' href=i><meta property=og:title content=t><meta property=og:image content=i><script type='application/ld+json'>{}</script>"
    rows = [
        (1, "https://a.test/sub", "<title>s</title><script>const k='sk_live_" + "a" * 24 + "'</script><script type='application/ld+json'>{bad</script>"),
        (2, "https://a.test/", whole + "<title>h</title>"),
        (3, "https://b.test/only", "<p>bolt.newsletter</p><form><label>Acme Inc</label></form>"),
        (4, "https://c.test/x", '<a href="https://bolt.new/">b</a><p>Acme Inc</p>'),
    ]
    view = elements.page_view(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r.page_id, r.rule) for r in rules.page_findings(view).collect()}
    home = {r for r, *_ in rules.HOME_RULES}
    assert {x for x in got if x[1] in home and x[0] < 3} == set()
    assert {x[1] for x in got if x[0] == 3} & home == home - {"build.builder-fingerprints"}
    assert (4, "build.builder-fingerprints") in got and (4, "build.placeholder-content") in got and (3, "build.placeholder-content") not in got
    assert (1, "build.secret-in-javascript") in got and (1, "ai.structured-data-invalid") in got


def test_facts_of_sites(spark):
    form = "<form {0}><label>N <input name=n></label><input id=m><input type=hidden>{1}<button>Go</button></form>"
    rows = [
        (1, "https://a.test/x", "<footer>mail me@x.org</footer>" + form.format("", "")),
        (2, "https://a.test/", "<nav><a href=/p>Privacy</a><a href='/legal/terms'>T</a></nav><p>Buy now</p><script src='https://www.googletagmanager.com/gtag/js'></script><script src=//cdn.x.io/a.js></script><div style='position: fixed'>We use <b>cookies</b> <a href=#>accept</a></div><footer>Tel +49 30 1234567</footer>"),
        (3, "https://b.test/", form.format("action=/s novalidate", "<div style='opacity:0'><input></div>") + "<style>a:focus{outline:none} a:hover{opacity:.5}</style><div onclick=x()>1</div><span onclick=x()>2</span><li onclick=x() role=button>3</li><footer>© b</footer>" + "<svg class='lucide lucide-x'></svg>" * 5 + "<h2>Go \U0001f680</h2><p>seamless, world-class — and — so — on</p>"),
        (4, None, None),
    ]
    found = facts.page_facts(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, forms string")).cache()
    sites = {r.host: r for r in facts.site_facts(found).collect()}
    a, b = sites["a.test"], sites["b.test"]
    assert (a.has_privacy, a.has_terms, a.has_cookies, a.commercial, a.has_banner, a.analytics, a.third_parties, a.trackers, a.forms) == (True, True, False, True, True, 1, 2, 1, 1)
    assert (a.has_email, a.has_phone, a.has_company, a.home_ctas) == (False, True, False, None)
    assert (a.unverifiable, a.unvalidated, a.unlabelled, a.unprotected) == (1, 1, 1, 1) and (b.unverifiable, b.unvalidated, b.unlabelled, b.unprotected) == (0, 1, 1, 0)
    assert (b.focus_suppressed, b.fake_buttons, b.has_company) == (1, 2, True)
    rules_of = {}
    for r in facts.site_findings(found).collect():
        rules_of.setdefault(r.host, set()).add(r.rule.split(".")[1])
    assert rules_of["a.test"] == {"no-cookie-policy", "no-refund-policy", "no-data-deletion", "no-business-identity", "form-submit-unverified", "form-no-validation", "form-unlabelled", "no-spam-protection"}
    assert rules_of["b.test"] == {"no-privacy-policy", "no-terms", "no-data-deletion", "no-analytics", "no-contact-details", "focus-outline-removed", "clickable-non-buttons", "form-no-validation", "form-unlabelled"}
    assert {(r.page_id, r.rule.split(".")[1]) for r in facts.design_findings(found).collect()} == {(3, "emoji-headings"), (3, "lucide-icons"), (3, "buzzword-copy"), (3, "em-dash-density"), (3, "hover-opacity")}
    assert facts.site_facts(found.where("false")).count() == facts.design_findings(found.where("false")).count() == 0


def test_as_of_of_a_hot_key(spark):
    rng = random.Random(7)
    lefts = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)]), k, f"l{k}") for k in range(300)]
    rights = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)]), 1000 + k, rng.choice([None, "v", "w"])) for k in range(300)]
    want = set()
    for by, time, tie, label in lefts:
        near = [(t, i, v) for b, t, i, v in rights if b == by and t is not None and time is not None and t <= time]
        best = max(near, key=lambda x: x[:2], default=(None, None, None))
        want.add((by, time, tie, label, best[1], best[2]))
    left = spark.createDataFrame(lefts, "u long, t long, id long, label string")
    right = spark.createDataFrame(rights, "u long, t long, id long, v string")
    assert set(map(tuple, ordered.as_of(left, right, ["u"], "t", "id", ["id", "v"]).collect())) == want
    assert ordered.as_of(left.where("false"), right, ["u"], "t", "id", ["v"]).count() == 0
    assert ordered.as_of(left, right.where("false"), ["u"], "t", "id", ["v"]).where("last_v is null").count() == 300


def test_ranks_and_running_values_over_ranges(spark):
    rows = [("hot", k, None if k % 3 else k) for k in range(500)] + [("one", 0, None), (None, 1, 5), (None, 2, None)]
    parts = ordered.in_parts(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], ["k"])
    assert parts.where("g = 'hot'").select(ordered.PART).distinct().count() > 1
    got = {(r.g, r.k): (r.s, r.m, r.l) for r in ordered.running(ordered.running(ordered.running(parts, ["g"], ["k"], "sum", F.col("v"), "s"), ["g"], ["k"], "max", -F.col("v"), "m"), ["g"], ["k"], "last", F.col("v"), "l", current=False).collect()}
    assert got["one", 0] == (None, None, None) and got[None, 2] == (5, -5, 5)
    for k in range(500):
        seen = [x for x in range(0, k + 1, 3)]
        assert got["hot", k] == (sum(seen), 0, max((x for x in seen if x < k), default=None))
    assert [r["rank"] for r in ordered.ranked(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], ["k"]).where("g = 'hot'").orderBy("k").collect()] == list(range(500))


def test_overlap_ranks(spark):
    rng = random.Random(11)
    rows = [(key, k, *rng.choices(range(40 if key else 4000), k=2)) for key, n in ((0, 40), (1, 300), (2, 1)) for k in range(n)] + [(3, 0, None, 5), (3, 1, 2, 4), (None, 0, 1, 3), (None, 1, 2, 2)]
    want, spans = {}, {}
    for key, k, lo, hi in rows:
        if lo is None:
            want[key, k] = None
            continue
        lo, hi = min(lo, hi), max(lo, hi)
        rank = max((r + 1 for a, b, r in spans.get(key, []) if a < hi and lo < b), default=0)
        spans.setdefault(key, []).append((lo, hi, rank))
        want[key, k] = rank
    frame = spark.createDataFrame(rows, "key long, k long, lo long, hi long")
    assert {(r.key, r.k): r["rank"] for r in intervals.overlap_ranks(frame, "key", ["k"], "lo", "hi").collect()} == want
    assert intervals.overlap_ranks(frame.where("false"), "key", ["k"], "lo", "hi").count() == 0


@pytest.mark.parametrize("slots", [1, 2, 3])
def test_admission_in_order_of_arrival(spark, slots):
    rng = random.Random(31)
    rows = [(key, k, rng.randrange(400 if key == "hot" else 4000), rng.choice([0, 1, 3, 9])) for key, n in (("hot", 300), ("b", 50), (None, 20)) for k in range(n)] + [("n", 0, None, 3), ("n", 1, 5, None), ("n", 2, 5, -4)]
    want = {("n", 0): (None, None), ("n", 1): (None, None)}
    for key in {r[0] for r in rows}:
        free = [0] * slots
        for _, k, at, work in sorted((r for r in rows if r[0] == key and None not in r[2:]), key=lambda r: (r[2], r[1])):
            begin = max(at, free[0])
            free = sorted([*free[1:], begin + max(work, 0)])
            want[key, k] = (begin, begin + max(work, 0))
    frame = spark.createDataFrame(rows, "g string, k long, at long, work long")
    assert {(r.g, r.k): (r.started, r.ended) for r in admission.admitted(frame, "g", "k", "at", "work", slots).collect()} == want
    assert admission.admitted(frame.where("false"), "g", "k", "at", "work", slots).count() == 0


def test_unique_names(spark):
    rng = random.Random(13)
    rows = [("planted", k, b) for k, b in enumerate(["a", "a", "a2", "a", "a22", "a2", None, ""])]
    rows += [("late", k, b) for k, b in enumerate(["a2", "a", "a", "a3", "a"])]
    rows += [("hot", k, rng.choice(["Page"] * 20 + ["Page2", "Page1", "Page12", "Page02", "P", "Other"])) for k in range(400)]
    rows += [(None, 0, "x"), (None, 1, "x")]
    rng.shuffle(rows)
    want, used = {}, {}
    for group, k, base in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        taken = used.setdefault(group, set())
        name, i = base or "", 2
        while name in taken:
            name, i = f"{base or ''}{i}", i + 1
        taken.add(name)
        want[group, k] = name
    assert [want["planted", k] for k in range(5)] == ["a", "a2", "a22", "a3", "a222"]
    frame = spark.createDataFrame(rows, "g string, k long, base string")
    assert {(r.g, r.k): r["name"] for r in numbering.unique_names(frame, "g", "k", "base").collect()} == want
    assert numbering.unique_names(frame.where("false"), "g", "k", "base").count() == 0


def test_neighbourhoods_of_a_hub(spark):
    rng = random.Random(17)
    edges = {(a, b) for a in (f"n{k:03}" for k in range(120)) for b in rng.sample([f"n{k:03}" for k in range(120)], rng.randint(0, 4))}
    edges |= {("hub", f"n{k:03}") for k in range(120)} | {(f"n{k:03}", "hub") for k in range(0, 120, 2)}
    out = {}
    for a, b in sorted(edges):
        if a != b:
            out.setdefault(a, []).append(b)
    want = set()
    for start in out:
        seen, frontier = [start], [start]
        for _ in range(2):
            fresh = []
            for node in frontier:
                for target in out.get(node, ()):
                    if target not in seen and len(seen) < 40:
                        seen.append(target)
                        fresh.append(target)
            frontier = fresh
        want |= {(start, n, k) for k, n in enumerate(seen)}
    frame = spark.createDataFrame([*edges, (None, "x"), ("n000", None)], "src string, dst string")
    assert {(r.start, r.node, r.place) for r in graph.neighbourhoods(frame).collect()} == want
    assert graph.neighbourhoods(frame.where("false")).count() == 0


def test_constraints_and_quarantine(spark):
    made = constraints.Rules(("id",), {"positive": "v > 0"}, {"ref": ("other", "k")})
    rows = [(1, 5, 7), (None, 5, 7), (2, -1, 9), (3, None, None), (4, 0, 7)]
    frame = spark.createDataFrame(rows, "id long, v long, ref long")
    other = spark.createDataFrame([(7,), (7,), (None,)], "k long")
    good, bad, counts = constraints.quarantined(frame, made, {"other": other})
    assert sorted(map(tuple, good.collect())) == [(1, 5, 7), (3, None, None)]
    assert {r.id: r.violations for r in bad.collect()} == {None: ["id not null"], 2: ["positive", "ref in other.k"], 4: ["positive"]}
    assert counts == {"rows": 5, "id not null": 1, "positive": 2, "ref in other.k": 1}
    assert {r.rule: (r.n_rows, r.n_bad) for r in constraints.counted(frame, made, {"other": other}).collect()} == {"id not null": (5, 1), "positive": (5, 2), "ref in other.k": (5, 1)}
    assert {(r.n_rows, r.n_bad) for r in constraints.counted(frame.where("false"), made, {"other": other.where("false")}).collect()} == {(0, 0)}


def test_attached_turns_of_a_hot_conversation(spark):
    rng = random.Random(19)
    rows = [("hot", k, rng.choice(["user", "assistant", "assistant", None]), None if k % 7 == 0 else f"t{k}") for k in range(200)] + [("c", 0, "assistant", "x"), ("c", 1, "user", "y"), (None, 0, "user", "q"), (None, 1, "assistant", "r")]
    want = {}
    for conv in ("hot", "c", None):
        own = [r for r in rows if r[0] == conv]
        for i, (_, turn, role, _) in enumerate(own):
            if role != "user":
                opener = max((r[1] for r in own[:i] if r[2] == "user"), default=None)
                want[conv, turn] = (opener, None if opener is None else turn - opener, [(r[2], r[3]) for r in own[max(0, i - 2) : i]])
    frame = spark.createDataFrame(rows, "conv string, turn long, role string, text string")
    got = ordered.attached(frame, "conv", "turn", F.col("role") == "user", ["role", "text"]).collect()
    assert {(r.conv, r.turn): (r.opener, r.place, [tuple(b) for b in r.before]) for r in got} == want
    assert ordered.attached(frame.where("false"), "conv", "turn", F.col("role") == "user", ["text"]).count() == 0


def test_patterns_in_texts(spark):
    rng = random.Random(23)
    bag = ["the"] * 8 + ["a", "of", "x", "y"]
    texts = [" ".join(rng.choices(bag, k=rng.randint(0, 60))) for _ in range(60)]
    wanted = [" ".join(rng.choices(bag, k=rng.randint(1, 9))) for _ in range(40)] + ["THE  the\tthe", "", None, "zebra"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, "the x"), (None, "the x"), (99, None), (98, "The\nx")]
    items = [(k, t) for k, t in enumerate(wanted)] + [(None, "x y")]
    want = {}
    for item, p in items:
        pw = (p or "").lower().split()
        for doc, t in docs:
            w = (t or "").lower().split()
            n = sum(w[i : i + len(pw)] == pw for i in range(len(w) - len(pw) + 1)) if pw else 0
            if n:
                want[item, doc] = want.get((item, doc), 0) + n
    d, p = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.item_id, r.doc_id): r.n_found for r in patterns.holding(d, p, "doc_id", "item_id").collect()} == want
    assert patterns.holding(d, p.where("false"), "doc_id", "item_id").count() == patterns.holding(d.where("false"), p, "doc_id", "item_id").count() == 0


START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def folded(rows, now, limit):
    """State, counts and time of each user's run, one event after the other."""
    out = {}
    for event_id, ts, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        state, n, illegal, timeouts, since = out.get(user, ("none", 0, 0, 0, None))
        if state in ("queued", "running") and ts > since + limit:
            state, timeouts = "timed out", timeouts + 1
        asked = {"signup": "queued", "view": "running", "click": "running", "purchase": "succeeded", "error": "failed"}.get(kind)
        legal = asked in {"none": ["queued"], "queued": ["running", "failed"], "running": ["running", "succeeded", "failed"]}.get(state, ["queued"])
        out[user] = (asked if legal else state, n + 1, illegal + (not legal), timeouts, ts if legal else since)
    return {u: ("timed out", n, i, t + 1, s) if state in ("queued", "running") and now > s + limit else (state, n, i, t, s) for u, (state, n, i, t, s) in out.items()}


def test_run_states_after_a_restart(spark, tmp_path):
    rng = random.Random(29)
    rows = [(k, START + timedelta(minutes=7 * k + rng.randint(-40, 40)), rng.choice([1, 1, 1, 2, 3]), rng.choice(["signup", "view", "click", "purchase", "error", "odd"])) for k in range(240)]
    rows += [(900, START + timedelta(hours=20), 8, "signup"), (901, START, 9, "view")]
    rows.sort(key=lambda r: r[0] if r[0] < 900 else (r[1] - START).total_seconds() / 420)
    batches = [rows[:60], rows[60:130], rows[130:180], rows[180:]]
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    dropped = 0
    for batch in [*batches, [(950, START, 1, "signup")]]:  # the last one comes far too late
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        query = tables.run_to_end(states.run_states(stream, "5 hours", "2 hours"), target, check)
        dropped += tables.late_rows(query)
    got = {r.user_id: (r.state, r.n_events, r.illegal, r.timeouts, r.since) for r in states.latest(spark.read.parquet(target)).collect()}
    now = max(r[1] for r in rows) - timedelta(hours=2)
    assert got == folded(rows, now, timedelta(hours=5))
    assert dropped == 1


def test_users_share_keys_of_run_states(spark, tmp_path, monkeypatch):
    """However many users there are, the state has so many keys; runs of a key time out each at its own time."""
    monkeypatch.setattr(states, "KEYS", 3, raising=False)
    rng = random.Random(31)
    rows = [(k, START + timedelta(minutes=3 * k + rng.randint(-20, 20)), rng.randrange(40), rng.choice(["signup", "signup", "view", "click", "purchase", "error", None])) for k in range(600)]
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for batch in (rows[:350], rows[350:]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        query = tables.run_to_end(states.run_states(spark.readStream.schema(EVENTS).parquet(source), "5 hours", "2 hours"), target, check)
    assert max(operator["numRowsTotal"] for progress in query.recentProgress for operator in progress["stateOperators"]) <= 3
    got = {r.user_id: (r.state, r.n_events, r.illegal, r.timeouts, r.since) for r in states.latest(spark.read.parquet(target)).collect()}
    assert got == folded(rows, max(r[1] for r in rows) - timedelta(hours=2), timedelta(hours=5))


def test_late_rows_repeats_and_sessions(spark, tmp_path):
    minutes = lambda *ms: [(1000 + m, START + timedelta(minutes=m), 1, "view") for m in ms]
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    dropped = 0
    for batch in (minutes(0, 10, 100), minutes(300), minutes(20, 290, 305), minutes(600), minutes(900)):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(source)
        query = tables.run_to_end(windows.sessions(spark.readStream.schema(EVENTS).parquet(source), "30 minutes", "1 hour"), target, check)
        dropped += tables.late_rows(query)
    got = sorted((int((r.begin - START).total_seconds() / 60), int((r.end - START).total_seconds() / 60), r.n_events) for r in spark.read.parquet(target).collect())
    # 20 came after the watermark of 240; 290 did not
    assert got == [(0, 40, 2), (100, 130, 1), (290, 335, 3), (600, 630, 1)] and dropped == 1
    twice = tables.finished(windows.without_repeats(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source), ["user_id"], "1 hour"), "once")
    # one key: it stays known for an hour after the watermark, and returns afterwards
    assert 1 < twice.count() < 9
    pairs = tables.finished(windows.followed_by(spark.readStream.schema(EVENTS).parquet(source), spark.readStream.schema(EVENTS).parquet(source).withColumn("event_id", F.col("event_id") * 10), 900), "pairs")
    times = [0, 10, 100, 300, 20, 290, 305, 600, 900]
    assert sorted((r.first_id - 1000, r.second_id // 10 - 1000) for r in pairs.collect()) == sorted((a, b) for a in times for b in times if 0 <= b - a <= 15)
