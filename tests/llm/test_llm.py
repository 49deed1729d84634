"""The operators against brute force, exact round trips, and on nulls, empty tables and clashing columns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, bpe, langid, line_dedup, minhash, mixing, quality, queries, substring_dedup, token_files, warc

FOLDER = "/root/testdata/sf0.001"
#: Names that the operators use inside, as columns of their input.
INNER = ["row", "marks", "key", "id", "cut", "cut_pos", "bad_id", "copies", "size", "rank", "bin", "line", "cell", "hash", "least", "anchor", "at", "vector", "ids", "sha", "refers_to", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in INNER)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, columns named as inner ones."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base, "en", "a"), (2, base, "en", None), (3, None, None, "a"), (4, "", "en", "b"), (5, " \n\t ", None, None), (6, base + " tail", "de", "b"), (7, "x\n\ny, z.\n<|endoftext|> é ü", "de", "c"), (None, base, "en", "a"), (8, "w " * 30000, "en", "a"), (9, "b c", "de", "b"), (9, "b c", "de", "b")]
    return spark.createDataFrame([(*r, None, *INNER) for r in rows], SCHEMA)


def removed(rows):
    """kept words by id, by brute force."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words, gone = (text or "").encode().split(), set()
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            gone |= set(range(s, s + 20)) if window in seen else set()
            seen.add(window)
        out[doc] = (len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_CONTEXTS", most)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op1_substring_dedup(spark, FOLDER).collect()}
    assert got == removed(docs.select("doc_id", "text").collect())


def test_substring_dedup_odd_rows(odd):
    got = defaultdict(list)
    for r in substring_dedup.dedup(odd).collect():
        got[r.doc_id].append((r.n_words, r.n_removed))
    assert got == {1: [(60, 0)], 2: [(60, 60)], 3: [(0, 0)], 4: [(0, 0)], 5: [(0, 0)], 6: [(61, 60)], 7: [(5, 0)], None: [(60, 60)], 8: [(30000, 29999)], 9: [(2, 0), (2, 0)]}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.vocabulary())
    made.no_truncation()
    made.no_padding()
    return made


def test_bpe_and_token_files(spark, odd, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id is not null").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    rows = docs.distinct().collect()
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.digests(docs, queries.vocabulary()).collect():
        own = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(own), sha(np.array(own, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(library.decode(own, skip_special_tokens=False).encode())
    unique = docs.distinct()
    start = 0
    files = token_files.write_tokens(spark, unique, queries.vocabulary())
    for r in sorted(token_files.read_tokens(files).collect(), key=lambda r: r.doc_id):
        own = [*ids[r.doc_id], 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    judged = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert sum(judged) / len(judged) >= 0.9 and len(judged) >= 100


def test_a_language_of_one_repeated_text_is_learned(spark):
    german, english = "das ist ein Text in deutscher Sprache", "this is english text number {} and the rest"
    rows = [(k, german, "de") for k in range(3000)] + [(5000 + k, english.format(k), "en") for k in range(300)]
    docs = spark.createDataFrame([*rows, (9000, "123 ...", "xx"), (9001, None, "xx")], "doc_id long, text string, lang string")
    got = {(r.lang_pred, r["count"]) for r in langid.predict_all(spark, docs).groupBy("lang_pred").count().collect()}
    assert got == {("de", 3000), ("en", 300), ("und", 2)}
    sample = langid.sampled(docs.where("text is not null"), 50).collect()
    assert len(sample) == len({(r.lang, r.text) for r in sample}) == 1 + 50 + 1


def best_by_hand(ids, x, q, k=5):
    dots, norms = x @ x[q], np.sqrt((x * x).sum(axis=1))
    score = dots / (norms[q] * norms)
    score[ids == ids[q]] = -9
    at = np.lexsort((ids, -np.round(score, 12)))[:k]
    return ids[at].tolist(), score[at]


@pytest.mark.parametrize("rerank", [20, 200])
def test_nearest_vectors(spark, rerank):
    """20,000 vectors in loose clusters: recall, ranks, scores and their order."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 24))[rng.integers(0, 200, 20_000)] + 0.6 * rng.normal(size=(20_000, 24))).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<float>, vector string")
    got = defaultdict(dict)
    for r in ann.search(table, rerank=rerank).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    found, x, ids = 0, x.astype(np.float64), np.arange(20_000)
    for q in range(0, 20_000, 50):
        answers = got.pop(q)
        assert sorted(answers) == [1, 2, 3, 4, 5]
        listed = [answers[k] for k in range(1, 6)]
        assert listed == sorted(listed, key=lambda a: (-a[1], a[0]))
        for vec_id, score in listed:
            assert vec_id != q and abs(score - x[q] @ x[vec_id] / np.linalg.norm(x[q]) / np.linalg.norm(x[vec_id])) < 1e-12
        found += len(set(best_by_hand(ids, x, q)[0]) & {v for v, _ in listed})
    assert not got and found / 2000 >= 0.9


def test_nearest_vectors_ties(spark):
    """Of 401 equal vectors the smallest ids answer, and each id once, however often it is there."""
    rows = [(k, [1.0, 2.0, 0.5, -0.0]) for k in range(401)] * 2 + [(1000 + k, [float(k), 1.0, 0.0, 3.0]) for k in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(table, rerank=3).collect()}
    assert [got[0, k] for k in range(1, 6)] == [(k, 1.0) for k in range(1, 6)]
    assert [got[50, k][0] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    assert len(got) == 5 * 10


def test_near_duplicates(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        words = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_bbit_minhash(spark, FOLDER).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_base_counts(spark):
    rows = {r.doc_id: r for r in queries.op9_quality_outliers(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        text = r.text or ""
        words, got = text.encode().split(), rows[r.doc_id]
        where = defaultdict(list)
        for k in range(len(words) - 2):
            where[tuple(words[k : k + 3])].append(k)
        repeated = {k + j for ks in where.values() if len(ks) > 1 for k in ks for j in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert got.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (got.base_failed and got.kept)


def test_mix_with_unequal_importance(spark):
    """Over seeds, documents of equal size are taken as often as their importance says, and each draw fills the target."""
    rows = [(k, "a b", "s", 1.0 + k % 3) for k in range(60)]
    docs, seeds, taken = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double").coalesce(1), 12, defaultdict(int)
    for seed in range(seeds):
        drawn = mixing.mix(docs, share=0.4, seed=seed, importance=F.col("weight")).collect()
        assert abs(sum(r.taken for r in drawn) - 48) <= 1
        for r in drawn:
            taken[r.doc_id % 3] += r.copies
    # 24 of 60 documents are expected: 4, 8 and 12 of the 20 of each importance
    for k, want in enumerate((4, 8, 12)):
        assert abs(taken[k] / seeds - want) < 1.6, taken


def test_mix_gives_all_of_the_target_away(spark):
    """One document of very high importance is capped; the others get what the cap cuts off."""
    docs = spark.createDataFrame([(k, "a b c d e", "s", 1000.0 if k == 0 else 1.0) for k in range(200)], "doc_id long, text string, source string, w double")
    drawn = mixing.mix(docs, importance=F.col("w")).collect()
    assert sum(r.taken for r in drawn) == drawn[0].target == 1500 and max(r.copies for r in drawn) == 2
    # rows of one id and size are taken alike, and mixed() gives just those that mix() takes
    same = spark.createDataFrame([(k // 4, "a b", "s", str(k)) for k in range(400)], "doc_id long, text string, source string, size string")
    made = defaultdict(list)
    for r in mixing.mix(same, share=0.5).collect():
        made[r.doc_id].append(r.copies)
    assert all(len(set(c)) == 1 for c in made.values()) and sum(map(sum, made.values())) == 200
    rows = mixing.mixed(same, share=0.5)
    assert rows.columns == same.columns and rows.count() == 200 and rows.dropDuplicates().count() == 200


def test_source_targets(spark):
    """Weights by turn in order of code points, null last; the excess of full sources is divided anew."""
    sizes = {"b": 1000, "a": 10, "Z": 1000, None: 500, "c": 40}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    total = 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in open_)
        more = {s: 2.0 * sizes[s] for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not more:
            break
        full |= more
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(table, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == {s: round(full.get(s, level * weight[s]), 6) for s in order}


@pytest.mark.parametrize("block, bucket", [(300, 5), (2000, 4096)])
def test_large_classes_lose_no_link(spark, monkeypatch, block, bucket):
    """The ways for large buckets and classes give what the plain ones give."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plain = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == plain


OPERATORS = {
    "substring": lambda spark, docs: substring_dedup.dedup(docs),
    "bpe": lambda spark, docs: bpe.digests(docs, queries.vocabulary()),
    "tokens": lambda spark, docs: token_files.read_tokens(token_files.write_tokens(spark, docs, queries.vocabulary())),
    "language": lambda spark, docs: langid.predict_all(spark, docs),
    "mix": lambda spark, docs: mixing.mix(docs),
    "lines": lambda spark, docs: line_dedup.digests(docs),
    "quality": lambda spark, docs: quality.judged(docs),
    "near": lambda spark, docs: minhash.near_duplicates(docs),
}


#: What each operator gives for the odd rows, by id: the columns checked, and their values.
EXPECTED = {
    "bpe": ("n_tokens", {3: 0, 4: 0}),
    "tokens": ("n_tokens", {3: 1, 4: 1}),
    "language": ("lang_pred", {3: "und", 4: "und", 5: "und"}),
    "mix": ("size", {1: 60, 3: 0, 4: 0, 5: 0, 6: 61, 8: 30000, 9: 2}),
    "lines": ("n_lines", {1: 1, 3: 0, 4: 1, 5: 2, 7: 4}),
    "quality": ("kept", {1: True, 2: True, 3: False, 4: False, 5: False, 7: False, 8: False, 9: False}),
    "near": ("component_id", {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1, 8: 8, 9: 9}),
    "substring": ("n_words", {3: 0, 4: 0, 5: 0, 8: 30000}),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_tables(spark, odd, name):
    rows = OPERATORS[name](spark, odd).collect()
    assert len(rows) == odd.count()
    column, want = EXPECTED[name]
    for doc_id, value in want.items():
        assert {r[column] for r in rows if r.doc_id == doc_id} == {value}, doc_id
    assert sum(r.doc_id == 9 for r in rows) == 2
    assert OPERATORS[name](spark, odd.where("false")).count() == 0


def test_odd_vectors_and_pages(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (1, [0.6, 0.8]), (2, [float("nan"), 1.0]), (3, [None, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.search(vectors).collect()] == [(0, 1)]
    assert ann.search(vectors.where("false")).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/", ""), (3, "http://a/", "x" * 100000), (4, None, "x" * 100000)], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("sha", "refers_to", "last", "row", "at")})
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.archive(spark, pages)).collect()}
    assert got == {1: (0, "response", None), 2: (0, "revisit", 1), 3: (100000, "response", None), 4: (100000, "revisit", 3)}
    assert warc.read_archives(warc.archive(spark, pages.where("false"))).count() == 0
