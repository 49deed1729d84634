"""Word runs, whitening and the quality classifier against brute force, on odd rows, and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import quality_classifier, queries, runs, whitening

FOLDER = "/root/testdata/sf0.001"


def brute_runs(w, least=6, times=4):
    n, found = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, times * p):
                found.setdefault((s, i - s + p), p)  # the smallest period first
            i += 1
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_of_periodic_words():
    rng = random.Random(1)
    for _ in range(4000):
        letters, w = rng.randint(1, 4), []
        for _ in range(rng.randint(0, 4)):
            w += [rng.randrange(letters) for _ in range(rng.randint(1, 5))] * rng.randint(1, 7)
            w += [rng.randrange(letters) for _ in range(rng.randint(0, 3))]
        assert runs.runs_of(runs.numbered(w)) == brute_runs(w), w
        assert runs.runs_of(runs.numbered(w), 2, 3) == brute_runs(w, 2, 3), w


class Counted:
    asked = 0

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Counted.asked += 1
        return self.value == other.value

    def __lt__(self, other):
        Counted.asked += 1
        return self.value < other.value


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [
    fibonacci, lambda n: [k.bit_count() & 1 for k in range(n)], lambda n: [0] * n, lambda n: (fibonacci(97) * n)[:n], lambda n: [0 if k & (k - 1) else 1 for k in range(n)],
    lambda n: [x for k in range(n) for x in [0] * k + [1]][:n], lambda n: list(range(n, 0, -1)),
])
def test_runs_ask_few_comparisons(words):
    for n in (2000, 16000):
        for sign in (1, -1):
            w = [Counted(sign * x) for x in words(n)] + [Counted(-(10**9))]
            Counted.asked = 0
            edges = sorted(runs.repetitive_edges(w, 2), key=lambda e: -e[0])
            runs.extended_left(w, edges)
            assert Counted.asked < 10 * n


def expected_runs(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute_runs(words)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        sha("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def test_word_runs_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_word_runs(spark, FOLDER).collect()}
    short = [r for r in docs if len(r.text or "") < 20000]
    assert len(got) == len(docs) and len(short) > 190
    assert all(got[r.doc_id] == expected_runs(r.doc_id, r.text) for r in short)
    assert any(x[0] for x in got.values())


def test_word_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a " * 6), (4, "b " * 5), (5, "x y " * 4 + "z"), (5, "x y " * 4 + "z"), (6, "w " * 60000), (7, "é é é é " * 10), (8, "a b " * 4 + "a a a a a a")]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start long, runs string")
    got = {}
    for r in runs.digests(frame, plant=False).collect():
        got.setdefault(r.doc_id, []).append((r.n_runs, r.start, r.length, r.period, r.exponent_milli))
    assert got[1] == got[2] == got[3] == got[4] == [(0, None, None, None, None)]
    assert got[None] == [(1, 0, 6, 1, 6000)] and got[5] == [(1, 0, 8, 2, 4000)] * 2 and got[6] == [(1, 0, 60000, 1, 60000000)] and got[7] == [(1, 0, 20, 1, 20000)]
    assert got[8] == [(2, 0, 9, 2, 4500)]
    texts = {r.doc_id: (r.collapsed, len(r.runs)) for r in runs.word_runs(frame).collect()}
    assert texts[5] == ("x y z", 1) and texts[1] == ("", 0)
    assert runs.digests(frame.where("false")).count() == runs.word_runs(frame.where("false")).count() == 0


def whitened_by_numpy(x):
    mean = x.mean(axis=0)
    cov = (x - mean).T @ (x - mean) / len(x)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:32]
    return (x - mean) @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


@pytest.mark.parametrize("files", [1, 7])
def test_whitening_against_numpy(spark, tmp_path, files):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    vectors.repartition(files).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_whitening(spark, str(tmp_path)).toPandas()
    rows = vectors.orderBy("vec_id").toPandas()
    x = np.floor(np.stack(rows["embedding"]).astype(float) * 64) + 1_000_000
    want, explained = whitened_by_numpy(x)
    made = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    sign = np.sign((made * want).sum(axis=0))
    assert np.abs(made - want * sign).max() < 1e-8
    one = got[got["vec_id"] == rows["vec_id"][0]].sort_values("component")
    assert np.abs(one["explained"].to_numpy() / explained - 1).max() < 1e-10
    assert (got["identity_error"] < 1e-9).all() and (got["n"] == len(x)).all()
    whole = x.astype(np.int64)
    deviation = ((len(x) * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == dict(zip(rows["vec_id"], deviation.tolist(), strict=True))


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    usable = [(k, rng.normal(size=3).tolist()) for k in range(20)] + [(20, [0.5, 0.25, -1.0])] * 3 + [(None, [1.0, 2.0, 3.0])]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, n long, whitened string"
    frame = spark.createDataFrame([(*r, 1, "x") for r in usable + odd], schema).repartition(5)
    got = whitening.whitened(frame).toPandas()
    assert len(got) == 3 * len(usable) and (got["n"] == len(usable)).all() and set(got["component"]) == {1, 2, 3}
    assert (got["vec_id"] == 20).sum() == 9 and got["vec_id"].isna().sum() == 3
    want, _ = whitened_by_numpy(np.floor(np.array([v for _, v in usable]) * 64))
    made = got[got["vec_id"] < 20].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(made) - np.abs(want[:20])).max() < 1e-9
    flat = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)] + [(9, [1.0, 3.0])], "vec_id long, embedding array<double>")
    rows = whitening.whitened(flat).collect()
    assert {(r.component, r.whitened is None) for r in rows} == {(1, False), (2, True)} and {r.identity_error < 1e-9 for r in rows} == {True}
    large = spark.createDataFrame([(0, [0.0]), (1, [float(2**45)])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whitened(large).collect()] == [None, None]
    wide = spark.createDataFrame([(0, [0.0]), (1, [float(2**20)])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whitened(wide).collect()} == {2**52}
    assert whitening.whitened(frame.where("false")).count() == whitening.whitened(frame.where("vec_id = 90")).count() == whitening.whitened(frame.where("vec_id = 91")).count() == 0


def test_merging_gives_the_whole_scatter():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 6)) * 100)
    whole = whitening.Moments.of(x, True)
    cuts = np.split(x, [1, 2, 90, 333])
    merged = None
    for c in cuts:
        merged = whitening._both(merged, whitening.Moments.of(c, True))
    assert merged.n == 500 and merged.sums == whole.sums == x.sum(axis=0).astype(int).tolist()
    assert np.allclose(merged.scatter, whole.scatter, rtol=1e-10) and np.allclose(merged.scatter, np.cov(x.T) * 499, rtol=1e-9)


def test_classifier_against_numpy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.predict_all(docs, labels).collect()}
    x = {r.doc_id: np.array(quality_classifier.statistics_of(r.text)) for r in docs.select("doc_id", "text").collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == len(x) and all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    taught = [k for k in label if zlib.crc32(str(k).encode()) % 3 != 1 and k in x]
    rows = [np.array([x[k] for k in taught if label[k] == c]) for c in (0, 1)]
    covs = [np.cov(r.T, bias=True) for r in rows]
    n = [len(r) for r in rows]
    d, shrink, floor = len(quality_classifier.STATISTICS), 0.05, 0.02
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled)) + floor**2 * np.eye(d)
    density = []
    for c in (0, 1):
        alpha = max(shrink, d / (d + n[c]))
        cov = (1 - alpha) * (covs[c] + floor**2 * np.eye(d)) + alpha * pooled
        off = np.array([x[k] for k in got]) - rows[c].mean(axis=0)
        density.append(np.log(n[c] / sum(n)) - 0.5 * (np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) + np.linalg.slogdet(cov)[1]))
    want = 1 / (1 + np.exp(-(density[1] - density[0]) / d))
    assert np.abs(np.array([r.score for r in got.values()]) - want).max() < 1e-8
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    scored = queries.op13_quality_classifier(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "predicted", "quality").toPandas()
    right = scored["predicted"] == scored["quality"]
    assert len(scored) > 1000 and right.mean() > 0.98 and right[scored["quality"] == 0].mean() > 0.97
    rank, good = scored["score"].rank(), scored["quality"] == 1
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum() > 0.995


def test_classifier_on_odd_rows(spark):
    base = " ".join(f"word{k}, and" for k in range(40))
    rows = [(k, base + f" tail{k}.") for k in range(30)] + [(100 + k, "### $$$ &&& " * 20 + str(k)) for k in range(30)]
    rows += [(200, None), (201, ""), (None, base), (202, "w " * 40000), (203, base), (203, base)]
    docs = spark.createDataFrame([(*r, "y", 5.0, 0) for r in rows], "doc_id long, text string, label string, x0 double, score int")
    marked = [(k, int(k < 100)) for k, _ in rows if k is not None and k < 200] + [(200, 1), (201, None), (203, 0), (203, 1), (None, 0), (999, 0)]
    labels = spark.createDataFrame([(k, q, "z") for k, q in marked], "doc_id long, quality int, text string")
    got = [r for r in quality_classifier.predict_all(docs, labels).collect()]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 100} == {1} and {r.predicted for r in got if r.doc_id is not None and 100 <= r.doc_id < 200} == {0}
    only = quality_classifier.predict_all(docs, labels.where("quality = 0 and doc_id < 200"))
    assert {(r.score, r.predicted) for r in only.collect()} == {(0.0, 0)}
    assert {r.score for r in quality_classifier.predict_all(docs, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.predict_all(docs.where("false"), labels).count() == 0
    assert docs.select(F.max(quality_classifier.held_out(F.col("doc_id")).cast("int"))).first()[0] in (0, 1)


def language_model(rows, per_lang, k):
    """idf, centroids and their languages by loops over texts, from rows of lang and text."""
    def grams(text):
        raw, bins = text.lower().encode(), {}
        for n in (1, 2, 3, 4):
            for i in range(len(raw) - n + 1):
                value = int.from_bytes(raw[i : i + n], "big")
                at = (value * 2654435761 + n * 0x9E3779B1 & 0xFFFFFFFF) * 0x85EBCA6B % 2**32 >> 20
                bins[at] = bins.get(at, 0) + 1
        return bins

    df = np.zeros(4096)
    for _, text in rows:
        df[list(grams(text))] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1

    def vector(text):
        x = np.zeros(4096)
        for at, n in grams(text).items():
            x[at] = np.log1p(n) * idf[at]
        return x / np.linalg.norm(x)

    return vector, idf


def test_languages_by_their_definition(spark):
    from siltstone.llm import langid

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    taught = [(r.lang, r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang and any(map(str.isalpha, r.text or ""))]
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"), per_lang=20, k=3)
    vector, idf = language_model(taught, 20, 3)
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert sorted(model.langs) == sorted({lang for lang, _ in taught})
    for k, lang in enumerate(model.langs):
        texts = sorted({t for x, t in taught if x == lang}, key=lambda t: spark_hash(spark, t))[:20]
        x = np.stack([vector(t) for t in texts])
        centres = model.centroids[model.owner == k]
        own = np.argmax(x @ centres.T, axis=1)
        for c, centre in enumerate(centres):
            # a centroid is the mean direction of the texts nearest to it
            mean = x[own == c].sum(axis=0)
            assert np.allclose(centre, mean / np.linalg.norm(mean), atol=1e-4)
            assert np.isclose(model.floor[model.owner == k][c], 0.5 * (x[own == c] @ centre).min(), atol=1e-4)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        if any(map(str.isalpha, r.text or "")):
            cosine = vector(r.text) @ model.centroids.T
            assert np.isclose(got[r.doc_id].score, cosine.max(), atol=1e-4)
            assert cosine[model.owner == model.langs.index(got[r.doc_id].lang_pred)].max() > cosine.max() - 1e-4
            best = int(np.argmax(cosine))
            assert got[r.doc_id].rejected == (cosine[best] < model.floor[best]) or abs(cosine[best] - model.floor[best]) < 1e-4
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score, got[r.doc_id].rejected) == ("und", 0.0, True)


_HASHES: dict[str, int] = {}


def spark_hash(spark, text):
    if text not in _HASHES:
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", F.xxhash64("text").alias("h"))
        _HASHES.update({r.text: r.h for r in docs.collect()})
    return _HASHES[text]


def test_vectors_of_several_lengths_and_sizes(spark):
    from siltstone.llm import ann

    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 4))
    rows = [(k, (v * (1e200 if k % 3 == 0 else 1e-200 if k % 3 == 1 else 1.0)).tolist()) for k, v in enumerate(base)]
    odd = [(100, [1.0, 2.0]), (101, [1.0, 2.0, 3.0]), (150, [5.0]), (102, base[7].tolist()[:3])]
    got = ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), every=10)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {0, 10, 20, 30}
    for query, hits in found.items():
        cosine = unit @ unit[query]
        order = [k for k in np.argsort(-cosine, kind="stable") if k != query][:5]
        assert [v for _, v, _ in sorted(hits)] == order and np.allclose([s for *_, s in sorted(hits)], cosine[order])


def test_equal_hashes_of_unequal_words():
    """Where all words hash alike, and so all anchors, only equal runs of words have equal keys."""
    from siltstone.llm import substring_dedup
    from siltstone.llm.memo import Memo

    rng = random.Random(4)
    docs = [[b"w%d" % rng.randrange(3) for _ in range(rng.randint(20, 60))] for _ in range(200)]
    docs += docs[:20]
    seen = {}
    for words in docs:
        anchor, key, more, low, count = substring_dedup.contexts(words, Memo(lambda _: 7, 1000))
        assert len(set(anchor.tolist())) == 1
        for k, m, at, n in zip(key.tolist(), more.tolist(), low.tolist(), count.tolist(), strict=True):
            run = tuple(words[at : at + n + substring_dedup.WINDOW - 1])
            assert seen.setdefault((k, m), run) == run
    assert len(set(seen.values())) == len(seen)


def test_paths_that_another_thread_takes(spark):
    import threading

    from siltstone.llm.store import drop_tables, taken_paths, written

    made = {}
    with taken_paths() as mine:
        written(spark.range(3), "mine").count()
        other = threading.Thread(target=lambda: made.update(table=written(spark.range(5), "other")))
        other.start()
        other.join()
        with taken_paths() as inner:
            written(spark.range(2), "inner")
    assert len(mine) == len(inner) == 1
    drop_tables(mine + inner)
    assert made["table"].count() == 5


@pytest.mark.parametrize("spread", [0.3, 0.001])
def test_nearest_vectors_of_dense_groups(spark, spread):
    """Groups of 2,000 near directions, one of them along an axis: the scores are those of brute force."""
    from siltstone.llm import ann

    rng = np.random.default_rng(21)
    centres = np.concatenate([rng.normal(size=(3, 32)), np.eye(32)[:1] * 9])
    x = centres[np.arange(8000) % 4] + spread * rng.normal(size=(8000, 32))
    x[7900:] = x[:100] * 2  # equal directions
    got = {}
    for r in ann.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 8000, 50))
    for query, hits in got.items():
        cosine = np.delete(unit @ unit[query], query)
        assert np.allclose([hits[k][1] for k in range(1, 6)], np.sort(cosine)[::-1][:5], rtol=0, atol=1e-13)
        assert len({v for v, _ in hits.values()} - {query}) == 5


def test_the_best_of_an_id_of_many_vectors(spark):
    """An id that has many near vectors takes one place."""
    from siltstone.llm import ann

    rows = [(0, [1.0, 0.0, 0.0])] + [(7, [1.0, k / 1e5, 0.0]) for k in range(1, 900)] + [(10 + k, [1.0, 0.1 + k / 100, 0.0]) for k in range(9)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7, 10, 11, 12, 13]
