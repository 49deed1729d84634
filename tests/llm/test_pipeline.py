"""Each stage of the pipeline against brute force on the stage's own input, and the whole run against the last stage."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import mixing, queries
from siltstone.llm.quality import CAPITALS, PUNCTUATION, SYMBOLS, chi2_cdf, chi2_quantile, estimates
from siltstone.llm.store import written

FOLDER = "/root/testdata/sf0.01"
FLOORS = np.array([0.06, 0.15, 0.15, 0.08, 0.06, 0.06])


def statistics(text):
    """words, words in repeated windows, and the six transformed statistics of a text."""
    raw = (text or "").encode()
    words = raw.split()
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n, m = max(len(words), 1), max(len(lines), 1)
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    capitals, marks = (sum(b in kind for b in raw) for kind in (CAPITALS, PUNCTUATION))
    values = [math.log2(1 + chars / n), math.log2(1 + 20 * symbols / n), math.sqrt((len(lines) - len(set(lines))) / m), math.sqrt(len(twice) / n), math.log2(1 + capitals / n), math.log2(1 + marks / n)]
    return len(words), len(twice), np.floor(np.array(values) * 1024) / 1024


def squared(x, mean, inverse):
    return np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)


def estimate(x):
    """Centre, inverse scatter and log-determinant of the nearest three quarters: the best of random starts, by exact ranks."""
    scale, h, rng, best = 0.75 / chi2_cdf(chi2_quantile(0.75, 6), 8), math.ceil(0.75 * len(x)), np.random.default_rng(1), None
    for _ in range(12):
        near = x[rng.choice(len(x), min(len(x), 20), replace=False)]
        last = math.inf
        while True:
            mean, scatter = near.mean(axis=0), np.cov(near.T, bias=True) * scale + np.diag(FLOORS**2)
            inverse, logdet = np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]
            if len(near) == h and logdet > last - 1e-9:
                break
            last = logdet if len(near) == h else math.inf
            near = x[np.argsort(squared(x, mean, inverse), kind="stable")[:h]]
        if best is None or last < best[2]:
            best = mean, inverse, last
    return best


def cells_of(rows):
    """The rows that pass the base rules, their statistics, and which of them are judged by the estimate of which."""
    stats = [statistics(r["text"]) for r in rows]
    good = [k for k, (n, twice, _) in enumerate(stats) if n >= 50 and 100 * twice <= 50 * n]
    pairs = Counter((rows[k]["lang"], rows[k]["source"]) for k in good)
    pooled = Counter()
    for (lang, _), n in pairs.items():
        pooled[lang] += n if n < 100 else 0
    cells = defaultdict(list)
    for k in good:
        pair = (rows[k]["lang"], rows[k]["source"])
        cells[pair if pairs[pair] >= 100 else pair[:1] if pooled[pair[0]] >= 100 else ()].append(k)
    return stats, good, cells


def quality(rows):
    """Far rows go. The cut lies where no row's distance is, so that two estimates must agree on the verdict but not on distances."""
    stats, good, cells = cells_of(rows)
    kept = set()
    for name, members in cells.items():
        mean, inverse, _ = estimate(np.array([stats[k][2] for k in (members if name else good)]))
        x, words = np.array([stats[k][2] for k in members]), np.array([stats[k][0] for k in members])
        far = squared(x, mean, inverse) * words / (words + 40)
        cut = chi2_quantile(1 - 1e-12, 6)
        assert not ((far > 0.8 * cut) & (far < 1.25 * cut)).any()
        kept |= {k for k, f in zip(members, far > cut, strict=True) if not f}
    return [rows[k] for k in sorted(kept)]


def lines(rows):
    spaces, sites = " \t\n\v\f\r", defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            sites[line.strip(spaces)] |= {r["source"]} - {None}
    gone = {line for line, on in sites.items() if line and len(on) >= 10}
    out = []
    for r in rows:
        text = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if x.strip(spaces) not in gone)
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def near(rows):
    sets = {}
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root, where, common = {i: i for i in sets}, defaultdict(list), Counter()
    for i in sorted(sets):
        for shingle in sets[i]:
            common.update((j, i) for j in where[shingle])
            where[shingle].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def mixed(rows, columns):
    import pandas as pd

    docs = pd.DataFrame(rows, columns=columns)  # noqa: F841 (read by the SQL)
    copies = dict(duckdb.sql(f"select doc_id, copies from ({mixing.MIX_SQL.format(docs='docs')})").fetchall())
    return [r for r in rows for _ in range(copies[r["doc_id"]])]


def encoded(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    library.no_truncation()
    library.no_padding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        out.append({"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": sha(np.array(ids, "<u4").tobytes()), "decoded_sha256": sha(library.decode(ids, skip_special_tokens=False).encode())})
    return out


def same(left, right):
    key = lambda r: sorted((k, repr(v)) for k, v in r.items())
    assert sorted(map(key, left)) == sorted(map(key, right))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", FOLDER])
def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (quality, lines, near, lambda rows: mixed(rows, columns), encoded), strict=True):
        rows = [r.asDict() for r in docs.collect()]
        docs = written(stage(spark, docs, folder), "stage")
        got = [r.asDict() for r in docs.collect()]
        same(got, brute(rows))
        assert name == "token ids" or docs.columns == columns
        assert got
    same([r.asDict() for r in corpus_pipeline.run(spark, folder).collect()], got)


def test_estimates_reach_the_smallest_determinant(spark):
    """Of each cell, the operator's determinant is about that of the best of many random starts by exact ranks."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    stats, good, cells = cells_of(rows)
    groups = {str(name): good if not name else members for name, members in cells.items()} | {"()": good}
    points = [(name, *map(float, stats[k][2])) for name, members in groups.items() for k in members]
    got = {r.cell: r.logdet for r in estimates(spark.createDataFrame(points, "cell string, " + ", ".join(f"x{k} double" for k in range(6)))).collect()}
    assert got.keys() == groups.keys()
    for name, members in groups.items():
        assert got[name] <= estimate(np.array([stats[k][2] for k in members]))[2] + 0.15, name


def test_odd_and_empty_documents(spark, tmp_path):
    """Null ids, texts, languages and sources, repeated rows, blank texts and columns named as inner ones pass every stage."""
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    rows = [(None, body(0), "en", "a"), (1, body(1), None, None), (2, None, None, "a"), (3, "", "en", "b"), (4, " \n ", "en", "b"), (5, body(5), "de", "b"), (6, body(5), "de", "b"), (7, body(7), "en", "a"), (7, body(7), "en", "a")]
    inner = ["copies", "key", "kept", "row", "id", "bad_id", "mix_copy", "copy", "cut_pos", "n_lines", "n_removed", "size", "u", "rank", "bin", "line", "cell", "a", "b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in inner)
    odd = spark.createDataFrame([(*r, None, *inner) for r in rows], schema)
    for name, docs in (("odd", odd), ("none", odd.where("false"))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, (_, function) in enumerate(corpus_pipeline.STAGES[:-1]):
            before, docs = docs, written(function(spark, docs, str(tmp_path / name)), "stage")
            assert docs.columns == before.columns
            assert all(r[c] == c for r in docs.collect() for c in inner)
            if name == "odd" and stage < 3:
                assert sorted(str(r.doc_id) for r in docs.collect()) == [["1", "5", "6", "7", "7", "None"], ["1", "5", "6", "7", "7", "None"], ["1", "5", "7", "7", "None"]][stage]
        assert (corpus_pipeline.run(spark, str(tmp_path / name)).count() > 0) == (name == "odd")
