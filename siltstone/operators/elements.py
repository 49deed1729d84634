"""Tables of what stands on pages: elements, links by region, headings, blocks of text, and a view of each page; html is read in one pass."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions import urls
from ..functions.html import host_of, path_of
from ..functions.markup import Element, Page, parsed, squeezed

# Controls whose text is no copy; characters of copy that are looked at for placeholders.
NO_COPY = frozenset("form label select button option".split())
COPY = 3000
# Signs that site builders leave (builder, pattern, evidence).
BUILDER_SIGNS = [
    ("Lovable", r"(?i)lovable-badge|Edit with Lovable|lovable\.dev/projects", "Lovable badge or project link"),
    ("Lovable", r"(?i)cdn\.gpteng\.co|gptengineer\.js", "gpt-engineer script"),
    ("Bolt", r"""(?i)Made (?:in|with) Bolt|bolt\.new/?["'?]""", "Bolt badge or link"),
    ("v0", r"(?i)v0\.dev/chat|Built with v0", "v0 link"),
    ("Vite scaffold", r'(?i)href="/vite\.svg"', "default Vite favicon"),
    ("Create React App scaffold", r"(?i)You need to enable JavaScript to run this app\.", "default CRA noscript text"),
]
WORD = re.compile(r"[A-Za-z0-9]")
HASH_ROUTE = re.compile(r"#!?/")
LOADED = ("img", "script", "iframe", "audio", "video", "source")


def _read(pages: DataFrame, rows_of: Callable[[Page], Iterator[tuple]], schema: str) -> DataFrame:
    """page_id and the rows that `rows_of` makes of each parsed page; no shuffle. A page is one unit of work."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece = batch.slice(k, 64)
                ids, rows = [], []
                for page_id, html in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    made = list(rows_of(parsed(html)))
                    ids += [page_id] * len(made)
                    rows += made
                columns = zip(*rows, strict=True) if rows else [()] * len(fields)
                arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], names=["page_id", *(name for name, _ in fields)])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(read, f"page_id long, {schema}")


def elements(pages: DataFrame) -> DataFrame:
    """page_id, place, tag, parent (place of the parent, null for the first), region, depth, attributes, text of each element, in the order they open. Null html has none."""

    def rows(page: Page) -> Iterator[tuple]:
        for k, e in enumerate(page.elements):
            yield k, e.tag, e.parent, e.region, e.depth, list(e.attributes.items()), e.text

    return _read(pages, rows, "place int, tag string, parent int, region string, depth int, attributes map<string,string>, text string")


def link_regions(pages: DataFrame) -> DataFrame:
    """page_id, place (0 for the page's first link), region (innermost nav, main, article, aside, header or footer; else empty), href, text of each link."""

    def rows(page: Page) -> Iterator[tuple]:
        for k, e in enumerate(e for e in page.elements if e.tag == "a" and "href" in e.attributes):
            yield k, e.region, e.attributes["href"], e.text

    return _read(pages, rows, "place int, region string, href string, text string")


def headings(pages: DataFrame) -> DataFrame:
    """page_id, place, level, text, under (place of the last heading of a lesser level before it, null if none) of headings with text, in order."""

    def rows(page: Page) -> Iterator[tuple]:
        path: list[tuple[int, int]] = []
        for k, e in enumerate(_headings(page)):
            level = int(e.tag[1])
            while path and path[-1][0] >= level:
                path.pop()
            yield k, level, e.text, path[-1][1] if path else None
            path.append((level, k))

    return _read(pages, rows, "place int, level int, text string, under int")


def _headings(page: Page) -> Iterator[Element]:
    return (e for e in page.elements if len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456" and e.text)


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, place, region, words, text of each run of visible text between borders of blocks, in order; words have an ASCII letter or digit."""

    def rows(page: Page) -> Iterator[tuple]:
        for k, (_, region, text) in enumerate(page.runs):
            yield k, region, sum(1 for w in text.split() if WORD.search(w)), text

    return _read(pages, rows, "place int, region string, words long, text string")


_VIEW = (
    "title string, lang string, description string, canonical string, robots string, og_title string, og_image string, has_viewport int, has_icon int, words long, "
    "n_h1 long, n_headings long, n_images long, n_missing_alt long, n_hash_routes long, n_json_ld long, n_json_ld_errors long, n_http_resources long, copy string, scripts string"
)


def _view_of(page: Page) -> Iterator[tuple]:
    metas: dict[str, str] = {}
    links: dict[str, str] = {}
    lang, title, icon, scripts, json_ld, errors, images, missing, hash_routes, http = "", "", 0, [], 0, 0, 0, 0, 0, 0
    for e in page.elements:
        a = e.attributes
        if e.tag == "meta":
            for key in ("name", "property"):
                metas.setdefault(f"{key} {a.get(key, '').lower()}", squeezed(a.get("content", "")))
        elif e.tag == "link":
            rel = a.get("rel", "").lower()
            links.setdefault(rel, a.get("href", ""))
            icon |= "icon" in rel.split()
        elif e.tag == "html":
            lang = lang or a.get("lang", "").strip().lower()
        elif e.tag == "title":
            title = title or e.text
        elif e.tag == "script":
            if a.get("type", "").lower() == "application/ld+json":
                json_ld += 1
                errors += not _is_json(e.text)
            elif "src" not in a:
                scripts.append(e.text)
        elif e.tag == "img":
            images += 1
            missing += "alt" not in a and a.get("role") != "presentation" and a.get("aria-hidden") != "true"
        elif e.tag == "a":
            hash_routes += bool(HASH_ROUTE.match(a.get("href", "")))
        if e.tag in LOADED and a.get("src", "").lower().startswith("http://"):
            http += 1
    controls = set()
    for k, e in enumerate(page.elements):
        if e.tag in NO_COPY or e.parent in controls:
            controls.add(k)
    copy = " ".join(text for k, _, text in page.runs if k not in controls)
    heads = [e.tag for e in _headings(page)]
    yield (
        title, lang, metas.get("name description", ""), links.get("canonical", ""), ", ".join(filter(None, (metas.get("name robots"), metas.get("name googlebot")))),
        metas.get("property og:title", ""), metas.get("property og:image", ""), int("name viewport" in metas), icon, sum(1 for _, _, t in page.runs for w in t.split() if WORD.search(w)),
        heads.count("h1"), sum(e.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for e in page.elements), images, missing, hash_routes, json_ld, errors, http, copy[:COPY], "\n".join(scripts),
    )


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def page_view(pages: DataFrame) -> DataFrame:
    """What the page rules ask of each page, from its elements, its html's builder signs and its URL. One scan, no shuffle; null html reads as empty."""
    # the url and the signs, which are of the html as written, go along
    signs = F.array_compact(F.array(*(F.when(F.coalesce("html", F.lit("")).rlike(p), e) for _, p, e in BUILDER_SIGNS)))
    view = _carried(pages.select("page_id", "html", "url", F.array_join(signs, "; ").alias("signs")))
    url = F.col("url")
    seven = view.withColumn("found", F.when(F.col("scripts").rlike(texts.ANY_SECRET), texts.secrets(F.col("scripts"))))
    has = lambda severity: F.coalesce(F.exists("found", lambda s: s["severity"] == severity), F.lit(False))
    return seven.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        "title", "lang", "description", "canonical",
        host_of(F.col("canonical")).alias("canonical_host"),
        "words",
        F.coalesce(F.startswith(F.lower(url), F.lit("https:")), F.lit(False)).alias("https"),
        F.coalesce(urls.staging(url), F.lit(False)).alias("staging"),
        F.coalesce(urls.private_path(path_of(url)), F.lit(False)).alias("private"),
        F.size(texts.labels(F.col("copy"), texts.PLACEHOLDERS)).cast("long").alias("n_placeholders"),
        "n_h1", "n_headings", "n_images", "n_missing_alt", "n_hash_routes", "n_json_ld", "n_json_ld_errors", "n_http_resources",
        (F.col("has_viewport") > 0).alias("has_viewport"),
        ((F.col("og_title") != "") & (F.col("og_image") != "")).alias("has_og"),
        (F.col("has_icon") > 0).alias("has_icon"),
        F.col("robots").rlike(r"(?i)\bnoindex\b").alias("noindex"),
        F.col("robots").rlike(r"(?i)\bnosnippet\b|max-snippet\s*:\s*0\b").alias("nosnippet"),
        "signs",
        has("critical").alias("secret_in_script"),
        has("info").alias("public_key_in_script"),
    )


def _carried(pages: DataFrame) -> DataFrame:
    """page_id, url, signs and the view of each page."""
    fields = [f.rsplit(" ", 1) for f in _VIEW.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                rows = [row for html in piece.column(1).to_pylist() for row in _view_of(parsed(html))]
                arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), piece.column(3), *arrays], names=["page_id", "url", "signs", *(n for n, _ in fields)])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", "url", "signs")
    return picked.mapInArrow(read, "page_id long, url string, signs string, " + _VIEW)
