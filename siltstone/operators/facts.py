"""What a site's pages say of its readiness and design, measured from their html alone, and the checks that these facts decide."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions import urls
from ..functions.html import host_of, path_of
from ..functions.markup import Element, Page, parsed
from .checks import DESIGN, SITE, Check, findings
from .readiness import COMMERCE_HREF, GATED, POLICIES, commercial, form_problems, third_party_kind

# Analytics by their addresses and calls, consent platforms, captchas, marks of component kits, contact details, emoji.
ANALYTICS = [
    r"googletagmanager\.com/gtag|google-analytics\.com|\bgtag\(", r"googletagmanager\.com/gtm", r"plausible\.io", r"usefathom\.com", r"posthog\.com|posthog\.js", r"umami\.",
    r"/_vercel/insights", r"matomo|piwik", r"simpleanalytics", r"static\.cloudflareinsights\.com",
]
CONSENT = r"(?i)cookiebot|onetrust|cookieyes|termly|iubenda|klaro|osano|cookieconsent|usercentrics"
CAPTCHA = r"(?i)recaptcha|hcaptcha|turnstile|friendly-?challenge"
LUCIDE = re.compile("lucide", re.IGNORECASE)
SHADCN = re.compile(r"\b(?:bg-background|text-foreground|bg-muted|text-muted-foreground|border-input|ring-offset-background|bg-primary|text-primary-foreground)\b")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d ()-]{7,}\d"
COMPANY = r"\b(?:Ltd|Limited|LLC|L\.L\.C\.|Inc\.?|Incorporated|GmbH|Pty|B\.V\.|S\.A\.|Pvt|Private Limited|LLP)\b|©|(?i:\bcopyright\b)"
EMOJI = "[\U0001f300-\U0001faff\u2600-\u27bf\ufe0f\u2190-\u21ff\u2b00-\u2bff]"
FOCUS_NONE = r":focus(?!-visible)[^{]*\{[^}]*outline\s*:\s*(?:none|0)"
FOOTER = 4000
#: Checks that html decides; other facts (status codes, geometry, computed styles) are not in it.
MEASURED = (
    "readiness.no-privacy-policy readiness.no-terms readiness.no-cookie-policy readiness.no-consent-banner readiness.no-refund-policy readiness.no-data-deletion readiness.no-analytics "
    "readiness.no-call-to-action readiness.no-contact-details readiness.no-business-identity readiness.focus-outline-removed readiness.clickable-non-buttons readiness.many-third-parties"
).split()
FORMS: list[Check] = [
    ("readiness.form-submit-unverified", "readiness", "'high'", "unverifiable > 0"),
    ("readiness.form-no-validation", "readiness", "'medium'", "unvalidated > 0"),
    ("readiness.form-unlabelled", "readiness", "'medium'", "unlabelled > 0"),
    ("readiness.no-spam-protection", "readiness", "'medium'", "unprotected > 0"),
]
SITE_CHECKS: list[Check] = [c for c in SITE if c[0] in MEASURED] + FORMS
DESIGN_CHECKS: list[Check] = [c for c in DESIGN if c[0].split(".")[1] in ("emoji-headings", "lucide-icons", "untouched-shadcn", "buzzword-copy", "em-dash-density", "hover-opacity")]

HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)|(?:left|top)\s*:\s*-\d{4,}px", re.IGNORECASE)
FLOATING = re.compile(r"position\s*:\s*(?:fixed|sticky)", re.IGNORECASE)
_FORM = pa.struct([*((c, pa.int32()) for c in ("fields", "required", "labelled")), *((c, pa.bool_()) for c in ("has_action", "has_handler", "novalidate", "captcha", "honeypot", "password"))])
_LINK = pa.struct([("href", pa.string()), ("text", pa.string())])
_SIGHTS = {
    "links": pa.list_(_LINK), "loaded": pa.list_(pa.string()), "script_urls": pa.string(), "inline": pa.string(), "html_class": pa.string(), "bars": pa.list_(pa.string()), "footer": pa.string(),
    "styles": pa.string(), "headings": pa.list_(pa.string()), "said": pa.string(), "lucide": pa.int64(), "shadcn": pa.int64(), "fake_buttons": pa.int64(), "ctas": pa.int64(), "forms": pa.list_(_FORM),
}
_SCHEMA = (
    "page_id long, url string, links array<struct<href: string, text: string>>, loaded array<string>, script_urls string, inline string, html_class string, bars array<string>, footer string, "
    "styles string, headings array<string>, said string, lucide long, shadcn long, fake_buttons long, ctas long, forms array<struct<fields: int, required: int, labelled: int, has_action: boolean, "
    "has_handler: boolean, novalidate: boolean, captcha: boolean, honeypot: boolean, password: boolean>>"
)


def _sights(page: Page) -> dict:
    """What of a page the facts are read from."""
    every = page.elements
    inside: dict[str, list] = {tag: [None] * len(every) for tag in ("form", "label", "nav", "header", "footer")}
    hidden = [False] * len(every)
    for k, e in enumerate(every):
        for tag, of in inside.items():
            of[k] = k if e.tag == tag else of[e.parent] if e.parent is not None else None
        hidden[k] = bool(HIDDEN.search(e.attributes.get("style", ""))) or (e.parent is not None and hidden[e.parent])
    said = [text for _, _, text in page.runs]
    own = [text for k, _, text in page.runs if k is not None and inside["footer"][k] is not None]
    scripts = [e for e in every if e.tag == "script"]
    addresses = [e.attributes.get("src", "") for e in scripts if "src" in e.attributes]
    asked = " ".join(addresses)
    loaded = addresses + [e.attributes["src"] for e in every if e.tag == "iframe" and "src" in e.attributes]
    loaded += [e.attributes["href"] for e in every if e.tag == "link" and "href" in e.attributes and e.attributes.get("rel", "").lower() in ("stylesheet", "preconnect")]
    classes = [e.attributes.get("class", "") for e in every]
    pressed = [e for e in every if e.tag in ("div", "span", "li") and "onclick" in e.attributes]
    return {
        "links": [{"href": e.attributes["href"], "text": e.text} for e in every if e.tag == "a" and "href" in e.attributes],
        "loaded": loaded, "script_urls": asked, "inline": "\n".join(e.text for e in scripts if "src" not in e.attributes),
        "html_class": next((e.attributes.get("class", "") for e in every if e.tag == "html"), ""),
        "bars": [_below(page, k) for k, e in enumerate(every) if e.tag in ("div", "section", "aside", "dialog") and FLOATING.search(e.attributes.get("style", ""))],
        "footer": " ".join(own if any(e.tag == "footer" for e in every) else said)[:FOOTER],
        "styles": "\n".join(e.text for e in every if e.tag == "style"),
        "headings": [e.text for e in every if len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456" and e.text],
        "said": " ".join(said),
        "lucide": sum(1 for e, c in zip(every, classes, strict=True) if e.tag == "svg" and LUCIDE.search(c)),
        "shadcn": sum(1 for c in classes if SHADCN.search(c)),
        "fake_buttons": sum(1 for e in pressed if e.attributes.get("role") != "button" and "tabindex" not in e.attributes),
        "ctas": sum(1 for k, e in enumerate(every) if (e.tag == "button" or (e.tag == "a" and "href" in e.attributes)) and inside["nav"][k] is None and inside["header"][k] is None and e.text),
        "forms": [_form(every, k, inside, hidden, asked) for k, e in enumerate(every) if e.tag == "form"],
    }


def _below(page: Page, at: int) -> str:
    """Text of an element and all inside it."""
    under = {at}
    for k in range(at + 1, len(page.elements)):
        if page.elements[k].parent in under:
            under.add(k)
        elif page.elements[k].depth <= page.elements[at].depth:
            break
    return " ".join(text for k, _, text in page.runs if k in under)


def _form(every: list[Element], at: int, inside: dict[str, list], hidden: list[bool], asked: str) -> dict:
    own = [k for k in range(at, len(every)) if inside["form"][k] == at]
    controls = [k for k in own if every[k].tag in ("input", "select", "textarea") and every[k].attributes.get("type", "").lower() != "hidden"]
    named = {every[k].attributes.get("for") for k in own if every[k].tag == "label"}
    attributes = [every[k].attributes for k in controls]
    submits = [every[k] for k in own if every[k].tag == "button" or (every[k].tag == "input" and every[k].attributes.get("type", "").lower() == "submit")]
    shown = " ".join(v for k in own[1:] for v in every[k].attributes.values())
    return {
        "fields": len(controls),
        "required": sum("required" in a or a.get("aria-required") == "true" for a in attributes),
        "labelled": sum(bool(a.get("aria-label") or a.get("aria-labelledby") or (a.get("id") and a["id"] in named) or inside["label"][k] is not None) for k, a in zip(controls, attributes, strict=True)),
        "has_action": bool(every[at].attributes.get("action")),
        "has_handler": "onsubmit" in every[at].attributes or any("onclick" in b.attributes for b in submits),
        "novalidate": "novalidate" in every[at].attributes,
        "captcha": bool(re.search(CAPTCHA, shown) or re.search(CAPTCHA, asked)),
        "honeypot": any(hidden[k] for k in controls),
        "password": any(a.get("type", "").lower() == "password" for a in attributes),
    }


def page_sights(pages: DataFrame) -> DataFrame:
    """page_id, url and what of each page the facts are read from. One scan, no shuffle; null html reads as empty."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                piece = batch.slice(k, 64)
                rows = [_sights(parsed(html)) for html in piece.column(2).to_pylist()]
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in _SIGHTS.items()]
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], *columns], names=["page_id", "url", *_SIGHTS])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, _SCHEMA)


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the facts of each page by name; `origins` are the third parties that it loads from."""
    sights = page_sights(pages)
    hrefs = F.transform("links", lambda x: F.regexp_replace(x["href"], r"^[A-Za-z]+://[^/?#]+|[?#].*$", ""))
    named = lambda p: F.exists(hrefs, lambda h: h.rlike(f"(?i){p}")) | F.exists("links", lambda x: x["text"].rlike(f"(?i){p}"))
    code = F.concat_ws("\n", "script_urls", "inline")
    schemed = F.transform("loaded", lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u))
    origins = F.array_distinct(F.filter(F.transform(schemed, lambda u: urls.origin(u)), lambda o: (o != "") & (o != F.coalesce(urls.origin(F.col("url")), F.lit("")))))
    bars = F.exists("bars", lambda b: b.rlike("(?i)cookie|consent") & b.rlike("(?i)accept|agree|allow|reject|decline|manage|preferences"))
    linked = lambda scheme: F.exists("links", lambda x: F.startswith(x["href"], F.lit(scheme)))
    dashes = F.regexp_count("said", F.lit("—")).cast("long")
    words = F.regexp_count("said", F.lit(r"\S*[A-Za-z0-9]\S*"))
    focus = F.when(F.col("styles").rlike(r":focus-visible[^{]*\{[^}]*outline"), 0).otherwise(F.regexp_count("styles", F.lit(FOCUS_NONE)))
    hovers = F.filter(F.split("styles", r"\}"), lambda r: r.rlike(r":hover[^{]*\{[^}]*opacity\s*:") & r.rlike(r"(?i)button|\.btn|a[:.\s]"))
    return sights.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        *(named(p).alias(f"has_{policy}") for policy, p in POLICIES.items()),
        (commercial(F.col("said")) | F.exists("links", lambda x: x["href"].rlike(COMMERCE_HREF))).alias("commercial"),
        origins.alias("origins"),
        sum((code.rlike(p).cast("long") for p in ANALYTICS[1:]), code.rlike(ANALYTICS[0]).cast("long")).alias("analytics"),
        (F.concat_ws(" ", "script_urls", "html_class").rlike(CONSENT) | bars).alias("has_banner"),
        "forms", F.when(F.col("ctas") == 0, 0).alias("home_ctas"),  # how many are on the first screen is not in html, unless there are none
        (F.col("footer").rlike(EMAIL) | linked("mailto:")).alias("has_email"), (F.col("footer").rlike(PHONE) | linked("tel:")).alias("has_phone"), F.col("footer").rlike(COMPANY).alias("has_company"),
        focus.cast("long").alias("focus_suppressed"), "fake_buttons",
        F.size(F.filter("headings", lambda h: h.rlike(EMOJI))).cast("long").alias("emoji_headings"), "lucide", "shadcn",
        F.size(texts.buzzwords(F.col("said"))).cast("long").alias("buzzwords"), dashes.alias("dashes"),
        F.when(words > 0, F.floor(dashes / words * 10000 + 0.5) / 10).otherwise(0.0).alias("dashes_per_1000"), F.size(hovers).cast("long").alias("hover_opacity"),
    )


def site_facts(facts: DataFrame) -> DataFrame:
    """The facts of each host from those of its pages (`page_facts`, written): policies, trackers, forms and signs of all pages, contact details and calls to action of the home page.

    Third parties are counted by host and origin first, so that neither a host's pages nor its origins come together in a task.
    """
    some = lambda c: F.max(c).alias(c)
    home: Column = F.min_by(F.struct("has_email", "has_phone", "has_company", "home_ctas"), F.struct(F.col("path") != "/", "page_id")).alias("home")
    flags = [*(f"has_{p}" for p in POLICIES), "commercial", "has_banner"]
    sums = ("analytics", "fake_buttons", "focus_suppressed")
    sites = facts.groupBy("host").agg(*map(some, flags), *(F.sum(c).alias(c) for c in sums), F.sum(F.size("forms")).alias("forms"), home)
    origins = facts.select("host", F.explode("origins").alias("origin")).distinct()
    parties = origins.groupBy("host").agg(F.count(F.lit(1)).alias("third_parties"), F.count_if(third_party_kind(F.col("origin")).isin(*GATED)).alias("trackers"))
    forms = facts.select("host", "page_id", F.posexplode("forms").alias("at", "f")).select("host", F.struct("host", "page_id", "at").alias("form"), "f.*")
    kinds = form_problems(forms).groupBy(F.col("form.host").alias("host")).agg(
        *(F.count_if(F.col("kind").isin(*names)).alias(c) for c, names in (("unverifiable", ["unverifiable-submit"]), ("unvalidated", ["no-validation", "no-required"]), ("unlabelled", ["unlabelled"]), ("unprotected", ["no-spam-protection"])))
    )
    counted = ["third_parties", "trackers", "unverifiable", "unvalidated", "unlabelled", "unprotected"]
    return sites.select("host", *flags, *sums, "forms", "home.*").join(parties, "host", "left").join(kinds, "host", "left").fillna(0, counted)


def site_findings(facts: DataFrame) -> DataFrame:
    """host, rule, area, severity of each check that a host's pages fail by what their html says."""
    return findings(site_facts(facts), ["host"], SITE_CHECKS)


def design_findings(facts: DataFrame) -> DataFrame:
    """page_id, host, rule, area, severity of each sign of a template that a page shows in its html."""
    return findings(facts, ["page_id", "host"], DESIGN_CHECKS)
