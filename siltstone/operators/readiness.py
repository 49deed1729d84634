"""Third parties, policies and forms of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of third parties by patterns of their origins, first match first; the kinds that a banner gates; policies by patterns.
TRACKERS = [
    ("googletagmanager|google-analytics|analytics[.]google", "analytics"),
    ("doubleclick|googlesyndication|googleadservices", "advertising"),
    ("facebook[.]net|connect[.]facebook|facebook[.]com/tr", "advertising"),
    ("hotjar|clarity[.]ms|fullstory|logrocket|smartlook", "session recording"),
    ("segment[.](?:io|com)|rudderstack|mixpanel|amplitude|posthog", "product analytics"),
    ("intercom|drift[.]com|crisp[.]chat|tawk[.]to|hubspot", "chat and CRM"),
    ("sentry|bugsnag|rollbar|datadoghq", "error monitoring"),
    ("stripe|paypal|paddle|lemonsqueezy", "payments"),
    ("fonts[.]googleapis|fonts[.]gstatic", "fonts"),
]
GATED = ["analytics", "advertising", "session recording", "product analytics", "chat and CRM"]
POLICIES = {
    "privacy": "privacy|datenschutz|gizlilik",
    "terms": r"\bterms\b|\btos\b|conditions|nutzungsbedingungen",
    "cookies": "cookie",
    "refund": r"refund|returns?\b|cancellation|money.?back",
    "deletion": "data.?deletion|delete.?(?:your.)?account|erase.?my.?data|dsar|subject.?access",
}
COMMERCE = r"(?i)\b(?:add to (?:cart|basket)|checkout|buy now|subscribe|start (?:free )?trial|per month|/mo\b|billed annually)\b"
COMMERCE_HREF = r"(?i)/(?:checkout|cart|pricing|plans|subscribe|billing)\b"


def third_party_kind(origin: Column) -> Column:
    found = F.lit(None).cast("string")
    for pattern, kind in reversed(TRACKERS):
        found = F.when(origin.rlike(f"(?i){pattern}"), kind).otherwise(found)
    return F.coalesce(found, F.lit("other"))


def third_parties(requests: DataFrame) -> DataFrame:
    """site, origin, kind, tracking of the distinct third-party origins of requests (site, origin)."""
    kinds = requests.select("site", "origin").distinct().withColumn("kind", third_party_kind(F.col("origin")))
    return kinds.withColumn("tracking", F.col("kind").isin(*GATED))


def policies(links: DataFrame) -> DataFrame:
    """site, policy, href: the first link (by n) of links (site, n, href, text) whose path or text names a policy; one partial aggregation."""
    path = F.regexp_replace("href", r"^[A-Za-z]+://[^/?#]+|[?#].*$", "")
    named = lambda p: path.rlike(f"(?i){p}") | F.coalesce(F.col("text").rlike(f"(?i){p}"), F.lit(False))
    hits = F.array_compact(F.array(*(F.when(named(p), F.lit(policy)) for policy, p in POLICIES.items())))
    return links.select("site", "n", "href", F.explode(hits).alias("policy")).groupBy("site", "policy").agg(F.min_by("href", "n").alias("href"))


def commercial(text: Column) -> Column:
    """Whether a text speaks of buying or subscribing."""
    return F.coalesce(text.rlike(COMMERCE), F.lit(False))


def form_problems(forms: DataFrame) -> DataFrame:
    """form, kind: up to four problems of each form with fields; null counts and marks read as none."""
    n = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(~yes("has_action") & ~yes("has_handler"), "unverifiable-submit"),
            F.when(n("required") == 0, F.when(yes("novalidate"), "no-validation").otherwise("no-required")),
            F.when(n("labelled") < F.col("fields"), "unlabelled"),
            F.when(~yes("captcha") & ~yes("honeypot") & (F.col("fields") >= 2) & ~yes("password"), "no-spam-protection"),
        )
    )
    return forms.where("fields > 0").select("form", F.explode(kinds).alias("kind"))
