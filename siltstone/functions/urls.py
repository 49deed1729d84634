"""URLs: canonical form, origin, and what their hosts and paths say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in both Java's and RE2's syntax: static assets, private paths, staging hosts, the parts of an absolute URL.
ASSET = r"(?i)\.(?:png|jpe?g|gif|svg|webp|ico|css|js|mjs|map|woff2?|ttf|pdf|zip|mp4|webm|mp3)$"
PRIVATE = r"(?i)(?:^|/)(?:login|signin|sign-in|log-in|register|signup|sign-up|auth|account|dashboard|admin|checkout|cart|billing|forgot-password|reset-password|verify|logout|onboarding|profile|settings)(?:/|$|\?)"
LOCAL = r"^(?:localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|\[::1\])$"
STAGE = r"(?i)(?:^|\.)(?:staging|preview|dev|test)\."
PREVIEW = r"(?i)\.(?:vercel\.app|netlify\.app|pages\.dev|lovable\.app|lovableproject\.com|bolt\.host|replit\.app|github\.io|web\.app|onrender\.com)$"
ORIGIN = r"^(?i:https?)://[^/?#]+"
HOST_PORT = r"^[A-Za-z]+://([^/?#]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
PATH = r"^[A-Za-z]+://[^/?#]+([^?#]*)"


def normalised(url: Column) -> Column:
    """An absolute http(s) URL with a lower-case origin, no fragment and no trailing slash but the root's; null for any other."""
    bare = F.regexp_replace(url, r"#.*$", "")
    origin = F.lower(F.regexp_extract(bare, ORIGIN, 0))
    path = F.regexp_replace(F.regexp_extract(bare, PATH, 1), r"([^/])/$", r"$1")
    return F.when(origin != "", F.concat(origin, F.when(path == "", "/").otherwise(path), F.regexp_extract(bare, r"\?.*$", 0)))


def resolved(href: Column, base: Column) -> Column:
    """The absolute address of a link on a page at `base`, dot segments folded."""
    bare = F.regexp_replace(base, r"[?#].*$", "")
    root, path = F.regexp_extract(base, ORIGIN, 0), F.regexp_extract(bare, PATH, 1)
    whole = (
        F.when(href.rlike(SCHEME), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^[A-Za-z]+:", 0), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(bare, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(root, F.regexp_replace(path, r"[^/]*$", ""), F.when(path == "", "/").otherwise(""), href))
    )
    parts = F.split(F.regexp_extract(whole, PATH, 1), "/")
    step = lambda done, x: F.when(x == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.lit(""), step)
    return F.when(whole.rlike(ORIGIN), F.concat(F.regexp_extract(whole, ORIGIN, 0), folded, F.regexp_extract(whole, r"[?#].*$", 0))).otherwise(whole)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ORIGIN, 0))


def crawlable(url: Column, of: Column) -> Column:
    """Whether a URL has that origin and is no static asset."""
    return (origin(url) == of) & ~F.regexp_extract(url, PATH, 1).rlike(ASSET)


def staging(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_extract(url, HOST_PORT, 1), r":\d+$", "")
    return host.rlike(LOCAL) | host.rlike(STAGE) | host.rlike(PREVIEW)


def private_path(path: Column) -> Column:
    return path.rlike(PRIVATE)
