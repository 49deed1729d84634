"""Layout measured at several widths: overflow, gaps between breakpoints, tap targets, clipped text, vanished links, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Widths usually checked and those between them, least tap size, tolerance of overflow in pixels.
NAMED = (360, 390, 768, 1280, 1440)
BETWEEN = (480, 1024)
LEAST_TAP = 44
TOLERANCE = 2
TILE = 256


def overflow(views: DataFrame) -> DataFrame:
    """page, width, overflow_px of views (page, width, scroll_width) wider than their viewport."""
    over = F.col("scroll_width") - F.col("width")
    return views.select("page", "width", over.alias("overflow_px")).where(F.col("overflow_px") > TOLERANCE)


def breakpoint_gaps(views: DataFrame) -> DataFrame:
    """page, width: overflow at a width between the usual ones, whose nearest usual widths (if measured) are clean."""
    over = (F.col("scroll_width") - F.col("width") > TOLERANCE).alias("over")
    usual = F.when(F.col("width").isin(*NAMED), F.col("over"))
    order = Window.partitionBy("page").orderBy("width")
    lower = F.last(usual, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    upper = F.first(usual, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    seen = views.select("page", "width", over).withColumn("lower", lower).withColumn("upper", upper)
    return seen.where(F.col("width").isin(*BETWEEN) & F.col("over") & ~F.coalesce("lower", F.lit(False)) & ~F.coalesce("upper", F.lit(False))).select("page", "width")


def small_targets(targets: DataFrame) -> DataFrame:
    """page, width, sel, w, h of tap targets (page, width, n, sel, x, y, w, h) under 44 pixels either way."""
    return targets.where(F.least("w", "h") < LEAST_TAP).select("page", "width", "sel", "w", "h")


def _tiles(low: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / TILE), F.floor((low + F.greatest(size, F.lit(1)) - 1) / TILE))


def overlapping_targets(targets: DataFrame) -> DataFrame:
    """page, width, a, b: targets that overlap in part, a first in order n; one inside the other is no collision.

    Boxes meet in tiles of 256 pixels, so only neighbours are compared; a pair counts in the tile of its overlap's corner.
    """
    tiled = targets.where("w > 0 and h > 0").withColumn("tx", F.explode(_tiles(F.col("x"), F.col("w")))).withColumn("ty", F.explode(_tiles(F.col("y"), F.col("h"))))
    a, b = tiled.alias("a"), tiled.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "width", "tx", "ty")]
    met = a.join(b, [*same, F.col("a.n") < F.col("b.n")])
    apart = F.expr("a.x + a.w <= b.x or b.x + b.w <= a.x or a.y + a.h <= b.y or b.y + b.h <= a.y")
    inside = lambda o, i: F.expr(f"{i}.x >= {o}.x and {i}.y >= {o}.y and {i}.x + {i}.w <= {o}.x + {o}.w and {i}.y + {i}.h <= {o}.y + {o}.h")
    corner = (F.floor(F.greatest("a.x", "b.x") / TILE) == F.col("a.tx")) & (F.floor(F.greatest("a.y", "b.y") / TILE) == F.col("a.ty"))
    hit = met.where(corner & ~apart & ~inside("a", "b") & ~inside("b", "a"))
    return hit.select(F.col("a.page").alias("page"), F.col("a.width").alias("width"), F.col("a.sel").alias("a"), F.col("b.sel").alias("b"))


def clipped_text(clipped: DataFrame) -> DataFrame:
    """page, width, sel of text (page, width, sel, ellipsis) cut off without an ellipsis."""
    return clipped.where("not ellipsis").select("page", "width", "sel")


def vanished_links(links: DataFrame, wide: int = 1440, narrow: int = 360) -> DataFrame:
    """page, href, text of links (page, width, href, text, region) outside navigation that the narrowest width lacks.

    Pages without a view at the narrow width are not judged.
    """
    small = links.where(F.col("width") == narrow)
    there = links.where((F.col("width") == wide) & (F.col("region") != "nav") & (F.col("href") != "")).select("page", "href", "text")
    return there.join(small.select("page").distinct(), "page", "left_semi").join(small.select("page", "href").distinct(), ["page", "href"], "left_anti")


def oversized_images(images: DataFrame, least: float = 2.0) -> DataFrame:
    """page, src, ratio of images (page, src, natural_width, render_width) with so many times the pixels drawn; one decimal, halves up."""
    ratio = F.col("natural_width").cast("double") / F.col("render_width")
    return images.where("render_width > 0").where(ratio >= least).select("page", "src", (F.floor(ratio * 10 + 0.5) / 10).alias("ratio"))
