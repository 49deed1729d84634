"""Design measurements: gradients by hue, spacing scales, fonts, contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import contrast_ratio, contrast_threshold, hue, saturation

# Bands of hue in degrees, the least saturation, spacing steps, fonts of scaffolds.
VIOLET, BLUE, LEAST_SATURATION = (250, 290), (200, 250), 0.15
STEPS = (4, 5, 6, 8)
TELL_FONTS = ["inter", "space grotesk", "instrument serif", "geist", "plus jakarta sans"]


def violet_blue(stops: DataFrame) -> DataFrame:
    """gradient, hues: gradients (gradient, colour #rrggbb a row) with saturated stops both in the violet and in the blue band."""
    seen = stops.select("gradient", hue(F.col("colour")).alias("hue"), saturation(F.col("colour")).alias("sat")).where(F.col("sat") >= LEAST_SATURATION)
    both = [F.max(F.col("hue").between(*band)) for band in (VIOLET, BLUE)]
    return seen.groupBy("gradient").agg(both[0].alias("violet"), both[1].alias("blue"), F.count(F.lit(1)).alias("hues")).where("violet and blue").select("gradient", "hues")


def off_scale(spacings: DataFrame) -> DataFrame:
    """page, step, share: the step (least off scale, then smallest in order) that fits the values (page, value) best, and the share off it."""
    off = [F.count_if(F.col("value") % s != 0) for s in STEPS]
    best = spacings.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.array_min(F.array(*(F.struct(o.alias("off"), F.lit(s).alias("step")) for o, s in zip(off, STEPS, strict=True)))).alias("best"))
    return best.select("page", F.col("best.step").alias("step"), (F.floor(F.col("best.off") / F.col("n") * 100 + 0.5) / 100).alias("share"))


def fonts(used: DataFrame) -> DataFrame:
    """page, family, share, tell of each page's most used family (page, family, n), of equal ones the first by name."""
    best = used.groupBy("page").agg(F.sum("n").alias("total"), F.min_by("family", F.struct(-F.col("n"), "family")).alias("family"), F.max("n").alias("most"))
    share = F.floor(F.col("most") / F.col("total") * 100 + 0.5) / 100
    return best.where("total > 0").select("page", "family", share.alias("share"), F.lower("family").isin(*TELL_FONTS).alias("tell"))


def worst_contrast(pairs: DataFrame, most: int = 10) -> DataFrame:
    """page, position, n, ratio: each page's worst failing samples (page, n, fg, bg, size, bold), lowest ratio first, then by n."""
    rated = pairs.withColumn("ratio", contrast_ratio(F.col("fg"), F.col("bg")))
    failing = rated.where(F.col("ratio") < contrast_threshold(F.col("size"), F.col("bold")))
    place = F.row_number().over(Window.partitionBy("page").orderBy("ratio", "n"))
    return failing.withColumn("position", place).where(F.col("position") <= most).select("page", "position", "n", "ratio")
