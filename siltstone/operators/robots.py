"""robots.txt: parsing by windows over lines, and access decisions by the longest matching rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rules(robots: DataFrame) -> DataFrame:
    """site, agent, allow, path from site, text: agents in a row share the rules that follow them.

    Comments, blank and unknown lines are skipped; an empty path adds no rule.
    """
    lines = robots.select("site", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    parsed = lines.select(
        "site", "n", F.lower(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_extract(line, r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value")
    ).where("key <> ''")
    order = Window.partitionBy("site").orderBy("n")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    grouped = parsed.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = grouped.where("key = 'user-agent'").select("site", "group", F.lower("value").alias("agent"))
    own = grouped.where("key in ('allow', 'disallow') and value <> '' and group > 0")
    own = own.select("site", "group", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(own, ["site", "group"], "left").select("site", "agent", "allow", "path").distinct()


def access(robots: DataFrame, probes: DataFrame) -> DataFrame:
    """site, token, path, allowed, matched_by (exact, star, none) of each probe (site, token, path).

    The group that names the token decides, else the one for `*`; in it the longest matching rule, of equal ones the allowing one.
    """
    parsed = rules(robots).withColumnRenamed("path", "rule")
    met = probes.distinct().join(parsed.where(F.col("agent").isNotNull()), "site", "left").where("agent is null or agent = lower(token) or agent = '*'")
    met = met.unionByName(probes.distinct().select("site", "token", "path", F.lit(None).cast("string").alias("agent"), F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("string").alias("rule")))
    body = F.replace(F.regexp_replace(F.regexp_replace("rule", r"\$$", ""), r"[.+?^${}()|\[\]\\]", r"\\$0"), F.lit("*"), F.lit(".*"))
    pattern = F.concat(F.lit("^"), body, F.when(F.col("rule").endswith("$"), "$").otherwise(""))
    kind = F.when(F.col("agent") == F.lower("token"), 2).when(F.col("agent") == "*", 1).otherwise(0)
    tested = met.select("site", "token", "path", kind.alias("kind"), F.when(F.rlike("path", pattern), F.length("rule") * 2 + F.col("allow").cast("int")).alias("strength"))
    best = tested.groupBy("site", "token", "path").agg(F.max("kind").alias("kind"), F.max(F.when(F.col("kind") == 2, F.col("strength"))).alias("exact"), F.max(F.when(F.col("kind") == 1, F.col("strength"))).alias("star"))
    strength = F.when(F.col("kind") == 2, F.col("exact")).otherwise(F.col("star"))
    return best.select(
        "site", "token", "path", F.coalesce(strength % 2 == 1, F.lit(True)).alias("allowed"), F.when(F.col("kind") == 2, "exact").when(F.col("kind") == 1, "star").otherwise("none").alias("matched_by")
    )
