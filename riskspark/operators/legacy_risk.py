"""The older score of topics in four parts on a scale of 0 to 10, with a multiplier for verification.

Rows of ``articles``: topic, level, score, text and flags. Texts are searched row by row: a phrase counts once
for a topic if any of its articles has it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as X


def severity_part(articles: DataFrame, *, by: str = "topic") -> DataFrame:
    """Half from levels, three tenths from phrases, a fifth from the mean score; 10 at most."""
    has = lambda p: F.max(F.contains(F.lower("text"), F.lit(p)).cast("int"))
    high = reduce(lambda a, b: a + b, [has(p) for p in X.HIGH_SEVERITY])
    medium = reduce(lambda a, b: a + b, [has(p) for p in X.MEDIUM_SEVERITY])
    level = lambda v: F.count_if(F.upper("level") == v)
    points = 0.5 * (level("HIGH") * 9 + level("MEDIUM") * 5) / F.count("*") + 0.3 * F.least(F.lit(3.0), 0.5 * high + 0.2 * medium) + 0.2 * F.avg("score") / 10
    return articles.groupBy(by).agg(F.round(F.least(F.lit(10.0), points), 4).alias("severity"), F.count("*").cast("bigint").alias("articles"))


def propagation(domain: Column, industries: Column) -> Column:
    base = reduce(lambda e, kv: F.when(F.lower(domain) == kv[0], kv[1]).otherwise(e), X.PROPAGATION.items(), F.lit(4.0))
    return F.least(F.lit(10.0), base + F.least(0.4 * industries, F.lit(2.0)))


def concentration_factor(commodity: Column) -> Column:
    """The largest factor of a commodity that is part of the text; 1 for none and for null."""
    low = F.lower(F.coalesce(commodity, F.lit("")))
    return F.greatest(*[F.when(F.contains(low, F.lit(c)), f).otherwise(1.0) for c, f in X.CONCENTRATION.items()])


def concentration(severity: Column, factor: Column) -> Column:
    return F.least(severity * factor, F.lit(10.0))


def velocity(n: Column) -> Column:
    return F.when(n >= 20, 9.5).when(n >= 11, 8.0).when(n >= 6, 6.5).when(n >= 3, 4.0).otherwise(n.cast("double"))


def verification(total: Column, verified: Column, rejected: Column) -> Column:
    return F.when(total == 0, 0.9).when(rejected > 0, 0.8).when(verified == 0, 0.9).when(verified == total, 1.1).when(verified * 2 >= total, 1.05).otherwise(1.0)


def level(score: Column) -> Column:
    return F.when(score >= 8, "CRITICAL").when(score >= 6, "HIGH").when(score >= 3.5, "MEDIUM").otherwise("LOW")


def score_topics(articles: DataFrame) -> DataFrame:
    """topic, its four parts, multiplier, risk (two decimals) and level.

    ``articles``: topic, level, score, text, domain, industry, commodity, verified, rejected.
    """
    facts = articles.groupBy("topic").agg(
        F.min("domain").alias("domain"), F.count_distinct("industry").alias("industries"), F.max(concentration_factor(F.col("commodity"))).alias("factor"),
        F.count_if("verified").alias("verified"), F.count_if("rejected").alias("rejected"),
    )
    g = severity_part(articles).join(facts, "topic")
    g = g.withColumns({"propagation": propagation(F.col("domain"), F.col("industries")), "concentration": F.round(concentration(F.col("severity"), F.col("factor")), 4), "velocity": velocity(F.col("articles")), "multiplier": verification(F.col("articles"), F.col("verified"), F.col("rejected"))})
    risk = F.round(F.least(F.lit(10.0), F.round((F.col("severity") + F.col("propagation") + F.col("concentration") + F.col("velocity")) / 4 * F.col("multiplier"), 6)), 2)
    return g.withColumn("risk", risk).withColumn("risk_level", level(F.col("risk"))).select("topic", "articles", "severity", "propagation", "concentration", "velocity", "multiplier", "risk", "risk_level")


def overall(levels: DataFrame) -> DataFrame:
    """One row of the fall-back badge: 20 per HIGH, 10 per MEDIUM, 100 at most; HIGH from five HIGH on, MEDIUM from one."""
    g = levels.agg(F.count_if(F.upper("level") == "HIGH").cast("bigint").alias("high"), F.count_if(F.upper("level") == "MEDIUM").cast("bigint").alias("medium"))
    return g.select("high", "medium", F.least(F.col("high") * 20 + F.col("medium") * 10, F.lit(100)).cast("bigint").alias("score"), F.when(F.col("high") >= 5, "HIGH").when(F.col("high") >= 1, "MEDIUM").otherwise("LOW").alias("badge"))


def enrich(clusters: DataFrame, scores: DataFrame, *, by: str = "topic") -> DataFrame:
    """``clusters`` with their risk and parts, and ``impact_level`` taken from the risk level; those without a score keep their own."""
    parts = scores.select(by, "risk", "risk_level", F.struct("severity", "propagation", "concentration", "velocity", "multiplier").alias("risk_breakdown"))
    out = clusters.drop("risk", "risk_level", "risk_breakdown").join(parts, by, "left")
    return out.withColumn("impact_level", F.coalesce("risk_level", "impact_level"))


def overall_of_clusters(clusters: DataFrame) -> DataFrame:
    """One row: badge, score on a scale of 100, and counts, from the best of the scored real clusters (risk, risk_level, is_noise)."""
    own = clusters.where(F.col("risk").isNotNull() & ~F.coalesce("is_noise", F.lit(False)))
    g = own.agg(F.count("*").alias("clusters"), F.coalesce(F.max("risk"), F.lit(0.0)).alias("best"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"), F.count_if(F.col("risk_level") == "HIGH").alias("high"))
    badge = F.when((F.col("best") >= 8) | (F.col("critical") >= 1), "HIGH").when((F.col("best") >= 6) | (F.col("high") >= 1), "MEDIUM").otherwise("LOW")
    return g.select(badge.alias("badge"), F.least(F.floor(F.round(F.col("best") * 10, 6)), F.lit(100)).cast("bigint").alias("score"), "clusters", "critical", "high")
