"""Risk of event clusters in eight dimensions, composite, narrative, portfolio and node risk.

``articles``: cluster_id, score (0-100), domain, country, source, published (timestamp), nodes
(array of "type:name"). All aggregates are partial before the shuffle; distinct counts take sets of
domains, countries and sources, which are small by nature. A cluster id below 0 is noise and has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import NODE_WEIGHT

# Weights of the dimensions and least scores of the severities.
WEIGHTS = {"intensity": 0.25, "breadth": 0.15, "node_criticality": 0.20, "geo_spread": 0.10, "corroboration": 0.10, "velocity": 0.10, "size": 0.05, "confidence": 0.05}
SEVERITY = {"CRITICAL": 75, "HIGH": 55, "MEDIUM": 35}
SEVERITY_WEIGHT = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def known(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.lower(F.trim(F.col(c))))


def node_weight(node: Column) -> Column:
    kind = F.lower(F.split(node, ":", 2)[0])
    return reduce(lambda e, kv: F.when(kind == kv[0], kv[1]).otherwise(e), NODE_WEIGHT.items(), F.lit(0))


def corroboration(sources: Column) -> Column:
    return F.when(sources <= 0, 0).when(sources == 1, 10).when(sources == 2, 30).when(sources == 3, 50).when(sources == 4, 70).when(sources == 5, 90).otherwise(100)


def cluster_size(n: Column) -> Column:
    return F.least(F.lit(100.0), F.log2(n + 1) / F.log2(F.lit(33.0)) * 100)


def severity(score: Column) -> Column:
    out = F.lit("LOW")
    for name, least in reversed(SEVERITY.items()):
        out = F.when(score >= least, name).otherwise(out)
    return out


def cluster_dimensions(articles: DataFrame, as_of: str, *, by: str = "cluster_id") -> DataFrame:
    """The eight dimensions of each cluster, 0 to 100; ``as_of`` stands for now in the velocity of 24 hours."""
    own = articles.where(F.col(by) >= 0)
    recent = F.when(F.col("published") >= F.to_timestamp(F.lit(as_of)) - F.expr("INTERVAL 24 HOURS"), 1).otherwise(0)
    top = F.coalesce(F.array_max(F.transform("nodes", lambda n: node_weight(n))), F.lit(0))
    g = own.groupBy(by).agg(
        F.count("*").cast("bigint").alias("articles"), F.max("score").cast("double").alias("intensity"), F.avg("score").alias("_mean"), F.avg(recent.cast("double")).alias("_recent"),
        F.max(top).cast("double").alias("node_criticality"), F.count_distinct(F.when(known("domain") != "none", known("domain"))).alias("_d"), F.count_distinct(known("country")).alias("_c"), F.count_distinct(known("source")).alias("_s"),
    )
    return g.select(
        by, "articles", F.least("intensity", F.lit(100.0)).alias("intensity"), F.least(F.col("_d") * 20, F.lit(100)).cast("double").alias("breadth"), "node_criticality", F.least(F.col("_c") * 20, F.lit(100)).cast("double").alias("geo_spread"),
        corroboration(F.col("_s")).cast("double").alias("corroboration"), F.round(F.col("_recent") * 100, 1).alias("velocity"), F.round(cluster_size(F.col("articles")), 4).alias("size"), F.round("_mean", 1).alias("confidence"), F.col("_s").alias("sources"),
    )


def composite(dimensions: DataFrame) -> DataFrame:
    """Weighted sum of the dimensions, 100 at most, one decimal, with its severity."""
    total = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in WEIGHTS.items()])
    return dimensions.withColumn("composite", F.round(F.least(F.lit(100.0), F.round(total, 6)), 1)).withColumn("severity", severity(F.col("composite")))


def primary_domain(articles: DataFrame, *, by: str = "cluster_id", order: str = "pos") -> DataFrame:
    """The most frequent domain of each cluster; the first seen wins a tie."""
    counted = articles.where((F.col(by) >= 0) & known("domain").isNotNull() & (known("domain") != "none")).groupBy(by, known("domain").alias("domain")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(by).agg(F.min_by("domain", F.struct(-F.col("n"), F.col("first"))).alias("primary_domain"))


def top_node(articles: DataFrame, *, by: str = "cluster_id") -> DataFrame:
    """The weightiest node of each cluster; of equal ones the first by name."""
    nodes = articles.where(F.col(by) >= 0).select(by, F.explode("nodes").alias("node"))
    return nodes.groupBy(by).agg(F.min_by(F.split("node", ":", 2)[1], F.struct(-node_weight(F.col("node")), F.col("node"))).alias("top_node"))


def narrative(scored: DataFrame) -> DataFrame:
    """A sentence for each cluster from composite, severity, sources and, where known, primary_domain, top_node and countries."""
    level = F.when(F.col("intensity") >= 75, "high-intensity").when(F.col("intensity") >= 50, "moderate").otherwise("low-level")
    many = F.when(F.col("sources") == 1, "").otherwise("s")
    where = F.when(F.size("countries") > 0, F.concat(F.lit(" in "), F.array_join(F.slice("countries", 1, 2), ", "))).otherwise("")
    parts = F.concat_ws(
        " — ", F.concat(F.initcap("severity"), F.lit(" composite risk ("), F.bround("composite", 0).cast("int").cast("string"), F.lit("/100)")),
        F.when(F.col("primary_domain").isNotNull(), F.concat(level, F.lit(" "), F.col("primary_domain"), F.lit(" signal"))), F.when(F.col("top_node").isNotNull(), F.concat(F.lit("affecting "), F.col("top_node"), where)),
        F.concat(F.lit("corroborated by "), F.col("sources").cast("string"), F.lit(" source"), many),
    )
    return scored.withColumn("narrative", F.concat(parts, F.lit(".")))


def portfolio(scored: DataFrame) -> DataFrame:
    """One row: mean of the composites weighted by severity, counts by severity, severity and message."""
    weight = reduce(lambda e, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(e), SEVERITY_WEIGHT.items(), F.lit(1))
    count = lambda s: F.count_if(F.col("severity") == s).cast("bigint")
    g = scored.agg(F.round(F.coalesce(F.sum(F.col("composite") * weight) / F.sum(weight), F.lit(0.0)), 1).alias("overall_score"), F.count("*").cast("bigint").alias("clusters"), count("CRITICAL").alias("critical"), count("HIGH").alias("high"), count("MEDIUM").alias("medium"), count("LOW").alias("low"))
    g = g.withColumn("overall_severity", severity(F.col("overall_score")))
    s = lambda n: F.when(n == 1, "").otherwise("s")
    num = lambda c: F.col(c).cast("string")
    message = (
        F.when(F.col("overall_severity") == "CRITICAL", F.concat(num("critical"), F.lit(" critical and "), num("high"), F.lit(" high-severity event"), s(F.col("critical") + F.col("high")), F.lit(" detected. Immediate executive review required.")))
        .when(F.col("overall_severity") == "HIGH", F.concat(num("high"), F.lit(" high-severity event"), s(F.col("high")), F.lit(" detected across your supply chain exposure. Prompt review recommended.")))
        .when(F.col("overall_severity") == "MEDIUM", F.concat(num("medium"), F.lit(" medium-severity event"), s(F.col("medium")), F.lit(" identified. Monitor developments and review affected nodes.")))
        .otherwise("No significant disruption signals detected across your supply chain.")
    )
    return g.withColumn("message", message)


def domain_breakdown(articles: DataFrame) -> DataFrame:
    """Articles per domain over all clusters, noise as well."""
    return articles.where(known("domain").isNotNull()).groupBy(known("domain").alias("domain")).agg(F.count("*").cast("bigint").alias("n"))


def node_risk(articles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node counts by impact level and the best score; nodes without articles stay with zeros.

    ``articles``: nodes array, level, score; ``nodes``: (node_type, node). Edges to unknown nodes fall away.
    """
    edges = articles.select(F.explode("nodes").alias("_e"), "level", "score").select(F.lower(F.split("_e", ":", 2)[0]).alias("node_type"), F.split("_e", ":", 2)[1].alias("node"), F.upper("level").alias("level"), "score")
    g = edges.groupBy("node_type", "node").agg(*[F.count_if(F.col("level") == v.upper()).cast("bigint").alias(v) for v in ("high", "medium", "low")], F.max("score").cast("bigint").alias("max_score"))
    out = nodes.select("node_type", "node").distinct().join(g, ["node_type", "node"], "left")
    return out.select("node_type", "node", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("high", "medium", "low", "max_score")])


def cluster_rollup(articles: DataFrame, *, by: str = "cluster_id") -> DataFrame:
    """Per cluster the highest level, the best score, its distinct nodes and sources, and the count."""
    from .relevance import level_rank

    nodes = articles.where(F.col(by) >= 0).select(by, F.explode("nodes").alias("node")).distinct().groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("node")), "|").alias("nodes"))
    g = articles.where(F.col(by) >= 0).groupBy(by).agg(
        F.max_by(F.upper("level"), level_rank(F.col("level"))).alias("impact_level"), F.max("score").cast("double").alias("risk_score"), F.count("*").cast("bigint").alias("articles"),
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
    )
    return g.join(nodes, by, "left").withColumn("nodes", F.coalesce("nodes", F.lit("")))


def top_clusters(scored: DataFrame, n: int = 3) -> DataFrame:
    return scored.orderBy(F.col("composite").desc(), "cluster_id").limit(n)


def plurality(votes: DataFrame, *, by: str = "cluster_id", value: str = "topic_id", order: str = "pos", outlier: int = -1) -> DataFrame:
    """The value most rows of a group have; any other beats ``outlier``, ties go to the first seen."""
    counted = votes.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy((F.col(value) == outlier).cast("int"), F.col("n").desc(), "first"))
    return counted.withColumn("_r", rank).where(F.col("_r") == 1).select(by, value)
