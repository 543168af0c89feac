"""Connected components and density clusters over similarity links, by rounds of joins on the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def min_labels(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(id, label): the smallest id of each node's component, for nodes with links (a, b).

    Labels go to neighbours, then to the label's own label (pointer jumping), so that chains take a
    logarithm of their length in rounds.
    """
    e = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "links")
    labels = materialize(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    for _ in range(rounds):
        near = e.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("n"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "n").alias("n"))
        jump = step.join(labels.select(F.col("id").alias("n"), F.col("label").alias("j")), "n", "left").select("id", "label", F.least("n", F.coalesce("j", "n")).alias("new"))
        new = materialize(jump, "labels")
        changed = new.where(F.col("new") < F.col("label")).limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def density_clusters(items: DataFrame, pairs: DataFrame, *, key: str = "vec_id", min_samples: int = 2) -> DataFrame:
    """(key, cluster_id, is_noise, cluster_size) as DBSCAN gives them, in order of each cluster's smallest key.

    With ``min_samples`` of 2 each row with a neighbour is a core row and clusters are components. For more,
    core rows have that many rows within reach, themselves counted; border rows join the core row of the
    smallest label. Noise rows get ids of their own after the clusters.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")  # read several times, and costly to make
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy(F.col("a").alias("id")).agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select("id")
    inner = pairs.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi")
    labels = min_labels(inner)
    labels = materialize(labels.union(core.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))), "core-labels")
    border = both.join(core.withColumnRenamed("id", "a"), "a", "left_anti").join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"))
    own = items.select(F.col(key).alias("id")).distinct().join(labels.union(border), "id", "left")
    own = materialize(own, "clusters")
    sizes = own.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("cluster_size"), F.min("id").alias("first"))
    n = sizes.count()
    # Ids are ranks over clusters and over noise rows: one row each, sorted by range, not gathered with their members.
    ranked = _number(sizes.select("label", "cluster_size", "first"), "first", 0)
    noise = _number(own.where(F.col("label").isNull()).select("id"), "id", n)
    a = own.join(ranked, "label").select("id", F.col("number").alias("cluster_id"), F.lit(False).alias("is_noise"), "cluster_size")
    b = noise.select("id", F.col("number").alias("cluster_id"), F.lit(True).alias("is_noise"), F.lit(1).cast("bigint").alias("cluster_size"))
    return a.unionByName(b).withColumnRenamed("id", key)


def _number(rows: DataFrame, order: str, start: int) -> DataFrame:
    """Consecutive numbers in order, by ranges: counts per range first, then positions inside each."""
    parts = rows.sparkSession.sparkContext.defaultParallelism
    ranged = materialize(rows.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return ranged.withColumn("_i", inside).join(F.broadcast(offset), "_p").withColumn("number", (F.col("_i") - 1 + F.col("_o") + start).cast("bigint")).drop("_p", "_i", "_o")
