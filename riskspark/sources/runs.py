"""Saved runs: articles partitioned by run, their listing, profiles by client."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_id


def save_run(articles: DataFrame, path: str) -> None:
    """Append or replace the partitions of the runs in ``articles`` (run_id)."""
    articles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def load_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run; its folder alone is read."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def list_runs(articles: DataFrame, client: str | None = None) -> DataFrame:
    """(run_id, client, articles, high, nodes), newest first; ``client`` is a prefix of the run's name."""
    rows = articles.where(F.startswith("run_id", F.lit(client))) if client else articles
    g = rows.groupBy("run_id").agg(F.count("*").cast("bigint").alias("articles"), F.count_if(F.upper("impact_level") == "HIGH").cast("bigint").alias("high"), F.sum(F.size("linked_nodes")).cast("bigint").alias("nodes"))
    return g.withColumn("client", F.regexp_replace("run_id", r"_\d{8}_\d{6}$", "")).select("run_id", "client", "articles", "high", "nodes").orderBy(F.desc("run_id"))


def client_summaries(profiles: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("int")
    return profiles.select("client_id", "client_name", safe_id(F.col("client_name")).alias("file_id"), n("tier1_suppliers").alias("suppliers"), n("raw_materials").alias("materials"), n("logistics_nodes").alias("nodes"), n("own_facilities").alias("facilities"))


def save_profile(profile: DataFrame, folder: str) -> None:
    """One JSON file per client under its safe name; a profile without a name is refused."""
    if profile.where(F.trim(F.coalesce("client_name", F.lit(""))) == "").limit(1).count():
        raise ValueError("client_name is required")
    profile.withColumn("client", safe_id(F.col("client_name"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("client").json(folder)
