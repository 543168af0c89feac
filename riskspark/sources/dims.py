"""Dimension files of the user as tables: countries, materials, ports, routes, lexicon, feed registry, profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST = "array<string>"


def _load(path: str) -> dict:
    """A configuration file: small by nature, read where the plan is made."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _rows(spark: SparkSession, entries: dict, schema: str, pick: list[str], name: str) -> DataFrame:
    data = [(i, key, *[entry.get(p) for p in pick]) for i, (key, entry) in enumerate(entries.items())]
    return spark.createDataFrame(data, f"pos int, {name} string, {schema}")


def countries(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, _load(f"{folder}/countries.json")["countries"], f"major_cities {LIST}, industrial_hubs {LIST}", ["major_cities", "industrial_hubs"], "country")


def materials(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, _load(f"{folder}/materials.json")["materials"], f"synonyms {LIST}, top_producers {LIST}, query_terms {LIST}", ["synonyms", "top_producers", "query_terms"], "material")


def ports(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, _load(f"{folder}/ports.json")["ports"], f"city string, country string, aliases {LIST}", ["city", "country", "aliases"], "port")


def routes(spark: SparkSession, folder: str) -> DataFrame:
    both = _load(f"{folder}/logistics_routes.json")
    return _rows(spark, both["strategic_chokepoints"] | both["major_trade_corridors"], f"connects {LIST}, query_terms {LIST}", ["connects", "query_terms"], "route")


def lexicon(folder: str) -> dict[str, list[str]]:
    """Domain to terms, in file order, as the scoring takes it."""
    return {d: v["terms"] for d, v in _load(f"{folder}/disruption_terms.json")["domains"].items()}


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Feed sources: country (null for defaults), bucket, pos, name, url, trust_score."""
    data = _load(path)
    rows = []
    for bucket, entries in data.get("defaults", {}).items():
        rows += [(None, bucket.removesuffix("_sources"), i, e.get("name"), e.get("url"), e.get("trust_score")) for i, e in enumerate(entries)]
    for country, buckets in data.get("countries", {}).items():
        for bucket, entries in buckets.items():
            if isinstance(entries, list):
                rows += [(country, bucket, i, e.get("name"), e.get("url"), e.get("trust_score")) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "country string, bucket string, pos int, name string, url string, trust_score double")


PROFILE = (
    "client_id string, client_name string, tier1_suppliers array<struct<name:string,material:string,location:string,country:string,city:string>>, raw_materials array<struct<commodity:string,region:string>>, "
    "logistics_nodes array<struct<name:string,type:string,carrier:string,port:string,route:string>>, own_facilities array<struct<name:string,location:string>>"
)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Client profiles; nodes written as port and route become a node of each."""
    raw = spark.read.schema(PROFILE).option("multiLine", True).json(path)
    node = lambda n: F.array_compact(F.array(F.when(n["name"].isNotNull(), F.struct(n["name"].alias("name"), n["type"].alias("type"), n["carrier"].alias("carrier"))), F.when(n["port"].isNotNull(), F.struct(n["port"].alias("name"), F.lit("port").alias("type"), n["carrier"].alias("carrier"))), F.when(n["route"].isNotNull(), F.struct(n["route"].alias("name"), F.lit("route").alias("type"), n["carrier"].alias("carrier")))))
    named = raw.withColumn("client_id", F.coalesce("client_id", F.regexp_replace(F.replace(F.lower("client_name"), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_-]", "")))
    return named.withColumn("logistics_nodes", F.flatten(F.transform("logistics_nodes", node)))
