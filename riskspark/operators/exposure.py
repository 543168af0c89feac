"""Client profiles resolved against dimensions into an exposure map, and queries made from it.

Every step keeps the position of what it reads, so that first-seen order is a column, not an accident.
Empty strings count as missing; names are matched without regard to case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as X


def filled(*names: str) -> Column:
    """The first of the columns that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.col(n)) for n in names], F.lit(""))


def explode_profile(profiles: DataFrame) -> dict[str, DataFrame]:
    """Long tables of suppliers, materials, nodes and facilities, with client_id and pos."""
    take = lambda c: profiles.select("client_id", F.posexplode(c).alias("pos", "x")).select("client_id", "pos", "x.*")
    suppliers = take("tier1_suppliers").select("client_id", "pos", "name", "material", filled("location", "country", "city").alias("location"), filled("country", "location").alias("country"), F.coalesce("city", F.lit("")).alias("city"))
    return {"suppliers": suppliers, "materials": take("raw_materials"), "nodes": take("logistics_nodes"), "facilities": take("own_facilities")}


def exposure_nodes(profiles: DataFrame) -> DataFrame:
    """(client_id, node_type, node, pos): suppliers, then materials, then logistics nodes as the profile names them, each once."""
    parts = explode_profile(profiles)
    one = parts["suppliers"].select("client_id", F.lit("supplier").alias("node_type"), F.col("name").alias("node"), F.lit(0).alias("k"), "pos")
    two = parts["materials"].select("client_id", F.lit("material").alias("node_type"), F.col("commodity").alias("node"), F.lit(1).alias("k"), "pos")
    three = parts["nodes"].select("client_id", F.coalesce("type", F.lit("node")).alias("node_type"), F.col("name").alias("node"), F.lit(2).alias("k"), "pos")
    every = one.unionByName(two).unionByName(three).where(F.trim(F.coalesce("node", F.lit(""))) != "")
    firsts = every.groupBy("client_id", "node_type", "node").agg(F.min(F.struct("k", "pos")).alias("o"))
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("o", "node_type", "node")) - 1
    return firsts.select("client_id", "node_type", "node", place.cast("int").alias("pos"))


def resolve_names(names: DataFrame, dimension: DataFrame, *, name: str, key: str, aliases: str | None = None, pos: str = "pos") -> DataFrame:
    """``names`` with the first dimension key, in file order, whose key or alias equals the name; null if none does."""
    own = dimension.select(F.col(key).alias("_key"), F.col(pos).alias("_pos"), F.explode(F.array_union(F.array(key), F.coalesce(F.col(aliases), F.array().cast("array<string>"))) if aliases else F.array(key)).alias("_alias"))
    first = own.groupBy(F.lower(F.trim("_alias")).alias("_alias")).agg(F.min_by("_key", "_pos").alias("resolved"))
    return names.join(first, F.lower(F.trim(F.col(name))) == F.col("_alias"), "left").drop("_alias")


def first_seen(rows: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """Distinct values in order of first sight, numbered from 0 within ``by``."""
    firsts = rows.where(F.trim(F.coalesce(value, F.lit(""))) != "").groupBy(*by, F.trim(F.col(value)).alias(value)).agg(F.min(order).alias("_o"))
    return firsts.withColumn("pos", (F.row_number().over(Window.partitionBy(*by).orderBy("_o", value)) - 1).cast("int")).drop("_o")


def quoted(terms: list[str]) -> str:
    return " OR ".join(f'"{t}"' for t in terms)


def country_queries(countries: DataFrame, column: str = "country", limit: int = 500) -> DataFrame:
    """One query per country with the terms of disruptions, cut at the length the service takes."""
    return countries.select(column, F.substring(F.concat(F.lit('"'), F.col(column), F.lit(f'" AND ({quoted(X.COUNTRY_TERMS)})')), 1, limit).alias("query"))


def search_url(query: Column, base: str = "https://news.example/rss/search?q=") -> Column:
    """A search address; spaces, asterisks and tildes as RFC 3986 has them."""
    encoded = F.url_encode(query)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), encoded)
