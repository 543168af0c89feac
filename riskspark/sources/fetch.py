"""The stages that decide what is fetched, and how what comes back is dated and cut.

Stages give plans of requests as rows; ``feeds.read_feeds`` reads what they name. Nothing is fetched here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.exposure import search_url
from .feeds import ENTRIES, normalise_entries, read_feeds

QUERY_TRUST, QUERY_CATEGORY, MOST_QUERIES, LOOK_BACK_DAYS = 0.70, "google_news", 15, 3  # fixed values


def country_plan(countries: DataFrame, registry: DataFrame, *, default_trust: float = 0.65) -> DataFrame:
    """(client_id, country, pos, name, url, trust_score, category): the sources of each country and the world's, each address once.

    ``countries``: client_id, country. ``registry``: country (null for defaults), bucket, pos, name, url, trust_score.
    A country that the registry lacks gets the world's sources alone; sources without address are left out.
    """
    order = F.when(F.col("bucket") == "local", 0).when(F.col("bucket") == "government", 1).when(F.col("bucket") == "global_wire", 2).otherwise(3)
    own = registry.where(F.trim(F.coalesce("url", F.lit(""))) != "").withColumn("_b", order)
    countries = countries.select("client_id", "country").distinct()
    local = countries.join(F.broadcast(own.where(F.col("country").isNotNull())), "country").select("client_id", "country", "name", "url", "trust_score", "bucket", "_b", "pos")
    world = countries.select("client_id", "country").join(F.broadcast(own.where(F.col("country").isNull()).drop("country")), F.lit(True)).select("client_id", "country", "name", "url", "trust_score", "bucket", "_b", "pos")
    by = Window.partitionBy("client_id", "country")
    ranked = local.unionByName(world).withColumn("_r", F.row_number().over(Window.partitionBy("client_id", "country", "url").orderBy("_b", "pos", "name"))).where(F.col("_r") == 1)
    place = F.row_number().over(by.orderBy("_b", "pos", "name")) - 1
    return ranked.select("client_id", "country", place.cast("int").alias("pos"), "name", "url", F.coalesce("trust_score", F.lit(default_trust)).alias("trust_score"), F.col("bucket").alias("category"))


def query_plan(queries: DataFrame, *, most: int = MOST_QUERIES) -> DataFrame:
    """(client_id, pos, query, url, source, trust_score, category) of each client's first ``most`` queries (client_id, pos, query)."""
    return queries.where(F.col("pos") < most).select(
        "client_id", "pos", "query", search_url(F.col("query")).alias("url"), F.concat(F.lit("Google News: "), F.substring("query", 1, 60)).alias("source"), F.lit(QUERY_TRUST).alias("trust_score"), F.lit(QUERY_CATEGORY).alias("category")
    )


def service_plan(queries: DataFrame, as_of: str, *, days: int = LOOK_BACK_DAYS, page: int = 10, language: str = "en", most: int = 500) -> DataFrame:
    """(client_id, pos, q, from_date, language, sort, page_size): requests to a news service, looking back ``days`` from ``as_of``."""
    since = F.date_format(F.date_sub(F.to_date(F.lit(as_of)), days), "yyyy-MM-dd")
    return queries.select("client_id", "pos", F.substring("query", 1, most).alias("q"), since.alias("from_date"), F.lit(language).alias("language"), F.lit("publishedAt").alias("sort"), F.lit(page).alias("page_size"))


def recent(articles: DataFrame, as_of: str, *, days: int = LOOK_BACK_DAYS, published: str = "published_ts") -> DataFrame:
    """Articles of the last ``days``; those without a readable date fall away, as the service would not have sent them."""
    return articles.where(F.col(published) >= F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days)))


def phase_four(queries: DataFrame, cities: DataFrame, *, first: int = 3) -> DataFrame:
    """``queries`` (client_id, pos, query) without those that quote a city of the client: the city queries of the phases before.

    ``cities``: client_id, country, pos, city, of which the ``first`` of each country count. They are few for a client: checked, then
    gathered into one row.
    """
    near = cities.where((F.col("pos") < first) & (F.trim(F.coalesce("city", F.lit(""))) != "")).groupBy("client_id").agg(F.collect_set("city").alias("_cities"))
    own = queries.join(near, "client_id", "left")
    of_city = F.contains("query", F.lit('"')) & F.contains("query", F.lit(" AND (")) & F.exists("_cities", lambda c: F.contains(F.col("query"), c))
    return own.where(~F.coalesce(of_city, F.lit(False))).drop("_cities")


def feed_moment(text: Column) -> Column:
    """The instant of a feed's date: RFC 2822 with a zone, or ISO 8601 (``Z`` or an offset, no zone meaning UTC); null if it is neither."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""))
    mail = F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (?:[+-]\d{4}|GMT|UTC|Z)$"), F.regexp_replace(bare, r"(?:GMT|UTC|Z)$", "+0000"))
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"), F.concat(F.regexp_replace(F.substring(bare, 1, 19), "T", " "), F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(bare, r"(Z|[+-]\d{2}:\d{2})$", 1), "Z", "+00:00"), F.lit("")), F.lit("+00:00"))))
    return F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ssxxx")))


def dated(articles: DataFrame, now: str, *, published: str = "published") -> DataFrame:
    """``articles`` with ``published_ts`` (null if unreadable) and ``published`` in ISO 8601 UTC, raw if unreadable, ``now`` if missing."""
    at = feed_moment(F.col(published))
    text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    missing = F.trim(F.coalesce(published, F.lit(""))) == ""
    return articles.withColumn("published_ts", F.when(missing, F.to_timestamp(F.lit(now))).otherwise(at)).withColumn(published, F.when(missing, F.lit(now)).otherwise(F.coalesce(text, F.col(published))))


def fetch(spark: SparkSession, plan: DataFrame, now: str, *, kind: str = "rss", locate: Callable[[str], str] | None = None, most_feeds: int = 10_000) -> DataFrame:
    """Articles of the feeds a plan names, with the plan's source, trust and category; the first ``ENTRIES`` of each feed.

    ``locate`` maps an address to where it is read from (a file, where there is no network). A feed that cannot be read gives no rows.
    """
    rows = plan.select("url", "source" if "source" in plan.columns else F.col("name").alias("source"), "trust_score", "category").dropDuplicates(["url"]).limit(most_feeds + 1).collect()
    if len(rows) > most_feeds:
        raise ValueError(f"more than {most_feeds} feeds: fetch them in blocks")
    where = {(locate(r["url"]) if locate else r["url"]): r for r in rows}
    got = normalise_entries(read_feeds(spark, list(where), kind=kind, limit=ENTRIES)).drop("source", "trust_score")
    told = spark.createDataFrame([(p, r["source"], float(r["trust_score"]), r["category"]) for p, r in where.items()], "feed string, source string, trust_score double, category string")
    return dated(got.join(F.broadcast(told), "feed"), now)
