"""Feed and news readers as Python data sources, and the normalising of what they bring.

``spark.read.format("rss")`` reads feed files or addresses, one partition per feed; ``spark.read.format("newsapi")``
reads saved replies or a service's address. A feed that can't be fetched or parsed gives no rows and stops
nothing. Addresses are fetched in the executors, so reading works offline on files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import outlet_trust, strip_tags

RAW = "feed string, pos int, title string, link string, description string, published string, source string"
ENTRIES = 15  # entries a feed is read for: the length of a feed's page


class _Feed(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _fetch(path: str, timeout: int = 15) -> bytes | None:
    try:
        if re.match(r"https?://", path):
            from urllib.request import Request, urlopen

            with urlopen(Request(path, headers={"User-Agent": "riskspark"}), timeout=timeout) as reply:
                return reply.read()
        with open(path.removeprefix("file://"), "rb") as f:
            return f.read()
    except Exception:
        return None


def _text(node: ElementTree.Element, *names: str) -> str | None:
    for child in node:
        if child.tag.rsplit("}", 1)[-1] in names:
            return (child.text or child.get("href") or "").strip()
    return None


def parse_feed(raw: bytes | None, feed: str, most: int) -> Iterator[tuple]:
    """The first entries of an RSS or Atom document; nothing if it is malformed."""
    try:
        root = ElementTree.fromstring(raw or b"")
    except ElementTree.ParseError:
        return
    entries = [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] in ("item", "entry")]
    for pos, e in enumerate(entries[:most]):
        yield (feed, pos, _text(e, "title"), _text(e, "link"), _text(e, "description", "summary"), _text(e, "pubDate", "published", "updated", "created"), _text(e, "source"))


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: str):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split("\n") if p]
        self.most, self.kind = int(options.get("limit", ENTRIES)), kind

    def partitions(self) -> list[_Feed]:
        return [_Feed(p) for p in self.paths] or [_Feed("")]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        raw = _fetch(partition.path) if partition.path else None
        if self.kind == "rss":
            yield from parse_feed(raw, partition.path, self.most)
            return
        try:
            articles = json.loads(raw or b"{}").get("articles") or []
        except (ValueError, AttributeError):
            return
        for pos, a in enumerate(articles[: self.most]):
            source = a.get("source")
            name = (source.get("name") or source.get("id")) if isinstance(source, dict) else source
            yield (partition.path, pos, a.get("title"), a.get("url"), a.get("description"), a.get("publishedAt"), name)


class RssSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rss"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: object) -> DataSourceReader:
        return _FeedReader(self.options, "rss")


class NewsApiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsapi"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: object) -> DataSourceReader:
        return _FeedReader(self.options, "newsapi")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RssSource)
    spark.dataSource.register(NewsApiSource)


def read_feeds(spark: SparkSession, paths: list[str], *, kind: str = "rss", limit: int = ENTRIES) -> DataFrame:
    register(spark)
    return spark.read.format(kind).option("paths", "\n".join(paths)).option("limit", limit).load()


def address_key(url: Column) -> Column:
    return F.md5(F.lower(F.trim(url)))


def normalise_entries(rows: DataFrame, *, removed: tuple[str, ...] = ("https://removed.com",)) -> DataFrame:
    """Rows with an address and a title, tags stripped, trust looked up; removed articles fall away."""
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    link = F.trim(F.coalesce("link", F.lit("")))
    kept = rows.where((link != "") & ~link.isin(*removed) & ~title.isin("", "[Removed]"))
    return kept.select("feed", "pos", title.alias("title"), link.alias("url"), strip_tags(F.coalesce("description", F.lit(""))).alias("summary"), "published", F.coalesce("source", "feed").alias("source"), F.round(outlet_trust(F.coalesce("source", F.lit(""))), 3).alias("trust_score"))


def dedup_addresses(rows: DataFrame, *, order: list[str], url: str = "url", family: str | None = None) -> DataFrame:
    """The first row of each address, within ``family`` if given; rows without address all stay out.

    Only key and order go through the aggregate; ties beyond ``order`` go by the whole row.
    """
    by = [*([family] if family else []), "_k"]
    keyed = rows.where(F.trim(F.coalesce(url, F.lit(""))) != "").withColumn("_k", address_key(F.col(url)))
    return keyed.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def union_phases(phases: list[DataFrame]) -> DataFrame:
    """Phases one after the other, with their number; columns are matched by name."""
    out = None
    for i, p in enumerate(phases):
        p = p.withColumn("phase", F.lit(i + 1))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def select_sources(registry: DataFrame, country: str, *, default_trust: float = 0.65) -> DataFrame:
    """Sources for a country: its own, then the world's, each address once.

    ``registry``: country (null for defaults), bucket, pos, name, url, trust_score. An unknown country gets the defaults.
    """
    order = F.when(F.col("bucket") == "local", 0).when(F.col("bucket") == "government", 1).when(F.col("bucket") == "global_wire", 2).otherwise(3)
    own = registry.where((F.col("country") == country) | F.col("country").isNull()).where(F.trim(F.coalesce("url", F.lit(""))) != "")
    ranked = own.withColumn("_o", order).withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("_o", "pos", "name"))).where(F.col("_r") == 1)
    return ranked.select("name", "url", "bucket", F.coalesce("trust_score", F.lit(default_trust)).alias("trust_score"))
