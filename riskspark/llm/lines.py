"""Lines that one source prints again and again.

Per-source line counts are a table that grows by deltas: a new partition of articles adds its own counts,
lines whose count crosses the threshold are detected, and only the articles that hold such lines, or new
articles that hold lines known before, get new result rows.

Defined results: null and empty bodies have no lines; an article without a source has no site and none
of its lines is counted; redelivered rows of an article are one article, of which the first delivery
counts across partitions; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timestamps import MONTH_NAMES, MONTH_SHORT
from ..session import at_once, materialize, small_side
from ..store import Store, bucket_count

# Weekday names of the supported languages.
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo"
).split()


def _any(words: object) -> str:
    return "(?:" + "|".join(sorted(words, key=lambda n: (-len(n), n))) + ")"


def _date_patterns() -> tuple[str, str, str]:
    """Dates and times that begin with a digit, those that begin with a month, weekdays before either."""
    full = {n for names in MONTH_NAMES.values() for n in names.split()}
    month, day = _any(full | {n[:3] for n in full} | set(MONTH_SHORT)) + r"\.?", r"\d{1,2}(?:st|nd|rd|th|\.)?"
    clock = r"\d{1,2}[:.h]\d{2}(?::\d{2})?\s*(?:[ap]\.?m\b\.?|uhr\b)?(?:\s*(?:utc|gmt|[a-z]{1,3}st|[a-z]{1,3}dt|cet|cest)\b)?"
    first = "[" + "".join(sorted({n[0] for n in full})) + "]"
    return (
        rf"(?<!\d)(?:{day}\s+(?:de\s+)?{month}(?:,?\s+(?:de\s+)?\d{{2,4}})?|{clock})(?!\p{{L}})",
        rf"(?={first})(?<!\p{{L}}){month}\s+(?:{day},?\s+\d{{4}}|\d{{4}}|{day})(?!\p{{L}})",
        rf"(?<!\p{{L}}){_any(WEEKDAYS)}\.?,?\s*(?=\x{{1}})",
    )


DIGIT_DATE, MONTH_DATE, WEEKDAY_DATE = _date_patterns()
LINK = r"(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\w.])(?:[a-z0-9-]+\.)+(?:com|org|net|example|info|io|news)(?:/\S*)?(?![\w])"
INVISIBLE = r"[\p{Cf}\p{Mn}]"


def letters(text: Column) -> Column:
    """Lower-case letters alone: case, spacing, punctuation, invisible characters, numbers, dates and links are gone."""
    low = F.lower(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), r"[\p{Z}\s]+", " "))
    linked = F.when(low.rlike(r"[a-z]\.[a-z]|://|@"), F.regexp_replace(low, LINK, " ")).otherwise(low)
    dated = F.regexp_replace(F.regexp_replace(F.regexp_replace(linked, DIGIT_DATE, "\x01"), MONTH_DATE, "\x01"), WEEKDAY_DATE, "")
    return F.regexp_replace(F.when(linked.rlike(r"\d"), dated).otherwise(linked), r"[^\p{L}]+", "")


def article_lines(articles: DataFrame, *, key: str = "article_id", body: str = "clean_body", headline: str = "clean_title") -> DataFrame:
    """(article_id, line_no, source, line, line_key) of all lines; line_no from 1, split at the line feed."""
    rows = articles.where(F.col(body).isNotNull()).select(
        F.col(key).alias("article_id"), F.col("source").alias("source"), F.split(F.col(body), "\n").alias("_lines"), letters(F.coalesce(F.col(headline), F.lit(""))).alias("_head")
    )
    rows = rows.select("article_id", "source", "_head", F.posexplode("_lines").alias("pos", "line"))
    plain = letters(F.col("line"))
    # A headline of a few letters could be part of ordinary words, so only longer ones are taken out.
    plain = F.when(F.length("_head") >= 12, F.replace(plain, F.col("_head"), F.lit(""))).otherwise(plain)
    return rows.select("article_id", (F.col("pos") + 1).alias("line_no"), "source", "line", F.xxhash64("source", plain).alias("line_key")).where(F.trim(F.regexp_replace("line", r"[\p{Cf}\p{Z}\s]+", "")) != "")


class LineCounts:
    """Per-source line counts, a store to which each partition of articles adds its counts, and which can be opened again.

    Lines, counts and articles are parted by a hash of their key: a partition reads the parts its own
    lines and articles fall into and no others.
    """

    SEEN, LINES, COUNTS, FOUND = "key bigint", "line_key bigint, article_id bigint, line_no int", "line_key bigint, n bigint", "article_id bigint, line_no int"

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: int = 3):
        self.store, self.threshold = Store(spark, path, "lines"), threshold
        self.path = self.store.path

    def merge(self, articles: DataFrame, **columns: str) -> None:
        """Add one partition of articles; counts, line table and result rows grow by what it brings."""
        store = self.store
        # The hash of the line stands for it: no text is shuffled. Equal redeliveries fall together.
        lines = article_lines(articles, **columns).where(F.col("source").isNotNull()).select("line_key", "article_id", "line_no").distinct()
        lines = materialize(lines, "lines-new")
        ids = lines.select(F.col("article_id").alias("key")).distinct()
        if not store.steps:
            store.buckets = bucket_count(lines.count())
            fresh = ids
        else:
            ids = materialize(ids, "articles-new")
            known = store.read("seen", self.SEEN, store.touched(ids)).join(small_side(ids), "key", "left_semi")
            fresh = materialize(ids.join(known, "key", "left_anti"), "articles-new")
            lines = lines.join(fresh.select(F.col("key").alias("article_id")), "article_id", "left_semi").select("line_key", "article_id", "line_no")
        store.begin()
        at_once(lambda: store.write(fresh, "seen", store.bucket(F.col("key"))), lambda: store.write(lines, "lines", store.bucket(F.col("line_key"))))
        own = store.read("lines", self.LINES, own=True)
        delta = own.select("line_key", "article_id").distinct().groupBy("line_key").agg(F.count("*").alias("n"))
        store.write(delta, "counts", store.bucket(F.col("line_key")))
        delta = store.read("counts", self.COUNTS, own=True).select("line_key", F.col("n").alias("new"))
        if store.steps:
            before = store.read("counts", self.COUNTS, store.touched(delta.select(F.col("line_key").alias("key")))).select("line_key", "n")
            old = before.join(small_side(delta.select("line_key")), "line_key", "left_semi").groupBy("line_key").agg(F.sum("n").alias("old"))
            delta = delta.join(old, "line_key", "left")
        else:
            delta = delta.withColumn("old", F.lit(None).cast("bigint"))
        old = F.coalesce("old", F.lit(0))
        hot = materialize(delta.where(old + F.col("new") >= self.threshold).select("line_key", (old < self.threshold).alias("crossed")), "lines-hot")
        found = own.join(hot, "line_key", "left_semi")
        if store.steps:
            # Only lines that crossed the threshold now are looked up in what came before.
            crossed = hot.where("crossed").select("line_key")
            before = store.read("lines", self.LINES, store.touched(crossed.select(F.col("line_key").alias("key"))))
            found = found.select("article_id", "line_no").unionByName(before.join(small_side(crossed), "line_key", "left_semi").select("article_id", "line_no"))
        store.write(found.select("article_id", "line_no"), "found")
        store.publish()

    def found(self) -> DataFrame:
        """(article_id, line_no) of all lines that stand in ``threshold`` or more articles of their source."""
        return self.store.read("found", self.FOUND)


def repeated_lines(articles: DataFrame, *, threshold: int = 3, arrival: str | None = "fetched_at", steps: tuple[float, ...] = (0.7, 0.85)) -> DataFrame:
    """(article_id, line_no) of lines repeated within a source, by merging partitions in order of arrival.

    ``steps``: fractions of the rows, by ``arrival``, at which partitions end. The result does not depend on them.
    """
    store = LineCounts(articles.sparkSession, threshold=threshold)
    bounds = []
    if arrival and steps:
        got = articles.select(F.percentile_approx(arrival, list(steps), 1000).alias("b")).first()["b"]
        bounds = sorted(set(got or []))
    if not bounds:
        store.merge(articles)
        return store.found()
    at = F.col(arrival)
    store.merge(articles.where(at.isNull() | (at <= F.lit(bounds[0]))))
    for low, high in zip(bounds, [*bounds[1:], None]):
        store.merge(articles.where((at > F.lit(low)) & (F.lit(True) if high is None else at <= F.lit(high))))
    return store.found()


def own_lines(articles: DataFrame, *, threshold: int = 3, step: str = "own-lines") -> DataFrame:
    """One row per article with a body, once however often delivered: (article_id, source, lines, site).

    ``lines`` are all its lines in order, ``site`` the numbers of those its source repeats.
    """
    store = LineCounts(articles.sparkSession, threshold=threshold)
    store.merge(articles)
    site = store.found().groupBy("article_id").agg(F.collect_list("line_no").alias("site"))
    bodies = articles.where(F.col("clean_body").isNotNull() & F.col("clean_body").rlike(r"\S")).select("article_id", "source", "clean_body").dropDuplicates(["article_id"])
    none = F.array().cast("array<int>")
    return bodies.join(site, "article_id", "left").select("article_id", "source", F.split("clean_body", "\n").alias("lines"), F.coalesce("site", none).alias("site"))
