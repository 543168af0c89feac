"""Composable filters of articles: alternatives within a dimension, all dimensions together, none given passes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Filters:
    levels: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    within_hours: int | None = None
    as_of: str | None = None
    least_trust: float | None = None

    def active(self) -> int:
        return sum(bool(x) for x in (self.levels, self.domains, self.countries, self.categories, self.within_hours, self.least_trust))

    def predicate(self, columns: set[str]) -> Column:
        """For a table with ``columns``; a dimension whose column is missing lets nothing through, as a null does."""
        parts: list[Column] = []
        isin = lambda c, v: F.coalesce(F.upper(F.col(c)).isin([x.upper() for x in v]), F.lit(False)) if c in columns else F.lit(False)
        if self.levels:
            parts.append(isin("impact_level", self.levels))
        if self.domains:
            parts.append(isin("disruption_domain", self.domains))
        if self.countries:
            parts.append(isin("country", self.countries))
        if self.categories:
            parts.append(isin("semantic_category", self.categories))
        if self.within_hours:
            low = F.to_timestamp(F.lit(self.as_of)) - F.make_dt_interval(F.lit(0), F.lit(self.within_hours))
            parts.append(F.col("published_ts").isNull() | (F.col("published_ts") >= low))  # what can't be read passes
        if self.least_trust:
            parts.append(F.coalesce(F.col("trust_score") >= self.least_trust, F.lit(False)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filters(rows: DataFrame, filters: Filters) -> DataFrame:
    return rows.where(filters.predicate(set(rows.columns)))


def category_facet(rows: DataFrame, column: str = "semantic_category") -> DataFrame:
    """The distinct known categories, if there are at least two."""
    known = rows.where(F.col(column).isNotNull() & (F.lower(column) != "unknown")).groupBy(F.col(column).alias("category")).agg(F.count("*").cast("bigint").alias("n"))
    many = known.agg(F.count("*").alias("c"))
    return known.join(F.broadcast(many)).where(F.col("c") >= 2).drop("c")


def keyword_search(rows: DataFrame, query: str, *, key: str, title: str, body: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows by key whose title or body contains the query."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    return rows.where(F.contains(text, F.lit(query.lower()))).select(key, title).orderBy(key, title).limit(n)
