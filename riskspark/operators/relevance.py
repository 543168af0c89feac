"""Relevance of articles: six scores, a total, an impact level and links to exposure nodes.

All scores are expressions over one row; each lexicon is one compiled pattern, so no join multiplies rows.
Null titles and bodies count as empty, a null trust as ``default_trust``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as X


def article_text(title: str = "clean_title", body: str = "clean_body") -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit(""))))


def disruption_domains(text: Column | str, lexicon: dict[str, list[str]] | None = None, inline: dict[str, list[str]] | None = None) -> Column:
    """Domains in lexicon order, then inline ones; words of the lexicon stand alone, inline phrases are substrings."""
    lexicon, inline = lexicon or X.SAMPLE_LEXICON, X.INLINE_DOMAINS if inline is None else inline
    # A plain search, which is fast, passes over the texts that the pattern need not see.
    column = F.col(text) if isinstance(text, str) else text
    alone = lambda terms: any_phrase(text, terms) & column.rlike(X.whole_words(terms))
    hits = [F.when(alone(terms), F.lit(d)) for d, terms in lexicon.items()]
    for d, phrases in inline.items():
        hits.append(F.when(any_phrase(text, phrases) & ~alone(lexicon[d]) if d in lexicon else any_phrase(text, phrases), F.lit(d)))
    return F.array_compact(F.array(*hits))


def disruption_score(domains: Column, points: dict[str, int] | None = None) -> Column:
    """Points of the domains, a bonus for two or more, 35 at most."""
    points = points or X.DOMAIN_POINTS
    one = lambda d: reduce(lambda e, kv: F.when(d == kv[0], kv[1]).otherwise(e), points.items(), F.lit(X.OTHER_DOMAIN_POINTS))
    total = F.aggregate(domains, F.lit(0), lambda s, d: s + one(d))
    return F.least(total + F.when(F.size(domains) >= 2, X.MULTI_DOMAIN_BONUS).otherwise(0), F.lit(35)).cast("int")


def _found(text: Column | str, words: list[str]) -> list[Column] | str:
    """``contains`` for each word; for a column given by name as one SQL text, which is built in one call."""
    if isinstance(text, str):
        return [f"contains(`{text}`, '{w}')" for w in (w.replace("\\", "\\\\").replace("'", "\\'") for w in words)]
    return [F.contains(text, F.lit(w)) for w in words]


def count_phrases(text: Column | str, phrases: list[str]) -> Column:
    found = _found(text, phrases)
    if isinstance(text, str):
        return F.expr(" + ".join(f"cast({f} as int)" for f in found))
    return reduce(lambda a, b: a + b, [f.cast("int") for f in found])


def any_phrase(text: Column | str, phrases: list[str]) -> Column:
    found = _found(text, phrases)
    return F.expr(" or ".join(found)) if isinstance(text, str) else reduce(lambda a, b: a | b, found)


def keyword_density(text: Column | str, keywords: list[str] | None = None) -> Column:
    """0, 6, 11, 16, 16, 20 for 0, 1, 2, 3, 4 and more context words, found as substrings."""
    n = count_phrases(text, keywords or X.SUPPLY_CHAIN)
    # By place in a list, so that the long count stands in the plan once.
    return F.element_at(F.array(*map(F.lit, (0, 6, 11, 16, 16, 20))), F.least(n, F.lit(5)) + 1).cast("int")


def trust_points(trust: Column, default: float = 0.5) -> Column:
    """Tenths of the trust, half to even, 10 at most."""
    return F.least(F.bround(F.coalesce(trust, F.lit(default)) * 10, 0).cast("int"), F.lit(10))


def press_penalty(text: Column | str) -> Column:
    n = count_phrases(text, X.PRESS_RELEASE)
    return F.element_at(F.array(*map(F.lit, (0, 5, 15))), F.least(n, F.lit(2)) + 1).cast("int")


def padded(text: Column) -> Column:
    """Text with one space for every run of other characters than letters and digits, and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def impact_level(total: Column, disruption: Column, supply_chain: Column, *, high: int = 55, medium: int = 30) -> Column:
    return F.when((disruption == 0) | (supply_chain == 0), "LOW").when(total >= high, "HIGH").when(total >= medium, "MEDIUM").otherwise("LOW")


def score_articles(articles: DataFrame, *, lexicon: dict[str, list[str]] | None = None, text: Column | None = None, trust: str = "trust_score") -> DataFrame:
    """The scores that the text and its source alone decide, their total (0 to 100) and the impact level; ``resolve`` adds those of a client's exposure."""
    own = articles.withColumn("_text", text if text is not None else article_text())
    own = own.withColumns({"disruption_domains": disruption_domains("_text", lexicon), "supply_chain": keyword_density("_text"), "trust": trust_points(F.col(trust)), "penalty": press_penalty("_text")}).drop("_text")
    own = own.withColumn("disruption", disruption_score(F.col("disruption_domains")))
    total = F.col("disruption") + F.col("supply_chain") + F.col("trust") - F.col("penalty")
    own = own.withColumn("total", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"))
    return own.withColumn("impact", impact_level(F.col("total"), F.col("disruption"), F.col("supply_chain")))


LEVEL_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def level_rank(level: Column) -> Column:
    return reduce(lambda e, kv: F.when(F.upper(level) == kv[0], kv[1]).otherwise(e), LEVEL_RANK.items(), F.lit(0)).cast("int")


def rank_articles(scored: DataFrame, n: int, *, tie: list[str]) -> DataFrame:
    """The ``n`` first by level, then score, then ``tie``."""
    return scored.orderBy(level_rank(F.col("impact")).desc(), F.col("total").desc(), *tie).limit(n)
