"""Labelled corpus records and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import industry, split_sentences, word_count


def extractive_summary(chosen: Column, body: Column) -> Column:
    """The chosen sentences, else the first two of the body, joined by bars."""
    first = F.filter(F.slice(split_sentences(F.coalesce(body, F.lit(""))), 1, 2), lambda s: F.trim(s) != "")
    return F.array_join(F.when(F.size(chosen) > 0, chosen).otherwise(first), " ||| ")


def primary_domain(domains: Column) -> Column:
    """The first disruption domain, else none."""
    return F.coalesce(F.get(F.filter(F.coalesce(domains, F.array().cast("array<string>")), lambda d: F.trim(d) != ""), 0), F.lit("none"))


def corpus_record(articles: DataFrame) -> DataFrame:
    """The sixteen fields of a corpus record, with article_id and run_id.

    ``articles``: title or clean_title, clean_body, relevance_score, trust_score, impact_level, and, where they are there,
    disruption_domains, mmr_sentences, ner_entities (or entities; structs of text and label), semantic_category,
    score_breakdown and cluster_id. What is missing or null gets the field's default.
    """
    have = set(articles.columns)
    take = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), default) if c in have else default
    text = lambda c: take(c, "string", F.lit(""))
    body = text("clean_body")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), take("relevance_score", "double", F.lit(0.0)) / F.lit(100.0))), 6)
    none = F.array().cast("array<string>")
    tags = next((c for c in ("ner_entities", "entities") if c in have), None)
    ner = F.transform(F.col(tags), lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"))) if tags else None
    empty = F.array().cast("array<struct<text:string,label:string>>")
    level = F.upper(F.coalesce(F.nullif(text("impact_level"), F.lit("")), F.lit("LOW")))
    trust = F.coalesce(F.nullif(take("trust_score", "double", F.lit(0.5)), F.lit(0.0)), F.lit(0.5))
    title = text("title") if "title" in have else text("clean_title")
    return articles.select(
        "article_id", "run_id", title.alias("title"), text("url").alias("url"), text("published").alias("published"), text("source").alias("source"), trust.alias("trust_score"),
        industry(F.concat_ws(" ", title, body)).alias("industry_label"), primary_domain(F.col("disruption_domains") if "disruption_domains" in have else none).alias("disruption_domain"), score.alias("risk_score_norm"),
        extractive_summary(take("mmr_sentences", "array<string>", none), body).alias("extractive_summary"), (F.coalesce(ner, empty) if tags else empty).alias("ner_tags"),
        F.when(level.isin("HIGH", "MEDIUM"), 1).otherwise(0).alias("is_relevant"), level.alias("impact_level"), text("semantic_category").alias("semantic_category"),
        take("score_breakdown", "map<string,int>", F.create_map().cast("map<string,int>")).alias("score_breakdown"), take("cluster_id", "int", F.lit(-1)).alias("cluster_id"), word_count(body).alias("word_count"),
    )


def corpus_stats(records: DataFrame) -> DataFrame:
    """Counts by industry, by domain, by impact level and in all, in one pass; the ratio of relevant rows for each."""
    level, dom, ind = F.upper("impact_level").alias("lvl"), F.coalesce("disruption_domain", F.lit("none")).alias("dom"), F.coalesce("industry_label", F.lit("general")).alias("ind")
    base = records.select(ind, dom, level, "is_relevant")
    g = base.groupingSets([["ind"], ["dom"], ["lvl"], []], "ind", "dom", "lvl").agg(F.count("*").cast("bigint").alias("n"), F.round(F.avg("is_relevant"), 4).alias("relevant_ratio"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "industry").when(F.col("g") == 5, "domain").when(F.col("g") == 6, "impact").otherwise("all")
    return g.select(kind.alias("kind"), F.coalesce("ind", "dom", "lvl", F.lit("")).alias("value"), "n", "relevant_ratio")


def write_jsonl(records: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Records as lines of JSON, one file per task; ``one_file`` for an export small enough for one task."""
    (records.coalesce(1) if one_file else records).write.mode("overwrite").json(path)
