"""A whole analysis of one or more clients' articles: every stage in order, as DataFrames that share what they can.

Tables that several stages read are written: the scored and preprocessed articles, the vectors, the clusters, what clients see
of them and its scores. Summaries, topics, briefs and core paragraphs are made when they are first asked for: the portfolio rests
on none of them. A stage that has nothing to work on gives an empty table. Hooks are those of ``stages``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from . import graph as G
from . import resolve as V
from . import risk as K
from . import stages as ST
from . import summaries as S
from . import topics as P
from . import vectors as X
from .relevance import level_rank

NEWS, QUERIES = 30, 50  # fixed values: rows of articles and queries that a response shows of each client


@dataclass
class Analysis:
    """The tables of an analysis. Keys are client_id, article_id and cluster_id (within a client: clusters are those of all its articles)."""

    exposure: DataFrame
    queries: DataFrame
    scored: DataFrame
    kept: DataFrame
    node_risk: DataFrame
    portfolio: DataFrame
    funnel: DataFrame
    make_encoded: Callable[[], DataFrame]
    make_articles: Callable[[], DataFrame]
    make_assigned: Callable[[], tuple[DataFrame | None, DataFrame | None]]
    make_clusters: Callable[[DataFrame | None, DataFrame | None], DataFrame]
    make_topics: Callable[[DataFrame | None, DataFrame | None], DataFrame]

    @cached_property
    def encoded(self) -> DataFrame:
        return self.make_encoded()

    @cached_property
    def articles(self) -> DataFrame:
        return self.make_articles()

    @cached_property
    def assigned(self) -> tuple[DataFrame | None, DataFrame | None]:
        """The topic of each article and the labels of topics; None where there are too few articles."""
        return self.make_assigned()

    @cached_property
    def clusters(self) -> DataFrame:
        return self.make_clusters(*self.assigned)

    @cached_property
    def topics(self) -> DataFrame:
        return self.make_topics(*self.assigned)

    def news(self) -> DataFrame:
        """The first articles of each client by level, score and id."""
        order = [level_rank(F.col("impact_level")).desc(), F.col("relevance_score").desc(), F.col("article_id")]
        return X.rank_rows(self.articles, ["client_id"], order, NEWS)

    def shown_queries(self) -> DataFrame:
        return self.queries.where(F.col("pos") < QUERIES)


def analyze(
    articles: DataFrame, profiles: DataFrame, dims: V.Dims, centroids: DataFrame, as_of: str, *, encoder: ST.Hook | None = None, ner: ST.Hook | None = None, brief_fn: ST.Hook | None = None, dim: int = 384,
    near: float = 0.88, alike: float = 0.75, title: str = "title", body: str = "summary",
) -> Analysis:
    """``articles`` (article_id, title, summary, url, published_ts, source, country, trust_score), one row per article, analysed for all ``profiles``.

    Near-duplicates (cosine ``near``) are dropped in order of the best score any client gives them, events are clusters of articles
    within ``alike``; articles without vectors are events of their own. ``as_of`` stands for now in the velocity.
    """
    own = articles.where(F.col("article_id").isNotNull()).dropDuplicates(["article_id"])
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    exposure, queries = V.exposure(profiles, dims), V.generate_queries(profiles, dims)
    scored = V.score_for_clients(own, profiles, dims, keys=["article_id"], text=text)
    scored = materialize(scored.select("client_id", "article_id", F.col("total").alias("relevance_score"), F.col("impact").alias("impact_level"), "matched", "linked_nodes", "disruption_domains"), "scored")
    best = scored.groupBy("article_id").agg(F.max("relevance_score").alias("relevance_score"), F.max_by("impact_level", level_rank(F.col("impact_level"))).alias("impact_level"), F.array_distinct(F.flatten(F.collect_list("matched"))).alias("matched"))
    made = ST.preprocess(own.drop("relevance_score", "impact_level", "matched").join(best, "article_id"), title=title, body=body, ner=ner)
    made = materialize(made, "preprocessed")
    payload = ST.encoder_payload(made, with_entities=False)
    encoded = materialize(ST.encode_documents(payload, centroids, encoder=encoder, dim=dim), "vectors")
    # Duplicates, then events, over the kept articles.
    ranked = made.select("article_id", F.col("relevance_score").alias("priority"))
    kept = X.greedy_dedup(ranked, X.similarity_pairs(encoded, near, key="article_id", vector="embedding"), key="article_id")
    kept = materialize(kept, "kept")
    left = made.join(kept.where("kept").select("article_id", F.col("absorbed").alias("dedup_similar_count")), "article_id")
    alive = encoded.join(left.select("article_id"), "article_id", "left_semi")
    clustered = G.density_clusters(left.select("article_id"), X.similarity_pairs(alive, alike, key="article_id", vector="embedding"), key="article_id")
    rows = left.join(clustered, "article_id").join(encoded.select("article_id", "semantic_category", "semantic_score"), "article_id", "left")
    rows = materialize(rows, "clustered")
    # What a client sees of an event: its own scores of the event's articles.
    members = rows.select("article_id", "cluster_id", "is_noise", "cluster_size", "clean_title", "source", "country", "published_ts", "semantic_category").join(scored, "article_id")
    members = materialize(members, "members")
    scores = materialize(_dimensions(members, as_of), "event-scores")

    def make_articles() -> DataFrame:
        told = ST.attach_summaries(rows.select("article_id", "clean_title", "sentences"), S.lexrank_documents(rows, key="article_id", sentences="sentences", n=2), key="article_id")
        order = ["article_id", "cluster_id", "is_noise", "cluster_size", "clean_title", "lexrank_summary"]
        return materialize(members.join(told.select("article_id", "lexrank_summary"), "article_id").select(*order, *[c for c in members.columns if c not in order]), "articles")

    def make_assigned() -> tuple[DataFrame | None, DataFrame | None]:
        topics = ST.model_topics(alive, key="article_id", vector="embedding")
        if topics is None:
            return None, None
        return topics, P.labels(P.keywords(rows.join(topics, "article_id").select("topic_id", "article_id", T.tokens(ST.document_text(F.col("clean_title"), F.col("clean_body")), 4).alias("t")), by="topic_id", doc="article_id", tokens="t"), by="topic_id")

    def make_clusters(topics: DataFrame | None, names: DataFrame | None) -> DataFrame:
        lines = rows.select("cluster_id", "article_id", F.posexplode("sentences").alias("i", "sentence")).select("cluster_id", (F.col("article_id") * (1 << 20) + F.col("i")).alias("pos"), "sentence")
        summary = S.lexrank(lines, by="cluster_id", pos="pos", text="sentence", n=4)
        told = rows.select("cluster_id", "article_id", F.posexplode(ST.brief_sentences(F.col("clean_body"))).alias("i", "s")).select("cluster_id", (F.col("article_id") * (1 << 20) + F.col("i")).alias("pos"), "s")
        chosen = ST.distinct_sentences(told, by="cluster_id", pos="pos", text="s").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("mmr_sentences"))
        level = members.groupBy("client_id", "cluster_id").agg(
            F.first("is_noise").alias("is_noise"), F.first("cluster_size").alias("article_count"), F.max_by("impact_level", level_rank(F.col("impact_level"))).alias("impact_level"), F.max("relevance_score").alias("risk_score"), F.min_by("clean_title", "article_id").alias("headline"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("linked_nodes")))).alias("linked_nodes"), F.array_sort(F.collect_set("source")).alias("sources"),
        )
        events = level.join(scores.drop("is_noise"), ["client_id", "cluster_id"]).join(summary, "cluster_id", "left").join(chosen, "cluster_id", "left")
        voted = ST.attach_topics(rows.select("cluster_id", "article_id", F.col("article_id").alias("pos")), topics, names)
        events = events.join(voted, "cluster_id", "left")
        keyed = ST.attach_briefs(events.withColumn("k", F.concat_ws("/", "client_id", "cluster_id")), by="k", brief_fn=brief_fn).drop("k")
        return materialize(keyed, "events")

    def make_topics(topics: DataFrame | None, names: DataFrame | None) -> DataFrame:
        if topics is None:
            return rows.limit(0).select(F.lit(0).alias("topic_id"), F.lit(0).alias("articles"), "impact_level", F.lit(0).alias("risk_score"), F.lit("").alias("label"))
        return ST.topic_rollup(rows, topics).join(names, "topic_id", "left")

    nodes = exposure.where("node_type <> 'node'").select("client_id", "node_type", "node").distinct()
    edges = scored.select("client_id", F.explode("linked_nodes").alias("e"), "impact_level", "relevance_score").select("client_id", F.split("e", ":", 2)[0].alias("node_type"), F.split("e", ":", 2)[1].alias("node"), "impact_level", "relevance_score")
    count = lambda v: F.count_if(F.col("impact_level") == v).alias(v.lower())
    risk = nodes.join(edges.groupBy("client_id", "node_type", "node").agg(count("HIGH"), count("MEDIUM"), count("LOW"), F.max("relevance_score").alias("max_score")), ["client_id", "node_type", "node"], "left").na.fill(0)
    weight = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    real = scores.where("not is_noise").groupBy("client_id").agg(F.round(F.sum(F.col("composite") * weight) / F.sum(weight), 1).alias("overall_score"), F.count("*").alias("clusters"))
    portfolio = profiles.select("client_id").distinct().join(real, "client_id", "left").na.fill(0).withColumn("overall_severity", K.severity(F.col("overall_score")))
    funnel = scored.groupBy("client_id").agg(F.count("*").alias("scored"), F.count_if(F.size("matched") > 0).alias("matched"), count("HIGH"), count("MEDIUM"), count("LOW"))
    funnel = funnel.join(members.groupBy("client_id").agg(F.count("*").alias("kept"), F.count_distinct("cluster_id").alias("clusters")), "client_id", "left").na.fill(0)
    return Analysis(exposure, queries, scored, kept, risk, portfolio, funnel, lambda: ST.with_core(encoded, payload, encoder=encoder, dim=dim), make_articles, make_assigned, make_clusters, make_topics)


def _dimensions(members: DataFrame, as_of: str) -> DataFrame:
    """(client_id, cluster_id, is_noise) with the eight dimensions, composite and severity; an article counts once, its domains each."""
    one = members.select(F.concat_ws("/", "client_id", "cluster_id").alias("k"), "client_id", "cluster_id", "is_noise", F.col("relevance_score").alias("score"), F.lit(None).cast("string").alias("domain"), "country", "source", F.col("published_ts").alias("published"), F.col("linked_nodes").alias("nodes"))
    numbered = one.withColumn("n", F.xxhash64("k")).withColumn("n", F.pmod("n", F.lit((1 << 62) - 1)))
    base = K.cluster_dimensions(numbered, as_of, by="n")
    domains = members.select(F.concat_ws("/", "client_id", "cluster_id").alias("k"), F.explode("disruption_domains").alias("domain")).where(F.col("domain").isNotNull()).groupBy("k").agg(F.count_distinct(F.lower("domain")).alias("d"))
    keys = numbered.select("n", "k", "client_id", "cluster_id", "is_noise").distinct()
    full = keys.join(base.drop("breadth"), "n").join(domains, "k", "left").withColumn("breadth", F.least(F.coalesce("d", F.lit(0)) * 20, F.lit(100)).cast("double"))
    return K.composite(full).select("client_id", "cluster_id", "is_noise", *K.WEIGHTS, "composite", "severity")
