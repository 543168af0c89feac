"""The stages of an analysis, each from DataFrame to DataFrame: preprocessing, encoding, topics, summaries, briefs, risk.

Models are hooks: ``ner``, ``encoder`` and ``brief_fn`` are functions on batches of pandas rows. Where none is given a
gazetteer, hashed words and a brief of the chosen sentences take their place. A row on which a hook fails keeps its other
columns and is marked; a null or empty text has no sentences, entities or vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import topics as P
from .relevance import level_rank
from .vectors import archetypes, core_paragraph, hash_encode, paragraphs

Hook = Callable[[pd.DataFrame], pd.Series]
ENTITIES = "array<struct<text:string,label:string>>"
ENTITY_LABELS = {"ORG", "GPE", "LOC", "PRODUCT", "EVENT", "FAC", "NORP"}  # fixed values: kinds of entities that are kept


def gazetteer(names: dict[str, str]) -> Hook:
    """A tagger that finds listed names (name to label) as whole words, in order of the list."""
    import re

    known = [(n, label, re.compile(rf"(?<!\w){re.escape(n)}(?!\w)")) for n, label in names.items()]

    def tag(rows: pd.DataFrame) -> pd.Series:
        return rows["text"].map(lambda t: [{"text": n, "label": label} for n, label, p in known if p.search(t or "")])

    return tag


def _tagged(ner: Hook, rows: pd.DataFrame) -> tuple[list[list[dict[str, str]]], list[bool]]:
    """Entities of each row, once by name and label, and whether the tagger took it; rows of a batch on which it fails are tagged one by one."""
    try:
        got, ok = list(ner(rows)), [True] * len(rows)
    except Exception:
        got, ok = [], []
        for i in range(len(rows)):
            try:
                got.append(list(ner(rows.iloc[i : i + 1]))[0])
                ok.append(True)
            except Exception:
                got.append([])
                ok.append(False)
    kept = []
    for ents in got:
        seen: dict[tuple[str, str], dict[str, str]] = {}
        for e in ents if isinstance(ents, (list, np.ndarray)) else []:
            name = str(e["text"]).strip()
            if len(name) >= 2 and e["label"] in ENTITY_LABELS:
                seen.setdefault((name.lower(), e["label"]), {"text": name, "label": e["label"]})
        kept.append(list(seen.values()))
    return kept, ok


def tag_entities(text: Column, ner: Hook) -> Column:
    """(entities, ok) of a text: its entities, once by name and label; where the tagger fails none, and ok is false.

    ``ner`` takes a frame with ``text`` and gives lists of {text, label}.
    """

    def run(texts: pd.Series) -> pd.DataFrame:
        kept, ok = _tagged(ner, pd.DataFrame({"text": texts}))
        return pd.DataFrame({"entities": kept, "ok": ok})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, f"entities {ENTITIES}, ok boolean")(text)


def _named(matched: Column, entities: Column) -> tuple[Column, Column]:
    """Matched names, labelled RULE, and tagged ones, both normalised."""
    rule = F.transform(matched, lambda m: F.struct(T.normalise_entity(m).alias("text"), F.lit("RULE").alias("label"), F.lit("rule").alias("source")))
    return rule, F.transform(entities, lambda e: F.struct(T.normalise_entity(e["text"]).alias("text"), e["label"].alias("label"), F.lit("ner").alias("source")))


def _node_type(name: Column, kinds: dict[str, set[str]] | None) -> Column:
    out = F.lit(None).cast("string")
    for node_type in reversed(("supplier", "material", "port", "route")):
        own = sorted((kinds or {}).get(node_type, ()))
        out = F.when(F.lower(name).isin(own), node_type).otherwise(out) if own else out
    return out


def fuse_entities(matched: Column, entities: Column, kinds: dict[str, set[str]] | None = None) -> Column:
    """Matched names (label RULE), then tagged ones, each name once, with the node type a name stands for.

    ``kinds``: lower-case names of suppliers, materials, ports and routes, looked up in that order.
    """
    empty = F.array().cast("array<struct<text:string,label:string,source:string>>")
    rule, found = _named(matched, entities)
    every = F.concat(F.coalesce(rule, empty), F.coalesce(found, empty))
    names = F.transform(every, lambda e: F.lower(e["text"]))
    firsts = F.filter(F.transform(every, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: F.array_position(names, F.lower(x["e"]["text"])) == x["i"] + 1)
    return F.transform(firsts, lambda x: F.struct(x["e"]["text"].alias("text"), x["e"]["label"].alias("label"), x["e"]["source"].alias("source"), _node_type(x["e"]["text"], kinds).alias("node_type")))


def fuse_rows(rows: DataFrame, *, by: list[str], matched: str, entities: str, kinds: dict[str, set[str]] | None = None) -> DataFrame:
    """(by, ner_entities): ``fuse_entities`` over all rows of a key, each name once, by its first place in any row; ties by name and label.

    A key without names has no row.
    """
    placed = lambda own, kind: F.transform(own, lambda e, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), e["text"].alias("text"), e["label"].alias("label"), e["source"].alias("source")))
    rule, found = _named(F.coalesce(matched, F.array().cast("array<string>")), F.coalesce(entities, F.array().cast(ENTITIES)))
    names = rows.select(*by, F.explode(F.concat(placed(rule, 0), placed(found, 1))).alias("e"))
    firsts = names.groupBy(*by, F.lower("e.text").alias("_name")).agg(F.min("e").alias("e")).groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("_e"))
    return firsts.select(*by, F.transform("_e", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["source"].alias("source"), _node_type(e["text"], kinds).alias("node_type"))).alias("ner_entities"))


def preprocess(articles: DataFrame, *, key: str = "article_id", title: str = "title", body: str = "summary", matched: str = "matched", ner: Hook | None = None, kinds: dict[str, set[str]] | None = None, clean: bool = True) -> DataFrame:
    """``articles`` with clean_title, clean_body, sentences, ner_entities, entity_string, input_text, input_text_w_ent, token_estimate and preprocessing_ok."""
    own = articles.withColumns({"_title": F.coalesce(title, F.lit("")), "_body": F.coalesce(body, F.lit(""))}).drop("clean_title", "clean_body", "sentences", "ner_entities", "entity_string", "input_text", "input_text_w_ent", "token_estimate", "preprocessing_ok")
    make = T.clean_text if clean else (lambda c: c)
    own = own.withColumns({"clean_title": make(F.col("_title")), "clean_body": make(F.col("_body"))}).drop("_title", "_body")
    own = own.withColumn("sentences", T.usable_sentences(F.col("clean_body")))
    none = F.array().cast(ENTITIES)
    if ner is not None:
        # Rows are tagged where they lie, each by its own text: a key may come more than once.
        own = own.withColumn("_tags", tag_entities(F.concat_ws(" ", "clean_title", "clean_body"), ner))
        own = own.withColumns({"_ents": F.col("_tags.entities"), "_ok": F.col("_tags.ok")}).drop("_tags")
    else:
        own = own.withColumns({"_ents": none, "_ok": F.lit(True)})
    have = F.col(matched) if matched in own.columns else F.array().cast("array<string>")
    own = own.withColumn("ner_entities", fuse_entities(have, F.col("_ents"), kinds))
    own = own.withColumn("entity_string", F.array_join(F.transform(F.slice("ner_entities", 1, 10), lambda e: F.concat(e["text"], F.lit(" ("), e["label"], F.lit(")"))), " | "))
    own = own.withColumn("input_text", T.input_text(F.col("clean_title"), F.col("sentences")))
    own = own.withColumn("input_text_w_ent", F.when(F.col("entity_string") != "", F.concat_ws("  ", "input_text", F.concat(F.lit("[ENT] "), F.col("entity_string")))).otherwise(F.col("input_text")))
    return own.withColumns({"token_estimate": T.token_estimate(F.col("input_text")), "preprocessing_ok": F.coalesce("_ok", F.lit(False))}).drop("_ents", "_ok")


def entity_averages(preprocessed: DataFrame) -> DataFrame:
    """One row: articles, mean sentences, mean entities and mean tokens, to two decimals; zeros for no rows."""
    mean = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 2)
    return preprocessed.agg(F.count("*").alias("articles"), mean(F.size("sentences")).alias("sentences"), mean(F.size("ner_entities")).alias("entities"), mean(F.col("token_estimate")).alias("tokens"))


def encoder_payload(preprocessed: DataFrame, *, key: str = "article_id", with_entities: bool = True) -> DataFrame:
    """(key, text, sentences, source, impact_level, relevance_score): what an encoder is given; articles without text stay out."""
    text = F.col("input_text_w_ent" if with_entities else "input_text")
    return preprocessed.where(F.trim(F.concat("clean_title", "clean_body")) != "").select(key, text.alias("text"), "sentences", "source", "impact_level", "relevance_score")


def _vectors(rows: DataFrame, name: str, encoder: Hook | None, dim: int) -> DataFrame:
    """(name, embedding) of rows (name, text) by the encoder, or by hashed words."""
    if encoder is None:
        return hash_encode(rows, key=name, text="text", dim=dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({name: part[name], "embedding": [None if v is None else np.asarray(v, dtype=np.float32) for v in encoder(part)]})

    return rows.select(name, "text").mapInPandas(run, f"{name} bigint, embedding array<float>")


def encode_documents(payload: DataFrame, centroids: DataFrame, *, key: str = "article_id", encoder: Hook | None = None, dim: int = 384) -> DataFrame:
    """(key, semantic_category, semantic_score, archetype_matches, embedding): what ``encode`` gives of whole texts, without their sentences."""
    docs = _vectors(payload.select(F.col(key).cast("bigint").alias(key), "text"), key, encoder, dim)
    best = archetypes(docs, centroids, key=key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "category", "score"))).alias("m"))
    matches = F.transform("m", lambda x: F.struct(x["category"].alias("category"), x["score"].alias("score")))
    out = docs.join(best, key, "left")
    return out.select(key, F.coalesce(F.col("m")[0]["category"], F.lit("unknown")).alias("semantic_category"), F.coalesce(F.col("m")[0]["score"], F.lit(0.0)).alias("semantic_score"), matches.alias("archetype_matches"), "embedding")


def with_core(docs: DataFrame, payload: DataFrame, *, key: str = "article_id", encoder: Hook | None = None, dim: int = 384) -> DataFrame:
    """The rows of ``encode``: ``docs`` of ``encode_documents`` with the core paragraph, for which the sentences of ``payload`` are encoded."""
    lines = payload.select(F.col(key).cast("bigint").alias("doc"), F.posexplode("sentences").alias("pos", "text"))
    keyed = lines.withColumn("sid", F.xxhash64("doc", "pos"))
    sent = keyed.select("sid", "doc", "pos").join(_vectors(keyed.select("sid", "text"), "sid", encoder, dim), "sid").where(F.col("embedding").isNotNull())
    pooled = paragraphs(sent, doc="doc", pos="pos", vector="embedding")
    core = core_paragraph(docs.where(F.col("embedding").isNotNull()).select(F.col(key).alias("doc"), "embedding"), pooled, doc="doc", vector="embedding").select(F.col("doc").alias(key), F.col("core").alias("core_paragraph_idx"))
    return docs.join(core, key, "left").select(
        key, "semantic_category", "semantic_score", "archetype_matches", F.coalesce("core_paragraph_idx", F.lit(0)).alias("core_paragraph_idx"), F.col("embedding").alias("doc_embedding"), "embedding", F.col("embedding").isNotNull().alias("sbert_encoded"),
    )


def encode(payload: DataFrame, centroids: DataFrame, *, key: str = "article_id", encoder: Hook | None = None, dim: int = 384) -> DataFrame:
    """(key, semantic_category, semantic_score, archetype_matches, core_paragraph_idx, doc_embedding, embedding, sbert_encoded).

    ``encoder`` takes a frame with ``text`` and gives unit vectors; hashed words where there is none. ``centroids``: category,
    pos, centroid. A text without a vector is not encoded and of no category.
    """
    return with_core(encode_documents(payload, centroids, key=key, encoder=encoder, dim=dim), payload, key=key, encoder=encoder, dim=dim)


def document_text(title: Column, body: Column, most: int = 300) -> Column:
    """What topics read: the title and the beginning of the body, in lower case."""
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, most)))


def model_topics(articles: DataFrame, *, key: str = "article_id", vector: str = "doc_embedding", least: int = 3, rounds: int = 30) -> DataFrame | None:
    """(key, topic_id) by k-means, or None where fewer than twice ``least`` articles have a vector."""
    own = articles.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, vector)
    n = own.count()
    return None if n < 2 * least else P.spherical_kmeans(own, P.topic_count(n), rounds=rounds, key=key, vector=vector)


def topic_rollup(articles: DataFrame, assigned: DataFrame, *, key: str = "article_id", level: str = "impact_level", score: str = "relevance_score") -> DataFrame:
    """(topic_id, articles, impact_level, risk_score): count, highest level and best score of each topic; outliers (-1) have no row."""
    own = articles.select(key, level, score).join(assigned, key).where(F.col("topic_id") >= 0)
    return own.groupBy("topic_id").agg(F.count("*").alias("articles"), F.max_by(F.upper(level), level_rank(F.col(level))).alias("impact_level"), F.coalesce(F.max(score), F.lit(0)).cast("bigint").alias("risk_score"))


def attach_topics(members: DataFrame, assigned: DataFrame | None, names: DataFrame | None, *, key: str = "article_id", by: str = "cluster_id") -> DataFrame:
    """(by, topic_id, topic_label) of each cluster by the votes of its members (by, key, pos).

    Without topics all are -1, Uncategorised; a topic without a label is General News. ``names``: topic_id, label.
    """
    if assigned is None:
        return members.select(by).distinct().select(by, F.lit(-1).alias("topic_id"), F.lit("Uncategorised").alias("topic_label"))
    from .risk import plurality

    votes = members.join(assigned, key, "left").select(by, "pos", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"))
    won = plurality(votes, by=by)
    return won.join(F.broadcast(names), "topic_id", "left").select(by, "topic_id", F.coalesce(F.nullif("label", F.lit("")), F.lit("General News")).alias("topic_label"))


def brief_sentences(text: Column, least: int = 40, most: int = 300) -> Column:
    """Sentences long enough for a brief, long ones cut at a word."""
    return F.transform(F.filter(T.split_sentences(text), lambda s: F.length(F.trim(s)) >= least), lambda s: T.clean_sentence(s, most))


def distinct_sentences(rows: DataFrame, *, by: str, pos: str, text: str, n: int = 6) -> DataFrame:
    """(by, rank, text): the first ``n`` sentences that differ in their first 80 letters, where there are no vectors to choose by."""
    firsts = rows.where(F.col(text).isNotNull()).groupBy(by, F.substring(F.lower(text), 1, 80).alias("_k")).agg(F.min(pos).alias("_p"), F.min_by(text, pos).alias("text"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("_p"))).where(F.col("rank") <= n).select(by, F.col("rank").cast("int").alias("rank"), "text")


def fallback_briefs(clusters: DataFrame, *, by: str = "cluster_id") -> DataFrame:
    """``clusters`` (by, is_noise, article_count, headline, summary, linked_nodes, mmr_sentences) with their briefs.

    Noise and clusters of fewer than two articles have no chosen sentences. What happened are the first three of them, or else the summary.
    """
    chosen = F.when(F.coalesce("is_noise", F.lit(False)) | (F.col("article_count") < 2), F.array().cast("array<string>")).otherwise(F.coalesce("mmr_sentences", F.array().cast("array<string>")))
    own = clusters.withColumn("mmr_sentences", chosen)
    told = F.when(F.size("mmr_sentences") > 0, F.array_join(F.slice("mmr_sentences", 1, 3), "  ")).otherwise(F.coalesce("summary", F.lit("")))
    names = F.transform(F.coalesce("linked_nodes", F.array().cast("array<string>")), lambda n: F.element_at(F.split(n, ":", 2), -1))
    brief = F.struct(F.coalesce("headline", F.lit("")).alias("headline"), told.alias("what_happened"), names.alias("affected_nodes"), F.lit("").alias("outlook"), F.lit("fallback").alias("source"), F.lit(None).cast("string").alias("model"), F.size("mmr_sentences").alias("mmr_sentence_count"))
    return own.withColumn("brief", brief)


REPLY = "headline string, what_happened string, affected_nodes array<string>, outlook string"


def attach_briefs(clusters: DataFrame, *, by: str = "cluster_id", brief_fn: Hook | None = None, model: str = "hook") -> DataFrame:
    """Briefs by ``brief_fn`` (a frame with headline, mmr_sentences and linked_nodes to replies holding JSON) for real clusters of two articles or more.

    Where it is not given, fails or replies with no object, the fall-back brief stays.
    """
    own = fallback_briefs(clusters, by=by)
    if brief_fn is None:
        return own

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            said = []
            for i in range(len(part)):
                try:
                    said.append(list(brief_fn(part.iloc[i : i + 1]))[0])
                except Exception:
                    said.append(None)
            yield pd.DataFrame({by: part[by], "_reply": said})

    kind = dict(clusters.dtypes)[by]
    asked = own.where(~F.coalesce("is_noise", F.lit(False)) & (F.col("article_count") >= 2)).select(by, "headline", "mmr_sentences", "linked_nodes")
    replies = asked.mapInPandas(ask, f"{by} {kind}, _reply string").select(by, T.parse_reply(F.col("_reply"), REPLY).alias("_r"))
    joined = own.join(replies, by, "left")
    made = F.struct(
        F.col("_r.headline").alias("headline"), F.coalesce("_r.what_happened", F.lit("")).alias("what_happened"), F.coalesce("_r.affected_nodes", F.array().cast("array<string>")).alias("affected_nodes"), F.coalesce("_r.outlook", F.lit("")).alias("outlook"),
        F.lit("llm").alias("source"), F.lit(model).alias("model"), F.size("mmr_sentences").alias("mmr_sentence_count"),
    )
    return joined.withColumn("brief", F.when(F.col("_r.headline").isNotNull(), made).otherwise(F.col("brief"))).drop("_r")


def attach_summaries(articles: DataFrame, summaries: DataFrame, *, key: str, title: str = "clean_title") -> DataFrame:
    """``articles`` with ``lexrank_summary``; without one the title stands in, and the article's own summary stays as it is."""
    return articles.drop("lexrank_summary").join(summaries.select(key, F.col("summary").alias("lexrank_summary")), key, "left").withColumn("lexrank_summary", F.coalesce(F.nullif("lexrank_summary", F.lit("")), F.col(title), F.lit("")))


def order_clusters(clusters: DataFrame) -> DataFrame:
    """Real clusters first, then the larger ones; ties by id."""
    return clusters.orderBy(F.col("is_noise").cast("int"), F.col("cluster_size").desc(), "cluster_id")


SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def order_by_severity(scored: DataFrame) -> DataFrame:
    """The gravest first, then the highest composite; ties by id."""
    rank = F.lit(4)
    for name, r in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, r).otherwise(rank)
    return scored.orderBy(rank, F.col("composite").desc(), "cluster_id")


def overlaps(a: Column, b: list[str]) -> Column:
    """Whether an array of names holds any of ``b``, whatever the case; no filter lets all pass."""
    return F.arrays_overlap(F.transform(a, lambda x: F.lower(x)), F.array(*[F.lit(x.lower()) for x in b])) if b else F.lit(True)


def filter_clusters(clusters: DataFrame, *, severities: list[str] | None = None, domains: list[str] | None = None, countries: list[str] | None = None) -> DataFrame:
    """Clusters (severity, impact_level, disruption_domains, affected_nodes, linked_nodes) that pass every filter given.

    The severity falls back to the impact level, the domains to the affected nodes; countries are looked up among ``country:`` nodes.
    """
    out = clusters
    if severities:
        out = out.where(F.upper(F.coalesce("severity", "impact_level")).isin([s.upper() for s in severities]))
    if domains:
        own = F.when(F.size(F.coalesce("disruption_domains", F.array().cast("array<string>"))) > 0, F.col("disruption_domains")).otherwise(F.coalesce("affected_nodes", F.array().cast("array<string>")))
        out = out.where(overlaps(own, domains))
    if countries:
        out = out.where(overlaps(F.coalesce("linked_nodes", F.array().cast("array<string>")), [f"country:{c}" for c in countries]))
    return out


def with_aliases(articles: DataFrame) -> DataFrame:
    """``articles`` with published_at, description and source_type for readers of the older names, and defaults for what is missing."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return articles.withColumns({"published_at": text("published"), "description": text("summary"), "source_type": F.coalesce("category", F.lit("unknown")), "trust_score": F.coalesce("trust_score", F.lit(0.5))})


def without_records(exposure: DataFrame) -> DataFrame:
    """An exposure row without the three maps of whole dimension records."""
    return exposure.drop("material_records", "port_records", "route_records")
