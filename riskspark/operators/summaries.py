"""Extractive summaries: term weights, LexRank, maximal marginal relevance, briefs.

Groups too large for one task: MMR goes in rounds over rows where they lie, LexRank in heats over all its rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def tfidf(rows: DataFrame, *, by: str, doc: str, tokens: str) -> DataFrame:
    """(by, doc, term, weight): unit vectors of tf * (ln((n + 1) / (df + 1)) + 1) within each group."""
    terms = rows.select(by, doc, F.explode(tokens).alias("term"))
    counts = terms.groupBy(by, doc, "term").agg(F.count("*").alias("c"))
    total = terms.groupBy(by, doc).agg(F.count("*").alias("t"))
    n = total.groupBy(by).agg(F.count("*").alias("n"))
    df = counts.groupBy(by, "term").agg(F.count("*").alias("df"))
    w = counts.join(total, [by, doc]).join(df, [by, "term"]).join(n, by).withColumn("w", F.col("c") / F.col("t") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    length = w.groupBy(by, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return w.join(length, [by, doc]).select(by, doc, "term", (F.col("w") / F.col("l")).alias("weight"))


def tfidf_pairs(weights: DataFrame, *, by: str, doc: str) -> DataFrame:
    """(by, a, b, sim), a < b: cosines of documents of one group that share a term."""
    a, b = weights.select(by, F.col(doc).alias("a"), "term", F.col("weight").alias("wa")), weights.select(by, F.col(doc).alias("b"), "term", F.col("weight").alias("wb"))
    return a.join(b, [by, "term"]).where(F.col("a") < F.col("b")).groupBy(by, "a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("sim"))


MANY = 500  # sentences from which single precision and lists of neighbours take the place of whole matrices


def _weights(texts: list[str]) -> np.ndarray:
    docs = [re.findall(r"[a-z]{3,}", t.lower()) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    m = np.zeros((len(docs), max(1, len(vocabulary))))
    for i, d in enumerate(docs):
        for w in d:
            m[i, vocabulary[w]] += 1 / len(d)
    df = (m > 0).sum(axis=0)
    m *= np.log((len(docs) + 1) / (df + 1)) + 1
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _many_cosines(texts: list[str]) -> np.ndarray:
    """Cosines of the ``_weights`` of many texts in single precision: terms of many texts by one product, each other term among its own texts alone."""
    docs = [re.findall(r"[a-z]{3,}", t.lower()) for t in texts]
    n, vocabulary = len(docs), {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    sims = np.zeros((n, n), dtype=np.float32)
    if not vocabulary:
        return sims
    size = np.array([len(d) for d in docs])
    row, term = np.repeat(np.arange(n), size), np.array([vocabulary[w] for d in docs for w in d])
    cell, tf = np.unique(row * len(vocabulary) + term, return_counts=True)
    row, term = cell // len(vocabulary), cell % len(vocabulary)
    df = np.bincount(term, minlength=len(vocabulary))
    w = tf / size[row] * (np.log((n + 1) / (df + 1)) + 1)[term]
    w = (w / np.sqrt(np.bincount(row, w * w, minlength=n))[row]).astype(np.float32)
    common = np.flatnonzero(df > max(8, n // 50))
    place = np.full(len(vocabulary), -1)
    place[common] = np.arange(len(common))
    wide = np.zeros((n, len(common)), dtype=np.float32)
    often = place[term] >= 0
    wide[row[often], place[term[often]]] = w[often]
    np.matmul(wide, wide.T, out=sims)
    rest = np.flatnonzero(~often)
    rest = rest[np.argsort(term[rest], kind="stable")]
    for own in np.split(rest, np.flatnonzero(np.diff(term[rest])) + 1) if len(rest) else ():
        if len(own) > 1:
            sims[np.ix_(row[own], row[own])] += np.outer(w[own], w[own])
    return sims


def lexrank_scores(vectors: np.ndarray, *, threshold: float = 0.1, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """Stationary weights over the graph of similar sentences."""
    n = len(vectors)
    sims = vectors @ vectors.T
    graph = (sims >= threshold).astype(float)
    np.fill_diagonal(graph, 0)
    degree = graph.sum(axis=1, keepdims=True)
    walk = np.divide(graph, degree, out=np.zeros_like(graph), where=degree > 0)
    score = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * walk.T @ score
        if np.abs(new - score).max() < tolerance:
            return new
        score = new
    return score


def _many_scores(sims: np.ndarray, *, threshold: float = 0.1, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """``lexrank_scores`` of given cosines, with the graph as lists of neighbours: the cosines are the only table of all pairs."""
    n = len(sims)
    np.fill_diagonal(sims, -1)
    degree, blocks = np.zeros(n, dtype=np.int64), []
    for i in range(0, n, 500):
        near = sims[i : i + 500] >= threshold
        degree[i : i + 500] = near.sum(axis=1)
        some = i + np.flatnonzero(degree[i : i + 500])
        if len(some):
            blocks.append((some, np.cumsum(degree[some]) - degree[some], np.nonzero(near)[1].astype(np.int32)))
    score = np.full(n, 1 / n)
    for _ in range(rounds):
        new, given = np.full(n, (1 - damping) / n), score / np.maximum(degree, 1)
        for some, starts, to in blocks:
            # Neighbourhood goes both ways, so what flows in is what the neighbours give.
            new[some] += damping * np.add.reduceat(given[to], starts)
        if np.abs(new - score).max() < tolerance:
            return new
        score = new
    return score


def _heats(rows: DataFrame, by: str, pos: str, most: int, pick: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows of groups of at most about ``most``: a larger group is dealt into blocks by a hash, and what ``pick``
    chooses of each block goes on, until each group is one block. No task holds a large group, and all rows take part.
    """
    while True:
        sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / (1.5 * most)).cast("int").alias("_b"))
        largest = sizes.agg(F.max("_b").alias("m")).first()["m"]
        if not largest or largest <= 1:
            return rows
        dealt = rows.join(sizes, by)
        small = dealt.where(F.col("_b") <= 1).drop("_b")
        large = dealt.where(F.col("_b") > 1).withColumn("_b", F.pmod(F.xxhash64(pos), F.col("_b")).cast("int"))
        won = large.groupBy(by, "_b").applyInPandas(lambda part: pick(part.drop(columns="_b")), rows.schema)
        rows = materialize(small.unionByName(won), "heats")


def lexrank(rows: DataFrame, *, by: str, pos: str, text: str, n: int, most: int = 4000) -> DataFrame:
    """(by, summary): the ``n`` most central sentences of a group in text order; one alone is itself.

    Centrality rests on all pairs of a group, so one task ranks a group of up to ``most`` sentences exactly. Larger groups
    are ranked in heats, of which the winners are ranked again: an approximation (README gives how far it agrees).
    """
    kind = dict(rows.dtypes)[by]

    def heat(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos, kind="stable")
        return part.iloc[chosen(part[text].tolist(), n)]

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos, kind="stable")
        return pd.DataFrame({by: [part[by].iloc[0]], "summary": [central(part[text].tolist(), n)]})

    own = _heats(rows.where(F.col(text).isNotNull()).select(by, pos, text), by, pos, most, heat)
    return own.groupBy(by).applyInPandas(rank, f"`{by}` {kind}, summary string")


def chosen(texts: list[str], n: int) -> list[int]:
    """Places of the ``n`` most central sentences in text order, ties to the earlier one."""
    if len(texts) <= n:
        return list(range(len(texts)))
    score = np.round(_many_scores(_many_cosines(texts)) if len(texts) > MANY else lexrank_scores(_weights(texts)), 9)
    return sorted(np.lexsort((np.arange(len(texts)), -score))[:n].tolist())


def central(texts: list[str], n: int) -> str:
    return "  ".join(texts[i] for i in chosen(texts, n))


def lexrank_documents(rows: DataFrame, *, key: str, sentences: str, n: int) -> DataFrame:
    """(key, summary) of documents whose sentences stand in one array: no exchange. Without sentences there is no row."""
    kind = dict(rows.dtypes)[key]

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({key: part[key], "summary": [central(list(s), n) for s in part[sentences]]})

    return rows.where(F.size(sentences) > 0).select(key, sentences).mapInPandas(rank, f"`{key}` {kind}, summary string")


def _marginal(v: np.ndarray, n: int, balance: float) -> list[int]:
    """Places chosen one by one for nearness to the centre and distance to those chosen."""
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    centre = v.mean(axis=0)
    gain, near = v @ (centre / max(np.linalg.norm(centre), 1e-12)), np.zeros(len(v))
    out: list[int] = []
    while len(out) < min(n, len(v)):
        score = np.round(balance * gain - (1 - balance) * near, 9)
        score[out] = -9
        best = int(score.argmax())
        out.append(best)
        near = np.maximum(near, v @ v[best]) if len(out) > 1 else v @ v[best]
    return out


def mmr(rows: DataFrame, *, by: str, pos: str, vector: str, n: int = 6, balance: float = 0.55, most: int = 2000) -> DataFrame:
    """(by, rank, pos): the rows of each group that are near its centre and far from one another, in order of choice.

    Groups of more than ``most`` rows are chosen from by ``n`` rounds over all their rows where these lie, with the same result.
    """
    own = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(by, pos, vector)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(pos, kind="stable")
        got = _marginal(np.stack(part[vector].to_numpy()).astype(float), n, balance)
        return pd.DataFrame({by: [part[by].iloc[0]] * len(got), "rank": np.arange(1, len(got) + 1, dtype=np.int32), "pos": part[pos].to_numpy()[got]})

    kinds = dict(rows.dtypes)
    schema = f"`{by}` {kinds[by]}, rank int, pos {kinds[pos]}"
    large = materialize(own.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(by), "large-groups")
    if not large.limit(1).count():
        return own.groupBy(by).applyInPandas(choose, schema)
    small = own.join(large, by, "left_anti").groupBy(by).applyInPandas(choose, schema)
    return small.unionByName(_mmr_rounds(own.join(large, by, "left_semi"), by, pos, vector, n, balance))


def _mmr_rounds(own: DataFrame, by: str, pos: str, vector: str, n: int, balance: float) -> DataFrame:
    from .vectors import dot, mean_vectors, normalise

    unit = own.select(by, F.col(pos).alias("pos"), normalise(F.col(vector)).alias("v"))
    centre = mean_vectors(unit, [by], vector="v").select(by, normalise(F.col("centroid")).alias("c"))
    state = materialize(unit.join(centre, by).select(by, "pos", "v", dot(F.col("v"), F.col("c")).alias("gain"), F.lit(None).cast("double").alias("near")), "mmr")
    picks = None
    for rank in range(1, n + 1):
        score = F.round(balance * F.col("gain") - (1 - balance) * F.coalesce("near", F.lit(0.0)), 9)
        open_ = state if picks is None else state.join(picks.select(by, "pos"), [by, "pos"], "left_anti")
        best = open_.groupBy(by).agg(F.min_by(F.struct("pos", "v"), F.struct((-score).alias("s"), F.col("pos"))).alias("b"))
        best = materialize(best.select(by, F.lit(rank).alias("rank"), "b.pos", F.col("b.v").alias("p")), "mmr-pick")
        picks = best.select(by, "rank", "pos") if picks is None else picks.unionByName(best.select(by, "rank", "pos"))
        if rank < n:
            sim = dot(F.col("v"), F.col("p"))
            state = materialize(state.join(best.select(by, "p"), by).select(by, "pos", "v", "gain", F.greatest(sim, "near").alias("near")), "mmr")
    return picks


def briefs(clusters: DataFrame, *, by: str = "cluster_id") -> DataFrame:
    """Headline, what happened and affected nodes of each cluster, from rows (by, pos, title, sentences array, nodes array) of its articles.

    What happened are the cluster's first three sentences in order of the rows, wherever they stand; nodes are named once.
    """
    lines = clusters.select(by, "pos", F.posexplode("sentences").alias("i", "s")).where(F.trim("s") != "")
    first = lines.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("pos", "i"))).where("r <= 3").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]), " ").alias("what_happened"))
    names = clusters.select(by, F.explode("nodes").alias("n")).select(by, F.element_at(F.split("n", ":", 2), -1).alias("n")).distinct().groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("n")), ", ").alias("affected"))
    heads = clusters.groupBy(by).agg(F.min_by("title", "pos").alias("headline"))
    return heads.join(first, by, "left").join(names, by, "left").select(by, "headline", F.coalesce("what_happened", F.lit("")).alias("what_happened"), F.coalesce("affected", F.lit("")).alias("affected"))
