"""Topics: k-means on the sphere with fixed seeds, keywords within a topic, votes of clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import STOP_WORDS
from ..session import materialize
from .vectors import normalise


def topic_count(n: int) -> int:
    return min(8, max(1, n // 3))


def spherical_kmeans(vectors: DataFrame, k: int, *, rounds: int = 30, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, topic_id): seeds are the rows of the ``k`` smallest keys, then assigning and averaging until no row moves, or ``rounds``.

    The k centroids go to where the rows lie and sums of each topic come back; a tie goes to the smaller topic, a topic
    without rows keeps its centroid.
    """
    own = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, normalise(F.col(vector)).alias("v"))
    own = materialize(own, "unit")
    seeds = own.orderBy(key).limit(k).collect()  # k rows
    kind = dict(own.dtypes)[key]
    if not seeds:
        return own.select(key, F.lit(0).alias("topic_id"))
    centroids, before = np.array([r["v"] for r in seeds]), None

    def assign(part: pd.DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        return x, np.round(x @ c.T, 9).argmax(axis=1)

    for _ in range(rounds):

        def partial(batches: Iterator[pd.DataFrame], c: np.ndarray = centroids) -> Iterator[pd.DataFrame]:
            total, n, mark = np.zeros_like(c), np.zeros(len(c), dtype=np.int64), 0
            for part in batches:
                if len(part):
                    x, at = assign(part, c)
                    np.add.at(total, at, x)
                    n += np.bincount(at, minlength=len(c))
                    # The sum of hashes tells whether any row has moved since the round before.
                    mark += int((pd.util.hash_array(part[key].to_numpy()) * (at.astype(np.uint64) * np.uint64(2) + np.uint64(1))).astype(np.uint64).sum() >> np.uint64(16))
            yield pd.DataFrame({"topic_id": np.arange(len(c), dtype=np.int32), "n": n, "mark": np.where(np.arange(len(c)) == 0, mark % (1 << 40), 0), "total": list(total)})

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"topic_id": part["topic_id"].iloc[:1], "n": [part["n"].sum()], "mark": [part["mark"].sum()], "total": [np.stack(part["total"].to_numpy()).sum(axis=0)]})

        schema = "topic_id int, n bigint, mark bigint, total array<double>"
        got = own.mapInPandas(partial, schema).groupBy("topic_id").applyInPandas(add, schema).toPandas().sort_values("topic_id")  # k rows
        mark = int(got["mark"].sum())
        if mark == before:
            break
        before = mark
        mean = np.stack(got["total"].to_numpy())
        full = got["n"].to_numpy() > 0
        centroids = np.where(full[:, None], mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-30), centroids)

    def final(batches: Iterator[pd.DataFrame], c: np.ndarray = centroids) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield pd.DataFrame({key: part[key], "topic_id": assign(part, c)[1].astype(np.int32)})

    return own.mapInPandas(final, f"`{key}` {kind}, topic_id int")


def keywords(rows: DataFrame, *, by: str, doc: str, tokens: str, n: int = 5) -> DataFrame:
    """(by, rank, term, score): tf * ln(docs / df) within the group; stop words are none, ties go by the term."""
    terms = rows.select(by, doc, F.explode(tokens).alias("term")).where(~F.col("term").isin(STOP_WORDS))
    g = terms.groupBy(by, "term").agg(F.count("*").alias("tf"), F.count_distinct(doc).alias("df"))
    docs = rows.groupBy(by).agg(F.count_distinct(doc).alias("docs"))
    scored = g.join(docs, by).withColumn("score", F.round(F.col("tf") * F.ln(F.col("docs") / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select(by, "rank", "term", "score")


def labels(words: DataFrame, *, by: str) -> DataFrame:
    """(by, label): the first three keywords in title case."""
    top = words.where(F.col("rank") <= 3).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w"))
    return top.select(by, F.initcap(F.array_join(F.transform("w", lambda x: x["term"]), " ")).alias("label"))
