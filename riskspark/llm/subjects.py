"""Subject areas of articles.

Articles are embedded by weighted terms and a truncated singular value decomposition, so that terms which
occur in the same articles share a direction; sentences are placed in the same space. Centroids of the
areas start from the area descriptions and hand-made labels and are refined over several rounds; a
sentence belongs to the area whose centroid is nearest by cosine; an article is about each area that
holds its share of sentences.

Document frequencies and the decomposition cover all articles: each round of subspace iteration is one
pass that sums a fixed-size matrix. Only the centroids are fitted on a bounded sample of labelled
articles (``max_labelled``). Term identity is hashed into ``DIM`` slots, so what is sent to the
executors and gathered from them has a fixed size.

Defined results: null and empty bodies have no row; an article of site lines alone is ``general``;
redelivered rows are one article; labels in any case, wrong or missing ones are tolerated, as the
refinement lets a labelled article's sentences choose among its labels and ``general``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .lines import own_lines

DIM = 8192
GENERAL = "general"
_SPLIT = re.compile(r"(?<=[.!?…])[\"”’)]*\s+(?=[\"“(]?[^\W\d_a-z]|[\"“(]?\d)")
_WORD = re.compile(r"[^\W\d_](?:[\w'’-]*\w)?|\d[\d.,]*")
# Lines that close an article without being sentences: labelled notes, dashes with a name, brackets, counts.
_NOTE = re.compile(r"\s*(?:[-–—*•]\s|[(\[]|[^\W\d_][\w ]{2,40}:\s)")


def sentences(line: str) -> list[str]:
    """The sentences of a line; a note that is no sentence gives none."""
    text = " ".join(line.split())
    if not text or (_NOTE.match(text) and not re.search(r"[.!?]\s+\S", text) and len(text) < 160):
        return []
    return [s for s in _SPLIT.split(text) if s]


def terms(sentence: str) -> list[str]:
    """Words and neighbouring pairs, without names and numbers: names tell no subject."""
    words = _WORD.findall(sentence)
    plain: list[str | None] = []
    for i, w in enumerate(words):
        upper = w[0].isupper()
        acronym = upper and len(w) > 1 and w.isupper() and not sentence.isupper()
        begins = i == 0 and not (len(words) > 1 and words[1][0].isupper() and not words[1].isupper())
        if w[0].isdigit() or (upper and not acronym and not begins and not sentence.isupper()):
            plain.append(None)
        else:
            plain.append(w.lower())
    out = [w for w in plain if w]
    out += [f"{a}_{b}" for a, b in zip(plain, plain[1:]) if a and b]
    return list(dict.fromkeys(out))


_CODES: dict[str, int] = {}


def codes(sentence: str) -> np.ndarray:
    """Slots of a sentence's terms; the hash is the same on all machines."""
    out = []
    for t in terms(sentence):
        c = _CODES.get(t)
        if c is None:
            if len(_CODES) > 200_000:
                _CODES.clear()
            c = _CODES[t] = zlib.crc32(t.encode()) % DIM
        out.append(c)
    return np.unique(np.array(out, dtype=np.int64))


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Articles to the slots of their own sentences: one flat list and the length of each sentence."""
    for part in batches:
        flat, lengths = [], []
        for lines, site in zip(part["lines"], part["site"]):
            skip = set(site)
            own = [codes(s) for i, line in enumerate(lines, 1) if i not in skip for s in sentences(line)]
            flat.append(np.concatenate(own).astype(np.int32) if own else np.zeros(0, np.int32))
            lengths.append(np.array([len(c) for c in own], dtype=np.int32))
        yield pd.DataFrame({"article_id": part["article_id"], "slots": flat, "lengths": lengths})


def _document_frequency(coded: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for part in batches:
            for slots in part["slots"]:
                df[np.unique(slots)] += 1
                n += len(slots) > 0
        at = np.flatnonzero(df)
        yield pd.DataFrame({"slot": np.append(at, -1), "n": np.append(df[at], n)})

    rows = coded.select("slots").mapInPandas(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(DIM), 1
    for r in rows:  # at most DIM + 1 rows
        if r["slot"] < 0:
            total = max(1, r["n"])
        else:
            df[r["slot"]] = r["n"]
    return df, total


def _decompose(coded: DataFrame, idf: np.ndarray, rank: int, rounds: int) -> np.ndarray:
    """Right singular vectors of the article-term matrix by subspace iteration, one pass a round."""
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((DIM, rank)))[0]
    for _ in range(rounds):
        at = (idf[:, None] * q).astype(np.float32)
        weight = idf.astype(np.float32)

        def step(batches: Iterator[pd.DataFrame], at: np.ndarray = at, weight: np.ndarray = weight) -> Iterator[pd.DataFrame]:
            new = np.zeros((DIM, rank))
            for part in batches:
                for slots in part["slots"]:
                    if len(slots):
                        own, n = np.unique(slots, return_counts=True)
                        size = float(((weight[own] * n) ** 2).sum())
                        if size:
                            left = n @ at[own]
                            new[own] += (weight[own] * n / size)[:, None] * left
            used = np.flatnonzero(np.abs(new).sum(axis=1))
            yield pd.DataFrame({"slot": used} | {f"v{j}": new[used, j] for j in range(rank)})

        names = [f"v{j}" for j in range(rank)]
        sums = coded.select("slots").mapInPandas(step, "slot int, " + ", ".join(f"{n} double" for n in names)).groupBy("slot").agg(*[F.sum(n).alias(n) for n in names])
        got = sums.toPandas()  # at most DIM rows of ``rank`` numbers
        new = np.zeros((DIM, rank))
        new[got["slot"].to_numpy()] = got[names].to_numpy()
        q = np.linalg.qr(new)[0]
    return q


class SubjectModel:
    """The map from terms to the space, and the centroids of the areas."""

    def __init__(self, areas: list[str], term_map: np.ndarray):
        self.areas, self.map = areas, term_map.astype(np.float32)
        self.general = areas.index(GENERAL)
        self.centroids = np.zeros((len(areas), self.map.shape[1]), dtype=np.float32)
        self.floor = 0.0

    def vectors(self, slots: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One vector per sentence."""
        out = np.zeros((len(lengths), self.map.shape[1]), dtype=np.float32)
        np.add.at(out, np.repeat(np.arange(len(lengths)), lengths), self.map[slots])
        return out

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Index of the nearest area by cosine; sentences of little evidence lean to ``general``."""
        leaning = vectors + self.floor * self.centroids[self.general]
        got = (leaning @ self.centroids.T).argmax(axis=1)
        got[np.abs(vectors).sum(axis=1) < 1e-9] = self.general
        return got

    def fit(self, vectors: np.ndarray, article: np.ndarray, labels: list[set[str]], described: dict[str, np.ndarray], rounds: int = 12) -> "SubjectModel":
        """Seeds from labels and descriptions, then rounds of choosing and averaging."""
        k = len(self.areas)
        may = np.array([[a in own for a in self.areas] for own in labels], dtype=bool).reshape(-1, k)
        soft = (may / np.maximum(1, may.sum(axis=1, keepdims=True)))[article]
        may[:, self.general] = True
        norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        unit = vectors / norm
        seed = [described[a] if a in described else np.zeros(vectors.shape[1]) for a in self.areas]
        seed = np.array([s / max(np.linalg.norm(s), 1e-9) for s in seed])
        mean = unit.mean(axis=0) if len(unit) else np.zeros(vectors.shape[1])
        centroids = (soft.T @ unit) / np.maximum(soft.sum(axis=0), 1)[:, None]
        known = soft.sum(axis=0) > 0
        centroids = np.where(known[:, None], centroids - mean, 0.0) + seed * np.where(known, 0.01, 1)[:, None]
        at = unit - mean
        for _ in range(rounds):
            centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
            got = np.where(may[article], at @ centroids.T, -9).argmax(axis=1) if len(unit) else np.zeros(0, dtype=int)
            y = np.eye(k)[got]
            centroids = np.where(y.sum(axis=0)[:, None] > 0, y.T @ unit, seed)
            at = unit
        self.centroids = (centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.floor = 0.03 * float(np.median(norm)) if len(unit) else 0.0
        return self


def fit_subjects(coded: DataFrame, labels: DataFrame, areas: DataFrame, *, max_labelled: int = 4000, rounds: int = 4) -> SubjectModel:
    """Fit the space on all articles, the centroids on at most ``max_labelled`` labelled ones (by a hash of the id)."""
    described = {r["subject"].strip().lower(): (r["description"] or "").lower() for r in areas.where(F.col("subject").isNotNull()).collect()}
    names = sorted(set(described) | {GENERAL})
    df, total = _document_frequency(coded)
    idf = np.where(df >= 2, np.log((total + 1) / (df + 1)).clip(0), 0.0)
    # One direction per area and one for what all articles share: more would only hold single phrases.
    basis = _decompose(coded, idf, len(names), rounds)
    model = SubjectModel(names, idf[:, None] * basis)
    own = labels.where(F.col("subject").isNotNull() & F.col("article_id").isNotNull()).select("article_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(names))
    chosen = own.groupBy("article_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    sample = coded.join(chosen, "article_id").orderBy(F.xxhash64("article_id"), "article_id").limit(max_labelled).select("slots", "lengths", "subjects").toPandas()
    seeds = {a: model.map[codes(text)].sum(axis=0) for a, text in described.items() if a != GENERAL}
    vectors = [model.vectors(s, n) for s, n in zip(sample["slots"], sample["lengths"])]
    article = np.repeat(np.arange(len(sample)), [len(v) for v in vectors])
    stacked = np.concatenate(vectors) if vectors else np.zeros((0, len(names)), dtype=np.float32)
    return model.fit(stacked, article, [set(x) for x in sample["subjects"]], seeds)


def assign_subjects(articles: DataFrame, labels: DataFrame, areas: DataFrame, *, share: float = 0.3, max_labelled: int = 4000) -> DataFrame:
    """(article_id, subject) for each article with a non-empty body.

    Each area that holds at least ``share`` of the article's own sentences, or else ``general``.
    """
    coded = materialize(own_lines(articles).select("article_id", "lines", "site").mapInPandas(_coded, "article_id bigint, slots array<int>, lengths array<int>"), "subject-terms")
    model = fit_subjects(coded, labels, areas, max_labelled=max_labelled)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            ids, found = [], []
            for a, slots, lengths in zip(part["article_id"], part["slots"], part["lengths"]):
                got = np.bincount(model.assign(model.vectors(slots, lengths)), minlength=len(model.areas)) if len(lengths) else np.zeros(len(model.areas))
                enough = got >= share * max(1, got.sum())
                enough[model.general] = False
                own = [model.areas[i] for i in np.flatnonzero(enough)] or [GENERAL]
                ids += [a] * len(own)
                found += own
            yield pd.DataFrame({"article_id": ids, "subject": found})

    return coded.mapInPandas(decide, "article_id bigint, subject string")
