"""The k most similar vectors of every vector.

A two-level k-means tree is fitted on a bounded sample; every vector is stored with the leaf it belongs
to, one file per leaf block in the shared folder. Each vector then descends the tree best bin first
through a priority queue and visits as many leaves as a calibration against exact search showed to
be needed for the wanted recall. Similarities of the best candidates are recomputed in double precision.

Defined results: rows with null, empty, all-zero or non-finite vectors, or null ids, take no part; of vectors of
one direction (to six decimals) beyond the k + 1 smallest ids, each has the neighbours of those kept (ties go to the smaller
id, so these are the same); vectors of another length than the most usual take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workspace

SPARE = 16  # candidates by single precision that are compared again in double precision, at first
CLOSE = 4e-6  # more than rounding to six decimals and errors of single precision can make up together


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _nearest(x: np.ndarray, c: np.ndarray, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``c`` for each row and its similarity, some rows at a time."""
    own, fit = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.float32)
    for i in range(0, len(x), rows):
        score = x[i : i + rows] @ c.T
        own[i : i + rows] = score.argmax(axis=1)
        fit[i : i + rows] = score.max(axis=1)
    return own, fit


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; empty clusters take the rows that fit worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, fit = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, own, x)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            new[empty] = x[fit.argsort()[: len(empty)]]
        c = _unit(new)
    return c.astype(np.float32)


class Tree:
    """Centroids of branches and of their leaves."""

    def __init__(self, branches: np.ndarray, leaves: np.ndarray, parent: np.ndarray):
        self.branches, self.leaves, self.parent = branches, leaves, parent
        self.children = [np.flatnonzero(parent == b).tolist() for b in range(len(branches))]

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int, rounds: int = 8) -> "Tree":
        """Branches first, then each branch's share of the leaves; ``x`` holds unit rows."""
        leaves = max(1, min(leaves, len(x)))
        k = max(1, min(int(round(leaves**0.5)), len(x)))
        branches = _kmeans(x, k, rounds, 1)
        own = _nearest(x, branches)[0]
        parts, parent = [], []
        for b in range(k):
            rows = x[own == b]
            if len(rows):
                n = max(1, min(len(rows), round(leaves * len(rows) / len(x))))
                parts.append(_kmeans(rows, n, rounds, 2 + b))
                parent += [b] * n
        return cls(branches, np.concatenate(parts), np.array(parent))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.leaves)[0]

    def visits(self, x: np.ndarray, most: int) -> list[list[int]]:
        """For each row the first ``most`` leaves, best bin first."""
        to_branch, to_leaf = (x @ self.branches.T).tolist(), x @ self.leaves.T
        out = []
        for scores, leaf_scores in zip(to_branch, to_leaf):
            # A branch is opened before any leaf that scores less than its centroid does.
            queue = [(-s, 0, b) for b, s in enumerate(scores)]
            heapq.heapify(queue)
            order: list[int] = []
            while queue and len(order) < most:
                _, kind, at = heapq.heappop(queue)
                if kind:
                    order.append(at)
                else:
                    for leaf in self.children[at]:
                        heapq.heappush(queue, (-float(leaf_scores[leaf]), 1, leaf))
            out.append(order)
        return out


class LeafStore:
    """Leaf blocks as files in the shared folder: ids and raw vectors."""

    def __init__(self, uri: str):
        self.uri = uri

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def write(self, leaf: int, block: int, ids: np.ndarray, x: np.ndarray, attempt: str) -> None:
        files, at = self._open()
        files.create_dir(at, recursive=True)
        buffer = io.BytesIO()
        np.save(buffer, ids)
        np.save(buffer, x)
        name = f"{at}/{leaf}-{block}"
        with files.open_output_stream(f"{name}.{attempt}") as f:
            f.write(buffer.getvalue())
        try:
            files.move(f"{name}.{attempt}", f"{name}.npy")  # a task that runs again brings the same file
        except OSError:
            if files.get_file_info(f"{name}.npy").type != pafs.FileType.File:
                raise
            files.delete_file(f"{name}.{attempt}")

    def read(self, leaf: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        files, at = self._open()
        with files.open_input_stream(f"{at}/{leaf}-{block}.npy") as f:
            buffer = io.BytesIO(f.read())
        return np.load(buffer), np.load(buffer)


def _double(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A hash of each vector's direction to six decimals: copies are vectors of one direction, whatever their length."""
    for p in batches:
        # Adding zero makes both zeros one.
        ways = [np.round(v / np.linalg.norm(v), 6) + 0.0 for v in (np.asarray(x, dtype=np.float64) for x in p["v"])]
        mark = np.frombuffer(b"".join(hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in ways), dtype=np.int64).reshape(-1, 2)
        yield pd.DataFrame({"id": p["id"].to_numpy(), "h": mark[:, 0], "g": mark[:, 1]})


def _directed(vectors: DataFrame, k: int, recall: float, sample: int, leaf_rows: int, most_leaves: int, probes: int) -> DataFrame:
    """(id, other) for the k nearest of each row of ``vectors`` (id, v)."""
    spark = vectors.sparkSession
    schema = "id bigint, other bigint"
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]["d"], sizes[0]["count"]
    vectors = vectors.where(F.size("v") == dim)
    share = min(1.0, sample / n)
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    taken = vectors.where(part < int(share * (1 << 40) + 0.5)).toArrow().combine_chunks().sort_by("id")
    x = _unit(taken["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32))
    ids_taken = taken["id"].to_numpy()
    tree = Tree.fit(x, max(1, min(most_leaves, n // leaf_rows, max(1, len(x) // 4))))
    del taken
    per_leaf = np.bincount(tree.leaf_of(x), minlength=len(tree.leaves)) * (n / len(x))
    blocks = np.maximum(1, np.ceil(per_leaf / (8 * leaf_rows))).astype(int)  # a hot leaf is split into blocks
    # Probes are rows the tree was not fitted on, as leaves of few sample rows lie closer to those than to all others; only a sample of all rows holds its own probes.
    rng = np.random.default_rng(5)
    if share < 1:
        low, high = (int(s * (1 << 40) + 0.5) for s in (share, min(1.0, share + 2 * probes / n)))
        apart = vectors.where((part >= low) & (part < high)).toArrow().combine_chunks().sort_by("id")
        pool, pool_ids = _unit(apart["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)), apart["id"].to_numpy()
    if share == 1 or not len(pool):
        pool, pool_ids = x, ids_taken
    chosen = rng.choice(len(pool), min(probes, len(pool)), replace=False)
    queries, query_ids = pool[chosen], pool_ids[chosen]
    del pool
    del x
    store = LeafStore(workspace(spark, "leaves"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                raw = np.stack(p["v"].to_numpy()).astype(np.float32)
                leaf = tree.leaf_of(_unit(raw))
                ids = p["id"].to_numpy()
                block = ((ids * 2654435761) >> 8) % blocks[leaf]
                yield pd.DataFrame({"leaf": leaf.astype(np.int32), "block": block.astype(np.int32), "id": ids, "v": [r.tobytes() for r in raw]})

    def keep(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        import uuid

        order = np.argsort(p["id"].to_numpy(), kind="stable")
        raw = np.frombuffer(b"".join(p["v"].to_numpy()[order]), dtype=np.float32).reshape(len(p), dim)
        store.write(int(key[0]), int(key[1]), p["id"].to_numpy()[order], raw, uuid.uuid4().hex)
        return pd.DataFrame({"leaf": [key[0]], "block": [key[1]], "n": [len(p)]})

    placed = vectors.mapInPandas(place, "leaf int, block int, id bigint, v binary")
    listing = placed.groupBy("leaf", "block").applyInPandas(keep, "leaf int, block int, n int").collect()  # one row per block: bounded by the tree
    there: dict[int, list[int]] = {}
    for r in listing:
        there.setdefault(r["leaf"], []).append(r["block"])
    tasks = sorted((r["leaf"], r["block"]) for r in listing)
    # Neighbouring leaves go to the same task, as they visit the same files; large blocks are spread.
    slices = max(1, min(len(tasks), max(spark.sparkContext.defaultParallelism * 3, len(tasks) // 16)))
    work = spark.createDataFrame([(i * slices // len(tasks), leaf, block) for i, (leaf, block) in enumerate(tasks)], "slice int, leaf int, block int").repartitionByRange(slices, "slice")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_s = np.full((len(queries), k), -9.0, dtype=np.float32)
        best_leaf = np.full((len(queries), k), -1, dtype=np.int64)
        for p in batches:
            for leaf, block in zip(p["leaf"], p["block"]):
                ids, raw = store.read(leaf, block)
                score = queries @ _unit(raw).T
                score[query_ids[:, None] == ids[None, :]] = -9  # a probe is no neighbour of its own
                s = np.concatenate([best_s, score], axis=1)
                at = np.concatenate([best_leaf, np.where(score > -8, leaf, -1)], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best_s, best_leaf = np.take_along_axis(s, top, axis=1), np.take_along_axis(at, top, axis=1)
        found = best_leaf >= 0
        yield pd.DataFrame({"q": np.nonzero(found)[0], "leaf": best_leaf[found], "s": best_s[found].astype(np.float64)})

    hits = work.mapInPandas(exact, "q int, leaf int, s double").toPandas()  # probes * k rows a slice
    hits = hits.sort_values(["q", "s"], ascending=[True, False]).groupby("q").head(k)
    ranks = {q: {leaf: i for i, leaf in enumerate(v)} for q, v in enumerate(tree.visits(queries, len(tree.leaves)))}
    needed = np.sort([ranks[q][leaf] for q, leaf in zip(hits["q"], hits["leaf"])])
    sure = recall + 2 * (recall * (1 - recall) / max(1, len(needed))) ** 0.5  # by two standard errors, as the probes are few
    visits = int(needed[min(len(needed) - 1, int(np.ceil(sure * len(needed))))]) + 1 if len(needed) else 1

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        held = 0

        def load(leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal held
            if leaf not in cache:
                parts = [store.read(leaf, b) for b in there.get(leaf, [])]
                ids = np.concatenate([a for a, _ in parts]) if parts else np.zeros(0, np.int64)
                raw = np.concatenate([b for _, b in parts]) if parts else np.zeros((0, dim), np.float32)
                while cache and held + raw.nbytes > 96e6:
                    held -= cache.pop(next(iter(cache)))[1].nbytes
                cache[leaf] = (ids, _unit(raw), raw)
                held += raw.nbytes
            return cache[leaf]

        for p in batches:
            for leaf, block in zip(p["leaf"], p["block"]):
                own_ids, own_raw = store.read(leaf, block)
                for start in range(0, len(own_ids), 2048):
                    ids, raw = own_ids[start : start + 2048], own_raw[start : start + 2048]
                    unit = _unit(raw)
                    by_leaf: dict[int, list[int]] = {}
                    for i, order in enumerate(tree.visits(unit, visits)):
                        for at in order:
                            by_leaf.setdefault(at, []).append(i)
                    spare = SPARE
                    while True:
                        best_s = np.full((len(ids), spare), -9.0, dtype=np.float32)
                        best_i = np.full((len(ids), spare), -1, dtype=np.int64)
                        best_at = np.zeros((len(ids), spare), dtype=np.int64)  # leaf and place in it
                        for at, rows in by_leaf.items():
                            other_ids, other, _ = load(at)
                            for low in range(0, len(other_ids), 8192):
                                part_ids = other_ids[low : low + 8192]
                                score = unit[rows] @ other[low : low + 8192].T
                                score[ids[rows][:, None] == part_ids[None, :]] = -9
                                m = min(spare, score.shape[1])
                                top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                                s = np.concatenate([best_s[rows], np.take_along_axis(score, top, axis=1)], axis=1)
                                i = np.concatenate([best_i[rows], part_ids[top]], axis=1)
                                w = np.concatenate([best_at[rows], (at << 40) + low + top], axis=1)
                                pick = np.argpartition(-s, spare - 1, axis=1)[:, :spare]
                                best_s[rows] = np.take_along_axis(s, pick, axis=1)
                                best_i[rows] = np.take_along_axis(i, pick, axis=1)
                                best_at[rows] = np.take_along_axis(w, pick, axis=1)
                        # Candidates that single precision cannot tell from the k-th must all be kept: where they may be more, again with more room.
                        ordered = -np.sort(-best_s, axis=1)
                        if not ((ordered[:, -1] > -8) & (ordered[:, min(k, spare) - 1] - ordered[:, -1] <= CLOSE)).any():
                            break
                        spare *= 4
                    own_exact = _double(raw)
                    sims = np.full((len(ids), spare), -9.0)
                    known = best_s > -8
                    for at in np.unique(best_at[known] >> 40):
                        r, c = np.nonzero(known & (best_at >> 40 == at))
                        other_raw = load(int(at))[2]
                        sims[r, c] = np.einsum("ij,ij->i", _double(other_raw[best_at[r, c] & ((1 << 40) - 1)]), own_exact[r])
                    rank = np.lexsort((best_i, -np.round(sims, 6)), axis=1)[:, :k]
                    kept = np.take_along_axis(known, rank, axis=1)
                    out_a = np.repeat(ids, rank.shape[1])[kept.ravel()]
                    out_b = np.take_along_axis(best_i, rank, axis=1)[kept]
                    yield pd.DataFrame({"id": out_a, "other": out_b})

    return work.mapInPandas(search, schema)


def nearest(
    rows: DataFrame, *, key: str = "article_id", vector: str = "doc_embedding", k: int = 5, recall: float = 0.99, sample: int = 20_000, leaf_rows: int = 256, most_leaves: int = 4096, probes: int = 256
) -> DataFrame:
    """(id, other): the ``k`` rows most similar to each row by cosine, rounded to six decimals, ties to the smaller id.

    ``sample``: rows the tree is fitted on, by a hash of the id. ``recall``: share of the true neighbours of
    ``probes`` rows outside the sample that the visited leaves must hold beyond chance, measured against exact search over all rows.
    """
    own = rows.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    marks = own.mapInPandas(_marks, "id bigint, h bigint, g bigint")
    # Only the k + 1 smallest ids of a vector's copies are searched; hot vectors are counted first, on hashes alone.
    hot = marks.groupBy("h", "g").count().where(F.col("count") > k + 1)
    spare = hot.agg(F.sum("count").alias("n")).first()["n"] or 0
    if not spare:
        return _directed(own, k, recall, sample, leaf_rows, most_leaves, probes)
    from pyspark.sql import Window

    held = marks.join(hot.select("h", "g"), ["h", "g"])
    salted = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("h", "g", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("r") <= k + 1)
    last = first.groupBy("h", "g").agg(F.max("id").alias("stand_in"))
    rest = held.join(first.select("id"), "id", "left_anti").join(last, ["h", "g"]).select("id", "stand_in")
    from ..session import materialize

    rest = materialize(rest, "copies")
    drop = rest.select("id")
    drop = F.broadcast(drop) if spare <= 200_000 else drop
    found = materialize(_directed(own.join(drop, "id", "left_anti"), k, recall, sample, leaf_rows, most_leaves, probes), "neighbours")
    lists = found.join(last.select("stand_in"), found["id"] == F.col("stand_in"), "left_semi").withColumnRenamed("id", "stand_in")
    return found.unionByName(rest.join(lists, "stand_in").select("id", "other"))


def nearest_pairs(rows: DataFrame, **options: object) -> DataFrame:
    """(a, b), a < b: the pairs of which at least one is among the k nearest of the other."""
    got = nearest(rows, **options)
    return got.select(F.least("id", "other").alias("article_id_a"), F.greatest("id", "other").alias("article_id_b")).distinct()
