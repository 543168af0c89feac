"""Vectors as arrays: dot products, exact similarity joins in blocks, search, archetypes, near-duplicate removal.

Vectors that are null or empty take no part. Sums are in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


MOST_PIVOTS, MOST_CENTROIDS = 256, 200


def _cells(own: DataFrame, threshold: float, pivots: np.ndarray, sizes: bool = False) -> DataFrame:
    """(id, v, home, cell): each row in the cell of its nearest pivot, and in every other in which it could have a partner; for ``sizes`` (cell, n) alone.

    Two rows within an angle t of each other, the first at home with p: the second is no further from p than from its own
    pivot and 2 t more. So all pairs meet in each other's home cells, and cells too far apart never meet.
    """
    reach = 2 * float(np.arccos(np.clip(threshold, -1, 1)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p.iloc[k : k + 1000] for p in batches for k in range(0, len(p), 1000)):  # a row may come out many times
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            angle = np.arccos(np.clip(unit @ pivots.T, -1, 1))
            home = angle.argmin(axis=1)
            r, c = np.nonzero(angle <= angle[np.arange(len(x)), home][:, None] + reach + 1e-9)
            if sizes:
                yield pd.DataFrame({"cell": np.arange(len(pivots), dtype=np.int32), "n": np.bincount(c, minlength=len(pivots))})
            else:
                yield pd.DataFrame({"id": part["id"].to_numpy()[r], "v": part["v"].to_numpy()[r], "home": home[r].astype(np.int32), "cell": c.astype(np.int32)})

    return own.mapInPandas(place, "cell int, n bigint" if sizes else "id bigint, v array<float>, home int, cell int")


def _link(i: np.ndarray, u: np.ndarray, j: np.ndarray, v: np.ndarray, threshold: float, same: bool) -> pd.DataFrame:
    """(a, b, sim) of all rows of two blocks with a product of at least ``threshold``.

    Single precision picks the products that may get there, by more than it can err; those are made again in double precision.
    """
    reach = float(np.linalg.norm(u, axis=1).max() * np.linalg.norm(v, axis=1).max()) if len(u) and len(v) else 0.0
    r, c = np.nonzero(u @ v.T >= threshold - 1e-6 - 2.4e-7 * (u.shape[-1] + 1) * reach)
    if same:
        keep = i[r] < j[c]
        r, c = r[keep], c[keep]
    sims = np.zeros(len(r))
    for k in range(0, len(r), 50_000):
        own = slice(k, k + 50_000)
        sims[own] = np.einsum("ij,ij->i", u[r[own]].astype(np.float64), v[c[own]].astype(np.float64))
    keep = sims >= threshold - 1e-12
    r, c = r[keep], c[keep]
    return pd.DataFrame({"a": np.minimum(i[r], j[c]), "b": np.maximum(i[r], j[c]), "sim": sims[keep]})


LINKS = "a bigint, b bigint, sim double"
GROUP_MB = 64


def _all_pairs(own: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """All rows against all: blocks of rows lie packed in one row each, groups of blocks meet each other once.

    A task holds two groups, of ``GROUP_MB`` at most each but for a single block; a block is sent once for each group.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for k in range(0, len(part), block_rows):
                some = part.iloc[k : k + block_rows]
                x = np.stack(some["v"].to_numpy()).astype(np.float32)
                yield pd.DataFrame({"rows": np.array([len(x)], dtype=np.int32), "ids": [some["id"].to_numpy(dtype=np.int64).tobytes()], "vs": [x.tobytes()]})

    blocks = materialize(own.mapInPandas(pack, "rows int, ids binary, vs binary"), "blocks")
    blocks = materialize(blocks.withColumn("blk", F.monotonically_increasing_id()), "blocks")  # written, so that a block keeps its number
    about = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("vs")), F.lit(0)).alias("size")).first()
    cores = own.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(about["n"], max(-(-about["size"] // (GROUP_MB << 20)), int(np.ceil(np.sqrt(6 * cores))))))
    dealt = blocks.withColumn("g", F.pmod(F.xxhash64("blk"), F.lit(groups)).cast("int"))
    both = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("g", "blk", "rows", "ids", "vs", F.least("g", "o").alias("x"), F.greatest("g", "o").alias("y"))

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        x, y = int(part["x"].iloc[0]), int(part["y"].iloc[0])
        open_ = [(g, blk, np.frombuffer(ids, dtype=np.int64), np.frombuffer(vs, dtype=np.float32).reshape(n, -1)) for g, blk, n, ids, vs in zip(part["g"], part["blk"], part["rows"], part["ids"], part["vs"])]
        found = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})]
        for g, p, i, u in open_:
            for h, q, j, v in open_:
                if g == x and h == y and (x != y or p <= q):
                    got = _link(i, u, j, v, threshold, p == q)
                    if len(got):
                        found.append(got)
        return pd.concat(found[1:] or found)

    return both.groupBy("x", "y").applyInPandas(multiply, LINKS)


def similarity_pairs(vectors: DataFrame, threshold: float, *, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None, block_rows: int = 2000) -> DataFrame:
    """(a, b, sim), a < b, of all pairs with a dot product of at least ``threshold``; exact for unit vectors.

    Rows meet only in cells around pivots (``_cells``), so far ones never do; a pair is found in the smaller of its two home
    cells. A cell of more than ``block_rows`` rows is dealt into blocks by a hash and each pair of blocks is one matrix
    product, so that no task holds more than two blocks. Where cells overlap so much that this would be more work than all
    pairs at once, all are compared (``_all_pairs``). The number of links returned is what the data holds.
    """
    own = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
    n = own.count()
    most = pivots or max(1, min(MOST_PIVOTS, n // block_rows))
    if most == 1:
        return _all_pairs(own, threshold, block_rows)
    # Pivots are drawn by a hash of the key: any will do for the result, near ones only for the work.
    drawn = own.orderBy(F.xxhash64("id")).limit(most).toPandas()
    x = np.stack(drawn["v"].to_numpy()).astype(np.float64)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    # Both ways give all pairs: which is less work is told by some of the rows, drawn by a hash.
    part = max(1, n // 20_000)
    some = own.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(part)) == 0)
    filled = [r["n"] * part for r in _cells(some, threshold, unit, sizes=True).groupBy("cell").agg(F.sum("n").alias("n")).collect()]  # at most MOST_PIVOTS rows
    if sum(m * m for m in filled) > n * n / 2:
        return _all_pairs(own, threshold, block_rows)
    placed = materialize(_cells(own, threshold, unit), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))  # at most MOST_PIVOTS rows
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    both = dealt.select("cell", "id", "v", "home", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("cell", "id", "v", "home", "blk", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"))

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        cell, x, y = int(part["cell"].iloc[0]), int(part["x"].iloc[0]), int(part["y"].iloc[0])
        left, right = part[part["blk"] == x], part[part["blk"] == y]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        u, v = np.stack(left["v"].to_numpy()).astype(np.float64), np.stack(right["v"].to_numpy()).astype(np.float64)
        i, j, hi, hj = left["id"].to_numpy(), right["id"].to_numpy(), left["home"].to_numpy(), right["home"].to_numpy()
        sims = u @ v.T
        r, c = np.nonzero(sims >= threshold - 1e-12)
        keep = np.minimum(hi[r], hj[c]) == cell
        if x == y:
            keep &= i[r] < j[c]
        r, c = r[keep], c[keep]
        return pd.DataFrame({"a": np.minimum(i[r], j[c]), "b": np.maximum(i[r], j[c]), "sim": sims[r, c]})

    return both.groupBy("cell", "x", "y").applyInPandas(multiply, LINKS)


def search(vectors: DataFrame, query: list[float], k: int = 5, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of the largest dot product with ``query``, scores to four decimals, ties to the smaller key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    own = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, F.round(dot(F.col(vector), q), 4).alias("score"))
    return own.orderBy(F.col("score").desc(), key).limit(k)


def archetypes(vectors: DataFrame, centroids: DataFrame, n: int = 2, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, rank, category, score) of the ``n`` best of a few centroids (category, pos, centroid) for each row."""
    few = centroids.select("category", "pos", "centroid").limit(MOST_CENTROIDS + 1).collect()
    if len(few) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids: match them in blocks")
    # The centroids stand in the plan: each row is scored where it lies.
    scores = [F.struct((-F.round(dot(F.col(vector), F.array(*map(F.lit, map(float, c["centroid"])))), 4)).alias("s"), F.lit(c["pos"]).alias("pos"), F.lit(c["category"]).alias("category")) for c in few]
    own = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    if not scores:
        return own.limit(0).select(key, F.lit(1).alias("rank"), F.lit("").alias("category"), F.lit(0.0).alias("score"))
    best = own.select(key, F.slice(F.array_sort(F.array(*scores)), 1, n).alias("best"))
    return best.select(key, F.posexplode("best").alias("rank", "b")).select(key, (F.col("rank") + 1).alias("rank"), "b.category", (F.lit(0.0) - F.col("b.s")).alias("score"))


def mean_vectors(rows: DataFrame, by: list[str], *, vector: str = "embedding") -> DataFrame:
    """(by, centroid): the mean vector of each group, not brought to unit length."""
    long = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*by, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def paragraphs(sentences: DataFrame, *, doc: str, pos: str, vector: str, size: int = 3) -> DataFrame:
    """(doc, para, centroid): runs of ``size`` sentences pooled to unit means."""
    pooled = mean_vectors(sentences.withColumn("para", F.floor(F.col(pos) / size).cast("int")), [doc, "para"], vector=vector)
    return pooled.withColumn("centroid", normalise(F.col("centroid")))


def core_paragraph(docs: DataFrame, pooled: DataFrame, *, doc: str, vector: str) -> DataFrame:
    """(doc, core, score): the paragraph nearest to the whole document; the first of equals."""
    scored = docs.select(doc, vector).join(pooled, doc).select(doc, "para", F.round(dot(F.col(vector), F.col("centroid")), 6).alias("score"))
    return scored.groupBy(doc).agg(F.min_by("para", F.struct(-F.col("score"), F.col("para"))).alias("core"), F.max("score").alias("score"))


def greedy_dedup(items: DataFrame, pairs: DataFrame, *, key: str = "vec_id", priority: str = "priority", rounds: int = 1000) -> DataFrame:
    """(key, kept, absorbed_by, absorbed): what a greedy pass by falling priority keeps, without the pass.

    In each round an undecided row without an undecided better neighbour is kept and drops its neighbours: the
    first maximal independent set in order of priority, which takes few rounds. A dropped row is
    charged to its best kept neighbour. Equal priorities go by the smaller key.
    """
    rank = F.struct((-F.col(priority)).alias("p"), F.col(key).alias("k"))
    ranked = items.select(F.col(key).alias("id"), rank.alias("o"))
    e = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = e.join(ranked.select(F.col("id").alias("u"), F.col("o").alias("ou")), "u").join(ranked.select(F.col("id").alias("v"), F.col("o").alias("ov")), "v")
    e = materialize(e.where(F.col("ov") < F.col("ou")).select("u", "v", "ov"), "mis-edges")  # u is worse than v
    todo = materialize(e.select(F.col("u").alias("id")).union(e.select("v")).distinct(), "mis-open")
    kept = dropped = None
    live = e
    for i in range(rounds):
        blocked = live.select(F.col("u").alias("id")).distinct()
        new = materialize(todo.join(blocked, "id", "left_anti"), "mis-kept")
        gone = materialize(live.join(new.withColumnRenamed("id", "v"), "v", "left_semi").select(F.col("u").alias("id")).distinct(), "mis-dropped")
        kept = new if kept is None else kept.union(new)
        dropped = gone if dropped is None else dropped.union(gone)
        todo = materialize(todo.join(new, "id", "left_anti").join(gone, "id", "left_anti"), "mis-open")
        if not todo.limit(1).count():
            break
        if i == rounds - 1:
            raise RuntimeError(f"rows left undecided after {rounds} rounds")
        live = live.join(todo.withColumnRenamed("id", "u"), "u", "left_semi").join(todo.withColumnRenamed("id", "v"), "v", "left_semi")
        live = materialize(live, "mis-edges")
    charge = e.join(dropped.withColumnRenamed("id", "u"), "u", "left_semi").join(kept.withColumnRenamed("id", "v"), "v", "left_semi")
    charge = charge.groupBy("u").agg(F.min_by("v", "ov").alias("absorbed_by"))
    count = charge.groupBy("absorbed_by").agg(F.count("*").cast("bigint").alias("absorbed"))
    out = ranked.select("id").join(charge.withColumnRenamed("u", "id"), "id", "left")
    out = out.join(count.withColumnRenamed("absorbed_by", "_k"), out["id"] == F.col("_k"), "left")
    return out.select(F.col("id").alias(key), F.col("absorbed_by").isNull().alias("kept"), "absorbed_by", F.coalesce("absorbed", F.lit(0)).cast("bigint").alias("absorbed"))


def hash_encode(texts: DataFrame, *, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, embedding): unit vectors of hashed words, the encoder where no trained one is at hand. Null and empty texts have none."""
    import re
    import zlib

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for t in part["text"]:
                v = np.zeros(dim)
                for w in re.findall(r"[^\W\d_]{3,}", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 31 else -1
                n = np.linalg.norm(v)
                out.append((v / n).astype(np.float32) if n else None)
            yield pd.DataFrame({"key": part["key"], "embedding": out})

    return texts.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInPandas(encode, "key bigint, embedding array<float>").withColumnRenamed("key", key)


def rank_rows(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
