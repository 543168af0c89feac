"""Packing texts into containers of fixed token capacity.

First-fit decreasing, with the containers' free space in a tournament tree, run independently in groups
of texts drawn at random by a hash, so that no task holds all texts and each group has the same mix of
sizes. Texts above the capacity are split at it; all others stay whole.

Defined results: a null text has no row; an empty text takes no space but is placed; equal texts are
packed one by one; capacities that are null or not positive are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the public byte-level vocabulary splits texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_CAPACITIES = 100
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level tokenizer at ``path``, loaded once in a worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_sizes(documents: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each text that is not null; whole texts are encoded."""
    path = tokenizer or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(own.encode_ordinary(t)) for t in part["text"]]})

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "doc_id bigint, n_tokens bigint")


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size, taken in the given order: the first that has room.

    The tree's inner nodes hold the most free space below them, so a container is found in log time.
    """
    n = max(1, len(sizes))
    width = 1 << (n - 1).bit_length()
    free = [capacity] * (2 * width)
    out = np.empty(len(sizes), dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < width:
            at *= 2
            if free[at] < size:
                at += 1
        out[i] = at - width
        free[at] -= size
        at //= 2
        while at:
            most = free[2 * at] if free[2 * at] >= free[2 * at + 1] else free[2 * at + 1]
            if free[at] == most:
                break
            free[at] = most
            at //= 2
    return out


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    part["container"] = part["group"].astype(np.int64) * (1 << 32) + first_fit(part["n_tokens"].to_numpy(), int(part["capacity_tokens"].iloc[0]))
    return part[["capacity_id", "capacity_tokens", "container", "doc_id", "piece", "start_token", "n_tokens"]]


PACKED = "capacity_id int, capacity_tokens int, container bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint"


def pack(documents: DataFrame, capacities: DataFrame, *, group_items: int = 20_000, tokenizer: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Each text, or piece of a text above the capacity, with its container, for each capacity.

    ``group_items``: texts a group holds on average. A larger group wastes less, as each may leave one
    container half empty.
    """
    sizes = sizes if sizes is not None else materialize(token_sizes(documents, tokenizer=tokenizer), "token-sizes")
    groups = max(1, round(sizes.count() / group_items))
    own = capacities.where(F.col("capacity_tokens") > 0).select("capacity_id", "capacity_tokens").distinct().orderBy("capacity_id").limit(MOST_CAPACITIES + 1).collect()
    if len(own) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities: pack them in turn")
    each = F.array(*[F.struct(F.lit(r[0]).cast("int").alias("capacity_id"), F.lit(r[1]).cast("int").alias("capacity_tokens")) for r in own])
    whole = sizes.select("doc_id", "n_tokens", F.explode(each).alias("c")).select("doc_id", "n_tokens", "c.*") if own else sizes.limit(0).select("*", F.lit(0).alias("capacity_id"), F.lit(1).alias("capacity_tokens"))
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity_tokens")) - 1, F.lit(0)).cast("int")
    pieces = whole.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * F.col("capacity_tokens")
    items = pieces.select(
        "capacity_id", "capacity_tokens", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(groups)).cast("int").alias("group"), "doc_id", "piece", start.alias("start_token"),
        F.least(F.col("n_tokens") - start, F.col("capacity_tokens").cast("bigint")).alias("n_tokens"),
    )
    return items.groupBy("capacity_id", "group").applyInPandas(_pack, PACKED)
