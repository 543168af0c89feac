"""Evaluation passages inside a training corpus.

Documents are cut into windows of the size of an item and of a short run. Windows get SimHash fingerprints,
which are looked up in multi-indexes of Hamming blocks, of which at least one agrees exactly for all fingerprints
within the radius: so no window is compared with all items. Half of an item's words leave fingerprints too far apart
for any block, so an index of each item's rarer words adds what fingerprints miss: a document that holds half of an
item's words must hold as many of the rarer ones as are left when all others are there. Candidates are verified on
the words themselves: a run of consecutive words, or half of the item's words in order within a stretch of about its
length, or two that do not overlap.

Fingerprints stand for words alone: case, punctuation, spacing, markup, line breaks, hyphens at line ends and
invisible characters are gone before. The items are broadcast; ``find_leaks`` refuses more than ``max_items``.

Defined results: null and empty texts and items contain nothing; an item of fewer words than a run is found
when all its words stand in order; repeated documents come out under each id; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, RADIUS, BITS = 12, 3, 64
WIDE_BITS, WIDE_BLOCKS = 128, 8
COMMON = 0.35  # share of an item's words that counts as its common ones; must be below a half
_BLOCK_TAG = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|section|article|pre|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->", re.I | re.S)
_WRAP = re.compile(r"[-‐‑­]\s*\n[\s>|*]*")
_INSIDE = re.compile(r"(?<=\w)[-‐‑–'’_](?=\w)|(?<=\d)[.,](?=\d)")
_MARK = re.compile(r"[*_~`#]+")
_PLAIN = re.compile(r"\w+")


def plain_words(text: str | None) -> list[str]:
    """The words of a text as they read, whatever their dress."""
    if not text:
        return []
    text = html.unescape(text) if "&" in text else text
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) != "Cf" or c == "­")
    text = _WRAP.sub("", text).replace("­", "")
    return re.findall(r"\w+", _INSIDE.sub("", _MARK.sub("", text).lower()))


def _signs(word: str, bits: int) -> np.ndarray:
    """Plus or minus one per bit, from a hash that is the same on all machines."""
    out, raw = [], word.encode()
    for i in range(bits // 32):
        out.append(zlib.crc32(raw + bytes([i]), 0x5BD1E995 * (i + 1) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF)
    h = np.array(out, dtype=np.uint32)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return np.unpackbits(h.view(np.uint8)).astype(np.int8) * 2 - 1


def _fingerprints(signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the windows [start, end) over weighted sign rows, as rows of uint64."""
    total = np.zeros((len(signs) + 1, signs.shape[1]), dtype=np.float32)
    np.cumsum(signs, axis=0, out=total[1:])
    return np.packbits(total[ends] - total[starts] > 1e-4, axis=1).view(np.uint64)


def _order(masks: dict[str, int], words: list[str]) -> int:
    """Bits at which the longest common subsequence grows (bit-parallel); its length is the count of zeros."""
    v = -1
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return v


def in_order(item: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence."""
    return len(item) - (_order(_masks(item), words) & ((1 << len(item)) - 1)).bit_count()


def _masks(item: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _reach(n: int) -> int:
    """Words of a document in which ``n`` words of an item may lie."""
    return int(n * 1.25) + 2


def _parts(masks: dict[str, int], words: list[str], n: int) -> list[int]:
    """For each p up to n, how many of the item's first p words stand in order within the first ``_reach(p)`` of ``words``."""
    v, out, p = -1, [0] * (n + 1), 1
    for t, w in enumerate(words, 1):
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
        while p <= n and _reach(p) <= t:
            out[p] = p - (v & ((1 << p) - 1)).bit_count()
            p += 1
    for p in range(p, n + 1):
        out[p] = p - (v & ((1 << p) - 1)).bit_count()
    return out


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of all places of the ranges [low, high)."""
    many = high - low
    row = np.repeat(np.arange(len(low)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)


class Blocks:
    """A multi-index of fingerprints: all within ``count`` - 1 bits of an entry agree with it in one of ``count`` blocks of 16 bits."""

    def __init__(self, prints: np.ndarray, count: int):
        self.prints, self.count, self.tables = prints, count, []
        for value in self._cut(prints).T:
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << 16) + 1)), order))

    def _cut(self, prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints).view(np.uint16).reshape(-1, self.count).astype(np.int64)

    def near(self, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``got``, entry) of all within the radius."""
        rows, entries = [], []
        if len(self.prints) and len(got):
            for value, (first, order) in zip(self._cut(got).T, self.tables):
                if (first[value + 1] > first[value]).any():
                    row, place = _spread(first[value], first[value + 1])
                    entry = order[place]
                    close = np.bitwise_count(got[row] ^ self.prints[entry]).reshape(len(row), -1).sum(axis=1) < self.count
                    rows.append(row[close])
                    entries.append(entry[close])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate(rows or [none]), np.concatenate(entries or [none])


class Items:
    """Fingerprints of items and their windows, and what verifies candidates."""

    def __init__(self, items: list[tuple[int, list[str]]], weight: dict[str, float], default: float):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.vocabulary = sorted({w for ws in self.words for w in ws})
        self.code = {w: i for i, w in enumerate(self.vocabulary)}
        self.weight = np.array([weight.get(w, default) for w in self.vocabulary], dtype=np.float32)
        n = max(1, len(self.vocabulary))
        self.signs = np.stack([_signs(w, BITS) for w in self.vocabulary]).astype(np.float32) if self.vocabulary else np.zeros((n, BITS), np.float32)
        wide = np.stack([_signs(w, WIDE_BITS) for w in self.vocabulary]).astype(np.float32) if self.vocabulary else np.zeros((n, WIDE_BITS), np.float32)
        self.wide = wide * self.weight[:, None] if self.vocabulary else wide
        self.runs = [{tuple(ws[i : i + RUN]) for i in range(len(ws) - RUN + 1)} for ws in self.words]
        prints, owner = [], []
        for k, ws in enumerate(self.words):
            if len(ws) >= RUN:
                at = np.arange(len(ws) - RUN + 1)
                prints.append(_fingerprints(self.signs[[self.code[w] for w in ws]], at, at + RUN)[:, 0])
                owner += [k] * len(at)
        self.runs_at = Blocks(np.concatenate(prints) if prints else np.zeros(0, np.uint64), RADIUS + 1)
        self.owner = np.array(owner, dtype=np.int64)
        lengths = np.array([len(w) for w in self.words])
        self.sizes = sorted({int(16 * 1.35**j) for j in range(1, 40) if lengths.size and 16 * 1.35**j <= lengths.max() * 1.35}) or [32]
        self.whole = np.stack([self._whole(ws) for ws in self.words]) if self.words else np.zeros((0, WIDE_BITS // 64), np.uint64)
        self.need = np.array([math.ceil(n / 2) if n >= RUN else n for n in lengths], dtype=np.int64)
        # Words that an item has m times stand for m features. Its most usual words, COMMON of all, are passed over: what is
        # still needed when all of them are there must come from the others, whatever is usual in the corpus.
        held: list[list[int]] = [[] for _ in self.vocabulary]
        self.least = self.need.copy()
        for k, ws in enumerate(self.words):
            spare = int(COMMON * len(ws)) if len(ws) >= RUN else 0
            for w, m in sorted(Counter(ws).items(), key=lambda x: (weight.get(x[0], default), x[0])):
                if m <= spare:
                    spare -= m
                    self.least[k] -= m
                else:
                    spare = 0
                    held[self.code[w]] += [k, m]
        most = np.array([max(h[1::2], default=0) for h in held], dtype=np.int64)
        self.feature = np.r_[0, np.cumsum(most)]
        listed = [[k for k, m in zip(h[::2], h[1::2]) if m > level] for h, top in zip(held, most) for level in range(top)]
        self.first = np.r_[0, np.cumsum([len(x) for x in listed], dtype=np.int64)].astype(np.int64)
        self.holders = np.array([k for x in listed for k in x], dtype=np.int64)
        self.size_of = np.array([min(self.sizes, key=lambda s: abs(math.log(s / max(1, n)))) for n in lengths]) if len(lengths) else np.zeros(0)
        self.sized = {size: (of, Blocks(self.whole[of], WIDE_BLOCKS)) for size in self.sizes if len(of := np.flatnonzero(self.size_of == size))}

    def _whole(self, ws: list[str]) -> np.ndarray:
        return _fingerprints(self.wide[[self.code[w] for w in ws]], np.array([0]), np.array([len(ws)]))[0]

    def candidates(self, words: list[str]) -> dict[int, set[int]]:
        """Items that windows of a document may hold, with the places of those windows."""
        codes = np.array([self.code.get(w, -1) for w in words], dtype=np.int64)
        n, out = len(codes), {}
        known = np.r_[0, np.cumsum(codes >= 0)]
        if n == 0 or known[-1] < min(RUN, n) // 2:
            return out
        starts = np.arange(max(0, n - RUN + 1))
        starts = starts[known[starts + RUN] - known[starts] >= RUN - RADIUS] if len(starts) else starts
        if len(starts) and len(self.owner):
            got = _fingerprints(np.where(codes[:, None] >= 0, self.signs[codes], 0), starts, starts + RUN)
            row, entry = self.runs_at.near(got[:, 0])
            for k, at in set(zip(self.owner[entry].tolist(), starts[row].tolist())):
                out.setdefault(k, set()).add(at)
        weighed = None
        for size, (of, index) in self.sized.items():
            low = np.unique(np.r_[np.arange(0, max(1, n - size + 1), max(1, size // 6)), max(0, n - size)])
            high = np.minimum(low + size, n)
            full = known[high] - known[low] >= size // 2  # nearly the whole item, or the fingerprints are not near
            if full.any():
                weighed = np.where(codes[:, None] >= 0, self.wide[codes], 0) if weighed is None else weighed
                row, entry = index.near(_fingerprints(weighed, low[full], high[full]))
                for k, at in zip(of[entry].tolist(), low[full][row].tolist()):
                    out.setdefault(k, set()).add(at)
        return out

    def countable(self, words: list[str]) -> set[int]:
        """All items of whose rarer words the document holds as many as must be there if half of all stand in order."""
        codes = np.array([c for w in words if (c := self.code.get(w)) is not None], dtype=np.int64)
        if not len(codes):
            return set()
        code, many = np.unique(codes, return_counts=True)
        top = np.minimum(self.feature[code] + many, self.feature[code + 1])
        _, feature = _spread(self.feature[code], top)
        _, place = _spread(self.first[feature], self.first[feature + 1])
        shared = np.bincount(self.holders[place], minlength=len(self.words))
        return set(np.flatnonzero(shared >= np.maximum(self.least, 1)).tolist())

    def holds(self, k: int, words: list[str], grams: set[tuple[str, ...]]) -> bool:
        """Whether the document, with its ``grams`` of RUN words, holds the item.

        It does by a run, or by half of the item's words in order in a stretch or two, the item's beginning in the
        one and its end in the other, wherever it is parted.
        """
        item = self.words[k]
        n = len(item)
        if not self.runs[k].isdisjoint(grams):
            return True
        need = int(self.need[k])
        ahead, back = _masks(item), _masks(item[::-1])
        step, reach = max(1, n // 16), _reach(n)
        lows = np.arange(0, max(1, len(words) - 2 + step), step)
        # Wherever the item is parted, a stretch holds no more of a part than the words they share, repeated ones as often
        # as in the item; what cannot make up the need with the best other stretch is passed over.
        one, two, often = {w: i for i, w in reversed(list(enumerate(item)))}, {w: i for i, w in enumerate(item)}, Counter(item)
        size = len(words)
        begins, ends = np.array([one.get(w, n) for w in words]), np.array([two.get(w, -1) for w in words])
        before, later = np.full(size, -1), np.full(size, size)  # where the word stood as many times before, or will, as the item has it
        seen: dict[str, list[int]] = {}
        for t, w in enumerate(words):
            if w in often:
                at = seen.setdefault(w, [])
                if len(at) >= often[w]:
                    before[t] = at[-often[w]]
                    later[at[-often[w]]] = t
                at.append(t)
        stop = np.maximum(0, size - lows)
        fore_at, aft_at = lows[:, None] + np.arange(reach), stop[:, None] - 1 - np.arange(reach)
        fore_in, aft_in = fore_at < size, aft_at >= 0
        fore_at, aft_at = np.minimum(fore_at, size - 1), np.maximum(aft_at, 0)
        fore_in &= before[fore_at] < lows[:, None]
        aft_in &= later[aft_at] >= stop[:, None]
        fore_at, aft_at = begins[fore_at], ends[aft_at]
        use_first, use_last = np.zeros(len(lows), dtype=bool), np.zeros(len(lows), dtype=bool)
        cuts = sorted({n * i // 12 for i in range(13)})
        for a, b in zip(cuts, cuts[1:]):
            fore = (fore_in & (fore_at < b))[:, : _reach(b)].sum(axis=1)
            aft = (aft_in & (aft_at >= a))[:, : _reach(n - a)].sum(axis=1)
            use_first |= fore + aft.max() >= need
            use_last |= aft + fore.max() >= need
        if not use_first.any():
            return False
        first = np.zeros((len(lows), n + 1), dtype=np.int32)  # by start and length of the item's beginning
        last = np.zeros((len(lows), n + 1), dtype=np.int32)  # by end and length of the item's end
        turned = words[::-1]
        for i, low in enumerate(lows.tolist()):
            if use_first[i]:
                first[i] = _parts(ahead, words[low : low + reach], n)
                if first[i, n] >= need:
                    return True
            if use_last[i]:
                last[i] = _parts(back, turned[low : low + reach], n)
        if (first.max(axis=0) + last.max(axis=0)[::-1]).max() < need:
            return False
        end_of_last = len(words) - lows  # falls
        for p in range(1, n):
            start = end_of_last - _reach(n - p)
            for one, two, ends, starts in ((first[:, p], last[:, n - p], lows + _reach(p), start), (last[::-1, n - p], first[:, p], end_of_last[::-1], lows)):
                so_far = np.maximum.accumulate(one)
                before = np.searchsorted(ends, starts, side="right") - 1
                if (np.where(before >= 0, so_far[before], -n) + two).max() >= need:
                    return True
        return False


def _document_words(documents: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Number of documents that hold each word of the items: as many rows as the items have words.

    Dress is not taken off here: the counts weigh words, and no candidate is lost by them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        n = 0
        for part in batches:
            for t in part["text"]:
                n += 1
                for w in vocabulary.intersection(_PLAIN.findall(t.lower())):
                    seen[w] = seen.get(w, 0) + 1
        yield pd.DataFrame({"word": [*seen, ""], "n": [*seen.values(), n]})

    rows = documents.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return got, max(1, got.pop("", 1))


def find_leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", parts: tuple[str, ...] = ("passage", "question"), max_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id) of each document that contains an item, wholly or in part."""
    listed = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("i"), *[F.coalesce(F.col(p), F.lit("")).alias(f"p{j}") for j, p in enumerate(parts)]).limit(max_items + 1).collect()
    if len(listed) > max_items:
        raise ValueError(f"more than {max_items} items: run them in blocks")
    own = [(r["i"], plain_words(" ".join(r[f"p{j}"] for j in range(len(parts))))) for r in sorted(listed, key=lambda r: r["i"])]
    own = [(i, w) for i, w in own if w]
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    vocabulary = {w for _, ws in own for w in ws}
    seen, total = _document_words(rows.select("text"), vocabulary)
    weight = {w: math.log((total + 1) / (n + 1)) for w, n in seen.items()}
    table = Items(own, weight, math.log(total + 1))
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for part in batches:
            docs, found = [], []
            for d, t in zip(part["doc_id"], part["text"]):
                words = plain_words(t)
                near = table.candidates(words).keys() | table.countable(words)
                grams = {tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1)} if near else set()
                for k in sorted(near):
                    if table.holds(k, words, grams):
                        docs.append(d)
                        found.append(table.ids[k])
            yield pd.DataFrame({"doc_id": docs, "item_id": found})

    return rows.mapInPandas(search, "doc_id bigint, item_id bigint").distinct()
