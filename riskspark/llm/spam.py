"""Keyword-stuffed pages, link lists, menus and tag pages.

Counts of words and of neighbouring words over the whole corpus give the pointwise mutual information (PMI) of
neighbours, normalised to lie between -1 and 1. In coherent text neighbours tell much more about each other than
words some places apart; in word salad, keyword lists, menus, link lists and tags they do not, as any word stands
beside any other. The difference is a text's gain. Links and tags are read as the words they are made of.

A text has three kinds of parts: sentences, figures (lines that are numbers in good part), and loose words. Loose
words are spam if their gain is less than ``salad`` of what the sentences of the corpus usually gain and some of their
collocations come again, if it is less than ``hopeless`` of that, or if their collocations come again and again whatever
the gain; sentences are spam if one keyword fills them and their gain is less than ``salad`` or their collocations come
again and again, or if their gain is less than ``hopeless`` where they do not get there by repeating themselves. A document is spam if more than half of its words are in such
parts. As the bars are shares of the corpus' own gain, and PMI is taken over shares, neither moves with the size of the
corpus.

What is broadcast is bounded: pairs that make up at least ``1 / most_pairs`` of all are at most ``most_pairs``, and words from
``ABOVE`` times that count are fewer still. The counts of all rarer ones are asked for by the texts that hold them and joined (``asked``), so
that every pair's count is known and verdicts do not depend on ``most_pairs``; a bitmap tells which are worth asking for. A document's own counts, and those of
its copies, are left out when it is judged, so that no text vouches for itself.

Defined results: null, empty and blank texts are no cases; lists and tables of figures are none; every row is judged
on its own, so repeated texts come out under each id; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_side

MOST_PAIRS = 1 << 19
APART = (3, 5, 7)
ABOVE = 8  # how many times the share of ``EVEN`` a word needs in other texts for its pairs to be judged
EVEN = 1 << 19  # half of this share of all pairs, or half a text, is added to the count of every pair: what is rare says little, whatever the size of the corpus
TOGETHER = 2500  # texts looked up at once
SEGMENT, MOST_BITS = 15, 28  # of the bitmap of rarer words and pairs, as powers of two: bits of a segment, of all
EVIDENCE, COVER = 8, 0.25  # pairs of known words that a part needs to be judged by its gain, and their share in all its pairs
_HOST = re.compile(r"(?:https?://|www\.)[^/\s)\]>]*", re.I)
_LINKED = re.compile(r"\[([^\]\n]*)\]\(\s*([^)\s]*)\s*\)")
_ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>", re.I | re.S)
_MARKUP = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_HUMP = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_WORD = re.compile(r"[^\W\d_](?:[^\W_]|['’](?=\w))*|\d[\d.,:%]*")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”’)]*\s+(?=[\"“(]?[^\W\d_a-z]|[\"“(]?\d)")
_LEAD = re.compile(r"^\s*(?:[-*•>·]+|\d+[.)])\s+")
SENTENCE, LOOSE, FIGURES = 0, 1, 2

_HASHES: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Lower-case words; numbers are all the same word; compound tags fall into their words."""
    if "#" in text or "@" in text:
        text = _HUMP.sub(" ", text)
    return ["0" if w[0].isdigit() else w.lower() for w in _WORD.findall(text)]


def _hash(word: str) -> int:
    got = _HASHES.get(word)
    if got is None:
        if len(_HASHES) > 300_000:
            _HASHES.clear()
        raw = word.encode()
        got = _HASHES[word] = (zlib.crc32(raw) << 31) ^ zlib.crc32(raw, 0x9747B28C)
    return got


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of each ordered pair."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def rest_keys(kind: int, key: np.ndarray) -> np.ndarray:
    """Keys of words (kind 0) and pairs (1) in one space, spread over all 64 bits."""
    return pair_keys(key, np.full(len(key), kind + 1, dtype=np.int64))


def parts(text: str) -> tuple[tuple[list[str], list[str], list[str]], int]:
    """The words of sentences, of loose text and of figures, and how many words are in sentences that one keyword fills."""
    out: tuple[list[str], list[str], list[str]] = ([], [], [])
    stuffed = 0
    text = _ANCHOR.sub(r" \1 ", _LINKED.sub(r" \1 \2 ", text)) if "](" in text or "<a " in text else text
    if "<" in text:
        text = _MARKUP.sub("\n", text)
    for line in text.split("\n"):
        if not line.strip():
            continue
        linked = "://" in line or "www." in line
        line = _LEAD.sub("", _HOST.sub(" link ", line) if linked else line)
        for piece in _SPLIT.split(line):
            own = words(piece)
            if not own:
                continue
            figures = sum(w == "0" for w in own)
            closed = piece.rstrip("\"”’) ")[-1:] in ".!?…" and piece.lstrip("\"“(")[:1].isupper() and len(own) > 3
            if closed and not linked and "#" not in piece:
                out[SENTENCE].extend(own)
                top, n = Counter(w for w in own if len(w) > 2).most_common(1)[0] if any(len(w) > 2 for w in own) else ("", 0)
                # A word written with a capital inside the sentence is a name.
                if n >= 3 and n >= 0.15 * len(own) and not re.search(rf"\b{re.escape(top[:1].upper() + top[1:])}", piece[1:]):
                    stuffed += len(own)
            elif figures >= 0.2 * len(own) and not linked and "tags" not in own:
                out[FIGURES].extend(own)
            else:
                out[LOOSE].extend(own)
    return out, stuffed


class _Batch:
    """The words of all parts of some texts in one array, with the text and the part of each."""

    def __init__(self, texts: list[str]):
        found = [parts(t) for t in texts]
        self.sizes = np.array([[len(p) for p in f[0]] for f in found], dtype=np.int64).reshape(-1, 3)
        self.stuffed = np.array([f[1] for f in found], dtype=np.int64)
        self.word = np.array([_hash(w) for f in found for p in f[0] for w in p], dtype=np.int64)
        self.part = np.repeat(np.arange(len(found) * 3), self.sizes.ravel())

    def places(self, apart: int) -> np.ndarray:
        """Places of all words that have another ``apart`` places on in the same part."""
        return np.flatnonzero(self.part[:-apart] == self.part[apart:]) if len(self.part) > apart else np.zeros(0, dtype=np.int64)

    def pairs(self, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, first, second) of all words ``apart`` places from each other in one part."""
        same = self.places(apart)
        return self.part[same], self.word[same], self.word[same + apart]


def _in_text(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    return pair_keys(text.astype(np.int64) + 1, key)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts each word, each pair of neighbours stands; kind 0, 1."""
    for part in batches:
        own = _Batch(part["text"].tolist())
        at, a, b = own.pairs(1)
        for kind, text, key in ((0, own.part // 3, own.word), (1, at // 3, pair_keys(a, b))):
            _, first = np.unique(_in_text(text, key), return_index=True)
            value, n = np.unique(key[first], return_counts=True)
            yield pd.DataFrame({"kind": np.full(len(value), kind, dtype=np.int32), "key": value, "n": n})


class Known:
    """Sorted keys of frequent words and pairs with the number of texts that hold them, and a bitmap of the rarer ones."""

    def __init__(self, words: pd.DataFrame, pairs: pd.DataFrame, texts: int, least: float):
        self.words, self.word_n = self._sorted(words)
        self.pairs, self.pair_n = self._sorted(pairs)
        self.texts, self.least = max(1, texts), least
        self.bits: np.ndarray | None = None
        self.rest, self.rest_n = np.zeros(0, dtype=np.int64), np.zeros(0)

    @staticmethod
    def _sorted(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.sort_values("key")
        return rows["key"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64)

    @staticmethod
    def _look(keys: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(asked))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, n[at], 0.0)

    def with_rest(self, keys: np.ndarray, n: np.ndarray) -> Known:
        """The same with counts of some rarer words and pairs."""
        out = copy.copy(self)
        out.rest, first = np.unique(keys, return_index=True)
        out.rest_n = n[first].astype(np.float64)
        return out

    def count(self, kind: int, asked: np.ndarray) -> np.ndarray:
        """In how many texts each word (kind 0) or pair (1) stands."""
        n = self._look(*((self.pairs, self.pair_n) if kind else (self.words, self.word_n)), asked)
        if len(self.rest):
            unknown = np.flatnonzero(n == 0)
            n[unknown] = self._look(self.rest, self.rest_n, rest_keys(kind, asked[unknown]))
        return n

    def _rarer(self, kind: int, asked: np.ndarray) -> np.ndarray:
        """Whether the bitmap holds each; now and then of one that it should not hold."""
        at = rest_keys(kind, asked).view(np.uint64) >> np.uint64(64 - (len(self.bits) * 8).bit_length() + 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def asked(self, own: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """(text, key of ``rest_keys``) of all words and pairs whose counts the texts need and the frequent ones do not give."""
        word, back = np.unique(own.word, return_inverse=True)
        frequent = self._look(self.words, self.word_n, word) > 0
        rarer = ~frequent & self._rarer(0, word)
        at = np.flatnonzero(rarer[back])
        texts, keys = [own.part[at] // 3], [rest_keys(0, own.word[at])]
        usable = (frequent | rarer)[back]
        for apart in (1, *APART):
            same = own.places(apart)
            same = same[usable[same] & usable[same + apart]]
            pair, to = np.unique(pair_keys(own.word[same], own.word[same + apart]), return_inverse=True)
            need = (self._look(self.pairs, self.pair_n, pair) == 0) & self._rarer(1, pair)
            same, to = same[need[to]], to[need[to]]
            texts.append(own.part[same] // 3)
            keys.append(rest_keys(1, pair[to]))
        text, key = np.concatenate(texts), np.concatenate(keys)
        _, first = np.unique(_in_text(text, key), return_index=True)
        return text[first], key[first]

    def association(self, own: _Batch, apart: int, copies: np.ndarray, others: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of normalised PMI and number of judged pairs of each part.

        ``others``: in how many texts besides its own and its copies each word stands. ``beside``: pairs of neighbours of each text, sorted.
        """
        same = own.places(apart)
        enough = others >= ABOVE * self.least
        same = same[enough[same] & enough[same + apart]]
        at, na, nb = own.part[same], others[same], others[same + apart]
        key = pair_keys(own.word[same], own.word[same + apart])
        both = self.count(1, key)
        known = np.flatnonzero(both)
        text = at[known] // 3
        many = copies[text]
        if apart > 1 and len(beside):
            asked = _in_text(text, key[known])
            many = many * (beside[np.minimum(np.searchsorted(beside, asked), len(beside) - 1)] == asked)
        both[known] -= many
        share = (both + self.least / 2) / self.texts
        value = np.log(share * self.texts**2 / (na * nb)) / np.maximum(-np.log(np.minimum(share, 0.999)), 1e-3)
        size = own.sizes.size
        return np.bincount(at, value, minlength=size), np.bincount(at, minlength=size)

    def gains(self, own: _Batch, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain of each part, and the number of neighbours it rests on."""
        at, a, b = own.pairs(1)
        beside = np.unique(_in_text(at // 3, pair_keys(a, b)))
        others = self.count(0, own.word) - copies[own.part // 3]
        near, n = self.association(own, 1, copies, others, beside)
        far, m = (sum(x) for x in zip(*[self.association(own, d, copies, others, beside) for d in APART]))
        return near / np.maximum(n, 1) - far / np.maximum(m, 1), np.where(m > 0, n, 0)


def _repeated(own: _Batch) -> np.ndarray:
    """Share of each part's collocations that stand in it three times or more."""
    at, a, b = own.pairs(1)
    _, back, n = np.unique(_in_text(at, pair_keys(a, b)), return_inverse=True, return_counts=True)
    size = own.sizes.size
    return np.bincount(at, n[back] >= 3, minlength=size) / np.maximum(np.bincount(at, minlength=size), 1)


def _bitmap(rest: DataFrame, rows: int) -> np.ndarray:
    """Bits at the beginnings of the keys, packed into bytes; 16 for each key, up to ``2^MOST_BITS`` of all."""
    power = max(SEGMENT, min(MOST_BITS, (16 * rows).bit_length()))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        at = part["key"].to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(64 - power)
        bits = np.zeros(1 << SEGMENT, dtype=bool)
        bits[(at & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)] = True
        return pd.DataFrame({"segment": [int(at[0]) >> SEGMENT], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    segment = F.shiftrightunsigned("key", 64 - power + SEGMENT) if power > SEGMENT else F.lit(0)
    out = np.zeros((1 << (power - SEGMENT), 1 << (SEGMENT - 3)), dtype=np.uint8)
    for r in rest.select("key", segment.alias("s")).groupBy("s").applyInPandas(fill, "segment int, bits binary").collect():  # at most 2^(MOST_BITS - 3) bytes
        out[r["segment"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def corpus_counts(rows: DataFrame, most_pairs: int = MOST_PAIRS) -> tuple[Known, DataFrame | None]:
    """The pairs of neighbours that make up at least ``1 / most_pairs`` of all with the words frequent enough to form them, and a table (key, n) of all rarer ones, if there are any."""
    sums = rows.select("text").mapInPandas(_counts, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "word-counts")
    pairs = sums.where("kind = 1").agg(F.sum("n").alias("n")).first()["n"] or 0
    floor, least = max(1.0, pairs / most_pairs), max(1.0, pairs / EVEN)
    kept = [sums.where((F.col("kind") == k) & (F.col("n") >= share)).select("key", "n").toPandas() for k, share in ((0, ABOVE * max(floor, least)), (1, floor))]  # at most ``most_pairs`` rows
    known = Known(*kept, rows.count(), least)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            kind, key = part["kind"].to_numpy(), part["key"].to_numpy(dtype=np.int64)
            yield pd.DataFrame({"key": np.where(kind == 0, rest_keys(0, key), rest_keys(1, key)), "n": part["n"]})

    rarer = ((F.col("kind") == 0) & (F.col("n") >= ABOVE * least) & (F.col("n") < ABOVE * floor)) | ((F.col("kind") == 1) & (F.col("n") < floor))
    rest = materialize(sums.where(rarer).mapInPandas(keyed, "key bigint, n bigint"), "rarer-counts") if floor > 1 else None
    many = rest.count() if rest is not None else 0
    if not many:
        return known, None
    known.bits = _bitmap(rest, many)
    return known, rest


STATS = "doc_id bigint, words int, sentences int, loose int, stuffed int, gain_s double, n_s int, gain_l double, n_l int, repeated_s double, repeated_l double"


def text_stats(documents: DataFrame, *, text: str = "text", key: str = "doc_id", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """What each document with words is judged by: words, gains and repetition of its sentences and loose words."""
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    known, rest = corpus_counts(rows, most_pairs)
    # Copies of a text are counted on hashes; few enough of them go to where the texts lie.
    mark = rows.select("doc_id", F.xxhash64("text").alias("h"))
    copied = materialize(mark.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "copied")
    rows = rows.withColumn("h", F.xxhash64("text")).join(small_side(copied), "h", "left").select("doc_id", "text", "h", F.coalesce("copies", F.lit(1)).alias("copies"))
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p.iloc[k : k + TOGETHER] for p in batches for k in range(0, len(p), TOGETHER)):
            text, key = shared.value.asked(_Batch(part["text"].tolist()))
            yield pd.DataFrame({"h": part["h"].to_numpy(dtype=np.int64)[text], "key": key})

    if rest is not None:
        # Copies ask once; a text gets its keys and their counts in one row.
        told = rows.select("h", "text").mapInPandas(ask, "h bigint, key bigint").distinct().join(rest, "key")
        told = told.groupBy("h").agg(F.collect_list("key").alias("keys"), F.collect_list("n").alias("ns"))
        rows = rows.join(told, "h", "left")

    rest_told = rest is not None

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p.iloc[k : k + TOGETHER] for p in batches for k in range(0, len(p), TOGETHER)):
            own, counts = _Batch(part["text"].tolist()), shared.value
            if rest_told:
                told = [(k, n) for k, n in zip(part["keys"], part["ns"]) if k is not None]
                counts = counts.with_rest(np.concatenate([k for k, _ in told]), np.concatenate([n for _, n in told])) if told else counts
            gain, n = counts.gains(own, part["copies"].to_numpy(dtype=np.float64))
            gain, n, again = gain.reshape(-1, 3), n.reshape(-1, 3), _repeated(own).reshape(-1, 3)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "words": own.sizes.sum(axis=1), "sentences": own.sizes[:, SENTENCE], "loose": own.sizes[:, LOOSE], "stuffed": own.stuffed,
                "gain_s": gain[:, SENTENCE], "n_s": n[:, SENTENCE], "gain_l": gain[:, LOOSE], "n_l": n[:, LOOSE], "repeated_s": again[:, SENTENCE], "repeated_l": again[:, LOOSE],
            })

    return rows.mapInPandas(judge, STATS)


def spam_share(documents: DataFrame, *, salad: float = 0.5, hopeless: float = 0.12, again: float = 0.1, often: float = 0.33, **options: object) -> DataFrame:
    """(doc_id, spam, words) of each document that is not null.

    ``salad``, ``hopeless``: shares of the usual gain below which text is incoherent, and incoherent beyond doubt.
    ``again``, ``often``: shares of collocations coming three times or more from which loose words repeat themselves, and
    do so excessively.
    """
    stats = materialize(text_stats(documents, **options), "text-stats")
    usual = stats.where(F.col("n_s") >= 4 * EVIDENCE).agg(F.percentile_approx("gain_s", 0.5, 10_000).alias("m")).first()["m"] or 0.0
    judged = lambda n, of: (F.col(n) >= EVIDENCE) & (F.col(n) >= COVER * F.col(of))
    below = lambda gain, share: F.col(gain) < share * usual
    loose = (judged("n_l", "loose") & ((below("gain_l", salad) & (F.col("repeated_l") >= again)) | below("gain_l", hopeless))) | (F.col("repeated_l") >= often)
    low = judged("n_s", "sentences") & below("gain_s", salad)
    filled = (F.col("stuffed") * 2 > F.col("sentences")) & (low | (F.col("repeated_s") >= often))
    sentences = filled | (low & below("gain_s", hopeless) & (F.col("repeated_s") < often))
    bad = F.when(loose, F.col("loose")).otherwise(0) + F.when(sentences, F.col("sentences")).otherwise(0)
    return stats.select("doc_id", bad.cast("int").alias("spam"), "words")


def spam_pages(documents: DataFrame, **options: object) -> DataFrame:
    """(doc_id) of the documents of which more than half is repeated keywords, links, menus or tags."""
    return spam_share(documents, **options).where(F.col("spam") * 2 > F.col("words")).select("doc_id")
