"""Texts cut off by a field limit or in mid-transfer.

Per source the lengths of own texts are fitted with a log-normal distribution by maximum likelihood, in
which lengths heaped at a candidate limit count as right-censored; this gives the posterior of being censored
at a length. How a text ends is the other evidence: what endings cuts leave is seen by cutting every text of the
corpus at a random place, what endings whole texts have is what remains of the endings at lengths that are no
limit. Mid-word fragments and words that only join others, with which no whole text ends, give the rates of cuts
in mid-transfer at any letter, at a word's end, and at a word's end with an ellipsis. Both together give the
probability that a text was cut: neither an odd ending nor a limit decides alone.

Defined results: null, empty and blank bodies and bodies of site lines alone are not cut; an article is
judged once however often delivered; a null source is a source of its own; a text that ends with a sentence's
full stop is not cut in mid-sentence wherever it ends; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .lines import own_lines

_STOP = re.compile(r"(?:[.!?]|[。！？])[\"'”’»)\]]*$")
_DOTS = re.compile(r"(?:\.\.+|…)[\"'”’»)\]]*$")
_LABEL = re.compile(r"(?:[-–—*•©]\s|[^\W\d_][^.!?:]{1,48}:\s)")
# A full stop after a single letter or a capital and up to two letters more may be an abbreviation's.
_SHORT = re.compile(r"(?:^|[\s(\"“.])(?:[^\W\d_]|[^\W\d_a-z][^\W\d_]{1,2})\.$")
_LAST = re.compile(r"[^\W\d_]+$")
_MARK = re.compile(r"[\s.…\"'”’»)\]]+$")
ENDS = "article_id bigint, source string, length int, ending string, form string, last string, made boolean"


def _shape(line: str) -> str:
    """A line with its names and numbers masked."""
    line = re.sub(r"\d[\d.,]*", "9", line)
    return re.sub(r"(?:[^\W\d_a-z][\w'’-]*)(?:\s+[^\W\d_a-z][\w'’-]*)*", lambda m: "N" if m.start() or " " in m[0] else m[0], line)


def ending(line: str) -> str:
    """stop, short (a stop that may be an abbreviation's), dots (an ellipsis), note (a credit, figure or bracket that needs no full stop) or open."""
    text = "".join(c for c in line if unicodedata.category(c) != "Cf").strip()
    if _DOTS.search(text):
        return "dots"
    if _STOP.search(text):
        return "short" if _SHORT.search(text) else "stop"
    if text[:1] in "([":
        return "note" if text[-1:] in ")]" else "open"
    if _LABEL.match(text) and not re.search(r"[.!?]\s+\S", text):
        return "note"
    return "open"


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each own text ends, and how it would if it were cut at a place drawn by a hash of its id."""
    for part in batches:
        out = []
        for a, source, lines, site in zip(part["article_id"], part["source"], part["lines"], part["site"]):
            skip = set(site)
            own = [i for i in range(len(lines)) if i + 1 not in skip and lines[i].strip()]
            if not own:
                continue
            total = sum(len(lines[i]) for i in own)
            at = (a * 0x9E3779B97F4A7C15 + 0x7FB5D329 & (1 << 64) - 1) % max(1, total - 1) + 1
            for i in own:
                if at <= len(lines[i]):
                    break
                at -= len(lines[i])
            last = own[-1] + 1
            for line, made in ((lines[last - 1], False), (lines[i][:at], True)):
                how = ending(line) if line.strip() else "stop"
                word = _LAST.search(line.rstrip() if how == "open" else _MARK.sub("", line)) if how in ("open", "dots") else None
                out.append((a, source, sum(map(len, lines[:last])) + last - 1, how, _shape(line.strip()) if how in ("open", "dots") else None, word[0].lower() if word else None, made))
        yield pd.DataFrame(out, columns=["article_id", "source", "length", "ending", "form", "last", "made"])


def _pdf(z: float) -> float:
    return math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _beyond(z: float) -> float:
    return max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))


def censoring(lengths: np.ndarray, counts: np.ndarray, *, heap: int = 5, times: float = 6.0, rounds: int = 30) -> np.ndarray:
    """Posterior that a text of each length was censored there; 0 at lengths that are no candidate limit.

    A candidate holds at least ``heap`` texts and ``times`` what its neighbourhood (5 percent) lets expect.
    """
    order = np.argsort(lengths)
    back = np.argsort(order)
    x, n = lengths[order].astype(float), counts[order].astype(float)
    x = np.maximum(x, 1)
    total = np.r_[0, np.cumsum(n)]
    low, high = np.searchsorted(x, x * 0.95), np.searchsorted(x, x * 1.05, side="right")
    width = np.maximum(1, x * 0.1)
    usual = (total[high] - total[low] - n) / width
    limit = (n >= heap) & (n > times * np.maximum(usual, 0.02) + 2)
    post = np.where(limit, 0.9, 0.0)
    if not limit.any():
        return post[back]
    logs = np.log(x)
    mu, sd = float(np.average(logs, weights=n)), max(0.1, float(np.sqrt(np.average((logs - np.average(logs, weights=n)) ** 2, weights=n))))
    for _ in range(rounds):
        cut, whole = n * post, n * (1 - post)
        z = (logs - mu) / sd
        hazard = np.array([_pdf(v) / _beyond(v) if c else 0.0 for v, c in zip(z, cut)])
        first = np.where(cut > 0, mu + sd * hazard, 0.0)  # mean of the log length beyond the limit
        second = np.where(cut > 0, sd * sd * (1 + z * hazard) + mu * mu + 2 * mu * sd * hazard, 0.0)
        weight = n.sum()
        mu_new = float((whole * logs + cut * first).sum() / weight)
        var = float((whole * logs**2 + cut * second).sum() / weight) - mu_new**2
        mu, sd = mu_new, math.sqrt(max(var, 0.01))
        z = (logs - mu) / sd
        expected = weight * np.array([_pdf(v) for v in z]) / (sd * x)  # whole texts of just this length
        post = np.where(limit, np.clip(1 - expected / n, 0, 0.999), 0.0)
    return post[back]


def _posterior(part: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram of lengths, to the posterior of each length."""
    part = part.assign(posterior=censoring(part["length"].to_numpy(), part["n"].to_numpy()))
    return part[part["posterior"] > 0][["source", "length", "posterior"]]


def _kinds(kept: DataFrame, ends: DataFrame, frequent: float) -> tuple[DataFrame, float]:
    """``ends`` with open endings told apart, and the share of words that only join others.

    Kinds are fragment (a word the corpus does not have besides), joint (a word so frequent that it only joins others,
    or no letter) and word; an ellipsis after a joining word is dots-joint.
    """
    # Counts of all words of the corpus, as hashes; the word that a text ends with counts itself.
    words = kept.select(F.explode(F.regexp_extract_all(F.lower(F.array_join("lines", " ")), F.lit(r"\p{L}+"), 0)).alias("w")).groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("n"))
    words = materialize(words, "text-words")
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 1
    often = F.col("n") >= frequent * total
    share = (words.where(often).agg(F.sum("n").alias("n")).first()["n"] or 0) / total
    asked = ends.where(F.col("last").isNotNull()).select(F.xxhash64("last").alias("h")).distinct()
    known = words.join(asked, "h", "left_semi")
    out = ends.withColumn("h", F.xxhash64("last")).join(known, "h", "left").drop("h")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("made"), 0).otherwise(1)
    kind = F.when(F.col("last").isNull() | often, "joint").when(others < 2, "fragment").otherwise("word")
    kind = F.when(F.col("ending") == "open", kind).when((F.col("ending") == "dots") & often, "dots-joint").otherwise(F.col("ending"))
    return out.withColumn("ending", kind).drop("n", "last"), share


def cut_probability(articles: DataFrame, *, closing_share: float = 0.005, frequent: float = 0.004) -> DataFrame:
    """(article_id, source, length, ending, probability) of each article with own text.

    ``closing_share``: a masked line that makes up at least this share of all lines that end texts without a stop is
    a habitual close, a note; there can be no more than ``1 / closing_share`` such lines. ``frequent``: share of all
    words from which a word counts as one that only joins others.
    """
    kept = own_lines(articles).select("article_id", F.coalesce("source", F.lit("")).alias("source"), "lines", "site")
    kept = materialize(kept, "own-lines")
    ends = materialize(kept.mapInPandas(_endings, ENDS), "text-ends")
    open_ends = ends.where(F.col("form").isNotNull() & ~F.col("made"))
    forms = open_ends.groupBy("form").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    total = open_ends.count()
    usual = [r["form"] for r in forms.where((F.col("n") >= max(5, closing_share * total)) & (F.col("s") >= 2)).collect()]
    ends, joining = _kinds(kept, ends, frequent)
    if usual:
        ends = ends.withColumn("ending", F.when(F.col("form").isin(usual), F.lit("note")).otherwise(F.col("ending")))
    # The histogram is counted before it is gathered, a source at a time.
    own = ends.where(~F.col("made"))
    histogram = own.groupBy("source", "length").agg(F.count("*").alias("n"))
    posterior = histogram.groupBy("source").applyInPandas(_posterior, "source string, length int, posterior double")
    own = materialize(own.join(posterior, ["source", "length"], "left").withColumn("limit", F.coalesce("posterior", F.lit(0.0))).drop("posterior"), "text-limits")
    made = {r["ending"]: r["n"] for r in ends.where("made").groupBy("ending").agg(F.count("*").alias("n")).collect()}
    seen = {(r["ending"], r["at"]): r["n"] for r in own.groupBy("ending", (F.col("limit") > 0).alias("at")).agg(F.count("*").alias("n")).collect()}
    rate, ratio = evidence(made, {e: n for (e, at), n in seen.items() if not at}, joining)
    weight = F.lit(0.0)  # a sentence's full stop is not in mid-sentence
    for name, value in ratio.items():
        weight = F.when(F.col("ending") == name, F.lit(value)).otherwise(weight)
    limit = F.col("limit") + (1 - F.col("limit")) * rate
    scored = own.withColumn("_o", limit / (1 - limit) * weight)
    return scored.select("article_id", "source", "length", "ending", (F.col("_o") / (1 + F.col("_o"))).alias("probability"))


def evidence(made: dict[str, int], free: dict[str, int], joining: float) -> tuple[float, dict[str, float]]:
    """The rate of cuts in mid-transfer, and for each ending how much likelier a cut text shows it than a whole one.

    ``made``: endings that cuts at random letters leave. ``free``: endings of the texts at lengths that are no limit.
    ``joining``: share of words that only join others. What fragments and joining words tell of the rates of the three
    kinds of cut gives the number of other endings that cuts explain; the rest of those belong to whole texts.
    """
    n, every = max(1, sum(free.values())), sum(made.values()) + 3.5
    left = {e: (made.get(e, 0) + 0.5) / every for e in ("fragment", "joint", "word", "note", "short")}
    joining = min(max(joining, 0.01), 0.99)
    seen = {e: (free.get(e, 0) + 0.5) / n for e in ("fragment", "joint", "dots-joint")}
    letter = seen["fragment"] / left["fragment"]
    word = max(0.0, seen["joint"] - letter * left["joint"]) / joining
    dots = seen["dots-joint"] / joining
    rate = min(0.5, letter + word + dots)
    cut = seen | {"word": letter * left["word"] + word * (1 - joining), "note": letter * left["note"], "short": letter * left["short"], "dots": dots * (1 - joining)}
    whole = {e: 0.5 / n if e in seen else max(0.5, free.get(e, 0) - n * share) / n for e, share in cut.items()}
    return rate, {e: cut[e] / (letter + word + dots) / (whole[e] / (1 - rate)) for e in cut}


def truncated(articles: DataFrame, **options: float) -> DataFrame:
    """(article_id) of the articles that were cut in mid-word or mid-sentence."""
    return cut_probability(articles, **options).where(F.col("probability") > 0.5).select("article_id")


def truncation_by_source(articles: DataFrame, **options: float) -> DataFrame:
    """(source, articles, cut, share) per source; the null source is the empty string."""
    p = cut_probability(articles, **options).groupBy("source").agg(F.count("*").alias("articles"), F.count_if(F.col("probability") > 0.5).alias("cut"))
    return p.withColumn("share", F.round(F.col("cut") / F.col("articles"), 6))
