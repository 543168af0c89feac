"""Text functions on columns. Null in, null out, unless the docstring says otherwise."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import EDGE_LEFT, EDGE_RIGHT, INDUSTRIES, OUTLET_TRUST, OTHER_TRUST, any_of

# Patterns of what is no article text. Dots match line feeds, so the first ones run to the text's end.
BOILERPLATE = [
    r"(?i)subscribe\s+to\s+our\s+newsletter.*",
    r"(?i)click\s+here\s+to\s+(read|view|subscribe).*",
    r"(?i)copyright\s+©?\s*\d{4}.*",
    r"(?i)all\s+rights\s+reserved.*",
    r"(?i)this\s+article\s+(originally\s+)?appeared.*",
    r"(?i)read\s+more\s*:.*",
    r"(?i)related\s+articles?\s*:.*",
    r"(?i)advertisement\s*",
    r"(?i)sponsored\s+content\s*",
    r"(?i)\bvia\s+(reuters|ap|afp|bloomberg)\b.*?(?=\.|$)",
    r"https?://\S+",
    r"\[\+\d+\s+chars\]",
    r"(?m)^\s*by\s+[A-Z][a-z]+\s+[A-Z][a-z]+\s*$",
    r"(?m)^\s*\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\s*$",
    r"<[^>]+>",
    r"&[a-zA-Z]{2,6};",
]
# Typographic signs and what stands for them.
TYPOGRAPHIC = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ", "…": "..."}


def _unescape_nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")


def unescape_nfkc(text: Column) -> Column:
    """Entities resolved, then compatibility composition: neither has a built-in function."""
    return F.pandas_udf(_unescape_nfkc, "string")(text)


def boilerplate_pattern(patterns: list[str] | None = None, *, line_scoped: bool = False) -> str:
    """All patterns as one alternation, so that what one removes exposes nothing to another; case matters nowhere, as with one flag for all.

    ``line_scoped`` lets those that run to the end stop at the line.
    """
    return ("(?im)" if line_scoped else "(?ims)") + "|".join(f"(?:{p.removeprefix('(?i)').removeprefix('(?m)')})" for p in patterns or BOILERPLATE)


def strip_boilerplate(text: Column, patterns: list[str] | None = None, *, line_scoped: bool = False) -> Column:
    """Without the patterns, each find replaced by a blank."""
    return F.regexp_replace(text, boilerplate_pattern(patterns, line_scoped=line_scoped), " ")


def collapse(text: Column) -> Column:
    """Runs of blanks to one, three and more line feeds to two, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_text(text: Column, **options: bool) -> Column:
    text = unescape_nfkc(text)
    for a, b in TYPOGRAPHIC.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return collapse(strip_boilerplate(text, **options))


def strip_tags(text: Column, most: int = 500) -> Column:
    """Feed summaries: tags to blanks, blanks collapsed, the first ``most`` characters (the feed's field length)."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " ")), 1, most)


def split_sentences(text: Column) -> Column:
    """At blanks between a sentence's end and a capital letter."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def usable_sentences(text: Column, *, least: int = 40, most: int = 12) -> Column:
    """The first ``most`` sentences of ``least`` letters or more: what the summaries take as input."""
    return F.slice(F.filter(split_sentences(text), lambda s: F.length(s) >= least), 1, most)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) * 0.75).cast("int")


def input_text(title: Column, sentences: Column, *, most: int = 512) -> Column:
    """Title and body for an encoder; a longer body is cut at a word's end."""
    body = F.array_join(sentences, "  ")
    cut = F.concat(F.regexp_replace(F.substring(body, 1, most), " [^ ]*$", ""), F.lit("..."))
    return F.concat(F.lit("[TITLE] "), title, F.lit("  [BODY] "), F.when(F.length(body) > most, cut).otherwise(body))


def normalise_entity(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), r"['’]s$", ""), r"(?i)^(?:the|an|a)\s+", ""))


def clean_sentence(text: Column, most: int = 320) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most), r"\s+\S*$", ""), F.lit("…"))).otherwise(t)


def is_usable(text: Column) -> Column:
    return (F.size(F.split(F.trim(text), r"\s+")) >= 6) & ~text.rlike(r"^[\d\W]+$")


def tokens(text: Column, least: int = 3) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},}}"), 0)


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("int")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_-]", "")


def industry(text: Column) -> Column:
    """The first industry with a word of its list standing alone, or a phrase of it as substring; else general. Null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("general")
    for name, words in reversed(INDUSTRIES.items()):
        single, phrases = [w for w in words if " " not in w], [w for w in words if " " in w]
        hit = low.rlike(EDGE_LEFT + any_of(single) + EDGE_RIGHT)
        hit = hit | low.rlike(any_of(phrases)) if phrases else hit
        out = F.when(hit, name).otherwise(out)
    return out


def outlet_trust(source: Column) -> Column:
    """Trust of the first outlet that is part of the source's name. Null counts as unknown."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return reduce(lambda e, kv: F.when(F.contains(low, F.lit(kv[0])), kv[1]).otherwise(e), reversed(OUTLET_TRUST.items()), F.lit(OTHER_TRUST))


def parse_reply(text: Column, schema: str) -> Column:
    """The first braces of a model's reply as a struct; null if they hold no object of the schema."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")), schema)
