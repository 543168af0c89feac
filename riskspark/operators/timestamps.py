"""Normalising timestamps written in mixed formats and time zones.

Distinct (raw text, zone, date order) combinations form a dictionary that is parsed once,
kept in the shared folder and extended by what new rows add; rows get their instant by a join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, small_side
from ..store import Store, bucket_count

# Month names of the supported languages, by month.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
# Short forms that are not the first three letters.
MONTH_SHORT = {"sept": 9, "janv": 1, "févr": 2, "fevr": 2, "avr": 4, "juil": 7, "déc": 12, "dez": 12, "dic": 12, "ene": 1, "abr": 4, "ago": 8, "okt": 10, "mär": 3, "mrz": 3, "maerz": 3, "fév": 2, "aoû": 8, "setiembre": 9, "jänner": 1}
# Usual meaning of zone names, in minutes east of UTC.
ZONE_NAMES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "sast": 120, "cat": 120, "eat": 180, "gst": 240, "pkt": 300, "ist": 330, "npt": 345,
    "ict": 420, "wib": 420, "sgt": 480, "hkt": 480, "pht": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "brt": -180, "brst": -120, "art": -180, "ast": -240, "adt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "hst": -600,
}
EPOCH = datetime(1970, 1, 1)
UTC = timezone.utc
_TIME = re.compile(
    r"(?<![\d:.+-])(\d{1,2})\s*(?:[:h]|\.(?=\d\d\b(?!\.)))\s*(\d{2})(?:\s*[:m]\s*(\d{2})(?:[.,]\d+)?)?\s*(uhr\b)?\s*([ap])?(?(5)\.?m\b\.?)", re.I
)
_ISO = re.compile(r"(\d{4})([-/.]?)(\d{2})\2(\d{2})[t ]\s*(\d{2})(:?)(\d{2})(?:\6(\d{2})(?:[.,]\d+)?)?\s*(.*)", re.I)
_OFFSET = re.compile(r"(?:utc|gmt)?\s*([+-])(\d{1,2})(?::?(\d{2}))?$")


def _months() -> dict[str, int]:
    out = dict(MONTH_SHORT)
    for names in MONTH_NAMES.values():
        for i, full in enumerate(names.split(), 1):
            out[full] = i
            out.setdefault(full[:3], i)
    return out


MONTHS = _months()


@lru_cache(maxsize=None)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=None)
def _names_of(zone: str) -> dict[str, int]:
    """The zone names a zone itself uses, with their offsets in minutes; the latest use counts."""
    tz, out = _zone(zone), {}
    if tz is None:
        return out
    for month in range(12 * 60):
        at = datetime(1980 + month // 12, month % 12 + 1, 15, tzinfo=tz)
        name = (at.tzname() or "").lower()
        if name.isalpha():
            out[name] = int(at.utcoffset().total_seconds() // 60)
    return out


def _offset(text: str, zone: str | None) -> int | None:
    """Minutes east of UTC that a zone text states; None if it states none that is known."""
    text = text.strip().strip("()[]").lower()
    if m := _OFFSET.fullmatch(text):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if hours > 15 or minutes > 59:
            return None
        return (hours * 60 + minutes) * (1 if m[1] == "+" else -1)
    own = _names_of(zone) if zone else {}
    return own.get(text, ZONE_NAMES.get(text))


def _epoch(parts: tuple[int, ...], zone_text: str, zone: str | None) -> int | None:
    """Seconds since 1970 of a wall-clock time; skipped and impossible times give None."""
    try:
        wall = datetime(*parts)
    except ValueError:
        return None
    if zone_text.strip():
        minutes = _offset(zone_text, zone)
        if minutes is None:
            return None
        at = wall - timedelta(minutes=minutes)
    else:
        tz = _zone(zone) if zone else None
        if tz is None:
            return None
        at = wall.replace(tzinfo=tz, fold=0).astimezone(UTC).replace(tzinfo=None)
        if at.replace(tzinfo=UTC).astimezone(tz).replace(tzinfo=None) != wall:
            return None
    return int((at - EPOCH).total_seconds())


def _number(text: str) -> int | None:
    """Bare numbers count from 1970 in UTC, in a unit told by their length; eight digits are a date."""
    whole = text.split(".")[0].lstrip("-")
    n = len(whole)
    if n == 14 and "." not in text and whole[:2] in ("19", "20"):
        return None
    if not 9 <= n <= 20:
        return None
    power = 0 if n <= 11 else 3 if n <= 14 else 6 if n <= 17 else 9
    value = int(whole) // 10**power
    return -value if text.startswith("-") else value


def parse_moment(raw: str | None, zone: str | None, order: str | None) -> int | None:
    """Seconds since 1970 (UTC) that ``raw`` states, read on the clock of ``zone``.

    ``order`` (dmy, mdy, ymd) tells numeric days from months unless the year comes first. A local time
    that occurs twice means the earlier one. None for values that are missing, not a time, without a
    time of day, impossible, or skipped by the local clock.
    """
    if raw is None:
        return None
    text = unicodedata.normalize("NFKC", raw)
    text = " ".join("".join(c for c in text if unicodedata.category(c) != "Cf").split())
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        if m := re.fullmatch(r"((?:19|20)\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", text):
            return _epoch(tuple(map(int, m.groups())), "", zone)
        return _number(text)
    if m := _ISO.fullmatch(text):
        y, mo, d, h, mi, s = (int(x or 0) for x in m.group(1, 3, 4, 5, 7, 8))
        rest = m[9].strip()
        if not re.match(r"[ap]\.?m", rest, re.I):
            return _epoch((y, mo, d, h, mi, s), rest, zone)
    low = text.lower()
    m = _TIME.search(low)
    if not m:
        return None
    hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
    if m[5]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if m[5] == "p" else 0)
    before, after = low[: m.start()], low[m.end() :].strip(" ,")
    if not re.search(r"\d", before):  # the time stands first
        if z := re.match(r"([a-z]{1,5}|[+-]\d\d:?\d\d)\b\s*,?\s+(?=.*\d{4})", after):
            if z[1][:3] not in MONTHS and _offset(z[1], zone) is not None:
                before, after = before + " " + after[z.end() :], z[1]
            else:
                before, after = before + " " + after, ""
        else:
            before, after = before + " " + after, ""
    else:
        if y := re.fullmatch(r"(.*?)\s*\b(\d{4})", after):  # the year stands last, as in ctime
            if not re.search(r"\b\d{4}\b", before):
                before, after = before + " " + y[2], y[1]
    words = re.findall(r"\d+|[^\W\d_]+", before)
    numbers = [w for w in words if w.isdigit()]
    named = [MONTHS[w] for w in words if w in MONTHS and w not in ("mar", "mai") or w in ("mar", "mai") and len(numbers) == 2]
    try:
        if named and len(numbers) == 2:
            month = named[-1]
            day, year = (numbers[1], numbers[0]) if len(numbers[0]) == 4 else numbers
        elif len(numbers) == 3 and not named:
            if len(numbers[0]) == 4:
                year, month, day = numbers
            elif len(numbers[2]) == 4:
                day, month, year = numbers if order == "dmy" or order is None else (numbers[1], numbers[0], numbers[2])
            else:
                return None
        else:
            return None
        if len(str(year)) != 4:
            return None
        return _epoch((int(year), int(month), int(day), hour, minute, second), after, zone)
    except ValueError:
        return None


def parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        got = [parse_moment(r, z or None, o or None) for r, z, o in zip(part["raw"], part["zone"], part["date_order"])]
        yield part.assign(epoch_s=pd.array(got, dtype="Int64"))


DICT_SCHEMA = "key bigint, raw string, zone string, date_order string, epoch_s bigint"
_PARTS = ("raw", "zone", "date_order")


def _keyed(rows: DataFrame) -> DataFrame:
    """Null zones and orders are empty ones, so that equal readings have equal keys."""
    own = rows.select(*[c for c in rows.columns if c not in _PARTS[1:]], *[F.coalesce(c, F.lit("")).alias(c) for c in _PARTS[1:]])
    return own.withColumn("key", F.xxhash64(*_PARTS))


class TimestampDictionary:
    """Distinct raw timestamps with their instants, a store that grows by appends and can be opened again at its path.

    Entries are parted by a hash, so that an extension reads only the parts its new texts fall into. The
    language of a source is no part of the key: no month name of one supported language means another
    month in a second one, so the languages are read together.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.store = Store(spark, path, "timestamps")
        self.path = self.store.path

    def read(self) -> DataFrame:
        return self.store.read("entries", DICT_SCHEMA)

    def extend(self, rows: DataFrame) -> None:
        """Parse what ``rows`` (raw, zone, date_order) add to the dictionary. Null texts are left out."""
        store = self.store
        new = _keyed(rows.where(F.col("raw").isNotNull()).select(*_PARTS)).distinct()
        if not store.steps:
            store.buckets = bucket_count(new.count())
        else:
            new = materialize(new, "timestamps-new")
            known = store.read("entries", DICT_SCHEMA, store.touched(new)).select("key", *_PARTS)
            hits = known.join(small_side(new), ["key", *_PARTS], "left_semi")
            new = new.join(hits, ["key", *_PARTS], "left_anti")
        store.begin()
        store.write(new.mapInPandas(parse_batches, DICT_SCHEMA), "entries", store.bucket(F.col("key")))
        store.publish()


def normalise_timestamps(
    records: DataFrame, sources: DataFrame, *, raw: str = "published", key: str = "record_id", dictionary: TimestampDictionary | None = None
) -> DataFrame:
    """``records`` (key, raw, source) to (key, epoch_s) for each row whose raw text states a moment.

    Rows whose text is null, senseless, without a time of day, impossible or skipped by the clock are
    left out; repeated rows come out as often as they come in; an empty table gives an empty result.
    A source missing from ``sources`` has no clock: only texts that state their zone are read.
    """
    own = sources.select(F.col("source").alias("_s"), F.col("tz").alias("zone"), "date_order").dropDuplicates(["_s"])
    rows = records.select(F.col(key).alias("_id"), F.col(raw).alias("raw"), F.col("source").alias("_src")).where(F.col("raw").isNotNull())
    rows = _keyed(rows.join(own, F.col("_src") == F.col("_s"), "left").select("_id", *_PARTS))
    dictionary = dictionary or TimestampDictionary(records.sparkSession)
    dictionary.extend(rows)
    known = dictionary.read().where(F.col("epoch_s").isNotNull())
    return rows.join(known, ["key", *_PARTS]).select(F.col("_id").alias(key), "epoch_s")


def utc_text(epoch_s: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of seconds since 1970, whatever the session's zone."""
    at = F.timestamp_add("SECOND", epoch_s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
