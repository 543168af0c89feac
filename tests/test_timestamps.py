from datetime import datetime, timezone

import pytest

from riskspark.operators.timestamps import TimestampDictionary, normalise_timestamps, parse_moment, utc_text

CASES = [
    ("2024-05-01T10:00:00Z", "Europe/Berlin", "dmy", "2024-05-01T10:00:00Z"),
    ("2024-05-01 10:00", "Europe/Berlin", "dmy", "2024-05-01T08:00:00Z"),
    ("03/04/2024 05:06", "Europe/London", "dmy", "2024-04-03T04:06:00Z"),
    ("03/04/2024 05:06 PM", "America/New_York", "mdy", "2024-03-04T22:06:00Z"),
    ("12/31/2024 12:05 AM", "UTC", "mdy", "2024-12-31T00:05:00Z"),
    ("2024/03/04 05:06", "Asia/Tokyo", "dmy", "2024-03-03T20:06:00Z"),
    ("30 de marzo de 2025, 01:49", "Europe/Madrid", "dmy", "2025-03-30T00:49:00Z"),
    ("29 octobre 2023 à 02h13", "Europe/Paris", "dmy", "2023-10-29T00:13:00Z"),  # twice: the earlier one
    ("30. März 2025, 14:05 Uhr", "Europe/Berlin", "dmy", "2025-03-30T12:05:00Z"),
    ("Sun, 31 Mar 2024 02:55:00 BST", "Europe/London", "dmy", "2024-03-31T01:55:00Z"),
    ("2025-07-07 14:21:51 IST", "Asia/Kolkata", "dmy", "2025-07-07T08:51:51Z"),
    ("2025-05-31 18:29:56 CST", "Asia/Shanghai", "ymd", "2025-05-31T10:29:56Z"),
    ("2025-05-31 18:29:56 CST", "America/Chicago", "mdy", "2025-06-01T00:29:56Z"),
    ("Nov 9, 2025 9:55 PM CST", "Europe/Berlin", "dmy", "2025-11-10T03:55:00Z"),
    ("1747554997419", None, None, "2025-05-18T07:56:37Z"),
    ("1748782767.968", None, None, "2025-06-01T12:59:27Z"),
    ("1747249528076233", None, None, "2025-05-14T19:05:28Z"),
    ("20250509T234332Z", None, None, "2025-05-09T23:43:32Z"),
    ("2025-06-13T21:37:21.676154114-04:00", None, None, "2025-06-14T01:37:21Z"),
]
NONE = [None, "", "--", "n/a", "yesterday", "spring 2024", "2024-05-01", "20250516", "18 August 2025", "2023-02-30 11:15:00", "2024-13-45T99:00:00Z", "0000-00-00 00:00:00", "x" * 100_000, "9" * 5000]


@pytest.mark.parametrize("raw,zone,order,want", CASES)
def test_moments(raw, zone, order, want):
    got = parse_moment(raw, zone, order)
    assert datetime.fromtimestamp(got, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") == want


@pytest.mark.parametrize("raw", NONE)
def test_no_moment(raw):
    assert parse_moment(raw, "Europe/Berlin", "dmy") is None


def test_skipped_by_the_clock():
    assert parse_moment("2024-03-31 02:30:00", "Europe/Berlin", "dmy") is None
    assert parse_moment("2024-03-31 02:30:00", None, "dmy") is None


def test_operator(spark):
    rows = spark.createDataFrame([(1, "2024-05-01 10:00", "a", "x"), (1, "2024-05-01 10:00", "a", "x"), (2, "2024-05-01 10:00", None, None), (3, None, "a", "x"), (None, "1747554997", "a", "x")], "record_id long, published string, source string, raw string")
    sources = spark.createDataFrame([("a", "Europe/Berlin", "dmy", "de", "z"), ("a", "Europe/Berlin", "dmy", "de", "z"), (None, None, None, None, None)], "source string, tz string, date_order string, lang string, zone string")
    from pyspark.sql import functions as F

    got = normalise_timestamps(rows, sources).select("record_id", utc_text(F.col("epoch_s")).alias("t")).collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, "2025-05-18T07:56:37Z"), (1, "2024-05-01T08:00:00Z"), (1, "2024-05-01T08:00:00Z")]
    assert normalise_timestamps(rows.limit(0), sources).count() == 0


def test_dictionary_is_kept_and_opened_again(spark, tmp_path):
    rows = lambda *texts: spark.createDataFrame([(t, "UTC", "dmy") for t in texts], "raw string, zone string, date_order string")
    at = f"file://{tmp_path}/dictionary"
    first = TimestampDictionary(spark, at)
    first.extend(rows("2024-05-01 10:00"))
    first.extend(rows("2024-05-01 10:00"))
    again = TimestampDictionary(spark, at)
    assert again.read().count() == 1 and again.store.steps == 2
    again.extend(rows("2024-05-01 10:00", "2024-05-02 10:00", "no time"))
    assert TimestampDictionary(spark, at).read().count() == 3
    with pytest.raises(RuntimeError):  # the first object does not know of the step the second wrote
        first.extend(rows("2024-05-03 10:00"))
    assert TimestampDictionary(spark, at).read().count() == 3
