from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from markwise.operators.instants import moments, with_instant

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(*parts, zone="UTC", fold=0):
    return (datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold) - EPOCH) // timedelta(microseconds=1)


SHANGHAI, BERLIN, YORK, JOHNS, KOLKATA = "Asia/Shanghai", "Europe/Berlin", "America/New_York", "America/St_Johns", "Asia/Kolkata"
CASES = [
    ("2025-09-11T18:22:44+08:00", BERLIN, True, us(2025, 9, 11, 10, 22, 44)),
    ("2025-09-11t18:22:44.5z", BERLIN, True, us(2025, 9, 11, 18, 22, 44, 500000)),
    ("2025-09-11T18:22:44,123456789Z", BERLIN, True, us(2025, 9, 11, 18, 22, 44, 123456)),
    ("20250919T081356+0800", YORK, False, us(2025, 9, 19, 0, 13, 56)),
    ("20260519083150", SHANGHAI, True, us(2026, 5, 19, 8, 31, 50, zone=SHANGHAI)),
    ("２０２５-０７-０３　１０：１１", SHANGHAI, True, us(2025, 7, 3, 10, 11, zone=SHANGHAI)),
    ("2025-W51-4 08:08", YORK, False, us(2025, 12, 18, 8, 8, zone=YORK)),
    ("2026-W53-7 08:08", YORK, False, us(2027, 1, 3, 8, 8, zone=YORK)),
    ("2025-W53-1 08:08", YORK, False, None),
    ("1747667162", SHANGHAI, True, 1747667162 * 10**6),
    ("1750276458824", SHANGHAI, True, 1750276458824 * 10**3),
    ("22/10/2025 21:38:38", KOLKATA, True, us(2025, 10, 22, 21, 38, 38, zone=KOLKATA)),
    ("10/22/2025 21:38:38", YORK, False, us(2025, 10, 22, 21, 38, 38, zone=YORK)),
    ("22/10/2025 21:38:38", YORK, False, None),
    ("22.5.25 15:59", BERLIN, True, us(2025, 5, 22, 15, 59, zone=BERLIN)),
    ("05/06/2025 10:00", BERLIN, None, None),
    ("5/31/2025 8:36:02pm", YORK, False, us(2025, 5, 31, 20, 36, 2, zone=YORK)),
    ("5/31/2025 12:05 am", YORK, False, us(2025, 5, 31, 0, 5, zone=YORK)),
    ("5/31/2025 13:05 pm", YORK, False, None),
    ("Sat, 15 Nov 2025 08:19:25 +0530", BERLIN, True, us(2025, 11, 15, 2, 49, 25)),
    ("23 May 2026 08:53", BERLIN, True, us(2026, 5, 23, 8, 53, zone=BERLIN)),
    ("15. März 2026, 18:17 Uhr", BERLIN, True, us(2026, 3, 15, 18, 17, zone=BERLIN)),
    ("May 15, 2026 9:03:09 PM", YORK, False, us(2026, 5, 15, 21, 3, 9, zone=YORK)),
    ("Sun Jan 19 08:28:49 CST 2025", SHANGHAI, True, us(2025, 1, 19, 8, 28, 49, zone=SHANGHAI)),
    ("Sun Jan 19 08:28:49 CST 2025", "America/Chicago", False, us(2025, 1, 19, 14, 28, 49)),
    ("2025-01-16 14:17:24 IST", KOLKATA, True, us(2025, 1, 16, 8, 47, 24)),
    ("2025-07-16 14:17:24 IST", "Europe/Dublin", True, us(2025, 7, 16, 13, 17, 24)),
    ("2024-10-05 13:32:28 UTC-2:30", JOHNS, False, us(2024, 10, 5, 16, 2, 28)),
    ("2025-12-17 07:35:30 GMT+0", SHANGHAI, True, us(2025, 12, 17, 7, 35, 30)),
    ("2025-11-06T08:46:53+08:00[Asia/Shanghai]", BERLIN, True, us(2025, 11, 6, 0, 46, 53)),
    ("2025-11-06T08:46:53[Asia/Shanghai]", BERLIN, True, us(2025, 11, 6, 0, 46, 53)),
    ("2025-11-06T08:46:53[No/Where]", BERLIN, True, None),
    ("2026年4月22日 下午6:43:03", SHANGHAI, True, us(2026, 4, 22, 18, 43, 3, zone=SHANGHAI)),
    ("2026年4月22日 上午12:43:03", SHANGHAI, True, us(2026, 4, 22, 0, 43, 3, zone=SHANGHAI)),
    ("2026年2月27日 11时45分52秒", SHANGHAI, True, us(2026, 2, 27, 11, 45, 52, zone=SHANGHAI)),
    ("2025-10-26 02:30", BERLIN, True, us(2025, 10, 26, 2, 30, zone=BERLIN, fold=0)),
    ("2025-10-26 02:30:00 CET", BERLIN, True, us(2025, 10, 26, 1, 30)),
    ("2025-03-30 02:30", BERLIN, True, None),
    ("2025-03-30 03:00", BERLIN, True, us(2025, 3, 30, 1, 0)),
    (" 2025-06-28T07:59:39+05:45\n", BERLIN, True, us(2025, 6, 28, 2, 14, 39)),
    ("2025-02-30 10:15:00", BERLIN, True, None),
    ("2024-02-29 10:15", BERLIN, True, us(2024, 2, 29, 10, 15, zone=BERLIN)),
    ("2025-01-14T25:10:00+08:00", BERLIN, True, None),
    ("2025-01-14T10:10:60+08:00", BERLIN, True, None),
    ("2025-01-14T10:10:00+19:00", BERLIN, True, None),
    ("0000-00-00 00:00:00", BERLIN, True, None),
    ("2025-08-08", BERLIN, True, None),
    ("2025-01-14 10:00:00 XYZ", BERLIN, True, None),
    ("2025-01-14 10:00:00", None, True, None),
    ("2025-01-14 10:00:00", "No/Where", True, None),
    ("2025-01-14 10:00:00Z", None, None, us(2025, 1, 14, 10)),
    ("see cover sheet", BERLIN, True, None),
    ("", BERLIN, True, None),
    ("\u0001" * 17, BERLIN, True, None),
    (None, BERLIN, True, None),
    ("2025-01-14 10:00:00 " + "x" * 100_000, BERLIN, True, None),
]


def test_every_notation(spark):
    rows = [(i, *c[:3]) for i, c in enumerate(CASES)]
    got = {r["i"]: r["instant_us"] for r in with_instant(spark.createDataFrame(rows, "i int, t string, z string, d boolean"), "t", "z", "d").collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[3], case


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_session_zone_does_not_matter(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        rows = spark.createDataFrame([("2025-10-26 02:30", BERLIN, True), ("2025-03-09 02:30", BERLIN, True)], "t string, z string, d boolean")
        assert {r["instant_us"] for r in with_instant(rows, "t", "z", "d").collect()} == {us(2025, 10, 26, 2, 30, zone=BERLIN), us(2025, 3, 9, 2, 30, zone=BERLIN)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_repeated_rows_missing_context_clashing_columns_and_empty_tables(spark):
    schema = "attempt_id string, organization_id string, submitted_at string, time_zone string, submitted_us string"
    rows = spark.createDataFrame([("a", "o", "2025-01-14 10:00:00Z", "x", "y")] * 2 + [("b", "lost", "2025-01-14 10:00", "x", "y"), ("c", None, "1747667162", "x", "y"), (None, "o", None, "x", "y")], schema)
    settings = spark.createDataFrame([("o", BERLIN, True, 1)], "organization_id string, time_zone string, day_first boolean, attempt_id int")
    found = moments(rows, settings, "attempt_id", "submitted_at", "organization_id")
    assert sorted(map(tuple, found.collect())) == [("a", us(2025, 1, 14, 10)), ("c", 1747667162 * 10**6)]
    assert moments(rows.limit(0), settings, "attempt_id", "submitted_at", "organization_id").count() == 0
    assert moments(rows, settings.limit(0), "attempt_id", "submitted_at", "organization_id").count() == 2


def test_moments_lie_before_their_arrival(spark, data):
    from markwise.sources.tables import table

    attempts = table(spark, data, "attempts")
    found = moments(attempts, table(spark, data, "org_settings"), "attempt_id", "submitted_at", "organization_id")
    late = found.join(attempts, "attempt_id").where("submitted_us > unix_micros(cast(received_at as timestamp))")
    assert found.count() > 0.8 * attempts.select("attempt_id").distinct().count() and late.count() == 0


def test_padding_and_long_fractions(spark):
    from markwise.operators.instants import with_instant

    texts = [" " * 200 + "2026-03-01 10:00:00Z" + "\u3000\t\ufeff" * 100, "2026-03-01T10:00:00.123456789012Z", "2026-03-01T10:00:00," + "1234567" * 100 + "Z", "1772359200.5000000000001", "2026-03-01 10:00:00Z" + " " * 200_000 + "x"]
    frame = spark.createDataFrame([(i, t, "UTC", True) for i, t in enumerate(texts)], "id int, text string, zone string, day_first boolean")
    at = 1_772_359_200_000_000
    assert [r["instant_us"] for r in with_instant(frame, "text", "zone", "day_first").orderBy("id").collect()] == [at, at + 123456, at + 123456, at + 500000, None]
