from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pandas as pd

from folioflow.functions.timestamps import normalise_dates, to_utc_us


def us(*a, zone=None, fold=0):
    d = datetime(*a, tzinfo=ZoneInfo(zone) if zone else UTC, fold=fold)
    return int((d.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000


CASES = [
    ("2022-01-19T20:26:06Z", None, "en-GB", us(2022, 1, 19, 20, 26, 6)),
    ("2022-01-19T20:26:06", "Europe/Berlin", "de-DE", us(2022, 1, 19, 20, 26, 6, zone="Europe/Berlin")),
    ("2022-01-19T20:26:06", None, "de-DE", None),
    ("2022-01-19 20:26:06 GMT", None, "en-GB", us(2022, 1, 19, 20, 26, 6)),
    ("2025-12-02T15:04:16-05:00[America/New_York]", None, None, us(2025, 12, 2, 20, 4, 16)),
    ("2021-10-22 08:36:53.7+0100", None, None, us(2021, 10, 22, 7, 36, 53) + 700_000),
    ("2021-10-22T08:36:53.123456789", "UTC", None, us(2021, 10, 22, 8, 36, 53) + 123_456),
    ("20220708231420", "UTC", None, us(2022, 7, 8, 23, 14, 20)),
    ("20241029T065603Z", None, None, us(2024, 10, 29, 6, 56, 3)),
    ("1613773046", None, None, 1613773046 * 10**6),
    ("1744005723435", None, None, 1744005723435000),
    ("12/05/2022 11:00", "UTC", "en-GB", us(2022, 5, 12, 11)),
    ("12/05/2022 11:00 PM", "UTC", "en-US", us(2022, 12, 5, 23)),
    ("3/22/2022 12:15 AM", "UTC", "es-US", us(2022, 3, 22, 0, 15)),
    ("25.1.23 08:44", "UTC", "de-DE", us(2023, 1, 25, 8, 44)),
    ("14. Februar 2022, 15:09", "UTC", "de-DE", us(2022, 2, 14, 15, 9)),
    ("23 de enero de 2026, 6:53 AM", "UTC", "es-US", us(2026, 1, 23, 6, 53)),
    ("March 31, 2026 6:15 PM", "UTC", "en-US", us(2026, 3, 31, 18, 15)),
    ("2024年02月23日 04:04", "Asia/Tokyo", "ja-JP", us(2024, 2, 23, 4, 4, zone="Asia/Tokyo")),
    ("Sat, 09 Apr 2022 05:49:14 +0200", None, None, us(2022, 4, 9, 3, 49, 14)),
    ("2024-08-25", "Europe/Berlin", None, us(2024, 8, 24, 22)),
    ("2023-10-29 02:30", "Europe/Berlin", None, us(2023, 10, 29, 0, 30)),  # twice: the earlier
    ("2023-10-29 02:30:00 CET", "Europe/Berlin", None, us(2023, 10, 29, 1, 30)),  # named: the later
    ("2023-03-26 02:30", "Europe/Berlin", None, us(2023, 3, 26, 1, 30)),  # skipped: the offset before
    ("2023-02-30 10:15", "UTC", None, None),
    ("2024-13-05T08:00:00", "UTC", None, None),
    ("0000-00-00T00:00:00Z", "UTC", None, None),
    ("12.2024", "UTC", "de-DE", None),
    ("T14:05", "UTC", None, None),
    ("yesterday", "UTC", None, None),
    ("", "UTC", None, None),
    (None, "UTC", None, None),
    ("9" * 5000, "UTC", None, None),
]


def test_cases():
    got = to_utc_us(*(pd.Series(list(c), dtype=object) for c in list(zip(*CASES))[:3]))
    assert [None if pd.isna(x) else int(x) for x in got] == [c[3] for c in CASES]


def test_brute_force_over_changes():
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata"):
        days = pd.date_range("2021-01-01", "2026-12-31 23:30", freq="31min")
        got = to_utc_us(pd.Series(days.strftime("%Y-%m-%dT%H:%M:%S")), pd.Series([zone] * len(days)), pd.Series([None] * len(days), dtype=object))
        z = ZoneInfo(zone)
        want = [int(d.to_pydatetime().replace(tzinfo=z, fold=0).timestamp()) * 1_000_000 for d in days]
        assert list(got) == want


def test_frame(spark):
    rows = [("a", i, d, z, loc, "x") for i, (d, z, loc, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:3], "record_kind string, record_id bigint, date string, zone string, locale string, utc_us string")
    got = {r.record_id: r.utc_us for r in normalise_dates(df).collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES) if c[3] is not None}
    assert normalise_dates(df.limit(0)).count() == 0


def test_dates_before_1970_and_long_zones(spark):
    rows = [("s", 1, "1965-07-01 12:00", "America/New_York", "en-US"), ("s", 2, "1965-01-01 12:00", "America/New_York", "en-US"), ("s", 3, "1943-08-01 12:00", "Europe/London", "en-GB"), ("s", 4, "2024-07-01T12:00:00.123456789-03:00[America/Argentina/ComodRivadavia]", "Europe/Berlin", "de-DE")]
    df = spark.createDataFrame(rows, "record_kind string, record_id bigint, date string, zone string, locale string")
    got = {r.record_id: r.utc_us // 1_000_000 for r in normalise_dates(df).collect()}
    assert got == {1: -142070400, 2: -157705200, 3: -833724000, 4: 1719846000}


def test_zone_version_is_told(monkeypatch):
    import sys
    import zoneinfo

    from folioflow.functions import timestamps as T

    monkeypatch.setattr(zoneinfo, "TZPATH", ())
    monkeypatch.setitem(sys.modules, "tzdata", None)
    told = T.zone_version()
    assert told.startswith("digest ") and told == T.zone_version()
