from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from noticeweave.functions import moments as M
from noticeweave.operators.timestamps import normalise_subsidy_times, resolve_instants, timestamps_found


@pytest.mark.parametrize(
    ("text", "zone"),
    [
        ("2024年4月17日 9時30分（格林威治標準時間）截止", "UTC"),
        ("2024-04-17 09:30 HST", "Pacific/Honolulu"),
        ("2024-04-17 09:30 MSK", "Europe/Moscow"),
        ("2024-04-17 09:30 America/Toronto", "America/Toronto"),
        ("2024-04-17 09:30 America/Argentina/Buenos_Aires截止", "America/Argentina/Buenos_Aires"),
        ("2024-04-17 09:30 (Etc/GMT+8)", "Etc/GMT+8"),
        ("2024-04-17 09:30（英國夏令時間）", "Europe/London"),
        ("2024-04-17 09:30（以台灣標準時間為準）", "Asia/Taipei"),
        ("2024-04-17 09:30（中原標準時間）", "Asia/Taipei"),
        ("2024-04-17 09:30（火星標準時間）", "火星"),
        ("2024-04-17 09:30 XQT", "XQT"),
        ("2024-04-17 9:30 am Mexico City time", "America/Mexico_City"),
        ("2024-04-17 09:30 截止時間", "Asia/Taipei"),
        ("2024-04-17 下午5時前", "Asia/Taipei"),
    ],
)
def test_named_zones(text, zone):
    assert M.closing(text)[1] == zone


def test_intervals_are_open_and_agree_with_the_tz_database():
    for name in ("America/New_York", "Asia/Taipei", "Australia/Lord_Howe", "Africa/Casablanca", "Europe/Dublin", "Etc/GMT+8"):
        rows = M.zone_intervals([name])
        assert rows[0][1] == -M.OPEN_S and rows[-1][2] == M.OPEN_S and all(a[2] == b[1] for a, b in zip(rows, rows[1:]))
        z = ZoneInfo(name)
        for t in range(-5_000_000_000, 5_000_000_000, 3_333_333):
            d = datetime.fromtimestamp(t, timezone.utc).astimezone(z)
            assert [(r[3], r[4]) for r in rows if r[1] <= t < r[2]] == [(int(d.utcoffset().total_seconds()), d.tzname())]


def test_any_zone_and_year(spark):
    places = ["America/Toronto", "America/Santiago", "Asia/Kolkata", "Europe/London", "Asia/Taipei"]
    rows = [(f"{y}-{m}-{z}", z, datetime(y, m, 9, 12, tzinfo=timezone.utc), datetime(y, m, 9, 12, tzinfo=ZoneInfo(z)))
            for z in places for y in (1200, 1890, 1912, 1969, 2026, 2100, 2128, 2129, 2200, 2401, 9998) for m in (1, 7)]
    secs = lambda d: int((d - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds())
    df = spark.createDataFrame([(k, (secs(wall), z, None, None)) for k, z, wall, _ in rows], "k string, reading struct<local_s: long, zone: string, abbr: string, epoch_s: long>")
    got = {r["k"]: (r["status"], r["epoch_s"]) for r in resolve_instants(df).collect()}
    assert got == {k: ("exact", secs(at)) for k, _, _, at in rows}


def test_rows_of_named_and_unknown_zones(spark):
    texts = {"a": "2024年4月17日 9時30分（格林威治標準時間）截止", "b": "2024-07-17 09:30 America/Toronto", "c": "2024-04-17 09:30 XQT", "d": "民國1年1月1日", "e": "2150-07-01 12:00 EDT"}
    df = spark.createDataFrame([(k, None, None, None, v) for k, v in texts.items()], "id string, announce_date string, apply_end string, apply_end_time string, deadline_text string")
    assert {(r["id"], r["normalised"]) for r in timestamps_found(df).collect()} == {
        ("a", "2024-04-17T09:30:00Z"), ("b", "2024-07-17T13:30:00Z"), ("d", "1912-01-01T15:59:59Z"), ("e", "2150-07-01T16:00:00Z"),
    }
    assert {r["id"]: r["status"] for r in normalise_subsidy_times(df).collect()} == {"a": "exact", "b": "exact", "c": "unknown_zone", "d": "exact", "e": "exact"}
