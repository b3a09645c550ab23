from datetime import datetime, timezone

import pytest

from noticeweave.functions import moments as M
from noticeweave.operators.timestamps import normalise_subsidy_times, resolve_instants, timestamps_found


def wall(r):
    return None if r is None else datetime.fromtimestamp(r[0], timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2027年1月12日 24:00 前", "2027-01-13 00:00:00"),
        ("申請期間：１１４年１月１３日至4月29日止", "2025-04-29 23:59:59"),
        ("第一梯次114.3.31截止；第二梯次中華民國114年08月26日截止", "2025-08-26 23:59:59"),
        ("115年9月29日（星期二）17:00截止", "2026-09-29 17:00:00"),
        ("民國113年5月9日 4:00 PM截止", "2024-05-09 16:00:00"),
        ("一百十五年七月十三日 下午3時半", "2026-07-13 15:30:00"),
        ("Applications close 30 October 2024, 5:30 pm PDT", "2024-10-30 17:30:00"),
        ("2025-07-30 12 noon", "2025-07-30 12:00:00"),
        ("6月底前（詳各梯次規定）", None),
        ("自115年2月1日起至115年2月30日止", None),
        ("自115年2月1日起受理", None),
        ("額滿為止", None),
        ("", None),
        (None, None),
    ],
)
def test_closing(text, want):
    assert wall(M.closing(text)) == want


@pytest.mark.parametrize(
    ("text", "epoch"),
    [("1688801479", 1688801479), ("1734681977419", 1734681977), ("2023-12-16 10:20:14-05", 1702740014), ("2026/10/19 17:30:00 GMT+8", 1792402200)],
)
def test_stated_instants(text, epoch):
    assert M.whole(text)[1][3] == epoch


def test_day_and_time_together():
    assert wall(M.closing_of("1151014", "１２：００前")) == "2026-10-14 12:00:00"
    assert wall(M.closing_of("2026-01-02", "下午")) == "2026-01-02 23:59:59"
    assert M.closing_of("2026-01-02", "18:00:00 (GMT+8)")[3] == 1767348000
    assert M.closing_of("115年2月30日", "10:00") is None


def test_intervals_cover_the_clock_change():
    rows = [r for r in M.zone_intervals(["America/New_York"], 2025, 2026)]
    assert {r[4] for r in rows} == {"EST", "EDT"}
    assert all(a[2] == b[1] for a, b in zip(rows, rows[1:]))


def test_as_of_join(spark):
    def local(s):
        return int(datetime.fromisoformat(s + "+00:00").timestamp())

    rows = [
        ("exact", (local("2025-07-01 12:00:00"), "America/New_York", None, None)),
        ("twice", (local("2025-11-02 01:30:00"), "America/New_York", None, None)),
        ("est", (local("2025-11-02 01:30:00"), "America/New_York", "EST", None)),
        ("edt", (local("2025-11-02 01:30:00"), "America/New_York", "EDT", None)),
        ("never", (local("2025-03-09 02:30:00"), "America/New_York", None, None)),
        ("stated", (0, None, None, 5)),
        ("where", (local("2025-07-01 12:00:00"), "Mars/Base", None, None)),
    ]
    df = spark.createDataFrame(rows, "k string, reading struct<local_s: long, zone: string, abbr: string, epoch_s: long>")
    got = {r["k"]: (r["status"], r["epoch_s"]) for r in resolve_instants(df).collect()}
    assert got["exact"] == ("exact", local("2025-07-01 16:00:00"))
    assert got["twice"] == ("ambiguous", None)
    assert got["est"] == ("exact", local("2025-11-02 06:30:00"))
    assert got["edt"] == ("exact", local("2025-11-02 05:30:00"))
    assert got["never"] == ("nonexistent", None)
    assert got["stated"] == ("stated", 5)
    assert got["where"] == ("unknown_zone", None)


def test_found_rows(spark):
    cols = "id string, announce_date string, apply_end string, apply_end_time string, deadline_text string, title string, status string"
    rows = [
        ("a", "2026-07-08", "2026-08-10", "17:00", None, "x", "clash"),
        ("b", "115/8/28", "1151014", None, "2025-11-02 01:30 EST", "x", "clash"),
        ("b", "115/8/28", "1151014", None, "2025-11-02 01:30 EST", "x", "clash"),
        ("c", "N/A", "2026-13-05", "24:00", "常年受理", None, None),
        ("d", None, "2026-08-10", "24:00", "", None, None),
        ("e", "2026-02-18T23:23:19-05:00", None, "10:00", None, None, None),
    ]
    df = spark.createDataFrame(rows, cols)
    got = {tuple(r) for r in timestamps_found(df).collect()}
    assert got == {
        ("b", "announce_date", "2026-08-28"),
        ("b", "apply_end", "2026-10-14T15:59:59Z"),
        ("b", "deadline_text", "2025-11-02T06:30:00Z"),
        ("d", "apply_end", "2026-08-10T16:00:00Z"),
        ("e", "announce_date", "2026-02-19"),
    }
    assert normalise_subsidy_times(df).count() == 8
    assert timestamps_found(df.limit(0)).count() == 0
