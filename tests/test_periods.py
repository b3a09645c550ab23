import pytest
from pyspark.sql import functions as F

from noticeweave.functions import periods as P


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("115年9月11日", "2026-09-11"), ("115/9/1", "2026-09-01"), ("115.12.31", "2026-12-31"), ("１１５年１０月１日", "2026-10-01"), ("(115-09-30) 公告", "2026-09-30"),
        ("2026年9月11日", "2026-09-11"), ("一百十五年九", None), ("一百十五年9月1日", "2026-09-01"), ("115\uf98e9月11日", "2026-09-11"),
        ("115年2月30日", None), ("02-2775-7777", None), ("1.2.3", None), ("", None), (None, None),
    ],
)
def test_first_date(text, want):
    assert next((d.iso for d in P.find_dates(text)), None) == want


def test_dates_have_places_and_do_not_overlap():
    got = P.find_dates("自115年9月1日至115/10/2止，2月30日")
    assert [(d.iso, d.begin, d.end) for d in got] == [("2026-09-01", 1, 9), ("2026-10-02", 10, 18)]


@pytest.mark.parametrize(
    ("text", "announced", "want"),
    [
        ("申請期間：自115年3月2日起至115年10月30日下午5時止", None, ("2026-03-02", "2026-10-30", "17:00", False, False)),
        ("即日起至115年12月15日止受理申請", "2026-09-11", ("2026-09-11", "2026-12-15", None, True, False)),
        ("受理期間：115年9月15日至10月31日止", None, ("2026-09-15", "2026-10-31", None, False, False)),
        ("申請期間：\n(一)第一類自115年9月1日至115年10月15日止\n(二)第三類自115年9月1日至115年11月30日止", None, ("2026-09-01", "2026-11-30", None, False, True)),
        ("執行期程\n自輔導計畫通過申請日起至115年11月30日止", None, (None, None, None, False, False)),
        ("（114年9月17日前），將申請提案函送本所", None, (None, "2025-09-17", None, False, False)),
        ("請於115年3月31日前提出申請", None, (None, "2026-03-31", None, False, False)),
        ("申請期間：自115年10月1日起", None, ("2026-10-01", None, None, False, False)),
        ("收件期間：115年12月1日至115年1月1日止", None, (None, "2026-01-01", None, False, False)),
        ("沒有日期", None, (None, None, None, False, False)), (None, None, (None, None, None, False, False)),
    ],
)
def test_periods(text, announced, want):
    start, end, time, _, _, today, varies = P.period_of(text, announced)
    assert (start, end, time, today, varies) == want


def test_quota_announcement_batches(spark):
    assert P.period_of("申請期間：自115年3月2日起受理，額滿為止")[4]
    assert P.announced_on("發布日期：115-08-19\n其他") == "2025-08-19".replace("2025", "2026")
    assert P.announced_on("某署 公告\n中華民國115年2月6日\n主旨") == "2026-02-06" and P.announced_on("無") is None and P.announced_on(None) is None
    table = "第一梯:自115年2月13日(五)至115年3月31日(二)下午5時止\n第二梯僅受理「ＡＩ能源管理」:自115年5月1日起至115年6月1日止\n第三梯(暫定):自115年9月20日起至115年11月30日下午5時止"
    got = P.batches_of(table)
    assert [(b[0], b[1], b[2], b[3], b[4], b[5]) for b in got] == [
        (1, False, None, "2026-02-13", "2026-03-31", "17:00"), (2, False, "AI能源管理", "2026-05-01", "2026-06-01", None), (3, True, None, "2026-09-20", "2026-11-30", "17:00"),
    ]
    df = spark.createDataFrame([("a", table), ("b", None), ("c", "")], "id string, t string").withColumn("b", P.batches_in("t"))
    pick = lambda day, cat=None: {r["id"]: r["p"] and r["p"]["no"] for r in df.select("id", P.picked_batch(F.col("b"), F.lit(day), None if cat is None else F.lit(cat)).alias("p")).collect()}
    assert pick("2026-05-02") == {"a": 2, "b": None, "c": None} and pick("2026-05-02", "其他")["a"] == 3
    assert pick("2026-08-01")["a"] == 3 and pick("2027-01-01")["a"] == 3 and pick("2026-03-01")["a"] == 1
    rows = {r["id"]: r for r in df.select("id", P.period_in("t", F.lit(None).cast("string")).alias("p"), P.dates_in("t").alias("d"), P.announcement_in("t").alias("a")).collect()}
    assert len(rows["a"]["d"]) == 6 and rows["b"]["d"] == [] and rows["b"]["p"]["start"] is None and rows["c"]["a"] is None
