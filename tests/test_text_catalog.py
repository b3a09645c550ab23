from pyspark.sql import functions as F

from noticeweave.functions import text as T
from noticeweave.operators import catalog


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(expr.alias("x")).first()["x"]


def test_normalise(spark):
    c = F.col("s")
    assert one(spark, T.normalize_text(c), s="１１５／９／１") == "115/9/1"
    assert one(spark, T.normalize_text(c), s="115年9月") == "115年9月"
    assert one(spark, T.normalize_text(c), s="一百十五年度、一百零五年、一百一十年、一百年、一百元") == "115年度、105年、110年、100年、一百元"
    assert one(spark, T.normalize_text(F.lit(None).cast("string"))) == ""


def test_names_and_batches(spark):
    name = T.normalize_name(F.col("t"), F.col("p"))
    assert one(spark, name, t="115年度「節能設備汰換補助計畫」第2期受理申請公告", p="") == "節能設備汰換補助計畫"
    assert one(spark, T.batch_of(F.col("t")), t="計畫第三梯次受理") == "3"
    assert one(spark, T.batch_of(F.col("t")), t="計畫第02期") == "2"
    assert one(spark, T.batch_of(F.col("t")), t="計畫") == ""


def test_dice(spark):
    d = T.dice(F.col("a"), F.col("b"))
    assert abs(one(spark, d, a="aabab", b="abab") - 6 / 7) < 1e-9
    assert one(spark, d, a="x", b="x") == 1.0
    assert one(spark, d, a="", b="x") == 0.0
    assert one(spark, d, a="設備汰換補助", b="商業服務業節能設備汰換補助") >= 0.85
    assert one(spark, d, a="a", b="b") == 0.0


def test_status_order_and_visibility(spark):
    cols = "id string, announce_date string, apply_start string, apply_end string, apply_end_time string, status_flag string, year int, until_quota boolean, hidden boolean"
    now = 1790827200  # 2026-10-01 12:00 civil time
    rows = [
        ("new", "2026-10-01", None, None, None, None, 2026, None, None),
        ("old", "2026-09-23", "2026-09-01", "2026-10-31", None, None, 2026, None, False),
        ("hot", None, "2026-09-01", "2026-10-01", None, None, 2026, None, False),
        ("up", None, "2026-10-02", "2026-10-31", None, None, 2026, None, False),
        ("end", None, "2026-08-01", "2026-09-30", None, None, 2026, None, False),
        ("flag", None, None, "2026-12-31", None, "closed_early", 2026, None, True),
        ("none", None, None, "2026-02-30", None, "odd", 2025, True, None),
        ("carry", None, None, "2026-01-31", None, None, 2025, None, None),
        ("gone", None, None, "2025-11-30", None, None, 2025, True, None),
    ]
    df = spark.createDataFrame(rows, cols)
    got = {r["id"]: r for r in catalog.with_status(df, now).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "new": "unknown", "old": "open", "hot": "open", "up": "upcoming", "end": "closed", "flag": "closed", "none": "unknown", "carry": "closed", "gone": "closed",
    }
    assert got["hot"]["hot_text"] == "今天截止" and got["old"]["days_left"] == 30 and got["new"]["is_new"] and not got["old"]["is_new"]
    order = [r["id"] for r in catalog.lifecycle_top(df, now, 20).orderBy("rank").collect()]
    assert order[:5] == ["new", "hot", "old", "up", "none"]
    assert {r["id"] for r in catalog.visible(df, 2026).collect()} == {"new", "old", "hot", "up", "end", "carry"}
    facet = {r["status"]: r["n"] for r in catalog.status_facet(catalog.with_status(df, now)).collect()}
    assert facet[""] == 9 == sum(v for k, v in facet.items() if k)


def test_layers(spark):
    df = spark.createDataFrame([("1", "u1", "冷氣補助", "a", "b"), ("2", "u2", None, "a", "b")], "id string, official_url string, title string, target string, extra string")
    exact = spark.createDataFrame([("u1", {"target": None}), ("u1", {"target": None}), ("9", {"target": "z"})], "target string, set map<string,string>")
    got = {r["id"]: r for r in catalog.layered(df, exact, [("冷氣", {"target": "rule"})], ["target"]).collect()}
    assert got["1"]["target"] is None and got["1"]["manual"] and got["2"]["target"] == "a" and not got["2"]["manual"] and got["1"]["extra"] == "b"
