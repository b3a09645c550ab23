from pyspark.sql import functions as F

from noticeweave.operators import ask, crawl, merge, resolve, validate


def test_upsert_keeps_and_fills(spark):
    cols = "k string, seen string, at int, v string, w string"
    old = spark.createDataFrame([("a", "old", 1, "x", "w"), ("b", "old", 1, "x", None)], cols)
    new = spark.createDataFrame([("a", "new", 2, None, None), ("a", "new", 3, "z", None), ("c", "new", 2, "y", "q"), (None, "n", 1, "y", "q")], cols)
    got = {r["k"]: tuple(r) for r in merge.upsert(old, new, "k", "at", ["seen"], ["w"]).collect()}
    assert got == {"a": ("a", "old", 3, "z", "w"), "b": ("b", "old", 1, "x", None), "c": ("c", "new", 2, "y", "q")}
    again = merge.upsert(merge.upsert(old, new, "k", "at", ["seen"], ["w"]), new, "k", "at", ["seen"], ["w"])
    assert {r["k"]: tuple(r) for r in again.collect()} == got
    assert merge.upsert(old.limit(0), new.limit(0), "k", "at", []).count() == 0


def test_merge_group(spark):
    rows = [("k", 1, None, ["b", "a"], None), ("k", 2, "x", ["a", None, "c"], True), ("k", 2, "x", ["a", None, "c"], True), ("l", 1, None, None, None)]
    df = spark.createDataFrame(rows, "k string, o int, s string, a array<string>, f boolean")
    got = {r["k"]: (r["s"], r["a"], r["f"], r["n_merged"]) for r in merge.merge_group(df, "k", ["o"], ["s"], ["a"], ["f"]).collect()}
    assert got == {"k": ("x", ["b", "a", "c"], True, 3), "l": (None, [], False, 1)}


def test_keys_changes_retention(spark):
    df = spark.createDataFrame([("1", "k"), ("2", "k"), ("3", None)], "id string, dedupe_key string")
    assert {r["id"]: r["dedupe_key"] for r in merge.unique_keys(df, "dedupe_key", "id").collect()} == {"1": "k", "2": "k|2", "3": None}
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, None), ("v", 1, None)], "u string, t int, h string")
    assert sorted(r["change"] for r in merge.changes(df, "u", ["t"], "h").collect()) == ["changed", "new", "new", "same"]
    assert {r["id"] for r in merge.keep_last(spark.range(5), "id", 2).collect()} == {3, 4}


def test_failure_runs_over_buckets(spark):
    rows = [(i, not (1020 <= i <= 1030 or i == 5)) for i in range(2100)] + [(2100, None)]
    got = {(r["first"], r["last"], r["n"]) for r in crawl.failure_runs(spark.createDataFrame(rows, "id long, ok boolean"), "id", "ok").collect()}
    assert got == {(5, 5, 1), (1020, 1030, 11), (2100, 2100, 1)}


def test_work_list(spark):
    rows = [("a", None, None, None, "2026-01-01"), ("b", "error", "2026-01-01 00:00:00", 3, None), ("c", "error", "2026-01-01 00:00:00", 12, None),
            ("d", "subsidy", "2026-01-01 00:00:00", 0, None), ("e", "subsidy", "2026-09-15 03:00:00", 0, None), ("f", "not", "2020-01-01 00:00:00", 0, None)]
    df = spark.createDataFrame(rows, "url string, verdict string, last_checked_at string, fail_count int, list_date string").withColumn("last_checked_at", F.col("last_checked_at").cast("timestamp"))
    got = [(r["url"], r["priority"]) for r in crawl.work_list(df, "2026-09-15 04:00:00+00:00").collect()]
    assert got == [("a", 0), ("b", 1), ("d", 2)]


def test_sites(spark):
    df = spark.createDataFrame([("https://www.a.gov.tw/x", "https://a.gov.tw"), ("https://b.a.gov.tw", "https://a.gov.tw"), ("https://ba.gov.tw", "https://a.gov.tw"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(crawl.same_site(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_similar_names_against_brute_force(spark):
    names = ["節能設備汰換補助計畫", "節能設備汰換補助", "空調汰換補助", "照明改善", "照明改善計畫", "a", ""]
    rows = [(f"{ag}{n}", ag, n) for ag in ("經濟部", "經濟部能源署", "交通部", "") for n in names]
    df = spark.createDataFrame(rows, "node string, agency string, name string")
    from noticeweave.functions.text import dice

    a, b = df.toDF("a", "aa", "na"), df.toDF("b", "ab", "nb")
    related = (F.col("aa") != "") & (F.col("ab") != "") & (F.col("aa").startswith(F.col("ab")) | F.col("ab").startswith(F.col("aa")))
    want = {(r["a"], r["b"]) for r in a.join(b, related).where((dice(F.col("na"), F.col("nb")) >= 0.72) & (F.length("na") > 1) & (F.length("nb") > 1)).collect()}
    assert {(r["a"], r["b"]) for r in resolve.similar_names(df, df).collect()} == want


def test_cascade(spark):
    docs = spark.createDataFrame([("d1", ["u1"], "k9", ""), ("d2", ["u0"], "k1", "n1"), ("d3", [None], "k0", "n2"), ("d4", None, None, None)], "doc string, urls array<string>, key string, doc_no string")
    known = spark.createDataFrame([("i1", ["u1", None], "k1", "n2"), ("i0", [], "k1", "")], "id string, urls array<string>, key string, doc_no string")
    assert {r["doc"]: (r["match"], r["tier"]) for r in resolve.match_cascade(docs, known).collect()} == {"d1": ("i1", 1), "d2": ("i0", 2), "d3": ("i1", 3), "d4": (None, None)}


def test_ask(spark):
    text = "見 https://a.tw/x。另 https://b.tw/y, 完"
    df = spark.createDataFrame([(text, ["https://a.tw/x"])], "t string, u array<string>")
    assert df.select(ask.hold_to_urls(F.col("t"), F.col("u"))).first()[0] == f"見 https://a.tw/x。另 {ask.NO_URL}, 完"
    df = spark.createDataFrame([("補助1,500萬及3.5倍", "計1500萬、3.5倍"), ("7", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(ask.numbers_from(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    req = spark.sql("select * from values (1, 'x', timestamp_ntz'2026-01-01 15:59:00'), (2, 'x', timestamp_ntz'2026-01-01 16:00:00'), (3, 'x', timestamp_ntz'2026-01-01 16:00:00') t(id, c, ts)")
    assert {r["id"]: r["admitted"] for r in ask.admitted(req, "c", "ts", "id", 1).collect()} == {1: True, 2: True, 3: False}
    q = spark.createDataFrame([(1, "冷氣汰換有補助嗎"), (2, ""), (3, None)], "qid int, question string")
    n = spark.createDataFrame([("a", "冷氣汰換補助"), ("b", "照明"), ("c", None)], "id string, text string")
    assert [(r["qid"], r["id"], r["rank"]) for r in ask.relevance_top(q, n).collect()] == [(1, "a", 1)]
    got = spark.createDataFrame([("d", "ip")], "d string, a string").select(ask.client_ids("s")("d", "a")).first()[0]
    assert len(got) == 32


def test_validation(spark):
    cols = "id string, title string, official_url string, announce_date string, apply_end string, apply_end_time string, year int, status_flag string, views int"
    good = ("a1b2c3d4e5f6", "t", "https://x", None, "2026-01-01", "10:00", 2026, None, 0)
    bad = ("XX", " ", "ftp://x", "115/1/1", None, "24:00", 1800, "odd", -1)
    df = spark.createDataFrame([good, bad], cols)
    got = [r["errors"] for r in validate.flagged(df, validate.subsidy_rules()).collect()]
    assert got == [[], ["id", "title", "official_url", "announce_date", "apply_end_time", "year", "status_flag", "views"][:4] + ["apply_end_time", "year", "status_flag", "views"]]
    assert validate.accepted_batch(df, validate.subsidy_rules()).count() == 0
    assert validate.accepted_batch(df.limit(1), validate.subsidy_rules()).count() == 1
