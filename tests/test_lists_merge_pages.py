from pyspark.sql import functions as F

from noticeweave.functions import text as T
from noticeweave.operators import ask, catalog, crawl, merge, resolve
from noticeweave.session import numbered
from noticeweave.sources import pages


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(expr.alias("x")).first()["x"]


def test_ongoing_and_carried_over(spark):
    rows = [("a", 2024, None, "", None, False, True), ("b", 2024, None, "2025-12-31", None, False, True), ("c", 2025, "", "2026-01-01", None, False, None),
            ("d", 2025, "closed", "2027-01-01", None, False, None), ("e", None, None, None, None, None, True), ("f", 2026, None, None, None, True, True)]
    df = spark.createDataFrame(rows, "id string, year int, status_flag string, apply_end string, until_quota boolean, hidden boolean, ongoing boolean")
    got = {r["id"]: r["carried_over"] for r in catalog.visible(df, 2026, "ongoing").collect()}
    assert got == {"a": False, "c": True, "e": False}
    label = catalog.carried_label(F.col("c"), F.col("s"), F.col("y"))
    assert one(spark, label, c=True, s="open", y=2025) == "2025 年公告・今年仍受理" and one(spark, label, c=True, s="closed", y=2025) is None
    assert catalog.visible(df.limit(0), 2026, "ongoing").count() == 0


def test_layers_by_any_address_and_year_of_amounts(spark):
    rows = [("a", "空調", 2026, "u1", ["s1", "s2"], "x"), ("b", "空調", 2025, "u2", None, "x"), ("c", None, 2026, None, ["s2", "s1"], None)]
    df = spark.createDataFrame(rows, "id string, title string, year int, official_url string, source_urls array<string>, amount string")
    exact = spark.createDataFrame([("s1", {"amount": "one"}), ("s2", {"amount": None})], "target string, set map<string,string>")
    out = catalog.layered(df, exact.limit(0), [("空調", {"amount": "rule", "amount_year": 2026})], ["amount"], ("amount",))
    assert {r["id"]: (r["amount"], r["manual"]) for r in out.collect()} == {"a": ("rule", True), "b": ("x", True), "c": (None, False)}
    out = {r["id"]: (r["amount"], r["manual"]) for r in catalog.layered(df, exact, [], ["amount"]).collect()}
    assert out == {"a": ("one", True), "b": ("x", False), "c": (None, True)}


def test_display(spark):
    assert one(spark, T.categories_of(F.array(F.lit("民眾"), F.lit("旅宿業"), F.lit("外星"), F.lit(None)))) == ["服務業", "民眾"]
    assert one(spark, T.categories_of(F.lit(None).cast("array<string>"))) == []
    tags = T.title_tags(F.col("t"), F.col("p"))
    assert one(spark, tags, t="116年度計畫第四梯次", p="") == ["116年度", "第四梯次"] and one(spark, tags, t="一百十五年度計畫第3期", p="") == ["115年度", "第三梯次"]
    assert one(spark, tags, t="計畫", p="第二梯（暫定） 2026/11/02") == ["第二梯次"]
    points = T.target_points(F.lit(None).cast("array<string>"), F.col("t"))
    assert one(spark, points, t="（一）旅館業者（二）民宿 1.5 倍（三）x…") == ["旅館業者", "民宿 1.5 倍"] and one(spark, points, t="第一類補助對象為工廠第二類學校") == ["第一類：工廠", "第二類學校"]
    assert one(spark, points, t="") == []
    assert one(spark, T.short_period(F.lit("2026/09/01 ～ 2026/11/30 17:00"))) == "2026/09/01 ～ 11/30 17:00"
    money = T.dollars(F.col("n"))
    assert [one(spark, money, n=n) for n in (500, 1500, 15_000_000, 150_000_000, 12_345, 12_300)] == [
        "新臺幣 500 元", "新臺幣 1,500 元", "新臺幣 1,500 萬元", "新臺幣 1.5 億元", "新臺幣 12,345 元", "新臺幣 1.23 萬元",
    ]


def test_facets(spark):
    rows = [("open", "A", ["工業"], None), ("closed", "A", ["製造業／工廠"], None), ("open", "B", ["工業"], "x"), ("open", None, None, None)]
    df = spark.createDataFrame(rows, "status string, agency string, target_types array<string>, hot_text string")
    got = {r["status"]: r["n"] for r in catalog.status_facet(catalog.chosen(df, "status", status="open", agency="A", category="工業")).collect()}
    assert got == {"": 2, "open": 1, "closed": 1}
    assert tuple(catalog.totals(df, status="open", agency="A").first()) == (4, 3, 1, 1)
    assert [r["agency"] for r in catalog.agency_list(df).collect()] == ["A", "B"]
    assert catalog.values_of(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "key string, value string"), ["a", "z"]).first()["values"] == {"a": "2"}
    ids = spark.createDataFrame([("abcdef12", False), ("abcdef13", True)], "id string, hidden boolean")
    assert [catalog.notice(ids, i).count() for i in ("abcdef12", "abcdef13", "x' or 1", "")] == [1, 0, 0, 0]


NOTICE = "id string, title string, year int, announce_date string, target string, amount_text string, until_quota boolean, status_flag string, official_url string, source_urls array<string>, first_seen_at string"


def test_merge_cases(spark):
    old = ("1", "舊", 2026, "2026-01-01", "甲", None, False, None, "https://x.org.tw/1", ["https://x.org.tw/1"], "t0")
    new = lambda **k: tuple({**dict(zip([c.split()[0] for c in NOTICE.split(", ")], ("9", "新", 2026, "2026-02-01", "乙", "五萬", True, "closed", "https://a.gov.tw/2", ["https://a.gov.tw/2"], "t9"))), **k}.values())
    rows = [
        ("new", None, new()), ("upgrade", old, new()), ("other", old, new(official_url="https://y.org.tw/3", year=2025)),
        ("own", old, new(official_url="https://x.org.tw/1", status_flag="", target=None)), ("dated", (*old[:2], None, None, *old[4:]), new(target=None)),
    ]
    df = spark.createDataFrame(rows, f"k string, old struct<{NOTICE.replace(' ', ':').replace(',:', ',')}>, new struct<{NOTICE.replace(' ', ':').replace(',:', ',')}>")
    got = {r["k"]: (r["case"], r["merged"]) for r in merge.merged_notice(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"new": "new", "upgrade": "own", "other": "other", "own": "own", "dated": "dated"}
    assert got["new"][1]["id"] == "9" and got["new"][1]["title"] == "新"
    up = got["upgrade"][1]
    assert (up["id"], up["first_seen_at"], up["title"], up["official_url"], up["target"], up["status_flag"], up["until_quota"]) == ("1", "t0", "新", "https://a.gov.tw/2", "乙", "closed", True)
    assert up["source_urls"] == ["https://x.org.tw/1", "https://a.gov.tw/2"]
    other = got["other"][1]
    assert (other["title"], other["target"], other["amount_text"], other["status_flag"], other["official_url"]) == ("舊", "甲", "五萬", None, "https://x.org.tw/1")
    assert (got["own"][1]["target"], got["own"][1]["status_flag"], got["own"][1]["year"]) == ("甲", None, 2026)
    dated = got["dated"][1]
    assert (dated["id"], dated["title"], dated["year"], dated["target"], dated["source_urls"]) == ("1", "新", 2026, "甲", ["https://a.gov.tw/2", "https://x.org.tw/1"])


def test_snapshots(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 3, None), ("u", 2, "b"), ("v", None, "c"), (None, 1, "d")], "u string, t int, x string")
    assert {(r["u"], r["x"]) for r in merge.last_wins(df, "u", ["t"]).collect()} == {("u", None), ("v", "c"), (None, "d")}
    assert {(r["u"], r["x"]) for r in merge.first_wins(df, "u", ["t"]).collect()} == {("u", "a"), ("v", "c"), (None, "d")}
    assert {r["x"] for r in merge.replaced_all(df.limit(0), df, "u", "t").collect()} == {None, "c"} and merge.replaced_all(df, df.limit(0), "u", "t").count() == 0 and merge.replaced_all(df, None, "u", "t").count() == 5
    rows = spark.createDataFrame([("1", "a", None, "ok"), ("2", "b", True, "ok"), ("3", None, False, None)], "id string, official_url string, hidden boolean, link_status string")
    gone = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    assert {r["id"]: (r["hidden"], r["changed"]) for r in merge.withdrawn(rows, gone).collect()} == {"1": (True, True), "2": (True, False), "3": (False, False)}
    checks = spark.createDataFrame([("a", False, True, 3), ("a", True, False, 0), ("b", False, True, 2)], "url string, ok boolean, permanent boolean, fail_count int")
    assert {r["id"]: r["link_status"] for r in merge.link_states(rows, checks).collect()} == {"1": "dead", "2": "ok", "3": None}
    keys = spark.createDataFrame([("1", "k"), ("1", "k"), ("2", "k"), ("3", None), ("4", None)], "id string, dedupe_key string")
    assert sorted(str(r["dedupe_key"]) for r in merge.unique_keys(keys, "dedupe_key", "id").collect()) == ["None", "None", "k", "k", "k|2"]


def test_candidates_and_redirects(spark):
    cols = "url string, title string, list_date string, source_id string"
    lists = spark.createDataFrame([("a", "t", "2026-01-01", "s2"), ("a", "t", "2025-05-01", "s1"), ("b", "t", "2020-01-01", "s"), ("c", "t", None, "s"), ("x", "t", None, "s"), (None, "t", None, "s")], cols)
    pinned = spark.createDataFrame([("c", "p", None, "program")], cols)
    known = spark.createDataFrame([("a", "k", None, "known"), ("d", "k", None, "known")], cols)
    out = spark.createDataFrame([("x",), (None,)], "target string")
    got = {r["url"]: (r["kind"], r["source_id"]) for r in crawl.candidate_pages(lists, pinned, known, out, "2025-01-01").collect()}
    assert got == {"a": ("list", "s1"), "c": ("programme", "program"), "d": ("known", "known")}
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", None), ("e", "e")], "url string, target string")
    assert {r["url"]: (r["final_url"], r["hops"]) for r in crawl.followed(hops).collect()} == {"a": ("c", 2), "b": ("d", 2), "c": ("d", 1), "d": ("d", 0), "e": ("e", 0)}
    title = crawl.picked_title(F.col("t"), F.col("x"), F.col("h"), F.lit("page"))
    assert one(spark, title, t="某署補助計畫…", x="別行\n某署補助計畫申請公告", h="") == "某署補助計畫申請公告" and one(spark, title, t="短", x="", h="較長的標題") == "較長的標題"
    assert one(spark, title, t="足夠長的標題一二三", x="", h="") == "足夠長的標題一二三" and one(spark, title, t="", x="", h="") == "page"
    year = crawl.document_year(F.col("a"), F.col("l"), F.lit(None).cast("int"), F.col("t"))
    assert one(spark, year, a="", l="2025-01-01", t="115年度") == 2025 and one(spark, year, a="", l="", t="115年度計畫") == 2026 and one(spark, year, a="", l="", t="計畫") is None


def test_cascade_of_programmes_and_empty_keys(spark):
    shape = "urls array<string>, key string, doc_no string"
    docs = [("d1", ["u1"], "", None), ("d2", ["u2"], "k", ""), ("d3", ["zz"], "program:p", None), ("d4", ["u9"], None, "n1"), ("d5", ["off"], "k9", None), ("d6", ["alt"], "k8", None), ("d7", None, None, None)]
    known = [("1", ["x1", "u1"], "", ""), ("2", ["x"], "k", ""), ("3", ["off", "alt"], "program:p", ""), ("4", None, None, "n1"), ("0", ["y"], "", "")]
    got = {r["doc"]: (r["match"], r["tier"]) for r in resolve.match_cascade(spark.createDataFrame(docs, "doc string, " + shape), spark.createDataFrame(known, "id string, " + shape)).collect()}
    assert got == {"d1": ("1", 1), "d2": ("2", 2), "d3": ("3", 0), "d4": ("4", 3), "d5": ("3", 1), "d6": (None, None), "d7": (None, None)}


def test_numbers(spark):
    assert [ask.plain_numbers(s) for s in ("百分之三十", "三分之一", "1,500萬", "一千五百", "一百十五年", "十", "兩千零五")] == ["30%", "1/3", "1500萬", "1500", "115年", "10", "2005"]
    ok = ask.numbers_from(F.col("f"), F.col("s"), han=True)
    assert one(spark, ok, f="補助三成，最高五百元", s="3 成與 500 元") and not one(spark, ok, f="最高六百元", s="500") and one(spark, ok, f="5", s="05.0") and one(spark, ok, f="", s="")


def test_places_and_chunks(spark):
    rows = [(f"{i:04d}", "a" if i % 3 else "b", i) for i in range(500)] + [("x", None, 1)]
    df = spark.createDataFrame(rows, "o string, g string, v int").repartition(5)
    got = {(r["g"], r["o"]): r["n"] for r in numbered(df, ["g"], ["o"]).collect()}
    for g in ("a", "b", None):
        assert [got[g, o] for o in sorted(o for o, h, _ in rows if h == g)] == list(range(sum(h == g for _, h, _ in rows)))
    sums = {r["o"]: r["n"] for r in numbered(df.where("g = 'a'"), [], ["o"], "v").collect()}
    assert sums["0001"] == 0 and sums["0004"] == 3 and sums["0499"] == sum(i for i in range(499) if i % 3)
    text = {(r["g"], r["chunk"]): r["context"] for r in ask.context_lines(df.where("g is not null"), "g", "o", ["v"], 100).collect()}
    assert len(text) == 4 + 2 and text["b", 0].split("\n")[:2] == ["v: 0", "v: 3"] and len(text["a", 3].split("\n")) == 33
    assert numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_pages(spark):
    html = (
        '<html><head><title>署</title><meta name="description" content="說明 文字"></head><body><div class="menu">' + "選單" * 60 + '</div><table><tr><td class="content"><h2 class="t">補助計畫公告標題</h2>'
        + "內文內文" * 30 + '<a href="f.pdf">要點.pdf</a></td></tr></table><a href="?p=2" title="下一頁">2</a><a href="/news">最新消息</a><a href="/bid">採購公告</a><a href="https://else.tw/n">公告</a>'
        "<ul><li><span>115/09/01</span> <span>無網頁的補助公告一則</span></li><li>無日期的一列文字文字文字</li></ul></body></html>"
    )
    title, heading, about, text = pages.main_and_description(html)
    assert (title, heading, about) == ("署", "補助計畫公告標題", "說明 文字") and "內文" in text and "選單" not in text
    assert pages.attached_files(html, "https://a.tw/x/") == [("https://a.tw/x/f.pdf", "要點.pdf")] and pages.next_page(html, "https://a.tw/x") == "https://a.tw/x?p=2"
    (row,) = pages.row_documents(html, "https://a.tw/x#y")
    assert row[1:3] == ("無網頁的補助公告一則", "2026-09-01") and row[0].startswith("https://a.tw/x#row-%E7%84%A1")
    df = spark.createDataFrame([("https://a.tw/", html), ("https://b.tw/", None), ("https://c.tw/", "")], "url string, html string")
    assert [(r["url"], r["list_url"], r["score"]) for r in pages.discovered_lists(df).collect()] == [("https://a.tw/", "https://a.tw/news", 1)]
    assert one(spark, pages.is_challenge(F.lit("x _Incapsula_Resource"))) and not one(spark, pages.is_challenge(F.lit(None).cast("string")))
    assert [r["n"] for r in df.select(pages.next_of("html", "url").alias("n")).collect()] == ["https://a.tw/?p=2", None, None]
