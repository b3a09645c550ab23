from noticeweave.llm import canonical as C
from noticeweave.llm import repeated_lines as R


def test_ordinary_form():
    same = ["47 μm α ℃ m² ①", "Solène Énova", "カタログ", "，。：？｜／＞…⋯�", "\ta\n", "ο"]
    assert [C.ordinary_form(s) for s in same] == same
    pairs = [("ЕΜЅ", "EMS"), ("紙器エ廠", "紙器工廠"), ("第ニ梯次", "第二梯次"), ("ー、依據", "一、依據"), ("Ｅｎｅ１", "Ene1"), ("Solène", "Solène"),
             ("依​每﻿", "依每"), ("年⾦屬", "年金屬"), ("a　b c d", "a b c d"), ("kWһ", "kWh"), ("µm", "μm")]
    assert [C.ordinary_form(a) for a, _ in pairs] == [b for _, b in pairs]


def test_found_and_texts(spark):
    rows = [("1", "ЕΜЅ補助", "第一行​\n二"), ("2", "EMS補助", None), ("3", None, ""), ("4", "Solène", "x" * 20_000), ("4", "Solène", "x" * 20_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id string, title string, content string, canonical string")
    got = {tuple(r) for r in C.canonical_found(df, "id", ["title", "content"]).collect()}
    assert got == {("1", "title"), ("1", "content"), ("4", "title")}
    texts = {(r["id"], r["title"], r["content"], r["canonical"]) for r in C.canonical_texts(df, "id", ["title", "content"]).collect()}
    assert texts == {("1", "EMS補助", "第一行\n二", "z"), ("2", "EMS補助", None, "z"), ("3", None, "", "z"), ("4", "Solène", "x" * 20_000, "z")}
    assert C.canonical_found(df.limit(0), "id", ["title", "content"]).count() == 0


def test_repeated_lines_against_brute_force(spark):
    rows = [(f"a{i}", "A", f"頁尾\n內文 {i}\n\n 頁 \t尾 \n頁尾" if i < 6 else f"內文 {i}") for i in range(40)]
    rows += [(f"b{i}", "B", "頁尾") for i in range(5)] + [("n", None, "頁尾"), ("e", "A", ""), ("x", "A", None)]
    df = spark.createDataFrame(rows, "id string, agency string, content string")
    got = {(r["key"], r["line_no"]) for r in R.excessive_occurrences(df, "id", "agency", "content").collect()}
    assert got == {(f"a{i}", j) for i in range(6) for j in (0, 3, 4)}
    out = {r["key"]: (r["text"], r["n_removed"]) for r in R.without_repeated_lines(df, "id", "agency", "content").collect()}
    assert out["a0"] == ("內文 0\n", 3) and out["b0"] == ("頁尾", 0) and out["x"] == (None, 0) and out["e"] == ("", 0) and len(out) == len(rows)
    assert {r["line"] for r in R.repeated_line_report(df, "id", "agency", "content").collect()} == {"頁尾", "頁 尾"}
    assert R.excessive_occurrences(df.limit(0), "id", "agency", "content").count() == 0
