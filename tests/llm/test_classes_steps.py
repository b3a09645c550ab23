import random

from pyspark.sql import functions as F

from noticeweave.llm import boilerplate as B
from noticeweave.llm import canonical as C
from noticeweave.llm import mixing, packing, tokens, truncation


def test_the_class_decides(spark):
    """What one text can't tell, the others of its class do: most of them write the ideograph, or the kana."""
    rows = [(f"a{i}", "ニ期工程") for i in range(2)] + [(f"b{i}", "二期工程") for i in range(3)]
    rows += [(f"c{i}", "カタロ") for i in range(3)] + [("d", "カタ口")]  # a sign in place of a kana, outvoted
    rows += [("e", "EMS​補助"), ("f", "ЕМS補助"), ("g", None), ("h", "")]
    df = spark.createDataFrame(rows, "id string, title string")
    got = {r["id"]: r["title"] for r in C.canonical_texts(df, "id", ["title"]).collect()}
    assert {got[f"a{i}"] for i in range(2)} | {got[f"b{i}"] for i in range(3)} == {"二期工程"}
    assert {got[f"c{i}"] for i in range(3)} == {"カタロ"} and got["e"] == got["f"] == "EMS補助" and got["g"] is None and got["h"] == ""
    assert got["d"] == "カタロ" and {r["key"] for r in C.canonical_found(df, "id", ["title"]).collect()} == {"a0", "a1", "d", "e", "f"}


def test_all_values_that_look_alike_are_one_class(spark):
    df = spark.createDataFrame([("1", "A​B"), ("2", "AB"), ("3", "ＡＢ"), ("4", "ab")], "id string, title string")
    got = {r["key"]: r["canonical"] for r in C.canonical_values(df, "id", ["title"]).collect()}
    assert got == {"1": "AB", "3": "AB"}


def test_endings_longer_than_the_upper_trie(spark):
    """Of the same eight last characters some titles end and some go on; the ninth, or the twentieth, tells them apart."""
    tail = "設備汰換補助計畫"
    for pad in ("", "一二三四五六七八九十甲乙丙丁"):
        rows = [(f"e{i}", f"{100 + i}子{pad}{tail}") for i in range(12)] + [(f"g{i}", f"{100 + i}丑{pad}{tail}申請須知{i % 3}") for i in range(12)]
        rows += [("cut", f"999丑{pad}{tail}"), ("whole", f"999子{pad}{tail}")]
        df = spark.createDataFrame([("c", k, f"s{i}", t) for i, (k, t) in enumerate(rows)], "tab string, rec_key string, source string, title string")
        found = {r["rec_key"] for r in truncation.truncated_titles(df).where("truncated").collect()}
        assert "cut" in found and "whole" not in found and not any(k[0] == "e" for k in found)


def test_open_containers_of_shards_are_packed_together(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(1, 40)) for i in range(2000)]
    sizes, budgets = spark.createDataFrame(rows, "doc long, n_tokens long"), spark.createDataFrame([(1, 100)], "budget_id int, capacity int")
    out = packing.pack(sizes, "doc", budgets, shard=15).collect()
    assert sorted((r["key"], r["n_tokens"]) for r in out) == sorted(rows)
    loads = {}
    for r in out:
        loads[r["container"]] = loads.get(r["container"], 0) + r["n_tokens"]
    assert max(loads.values()) <= 100 and len(loads) <= -(-sum(n for _, n in rows) // 100) + 8 and len({c for c in loads if c[0] == "m"}) > 5


def test_a_text_too_long_is_passed_over(spark):
    rows = [(i, "a", 100 if i % 7 else 100_000) for i in range(700)]
    sizes = spark.createDataFrame(rows, "doc long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    used = mixing.draw_mix(sizes, "doc", "source", targets, total=50_000).agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0]
    assert 49_900 < used <= 50_000


def test_frames_by_a_shuffled_join_are_those_by_broadcast(spark, monkeypatch):
    """Five thousand pages of one template; beyond the bound the marks are the same."""
    rows = []
    for i in range(5000):
        own = f"第{i}案內容如下，請查照。"
        rows.append((f"{i:04d}", f"https://www.h.example/view.do?id={i * 7}", f"選單 MENU\n您的位置：首頁\n計畫{i}號補助計畫\n{own}\n本站內容僅供參考。" + ("\n期間公告欄" if 2000 <= i < 2060 else ""), "某署", f"計畫{i}號補助計畫", None))
    rows += [(None, None, "單獨。", None, None, None), ("0000", rows[0][1], rows[0][2], "某署", rows[0][4], None)]
    df = spark.createDataFrame(rows, "id string, url string, content string, agency string, title string, name string")
    mark = lambda: sorted((str(r["key"]), r["codes"]) for r in B.marked_pages(df, "id", "url", "content", "agency", "title", F.col("name")).select("key", "codes").collect())
    one = mark()
    assert sum(c.startswith("FF") for _, c in one) == 5001 and len(one) == 5002
    assert all(c[5] == "F" for k, c in one if len(c) == 6)  # a line on sixty neighbours of five thousand
    monkeypatch.setattr(B, "BROADCAST_FRAMES", 0)
    assert mark() == one
