import os
import random

import numpy as np
import pytest

from noticeweave.llm import mixing, packing, tokens, truncation


def test_truncated_titles(spark):
    full = [f"{100 + i}年度第{i}號節能汰換補助計畫受理申請公告" for i in range(40)]
    rows = [("c", f"u{i}", "s", t) for i, t in enumerate(full)] + [("c", "cut", "s", full[3][:-3]), ("c", "mark", "s", full[4][:-6] + " ..."), ("c", "half", "s", full[5][:-6] + "&hell"),
            ("c", "bad", "t", full[6][:10] + "�"), ("c", "null", "s", None), ("c", "empty", None, ""), ("c", "u1", "s", full[1]), ("c", "cut", "s", full[3][:-3])]
    df = spark.createDataFrame(rows, "tab string, rec_key string, source string, title string")
    found = truncation.truncated_titles(df)
    got = {r["rec_key"] for r in found.where("truncated").collect()}
    assert got == {"cut", "mark", "half", "bad"} and found.count() == 45
    report = {r["source"]: (r["n_titles"], r["n_truncated"]) for r in truncation.truncation_by_source(found).collect()}
    assert report == {"s": (43, 3), "t": (1, 1), None: (1, 0)}
    assert truncation.truncated_titles(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 512])
    sizes = np.array([rng.randrange(0, cap + 1) for _ in range(rng.choice([0, 1, 5, 300]))], dtype=np.int64)
    place = packing.best_two_fit(sizes, cap)
    loads = np.bincount(place, weights=sizes) if len(sizes) else np.zeros(0)
    assert len(place) == len(sizes) and (loads <= cap).all()
    assert len(loads) <= max(1, int(np.ceil(sizes.sum() / cap) * 1.25) + 2)


def test_pair_replaces_the_smallest():
    # Greedy leaves 10 - (6 + 3) = 1; 6 + 2 + 2 fills the container.
    place = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert place[0] == place[2] == place[3] != place[1]


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 5, 30, 70, 100, 101, 250, 1000])) for i in range(500)]
    sizes = spark.createDataFrame(rows, "doc long, n_tokens long")
    budgets = spark.createDataFrame([(1, 100), (2, 256), (2, 256), (3, 0)], "budget_id int, capacity int")
    out = packing.pack(sizes, "doc", budgets, shard=120).collect()
    for budget, cap in ((1, 100), (2, 256)):
        parts = [r for r in out if r["budget_id"] == budget]
        loads, per = {}, {}
        for r in parts:
            loads[r["container"]] = loads.get(r["container"], 0) + r["n_tokens"]
            per.setdefault(r["key"], []).append((r["part"], r["first_token"], r["n_tokens"]))
        assert max(loads.values()) <= cap and set(per) == {i for i, _ in rows}
        for i, n in rows:
            got = sorted(per[i])
            assert sum(x[2] for x in got) == n and len(got) == max(1, -(-n // cap)) and [x[1] for x in got] == [j * cap for j in range(len(got))]
    report = packing.container_report(packing.pack(sizes, "doc", budgets)).collect()
    assert all(r["waste_share"] < 0.05 for r in report)
    assert packing.pack(sizes.limit(0), "doc", budgets).count() == 0


def test_water_fill():
    assert mixing.water_fill([0.5, 0.5], [100, 100], 100) == [50, 50]
    assert mixing.water_fill([0.5, 0.25, 0.25], [10, 100, 100], 100) == [10, 45, 45]
    assert mixing.water_fill([0.5, 0.5], [10, 10], 100) == [10, 10]
    assert mixing.water_fill([0.5, 0.5], [0, 100], 50) == [0, 50]
    assert mixing.water_fill([], [], 10) == []


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aabc"), rng.randrange(1, 50)) for i in range(3000)] + [(9001, None, 5), (9002, "z", 5), (9003, "a", 0)]
    sizes = spark.createDataFrame(rows, "doc long, source string, n_tokens long")
    have = {s: sum(n for _, x, n in rows if x == s) for s in "abc"}
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.3, 2), ("none", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw_mix(sizes, "doc", "source", targets)
    report = {r["source"]: r for r in mixing.mix_report(drawn, mixing.plan_mix(sizes, "source", targets)).collect()}
    total = sum(have.values())
    caps = [have["a"], 2 * have["b"], 2 * have["c"], 0]
    want = dict(zip("abc", mixing.water_fill([0.2, 0.5, 0.3, 0.1], caps, total)))
    for s in "abc":
        assert 0 <= want[s] - report[s]["tokens_used"] < 50, s
    assert report["none"]["tokens_used"] == 0 and report["none"]["clamped"]
    out = drawn.collect()
    assert len({r["key"] for r in out}) == len(out) and all(1 <= r["repeats"] <= {"a": 1, "b": 2, "c": 2}[r["source"]] for r in out)
    again = {(r["key"], r["repeats"]) for r in mixing.draw_mix(sizes.repartition(7), "doc", "source", targets).collect()}
    assert again == {(r["key"], r["repeats"]) for r in out}
    assert mixing.draw_mix(sizes.limit(0), "doc", "source", targets).count() == 0


@pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="needs the tokenizer files")
@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_sizes(spark, name):
    df = spark.createDataFrame([(1, "節能補助 hello", "x"), (2, "", "y"), (3, None, "z"), (4, "<|endoftext|>" * 50, "w")], "doc long, text string, _text string")
    got = {r["doc"]: r["n_tokens"] for r in tokens.with_sizes(df, "text", ["doc"], name).collect()}
    assert set(got) == {1, 2, 4} and got[2] == 0 and got[1] > 2 and got[4] > 50
