import random
import re
import unicodedata

import pytest

import __spark_entry__ as entry
from noticeweave.operators import ask


def pairs(s):
    t = "".join(c for c in s or "" if unicodedata.category(c)[0] not in "PS" and not c.isspace())
    return {t[i : i + 2] for i in range(len(t) - 1)}


def brute(questions, notices, k=6, least=3):
    out = set()
    for qid, q in questions:
        mine = pairs(" ".join([q or "", *[w for p, w in ask.SYNONYMS if re.search(p, q or "")]]))
        scored = sorted((-len(mine & pairs(t)), i) for i, t in notices)
        out |= {(qid, i, -s, r) for r, (s, i) in enumerate(scored[:k], 1) if -s >= least}
    return out


@pytest.mark.parametrize("block", [4000, 7])
def test_whole_questions_against_brute_force(spark, block):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("補助空調冷氣馬達申請，。 ab1𠮷燈") for _ in range(n))
    questions = [(i, word(rng.choice([0, 1, 5, 80, 900]))) for i in range(25)] + [(99, None)]
    notices = [(f"{i:03d}", word(rng.choice([0, 1, 4, 30]))) for i in range(60)] + [("x", None)]
    q, n = spark.createDataFrame(questions, "qid long, question string"), spark.createDataFrame(notices, "id string, text string")
    got = {tuple(r) for r in ask.relevance_top(q, n, block=block).select("qid", "id", "score", "rank").collect()}
    assert got == brute(questions, notices) and len(got) > 40
    assert ask.relevance_top(q.limit(0), n).count() == 0 == ask.relevance_top(q, n.limit(0)).count()


def test_query_reads_whole_texts_and_all_fields(spark, tmp_path):
    lines = "一般說明\n" + "無關" * 40 + "\n熱泵熱水補助"
    spark.createDataFrame([(20, lines), (40, "每台三萬三千元"), (60, "農漁業者皆可")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [("a", "熱泵熱水補助", None, None, None, None), ("b", "甲", None, None, None, ["每台三萬三千元"]), ("c", "乙", None, None, ["農漁業者"], [])]
    cols = "id string, title string, summary string, target string, target_types array<string>, amount_details array<string>"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/subsidies.parquet")
    got = {(r["qid"], r["id"]) for r in entry.queries()["relevance_topk"](spark, str(tmp_path)).collect()}
    assert got == {(20, "a"), (40, "b"), (60, "c")}
