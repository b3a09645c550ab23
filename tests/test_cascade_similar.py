import __spark_entry__ as entry


def test_pages_that_only_a_number_or_a_similar_name_matches(spark, tmp_path):
    pages = [
        ("u1", "s1", "辦理說明（管字第1159842849號）", "2026-03-01"), ("u2", "s1", "115年度商業服務業節能設備汰換獎助第二梯次", None),
        ("u3", "s1", "114年度商業服務業節能設備汰換獎助第二梯次", None), ("u4", "s2", "115年度商業服務業節能設備汰換獎助第二梯次", None),
        ("u5", "s1", "115年度商業服務業節能設備汰換獎助第三梯次", None), ("u6", "s1", "商業服務業節能設備汰換獎助", None), ("u7", None, None, None),
    ]
    rows = [(u, s, t, "subsidy", None, x) for u, s, t, x in pages]
    spark.createDataFrame(rows, "url string, source_id string, title string, verdict string, subsidy_id string, list_date string").write.parquet(f"{tmp_path}/crawl_urls.parquet")
    spark.createDataFrame([("s1", "能源部節電署"), ("s2", "交通部")], "source_id string, agency string").write.parquet(f"{tmp_path}/sources_status.parquet")
    known = [("n", "別案", "能源部", 2026, "管字第1159842849號"), ("a", "商業服務業節能設備汰換第2梯次", "能源部", 2026, None), ("b", "商業服務業節能設備汰換第2梯次", "能源部", 2026, None)]
    rows = [(i, t, a, y, n, None, None, None) for i, t, a, y, n in known]
    cols = "id string, title string, agency string, year int, doc_no string, official_url string, source_urls array<string>, program_name string"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/subsidies.parquet")
    got = {r["doc"]: (r["match"], r["tier"]) for r in entry.queries()["match_cascade"](spark, str(tmp_path)).collect()}
    assert got == {"u1": ("n", 3), "u2": ("a", 4), "u3": (None, None), "u4": (None, None), "u5": (None, None), "u6": ("a", 4), "u7": (None, None)}
