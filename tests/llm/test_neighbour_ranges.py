from itertools import count

from pyspark.sql import functions as F

from noticeweave.llm import boilerplate as B


def site(spark, n=1000, run=8):
    """Pages of one template, of which a run of neighbours shares frame 7; the numbers have different lengths."""
    fresh = count(100)
    rows = [("h", "/0", f"https://h/{i * 3}", f"{i * 7919 % n:05d}", [next(fresh)] + [7] * (0 <= i - n * 2 // 5 < run) + [next(fresh)], "CCC", f"text {i}") for i in range(n)]
    rows += [("h", "/x0", f"https://h/x{i}", f"x{i}", [5, next(fresh)], "CC", f"x {i}") for i in range(7)]
    return spark.createDataFrame(rows, "host string, template string, url string, key string, frames array<long>, codes string, plain string").repartition(8, "key")


def test_a_run_of_neighbours_keeps_its_pairs_in_a_large_template(spark):
    pages = site(spark)
    assert {tuple(r) for r in B.shared_frames(pages, bucket=50).collect()} == {("h", 7), ("h", 5)}


def test_ranges_change_no_pair(spark):
    pages = site(spark, 120, 5)
    want = {tuple(r) for r in B.shared_frames(pages, bucket=10**6).collect()}
    # 4 + 3 + 2 pairs of the run, within reach of 3; 6 + 5 + 4 of the other template.
    assert want == {tuple(r) for r in B.shared_frames(pages, bucket=10**6, min_pairs=9).collect()} == {("h", 7), ("h", 5)}
    for bucket in (1, 2, 3, 50, 51):
        for pairs in (9, 10, 15, 16):
            got = {tuple(r) for r in B.shared_frames(pages, bucket=bucket, min_pairs=pairs).collect()}
            assert got == {("h", f) for f, n in ((7, 9), (5, 15)) if n >= pairs}
    assert B.shared_frames(pages.where(F.lit(False))).count() == 0


def test_path_order(spark):
    urls = ["https://h/a?id=10", "https://h/a?id=9", "https://h/a?id=0011", "https://h/a?id=123456789012345678901", "https://h/a", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r["url"] for r in df.orderBy(B._path_order(F.col("url"))).collect()]
    assert got == ["", "https://h/a", "https://h/a?id=9", "https://h/a?id=10", "https://h/a?id=0011", "https://h/a?id=123456789012345678901"]
