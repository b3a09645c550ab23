import io
import zipfile

from pyspark.sql import functions as F

from noticeweave.sources import documents, pages, robots
from noticeweave.streaming import state

PAGE = """<html><head><title>T</title><script>x</script></head><body><nav><a href="/n">導覽導覽導覽</a></nav>
<div id=a><h1>節能補助公告</h1><p>本計畫補助老舊設備之汰換與改善作業，自公告日起受理申請，至經費用罄為止，申請者應備妥各項文件並於期限內送達。</p></div>
<ul><li>115-04-10 <a href="/x#top" title="另開新視窗">第二期受理申請公告</a><li><a href="javascript:void(0)">不可取用的連結</a></ul></body>"""


def test_robots(spark):
    text = "User-agent: x\nDisallow: /\n\nUser-agent: *\nUser-agent: y\nDisallow: /a # c\nAllow: /a/b\nDisallow: /*?q=\nDisallow: /end$\nDisallow:\n"
    assert robots.parse(text) == [(False, "/a"), (True, "/a/b"), (False, "/*?q="), (False, "/end$")]
    rules = robots.rules_of(spark, {"h": text})
    urls = ["https://h/a/c", "https://h/a/b/d", "https://h/z?q=1", "https://h/end", "https://h/endless", "https://h", "https://other/a"]
    df = spark.createDataFrame([(u, u.split("/")[2]) for u in urls], "url string, host string")
    got = {r["url"]: r["allowed"] for r in robots.allowed(df, rules).collect()}
    assert [got[u] for u in urls] == [False, True, False, False, True, True, True]


def test_pages(spark):
    assert pages.list_links(PAGE, "https://h/d/") == [("https://h/n", "導覽導覽導覽", None, True), ("https://h/x", "第二期受理申請公告", "2026-04-10", False)]
    title, heading, text = pages.main_part(PAGE)
    assert (title, heading) == ("T", "節能補助公告") and text.startswith("節能補助公告\n本計畫") and "導覽" not in text
    assert pages.main_part("") == (None, None, "")
    df = spark.createDataFrame([(PAGE, "https://h/"), (None, None), ("<p><b>x", None)], "h string, b string")
    assert [len(r[0]) for r in df.select(pages.links_of("h", "b")).collect()] == [2, 0, 0]
    assert [r[0]["title"] for r in df.select(pages.main_of("h")).collect()] == ["T", None, None]


def test_redirects_and_sets(spark):
    rows = ['<meta http-equiv="refresh" content="0; url=/to">', "<script>// location.href='/no'\nlocation.href='/yes'</script>", "x", None]
    df = spark.createDataFrame([(r,) for r in rows], "h string")
    assert [r[0] for r in df.select(pages.redirect_target(F.col("h"))).collect()] == ["/to", "/yes", None, None]
    df = spark.createDataFrame([("text/html; charset=MS950", ""), (None, '<meta charset="UTF-8">'), (None, "")], "c string, h string")
    assert [r[0] for r in df.select(pages.charset_of(F.col("c"), F.col("h"))).collect()] == ["big5", "utf-8", "utf-8"]
    df = spark.createDataFrame([(bytearray("節能".encode("big5")), "big5"), (bytearray(b"\xef\xbb\xbfa"), "big5"), (bytearray(b"a"), "odd"), (None, "utf-8")], "d binary, c string")
    assert [r[0] for r in df.select(pages.decoded("d", "c")).collect()] == ["節能", "a", "a", None]


def test_documents(spark, tmp_path):
    odt = io.BytesIO()
    with zipfile.ZipFile(odt, "w") as z:
        z.writestr("content.xml", "<x><text:p>甲&amp;乙</text:p><text:p>丙</text:p></x>")
    both = io.BytesIO()
    with zipfile.ZipFile(both, "w") as z:
        z.writestr("a.odt", odt.getvalue())
    (tmp_path / "a.zip").write_bytes(both.getvalue())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    got = {r["path"][-5:]: r["text"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.zip": "甲&乙\n丙", "b.pdf": ""}
    names = spark.createDataFrame([("attachment; filename*=UTF-8''%E7%94%B2.pdf",), ('attachment; filename="b.odt"',), ("inline",)], "d string")
    assert [r[0] for r in names.select(documents.filename_of(F.col("d"))).collect()] == ["甲.pdf", "b.odt", None]


def test_streaming(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.sql("select * from values (timestamp'2026-01-01 15:00:00', 'a'), (timestamp'2026-01-01 16:00:00', 'a'), (timestamp'2026-01-20 00:00:00', 'b') t(ts, k)")
    rows.write.parquet(src)
    stream = state.read_stream(spark, src, rows.schema)
    state.run_available(state.daily_counts(stream, "ts", "k"), sink, str(tmp_path / "cp"))
    got = {(str(r["day"]), r["k"], r["n"]) for r in spark.read.parquet(sink).collect()}
    assert {("2026-01-01", "a", 1), ("2026-01-02", "a", 1)} <= got


def test_snapshot_stream(spark, tmp_path):
    src, snap, cp = str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "cp")
    cols = "k string, seen int, at int, v string"
    spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y")], cols).coalesce(1).write.parquet(src)
    state.keep_snapshot(state.read_stream(spark, src, spark.read.parquet(src).schema), snap, cp, "k", "at", ["seen"])
    spark.createDataFrame([("a", 9, 3, "z"), ("b", 9, 3, "w")], cols).coalesce(1).write.mode("append").parquet(src)
    state.keep_snapshot(state.read_stream(spark, src, spark.read.parquet(src).schema), snap, cp, "k", "at", ["seen"])
    assert {tuple(r) for r in state.latest(spark, snap).collect()} == {("a", 2, 3, "z"), ("b", 9, 3, "w")}
