"""Page furniture around the main content: differencing of pages that are neighbours by URL."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from noticeweave.llm.canonical import ordinary_text
from noticeweave.session import bounded_broadcast, checkpoint, stored

# Words by which a sentence speaks of the site and not of a notice.
SITE_SENTENCES = (
    r"本站|本網站|Cookie|著作權|轉載|重製|正式公文|服務條款|隱私權|資訊安全宣告|本機關保留|以上解析度|告訴朋友|分享給|訂閱|電子報|訊息好友|滿意度"
)
# Words by which any other line does.
SITE_WORDS = (
    r"本站|網站|Cookie|著作權|版權|轉載|正式公文|隱私權|分享|列印|轉寄|收藏|瀏覽|點閱|人氣|人看過|人次|目前線上|回上一頁|解析度|跳到主要|LOGO|"
    r"全球資訊網|選單|MENU|字級|搜尋|Reserved|更多…|朋友|電子報|訂閱|好友|滿意度|^:::$"
)
# What stands before the changing part of a line of the site.
SITE_PREFIXES = (
    r"您的位置|目前位置|現在位置|所在位置|路徑|上一則|下一則|上一篇|下一篇|標籤|關鍵字|分類|發布單位|發布日期|發佈日期|更新日期|最後異動|最後更新|資料更新|"
    r"點閱數|點閱|點擊|瀏覽人次|人氣|上架|地址：|總機|文／|文:|文：|維護：|0\.0\.0 發布|0[-/]0[-/]0 發布"
)
# Headings of side lists.
LIST_HEADS = r"熱門|排行|也想看|相關連結|相關文章|相關消息|近期活動|推薦閱讀|延伸閱讀|猜你喜歡|最多人|最新消息列表|其他消息"
# How titles of notices and news end.
TITLE_ENDS = r"申請|申請公告|公告|FAQ|問答|要點|須知|說明會|機會！|措施|名單|議程|受理）|…|\.\.\.|⋯|計畫|補助|專案|方案|獎助|獎勵|座談會|研討會"
_LIST_MARK = r"^(?:[（(]?0[)）.、．](?!0)|[一二三四五六七八九十]+、|第0[點條]|[●※◎○■◆•]|[問答][：:]|主旨[：:]|說明[：:]|附件[：:0]|依據[：:])"


_FRAME = re.compile(rf"(?:{SITE_PREFIXES}|[‹›◀▶←→])|[^，。#]{{0,6}}#")
_MARKED = re.compile(_LIST_MARK)
_SENTENCE = re.compile(SITE_SENTENCES)
_SITE = re.compile(SITE_WORDS)
_HEAD = re.compile(LIST_HEADS)
_TITLE = re.compile(rf"(?:{TITLE_ENDS})\Z")
_DIGITS = re.compile("[0-9]+")
_BATCH = re.compile(r"第[0一二三四五六七八九十]+(?:梯次|梯|次|期)\Z")
_BARE = str.maketrans("", "", " \u3000「」")
_MEMO: dict[str, tuple[str, int]] = {}


def _signed_hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s)
    return h - (1 << 64) if h >> 63 else h


def line_code(line: str) -> tuple[str, int]:
    """Letter and frame of a trimmed line whose numbers are masked; a protected line has no frame (0).

    b blank, P part of the notice, H head of a side list, I like its items, S speaks of the site, C and W neither
    (W with a comma). Sentences are part of the notice unless they speak of the site; list marks and numbers, as in
    tables, protect a line as well. The frame hashes the part that stays the same from page to page.
    """
    if not line:
        return "b", 0
    if (m := _FRAME.match(line)) and not (len(line) <= 12 and _HEAD.search(line)):
        return "S", _signed_hash(m.group())
    if len(line) <= 12 and _HEAD.search(line):
        code = "H"
    elif _MARKED.match(line):
        return "P", 0
    elif line[-1] in "。；;，":
        if not _SENTENCE.search(line):
            return "P", 0
        code = "S"
    elif _SITE.search(line):
        code = "S"
    elif len(line) >= 8 and _TITLE.search(line):
        code = "I"
    elif "0" in line:
        return "P", 0
    else:
        code = "W" if "，" in line else "C"
    return code, _signed_hash(line)


def _bare(name: str | None) -> str:
    """A title as compared with lines: ordinary letters, numbers masked, no spaces or quotes."""
    return "" if not name else _DIGITS.sub("0", ordinary_text(name)).translate(_BARE).lower()


def mark_page(text: str, agency: str | None, title: str | None, name: str | None) -> tuple[str, list[int], str]:
    """``(plain text, frame of each line, letter of each line)`` of one page; its own title is protected too."""
    plain = ordinary_text(text)
    masked = plain.replace(agency, "@") if agency and len(agency) > 1 else plain
    own_title, own = _bare(title), _bare(name)
    frames, codes = [], []
    for line in _DIGITS.sub("0", masked).split("\n"):
        line = line.strip(" \t")
        got = _MEMO.get(line)
        if got is None:
            got = line_code(line)
            if got[0] != "P":
                if len(_MEMO) > 100_000:
                    _MEMO.clear()
                _MEMO[line] = got
        code, frame = got
        if code in "ICW":
            bare = _BATCH.sub("", line.translate(_BARE).lower())
            if len(bare) >= 6 and (bare in own_title or bare == own):
                code, frame = "P", 0
        codes.append(code)
        frames.append(frame)
    return plain, frames, "".join(codes)


_PAGE = StructType([StructField("plain", StringType()), StructField("frames", ArrayType(LongType())), StructField("codes", StringType())])


@F.pandas_udf(_PAGE)
def _mark_pages(text: pd.Series, agency: pd.Series, title: pd.Series, name: pd.Series) -> pd.DataFrame:
    rows = [mark_page(*row) for row in zip(text, agency, title, name)]
    return pd.DataFrame(rows, columns=["plain", "frames", "codes"])


def page_frames(df: DataFrame, key: str, url: str, text: str, agency: str, title: str, name: Column, keep: tuple = ()) -> DataFrame:
    """``(key, host, template, url, plain, frames, codes, *keep)`` of the pages with text: the only pass over the texts.

    ``plain`` is the text in its ordinary form, with the same lines.
    """
    page = df.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key"),
        F.lower(F.coalesce(F.regexp_extract(url, r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1), F.lit(""))).alias("host"),
        F.regexp_replace(F.coalesce(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), "[0-9]+", "0").alias("template"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        _mark_pages(F.col(text), F.col(agency), F.col(title), name).alias("p"),
        *[F.col(c).alias(c) for c in keep],
    )
    return page.select("key", "host", "template", "url", "p.plain", "p.frames", "p.codes", *keep)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Longest common subsequence of two line lists, by matches and binary search."""
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    cells: list[tuple] = []
    for x in a:
        for j in places.get(x, ()):
            k = bisect_left(ends, j)
            cell = (x, cells[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                cells.append(cell)
            else:
                ends[k], cells[k] = j, cell
    out, cell = [], cells[-1] if cells else None
    while cell:
        out.append(cell[0])
        cell = cell[1]
    return out[::-1]


def _path_order(url: Column) -> Column:
    """A text that sorts as the address does with its numbers taken as numbers: each has its length in front."""
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    number = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 4, "0"), digits(p))
    return F.array_join(F.transform(F.regexp_extract_all(url, F.lit(r"\d+|\D+"), 0), lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def _ranked(pages: DataFrame) -> DataFrame:
    """``pages`` with ``_r``, the place of each by path within its host and template, and no task that holds a template.

    The pages are sorted over all tasks at once; a page's place is its place in its part plus the sizes of the parts before.
    """
    order = ["host", "template", "_path", "key"]
    parts = pages.withColumn("_path", _path_order(F.col("url"))).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = stored(parts.withColumn("_m", F.monotonically_increasing_id()).drop("url", "_path"))
    part = F.shiftright("_m", 33)
    before, so_far = {}, 0
    for p, n in sorted((r["p"], r["n"]) for r in parts.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        before[p], so_far = so_far, so_far + n
    begins = F.create_map(*[F.lit(x) for item in before.items() for x in item]) if before else F.create_map(F.lit(0), F.lit(0))
    parts = parts.withColumn("_g", begins[part.cast("int")].cast("long") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")
    first = parts.groupBy("host", "template").agg(F.min("_g").alias("_first"))
    return parts.join(bounded_broadcast(first, 50_000), ["host", "template"]).withColumn("_r", F.col("_g") - F.col("_first")).drop("_g", "_first")


def _difference(reach: int):
    def run(pages: pd.DataFrame) -> pd.DataFrame:
        pages = pages.sort_values("_r")
        frames = [[x for x in f.tolist() if x] for f in pages["frames"]]
        digest, own = pages["digest"].tolist(), pages["_own"].tolist()
        found: Counter = Counter()
        for i, a in enumerate(frames):
            if not own[i]:
                break
            for j in range(i + 1, min(i + 1 + reach, len(frames))):
                if digest[i] != digest[j]:  # a copy of the same page says nothing about the site
                    found.update(set(common_lines(a, frames[j])))
        host = pages["host"].iat[0] if len(pages) else ""
        return pd.DataFrame({"host": host, "frame": pd.Series(list(found), dtype="int64"), "n": pd.Series(list(found.values()), dtype="int64")})

    return run


def shared_frames(pages: DataFrame, reach: int = 3, bucket: int = 200, min_pairs: int = 3, min_share: float = 0.003) -> DataFrame:
    """``(host, frame)``: frames that neighbouring pages of a host share; host ``*`` holds for every host.

    Pages are paired with the ``reach`` next ones by URL path, within the same host and path template; their frames
    are aligned by longest common subsequence. A host of any size is cut into ranges of ``bucket`` pages in the order
    of the path, each with the ``reach`` pages that follow, so no task ever holds a host and the cut changes no pair. A frame counts for its host if at least ``min_pairs`` alignments,
    and ``min_share`` of the host's, hold it. Of lines that speak of the site, which some pages have and their
    neighbours happen not to, a frame counts everywhere once alignments or pages of several hosts share it.
    """
    sizes = pages.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_n"))
    cut = _ranked(pages.select("host", "template", "url", "key", "frames", F.xxhash64("plain").alias("digest")))
    at = F.floor(F.col("_r") / bucket)
    # The first pages of a range also follow those of the ranges before that reach them.
    cut = cut.withColumn("_b", F.explode(F.sequence(F.floor(F.greatest(F.col("_r") - reach, F.lit(0)) / bucket), at))).withColumn("_own", F.col("_b") == at)
    pairs = cut.groupBy("host", "template", "_b").applyInPandas(_difference(reach), "host string, frame long, n long")
    n_host = sizes.groupBy("host").agg((reach * F.sum("_n")).alias("_pairs"))
    found = pairs.groupBy("host", "frame").agg(F.sum("n").alias("n"))
    own = found.join(n_host, "host").where((F.col("n") >= min_pairs) & (F.col("n") >= min_share * F.col("_pairs")))
    sites = pages.select("host", F.explode(F.array_distinct(F.filter("frames", lambda f, i: F.substring("codes", i + 1, 1) == "S"))).alias("frame"))
    seen = sites.groupBy("frame").agg(F.min("host").alias("a"), F.max("host").alias("b"), F.count(F.lit(1)).alias("n"))
    anywhere = seen.where((F.col("a") != F.col("b")) & (F.col("n") >= min_pairs))
    return own.select("host", "frame").unionByName(anywhere.select(F.lit("*").alias("host"), "frame"))


def _follow_lists(codes: Column) -> Column:
    """The items below a heading of the site, and a line between two lines of the site, are marked L, however far apart."""
    codes = F.regexp_replace(codes, r"(h|(?!\A)\G)(b*)I", "$1$2L")
    return F.regexp_replace(codes, r"(\A|[FhL])(b*)[SCWI](?=b*(?:[FhL]|\z))", "$1$2L")


#: Shared frames, all of one size, up to which they are broadcast; beyond, lines meet them in a shuffled join.
BROADCAST_FRAMES = 200_000


def _marked_codes(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """``pages`` with their codes as an array, F for a line whose frame ``shared`` has, h for such a heading.

    It is looked up for the page's host and, for lines of code S, for every host. Protected and blank lines have no frame.
    """
    none, letters = F.array().cast("array<bigint>"), F.split("codes", "")
    mark = lambda c: F.when(c == "H", "h").otherwise("F")
    if shared.limit(BROADCAST_FRAMES + 1).count() <= BROADCAST_FRAMES:
        every = shared.where("host = '*'").agg(F.collect_set("frame").alias("_every"))
        by_host = shared.where("host <> '*'").groupBy(F.col("host").alias("_host")).agg(F.collect_set("frame").alias("_shared"))
        pages = pages.join(F.broadcast(by_host), F.col("host") == F.col("_host"), "left").join(F.broadcast(every))
        pages = pages.withColumn("_shared", F.coalesce("_shared", none))
        seen = F.transform(
            letters,
            lambda c, i: F.when(c.isin("P", "b", "W"), c)
            .when((c == "S") & F.array_contains("_every", F.get("frames", i)), "F")
            .when(F.array_contains("_shared", F.get("frames", i)), mark(c)).otherwise(c),
        )
        return pages.withColumn("_codes", seen).drop("_host", "_shared", "_every")
    pages = pages.withColumn("_page", F.xxhash64("plain"))
    lines = pages.select("key", "_page", "host", "codes", F.posexplode("frames").alias("_i", "frame")).where("frame <> 0")
    code = F.substring("codes", F.col("_i") + 1, F.lit(1))
    own = lines.where(code.isin("H", "S", "C", "I")).drop("codes")
    anywhere = lines.where(code == "S").drop("codes").withColumn("host", F.lit("*"))
    hit = own.unionByName(anywhere).join(shared, ["host", "frame"], "left_semi")
    hit = hit.groupBy(F.col("key").alias("_key"), F.col("_page").alias("_p")).agg(F.collect_set("_i").alias("_at"))
    pages = pages.join(hit, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_page") == F.col("_p")), "left")
    found = F.coalesce("_at", F.array().cast("array<int>"))
    return pages.withColumn("_codes", F.transform(letters, lambda c, i: F.when(F.array_contains(found, i), mark(c)).otherwise(c))).drop("_page", "_key", "_p", "_at")


def marked_pages(
    df: DataFrame, key: str, url: str, text: str, agency: str, title: str, name: Column, keep: tuple = (), **limits: float
) -> DataFrame:
    """``(key, plain, codes, *keep)``: each page's ordinary text and one letter per line; h, F and L are lines of the site.

    Lines whose frame neighbouring pages share are deleted, save for those that ``_code`` protects: standing clauses,
    numbered lines, tables and the page's own title recur too, but belong to the notice. Titles below the heading of a
    side list go with the heading, as each page lists other ones. Pages without text give no row,
    pages without a partner keep all lines that no other host has; a missing URL counts as one host of its own.
    """
    pages = stored(page_frames(df, key, url, text, agency, title, name, keep))
    shared = checkpoint(shared_frames(pages, **limits))
    known = _marked_codes(pages.select("key", "host", "plain", "frames", "codes", *keep), shared)
    codes = _follow_lists(F.array_join("_codes", ""))
    return known.select("key", "plain", codes.alias("codes"), *keep)


def furniture_lines(marked: DataFrame) -> DataFrame:
    """Distinct ``(key, line_no)`` of the non-blank lines that belong to the site, ``line_no`` from 0."""
    out = marked.select("key", F.posexplode(F.split("codes", "")).alias("line_no", "code"))
    return out.where(F.col("code").isin("h", "F", "L")).select("key", "line_no").distinct()


def notice_lines(marked: DataFrame) -> DataFrame:
    """``(key, lines)``: the lines of the notice alone, in ordinary form."""
    keep = F.filter(F.split("plain", "\n", -1), lambda x, i: ~F.substring("codes", i + 1, 1).isin("h", "F", "L"))
    return marked.select("key", keep.alias("lines"))


def main_text(df: DataFrame, key: str, text: str, furniture: DataFrame) -> DataFrame:
    """``(key, text, n_removed)``: the texts of ``df`` without their furniture lines, nulls kept null."""
    drop = furniture.groupBy(F.col("key").alias("_key")).agg(F.collect_set("line_no").alias("_drop"))
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(drop, F.col("key") == F.col("_key"), "left")
    none = F.array().cast("array<int>")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("_drop", none), i))
    return out.select(
        "key",
        F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("_drop"), F.lit(0)).alias("n_removed"),
    )
