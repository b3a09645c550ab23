"""Dates and periods in free text: every date with its place, application periods, announcement dates, batches."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from noticeweave.functions.text import _FROM, _TO, BATCH_NUMERALS, WIDE_SIGNS

_text, _flag, _int = StringType(), BooleanType(), IntegerType()
DATES = ArrayType(StructType([StructField("day", _text), StructField("begin", _int), StructField("end", _int)]))
PERIOD = StructType(
    [StructField(n, _text) for n in ("start", "end", "end_time", "raw")] + [StructField(n, _flag) for n in ("until_quota", "from_today", "varies")]
)
BATCH = StructType(
    [StructField("no", _int), StructField("tentative", _flag), StructField("only", _text)] + [StructField(n, _text) for n in ("start", "end", "end_time", "raw")]
)

# The two ways of writing a whole date, and a day without a year.
HAN_DATE = r"(?:中華民國|民國|西元)?\s*(?P<y>\d{2,4})\s*年\s*(?P<m>\d{1,2})\s*月\s*(?P<d>\d{1,2})\s*日"
CUT_DATE = r"(?<![\d.])(?P<y>\d{2,4})\s*(?P<sep>[/.\-])\s*(?P<m>\d{1,2})\s*(?P=sep)\s*(?P<d>\d{1,2})(?![\d.])"
MONTH_DAY = r"(?<![\d年])(\d{1,2})\s*月\s*(\d{1,2})\s*日"
# Labels of application periods.
LABELS = (
    "申請補助期間|補助申請期間|受理補助申請期間|申請受理期間|申請期間|受理期間|受理申請期間|收件期間|申請時間|受理時間|收件時間|申請日期|受理日期|"
    "徵件期間|申請收件期間|計畫申請期間|申請截止|收件截止|截止收件|截止日期|申請期限|受理期限|開放申請|受理申請"
)
# Periods of other things, words of announcements of today, of quotas, and labels of announcement dates.
OTHER_PERIODS = "執行期程|執行期間|輔導期程|計畫期程|計畫期間|委託期間|結案|完工|有效期間|購買期間|購置期間|回收證明|訓練期間|活動期間|履約|保固|竣工|專案期程"
FROM_TODAY = "即日起|(?:自)?公告(?:之)?日起"
UNTIL_QUOTA = "額滿為止|額滿即止|額滿截止|用罄為止|經費用(?:罄|完)為止|預算用(?:罄|完)為止|額滿即停止|用罄即停止"
ANNOUNCED = "發布日期|發佈日期|公告日期|發文日期|上稿日期|上版日期|刊登日期|張貼日期|公布日期|發布時間|發佈時間|公告時間"
ACTS = "申請|提案|函送|報名|送件|提出|送達|收件"
_BETWEEN = "[至到~迄]"

_PLAIN = str.maketrans(WIDE_SIGNS[0] + _FROM, WIDE_SIGNS[1] + _TO)
_WRITTEN_YEAR = re.compile("一百[零一二三四五六七八九十]{0,3}(?= *年)")
_PATTERNS = [re.compile(HAN_DATE), re.compile(CUT_DATE)]
_LABEL = re.compile(f"(?:{LABELS})")
_STATED = re.compile(r"\s*(?:[:：]|自|即日起|公告|為|於|至|起|\d)")
_ITEM = re.compile(r"\s*(?:[（(][一二三四五六七八九十\d]+[)）]|\d+[.、]|第[一二三四五]類)")
_RANGE = re.compile(r"(?:自|即日起|於)[^。\n]{0,40}?(?:至|到|~|～|－|迄)[^。\n]{0,40}?(?:止|為止|截止|受理|收件)")
_BEFORE_DAY = r"\d{2,4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日\s*[)）]?\s*前"
_DEADLINE = re.compile(rf"(?:{ACTS})[^。\n]{{0,50}}?{_BEFORE_DAY}|{_BEFORE_DAY}[^。\n]{{0,40}}?(?:{ACTS})")
_OTHER, _TODAY, _QUOTA = re.compile(OTHER_PERIODS), re.compile(FROM_TODAY), re.compile(UNTIL_QUOTA)
_CLOCK = re.compile(r"(上午|下午|中午|晚上)?\s*(\d{1,2})\s*[時点點:](?:\s*(\d{1,2})\s*分?)?")
_BATCH_LINE = re.compile(r"第\s*([一二三四五六七八九十\d]+)\s*梯(?:次)?([^:：\n]{0,40})[:：]\s*([^\n]+)")


@dataclass(frozen=True)
class Day:
    """A whole date and where it stands."""

    iso: str
    begin: int
    end: int


def plain(text: str | None) -> str:
    """A text as ``text.normalize_text`` makes it, for the functions that need places in it."""
    s = re.sub("[\u00a0\u3000\t]+", " ", (text or "").translate(_PLAIN)).replace("\r", "")
    return _WRITTEN_YEAR.sub(lambda m: _hundreds(m[0]), s) if "一百" in s else s


def _hundreds(s: str) -> str:
    m = re.fullmatch("一百零?(?:([一二三四五六七八九]?)(十))?([一二三四五六七八九])?", s)
    if not m:
        return s
    digit = lambda c, none: "一二三四五六七八九".index(c) + 1 if c else none
    return str(100 + (10 * digit(m[1], 1) if m[2] else 0) + digit(m[3], 0))


def _iso(y: str | int, m: str | int, d: str | int) -> str | None:
    """An existing day of 1990 to 2100; years of two or three digits from 70 to 200 count from 1911."""
    year = int(y)
    if len(str(y)) != 4:
        year = year + 1911 if 70 <= year <= 200 else 0
    try:
        return date(year, int(m), int(d)).isoformat() if 1990 <= year <= 2100 else None
    except ValueError:
        return None


def find_dates(text: str | None) -> list[Day]:
    """All whole, existing dates in order; of two that overlap the first counts."""
    t = plain(text)
    found = [Day(v, *m.span()) for p in _PATTERNS for m in p.finditer(t) if (v := _iso(m["y"], m["m"], m["d"]))]
    out: list[Day] = []
    for d in sorted(found, key=lambda d: d.begin):
        if not out or d.begin >= out[-1].end:
            out.append(d)
    return out


def clock(text: str) -> str | None:
    """The first time of day in a text as HH:MM; an impossible one gives None."""
    if not (m := _CLOCK.search(plain(text))):
        return None
    h, mi = int(m[2]), int(m[3] or 0)
    if h < 12 and m[1] in ("下午", "晚上"):
        h += 12
    elif h < 12 and m[1] == "中午":
        h = 12
    return f"{h:02d}:{mi:02d}" if h < 24 and mi < 60 else None


@dataclass
class Span:
    start: str | None = None
    end: str | None = None
    end_time: str | None = None
    from_today: bool = False


def _days_of(sentence: str, today: bool) -> list[Day]:
    """The dates of a sentence; an end that names month and day alone has the year of the only date before it."""
    days = find_dates(sentence)
    if len(days) == 1 and not today:
        rest = sentence[days[0].end :]
        md, sep = re.search(MONTH_DAY, rest), re.search("至|到|~|-|－|迄", rest)
        if md and sep and sep.start() < md.start():
            end = _iso(days[0].iso[:4], md[1], md[2])
            if end and end >= days[0].iso:
                days.append(Day(end, days[0].end + md.start(), days[0].end + md.end()))
    return days


def read_sentence(sentence: str, announced: str | None = None) -> Span | None:
    """The period that one sentence states, or None.

    Two dates joined by words of reaching are a period; else from today to a date, a last day, a first day. Several dates
    that nothing joins say nothing. A start after the end is dropped.
    """
    today = bool(_TODAY.search(sentence))
    days = _days_of(sentence, today)
    joined = next(
        ((a, b) for a, b in zip(days, days[1:]) if b.begin - a.end <= 24 and re.search("至|到|~|迄|－|-", gap := sentence[a.end : b.begin]) and not re.search("[。；]", gap)),
        None,
    )
    one = days[0] if days else None
    after = lambda d: clock(sentence[d.end : d.end + 15])
    if joined:
        out = Span(joined[0].iso, joined[1].iso, after(joined[1]))
    elif today:
        out = Span(announced, one.iso if one else None, after(one) if one else None, True)
    elif len(days) != 1:
        return None
    else:
        before = sentence[: one.begin]
        last = re.search(r"截止|期限|前(?:送達|提出|寄達|申請)|為止|止\Z|日\s*[)）]?\s*前", sentence) and not re.search(_BETWEEN, before)
        if last or re.search(_BETWEEN + r".{0,6}\Z", before):
            out = Span(None, one.iso, after(one))
        elif "起" in sentence[one.end : one.end + 4]:
            out = Span(one.iso)
        else:
            return None
    if out.start and out.end and out.start > out.end:
        out.start = None
    return out


def _labelled(t: str) -> list[str | list[str]]:
    """What stands behind each label of a period: its line, or the listed lines below it."""
    out: list[str | list[str]] = []
    for m in _LABEL.finditer(t):
        if not _STATED.match(t[m.end() : m.end() + 4]):
            continue
        stop = t.find("\n", m.end())
        piece = t[m.start() : stop if stop >= 0 else m.start() + 200]
        if not re.search(r"\d|即日起|公告日", piece[len(m[0]) :]):
            listed = []
            for line in t[m.end() :].split("\n")[1:6]:
                if not _ITEM.match(line) or not re.search(r"\d", line):
                    break
                listed.append(line.strip())
            if len(listed) >= 2:
                out.append(listed)
                continue
            piece = " ".join(t[m.start() : m.start() + 200].split("\n")[:2])
        out.append(piece[:220])
    return out


def period_of(text: str | None, announced: str | None = None) -> tuple:
    """``(start, end, end_time, raw, until_quota, from_today, varies)`` of the first statement that can be read.

    Statements behind labels come first, then ranges, then last days alone; those of other periods are passed over. Of
    listed kinds the first start and the last end count, and ``varies`` tells whether their ends differ.
    """
    t = plain(text)
    quota = bool(_QUOTA.search(t))
    tries = _labelled(t)
    for m in _RANGE.finditer(t):
        if not _OTHER.search(t[max(0, m.start() - 30) : m.start()].split("。")[-1] + m[0]):
            tries.append(t[m.start() : m.end() + 20])
    tries += [m[0] for m in _DEADLINE.finditer(t) if not _OTHER.search(t[max(0, m.start() - 20) : m.start()] + m[0])]
    for piece in tries:
        if isinstance(piece, list):
            parts = [p for line in piece if (p := read_sentence(line, announced))]
            if len(parts) >= 2:
                ends, starts = sorted(p.end for p in parts if p.end), sorted(p.start for p in parts if p.start)
                last = ends[-1] if ends else None
                raw = "；".join(re.sub("[。；;]+\\Z", "", re.sub(r"^\s*[（(][一二三四五六七八九十\d]+[)）]\s*", "", x)) for x in piece)[:220]
                time = next((p.end_time for p in parts if p.end == last), None)
                return (starts or [None])[0], last, time, raw, quota, any(p.from_today for p in parts), len(set(ends)) > 1
            continue
        sentence = re.split("[。；;]", piece)[0]
        if got := read_sentence(sentence, announced):
            return got.start, got.end, got.end_time, re.sub(r"\s+", " ", sentence).strip()[:140], quota, got.from_today, False
    return None, None, None, None, quota, False, False


def announced_on(text: str | None) -> str | None:
    """The announcement date: behind a label, else the line of a date below a line that ends with 公告 at the head of a letter."""
    t = plain(text)
    for m in re.finditer(rf"(?:{ANNOUNCED})\s*[:：]?\s*", t):
        if days := find_dates(t[m.start() : m.start() + 40]):
            return days[0].iso
    head = t.split("\n")[:9]
    for line, below in zip(head[:8], [*head[1:], ""]):
        if re.search(r"公告\s*\Z", line):
            if re.fullmatch(r"(?:中華民國)?\s*\d{2,4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", below.strip()):
                return next((d.iso for d in find_dates(below)), None)
    return None


def batches_of(text: str | None) -> list[tuple]:
    """``(no, tentative, only, start, end, end_time, raw)`` of each batch that a text lists with an end."""
    out = []
    for m in _BATCH_LINE.finditer(plain(text)):
        start, end, time, *_ = period_of(m[3])
        if end:
            only = re.search(r"僅受理\s*[「『]([^」』]+)[」』]", m[2])
            no = int(m[1]) if m[1].isdigit() else BATCH_NUMERALS.find(m[1]) + 1
            raw = f"第{m[1]}梯{m[2].strip()}：{m[3].strip()}"[:160]
            out.append((no, "暫定" in m[2] + m[3], unicodedata.normalize("NFKC", only[1]) if only else None, start, end, time, raw))
    return out


@F.pandas_udf(DATES)
def dates_in(texts: pd.Series) -> pd.Series:
    """Every whole date of a text in order with its place in the normalised text."""
    return pd.Series([[(d.iso, d.begin, d.end) for d in find_dates(t)] for t in texts])


@F.pandas_udf(PERIOD)
def period_in(texts: pd.Series, announced: pd.Series) -> pd.DataFrame:
    rows = [period_of(t, a if isinstance(a, str) else None) for t, a in zip(texts, announced)]
    return pd.DataFrame(rows, columns=PERIOD.names).astype(object).where(lambda d: d.notna(), None)


@F.pandas_udf(_text)
def announcement_in(texts: pd.Series) -> pd.Series:
    return pd.Series([announced_on(t) for t in texts], dtype=object)


@F.pandas_udf(ArrayType(BATCH))
def batches_in(texts: pd.Series) -> pd.Series:
    return pd.Series([batches_of(t) for t in texts])


def picked_batch(batches: Column, today: Column, category: Column | None = None) -> Column:
    """Of the batches open to a category the one that is open today, else the next one, else the last; by end, then number."""
    fits = batches if category is None else F.filter(batches, lambda b: category.isNull() | b["only"].isNull() | (b["only"] == category))
    order = F.array_sort(F.transform(fits, lambda b: F.struct(b["end"].alias("e"), b["no"].alias("n"), b.alias("b"))))
    listed = F.transform(order, lambda x: x["b"])
    is_open = F.filter(listed, lambda b: (b["start"].isNull() | (b["start"] <= today)) & (b["end"] >= today))
    coming = F.filter(listed, lambda b: b["start"] > today)
    return F.coalesce(F.get(is_open, F.lit(0)), F.get(coming, F.lit(0)), F.try_element_at(listed, F.lit(-1)))
