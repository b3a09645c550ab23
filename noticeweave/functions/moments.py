"""Reading dates and times in many writings: a pure-Python core and Arrow-batched UDFs.

A reading is ``(local_s, zone, abbr, epoch_s)``: the wall-clock time in seconds, the zone it is meant in, the
abbreviation that was written, and, where the text states an offset, the instant itself.
"""

from __future__ import annotations

import calendar
import os
import re
import struct
import zoneinfo
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

READING = StructType(
    [
        StructField("local_s", LongType()),
        StructField("zone", StringType()),
        StructField("abbr", StringType()),
        StructField("epoch_s", LongType()),
    ]
)
HOME_ZONE = "Asia/Taipei"

# Written names of zones.
ZONE_OF = {
    "EST": "America/New_York", "EDT": "America/New_York", "ET": "America/New_York",
    "CST": "America/Chicago", "CDT": "America/Chicago",
    "MST": "America/Denver", "MDT": "America/Denver",
    "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles", "PT": "America/Los_Angeles",
    "CET": "Europe/Brussels", "CEST": "Europe/Brussels",
    "WET": "Europe/Lisbon", "WEST": "Europe/Lisbon", "EET": "Europe/Athens", "EEST": "Europe/Athens",
    "GMT": "UTC", "BST": "Europe/London",
    "AEST": "Australia/Sydney", "AEDT": "Australia/Sydney",
    "NZST": "Pacific/Auckland", "NZDT": "Pacific/Auckland",
    "JST": "Asia/Tokyo", "KST": "Asia/Seoul", "HKT": "Asia/Hong_Kong", "SGT": "Asia/Singapore",
    "IST": "Asia/Kolkata", "UTC": "UTC", "Z": "UTC",
    "紐約": "America/New_York", "美東": "America/New_York", "華盛頓": "America/New_York", "芝加哥": "America/Chicago",
    "美西": "America/Los_Angeles", "洛杉磯": "America/Los_Angeles", "舊金山": "America/Los_Angeles",
    "倫敦": "Europe/London", "柏林": "Europe/Berlin", "布魯塞爾": "Europe/Brussels", "巴黎": "Europe/Paris",
    "歐洲中部": "Europe/Brussels", "東京": "Asia/Tokyo", "日本": "Asia/Tokyo", "首爾": "Asia/Seoul",
    "雪梨": "Australia/Sydney", "新加坡": "Asia/Singapore", "香港": "Asia/Hong_Kong",
    "台北": "Asia/Taipei", "臺北": "Asia/Taipei", "台灣": "Asia/Taipei", "臺灣": "Asia/Taipei",
    "HST": "Pacific/Honolulu", "AKST": "America/Anchorage", "AKDT": "America/Anchorage", "CT": "America/Chicago", "MT": "America/Denver",
    "AST": "America/Halifax", "ADT": "America/Halifax", "NST": "America/St_Johns", "NDT": "America/St_Johns",
    "BRT": "America/Sao_Paulo", "ART": "America/Argentina/Buenos_Aires", "CLT": "America/Santiago", "COT": "America/Bogota", "PET": "America/Lima",
    "MSK": "Europe/Moscow", "TRT": "Europe/Istanbul", "MEZ": "Europe/Berlin", "MESZ": "Europe/Berlin",
    "SAST": "Africa/Johannesburg", "EAT": "Africa/Nairobi", "WAT": "Africa/Lagos", "CAT": "Africa/Maputo",
    "IDT": "Asia/Jerusalem", "IRST": "Asia/Tehran", "GST": "Asia/Dubai", "PKT": "Asia/Karachi", "NPT": "Asia/Kathmandu", "MMT": "Asia/Yangon",
    "ICT": "Asia/Bangkok", "WIB": "Asia/Jakarta", "WITA": "Asia/Makassar", "WIT": "Asia/Jayapura", "PHT": "Asia/Manila", "MYT": "Asia/Kuala_Lumpur",
    "AWST": "Australia/Perth", "ACST": "Australia/Adelaide", "ACDT": "Australia/Adelaide",
    "格林威治": "UTC", "格林尼治": "UTC", "格林威治平均": "UTC", "世界協調": "UTC", "協調世界": "UTC",
    "波士頓": "America/New_York", "多倫多": "America/Toronto", "溫哥華": "America/Vancouver", "西雅圖": "America/Los_Angeles", "夏威夷": "Pacific/Honolulu",
    "莫斯科": "Europe/Moscow", "羅馬": "Europe/Rome", "馬德里": "Europe/Madrid", "日內瓦": "Europe/Zurich", "阿姆斯特丹": "Europe/Amsterdam",
    "大阪": "Asia/Tokyo", "北京": "Asia/Shanghai", "上海": "Asia/Shanghai", "曼谷": "Asia/Bangkok", "河內": "Asia/Bangkok", "雅加達": "Asia/Jakarta",
    "吉隆坡": "Asia/Kuala_Lumpur", "馬尼拉": "Asia/Manila", "新德里": "Asia/Kolkata", "杜拜": "Asia/Dubai", "墨爾本": "Australia/Melbourne", "奧克蘭": "Pacific/Auckland",
}
# Names that mean a zone only where 時間 follows.
REGION_OF = {
    "中原": HOME_ZONE, "國家": HOME_ZONE, "太平洋": "America/Los_Angeles", "美國東部": "America/New_York", "美國中部": "America/Chicago",
    "美國山區": "America/Denver", "美國西部": "America/Los_Angeles", "美中": "America/Chicago", "歐洲東部": "Europe/Athens", "歐洲西部": "Europe/Lisbon",
    "英國": "Europe/London", "法國": "Europe/Paris", "德國": "Europe/Berlin", "韓國": "Asia/Seoul", "泰國": "Asia/Bangkok", "印度": "Asia/Kolkata",
    "中國": "Asia/Shanghai", "菲律賓": "Asia/Manila", "馬來西亞": "Asia/Kuala_Lumpur", "紐西蘭": "Pacific/Auckland", "澳洲東部": "Australia/Sydney",
}
ZONES = sorted(zoneinfo.available_timezones())
_KNOWN = frozenset(ZONES)
# English names that mean a zone where "time" follows: the cities of the tz database and these.
ENGLISH_OF = {z.rsplit("/", 1)[-1].replace("_", " "): z for z in ZONES if "/" in z} | {
    "Greenwich Mean": "UTC", "Coordinated Universal": "UTC", "Universal": "UTC", "Eastern": "America/New_York", "Central": "America/Chicago",
    "Mountain": "America/Denver", "Pacific": "America/Los_Angeles", "Central European": "Europe/Brussels", "Eastern European": "Europe/Athens",
    "Taiwan": HOME_ZONE, "Local": HOME_ZONE, "Japan": "Asia/Tokyo", "Korea": "Asia/Seoul", "Hong Kong": "Asia/Hong_Kong", "Singapore": "Asia/Singapore",
    "India": "Asia/Kolkata", "Washington": "America/New_York", "Geneva": "Europe/Zurich",
}
# English month names.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
# Chinese numerals.
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}

_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: " ", 0xA0: " ", 0x2009: " ", 0x202F: " "}
_WIDE |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)} | {0x301C: "~", 0x2013: "-"}
_HAN = r"[零〇一二三四五六七八九十百]"
_HAN_DATE = re.compile(rf"({_HAN}+)(?= *年)|(?<=年)( *{_HAN}+)(?= *月)|(?<=月)( *{_HAN}+)(?= *日)")
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_DATE = re.compile(
    r"(?<!\d)(?P<y1>\d{1,4}) ?年 ?(?P<m1>\d{1,2}) ?月 ?(?P<d1>\d{1,2}) ?日"
    r"|(?<![\d.])(?P<y2>\d{2,4})(?P<sep>[-/.])(?P<m2>\d{1,2})(?P=sep)(?P<d2>\d{1,2})(?!\d)"
    rf"|(?<![a-z]){_MON.replace('(', '(?P<n3>', 1)} +(?P<d3>\d{{1,2}})(?:st|nd|rd|th)?,? +(?P<y3>\d{{4}})"
    rf"|(?<!\d)(?P<d4>\d{{1,2}})(?:st|nd|rd|th)? +{_MON.replace('(', '(?P<n4>', 1)},? +(?P<y4>\d{{4}})"
    r"|(?<=[至到~-])(?: ?)(?P<m5>\d{1,2}) ?月 ?(?P<d5>\d{1,2}) ?日"
    r"|(?<=[至到~])(?: ?)(?P<m6>\d{1,2})/(?P<d6>\d{1,2})(?![\d/])",
    re.I,
)
_TIME = re.compile(
    r"(?: *\((?:星期|週|周)[一二三四五六日天]\))?[ T,(]*"
    r"(?P<half>上午|早上|清晨|凌晨|中午|下午|午後|傍晚|晚上|晚間|午夜|正午|a\.?m\.?|p\.?m\.?)? ?"
    r"(?:(?P<h>\d{1,2})(?:: ?(?P<mi>\d{2})(?:: ?(?P<s>\d{2})(?:[.,]\d+)?)?|(?P<dot> ?[點時](?:整|正)?)(?: ?(?P<mi2>\d{1,2}) ?分| ?(?P<hb>半))?"
    r"|(?= ?(?:[ap]\.?m(?![a-z])|noon|midnight)))"
    r" ?(?P<half2>[ap]\.?m\.?(?![a-z])|noon|midnight)?)?",
    re.I,
)
_NAMED = sorted((k for k in ZONE_OF if k[0] > "z"), key=lambda k: (-len(k), k))
_KIND = "(?:當地|標準|标准|夏令|日光節約)"
_ZONE = re.compile(
    r" ?[(（]?(?:(?P<off>(?:UTC|GMT)? ?[+-]\d{1,2}(?::?\d{2})?)(?![\d:/.])"
    r"|(?P<iana>[A-Z][A-Za-z]+(?:/[A-Z][A-Za-z0-9_]*(?:[+-][A-Za-z0-9_]+)*)+)|(?P<abbr>[A-Z]{2,5}|Z)(?![A-Za-z])"
    rf"|(?P<city>{'|'.join(_NAMED)}){_KIND}*(?:時間|时间)?|(?P<region>{'|'.join(REGION_OF)}){_KIND}*(?:時間|时间)"
    rf"|(?P<other>[\u4e00-\u9fff]{{2,8}}?){_KIND}(?:時間|时间)"
    r"|(?P<english>[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}?)(?: (?:[Ss]tandard|[Dd]aylight|[Ss]ummer|[Ll]ocal))? [Tt]ime(?![a-z]))"
)
_ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
_HHMM = re.compile(r"(?:[01]\d|2[0-3]):[0-5]\d\Z")


def han_number(s: str) -> int:
    """Chinese numerals below 1,000; digit by digit where no unit is written."""
    if not re.search("[十百]", s):
        return int("".join(str(NUMERALS[c]) for c in s))
    total, digit = 0, None
    for c in s:
        if c == "百":
            total, digit = total + 100 * (1 if digit is None else digit), None
        elif c == "十":
            total, digit = total + 10 * (digit or 1), None
        else:
            digit = NUMERALS[c]
    return total + (digit or 0)


def tidy(text: str) -> str:
    """Full-width signs, odd spaces and Chinese numerals in dates brought to ASCII digits."""
    s = text.translate(_WIDE).strip()
    if "年" in s and _HAN_DATE.search(s):
        s = _HAN_DATE.sub(lambda m: str(han_number(m.group().strip())), s)
    return s


def _wall(y: int, m: int, d: int) -> int | None:
    """Seconds of midnight of an existing day, years below 1000 counted from 1911."""
    y = y + 1911 if y < 1000 else y
    if not (1 <= y <= 9998 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    return (date(y, m, d) - date(1970, 1, 1)).days * 86400


def _offset(s: str) -> int:
    m = re.search(r"([+-])(\d{1,2}):?(\d{2})?", s)
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60)


def read_time(s: str, at: int) -> tuple[int | None, int | None, str | None, str | None, int]:
    """``(seconds of day, offset, zone, abbreviation, end)`` of the time that stands at ``at``.

    No time gives None, an impossible one -1.
    """
    m = _TIME.match(s, at)
    secs, end = None, at
    if m and m["h"]:
        h, mi = int(m["h"]), int(m["mi"] or m["mi2"] or (30 if m["hb"] else 0))
        half = (m["half"] or m["half2"] or "").lower().replace(".", "")
        if half in ("下午", "午後", "傍晚", "晚上", "晚間", "pm") and h < 12:
            h += 12
        elif half in ("中午", "正午", "noon") and h < 11:
            h += 12
        elif half in ("上午", "早上", "清晨", "凌晨", "am") and h == 12:
            h = 0
        elif half in ("午夜", "midnight", "晚上", "晚間") and h == 12:
            h = 24
        sec = int(m["s"] or 0)
        ok = mi < 60 and sec < 60 and (h < 24 or (h == 24 and mi == sec == 0))
        secs, end = (h * 3600 + mi * 60 + sec if ok else -1), m.end()
    elif m and m["half"] in ("正午", "午夜"):
        secs, end = (43200 if m["half"] == "正午" else 86400), m.end()
    off = zone = abbr = None
    if secs is not None and (z := _ZONE.match(s, end)):
        if z["off"]:
            off, end = _offset(z["off"]), z.end()
        elif z["iana"]:
            zone, end = z["iana"], z.end()
        elif z["city"]:
            zone, end = ZONE_OF[z["city"]], z.end()
        elif z["region"]:
            zone, end = REGION_OF[z["region"]], z.end()
        elif z["other"]:
            zone, end = next((v for k, v in {**ZONE_OF, **REGION_OF}.items() if k[0] > "z" and k in z["other"]), z["other"]), z.end()
        elif z["english"]:
            zone, end = ENGLISH_OF.get(z["english"], z["english"]), z.end()
        elif z["abbr"] in ZONE_OF:
            zone, abbr, end = ZONE_OF[z["abbr"]], z["abbr"], z.end()
        elif z["abbr"] and (z["abbr"] in ZONES or z["abbr"][-1] == "T"):
            zone, abbr, end = z["abbr"], z["abbr"], z.end()  # a zone without a known offset, not Taipei
    return secs, off, zone, abbr, end


def readings(text: str | None) -> list[tuple[int | None, bool, tuple | None, bool]]:
    """Every date in ``text`` in order: ``(midnight, timed, reading, opens)``; an unusable date has None.

    ``opens`` is set where the text says that a period begins then.
    """
    if not text:
        return []
    s, found, year, at = tidy(text), [], None, 0
    while m := _DATE.search(s, at):
        g = m.groupdict()
        if g["y1"]:
            y, mo, d = int(g["y1"]), int(g["m1"]), int(g["d1"])
        elif g["y2"]:
            y, mo, d = int(g["y2"]), int(g["m2"]), int(g["d2"])
        elif g["y3"]:
            y, mo, d = int(g["y3"]), MONTHS[g["n3"].lower()], int(g["d3"])
        elif g["y4"]:
            y, mo, d = int(g["y4"]), MONTHS[g["n4"].lower()], int(g["d4"])
        elif year is not None:
            y, mo, d = year, int(g["m5"] or g["m6"]), int(g["d5"] or g["d6"])
        else:
            at = m.end()
            continue
        year, day = y, _wall(y, mo, d)
        secs, off, zone, abbr, at = read_time(s, m.end())
        opens = bool(re.match(r" ?起(?!至)", s[at : at + 3]))
        if day is None or secs == -1:
            found.append((None, False, None, opens))
            continue
        local = day + (86399 if secs is None else secs)
        epoch = None if off is None else local - off
        found.append((day, secs is not None, (local, None if off is not None else zone or HOME_ZONE, abbr, epoch), opens))
    return found


def whole(text: str | None) -> tuple[bool, tuple] | None:
    """A field that is one date or instant: ``(timed, reading)``; epochs and unseparated digits included."""
    if not text:
        return None
    s = tidy(text)
    if re.fullmatch(r"\d{13}|\d{10}", s):
        n = int(s) // (1000 if len(s) == 13 else 1)
        return True, (n + 28800, None, None, n)
    if m := re.fullmatch(r"(\d{3,4})(\d{2})(\d{2})", s):
        day = _wall(*map(int, m.groups()))
        return None if day is None else (False, (day + 86399, HOME_ZONE, None, None))
    got = readings(text)
    return (got[0][1], got[0][2]) if len(got) == 1 and got[0][2] else None


def closing(text: str | None) -> tuple | None:
    """The latest closing reading that a free text names; None if it names no existing, complete one."""
    if not text:
        return None
    if re.fullmatch(r"\d{7,8}|\d{10}|\d{13}", tidy(text)):
        got = whole(text)
        return got and got[1]
    got = readings(text)
    if not got or got[-1][2] is None or (len(got) == 1 and got[0][3]):
        return None
    return max((r for _, _, r, _ in got if r), key=_instant)


def _instant(reading: tuple) -> int:
    """The instant by which readings of one text are compared: with its offset, that of its zone then, or, of an unknown zone, none."""
    local, zone, _, epoch = reading
    if epoch is not None:
        return epoch
    if zone == HOME_ZONE:
        return local - 28800
    if zone not in _KNOWN:
        return local
    at = datetime(1970, 1, 1) + timedelta(seconds=min(max(local, -5 * 10**10), 2 * 10**11))
    return local - int(at.replace(tzinfo=zoneinfo.ZoneInfo(zone)).utcoffset().total_seconds())


def closing_of(day: str | None, time: str | None) -> tuple | None:
    """A date field and a time field read together; a time inside the date field stands alone."""
    got = whole(day)
    if got is None or got[0] or time is None:
        return got and got[1]
    local = got[1][0] - 86399
    secs, off, zone, abbr, _ = read_time(tidy(time), 0)
    if secs is None or secs == -1:
        return got[1]
    local += secs
    return local, None if off is not None else zone or HOME_ZONE, abbr, None if off is None else local - off


def _valid_day(v: str | None) -> bool:
    if v is None or not _ISO_DAY.match(v):
        return False
    try:
        return date.fromisoformat(v) is not None
    except ValueError:
        return False


def _frame(rows: list[tuple | None]) -> pd.DataFrame:
    cols = list(zip(*[r or (None, None, None, None) for r in rows])) or [[]] * 4
    return pd.DataFrame({
        "local_s": pd.array(list(cols[0]), "Int64"), "zone": pd.Series(list(cols[1]), dtype=object),
        "abbr": pd.Series(list(cols[2]), dtype=object), "epoch_s": pd.array(list(cols[3]), "Int64"),
    })


def _text(s: pd.Series) -> list:
    return [v if isinstance(v, str) else None for v in s]


@F.pandas_udf(READING)
def _read_day(values: pd.Series) -> pd.DataFrame:
    rows = []
    for v in _text(values):
        got = None if v is None else whole(v)
        # A day without a time is taken at noon: the day is the same whatever the rest.
        rows.append(got and ((got[1][0] - 43199, *got[1][1:]) if not got[0] else got[1]))
    return _frame(rows)


@F.pandas_udf(READING)
def _read_closing(values: pd.Series) -> pd.DataFrame:
    return _frame([closing(v) for v in _text(values)])


@F.pandas_udf(READING)
def _read_closing_of(days: pd.Series, times: pd.Series) -> pd.DataFrame:
    return _frame([closing_of(d, t) for d, t in zip(_text(days), _text(times))])


def read_day(col: Column | str) -> Column:
    """Reading of a field that should be one date."""
    return _read_day(col)


def read_closing(col: Column | str) -> Column:
    """Reading of the latest closing date in a free text."""
    return _read_closing(col)


def read_closing_of(day: Column | str, time: Column | str) -> Column:
    """Reading of a date field together with a time field."""
    return _read_closing_of(day, time)


#: Yearly rules are followed up to here. Any later year has its changes on the same days as one of the 28 before,
#: which hold every weekday of New Year's Day with and without a leap day.
RULES_END = 2129
#: Before every change and after the last one of the table.
OPEN_S = 10**12


def _zone_file(name: str) -> bytes:
    for root in zoneinfo.TZPATH:
        if os.path.isfile(path := os.path.join(root, name)):
            with open(path, "rb") as f:
                return f.read()
    from importlib.resources import files

    return files("tzdata").joinpath("zoneinfo", name).read_bytes()


def _listed_changes(raw: bytes) -> tuple[tuple[int, str], list[tuple[int, int, str]], str]:
    """``(first state, changes as (instant, offset, abbreviation), yearly rule)`` of a file of the tz database (RFC 8536)."""
    def counts(at: int) -> tuple:
        return struct.unpack_from(">6l", raw, at + 20)

    at, wide = 0, 4
    if raw[4:5] >= b"2":
        utc, std, leap, times, types, chars = counts(0)
        at, wide = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc, 8
    utc, std, leap, times, types, chars = counts(at)
    at += 44
    when = struct.unpack_from(f">{times}{'q' if wide == 8 else 'l'}", raw, at)
    which = raw[at + times * wide :][:times]
    at += times * (wide + 1)
    kinds = [struct.unpack_from(">lBB", raw, at + 6 * i) for i in range(types)]
    at += 6 * types
    names = raw[at : at + chars]
    states = [(off, names[i : names.index(b"\0", i)].decode()) for off, _, i in kinds]
    at += chars + leap * (wide + 4) + std + utc
    return states[0], [(t, *states[k]) for t, k in zip(when, which)], raw[at:].strip(b"\n").decode() if wide == 8 else ""


def _ruled_changes(name: str, since: int, now: tuple[int, str]) -> list[tuple[int, int, str]]:
    """Changes after ``since`` by the zone's yearly rule, whose halves of the year are far longer than the steps."""
    z, rows = zoneinfo.ZoneInfo(name), []

    def state(t: int) -> tuple[int, str]:
        d = datetime.fromtimestamp(t, timezone.utc).astimezone(z)
        return int(d.utcoffset().total_seconds()), d.tzname()

    t, end = since, int(datetime(RULES_END, 2, 1, tzinfo=timezone.utc).timestamp())
    while t < end:
        nxt = t + 21 * 86400
        if state(nxt) != now:
            a, b = t, nxt
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if state(mid) == now else (a, mid)
            now = state(b)
            rows.append((b, *now))
        t = nxt
    return rows


def zone_intervals(zones: list[str], first_year: int | None = None, last_year: int | None = None) -> list[tuple]:
    """``(zone, utc_from, utc_to, offset_s, abbr)`` of each zone, from the public tz database.

    Without years the first and the last interval are open (``OPEN_S``); of the yearly rules ``RULES_END`` is the end.
    """
    at = lambda y: int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp())
    lo = -OPEN_S if first_year is None else at(first_year)
    hi = OPEN_S if last_year is None else at(last_year)
    rows, ruled = [], {}
    for name in zones:
        now, changes, rule = _listed_changes(_zone_file(name))
        if "," in rule:  # zones of one rule share its changes
            since, last = (changes[-1][0], changes[-1][1:]) if changes else (at(1970), now)
            if (rule, since) not in ruled:
                ruled[rule, since] = _ruled_changes(name, since, last)
            changes = changes + ruled[rule, since]
        begin = -OPEN_S
        for t, *state in [*changes, (OPEN_S, None, None)]:
            if tuple(state) != now:
                if max(begin, lo) < min(t, hi):
                    rows.append((name, max(begin, lo), min(t, hi), *now))
                begin, now = t, tuple(state)
    return rows
