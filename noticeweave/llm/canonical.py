"""One ordinary form for texts that look the same but differ in their characters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from noticeweave.session import bounded_broadcast, stored

# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԚԜҮаеһіјорсуѕхԁԛԝӏ", "ABESIJKMHOPCTYXQWYaehijopcysxdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
# Kana that look like ideographs.
KANA = dict(zip("エカニロートハタヌオミチヒセメ", "工力二口一卜八夕又才三千匕七乂"))
# Radicals without a decomposition in the Unicode tables.
RADICALS = dict(zip("⺌⺍⺎⺕⺗⺝⺠⺢⺩⺪⺫⺬⺭⺮⺱⺻⺾⻁⻂⻃⻄⻆⻇⻌⻍⻎⻏⻐⻑⻒⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰", "小小兀彐心月民水王疋目示示竹网聿艸虎衣西西角角辶辶辶邑邑長長門阜雨青韋頁風飛食食馬骨鬼魚鳥麥黃齊齒龍"))

_KEEP = set("\t\n\r�")


def _targets() -> dict[int, str | None]:
    """Character map by rule."""
    table: dict[int, str | None] = {ord(k): v for k, v in RADICALS.items()}
    spans = [(0, 0x3400), (0xA640, 0xA69F), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20), (0xE0000, 0xE01F0)]
    for lo, hi in spans:
        for o in range(lo, hi):
            c = chr(o)
            if c in _KEEP or o in table:
                continue
            kind = unicodedata.category(c)
            wide = unicodedata.normalize("NFKC", c)
            if kind in ("Cf", "Cc") or o in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180E) or 0xFE00 <= o < 0xFE10 or o >= 0xE0000:
                table[o] = None
            elif kind == "Zs" and c != " ":
                table[o] = " "
            elif kind == "Nd" and not "0" <= c <= "9":
                table[o] = str(unicodedata.digit(c))
            elif 0x2F00 <= o < 0x2FE0 or 0x2E80 <= o < 0x2F00 or 0xF900 <= o < 0xFB00 or o >= 0x1D400:
                if wide != c:
                    table[o] = wide
            elif kind[0] == "L" and o >= 0xFB00 and wide != c:  # full- and half-width letters, ligatures
                table[o] = wide
            elif o == 0xB5:
                table[o] = "μ"
            elif unicodedata.normalize("NFC", c) != c and kind[0] == "L":
                table[o] = unicodedata.normalize("NFC", c)
    return table


TABLE = _targets()
#: Any character outside the plainly ordinary ranges; wider than needed, as Python decides exactly afterwards.
SUSPECT = (
    r"[^\x20-\x7e\x{4e00}-\x{9fff}\n\t\r\x{3001}-\x{301f}\x{ff01}-\x{ff0f}\x{ff1a}-\x{ff20}\x{ff3b}-\x{ff40}\x{ff5b}-\x{ff65}"
    r"\x{a1}-\x{ac}\x{ae}-\x{b4}\x{b6}-\x{24f}\x{3b1}-\x{3be}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}"
    r"\x{2100}-\x{2125}\x{212c}-\x{2bff}\x{3200}-\x{4dbf}\x{fffd}]"
)
_WORD = re.compile(r"[A-Za-zÀ-ɏͰ-ϿЀ-ԯ̀-ͯ]+")
_FOREIGN = re.compile("[" + "".join(CYRILLIC) + "".join(GREEK) + "]")
_LATIN_OF = {ord(k): v for k, v in (CYRILLIC | GREEK).items()}
_OTHER = re.compile(r"[Ͱ-ϿЀ-ԯ]")
_ALONE = re.compile("(?<![぀-ヿㇰ-ㇿ])[" + "".join(KANA) + "]{1,2}(?![぀-ヿㇰ-ㇿ])")
_HAN = re.compile("[㐀-鿿、]")


def _word(m: re.Match) -> str:
    """A word's foreign letters become Latin where all of them have a Latin double.

    A lone letter is a symbol unless it is Cyrillic; a word of truly Greek or Cyrillic letters stays.
    """
    w = m.group()
    if not _FOREIGN.search(w):
        return w
    rest = _OTHER.sub(lambda x: "" if x.group() in CYRILLIC or x.group() in GREEK else x.group(), w)
    if _OTHER.search(rest.replace("μ", "").replace("α", "")) or (len(w) == 1 and w in GREEK):
        return w
    return w.translate(_LATIN_OF)


def _kana(m: re.Match) -> str:
    """One or two such kana between ideographs stand for ideographs; kana words stay."""
    s = m.string
    near = s[max(0, m.start() - 1) : m.start()] + s[m.end() : m.end() + 1]
    return "".join(map(KANA.get, m.group())) if _HAN.search(near) else m.group()


_PLAINEST = str.maketrans(CYRILLIC | GREEK | KANA)


def look_alike(text: str) -> str:
    """Every letter, digit, ideograph and space replaced by the ordinary one that it looks like, whatever stands around it.

    Two texts that look the same have the same form here, up to invisible characters and combining accents: these stay, as a
    Unicode collation ignores the former and equates composed and decomposed accents.
    """
    return "".join(c if (t := TABLE.get(ord(c), c)) is None else t for c in text).translate(_PLAINEST)


def ordinary_form(text: str) -> str:
    """The ordinary form of one text: look-alikes mapped, nothing invisible, accents composed."""
    s = text.translate(TABLE)
    s = _ALONE.sub(_kana, s) if _ALONE.search(s) else s
    s = _WORD.sub(_word, s) if _FOREIGN.search(s) else s
    return unicodedata.normalize("NFC", s)


_SUSPECT = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), SUSPECT))


def ordinary_text(text: str) -> str:
    """``ordinary_form`` behind the quick look for suspect characters."""
    return ordinary_form(text) if _SUSPECT.search(text) else text


_FORMS = StructType([StructField("mapped", StringType()), StructField("form", StringType())])


@F.pandas_udf(_FORMS)
def _forms(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"mapped": [look_alike(t) for t in texts], "form": [ordinary_form(t) for t in texts]}, dtype=object)


@F.pandas_udf(StringType())
def _ordinary(texts: pd.Series) -> pd.Series:
    return texts.map(ordinary_form, na_action="ignore").astype(object)


def suspect(col: Column) -> Column:
    """Whether a text holds any character that might not be ordinary (in the JVM, before Python sees it)."""
    return F.coalesce(col.rlike(SUSPECT), F.lit(False))


def ordinary(col: Column) -> Column:
    """Ordinary form of a text column; only suspect texts travel to Python."""
    return F.coalesce(_ordinary(F.when(suspect(col), col)), col)


#: The members of each class as they are written, and how often; the canonical one is what most records write.
CHOOSE = """
    WITH forms AS (SELECT mapped, form, count(*) AS n, min(odd) AS odd FROM {members} GROUP BY mapped, form)
    SELECT mapped, min(struct(-n AS n, odd, length(form) AS size, form)).form AS canonical FROM forms GROUP BY mapped
"""


def canonical_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, value, canonical)`` of each non-null field value with a suspect character.

    Every value is mapped to the plainest look-alikes and grouped under the accent- and case-sensitive Unicode collation:
    such a class holds all values that look the same, ordinary ones included. A class's members are the ordinary values in
    it as they are and its suspect values in their own ordinary form, as a class may have no ordinary value. The member
    that most records have becomes the canonical one, of these an ordinary value first, then that with the fewest code
    points, then the smallest in binary order; so where a text alone can't tell which of two look-alikes is meant, the others in its class do. It is
    joined back on the collated text.

    Ordinary values that no suspect value resembles are canonical already: a hash of the ideographs, on which all members of a
    class agree, leaves them out before any text is shuffled. Empty texts and nulls give no row.
    """
    longer = df.select(
        F.col(key).alias("key"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("v"),
    ).select("key", "v.field", "v.value")
    ideographs = lambda c: F.xxhash64(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]+", ""))
    odd = longer.where(suspect(F.col("value"))).select("*", _forms("value").alias("f"))
    odd = odd.select("key", "field", "value", "f.mapped", "f.form")
    odd = stored(odd.withColumn("h", ideographs(F.col("mapped"))))  # read three times; the scan and Python run once
    plain = longer.where(F.col("value").isNotNull() & ~suspect(F.col("value"))).select("value", ideographs(F.col("value")).alias("h"))
    plain = plain.join(bounded_broadcast(odd.select("h").distinct()), "h", "left_semi")
    members = odd.select("mapped", "form", F.lit(1).alias("odd")).unionByName(plain.select(F.col("value").alias("mapped"), F.col("value").alias("form"), F.lit(0).alias("odd")))
    members = members.withColumn("mapped", F.collate("mapped", "UNICODE"))
    classes = df.sparkSession.sql(CHOOSE, members=members)
    return odd.withColumn("mapped", F.collate("mapped", "UNICODE")).join(classes, "mapped").select("key", "field", "value", "canonical")


def canonical_texts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``df`` with each of ``fields`` in its one ordinary form; nulls stay null, other columns as they are.

    The changed values of a key are joined back in one join, by the key; rows that repeat a key each get their own.
    """
    mark = lambda f, v: F.concat(F.lit(f + "|"), F.xxhash64(v).cast("string"), F.lit("|"), F.hash(v).cast("string"))
    found = canonical_values(df, key, fields).where("canonical <> value")
    tagged = F.concat(F.col("field"), F.lit("|"), F.xxhash64("value").cast("string"), F.lit("|"), F.hash("value").cast("string"))
    one = found.select("key", tagged.alias("m"), "canonical").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("m", "canonical"))).alias("_new"))
    df = df.join(one.withColumnRenamed("key", "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    for f in fields:
        df = df.withColumn(f, F.coalesce(F.element_at("_new", mark(f, F.col(f))), F.col(f)))
    return df.drop("_key", "_new")


def canonical_found(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Distinct ``(key, field)`` of the values that the one form changes."""
    return canonical_values(df, key, fields).where("canonical <> value").select("key", "field").distinct()
