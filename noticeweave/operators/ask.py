"""Questions against the catalogue: relevance, quotas, and answers held to their sources."""

from __future__ import annotations

import hashlib
import hmac
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from noticeweave.functions import text as T
from noticeweave.session import numbered, stored

# What people say and the words that notices use.
SYNONYMS = (
    ("冰水主機|冰水機|冰機|空調主機|冷氣|空調|冷凍空調", "空調 冷卻 冰水 冷氣"),
    ("馬達|電動機", "電動機 馬達 動力"),
    ("燈|照明", "照明 燈具"),
    ("空壓機|空氣壓縮", "空氣壓縮機 壓縮空氣"),
    ("熱泵|熱水", "熱泵 熱水"),
    ("醫院|診所|醫療", "醫院 醫療"),
    ("旅館|飯店|民宿|旅宿", "旅館 住宿 服務業"),
    ("工廠|製造", "工廠 製造業 工業"),
    ("學校|機關", "學校 機關"),
    ("冰箱|冷凍櫃", "冰箱 冷凍"),
)
URL = r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&*+,;=%]+"
NO_URL = "（網址請見詳細資訊）"


def letters(c: Column) -> Column:
    """Letters and digits alone, signs and spaces left out."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s 　\p{P}\p{S}]", "")


def bigram_set(c: Column) -> Column:
    """Distinct pairs of letters and digits, signs and spaces left out."""
    s = letters(c)
    n = F.length(s)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def expanded(question: Column) -> Column:
    """A question with the notices' words for what it names."""
    more = [F.when(question.rlike(p), F.lit(w)) for p, w in SYNONYMS]
    return F.concat_ws(" ", question, *more)


def _pair_codes(text: str) -> np.ndarray:
    """Distinct pairs of neighbouring code points as numbers."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.unique(c[:-1] << 21 | c[1:])


def _best_of_block(k: int, least: int):
    def run(questions: pd.DataFrame, notices: pd.DataFrame) -> pd.DataFrame:
        notices = notices.sort_values("id", kind="stable")
        found, n = [], len(notices)
        sets = [_pair_codes(t) for t in notices["text"]]
        every = np.concatenate([*sets, np.empty(0, dtype=np.int64)])
        # Inverted lists: the notices of pair ``words[i]`` are ``owner[begin[i]:begin[i + 1]]``.
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(n), [len(x) for x in sets])[order]
        words, begin = np.unique(every[order], return_index=True)
        begin = np.append(begin, len(every))
        for qid, text in zip(questions["qid"].tolist(), questions["text"]):
            at = np.nonzero(np.isin(words, _pair_codes(text), assume_unique=True))[0]
            if not len(at):
                continue
            score = np.bincount(np.concatenate([owner[begin[i] : begin[i + 1]] for i in at]), minlength=n)
            place = score * n - np.arange(n)  # ties go to the smaller id
            best = np.argpartition(-place, k)[:k] if n > k else np.arange(n)
            found += [(qid, i, score[i]) for i in best.tolist() if score[i] >= least]
        qids, rows, scores = zip(*found) if found else ((), (), ())
        ids = notices["id"].iloc[list(rows)].reset_index(drop=True)
        return pd.DataFrame({"qid": pd.Series(list(qids), dtype=questions["qid"].dtype), "id": ids, "score": pd.Series(list(scores), dtype="int64")})

    return run


def relevance_top(questions: DataFrame, notices: DataFrame, k: int = 6, least: int = 3, block: int = 4000) -> DataFrame:
    """``(qid, id, score, rank)``: the ``k`` notices that share most bigrams with each question, at least ``least``.

    ``questions`` has ``qid, question``, ``notices`` has ``id, text``, both of any length; ties go to the smaller id.

    A whole text shares some pair with nearly every notice, so joined pairs would be as many as questions times
    notices times common pairs. Instead blocks of at most about ``block`` questions and notices meet, each pair of
    blocks counts on arrays and gives its ``k`` best, and the best of these are the best of all. Nothing is left out;
    the cost stays questions times notices.
    """
    q = questions.select("qid", letters(expanded(F.col("question"))).alias("text"))
    n = notices.select("id", letters(F.col("text")).alias("text"))
    blocks = [max(1, -(-df.count() // block)) for df in (q, n)]
    part = lambda c, i: F.pmod(F.xxhash64(c), F.lit(blocks[i])).cast("int")
    each = lambda i: F.explode(F.sequence(F.lit(0), F.lit(blocks[i] - 1)))
    q = q.select("qid", "text", part("qid", 0).alias("a"), each(1).alias("b")).groupBy("a", "b")
    n = n.select("id", "text", each(0).alias("a"), part("id", 1).alias("b")).groupBy("a", "b")
    kinds = f"qid {questions.schema['qid'].dataType.simpleString()}, id {notices.schema['id'].dataType.simpleString()}"
    scores = q.cogroup(n).applyInPandas(_best_of_block(k, least), f"{kinds}, score long")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def admitted(requests: DataFrame, client: str, at: str, ident: str, cap: int, hours: int = 8) -> DataFrame:
    """Requests with their local day and whether the client's first ``cap`` of that day admit them.

    The day is that of UTC+``hours``. Requests are totally ordered by time and id; null clients share one counter.
    """
    day = F.to_date(F.col(at) + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0)))
    n = F.row_number().over(Window.partitionBy(client, "day").orderBy(at, ident))
    return requests.withColumn("day", day).withColumn("nth", n).withColumn("admitted", F.col("nth") <= cap)


def hold_to_urls(text: Column, allowed: Column) -> Column:
    """A text in which every address outside ``allowed`` is replaced; trailing full stops stay outside the address."""
    pieces = F.split(F.coalesce(text, F.lit("")), rf"(?={URL})")

    def one(piece: Column) -> Column:
        url = F.regexp_extract(piece, f"^({URL})", 1)
        bare = F.regexp_replace(url, r"[.,;]+\z", "")
        rest = F.substring(piece, F.length(bare) + 1, F.length(piece))
        return F.when(url == "", piece).when(F.array_contains(allowed, bare), piece).otherwise(F.concat(F.lit(NO_URL), rest))

    return F.trim(F.array_join(F.transform(pieces, one), ""))


# Chinese digits and units of numbers below ten thousand.
HAN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
HAN_UNITS = {"十": 10, "百": 100, "千": 1000}
_HAN = "[" + "".join(HAN_DIGITS) + "".join(HAN_UNITS) + "]+"


def han_int(s: str) -> int | None:
    """A Chinese number below ten thousand; digits without a unit count as the last one, other signs give None."""
    total, digit = 0, None
    for c in s:
        if c in HAN_DIGITS:
            digit = HAN_DIGITS[c]
        elif c in HAN_UNITS:
            total, digit = total + (1 if digit is None else digit) * HAN_UNITS[c], None
        else:
            return None
    return total + (digit or 0)


def plain_numbers(text: str) -> str:
    """A text with its Chinese numbers in digits: parts of a hundred as percent, fractions as a/b, no thousands separators."""
    text = re.sub(f"百分之({_HAN})", lambda m: f"{han_int(m[1])}%", text)
    text = re.sub(f"({_HAN})分之({_HAN})", lambda m: f"{han_int(m[2])}/{han_int(m[1])}", text)
    return re.sub(r"(\d),(?=\d{3})", r"\1", re.sub(_HAN, lambda m: str(han_int(m[0])), text))


@F.pandas_udf(StringType())
def _plain_numbers(texts: pd.Series) -> pd.Series:
    return texts.map(plain_numbers, na_action="ignore").astype(object)


def numbers(c: Column, han: bool = False) -> Column:
    """Distinct numbers of a text in digits, thousands separators dropped; with ``han`` Chinese numbers and fractions too.

    Only texts that hold a Chinese numeral travel to Python.
    """
    text = F.coalesce(c, F.lit(""))
    if han:
        text = T.normalize_text(text)
        text = F.coalesce(_plain_numbers(F.when(text.rlike(_HAN), text)), text)
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"(\d),(?=\d{3})", "$1"), F.lit(r"\d+(?:\.\d+)?"), 0))


def numbers_from(field: Column, source: Column, han: bool = False) -> Column:
    """Whether every number of ``field`` stands in ``source`` too, there as it is or, with ``han``, with the same value."""
    mine, there = numbers(field, han), numbers(source, han)
    if han:
        there = F.array_union(there, F.transform(there, lambda n: F.regexp_replace(F.regexp_replace(n, r"^0+(?=\d)", ""), r"(\.\d*?)0+\z|\.\z", "$1")))
        there = F.transform(there, lambda n: F.regexp_replace(n, r"\.\z", ""))
    return F.size(F.array_except(mine, there)) == 0


#: Rows of a chunk of context; more than one task ever joins.
CHUNK = 2_000


def context_lines(notices: DataFrame, group: str, order: str, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """``(group, chunk, context)``: the known fields of each notice on one line, the lines in order.

    A group's rows are numbered over all tasks by ranges of the order and written ``chunk`` to a text, so that a group of
    any size never comes into one row; chunks count from 0.
    """
    line = F.concat_ws(" | ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns])
    rows = stored(numbered(notices.select(group, F.col(order).alias("o"), line.alias("l")), [group], ["o", "l"]))
    rows = rows.select(group, F.floor(F.col("n") / chunk).cast("int").alias("chunk"), F.struct("n", "l").alias("s"))
    return rows.groupBy(group, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["l"]), "\n").alias("context"))


def reranked(notices: DataFrame, scores: DataFrame, rank: str = "rank", cap: int = 80) -> DataFrame:
    """``notices`` with ``place`` from 1: those in ``scores`` (``id, score``) first, best first, then the others as ranked; the first ``cap``."""
    s = scores.groupBy(F.col("id").alias("_id")).agg(F.max("score").alias("_score"))
    rows = notices.join(s, F.col("id") == F.col("_id"), "left")
    keys = [F.col("_score").isNull(), F.col("_score").desc(), F.col(rank), F.col("id")]
    top = rows.orderBy(*keys).limit(cap)
    # At most ``cap`` rows are numbered.
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys))).drop("_id", "_score")


def client_ids(secret: str):
    """A column function (day, address) -> anonymous id: 16 bytes of HMAC-SHA256 in hex."""

    @F.pandas_udf(StringType())
    def run(day: pd.Series, address: pd.Series) -> pd.Series:
        key = secret.encode()
        return pd.Series([hmac.new(key, f"{d}|{a}".encode(), hashlib.sha256).digest()[:16].hex() for d, a in zip(day, address)], dtype=object)

    return run
