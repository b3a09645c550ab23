"""Template residue, filler and error pages: a linear classifier on hashed n-grams, trained on weak labels."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.llm.boilerplate import line_code
from noticeweave.llm.canonical import ordinary_text
from noticeweave.session import checkpoint

BODY, RESIDUE, BLANK_FIELD, AROUND = range(4)
#: Hashed n-grams, then length buckets, each for first clauses (titles) and for others.
HASH_BITS, LENGTHS = 17, 16
#: Documents that may be drawn for training, and clauses of each stratum that the classifier is fitted on.
SAMPLE_DOCS, SAMPLE_CLAUSES = 40_000, 2_000
#: Clauses that occur so often in the drawn documents are always fitted on.
FREQUENT = 50
#: By how much (log odds) an unfilled field must be likelier than all else, as one such clause condemns a document.
MARGIN = 2.0
#: Clauses whose class a worker remembers.
REMEMBERED = 200_000

# Forms of fields that a template leaves unfilled.
BLANK_FIELDS = (
    r"\{\{.*?\}\}|\{%.*?%\}|\$\{.*?\}|#\{.*?\}|<%.*?%>|\[\[.*?\]\]|\{\d\}|%s|__[A-Z][A-Z_.]*__|%{1,2}[A-Z_.]+%{1,2}|TBD_[A-Z]+|"
    r"\[(?:請填寫|請輸入|待填|Insert|Your|Enter)[^\]]*\]|【[^】]*(?:待補|待填)】|[（(]請(?:輸入|填寫)[^）)]*[）)]|<[^<>\d=/]{2,30}>|＿{2,}|_{4,}|○{3,}|"
    r"：(?:NaN|undefined|null|None)|(?<![A-Za-z])(?:undefined|NaN)(?![A-Za-z])(?! index)|@[A-Z][A-Za-z]+\.[A-Za-z.]+"
)
# What servers, browsers and gateways answer in place of content, HTTP states and exceptions included.
ERROR_WORDS = (
    r"^(?:HTTP )?0 (?:Bad|Not|Forbidden|Unauthorized|Gateway|Internal|Service|Too)|Bad Gateway|HTTP Error|Service Unavailable|Internal Server Error|Access denied|cannot be displayed|can't be reached|request timeout|"
    r"was rejected|Exception\b|SQLSTATE|undefined index|Runtime Error|server at port|Reference #|Support ID|JavaScript|requires? scripts|Script 功能|支援 Script|"
    r"noscript|Checking your browser|驗證您是否|允許 Cookie 與指令碼|查無此頁|找不到網頁|網頁不存在|連結已失效|防護系統|維護中，暫停|連線逾時|忙線中|沒有權限|連線失敗|"
    r"已過期，請重新|未預期的錯誤|暫時無法使用|錯誤時間|案件代碼|秒後重試|持續發生|網站管理人員|返回首頁"
)
# Filler that stands where text should come.
FILLER_WORDS = (
    r"假文|範例文字|範例段落|段落示意|敬請期待|在這裡輸入|編輯此區塊|放圖片說明|測試測試|文字文字|標題文字標題|新增內文|測試資料請勿|預設頁面內容|"
    r"\b(?:lorem|ipsum|consectetur|adipiscing|eiusmod|incididunt|nostrud|ullamco|laboris|veniam|aliqua|aute|irure)\b"
)
# Words by which a clause speaks of such things.
SPOKEN_OF = r"請填「|以 XXX|填寫範例|請以申請單位|應處理|出現「|回報「|曾有|併案|全數刪除|始得送出|以紙本|視為通訊|須於|不影響"
# Of these, the words of a clause about how a field is filled in, and what stands before a quoted one.
FIELD_SPOKEN_OF = r"請填「|以 XXX|填寫範例|請以申請單位|出現「|回報「|全數刪除|始得送出"
QUOTING = r"(?:請填|出現|回報)[「『][^」』]*\Z"
# Forms that people write too, when they speak of a field; no one but a template writes the others.
PLAIN_FIELDS = r"＿+|_+|○+|：?(?:NaN|undefined|null|None)"

_BLANK = re.compile(BLANK_FIELDS)
_BAD = re.compile(f"(?i:{ERROR_WORDS}|{FILLER_WORDS})")
_SPOKEN = re.compile(SPOKEN_OF)
_FIELD_SPOKEN = re.compile(FIELD_SPOKEN_OF)
_QUOTING = re.compile(QUOTING)
_PLAIN = re.compile(PLAIN_FIELDS)
_CUT = re.compile(r"\n|(?<=[。！？；])|(?<=[.!?]) ")
_DIGITS = re.compile("[0-9]+")


def clauses(text: str) -> list[str]:
    """Non-blank lines and sentences of a text, numbers masked."""
    return [c for c in map(str.strip, _CUT.split(_DIGITS.sub("0", ordinary_text(text)))) if c]


def unfilled(clause: str) -> bool:
    """Whether a field is left unfilled. One that is quoted as an example is spoken of; so is a plain form, such as ○○○,
    in a clause about filling in. A template's own form, such as {{...}}, is unfilled whatever else the clause says."""
    spoken = _FIELD_SPOKEN.search(clause)
    return any(
        not (spoken and _PLAIN.fullmatch(m.group())) and not _QUOTING.search(clause[: m.start()]) for m in _BLANK.finditer(clause)
    )


def weak_label(clause: str) -> int | None:
    """A class by phrase and by page furniture; None where neither decides.

    A clause that names such phrases but has the words of an instruction is body text.
    """
    spoken = _SPOKEN.search(clause)
    if unfilled(clause):
        return BLANK_FIELD
    if not spoken and _BAD.search(clause):
        return RESIDUE
    if spoken:
        return BODY
    code = line_code(clause)[0]
    if code in "SHIC":
        # English sentences have none of the marks that lines are told by.
        return BODY if code == "C" and clause.isascii() and clause.count(" ") >= 5 else AROUND
    return None if code == "W" else BODY


#: Kinds of signs: ideographs, small and capital letters count as one sign each; all others stand for themselves.
_HAN, _SMALL, _LARGE = 1, 97, 65


def _joined(texts: list[str]) -> np.ndarray:
    """Code points of all clauses with marks around each."""
    return np.frombuffer("".join(f"\x02{t}\x03" for t in texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def _signs(c: np.ndarray) -> np.ndarray:
    s = c.copy()
    s[(c >= 0x3400) & (c <= 0x9FFF)] = _HAN
    s[(c >= 97) & (c <= 122)] = _SMALL
    s[(c >= 65) & (c <= 90)] = _LARGE
    return s


def _grams(c: np.ndarray, orders: tuple[int, ...], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each order: start positions and hashed indices of the n-grams inside a clause, its marks included."""
    out, h, inside = [], (c + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15), c != 3
    for n in range(1, max(orders) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        if n > 1:
            h = (h[:m] ^ (c[n - 1 :] + np.uint64(n * 0x51ED270B + seed))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        if n in orders:
            ok = inside[:m].copy()
            for i in range(1, n - 1):
                ok &= inside[i : m + i]
            at = np.nonzero(ok)[0]
            out.append((at, (h[at] >> np.uint64(64 - HASH_BITS)).astype(np.int64)))
    return out


def _features(texts: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(clause of each n-gram, its index, index of length and title)``.

    N-grams are those of the letters, up to three, and of the kinds of signs, up to five, where runs of one kind of letter
    count as one: the latter tell forms such as ``{{name}}`` whatever the field is called and however long the clause is.
    """
    c = _joined([t.lower() for t in texts])
    starts = np.nonzero(c == 2)[0]
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(c))))
    who, what = [], []
    for at, i in _grams(c, (1, 2, 3), 0):
        who.append(owner[at])
        what.append(i)
    k = _joined(texts)
    kinds = _signs(k)
    letter = (kinds == _HAN) | (kinds == _SMALL) | (kinds == _LARGE)
    kinds = kinds[np.append(True, ~(letter[1:] & (kinds[1:] == kinds[:-1])))]
    owner = np.cumsum(kinds == 2) - 1
    seen = np.append(0, np.cumsum(kinds > 3))
    for n, (at, i) in zip((2, 3, 4, 5), _grams(kinds, (2, 3, 4, 5), 77)):
        some = seen[at + n] > seen[at]  # ideographs alone are no form
        who.append(owner[at[some]])
        what.append(i[some])
    n = np.array([len(t) for t in texts])
    length = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), LENGTHS - 1) + LENGTHS * np.asarray(first, dtype=np.int64)
    return np.concatenate(who), np.concatenate(what), length


@dataclass
class Model:
    """Weights by hashed feature and class, and how much likelier than all others an unfilled field must be."""

    grams: np.ndarray
    extra: np.ndarray
    margin: float = 0.0

    def scores(self, texts: list[str], first: np.ndarray) -> np.ndarray:
        if not texts:
            return np.zeros((0, 4), dtype=np.float32)
        who, what, extra = _features(texts, first)
        return np.stack([np.bincount(who, weights=self.grams[k][what], minlength=len(texts)) for k in range(4)], axis=1) + self.extra[extra]


def stratum(clause: str, label: int) -> int:
    """Class, script and kind of a clause: in each class Latin text and whole sentences are drawn and weighed apart."""
    return label * 4 + 2 * clause.isascii() + (clause[-1] in "。.！!；;")


def fit(texts: list[str], first: np.ndarray, labels: np.ndarray, many: np.ndarray | None = None, rounds: int = 200, l2: float = 1e-5, rate: float = 0.05) -> Model:
    """Multinomial logistic regression with an L2 penalty, fitted by Adam on all rows at once; deterministic.

    The strata count alike: else English sentences, of which most that differ have an unfilled field, would all
    seem to have one.
    """
    extra = np.zeros((2 * LENGTHS, 4))
    if not texts:
        return Model(np.zeros((4, 1 << HASH_BITS), dtype=np.float32), extra)
    who, what, more = _features(texts, first)
    # Few distinct features occur in the sample: only they move.
    used, what = np.unique(what, return_inverse=True)
    w, b = np.zeros((4, len(used))), np.zeros((2 * LENGTHS, 4))
    goal = np.eye(4)[labels]
    kind = np.array([stratum(t, k) for t, k in zip(texts, labels.tolist())])
    weight = np.ones(len(texts)) if many is None else 1 + np.log(np.maximum(many, 1))
    weight *= len(texts) / (np.bincount(kind, weights=weight)[kind] * len(np.unique(kind)))
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, rounds + 1):
        z = np.stack([np.bincount(who, weights=w[k][what], minlength=len(texts)) for k in range(4)], axis=1) + b[more]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - goal) * weight[:, None] / len(texts)
        dw = np.stack([np.bincount(what, weights=d[who, k], minlength=len(used)) for k in range(4)]) + l2 * w
        db = np.stack([np.bincount(more, weights=d[:, k], minlength=2 * LENGTHS) for k in range(4)], axis=1)
        for i, (x, g) in enumerate(((w, dw), (b, db))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    grams = np.zeros((4, 1 << HASH_BITS), dtype=np.float32)
    grams[:, used] = w
    return Model(grams, b)


def _host(df: DataFrame, url: str, source: str):
    host = F.regexp_extract(F.col(url), r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1)
    return F.coalesce(F.nullif(host, F.lit("")), F.col(source), F.lit(""))


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
            for i, c in enumerate(clauses(text)):
                if (label := weak_label(c)) is not None:
                    rows.append((host, c, i == 0, label, stratum(c, label)))
        cols = list(zip(*rows)) or [[], [], [], [], []]
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["host", "clause", "first", "label", "stratum"])


def labelled_clauses(df: DataFrame, key: str, text: str, url: str, source: str, docs: int = SAMPLE_DOCS, per_class: int = SAMPLE_CLAUSES) -> DataFrame:
    """``(clause, first, label, unseen, n)``: weakly labelled distinct clauses of a bounded sample of documents, with their number.

    About ``docs`` documents are drawn by a hash of their key, and of each class, script and kind of clause at most about
    ``per_class`` distinct clauses of the training hosts and as many of the unseen ones, by a hash of the clause, besides those that occur ``FREQUENT`` times. A fifth of the hosts, by hash, is unseen: none
    of their clauses is trained on.
    """
    rows = df.where(F.col(text).isNotNull())
    every = max(1, -(-rows.count() // docs))
    drawn = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(every)) == 0).select(_host(df, url, source).alias("host"), F.col(text).alias("text"))
    found = drawn.mapInArrow(_label_batches, "host string, clause string, first boolean, label int, stratum int")
    found = found.withColumn("unseen", F.pmod(F.xxhash64("host", F.lit(7)), F.lit(5)) == 0)
    one = found.groupBy("clause", "label", "stratum", "first").agg(F.min("unseen").alias("unseen"), F.count(F.lit(1)).alias("n"))
    one = checkpoint(one)
    counts = {(r["stratum"], r["unseen"]): r["count"] for r in one.groupBy("stratum", "unseen").count().collect()}
    keep = F.lit(False)
    for (kind, unseen), n in counts.items():
        spread = max(1, -(-n // per_class))
        keep = keep | ((F.col("stratum") == kind) & (F.col("unseen") == unseen) & (F.pmod(F.xxhash64("clause"), F.lit(spread)) == 0))
    return one.where(keep | (F.col("n") >= FREQUENT))


def train(df: DataFrame, key: str, text: str, url: str, source: str) -> tuple[Model, list[tuple]]:
    """The classifier and, by class, ``(class, rows, right, found, true)`` on hosts that it never saw."""
    rows = labelled_clauses(df, key, text, url, source).orderBy("clause", "label", "first").toArrow().to_pydict()
    label, unseen, first = np.array(rows["label"], dtype=np.int64), np.array(rows["unseen"], dtype=bool), np.array(rows["first"], dtype=bool)
    texts = rows["clause"]
    pick = lambda mask: [t for t, m in zip(texts, mask) if m]
    model = fit(pick(~unseen), first[~unseen], label[~unseen], np.array(rows["n"], dtype=float)[~unseen])
    model.margin = MARGIN
    guess = classes(model, pick(unseen), first[unseen])
    true = label[unseen]
    return model, [(k, len(true), int(((guess == k) & (true == k)).sum()), int((guess == k).sum()), int((true == k).sum())) for k in range(4)]


def classes(model: Model, texts: list[str], first: np.ndarray) -> np.ndarray:
    """The likeliest class of each clause; an unfilled field must be likelier than all others by the model's margin."""
    if not texts:
        return np.empty(0, dtype=np.int64)
    z = model.scores(texts, first)
    z[:, BLANK_FIELD] -= model.margin
    return z.argmax(axis=1)


def _score(model):
    known: dict[tuple[str, bool], int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for big in batches:
            for lo in range(0, big.num_rows, 400):
                batch = big.slice(lo, 400)
                cut = [[(c, j == 0) for j, c in enumerate(clauses(text))] for text in batch.column("text").to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list({c for doc in cut for c in doc if c not in known})
                known.update(zip(new, classes(m, [c for c, _ in new], np.array([f for _, f in new], dtype=bool)).tolist()))
                guess = np.array([known[c] for doc in cut for c in doc], dtype=np.int64)
                owner = np.repeat(np.arange(len(cut)), [len(doc) for doc in cut])
                n = [np.bincount(owner[guess == k], minlength=batch.num_rows) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column("key")] + [pa.array(x, pa.int32()) for x in n], ["key", "n_body", "n_residue", "n_blank", "n_around"])

    return run


def residue_documents(df: DataFrame, key: str, text: str, url: str, source: str, model: Model | None = None) -> DataFrame:
    """``(key, n_body, n_residue, n_blank, n_around, residue)`` of every document with text.

    The classifier alone decides; patterns only label its training sample. Each clause goes to its likeliest class: body text, residue (errors, notices about scripts, filler), a clause with
    an unfilled field, or page furniture, which decides nothing. A document is residue if any clause has an unfilled
    field, or if it has more residue than body. Null texts give no row; an empty text has no clause and is no residue.
    """
    if model is None:
        model, _ = train(df, key, text, url, source)
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    shape = f"key {kind}, n_body int, n_residue int, n_blank int, n_around int"
    found = rows.mapInArrow(_score(df.sparkSession.sparkContext.broadcast(model)), shape)
    return found.withColumn("residue", (F.col("n_blank") > 0) | (F.col("n_residue") > F.col("n_body")))


def validation(df: DataFrame, key: str, text: str, url: str, source: str) -> DataFrame:
    """``(class, n_unseen, n_true, precision, recall)`` against weak labels on hosts outside the training sample."""
    names = ["body", "residue", "unfilled", "around"]
    _, rows = train(df, key, text, url, source)
    data = [(names[k], n, true, round(right / found, 4) if found else None, round(right / true, 4) if true else None) for k, n, right, found, true in rows]
    return df.sparkSession.createDataFrame(data, "class string, n_unseen int, n_true int, precision double, recall double")
