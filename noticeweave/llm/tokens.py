"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import ast
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; set NOTICEWEAVE_TOKENIZERS to use another.
FOLDER = os.environ.get("NOTICEWEAVE_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "piece_bpe_32k.model"
_LOADED: dict = {}


def split_pattern(folder: str) -> str:
    """The pattern that splits texts before the merges of rank files, read from the folder's module without running it."""
    with open(os.path.join(folder, "__init__.py"), encoding="utf-8") as f:
        for node in ast.parse(f.read()).body:
            if isinstance(node, ast.Assign) and any(getattr(t, "id", "") == "PATTERN" for t in node.targets):
                return ast.literal_eval(node.value)
    raise ValueError(f"no PATTERN in {folder}")


def counter(path: str, pattern: str = ""):
    """A function from texts to their numbers of tokens, loaded once per worker; by the file's kind."""
    if path in _LOADED:
        return _LOADED[path]
    if path.endswith(".model"):
        import sentencepiece

        tok = sentencepiece.SentencePieceProcessor(model_file=path)
        run = lambda texts: [len(x) for x in tok.encode(texts, num_threads=1)]
    elif path.endswith(".json"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_file(path)
        bpe.encode_special_tokens = True
        run = lambda texts: [len(x) for x in bpe.encode_batch_fast(texts, add_special_tokens=False)]
    else:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern or split_pattern(os.path.dirname(path)), mergeable_ranks=ranks, special_tokens={})
        run = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    _LOADED[path] = run
    return run


def _count(name: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(SparkFiles.get(name), pattern)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            n = []
            for lo in range(0, len(texts), 256):
                n += count(texts[lo : lo + 256])
            i = batch.schema.get_field_index("_text")
            yield batch.set_column(i, pa.field("n_tokens", pa.int64()), pa.array(n, pa.int64()))

    return run


def with_sizes(df: DataFrame, text: str, keep: list[str], tokenizer: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``(*keep, n_tokens)``: the size of every non-null text; the texts themselves go no further.

    The vocabulary is read on the driver and given to the executors as a file of the application.
    """
    folder = folder or FOLDER
    df.sparkSession.sparkContext.addFile(os.path.join(folder, tokenizer))
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    pattern = split_pattern(folder) if tokenizer.endswith(".tiktoken") else ""
    return rows.mapInArrow(_count(tokenizer, pattern), f"{fields}, n_tokens long")
