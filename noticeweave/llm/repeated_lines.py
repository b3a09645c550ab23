"""Lines that one source repeats in far too many of its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeweave.session import bounded_broadcast, checkpoint


def normal_lines(text: Column) -> Column:
    """Lines of a text as compared: inner runs of spaces and tabs one space, none at either end."""
    one = F.regexp_replace(text, "[ \t]+", " ")
    return F.transform(F.split(one, "\n", -1), lambda x: F.trim(x))


def _key(line: Column) -> Column:
    """96 bits of hash: lines are counted and joined by it, never as texts."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def excessive_lines(df: DataFrame, key: str, source: str, text: str, min_docs: int = 6, min_share: float = 0.05) -> DataFrame:
    """``(source, h, g, n_docs, n_all)`` of the lines that at least ``min_docs`` documents and at least ``min_share``
    of the source's documents with text hold.

    A document counts a line once, before the shuffle; counts are combined map-side, so that a source with a third
    of all rows sends no more than its distinct lines from each task. At most ``lines per document / min_share``
    lines of a source can be excessive, so the result grows with the number of sources only. Documents without a
    source or text take no part; blank lines are never excessive.
    """
    docs = df.where(F.col(text).isNotNull() & F.col(source).isNotNull())
    totals = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_all"))
    keys = F.array_distinct(F.transform(F.filter(normal_lines(F.col(text)), lambda x: x != ""), _key))
    counts = (
        docs.select(F.col(source).alias("source"), F.inline(keys))
        .groupBy("source", "h", "g").agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    return counts.join(totals, "source").where(F.col("n_docs") >= min_share * F.col("n_all")).select("source", "h", "g", "n_docs", "n_all")


def excessive_occurrences(df: DataFrame, key: str, source: str, text: str, min_docs: int = 6, min_share: float = 0.05) -> DataFrame:
    """``(key, source, line_no, line, n_docs, n_all)`` of each occurrence of an excessive line, ``line_no`` from 0."""
    many = checkpoint(excessive_lines(df, key, source, text, min_docs, min_share))
    many = many.groupBy(F.col("source").alias("_source")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("h", "g"), F.struct("n_docs", "n_all")))).alias("_many")
    )
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    docs = docs.join(bounded_broadcast(many, 20_000), F.col("source") == F.col("_source"))
    lines = docs.select("key", "source", "_many", F.posexplode(normal_lines(F.col("text"))).alias("line_no", "line")).where("line <> ''")
    hit = lines.withColumn("_n", F.try_element_at("_many", _key(F.col("line")))).where("_n is not null")
    return hit.select("key", "source", "line_no", "line", "_n.n_docs", "_n.n_all")


def repeated_line_report(df: DataFrame, key: str, source: str, text: str, **limits: float) -> DataFrame:
    """``(source, line, n_docs, n_all, share)``: each excessive line of each source once."""
    found = excessive_occurrences(df, key, source, text, **limits)
    return found.groupBy("source", "line").agg(F.max("n_docs").alias("n_docs"), F.max("n_all").alias("n_all")).withColumn(
        "share", F.round(F.col("n_docs") / F.col("n_all"), 6)
    )


def without_repeated_lines(df: DataFrame, key: str, source: str, text: str, **limits: float) -> DataFrame:
    """``(key, text, n_removed)``: every document rebuilt without its source's excessive lines.

    Lines keep their text and order; null texts stay null with nothing removed.
    """
    found = excessive_occurrences(df, key, source, text, **limits)
    drop = found.groupBy(F.col("key").alias("_key")).agg(F.collect_set("line_no").alias("_drop"))
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(drop, F.col("key") == F.col("_key"), "left")
    none = F.array().cast("array<int>")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("_drop", none), i))
    n = F.coalesce(F.size("_drop"), F.lit(0))
    return out.select("key", F.when(n == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), n.alias("n_removed"))
