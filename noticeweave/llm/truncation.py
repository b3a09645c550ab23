"""Titles that were cut off: a vocabulary trie, read backwards from every position, combined with length evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeweave.llm.canonical import ordinary
from noticeweave.session import bounded_broadcast, checkpoint, stored

#: The shortest node that says anything, and the depth to which the trie is counted for all titles. Below it only nodes that
#: speak for both sides are followed, to the whole title.
LEAST, UPPER = 2, 8
#: The depths to which the steps below it go; the last one has no end.
LOWER = (12, 20, None)
# Marks and broken characters that a cut leaves behind, entity fragments included.
CUT_MARK = r"(?:\s*(?:…+|⋯+|\.{2,}|．{2,}|\x{fffd}+|&(?:[A-Za-z]{0,8}|#[0-9xX]{0,6});?))+\s*\z"


def _tail(c: Column, k: Column | int) -> Column:
    """The last ``k`` characters, fewer where there are fewer."""
    n, k = F.length(c), F.lit(k) if isinstance(k, int) else k
    return F.substring(c, F.greatest(n - k + 1, F.lit(1)), k)


def _nodes(c: Column, least: int, most: Column | int) -> Column:
    """Hashes of the endings of a text, from ``least`` characters to ``most``, the longest last."""
    n = F.least(F.length(c), F.lit(most) if isinstance(most, int) else most)
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda k: F.xxhash64(_tail(c, k)))).otherwise(F.array().cast("array<bigint>"))


def _positions(bases: DataFrame) -> DataFrame:
    """Every title up to each of its positions: ``(base, p, on, end)``, whether it goes on there or is an uncut end."""
    n = F.length("base")
    at = bases.where(n >= LEAST).select("base", "marked", F.explode(F.sequence(F.lit(LEAST), n)).alias("p"))
    return at.select("base", "p", (F.col("p") < n).cast("long").alias("on"), ((F.col("p") == n) & ~F.col("marked")).cast("long").alias("end"))


def _counted(paths: DataFrame, final: DataFrame) -> DataFrame:
    return paths.join(final, "node", "left_semi").groupBy("node").agg(F.sum("end").alias("ended"), F.sum("on").alias("went_on"))


def ending_trie(bases: DataFrame) -> DataFrame:
    """Upper part of the trie of the corpus vocabulary, read backwards from every position: ``(node, ended, went_on)``.

    The titles have no word marks, so every sequence of characters counts as a word from wherever it begins; a node is the
    hash of one of up to ``UPPER`` characters. ``went_on`` counts the titles' positions where it is followed by more
    text, so that it is a proper prefix of longer known words; ``ended`` counts the uncut titles that end with it, so
    that it is itself a known word. Only nodes that some title ends with are kept. Windows are pre-aggregated before
    each shuffle; the second one has a row for each distinct window alone.
    """
    windows = _positions(bases).select(F.substring("base", F.greatest(F.col("p") - UPPER + 1, F.lit(1)), F.least(F.col("p"), F.lit(UPPER))).alias("w"), "on", "end")
    windows = windows.groupBy("w").agg(F.sum("on").alias("on"), F.sum("end").alias("end"))
    final = bases.select(F.explode(_nodes(F.col("base"), LEAST, UPPER)).alias("node")).distinct()
    return _counted(windows.select(F.explode(_nodes(F.col("w"), LEAST, UPPER)).alias("node"), "on", "end"), final)


def deeper_nodes(heads: DataFrame, both: DataFrame, least: int, most: int | None) -> DataFrame:
    """The trie from depth ``least`` to ``most``: ``(node, ended, went_on)`` of the endings of the titles in ``both`` (``base, node``).

    ``heads`` (``w, on, end``) are the texts before the positions that may count; only those that end with a node of ``both``,
    one sign shorter than ``least``, are followed.
    """
    long = heads.where(F.length("w") >= least).withColumn("node", F.xxhash64(_tail(F.col("w"), least - 1)))
    long = long.join(bounded_broadcast(both.select("node").distinct()), "node", "left_semi")
    final = both.select(F.explode(_nodes(F.col("base"), least, F.length("base") if most is None else most)).alias("node")).distinct()
    ends = F.length("w") if most is None else most
    return _counted(long.select(F.explode(_nodes(F.col("w"), least, ends)).alias("node"), "on", "end"), final)


def _deepest(bases: DataFrame, trie: DataFrame, least: int, most: Column | int, support: int) -> DataFrame:
    """``(base, d, node, ended, went_on)``: each title's longest ending that was seen ``support`` times."""
    # Spark takes the size of the titles for that of their endings, many times as much, and would broadcast these.
    looked = bases.select("base", F.posexplode(_nodes(F.col("base"), least, most)).alias("d", "node")).hint("merge")
    best = looked.join(trie, "node").where(F.col("ended") + F.col("went_on") >= support)
    best = best.groupBy("base").agg(F.max(F.struct((F.col("d") + least).alias("d"), "node", "ended", "went_on")).alias("s"))
    return best.select("base", "s.*")


def truncated_titles(titles: DataFrame, support: int = 8, known: float = 0.5, known_at_limit: float = 0.6) -> DataFrame:
    """``(tab, rec_key, source, title, n_chars, marked, known_share, at_limit, truncated)`` per distinct record.

    ``titles`` has ``tab, rec_key, source, title``. A title's final token is its longest ending, of any length, that was
    seen at least ``support`` times. It is unknown if it ended less than ``known`` of those times, and then, as it
    went on the other times, a proper prefix of known words: the title is cut. A cut mark or broken character at the
    end decides alone. Length is evidence where cut titles pile up (``at_limit``): where at least ``support`` titles of
    the source that are this long, and half of them, end in an unknown token, ``known_at_limit`` takes the place of
    ``known``, and a title without any token of enough support is cut as well.

    Null titles give no row, empty ones are not cut. Repeated rows count once.
    """
    df = titles.where(F.col("title").isNotNull()).select("tab", "rec_key", "source", "title").distinct()
    # Two words of a look-alike form must meet in one node.
    df = df.withColumn("plain", ordinary(F.rtrim(F.col("title"))))
    df = df.withColumn("base", F.regexp_replace("plain", CUT_MARK, "")).withColumn("marked", F.col("base") != F.col("plain"))
    df = checkpoint(df.withColumn("base", F.rtrim("base")).drop("plain"))
    bases = df.groupBy("base").agg(F.min("marked").alias("marked"))
    upper = stored(_deepest(bases, ending_trie(bases), LEAST, UPPER, support))
    # Beneath a node with fewer ends, or fewer continuations, no node of enough support can decide otherwise: only the others
    # are followed, in steps, from the positions that hold them to the beginning of the title.
    turns = (F.col("ended") >= known * support) & (F.col("went_on") >= (1 - max(known, known_at_limit)) * support)
    share = (F.col("ended") / (F.col("ended") + F.col("went_on"))).alias("share")
    found, last, depth = upper.select("base", "d", share), upper, UPPER
    both = last.where((F.col("d") == depth) & turns).select("base", "node")
    inside = _positions(bases).where(F.col("p") > UPPER).select("on", "end", F.substring("base", F.lit(1), F.col("p")).alias("w"))
    inside = inside.withColumn("node", F.xxhash64(_tail(F.col("w"), UPPER))).join(bounded_broadcast(both.select("node").distinct()), "node", "left_semi")
    heads = stored(inside.groupBy("w").agg(F.sum("on").alias("on"), F.sum("end").alias("end")))
    for most in LOWER:
        last = stored(_deepest(both, deeper_nodes(heads, both, depth + 1, most), depth + 1, F.length("base") if most is None else most, support))
        found = found.unionByName(last.select("base", "d", share))
        if most is not None:
            depth = most
            both = last.where((F.col("d") == depth) & turns).select("base", "node")
    best = found.groupBy("base").agg(F.max(F.struct("d", "share"))["share"].alias("known_share"))
    df = df.join(best, "base", "left").withColumn("n_chars", F.length("title"))
    unknown = F.coalesce(F.col("known_share") < known, F.lit(False))
    df = df.withColumn("_cut", F.col("marked") | unknown)
    piled = df.groupBy("source", "n_chars").agg(F.sum(unknown.cast("long")).alias("_u"), F.count(F.lit(1)).alias("_n"))
    piled = piled.where((F.col("_u") >= support) & (2 * F.col("_u") >= F.col("_n"))).select(F.col("source").alias("_source"), F.col("n_chars").alias("_n_chars"), F.lit(True).alias("_at"))
    df = df.join(piled, F.col("source").eqNullSafe(F.col("_source")) & (F.col("n_chars") == F.col("_n_chars")), "left")
    at_limit = F.coalesce("_at", F.lit(False))
    long = at_limit & F.coalesce(F.col("known_share") < known_at_limit, F.length("base") >= LEAST)
    return df.withColumn("at_limit", at_limit).withColumn("truncated", F.col("_cut") | long).select(
        "tab", "rec_key", "source", "title", "n_chars", "marked", "known_share", "at_limit", "truncated"
    )


def truncation_by_source(found: DataFrame) -> DataFrame:
    """``(tab, source, n_titles, n_truncated, share)`` of what ``truncated_titles`` returns."""
    cut = F.col("truncated").cast("long")
    return found.groupBy("tab", "source").agg(
        F.count(F.lit(1)).alias("n_titles"), F.sum(cut).alias("n_truncated"), F.round(F.avg(cut), 6).alias("share")
    )


def title_rows(crawl_urls: DataFrame, subsidies: DataFrame) -> DataFrame:
    """Titles of both tables in one frame, with the record's key and its source."""
    a = crawl_urls.select(F.lit("crawl_urls").alias("tab"), F.col("url").alias("rec_key"), F.col("source_id").alias("source"), "title")
    b = subsidies.select(F.lit("subsidies").alias("tab"), F.col("id").alias("rec_key"), F.col("agency").alias("source"), "title")
    return a.unionByName(b)
