"""Snapshot algebra: upserts, merges, change detection, unique keys, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep_old: list[str], fill: list[str] = ()) -> DataFrame:
    """The snapshot after ``new`` rows are written over ``old`` ones by ``key``.

    The last new row of a key, by ``order`` and then by all values, counts. ``keep_old`` columns are never overwritten;
    ``fill`` columns only by a value. Rows with a null key are left out. One shuffle by key: union and one aggregation, no
    join, so a key with very many rows is reduced before the shuffle.
    """
    cols = [c for c in old.columns if c != key]
    row = lambda rank: F.struct(F.lit(rank).alias("_r"), F.col(order).alias("_o"), *[F.col(c) for c in cols])
    both = old.where(F.col(key).isNotNull()).select(key, row(0).alias("_v")).unionByName(new.where(F.col(key).isNotNull()).select(key, row(1).alias("_v")))
    newest = both.groupBy(key).agg(F.max("_v").alias("v"), F.max(F.when(F.col("_v._r") == 0, F.col("_v"))).alias("o"))
    value = lambda c: F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"v.{c}"))
    out = [value(c).alias(c) if c in keep_old else F.coalesce(f"v.{c}", f"o.{c}").alias(c) if c in fill else F.col(f"v.{c}").alias(c) for c in cols]
    return newest.select(key, *out)


def merge_group(df: DataFrame, key: str, order: list[str], scalars: list[str], arrays: list[str], flags: list[str], cap: int = 20) -> DataFrame:
    """One row per key: the first known scalar in order, arrays united in order (at most ``cap`` items), flags or-ed.

    Map-side combined by taking minima of (order, value); only array elements are collected, each with its place.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v"))))["v"].alias(c)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    base = df.groupBy(key).agg(*[first(c) for c in scalars], *[flag(c) for c in flags], F.count(F.lit(1)).alias("n_merged"))
    for c in arrays:
        items = df.select(key, *order, F.posexplode(c).alias("_p", "_x")).where("_x is not null")
        least = items.groupBy(key, "_x").agg(F.min(F.struct(*order, "_p")).alias("_at"))
        ranked = least.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at", "_x"))).where(F.col("_n") <= cap)
        listed = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_x"))), lambda s: s["_x"]).alias(c))
        base = base.join(listed, key, "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return base


def unique_keys(df: DataFrame, key: str, ident: str) -> DataFrame:
    """Every later row of a key, by id, gets ``|id`` appended, so that keys are unique.

    A key's first id is a minimum, combined before the shuffle; only keys with several ids are joined back. Repeated rows of
    the first id keep the key, null keys stay null.
    """
    ids = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(ident).alias("_first"), F.max(ident).alias("_last"))
    df = df.join(ids.where("_first <> _last"), F.col(key) == F.col("_k"), "left")
    later = F.col("_first").isNotNull() & (F.col(ident) != F.col("_first"))
    return df.withColumn(key, F.when(later, F.concat(F.col(key), F.lit("|"), F.col(ident))).otherwise(F.col(key))).drop("_k", "_first", "_last")


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the key's row before, null-safe; a key's first row counts as new."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(value).over(w))
    kind = F.when(F.col("_n") == 1, "new").when(F.col(value).eqNullSafe(F.col("_before")), "same").otherwise("changed")
    return df.withColumn("change", kind).drop("_n", "_before")


def keep_last(df: DataFrame, ident: str, n: int) -> DataFrame:
    """Rows whose number is among the last ``n`` numbers: the maximum is one row and joined as such."""
    top = df.agg(F.max(ident).alias("_max"))
    return df.join(F.broadcast(top), F.col(ident) > F.col("_max") - n).drop("_max")


def first_wins(df: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first row of each key in a fixed order, nulls first, then by the other columns; null keys are one key.

    A minimum of rows, combined before the shuffle, so a key's rows are never gathered. All columns must be orderable.
    """
    row = F.struct(*order, *[c for c in df.columns if c != key and c not in order])
    one = df.groupBy(key).agg((F.max if last else F.min)(row).alias("_v"))
    return one.select(*[F.col(c) if c == key else F.col(f"_v.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in a fixed order, nulls first, then by the other columns: a snapshot of a log."""
    return first_wins(df, key, order, last=True)


def replaced_all(old: DataFrame, new: DataFrame | None, key: str, order: str) -> DataFrame:
    """The table after a delivery that replaces all of it: the last new row of each key, or, without a delivery, the old rows.

    An empty delivery empties the table; null keys are left out.
    """
    return old if new is None else last_wins(new.where(F.col(key).isNotNull()), key, [order]).select(*old.columns)


def withdrawn(df: DataFrame, urls: DataFrame, url: str = "official_url") -> DataFrame:
    """``df`` with ``hidden`` set where ``urls`` (one column) has the row's address, and ``changed`` where that is new."""
    u = urls.toDF("_u").where("_u is not null").distinct()
    df = df.join(u, F.col(url) == F.col("_u"), "left").withColumn("changed", F.col("_u").isNotNull() & ~F.coalesce("hidden", F.lit(False)))
    return df.withColumn("hidden", F.coalesce("hidden", F.lit(False)) | F.col("_u").isNotNull()).drop("_u")


def link_states(df: DataFrame, checked: DataFrame, url: str = "official_url", fails: int = 3) -> DataFrame:
    """``df`` with ``link_status`` after checks ``(url, ok, permanent, fail_count)``: dead, ok, or as it was.

    An address is dead after a permanent failure that was at least the ``fails``-th in a row, and ok after a success. Of several
    checks of one address a death counts before a success.
    """
    dead = F.coalesce(F.col("permanent") & ~F.col("ok") & (F.col("fail_count") >= fails), F.lit(False))
    said = checked.where("url is not null").groupBy(F.col("url").alias("_u")).agg(F.bool_or(dead).alias("_dead"), F.bool_or(F.coalesce("ok", F.lit(False))).alias("_ok"))
    df = df.join(said, F.col(url) == F.col("_u"), "left")
    return df.withColumn("link_status", F.when(F.col("_dead"), "dead").when(F.col("_ok"), "ok").otherwise(F.col("link_status"))).drop("_u", "_dead", "_ok")


#: Fields that a page of a notice may fill or, if it is the notice's own page, overwrite.
FILLED = ("announce_date", "apply_start", "apply_end", "deadline_text", "target", "amount_text", "summary", "doc_no", "delegate")


def _rank(url: Column) -> Column:
    """2 a page of the government, 1 any other page or a row of a list, 0 no page."""
    gov = F.coalesce(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1).rlike(r"(?i)(^|\.)gov\.tw\z") & ~url.contains("#row-"), F.lit(False))
    return F.when(F.coalesce(url, F.lit("")) == "", 0).when(gov, 2).otherwise(1)


def merged_notice(pairs: DataFrame, old: str = "old", new: str = "new", cap: int = 20) -> DataFrame:
    """``pairs`` of a known notice and a page of it, structs of one shape, with ``merged`` and ``case``; ``old`` null means a new notice.

    * ``dated``: the known one has no year and the page has; the page counts, id and first sight stay, and target and
      amount are filled from the known one;
    * ``own``: the page is the notice's own, or ranks higher as a source and is of its year and becomes it; what the page
      says overwrites, also the status flag;
    * ``other``: any other page fills what is null, and its flag counts within the same year alone;
    * ``new``: the page as it is.

    Addresses are united in order, ``cap`` at most, and ``until_quota`` is true if either is. A known announcement date gives the year.
    """
    o, n = F.col(old), F.col(new)
    fields = pairs.schema[new].dataType.fieldNames()
    known = o["id"].isNotNull()
    upgrade = known & (_rank(n["official_url"]) > _rank(o["official_url"])) & n["year"].isNotNull() & (n["year"] == o["year"])
    own = F.coalesce(known & ((o["official_url"] == n["official_url"]) | upgrade), F.lit(False))
    dated = known & o["year"].isNull() & n["year"].isNotNull()
    case = F.when(~known, "new").when(dated, "dated").when(own, "own").otherwise("other")
    c = F.col("case")
    none = F.array().cast("array<string>")
    urls = lambda *parts: F.slice(F.array_distinct(F.array_compact(F.concat(*[F.coalesce(p, none) for p in parts]))), 1, cap)

    def value(f: str) -> Column:
        keep, take = o[f], n[f]
        if f in ("id", "first_seen_at"):
            return F.when(c == "new", take).otherwise(keep)
        if f == "source_urls":
            both = urls(F.array(n["official_url"], o["official_url"]), o[f])
            raised = F.when((c == "own") & upgrade, F.array(o["official_url"]))
            return F.when(c == "new", urls(take)).when(c == "dated", both).otherwise(urls(raised, o[f], F.array(n["official_url"])))
        if f == "until_quota":
            either = F.coalesce(keep, F.lit(False)) | F.coalesce(take, F.lit(False))
            return F.when(c.isin("new", "dated"), take).otherwise(either)
        if f == "status_flag":
            same = (F.coalesce(take, F.lit("")) != "") & (n["year"] == F.col("_year"))
            return F.when(c.isin("new", "dated"), take).when(c == "own", F.nullif(take, F.lit(""))).when(F.coalesce(same, F.lit(False)), take).otherwise(keep)
        if f in ("target", "amount_text"):
            return F.when(c.isin("new",), take).when(c.isin("dated", "own"), F.coalesce(take, keep)).otherwise(F.coalesce(keep, take))
        if f in FILLED:
            return F.when(c.isin("new", "dated"), take).when(c == "own", F.coalesce(take, keep)).otherwise(F.coalesce(keep, take))
        if f == "official_url":
            return F.when(c.isin("new", "dated") | ((c == "own") & upgrade), take).otherwise(keep)
        if f == "year":
            return F.when(c.isin("new", "dated"), take).otherwise(F.coalesce(F.left(F.col("_announced"), F.lit(4)).try_cast("int"), keep))
        if f == "title":
            return F.when(c == "other", keep).otherwise(take)
        return F.when(c == "other", F.coalesce(keep, take)).otherwise(F.coalesce(take, keep) if f != "content" else take)

    pairs = pairs.withColumn("case", case)
    pairs = pairs.withColumn("_year", o["year"]).withColumn("_announced", value("announce_date") if "announce_date" in fields else F.lit(None).cast("string"))
    return pairs.withColumn("merged", F.struct(*[value(f).alias(f) for f in fields])).drop("_year", "_announced")
