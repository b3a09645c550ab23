"""Views of the catalogue: status and order, facets, visibility, layered overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeweave.functions import lifecycle as L
from noticeweave.functions import text as T

GROUPS = {"new": 0, "open": 1, "upcoming": 2, "unknown": 3, "closed": 4}


def with_status(df: DataFrame, now_s: int) -> DataFrame:
    """Add ``status, is_new, days_left, hot_text`` as of ``now_s``, civil seconds of UTC+8 since 1970."""
    now, today = F.lit(now_s), F.date_add(F.lit("1970-01-01").cast("date"), now_s // 86400)
    start, end = L.start_second(F.col("apply_start")), L.end_second(F.col("apply_end"), F.col("apply_end_time"))
    df = df.withColumn("status", L.status(F.col("status_flag"), start, end, now)).withColumn("is_new", L.is_new(F.col("announce_date"), today))
    left = L.days_left(F.col("status"), F.col("apply_end"), today)
    df = df.withColumn("days_left", left)
    hot = F.when(left == 0, "今天截止").when(left.between(1, L.HOT_DAYS), F.concat(F.lit("剩餘 "), left.cast("string"), F.lit(" 天")))
    return df.withColumn("hot_text", hot)


def lifecycle_order(now_s: int) -> list[Column]:
    """Sort keys: new, open, upcoming, unknown, closed; then by date as each group needs, then id.

    Two rows with the same end in a group sorted by end keep the last key, their id.
    """
    ann = F.coalesce(L.start_second(F.col("announce_date")), F.lit(0))
    end = L.end_second(F.col("apply_end"), F.col("apply_end_time"))
    group = F.when(F.col("is_new"), 0).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv]), F.col("status")))
    first = F.when(group == 0, -ann).when(group == 4, -F.coalesce(end, ann)).otherwise(end)
    second = F.when(group == 0, end).when(group.isin(1, 2, 3) & end.isNull(), -ann)
    return [group.asc(), first.asc_nulls_last(), second.asc_nulls_last(), F.when(group == 0, -ann).asc_nulls_last(), F.col("id").asc()]


def lifecycle_top(df: DataFrame, now_s: int, k: int) -> DataFrame:
    """The first ``k`` rows in lifecycle order with their rank: a top-k, not a total sort."""
    top = with_status(df, now_s).orderBy(*lifecycle_order(now_s)).limit(k)
    # At most k rows are numbered.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*lifecycle_order(now_s))))


def status_facet(df: DataFrame) -> DataFrame:
    """``(status, n)`` under the other filters, the empty status for all: one pass with grouping sets."""
    return df.rollup("status").agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.coalesce("status", F.lit("")))


def category_facet(df: DataFrame, column: str) -> DataFrame:
    """``(category, n)``: rows that hold the category, each once; null and empty arrays count nowhere."""
    return df.select(F.explode(F.array_distinct(column)).alias("category")).where("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def visible(df: DataFrame, year: int, ongoing: str | None = None) -> DataFrame:
    """Rows of the year, those of the year before that run on, and ongoing ones; ``carried_over`` marks the second kind.

    A row runs on if nothing has closed it (an empty flag is none) and its end, compared as text as it stands, is not before
    the year, or if it has no end and holds until its quota is used up. The column ``ongoing``, if named, marks programmes that
    show whatever their year, save those whose end is before it.
    """
    first, end = f"{year}-01-01", F.nullif("apply_end", F.lit(""))
    runs_on = F.when(end.isNotNull(), end >= first).otherwise(F.coalesce("until_quota", F.lit(False)))
    carried = (F.col("year") == year - 1) & (F.coalesce("status_flag", F.lit("")) == "") & runs_on
    lasting = F.coalesce(F.col(ongoing), F.lit(False)) if ongoing else F.lit(False)
    shown = lasting & (end.isNull() | (end >= first))
    keep = (F.col("year") == year) | carried | shown
    rows = df.where(~F.coalesce("hidden", F.lit(False)) & F.coalesce(keep, F.lit(False)))
    return rows.withColumn("carried_over", ~F.col("year").eqNullSafe(F.lit(year)) & ~lasting)


def carried_label(carried: Column, status: Column, year: Column) -> Column:
    """The note of a row of another year that is still open; null for all others."""
    return F.when(F.coalesce(carried, F.lit(False)) & (status != "closed"), F.concat(year.cast("string"), F.lit(" 年公告・今年仍受理")))


def listed(df: DataFrame, year: int, targets: DataFrame) -> DataFrame:
    """Rows that the list of a year may need: not hidden and of the years around it, or named by an override.

    ``targets`` has one column with ids or addresses; both are looked up, and a row that both name comes once.
    """
    t = targets.toDF("_t").where("_t is not null").distinct()
    by_id, by_url = t.withColumnRenamed("_t", "_i"), t.withColumnRenamed("_t", "_u")
    df = df.where(~F.coalesce("hidden", F.lit(False)))
    df = df.join(by_id, F.col("id") == F.col("_i"), "left").join(by_url, F.col("official_url") == F.col("_u"), "left")
    near = F.coalesce(F.col("year").between(year - 1, year + 1), F.lit(False))
    return df.where(near | F.col("_i").isNotNull() | F.col("_u").isNotNull()).drop("_i", "_u")


def notice(df: DataFrame, ident: str) -> DataFrame:
    """One notice that is not hidden, by id; the filter reaches the scan. No row for an id that no one could have."""
    import re

    known = bool(re.fullmatch("[a-f0-9]{8,32}", ident or ""))
    return df.where((F.col("id") == ident) & ~F.coalesce("hidden", F.lit(False)) & F.lit(known)).limit(1)


def values_of(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row with the map of the wanted keys of ``pairs`` (``key, value``) that exist; of a repeated key the largest value."""
    one = pairs.where(F.col("key").isin(keys)).groupBy("key").agg(F.max("value").alias("value"))
    return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("values"))


def chosen(df: DataFrame, skip: str = "", **want: str) -> DataFrame:
    """Rows with the wanted ``status``, ``agency`` and ``category``, all but the filter ``skip``; a missing or empty one takes all."""
    for f in ("status", "agency"):
        if want.get(f) and skip != f:
            df = df.where(F.col(f) == want[f])
    if want.get("category") and skip != "category":
        df = df.where(F.array_contains(T.categories_of(F.col("target_types")), want["category"]))
    return df


def totals(df: DataFrame, **want: str) -> DataFrame:
    """``(n_all, n_open, n_hot, n_chosen)`` of rows with status in one pass."""
    hit = F.lit(True)
    for f in ("status", "agency"):
        if want.get(f):
            hit = hit & F.coalesce(F.col(f) == want[f], F.lit(False))
    if want.get("category"):
        hit = hit & F.coalesce(F.array_contains(T.categories_of(F.col("target_types")), want["category"]), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("status") == "open").alias("n_open"),
        F.count_if(F.col("hot_text").isNotNull()).alias("n_hot"), F.count_if(hit).alias("n_chosen"),
    )


def agency_list(df: DataFrame) -> DataFrame:
    """Distinct agencies in the order of Traditional Chinese; nulls and empty names are left out."""
    names = df.where("agency <> ''").select("agency").distinct()
    return names.orderBy(F.collate("agency", "zh_Hant_TWN"), "agency")


def without_excluded(df: DataFrame, targets: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose id and URL no exclusion names and whose title no pattern matches.

    ``targets`` has one column ``target``; the patterns are compiled into one expression.
    """
    t = targets.where("target is not null").select("target").distinct()
    df = df.join(t, F.col("id") == F.col("target"), "left_anti").join(t, F.col("official_url") == F.col("target"), "left_anti")
    return df.where(~F.coalesce(F.col("title").rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))) if patterns else df


def layered(df: DataFrame, exact: DataFrame, rules: list[tuple[str, dict]], fields: list[str], amounts: tuple = ()) -> DataFrame:
    """Overrides in layers: title rules in order, later ones winning, then the exact one, by id before URL before other addresses.

    ``exact`` has ``target`` and ``set``, a map from field to text; a field that is present wins even if its value is
    null. Rules are ``(pattern, {field: text})``; a rule with ``amount_year`` sets the fields ``amounts`` in rows of that year alone.
    Only ``fields`` can be overridden; two exact overrides of one target count as the later one in binary order of their
    entries. Of a row's ``source_urls``, if it has that column, the first with an override counts.
    """
    one = exact.groupBy("target").agg(F.max(F.struct(F.to_json("set").alias("k"), F.map_entries("set").alias("e"))).alias("m"))
    one = one.select("target", F.map_from_entries("m.e").alias("set"))
    by_id = one.select(F.col("target").alias("_i"), F.col("set").alias("_by_id"))
    by_url = one.select(F.col("target").alias("_u"), F.col("set").alias("_by_url"))
    columns = df.columns
    df = df.join(by_id, F.col("id") == F.col("_i"), "left").join(by_url, F.col("official_url") == F.col("_u"), "left")
    chosen = F.coalesce("_by_id", "_by_url")
    if "source_urls" in columns:
        spread = df.select("id", F.posexplode("source_urls").alias("_at", "_s")).join(one, F.col("_s") == F.col("target"))
        first = spread.groupBy(F.col("id").alias("_k")).agg(F.min(F.struct("_at", F.map_entries("set").alias("e"))).alias("_m"))
        df = df.join(first.select("_k", F.map_from_entries("_m.e").alias("_by_any")), F.col("id") == F.col("_k"), "left")
        chosen = F.coalesce("_by_id", "_by_url", "_by_any")
    matched, out = F.lit(False), {}
    applies = {i: F.coalesce(F.col("title").rlike(pattern), F.lit(False)) for i, (pattern, _) in enumerate(rules)}
    for hit in applies.values():
        matched = matched | hit
    for f in fields:
        value = F.col(f).cast("string")
        for i, (_, new) in enumerate(rules):
            if f in new:
                of_year = F.coalesce(F.col("year") == new["amount_year"], F.lit(False)) if f in amounts and "amount_year" in new else F.lit(True)
                value = F.when(applies[i] & of_year, F.lit(new[f])).otherwise(value)
        out[f] = F.when(F.map_contains_key(chosen, f), F.element_at(chosen, f)).otherwise(value)
    manual = chosen.isNotNull() | matched
    df = df.withColumn("manual", manual)
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in columns], "manual")


def year_of_announcement(announced: Column, year: Column) -> Column:
    """The year of a row whose announcement date was overridden: that of the date if it begins with four digits."""
    return F.coalesce(F.regexp_extract(announced, r"^(\d{4})", 1).try_cast("int"), year)
