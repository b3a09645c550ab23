"""Validation and coercion of incoming rows: quarantine row by row, or reject the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def flagged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``errors``: the names of the rules that a row breaks, in order. A rule that gives null is kept."""
    bad = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules]
    return df.withColumn("errors", F.array_compact(F.array(*bad)))


def accepted_batch(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rows, or none if any breaks a rule: one bad row rejects the batch."""
    rows = flagged(df, rules)
    bad = rows.where(F.size("errors") > 0).limit(1).select(F.lit(True).alias("_bad"))
    return rows.join(F.broadcast(bad), F.lit(True), "left_anti").drop("errors")


def coerced(df: DataFrame, texts: dict[str, int], enums: dict[str, list[str]], arrays: dict[str, tuple[int, int]]) -> DataFrame:
    """Texts cut to their limit and emptied to null, unknown enum values null, arrays and their items limited."""
    for c, n in texts.items():
        df = df.withColumn(c, F.nullif(F.left(F.trim(c), F.lit(n)), F.lit("")))
    for c, values in enums.items():
        df = df.withColumn(c, F.when(F.col(c).isin(values), F.col(c)))
    for c, (items, n) in arrays.items():
        df = df.withColumn(c, F.transform(F.slice(F.filter(c, lambda x: x.isNotNull()), 1, items), lambda x, n=n: F.left(x, F.lit(n))))
    return df


def subsidy_rules() -> list[Rule]:
    """Rules of a catalogue row: id, address, dates, flag, number ranges."""
    date = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}\z")
    return [
        ("id", F.coalesce(F.col("id").rlike(r"^[a-f0-9]{8,32}\z"), F.lit(False))),
        ("title", F.coalesce(F.length(F.trim("title")) > 0, F.lit(False))),
        ("official_url", F.coalesce(F.col("official_url").rlike(r"^https?://"), F.lit(False))),
        ("announce_date", date("announce_date")),
        ("apply_end", date("apply_end")),
        ("apply_end_time", F.col("apply_end_time").rlike(r"^([01]\d|2[0-3]):[0-5]\d\z")),
        ("year", F.col("year").between(1990, 2100)),
        ("status_flag", F.col("status_flag").isin("quota_full", "budget_exhausted", "closed_early", "closed")),
        ("views", F.col("views") >= 0),
    ]
