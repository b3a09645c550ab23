"""Mixing sources to target shares of the tokens: capped water-filling and seeded repetitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeweave.session import bounded_broadcast, checkpoint

#: Most buckets of a source's seeded order, and the texts that make one more; the bucket in which the fractional repetition
#: ends is gone through text by text.
BUCKETS, PER_BUCKET = 4096, 1000


def water_fill(targets: list[float], caps: list[float], total: float) -> list[float]:
    """Amounts in proportion to ``targets`` that add up to ``total`` where no cap is exceeded.

    Those beyond their cap are clamped to it and their excess goes to the others in proportion, until all fit or all
    are clamped.
    """
    got, free = [0.0] * len(targets), [i for i, t in enumerate(targets) if t > 0 and caps[i] > 0]
    left = total
    while free and left > 0:
        weight = sum(targets[i] for i in free)
        over = [i for i in free if left * targets[i] / weight >= caps[i]]
        if not over:
            for i in free:
                got[i] = left * targets[i] / weight
            break
        for i in over:
            got[i] = caps[i]
        left -= sum(caps[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return got


def _plan(total: int | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", kind="stable")
        have = rows["tokens_available"].to_numpy(dtype=float)
        caps = have * rows["max_repeats"].clip(lower=0).to_numpy(dtype=float)
        got = water_fill(list(rows["target_share"]), list(caps), float(have.sum() if total is None else total))
        out = rows[["source", "target_share", "max_repeats", "tokens_available"]].copy()
        out["planned_tokens"] = got
        out["epochs"] = [g / h if h else 0.0 for g, h in zip(got, have)]
        out["clamped"] = [bool(g >= c) and t > 0 for g, c, t in zip(got, caps, rows["target_share"])]
        return out

    return run


def plan_mix(sizes: DataFrame, source: str, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``(source, target_share, max_repeats, tokens_available, planned_tokens, epochs, clamped)`` per listed source.

    ``total`` tokens are shared out, by default as many as the listed sources have. A source that is listed twice counts
    with the sum of its shares and its largest cap; one without documents is clamped at nothing. The plan has one row for
    each listed source and is made in one task.
    """
    have = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("tokens_available"))
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"),
    )
    rows = listed.join(have, "source", "left").withColumn("tokens_available", F.coalesce("tokens_available", F.lit(0)))
    shape = "source string, target_share double, max_repeats int, tokens_available long, planned_tokens double, epochs double, clamped boolean"
    return rows.groupBy().applyInPandas(_plan(total), shape)


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source's last bucket, in seeded order, the texts that still fit."""
    rows = rows.sort_values(["_order", "key"], kind="stable")
    left, more = float(rows["_part"].iat[0] - rows["_before"].iat[0]), []
    for n in rows["n_tokens"].tolist():
        more.append(int(n <= left))
        left -= n * more[-1]
    return rows[["key", "source", "n_tokens", "_whole", "_part"]].assign(_more=pd.array(more, dtype="int64"))


def draw_mix(sizes: DataFrame, key: str, source: str, targets: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """``(key, source, n_tokens, repeats)`` of every chosen record.

    Each record is used as often as its source's whole epochs; the fraction goes to the first records of the source's
    seeded order, as far as their tokens fit into what is planned. That order's prefix is found from token sums of
    hash buckets, and only the bucket in which it ends is gone through record by record: a text too long for what is left is
    passed over for later ones that fit. A bucket has about a thousand texts, of a source with more than four million a
    four-thousandth of them, so no source is gathered in one task. Records without a listed source, and empty texts, are
    not chosen unless whole epochs hold them.
    """
    plan = checkpoint(plan_mix(sizes, source, targets, total)).where("epochs > 0")
    p = plan.select(F.col("source").alias("_s"), "epochs", "tokens_available", "max_repeats")
    many = sizes.groupBy(F.col(source).alias("_s")).agg(F.greatest(F.lit(1), F.least(F.lit(BUCKETS), F.ceil(F.count(F.lit(1)) / PER_BUCKET))).alias("_buckets"))
    p = checkpoint(p.join(many, "_s"))
    rows = sizes.select(F.col(key).alias("key"), F.col(source).alias("source"), "n_tokens")
    rows = rows.join(bounded_broadcast(p, 10_000), F.col("source") == F.col("_s")).drop("_s")
    order = F.xxhash64(F.lit(seed), "key")
    rows = rows.withColumn("_order", order).withColumn("_b", F.pmod(order, F.col("_buckets")).cast("int"))
    # A share of almost a whole epoch through rounding is one.
    rows = rows.withColumn("_whole", F.least(F.floor(F.col("epochs") + 1e-9), F.col("max_repeats")))
    rows = rows.withColumn("_part", F.when(F.col("_whole") < F.col("max_repeats"), (F.col("epochs") - F.col("_whole")) * F.col("tokens_available")).otherwise(0.0))
    sums = rows.groupBy("source", "_b").agg(F.sum("n_tokens").alias("t"), F.first("_part").alias("part"))
    # At most BUCKETS rows a source: the first bucket that the fraction doesn't fill, and the tokens before it.
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("_b"))
    sums = sums.withColumn("upto", upto)
    short = F.when(F.col("upto") > F.col("part"), F.struct("_b", (F.col("upto") - F.col("t")).alias("before")))
    ends = sums.groupBy(F.col("source").alias("_s")).agg(F.min(short).alias("end"))
    ends = ends.select("_s", F.coalesce("end._b", F.lit(-1)).alias("_at"), F.coalesce("end.before", F.lit(0)).alias("_before"))
    ends = checkpoint(ends)
    rows = rows.join(bounded_broadcast(ends, 10_000), F.col("source") == F.col("_s")).drop("_s")
    at = F.col("_at")
    kind = sizes.schema[key].dataType.simpleString()
    last = rows.where((F.col("_b") == at) & (F.col("_part") > 0)).select("key", "source", "n_tokens", "_whole", "_part", "_order", "_before")
    last = last.groupBy("source").applyInPandas(_fill, f"key {kind}, source string, n_tokens long, _whole long, _part double, _more long")
    rest = rows.where((F.col("_b") != at) | (F.col("_part") <= 0)).withColumn("_more", ((F.col("_part") > 0) & ((at < 0) | (F.col("_b") < at))).cast("long"))
    both = rest.select(*last.columns).unionByName(last)
    return both.withColumn("repeats", (F.col("_whole") + F.col("_more")).cast("int")).where("repeats > 0").select("key", "source", "n_tokens", "repeats")


def mix_report(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """``(source, target_share, planned_share, actual_share, tokens_used, n_records, epochs, max_repeats, clamped)``."""
    used = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.count(F.lit(1)).alias("n_records"))
    rows = plan.join(used, "source", "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0))).withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    sums = rows.agg(F.sum("tokens_used").alias("_used"), F.sum("planned_tokens").alias("_planned"))
    out = rows.join(F.broadcast(sums))  # one row of sums
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return out.select(
        "source", "target_share", share("planned_tokens", "_planned").alias("planned_share"), share("tokens_used", "_used").alias("actual_share"),
        "tokens_used", "n_records", F.round("epochs", 6).alias("epochs"), "max_repeats", "clamped",
    )
