"""Filling containers of fixed capacity with texts: best-two-fit."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.session import stored

#: Texts that one task packs, and how many tasks' last open containers are packed together again.
SHARD, MERGED = 20_000, 64


class _Stock:
    """Unpacked items by size: largest that fits, and the tightest pair, without touching each item."""

    def __init__(self, sizes: np.ndarray):
        self.items: dict[int, list[int]] = {}
        for i in np.argsort(-sizes, kind="stable")[::-1]:
            self.items.setdefault(int(sizes[i]), []).append(int(i))
        self.sizes = sorted(self.items)
        self.left = len(sizes)

    def fit(self, room: int) -> int | None:
        """The largest size that fits into ``room``."""
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else None

    def take(self, size: int) -> int:
        held = self.items[size]
        item = held.pop()
        if not held:
            del self.items[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
        self.left -= 1
        return item

    def give(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            insort(self.sizes, size)
        self.items[size].append(item)
        self.left += 1

    def pair(self, room: int, above: int) -> tuple[int, int] | None:
        """Two sizes with the largest sum within ``room`` and above ``above``, by two pointers over distinct sizes."""
        best, found = above, None
        lo, hi = 0, bisect_right(self.sizes, room) - 1
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > room:
                hi -= 1
            else:
                if a + b > best and (lo < hi or len(self.items[a]) > 1):
                    best, found = a + b, (b, a)
                    if best == room:
                        return found
                lo += 1
        return found


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, all of at most ``capacity``.

    Every container is filled greedily with the largest item that fits; then its smallest item makes room for two
    unpacked ones that fit the gap more tightly. Items without size go to the first container.
    """
    place = np.zeros(len(sizes), dtype=np.int64)
    real = np.nonzero(sizes > 0)[0]
    stock = _Stock(sizes[real])
    bin_no = 0
    while stock.left:
        room, held = capacity, []
        while (size := stock.fit(room)) is not None:
            held.append((size, stock.take(size)))
            room -= size
        while room and stock.left > 1:
            small, item = held[-1]
            two = stock.pair(room + small, small)
            if two is None:
                break
            held.pop()
            held += [(s, stock.take(s)) for s in two]
            stock.give(small, item)
            room -= sum(two) - small
            held.sort(reverse=True)
        for _, item in held:
            place[real[item]] = bin_no
        bin_no += 1
    return place


_COLUMNS = ["budget_id", "capacity", "key", "part", "first_token", "n_tokens", "container", "shard", "open"]


def _emptiest(place: np.ndarray, sizes: np.ndarray) -> int:
    """The container with the most room; of several the last."""
    held = np.bincount(place, weights=sizes) if len(place) else np.zeros(1)
    return int(len(held) - 1 - np.argmin(held[::-1]))


def _pack_again(level: int):
    """The open containers of several shards, packed as one: all but the emptiest are closed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "part"], kind="stable").reset_index(drop=True)
        sizes, group = rows["n_tokens"].to_numpy(), int(rows["shard"].iat[0])
        place = best_two_fit(sizes, int(rows["capacity"].iat[0]))
        return rows.assign(container=[f"m{level}-{group}-{b}" for b in place], open=place == _emptiest(place, sizes))[_COLUMNS]

    return run


def _pack(budgets: list[tuple[int, int]]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        n, keys, shard = rows["n_tokens"].to_numpy(), rows["key"].to_numpy(), rows["shard"].iat[0]
        out = []
        for budget, capacity in budgets:
            whole, rest = np.divmod(n, capacity)
            # A text beyond the capacity fills whole containers; only what is left of it is packed.
            part = np.where((rest > 0) | (whole == 0))[0]
            full = np.repeat(np.arange(len(n)), whole)
            nth = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
            place = best_two_fit(rest[part], capacity)
            base = int(place.max()) + 1 if len(place) else 0
            who = np.concatenate([part, full])
            out.append(pd.DataFrame({
                "budget_id": budget, "capacity": capacity, "key": keys[who],
                "part": np.concatenate([whole[part], nth]).astype("int32"),
                "first_token": np.concatenate([whole[part], nth]) * capacity,
                "n_tokens": np.concatenate([rest[part], np.full(len(full), capacity)]),
                "container": [f"{shard}-{b}" for b in np.concatenate([place, base + np.arange(len(full))])],
                "shard": shard, "open": np.concatenate([place == _emptiest(place, rest[part]), np.zeros(len(full), dtype=bool)]),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=_COLUMNS)

    return run


def pack(sizes: DataFrame, key: str, budgets: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(budget_id, capacity, key, part, first_token, n_tokens, container)``: every text in containers, per budget.

    Texts are dealt to shards of about ``shard`` by a hash of their key, whatever their number, and each shard is packed
    by best-two-fit for every capacity. The emptiest container of each shard stays open: those of ``MERGED`` shards are packed
    together, and so on until one is left, so the shards cost no containers and no task holds more than so many
    containers. Only texts larger than the capacity are split, into whole containers and a rest
    that is packed like a text. Budgets without a positive capacity are left out; repeated keys are items of their own.
    The budgets, of which there must be at most 1,000, travel with the task.
    """
    wanted = budgets.where("capacity > 0").select("budget_id", "capacity").distinct().limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("more than 1,000 budgets")
    known = sorted((r["budget_id"], r["capacity"]) for r in wanted)
    shards = max(1, -(-sizes.count() // shard))
    rows = sizes.select(F.col(key).alias("key"), "n_tokens").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    kind = sizes.schema[key].dataType.simpleString()
    shape = f"budget_id int, capacity int, key {kind}, part int, first_token long, n_tokens long, container string, shard int, open boolean"
    # A number given keeps adaptive execution from putting small shards into one task.
    packed = rows.repartition(min(shards, 20_000), "shard").groupBy("shard").applyInPandas(_pack(known), shape)
    closed, level = [], 0
    while shards > 1:
        level, shards = level + 1, -(-shards // MERGED)
        packed = stored(packed)
        closed.append(packed.where("not open"))
        packed = packed.where("open").withColumn("shard", F.floor(F.col("shard") / MERGED).cast("int"))
        packed = packed.groupBy("budget_id", "shard").applyInPandas(_pack_again(level), shape)
    for part in closed:
        packed = packed.unionByName(part)
    return packed.drop("shard", "open")


def container_report(packed: DataFrame) -> DataFrame:
    """``(budget_id, capacity, n_containers, n_parts, tokens, least_containers, waste_share)`` per budget."""
    bins = packed.groupBy("budget_id", "capacity", "container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    out = bins.groupBy("budget_id", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_parts"), F.sum("t").alias("tokens")
    )
    return out.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn(
        "waste_share", F.round(1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 6)
    )
