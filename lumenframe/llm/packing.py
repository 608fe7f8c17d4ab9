"""Items packed into containers of fixed capacity by the sum-of-squares rule.

An item goes where the sum, over all residual gaps, of the squared number of open containers with that gap becomes
smallest.  The state is one counter per gap, so it is bounded by the capacity, but the rule is sequential: items are
spread evenly over groups of a bounded number of items, which are packed side by side, and the items of the containers
that stay far from full in their groups are pooled and packed once more.

Defined results: an item of size 0 (empty or null text) takes no room and joins the first container of its group; an
item larger than the capacity is split into full containers and one remainder, which is packed like an item; repeated
rows of an item count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut

GROUP_ITEMS = 60_000
FULL_ENOUGH = 0.98


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (1..capacity), in the given order of arrival; ties take the smaller gap."""
    gaps = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), dtype=np.int64)
    used = 0
    never = np.int64(2**62)
    for i, size in enumerate(sizes.tolist()):
        rest = gaps[: capacity + 1 - size]
        here = gaps[size:]
        # Twice the half change of the sum: a gap g becomes g - size; a gap of 0 counts for nothing, a new container leaves none.
        change = np.where(here > 0, 2 * (rest - here + 1), never)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]
        change[-1] = 2 * rest[-1] + 1
        best = int(change.argmin()) + size
        if best == capacity:
            number, used = used, used + 1
        else:
            number = open_bins[best].pop()
            gaps[best] -= 1
        left = best - size
        if left:
            gaps[left] += 1
            open_bins[left].append(number)
        where[i] = number
    return where


def better_order(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The rule over items in falling order and over a fixed shuffle of them; the result with fewer containers."""
    shuffled = np.random.default_rng(0).permutation(len(sizes))
    falling = sum_of_squares(sizes, capacity)
    mixed = np.empty_like(falling)
    mixed[shuffled] = sum_of_squares(sizes[shuffled], capacity)
    return mixed if mixed.max(initial=-1) < falling.max(initial=-1) else falling


def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, doc_id, piece, token_start, size): whole items, or the parts of those that exceed the capacity."""
    known = items.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
    sizes = containers.where("capacity_tokens > 0").groupBy("container").agg(F.min("capacity_tokens").alias("capacity"))
    both = known.join(F.broadcast(sizes), how="cross")
    count = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")
    cutup = both.select("container", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return cutup.select("container", "capacity", "doc_id", "piece", start.alias("token_start"), F.least(F.col("n_tokens") - start, F.col("capacity")).cast("int").alias("size"))


def _packed(todo: DataFrame, groups: int, stage: int) -> DataFrame:
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        container, group = key
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True])
        sizes = pdf["size"].to_numpy()
        filled = sizes > 0
        bins = np.zeros(len(pdf), dtype=np.int64)
        bins[filled] = better_order(sizes[filled], capacity)
        load = np.bincount(bins, weights=sizes)
        return pd.DataFrame(
            {"container": container, "capacity": capacity, "doc_id": pdf["doc_id"], "piece": pdf["piece"], "token_start": pdf["token_start"], "size": pdf["size"], "bin_id": [f"{stage}-{group}-{b}" for b in bins], "load": load[bins].astype("int64")}
        )

    ddl = "container string, capacity int, doc_id bigint, piece int, token_start int, size int, bin_id string, load bigint"
    group = F.pmod(F.xxhash64("doc_id", "piece", F.lit(stage)), F.lit(groups))
    # A number of partitions that is asked for is kept; small groups would otherwise be put together in few tasks.  Of three
    # containers each group is a task, as long as these are no more than twenty for each core of the cluster.
    tasks = min(groups * 3, max(3, 20 * todo.sparkSession.sparkContext.defaultParallelism))
    return todo.withColumn("group", group).repartition(tasks, "container", "group").groupBy("container", "group").applyInPandas(pack, ddl)


def pack(items: DataFrame, containers: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, capacity, doc_id, piece, token_start, size, bin_id) of every item (doc_id, n_tokens) for every container.

    Full pieces need no packing: each is a container of its own.
    """
    todo = cut(pieces(items, containers))
    ready = todo.where("size = capacity").withColumn("bin_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece"))
    open_items = todo.where("size < capacity")
    most = max([r["n"] for r in open_items.groupBy("container").agg(F.count("*").alias("n")).collect()], default=0)
    groups = max(1, -(-most // group_items))
    first = _packed(open_items, groups, 0)
    if groups == 1:
        return ready.unionByName(first.drop("load"))
    first = cut(first)
    fine = F.col("load") >= FULL_ENOUGH * F.col("capacity")
    loose = first.where(~fine).drop("bin_id", "load")
    again = max([r["n"] for r in loose.groupBy("container").agg(F.count("*").alias("n")).collect()], default=0)
    second = _packed(loose, max(1, -(-again // group_items)), 1)
    return ready.unionByName(first.where(fine).drop("load")).unionByName(second.drop("load"))
