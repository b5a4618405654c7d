"""Filling containers of fixed capacity with whole items (multiway differencing).

Items are dealt by hash to windows of bounded size, and each window is partitioned on its own: the Karmarkar-Karp
differencing method merges the two partial partitions with the widest spread, the fullest parts of one with the emptiest of
the other, until one partition into k near-equal containers is left, k being the least that the sum allows. Equal loads are not full ones where few items share
a container, so the containers are then settled one after another, those with the largest items first, by exchanging items with
those not settled yet, which gathers all that is short or over in the last; items over the capacity there are partitioned again with the containers that
have room, and the number of containers rises.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, spread
from .tokens import with_tokens

#: Containers that a window fills, about, and items that it has at most, about. Larger windows waste less and take longer.
CONTAINERS, ITEMS = 256, 8192
#: Share of a container left over from which it is opened again for what found no place.
ROOM = 0.01
_LAST = 1 << 62


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Index of one of k parts for each item, by the largest differencing method on k-tuples."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    # a partial partition keeps its non-empty parts only: loads rising, and the node that stands for each part's items
    loads = {i: np.array([v], np.int64) for i, v in enumerate(sizes.tolist())}
    parts = {i: np.array([i], np.int64) for i in range(n)}
    left, right, made = [], [], n
    heap = [(-v, i) for i, v in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        la, lb, pa, pb = loads.pop(a), loads.pop(b), parts.pop(a), parts.pop(b)
        shared = max(0, len(la) + len(lb) - k)
        # the emptiest ``shared`` parts of each side meet, in opposite order when both are full
        if shared:
            lo_a, lo_b = la[: shared], lb[: shared][::-1]
            new = np.arange(made, made + shared)
            left.append(pa[:shared])
            right.append(pb[:shared][::-1])
            made += shared
            load = np.concatenate([lo_a + lo_b, la[shared:], lb[shared:]])
            part = np.concatenate([new, pa[shared:], pb[shared:]])
        else:
            load, part = np.concatenate([la, lb]), np.concatenate([pa, pb])
        order = np.argsort(load, kind="stable")
        load, part = load[order], part[order]
        loads[a], parts[a] = load, part
        spread = int(load[-1] - load[0]) if len(load) == k else int(load[-1])
        heapq.heappush(heap, (-spread, a))
    last = heap[0][1]
    label = np.zeros(made, np.int64)
    label[parts[last]] = np.arange(len(parts[last]))
    if left:
        lefts, rights = np.concatenate(left), np.concatenate(right)
        for i in range(len(lefts) - 1, -1, -1):
            label[lefts[i]] = label[rights[i]] = label[n + i]
    return label[:n]


def _settle(sizes: list[int], items: list[int], room: int, pool: list[tuple[int, int]], swap) -> int:
    """Bring one container to its capacity with the items of those not settled yet; the room left, negative if over.

    pool: sorted (size, item) of these. The best step, an item taken in or exchanged for another, leaves the least room.
    """
    while room and pool:
        best = None  # (room after it, place of the item given away, place in the pool)
        if room > 0:
            at = bisect_right(pool, (room, _LAST)) - 1
            if at >= 0 and pool[at][0] > 0:
                best = (room - pool[at][0], -1, at)
        for place, item in enumerate(items):
            if best and best[0] == 0:
                break
            at = bisect_right(pool, (sizes[item] + room, _LAST)) - 1
            if at >= 0:
                after = room - pool[at][0] + sizes[item]
                if (best is None or after < best[0]) and (room < 0 or after < room):
                    best = (after, place, at)
        if best is None:
            break
        after, place, at = best
        item = pool.pop(at)[1]
        if place < 0:
            swap(item, -1)
            items.append(item)
        else:
            out = items[place]
            swap(item, out)
            items[place] = item
            insort(pool, (sizes[out], out))
        room = after
    return room


def _round(sizes: list[int], groups: list[list[int]], capacity: int) -> None:
    """Settle containers one after another, that with the largest item first; what is short or over gathers in the last."""
    home = {i: g for g, items in enumerate(groups) for i in items}
    pool = sorted((sizes[i], i) for i in home)
    for g in sorted(range(len(groups)), key=lambda g: (-max((sizes[i] for i in groups[g]), default=0), g)):
        for i in groups[g]:
            pool.pop(bisect_left(pool, (sizes[i], i)))

        def swap(taken: int, given: int, g: int = g) -> None:
            other = home[taken]
            groups[other].remove(taken)
            home[taken] = g
            if given >= 0:
                groups[other].append(given)
                home[given] = other

        _settle(sizes, groups[g], capacity - sum(sizes[i] for i in groups[g]), pool, swap)


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, none over the capacity; no item may exceed it. Sizes of 0 are allowed."""
    sizes = np.asarray(sizes, dtype=np.int64)
    part = np.full(len(sizes), -1, np.int64)
    if not len(sizes):
        return part
    if sizes.max() > capacity:
        raise ValueError("an item exceeds the capacity")
    plain, left, used = sizes.tolist(), np.arange(len(sizes)), 0
    while len(left):
        k = max(1, math.ceil(int(sizes[left].sum()) / capacity))
        groups: list[list[int]] = [[] for _ in range(k)]
        for item, g in zip(left.tolist(), differencing(sizes[left], k).tolist()):
            groups[g].append(item)
        _round(plain, groups, capacity)
        again: list[int] = []
        for items in groups:
            load = sum(plain[i] for i in items)
            while load > capacity:
                out = max(items, key=lambda i: (plain[i], i))
                items.remove(out)
                again.append(out)
                load -= plain[out]
        short = [items for items in groups if sum(plain[i] for i in items) < capacity * (1 - ROOM)]
        inside = again + [i for items in short for i in items]
        # opened again while that can save a container
        if again or (math.ceil(sum(plain[i] for i in inside) / capacity) < len(short) and len(inside) < len(left)):
            again = inside if len(inside) < len(left) else again
            if again is inside:
                for items in short:
                    items.clear()
        for items in groups:
            if items:
                part[items] = used
                used += 1
        left = np.array(sorted(again), dtype=np.int64)
    return part


PACKED = "capacity_name string, container long, doc_id long, piece int, tokens int"


def pieces(sized: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_name, capacity, doc_id, piece, tokens): each text once per capacity, one longer than it as full pieces and a rest."""
    settings = [F.struct(F.lit(r["capacity_name"]).alias("capacity_name"), F.lit(r["tokens"]).cast("int").alias("capacity")) for r in capacities.where("tokens > 0").distinct().collect()]
    each = F.explode(F.array(*settings) if settings else F.array().cast("array<struct<capacity_name:string,capacity:int>>"))
    crossed = sized.where("tokens > 0").select("doc_id", "tokens", each.alias("c")).select("doc_id", "tokens", "c.*")
    whole = F.sequence(F.lit(0).cast("long"), F.expr("(tokens - 1) div capacity"))
    cutting = crossed.select("capacity_name", "capacity", "doc_id", "tokens", F.explode(whole).alias("piece"))
    return cutting.select("capacity_name", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), F.expr("least(capacity, tokens - piece * capacity)").cast("int").alias("tokens"))


def pack(documents: DataFrame, capacities: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows of ``PACKED``: the container of every piece of every text, for each capacity.

    A text is split only where it is longer than the capacity, into pieces of the capacity and a rest; full pieces have a
    container each, with a negative number. Null and empty texts and capacities below 1 take no part; repeated rows are
    items of their own. Containers are numbered apart for each capacity.

    Each window is a hash class of items that fills about ``CONTAINERS`` containers, so no task holds more than a window.
    The table of capacities, some rows of settings, becomes a literal.
    """
    sized = cut(with_tokens(spread(documents.select("doc_id", "text")), path=tokenizer))
    every = pieces(sized, capacities)
    small = every.where("tokens < capacity")
    counted = small.groupBy("capacity_name", "capacity").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    windows = {r["capacity_name"]: max(1, math.ceil(r["t"] / (CONTAINERS * r["capacity"])), math.ceil(r["n"] / ITEMS)) for r in counted}
    share = F.lit(1)
    for name, n in windows.items():
        share = F.when(F.col("capacity_name") == name, F.lit(n)).otherwise(share)
    dealt = small.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "piece"), share))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece"], ignore_index=True)
        where = fill(part["tokens"].to_numpy(), int(part["capacity"].iloc[0]))
        return pd.DataFrame({"capacity_name": part["capacity_name"], "container": where + (int(part["dealt"].iloc[0]) << 24), "doc_id": part["doc_id"], "piece": part["piece"], "tokens": part["tokens"]})

    filled = dealt.groupBy("capacity_name", "dealt").applyInPandas(run, PACKED)
    alone = every.where("tokens = capacity").select("capacity_name", (-1 - F.abs(F.shiftright(F.xxhash64("doc_id", "piece"), 1))).alias("container"), "doc_id", "piece", "tokens")
    return filled.unionByName(alone)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_name, capacity, texts, pieces, tokens, containers, unused_share)."""
    names = capacities.select("capacity_name", F.col("tokens").alias("capacity"))
    alone = F.col("container") < 0
    loads = packed.groupBy("capacity_name", F.when(~alone, F.col("container")).alias("container"), F.when(alone, F.col("doc_id")).alias("doc"), F.when(alone, F.col("piece")).alias("part")).agg(
        F.sum("tokens").alias("load"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("piece") == 0).alias("texts")
    )
    total = loads.groupBy("capacity_name").agg(F.sum("texts").alias("texts"), F.sum("n").alias("pieces"), F.sum("load").alias("tokens"), F.count(F.lit(1)).alias("containers"), F.max("load").alias("fullest"))
    joined = total.join(F.broadcast(names), "capacity_name")
    return joined.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
