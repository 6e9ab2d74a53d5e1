"""Items of varying size put into containers of fixed capacity with little room left over.

Items over the capacity are cut into full containers and one rest. The others go, in blocks of bounded size,
through bin completion: around the largest item left, fillings no other filling dominates are enumerated and
followed branch and bound, best-fit decreasing giving the first incumbent and the waste so far the bound.
Containers that stay emptier than wanted are taken apart and packed once more across blocks. The search is
bounded by branches, steps and nodes; each of them None leaves it unbounded, and the packing of a block is then
one with the fewest containers.

Defined results: items with a null id or null or non-positive size are left out; repeated rows of an id
count once (its largest size); equal sizes are ordered by id; an item is split only if it is over the
capacity; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_counted, partitions

#: Items of a block, fillings tried around one item, steps of finding them, nodes of a block's search, fill under which a container is packed again.
BLOCK, BRANCHES, STEPS, NODES, FULL = 512, 4, 200, 3_000, 0.98


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices per container."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # room, container, sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        bisect.insort(rooms, (room - sizes[i], b))
    return bins


def fillings(room: int, sizes: list[int], most: int | None, steps: int | None = STEPS) -> list[tuple[int, ...]]:
    """Up to `most` sets of indices into sizes (descending) that fit the room, fullest first, none dominated by another found.

    One filling dominates another if its items are as many and none smaller; only fillings to which no item
    left can be added are taken. After `steps` steps the set at hand is filled up and no other is begun.
    None for most or steps is no bound.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = float("inf") if steps is None else steps

    def add(start: int, left: int, chosen: tuple[int, ...]) -> None:
        nonlocal budget
        grew = False
        last = None
        i = bisect.bisect_left(sizes, -left, lo=start, key=lambda s: -s)  # the first that fits
        while i < len(sizes) and (budget > 0 or not grew):
            if sizes[i] != last:
                last = sizes[i]
                budget -= 1
                grew = True
                add(i + 1, left - last, (*chosen, i))
                if most is not None and found and found[0][0] == 0:
                    return
            i += 1
        if not grew:
            out = len(sizes) - 1  # the smallest item left out
            for c in reversed(chosen):
                if c != out:
                    break
                out -= 1
            if out >= 0 and sizes[out] <= left:
                return
            found.append((left, chosen))
            found.sort()
            if most is not None:
                del found[4 * most :]

    add(0, room, ())
    kept: list[tuple[int, ...]] = []
    for _, f in found:
        if not any(len(g) == len(f) and all(a <= b for a, b in zip(g, f)) for g in kept) or not kept:
            kept.append(f)
        if len(kept) == most:
            break
    return kept


def complete(sizes: list[int], capacity: int, branches: int | None = BRANCHES, nodes: int | None = NODES, steps: int | None = STEPS) -> list[list[int]]:
    """Bin completion: indices per container, as few containers as the search finds, the fewest there are if nothing bounds it."""
    best = best_fit(sizes, capacity)
    lower = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left_nodes = float("inf") if nodes is None else nodes

    def search(rest: list[int], done: list[list[int]], waste: int) -> bool:
        """rest: indices, largest first. True when the bound is met."""
        nonlocal best, left_nodes
        if not rest:
            if len(done) < len(best):
                best = [list(x) for x in done]
            return len(best) <= lower
        # With so much wasted, this branch can't need fewer containers than the incumbent.
        if waste > (len(best) - 1) * capacity - sum_all or left_nodes <= 0:
            return False
        head, tail = rest[0], rest[1:]
        ts = [sizes[i] for i in tail]
        for f in fillings(capacity - sizes[head], ts, branches, steps):
            left_nodes -= 1
            taken = set(f)
            filled = [head, *(tail[j] for j in f)]
            room = capacity - sum(sizes[i] for i in filled)
            if search([x for j, x in enumerate(tail) if j not in taken], [*done, filled], waste + room):
                return True
            if left_nodes <= 0:
                return False
        return False

    sum_all = sum(sizes)
    if len(best) > lower:
        import sys

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(sizes) + 1000))
        search(order, [], 0)
    return best


def _pack(capacity: int, stage: str, **bounds: int | None):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "item", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = complete(block["size"].tolist(), capacity, **bounds)
        name = f"{stage}-{block['block'].iloc[0]}"
        where = [(i, f"{name}-{k}") for k, b in enumerate(bins) for i in b]
        at = pd.Series(dict(where))
        out = block[["item", "piece", "size"]].copy()
        out["container"] = at.reindex(out.index)
        used = out.groupby("container")["size"].transform("sum")
        return out.assign(used=used)[["container", "item", "piece", "size", "used"]]

    return run


def pack(items: DataFrame, capacity: int, block: int = BLOCK, full: float = FULL, *, branches: int | None = BRANCHES, nodes: int | None = NODES, steps: int | None = STEPS) -> DataFrame:
    """items: item, size. Gives container, item, piece, size, used (what the container holds)."""
    types = "container string, item string, piece long, size long, used long"
    rows = items.select(F.col("item").cast("string").alias("item"), F.col("size").cast("long").alias("size")).where("item is not null and size > 0").groupBy("item").agg(F.max("size").alias("size"))
    whole = F.floor(F.col("size") / capacity).cast("long")
    rows, n = cut_counted(rows.withColumn("whole", whole), "items")
    pieces = rows.where("whole > 0").select("item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
    pieces = pieces.select(F.concat_ws("-", F.lit("whole"), "item", "piece").alias("container"), "item", "piece", F.lit(capacity).cast("long").alias("size"), F.lit(capacity).cast("long").alias("used"))
    rest = rows.select("item", F.col("whole").alias("piece"), (F.col("size") - F.col("whole") * capacity).alias("size")).where("size > 0")

    parts, bounds = partitions(items.sparkSession), {"branches": branches, "nodes": nodes, "steps": steps}

    def packed(df: DataFrame, n: int, seed: int, stage: str) -> DataFrame:
        # The work is in Python, not in bytes: partitions by the number of blocks, which are not merged for being small.
        count = max(1, -(-n // block))
        df = df.withColumn("block", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(count))).repartition(max(min(count, 2 * parts), count // 64), "block")
        return df.groupBy("block").applyInPandas(_pack(capacity, stage, **bounds), types)

    first, _ = cut_counted(packed(rest, n, 1, "a"), "packed")
    loose = first.where(F.col("used") < full * capacity).select("item", "piece", "size")
    loose, m = cut_counted(loose, "loose")
    again = packed(loose, m, 2, "b")
    return pieces.unionByName(first.where(F.col("used") >= full * capacity)).unionByName(again)
