"""The most similar vectors for every vector, by learned partitions.

Each model's vectors are one cell at first. A cell over the size of a block is split: on a bounded sample of it the
neighbour graph is cut into balanced parts, and a small softmax classifier learns which part a vector's
neighbours lie in; every vector of the cell moves to the part the classifier finds most probable, and is asked
for in the several most probable ones. Parts still too large are split again in the same way, so that parts keep
their size and the work per vector its amount however many vectors there are. Within a part, queries meet
vectors by matrix products, and the best k of all parts are kept.

Defined results: usable are vectors of the expected length without nulls, NaN or infinities and not all zero;
rows with a null id or model are left out; an id counts once however often its row is repeated (its greatest
row); similarity is the cosine; ties go to the smaller id; a vector alone in its model has no neighbours; an
empty table gives an empty result. Only the named columns are read. With probes=(least, most, 1.0) and most
as large as FAN every part is asked and the result is that of brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Vectors of a cell that its split is fitted on (about as many, by hash), vectors a part should hold, most parts of one split, and splits in a row at most.
SAMPLE, PART, FAN, LEVELS = 12_000, 1_000, 512, 6
#: Parts of a split that a query is sent to: the most probable ones up to this share of probability, this many at least and at most.
PROBES_LEAST, PROBES_MOST, PROBABILITY = 4, 24, 0.99
#: Rows of a cell that is not split; one that can't be (equal vectors) is searched in blocks of as many.
BLOCK = 4_096


def usable(vectors: DataFrame, dims: dict[str, int], default: int) -> DataFrame:
    """id, model, vector (double) of the usable rows, one per id."""
    expected: Column = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in dims.items() for x in kv]), F.col("model")), F.lit(default)) if dims else F.lit(default)
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("id").isNotNull() & F.col("model").isNotNull() & v.isNotNull()).where((F.size(v) == expected) & good)
    return rows.groupBy("id").agg(F.max(F.struct("model", "vector")).alias("r")).select("id", "r.model", "r.vector")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample_graph(x: np.ndarray, k: int = 10, block: int = 1024) -> np.ndarray:
    """For each row the k most similar other rows."""
    k = min(k, len(x) - 1)
    near = np.empty((len(x), k), dtype=np.int32)
    for s in range(0, len(x), block):
        sims = x[s : s + block] @ x.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        near[s : s + block] = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, seed: int = 6, rounds: int = 6, slack: float = 1.1) -> np.ndarray:
    """A part for each row: seeded by balanced centroids, then moved to where most graph neighbours are while there is room."""
    rng = np.random.default_rng(seed)
    n = len(x)
    room = int(np.ceil(n / parts * slack))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int32)
    for _ in range(rounds):
        sims = x @ centres.T
        part = _with_room(sims, room)
        for p in range(parts):
            if (members := part == p).any():
                centres[p] = x[members].mean(0)
        centres = _unit(centres + 1e-12)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):  # label propagation under the size limit
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[near[i]], minlength=parts)
            here, there = part[i], int(votes.argmax())
            if there != here and votes[there] > votes[here] and size[there] < room:
                size[here] -= 1
                size[there] += 1
                part[i] = there
                moved += 1
        if moved < n // 200:
            break
    return part


def _with_room(sims: np.ndarray, room: int) -> np.ndarray:
    """Each row's best column that has room, the surest rows first."""
    parts = sims.shape[1]
    part, size = np.full(len(sims), -1, dtype=np.int32), np.zeros(parts, dtype=np.int64)
    prefer = np.argsort(-sims, axis=1)[:, : min(parts, 32)]
    best = np.take_along_axis(sims, prefer[:, :1], 1)[:, 0]
    for i in np.argsort(-best):
        for p in prefer[i]:
            if size[p] < room:
                break
        else:
            p = int(size.argmin())
        part[i] = p
        size[p] += 1
    return part


def router(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, seed: int = 6, epochs: int = 30, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a softmax over the parts; a row's target is how its neighbours and itself spread over them."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    w, c = np.zeros((d, parts), dtype=np.float32), np.zeros(parts, dtype=np.float32)
    for p in range(parts):  # begins at the parts' means
        if (members := part == p).any():
            w[:, p] = x[members].mean(0) * 8
    gw, gc = np.full_like(w, 1e-8), np.full_like(c, 1e-8)
    all_near = np.concatenate([np.arange(n, dtype=np.int32)[:, None], near], axis=1)
    for _ in range(epochs):
        for s in np.array_split(rng.permutation(n), max(1, n // 512)):
            target = np.zeros((len(s), parts), dtype=np.float32)
            np.add.at(target, (np.repeat(np.arange(len(s)), all_near.shape[1]), part[all_near[s]].ravel()), 1 / all_near.shape[1])
            error = _softmax(x[s] @ w + c) - target
            dw, dc = x[s].T @ error / len(s), error.mean(0)
            gw += dw * dw
            gc += dc * dc
            w -= rate * dw / np.sqrt(gw)
            c -= rate * dc / np.sqrt(gc)
    return w, c


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of float32 kept as bytes."""
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), -1)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors divided by their lengths, as bytes of float32; they may differ in length from model to model."""
    for b in batches:
        if len(b):
            sizes = np.array([len(v) for v in b["vector"]])
            unit = np.empty(len(b), dtype=object)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = _unit(np.stack(b["vector"].iloc[at].to_numpy()).astype(np.float64)).astype(np.float32)
                for i, row in zip(at, x):
                    unit[i] = row.tobytes()
            yield pd.DataFrame({"id": b["id"], "cell": b["model"], "unit": unit})


def _fit(part: int, fan: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        x = _matrix(rows["unit"])
        parts = int(min(fan, max(2, rows["n"].iloc[0] // part), max(2, len(x) // 24)))
        near = sample_graph(x)
        w, c = router(x, near, balanced_parts(x, near, parts, seed), parts, seed)
        return pd.DataFrame({"of": [rows["cell"].iloc[0]], "parts": [parts], "weights": [w.tobytes()], "biases": [c.tobytes()]})

    return run


def _route(least: int, most: int, probability: float):
    def run(key, rows: pd.DataFrame, routers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"id": [], "unit": [], "home": [], "cell": []})
        x, r = _matrix(rows["unit"]), routers.iloc[0]
        w = np.frombuffer(r["weights"], dtype=np.float32).reshape(x.shape[1], r["parts"])
        p = _softmax(x @ w + np.frombuffer(r["biases"], dtype=np.float32))
        order = np.argsort(-p, axis=1)[:, :most]
        reach = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
        take = np.arange(order.shape[1]) < np.clip((reach < probability).sum(1) + 1, least, most)[:, None]
        row = np.repeat(np.arange(len(x)), take.sum(1))
        first = np.zeros_like(take)
        first[:, 0] = True
        names = np.array([f"{r['of']}/{i}" for i in range(r["parts"])], dtype=object)
        return pd.DataFrame({"id": rows["id"].to_numpy()[row], "unit": rows["unit"].to_numpy()[row], "home": rows["home"].to_numpy()[row] & first[take], "cell": names[order[take]]})

    return run


def _search(k: int):
    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"id": [], "near": [], "cosine": []})
        block = block.sort_values("its_id", kind="stable")
        ids, x = block["its_id"].to_numpy(), _matrix(block["its_unit"])
        at = pd.Series(np.arange(len(ids)), index=ids)
        qids, q, out = queries["id"].to_numpy(), _matrix(queries["unit"]), []
        own = at.reindex(qids).to_numpy()
        for s in range(0, len(q), 1024):
            sims = q[s : s + 1024] @ x.T
            here = np.flatnonzero(~np.isnan(own[s : s + 1024]))
            sims[here, own[s : s + 1024][here].astype(np.int64)] = -2
            m = min(k + 1, sims.shape[1])
            top = np.sort(np.argpartition(-sims, m - 1, axis=1)[:, :m], axis=1)
            value = np.take_along_axis(sims, top, 1)
            keep = value > -2
            row = np.repeat(np.arange(len(top)), m).reshape(top.shape)[keep]
            out.append(pd.DataFrame({"id": qids[s : s + 1024][row], "near": ids[top[keep]], "cosine": value[keep].astype(np.float64)}))
        return pd.concat(out)

    return run


def cells(vectors: DataFrame, *, sample: int = SAMPLE, part: int = PART, fan: int = FAN, probes: tuple[int, int, float] = (PROBES_LEAST, PROBES_MOST, PROBABILITY), block: int = BLOCK, levels: int = LEVELS, seed: int = 6) -> DataFrame:
    """vectors: id, model, vector. Every vector in each cell it is asked for: id, unit (bytes), cell, home (whether it is held there)."""
    rows = vectors.select("id", "model", "vector").mapInPandas(_units, "id string, cell string, unit binary").withColumn("home", F.lit(True))
    rows = cut(rows, "cells")
    for level in range(levels):
        sizes = cut(rows.where("home").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "large")
        if sizes.isEmpty():
            break
        large = rows.join(sizes, "cell")
        some = large.where("home").where(F.pmod(F.xxhash64("id", F.lit(seed + level)), F.lit(1_000_000)) < F.lit(1_000_000.0 * sample) / F.col("n"))
        routers = cut(some.select("cell", "n", "id", "unit").groupBy("cell").applyInPandas(_fit(part, fan, seed), "of string, parts int, weights binary, biases binary"), "routers")
        # A cell is routed in slices of about a block, each with a copy of its router.
        slices = F.ceil(F.col("n") / block).cast("int")
        asked = large.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(2)), slices).cast("int")).select("cell", "slice", "id", "unit", "home")
        copies = routers.join(sizes, F.col("of") == F.col("cell")).select("of", "parts", "weights", "biases", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
        moved = asked.groupBy("cell", "slice").cogroup(copies.groupBy("of", "slice")).applyInPandas(_route(*probes), "id string, unit binary, home boolean, cell string")
        rows = cut(rows.join(sizes, "cell", "left_anti").select("id", "unit", "home", "cell").unionByName(moved), "cells")
    return rows


def nearest(vectors: DataFrame, k: int, *, block: int = BLOCK, **how) -> DataFrame:
    """vectors: usable ones (id, model, vector). Gives id, near, cosine, place for the k nearest of each."""
    rows = cells(vectors, block=block, **how)
    sizes = cut(rows.where("home").groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes")  # written: its size is known when the join is planned
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(sizes, "cell").select("cell", "id", "unit", "home", blocks.alias("blocks"))
    # A cell of one block is one group; of more, each block of its vectors meets each slice of its queries.
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    queries = rows.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")).select("cell", "slice", each.alias("block"), "id", "unit")
    targets = rows.where("home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    targets = targets.select(F.col("cell").alias("its_cell"), each.alias("its_slice"), F.col("block").alias("its_block"), F.col("id").alias("its_id"), F.col("unit").alias("its_unit"))
    found = queries.groupBy("cell", "slice", "block").cogroup(targets.groupBy("its_cell", "its_slice", "its_block")).applyInPandas(_search(k), "id string, near string, cosine double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near"))
    best = found.withColumn("place", place).where(F.col("place") <= k)
    return cut(best, "nearest")


def mutual(best: DataFrame, least: float) -> DataFrame:
    """Pairs each of which is among the other's nearest, with at least this cosine: vector_id_a < vector_id_b."""
    pairs = best.where(F.round("cosine", 6) >= least).select(F.least("id", "near").alias("vector_id_a"), F.greatest("id", "near").alias("vector_id_b"))
    return pairs.groupBy("vector_id_a", "vector_id_b").count().where("count = 2").drop("count")
