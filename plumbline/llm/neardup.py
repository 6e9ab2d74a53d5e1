"""Near-duplicate texts: many universal hash minima with banding, signature check, exact check, components.

A text is the bag of its words (runs of ASCII letters, digits and underscores, lower case), each occurrence
counted: the n-th occurrence of a word is an element of its own, so the bags' overlap is that of counted
words. Equal bags form a class; only one row per class goes on. ROWS * BANDS minima under universal hashes
give BANDS keys; classes that share a key are candidates, held against each other by a one-bit sketch of all
minima and then by the exact overlap of their bags. Keys that many classes share are split into blocks held
against each other, so that no task meets all of them. Components come from alternating large-star and
small-star rounds over the verified links.

Defined results: rows with a null or blank id or a null text are left out, as are texts under min_chars and
texts without words; repeated rows of an id count once (its greatest text, if they differ); ties at the
threshold are links; very long texts are hashed whole; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..runtime import cut, cut_counted, drop_path, new_path, partitions

#: Minima per key and keys per text: at an overlap of 0.70 a pair is met with 97.7 %, at 0.75 with 99.9 %, at 0.80 with 99.999 %.
ROWS, BANDS = 8, 64
#: Of the sketch's bits (one per minimum) this many must agree: 0.70 gives 435 of 512 on average, deviation 8.
AGREE = 390
#: Members of a key that are paired in one task; keys with more are split into blocks of about as many.
BLOCK = 512
#: Edges of a node beyond which it counts as hot (and an even share of a partition), and what its edges are spread over.
HOT_EDGES, SALTS = 50_000, 16
WORD = re.compile(rb"[a-z0-9_]+")
_MASK = (1 << 64) - 1


def _parameters(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, _MASK, n, dtype=np.uint64, endpoint=True) | np.uint64(1), r.integers(0, _MASK, n, dtype=np.uint64, endpoint=True)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Bags:
    """Elements of texts as 64-bit numbers; words are hashed once per worker while the store is small."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def elements(self, text: str) -> list[int]:
        words, seen, out = WORD.findall(text.encode("utf-8", "replace").lower()), {}, []  # of bytes only ASCII letters have a lower case
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            n = seen.get(w, 0)
            seen[w] = n + 1
            out.append((h + n * 0x9E3779B97F4A7C15) & _MASK)
        return out


def _signatures(rows: int, bands: int, seed: int, block: int = 1 << 19):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _parameters(seed, rows * bands)
        bags = _Bags()
        for batch in batches:
            ids, sets = [], []
            for i, text in zip(batch["id"], batch["text"]):
                e = bags.elements(text)
                if e:
                    ids.append(i)
                    sets.append(np.array(e, dtype=np.uint64))
            out, k = [], 0
            while k < len(sets):  # as many texts at a time as keep the tables small
                j, total = k, 0
                while j < len(sets) and (j == k or total + len(sets[j]) <= block):
                    total += len(sets[j])
                    j += 1
                out.append(_block(ids[k:j], sets[k:j], a, b, rows, bands))
                k = j
            yield pd.concat(out) if out else pd.DataFrame({"id": [], "bag": [], "sketch": [], "keys": []})

    return run


def _block(ids: list[str], sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, rows: int, bands: int) -> pd.DataFrame:
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    mixed = _mix(flat)
    # Two sums of differently mixed elements, with the count: equal bags, whatever their order, and no others.
    one, two = np.add.reduceat(mixed, starts), np.add.reduceat(_mix(flat + np.uint64(0x632BE59BD9B4E019)), starts)
    low = np.empty((len(ids), rows * bands), dtype=np.uint64)
    for i in range(rows * bands):
        low[:, i] = np.minimum.reduceat(a[i] * mixed + b[i], starts)
    keys = np.zeros((len(ids), bands), dtype=np.uint64)
    grouped = low.reshape(len(ids), bands, rows)
    for r in range(rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    keys = _mix(keys + np.arange(bands, dtype=np.uint64))
    bits = (_mix(low) & np.uint64(1)).astype(np.uint8)
    sketch = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).astype(np.uint64) if (rows * bands) % 64 == 0 else np.packbits(np.pad(bits, ((0, 0), (0, -(rows * bands) % 64))), axis=1, bitorder="little").view(np.uint64)
    bag = [f"{x:016x}{y:016x}{len(s):x}" for x, y, s in zip(one.tolist(), two.tolist(), sets)]
    return pd.DataFrame({"id": ids, "bag": bag, "sketch": list(sketch.view(np.int64)), "keys": list(keys.view(np.int64))})


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bags = _Bags()
    for batch in batches:
        yield pd.DataFrame({"bag": batch["bag"], "elements": [np.array(bags.elements(t), dtype=np.uint64).view(np.int64) for t in batch["text"]]})


def texts(df: DataFrame, id_col: str, text_col: str, min_chars: int = 0) -> DataFrame:
    i, t = F.col(id_col).cast("string"), F.col(text_col)
    return df.where(i.isNotNull() & (F.trim(i) != "") & (F.length(t) >= min_chars)).select(i.alias("id"), t.alias("text"))


def links(df: DataFrame, threshold: float = 0.7, *, rows: int = ROWS, bands: int = BANDS, agree: int = AGREE, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """df: id, text. Gives the members (id, bag, class_id: the smallest id of the bag) and the verified links between classes (a, b, overlap; a < b)."""
    signed = df.mapInPandas(_signatures(rows, bands, seed), "id string, bag string, sketch array<long>, keys array<long>")
    spark, at = df.sparkSession, new_path(df.sparkSession, "signatures")
    signed, _ = cut_counted(signed, path=at)
    of_id = signed.groupBy("id").agg(F.max("bag").alias("bag"))
    members = of_id.join(of_id.groupBy("bag").agg(F.min("id").alias("class_id")), "bag").select("id", "bag", "class_id")
    members = cut(members, "members")
    classes = members.where("id = class_id").select("id", "bag")
    one = signed.join(classes, ["id", "bag"], "left_semi").dropDuplicates(["id"])
    # Number the classes with a 64-bit hash: band rows are a key and a number, 16 bytes.
    one = cut(one.select(F.xxhash64("id").alias("n"), "id", "bag", "sketch", "keys"), "classes")
    drop_path(spark, at)  # members and classes hold all that is still needed

    banded = one.select(F.explode("keys").alias("key"), F.col("n").alias("member"))
    met = pairs_within(banded).select(F.col("x").alias("na"), F.col("y").alias("nb")).distinct()
    sketches = one.select("n", "id", "bag", "sketch")
    near = met.join(sketches.select(F.col("n").alias("na"), F.col("id").alias("ia"), F.col("sketch").alias("sa")), "na")
    near = near.join(sketches.select(F.col("n").alias("nb"), F.col("id").alias("ib"), F.col("sketch").alias("sb")), "nb")
    same = F.lit(rows * bands) - F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = cut(near.where(same >= agree).select("ia", "ib"), "near")

    wanted = near.select(F.explode(F.array("ia", "ib")).alias("id")).distinct()
    bags = classes.join(wanted, "id", "left_semi")
    held = df.join(bags, "id").groupBy("id", "bag").agg(F.max("text").alias("text")).select(F.col("id").alias("bag"), "text")
    held = cut(held.mapInPandas(_elements, "bag string, elements array<long>"), "bags")
    both = near.join(held.select(F.col("bag").alias("ia"), F.col("elements").alias("ea")), "ia").join(held.select(F.col("bag").alias("ib"), F.col("elements").alias("eb")), "ib")
    shared = F.size(F.array_intersect("ea", "eb"))
    overlap = shared / (F.size("ea") + F.size("eb") - shared)
    both = both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), overlap.alias("overlap")).where(F.col("overlap") >= threshold)
    return members, cut(both, "links")


def pairs_within(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """df: key, member. All pairs x < y of different members of a key.

    Members are counted per key first and those alone under their key are gone before the join. A key of more than
    `block` members is cut into blocks by hash; each pair of blocks is a join key of its own, and each pair of
    members meets in exactly one.
    """
    many, largest = F.count(F.lit(1)).over(Window.partitionBy("key")), Observation()
    shared = df.withColumn("m", many).where("m > 1").observe(largest, F.max("m").alias("m"))
    shared = cut(shared, "shared")
    few = shared.where(F.col("m") <= block)
    left, right = few.alias("l"), few.alias("r")  # not renamed: both sides read one exchange
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.member") < F.col("r.member"))).select(F.col("l.member").alias("x"), F.col("r.member").alias("y"))
    if (largest.get["m"] or 0) <= block:
        return pairs
    blocks = F.ceil(F.col("m") / block).cast("int")
    hot = shared.where(F.col("m") > block).select("key", "member", blocks.alias("blocks"), F.pmod(F.xxhash64("member", F.lit(3)), blocks).cast("int").alias("at"))
    a = hot.select("key", F.col("member").alias("a"), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"))
    b = hot.select("key", F.col("member").alias("b"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"))
    across = a.join(b, ["key", "i", "j"]).where((F.col("a") < F.col("b")) | ((F.col("i") != F.col("j")) & (F.col("a") != F.col("b"))))
    return pairs.unionByName(across.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")))


def _with_least(edges: DataFrame, n: int, least: DataFrame) -> DataFrame:
    """n edges u, v joined with their u's row of least (u, m, degree); edges of a hot u are spread over salts."""
    limit = max(HOT_EDGES, n // (4 * partitions(edges.sparkSession)))  # at most 8 * partitions nodes can be hot
    hot = [r[0] for r in least.where(F.col("degree") > limit).select("u").collect()] if n > limit else []
    least = least.select("u", "m")
    if not hot:
        return edges.join(least, "u")
    is_hot = F.col("u").isin(hot)
    salted = edges.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    spread = least.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. For each end of an edge: id, root, the smallest id of its component.

    Alternates large-star (neighbours not below a node link to its smallest) and small-star (its neighbours
    below it do) until no edge changes; node degrees fall as edges go to the smallest ids. The root of a large
    component is the end of nearly all its edges: such nodes are joined over salts.
    """
    now, n = cut_counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "v").alias("m"), "degree")
        large = _with_least(both.where("v > u"), n, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = _with_least(large, n, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now, n = cut_counted(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
        if not n:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def groups(df: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """df: id, text. One row per id: id, class_id (its bag's smallest id), group_id (its component's), links (of its class to others)."""
    members, found = links(df, threshold, **how)
    root = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    x = members.join(root.select(F.col("id").alias("class_id"), "root"), "class_id", "left").join(degree, "class_id", "left")
    return x.select("id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def pairs(df: DataFrame, threshold: float = 0.7, **how) -> DataFrame:
    """df: id, text. All pairs of different ids whose bags overlap enough: id_a, id_b (id_a < id_b)."""
    members, found = links(df, threshold, **how)
    ids = members.select("id", "class_id")
    a, b = ids.select(F.col("id").alias("x"), F.col("class_id").alias("a")), ids.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    between = found.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    within = pairs_within(ids.select(F.col("class_id").alias("key"), F.col("id").alias("member")))
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
