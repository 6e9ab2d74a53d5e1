"""64-bit SimHash sketches: hash, votes, bands, distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

# FNV-1a with 64 bits.
OFFSET, PRIME = 14695981039346656037, 1099511628211
def fnv_all(tokens: list[str]) -> np.ndarray:
    """FNV-1a of many texts at once, as unsigned numbers: one step per character position over all texts that have one."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in tokens]
    sizes = np.array([len(r) // 2 for r in raw], dtype=np.int64)
    units = np.frombuffer(b"".join(raw), dtype="<u2").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    out = np.full(len(tokens), OFFSET, dtype=np.uint64)
    order = np.argsort(-sizes, kind="stable")  # the longest first: those with a next character are a prefix
    longest = int(sizes.max()) if len(sizes) else 0
    has = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
    for i in range(longest):
        at = order[: has[i]]
        out[at] = (out[at] ^ units[starts[at] + i]) * np.uint64(PRIME)
    return out


@F.pandas_udf(LongType())
def fnv1a64(tokens: pd.Series) -> pd.Series:
    """FNV-1a of each text, as a signed number."""
    out = pd.Series(fnv_all([t or "" for t in tokens]).view(np.int64), index=tokens.index).astype("Int64")
    return out.mask(tokens.isna())


#: Tokens whose bits are summed at a time.
_VOTES_AT_ONCE = 1 << 18


def simhash_all(bags: list[np.ndarray | None]) -> np.ndarray:
    """SimHash of many bags of tokens: distinct tokens are hashed once, votes are sums over runs of the flattened bags."""
    sizes = np.array([0 if b is None else len(b) for b in bags], dtype=np.int64)
    out = np.zeros(len(bags), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    index, distinct = pd.factorize(np.concatenate([bags[i] for i in full]))
    bits = ((fnv_all(list(distinct))[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ends = np.cumsum(sizes[full])
    power = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i = 0
    while i < len(full):
        begin = ends[i] - sizes[full[i]]
        j = max(i + 1, int(np.searchsorted(ends, begin + _VOTES_AT_ONCE, side="right")))
        votes = np.add.reduceat(bits[index[begin : ends[j - 1]]], ends[i:j] - sizes[full[i:j]] - begin, axis=0, dtype=np.int64)
        out[full[i:j]] = ((2 * votes > sizes[full[i:j], None]) * power).sum(1, dtype=np.uint64).view(np.int64)
        i = j
    return out


@F.pandas_udf(LongType())
def simhash(tokens: pd.Series) -> pd.Series:
    """Of each array of tokens: bit i is set if more of the tokens' hashes have it than not; 0 for none."""
    return pd.Series(simhash_all(tokens.tolist()), index=tokens.index)


def bands(fp: Column) -> Column:
    """Four 16-bit slices, low to high."""
    return F.array(*[F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int") for i in range(4)])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    return 1 - distance / F.lit(64.0)


#: Rows of one side that a scope and band value may bring to one task; beyond it they are spread.
BAND_BLOCK = 4_096


def band_candidates(seeds: DataFrame, prints: DataFrame, scope: list[str], block: int = BAND_BLOCK) -> DataFrame:
    """Pairs of seed and other row that share a band in the same place within the scope: seed_id, symbol_id, distance.

    Both frames: symbol_id, the scope's columns, fingerprint, band0 to band3. An equi-join on exploded bands. A
    scope and band value that more rows than a block share is split: each of its seeds meets every block of the others.
    """
    explode = lambda df, p: df.select(F.col("symbol_id").alias(f"{p}_id"), F.col("fingerprint").alias(f"{p}_fp"), *scope, F.posexplode(F.array("band0", "band1", "band2", "band3")).alias("at", "band"))
    on = [*scope, "at", "band"]
    others = explode(prints, "other")
    large = others.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(*on, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    left = explode(seeds, "seed").join(large, on, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = others.join(large, on, "left").withColumn("block", F.pmod(F.xxhash64("other_id"), blocks).cast("int"))
    met = left.drop("blocks").join(right.drop("blocks"), [*on, "block"]).where("seed_id <> other_id")
    return met.select("seed_id", F.col("other_id").alias("symbol_id"), hamming(F.col("seed_fp"), F.col("other_fp")).alias("distance")).distinct()


LONGS = ArrayType(LongType())
