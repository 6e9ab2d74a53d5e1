"""One ranking from several lists of differently scaled scores.

Within each query every list's values become empirical percentiles with averaged ties, those become
normal quantiles, and items are ordered by the weighted mean of their quantiles, ties by item id.

Defined results: higher values are better; null and NaN are no value; of repeated rows of an item in a
list the best value counts; an item that a list lacks shares the lowest ranks there with all others it
lacks; a list without any value for a query has no say there; rows with a null query or item are left
out; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits of a score: sums that are equal stay so in whatever order they were summed, and others stay apart.
DIGITS = 12
#: Bits of a double's order-preserving form that name its range; ranges are summed before rows are.
RANGE_BITS = 20

# Coefficients of Wichura's algorithm AS241 for the inverse normal distribution, accurate to about 1e-16.
_MIDDLE = (2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987, 13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665)
_MIDDLE_UNDER = (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597, 5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0)
_TAIL = (0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684, 3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835)
_TAIL_UNDER = (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008, 0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0)
_FAR = (2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124, 0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103)
_FAR_UNDER = (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133, 0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    y = F.lit(coefficients[0])
    for c in coefficients[1:]:
        y = y * x + F.lit(c)
    return y


def inverse_normal(p: Column) -> Column:
    """The normal quantile of p in (0, 1), to about 1e-15, as one JVM expression."""
    q = p - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    middle = q * _horner(_MIDDLE, r) / _horner(_MIDDLE_UNDER, r)
    e = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near, far = e - F.lit(1.6), e - F.lit(5.0)
    tail = F.when(e <= 5.0, _horner(_TAIL, near) / _horner(_TAIL_UNDER, near)).otherwise(_horner(_FAR, far) / _horner(_FAR_UNDER, far))
    return F.when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -tail).otherwise(tail))


def _range(v: Column) -> Column:
    """A number that grows with v: the leading bits of the double, as an ordered integer."""
    # sign and floor(log2) stand in for the exponent's bits; the mantissa's leading bits follow.
    size = F.abs(v)
    e = F.when(size == 0, F.lit(-1100.0)).otherwise(F.floor(F.log2(size)))
    m = F.when(size == 0, F.lit(0.0)).otherwise(F.floor((size / F.pow(F.lit(2.0), e) - 1) * (1 << (RANGE_BITS - 12))))
    r = ((e + 1101) * (1 << (RANGE_BITS - 12)) + m).cast("long")
    return F.when(v < 0, -r).otherwise(r)


def fuse(lists: DataFrame, weights: dict[str, float] | None = None, k: int | None = None) -> DataFrame:
    """lists: query, list, item, value. Gives query, item, score, place; the first k of each query.

    Counts of equal values are summed per range of values and then within the range, so no task sorts a
    whole list, and the last step keeps k rows per query and task before it shuffles.
    """
    v = F.col("value").cast("double")
    rows = lists.where("query is not null and item is not null").select("query", "list", "item", F.when(~F.isnan(v), v + F.lit(0.0)).alias("value"))
    rows = rows.groupBy("query", "list", "item").agg(F.max("value").alias("value"))
    items = rows.select("query", "item").distinct()
    size = items.groupBy("query").agg(F.count(F.lit(1)).alias("n"))

    have = rows.where("value is not null and list is not null").withColumn("range", _range(F.col("value")))
    ties = have.groupBy("query", "list", "range", "value").agg(F.count(F.lit(1)).alias("same"))
    below_range = Window.partitionBy("query", "list").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("query", "list")
    ranges = ties.groupBy("query", "list", "range").agg(F.sum("same").alias("in_range"))
    ranges = ranges.select("query", "list", "range", F.coalesce(F.sum("in_range").over(below_range), F.lit(0)).alias("before"), F.sum("in_range").over(whole).alias("present"))
    below = Window.partitionBy("query", "list", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("inside", F.coalesce(F.sum("same").over(below), F.lit(0)))

    weight = F.lit(1.0)
    total: Column | float = F.lit(1.0)
    if weights:
        pairs = F.create_map(*[x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))])
        weight, total = F.coalesce(pairs[F.col("list")], F.lit(0.0)), F.lit(float(sum(weights.values())))
    rank = F.col("n") - F.col("present") + F.col("before") + F.col("inside") + (F.col("same") + 1) / 2
    quantile = inverse_normal((rank - 0.5) / F.col("n"))
    missing = F.col("n") - F.col("present")
    worst = F.when(missing > 0, inverse_normal(missing / (2.0 * F.col("n")))).otherwise(0.0)
    placed = ties.join(ranges, ["query", "list", "range"]).join(size, "query")
    placed = placed.select("query", "list", "range", "value", (weight * (quantile - worst)).alias("gain"))
    floor = ranges.select("query", "list", "present").distinct().join(size, "query").groupBy("query").agg(F.sum(weight * worst).alias("floor"))
    gains = have.join(placed, ["query", "list", "range", "value"]).groupBy("query", "item").agg(F.sum("gain").alias("gain"))
    scored = items.join(gains, ["query", "item"], "left").join(floor, "query", "left")
    score = F.round((F.coalesce("floor", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))) / total, DIGITS)
    scored = scored.select("query", "item", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    ranked = scored.withColumn("place", place)
    return ranked.where(F.col("place") <= k) if k is not None else ranked


def symbol_lists(search_rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The four lists of each query: three profiles of score, and distance turned round."""
    a = search_rows.select(F.col("query_id").alias("query"), F.col("profile").alias("list"), F.col("symbol_id").alias("item"), F.col("score").cast("double").alias("value"))
    b = candidates.select(F.col("query_id").alias("query"), F.lit("Distance").alias("list"), F.col("symbol_id").alias("item"), (-F.col("distance")).cast("double").alias("value"))
    return a.unionByName(b)
