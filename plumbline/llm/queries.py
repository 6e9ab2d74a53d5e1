"""The queries of the operators in this subpackage, over the tables of a data folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import abuse, doc_pairs, mixing, neardup, neighbours, packing, rank_fusion, source_filter, splitting, tokens

Query = Callable[[SparkSession, str], DataFrame]
#: The four lists have the same say.
LISTS = {"Fast": 1.0, "Hybrid": 1.0, "Semantic": 1.0, "Distance": 1.0}
#: Full lengths of the models' vectors, others have DIMS.
MODEL_DIMS, DIMS = {"pip-mini-96": 96}, 128
#: Least length of contents that are compared, and least overlap of their words.
MIN_CHARS, OVERLAP = 500, 0.70
#: Least cosine of a pair.
COSINE = 0.80


def limit(spark: SparkSession, d: str, name: str) -> int:
    """One of the five amounts of run_limits."""
    return int(table(spark, d, "run_limits").where(F.col("limit_name") == name).agg(F.max("amount")).first()[0])


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.symbol_lists(table(spark, d, "search_rows"), table(spark, d, "similarity_candidates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.fuse(_lists(spark, d), LISTS, limit(spark, d, "ranking_k")).select(F.col("query").alias("query_id"), F.col("item").alias("symbol_id"))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank_fusion.fuse(_lists(spark, d), LISTS).select(F.col("query").alias("query_id"), F.col("item").alias("symbol_id"), (F.round("score", 6) + F.lit(0.0)).alias("score"), "place")  # no -0.0


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return source_filter.not_written(table(spark, d, "files"), table(spark, d, "file_heads"))


def p3_written(spark: SparkSession, d: str) -> DataFrame:
    return source_filter.written(table(spark, d, "files"), table(spark, d, "file_heads"))


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return source_filter.reasons(table(spark, d, "files"), table(spark, d, "file_heads"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs.described(table(spark, d, "code_chunks"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs.pairs(table(spark, d, "code_chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.member_cuts(table(spark, d, "code_chunks"), limit(spark, d, "piece_max_chars"), limit(spark, d, "piece_overlap_lines"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "code_chunks"), limit(spark, d, "piece_max_chars"), limit(spark, d, "piece_overlap_lines"))


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(neighbours.usable(table(spark, d, "chunk_vectors"), MODEL_DIMS, DIMS), limit(spark, d, "neighbours_k"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mutual(_nearest(spark, d), COSINE)


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select(F.col("id").alias("vector_id"), F.col("near").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "place")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return neardup.texts(table(spark, d, "code_chunks"), "id", "content", MIN_CHARS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs(_texts(spark, d), OVERLAP).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_texts(spark, d), OVERLAP).withColumnRenamed("id", "chunk_id")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_tokens(table(spark, d, "documents"), "text", ["doc_id"]).select(F.col("doc_id").alias("item"), F.col("tokens").alias("size"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(_sizes(spark, d), limit(spark, d, "pack_capacity_tokens"))
    return packed.select(F.col("container").alias("container_id"), F.col("item").cast("long").alias("doc_id"), "piece", F.col("size").alias("tokens"), F.col("used").alias("used_tokens"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    capacity = limit(spark, d, "pack_capacity_tokens")
    one = packing.pack(_sizes(spark, d), capacity).groupBy("container").agg(F.max("used").alias("used"))
    sums = one.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return sums.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / (F.col("containers") * capacity)).alias("filled"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p2_found, p2_ranking, p3_found, p3_written, p3_reasons, p4_found, p4_pairs, p5_found, p5_pieces, p6_found, p6_neighbours, p7_found, p7_groups, p8_containers, p8_fill, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)
}


def _inverse_normal_sql(p: str) -> str:
    """The same approximation of the normal quantile in SQL."""

    def horner(c: tuple[float, ...], x: str) -> str:
        y = f"({c[0]!r})"
        for v in c[1:]:
            y = f"({y} * {x} + ({v!r}))"
        return y

    r = rank_fusion
    q, e = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1.0e0 - {p})))"
    m, near, far = f"(0.180625e0 - {q} * {q})", f"({e} - 1.6e0)", f"({e} - 5.0e0)"
    middle = f"({q} * {horner(r._MIDDLE, m)} / {horner(r._MIDDLE_UNDER, m)})"
    tail = f"(CASE WHEN {e} <= 5.0e0 THEN {horner(r._TAIL, near)} / {horner(r._TAIL_UNDER, near)} ELSE {horner(r._FAR, far)} / {horner(r._FAR_UNDER, far)} END)"
    return f"(CASE WHEN abs({q}) <= 0.425e0 THEN {middle} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


_RANKED = f"""
WITH l AS (
  SELECT query_id, profile AS list, symbol_id, CASE WHEN isnan(score) THEN NULL ELSE CAST(score AS DOUBLE) END AS v FROM search_rows
  UNION ALL SELECT query_id, 'Distance', symbol_id, CAST(-distance AS DOUBLE) FROM similarity_candidates),
one AS (SELECT query_id, list, symbol_id, max(v) AS v FROM l WHERE query_id IS NOT NULL AND symbol_id IS NOT NULL GROUP BY ALL),
items AS (SELECT DISTINCT query_id, symbol_id FROM one),
lists AS (SELECT unnest(['Fast', 'Hybrid', 'Semantic', 'Distance']) AS list),
full_lists AS (SELECT i.query_id, i.symbol_id, n.list, o.v FROM items i CROSS JOIN lists n LEFT JOIN one o ON o.query_id = i.query_id AND o.symbol_id = i.symbol_id AND o.list = n.list),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY query_id, list) AS n,
    rank() OVER (PARTITION BY query_id, list ORDER BY v ASC NULLS FIRST) AS lowest,
    count(*) OVER (PARTITION BY query_id, list, v) AS same
  FROM full_lists),
p AS (SELECT query_id, symbol_id, (lowest + (same - 1) / 2.0e0 - 0.5e0) / n AS p FROM ranked),
scored AS (SELECT query_id, symbol_id, round(avg({_inverse_normal_sql('p')}), {rank_fusion.DIGITS}) AS score FROM p GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS place FROM scored)
"""

# Overlap of counted words, by joining the n-th occurrences of words: what is compared with minima elsewhere.
_OVERLAPS = f"""
WITH RECURSIVE t AS (SELECT id, max(content) AS content FROM code_chunks WHERE trim(id) <> '' AND length(content) >= {MIN_CHARS} GROUP BY 1),
w AS (SELECT id, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM t), e AS (SELECT id, lower(x) AS x, row_number() OVER (PARTITION BY id, lower(x)) AS n FROM (SELECT id, unnest(w) AS x FROM w)),
size AS (SELECT id, count(*) AS size FROM e GROUP BY 1), rare AS (SELECT x, n, row_number() OVER (ORDER BY count(*), x, n) AS pos FROM e GROUP BY 1, 2),
f AS (SELECT e.id, r.pos, row_number() OVER (PARTITION BY e.id ORDER BY r.pos) AS k, s.size FROM e JOIN rare r USING (x, n) JOIN size s USING (id)),
-- two bags that overlap enough share one of the first, rarest elements of each
head AS (SELECT id, pos, size FROM f WHERE k <= size - ceil({OVERLAP} * size) + 1),
met AS (SELECT DISTINCT a.id AS a, b.id AS b FROM head a JOIN head b ON a.pos = b.pos AND a.id < b.id AND least(a.size, b.size) >= {OVERLAP} * greatest(a.size, b.size)),
pairs AS (SELECT m.a, m.b FROM met m JOIN f x ON x.id = m.a JOIN f y ON y.id = m.b AND y.pos = x.pos GROUP BY m.a, m.b, x.size, y.size HAVING count(*) >= {OVERLAP} * (x.size + y.size - count(*)))
"""

SQL: dict[str, str] = {
    "p2_ranking": _RANKED + "SELECT query_id, symbol_id, round(score, 6) + 0.0e0 AS score, CAST(place AS INTEGER) AS place FROM placed",
    "p6_found": f"""
WITH v AS (SELECT id, max(struct_pack(model := model, vector := vector)) AS v FROM chunk_vectors WHERE id IS NOT NULL AND model IS NOT NULL AND len(vector) = CASE model {' '.join(f"WHEN '{m}' THEN {n}" for m, n in MODEL_DIMS.items())} ELSE {DIMS} END
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1),
n AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(CAST(a.v.vector AS DOUBLE[]), CAST(b.v.vector AS DOUBLE[])) AS c FROM v a JOIN v b ON a.v.model = b.v.model AND a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM n),
best AS (SELECT a, b FROM k WHERE place <= (SELECT max(amount) FROM run_limits WHERE limit_name = 'neighbours_k') AND round(c, 6) >= {COSINE})
SELECT a AS vector_id_a, b AS vector_id_b FROM best x WHERE a < b AND EXISTS (SELECT 1 FROM best y WHERE y.a = x.b AND y.b = x.a)""",
    "p7_found": _OVERLAPS + "SELECT a AS chunk_id_a, b AS chunk_id_b FROM pairs",
    "p7_groups": _OVERLAPS
    + """, bag AS (SELECT id, list(pos ORDER BY pos) AS bag FROM f GROUP BY 1), class AS (SELECT b.id, min(b2.id) AS class_id FROM bag b JOIN bag b2 ON b.bag = b2.bag GROUP BY 1),
links AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM pairs p JOIN class x ON x.id = p.a JOIN class y ON y.id = p.b WHERE x.class_id <> y.class_id), two AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT class_id AS id, class_id AS pos FROM class UNION SELECT r.id, b.b FROM reach r JOIN two b ON b.a = r.pos), root AS (SELECT id, min(pos) AS root FROM reach GROUP BY 1)
SELECT c.id AS chunk_id, c.class_id, r.root AS group_id, (SELECT count(*) FROM two b WHERE b.a = c.class_id) AS links FROM class c JOIN root r ON r.id = c.class_id""",
    "p2_found": _RANKED + "SELECT query_id, symbol_id FROM placed WHERE place <= (SELECT max(amount) FROM run_limits WHERE limit_name = 'ranking_k')",
}
