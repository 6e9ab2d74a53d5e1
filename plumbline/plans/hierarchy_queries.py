"""Queries over the parent links of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy
from ..runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    x = hierarchy.resolve(table(spark, d, "symbols"), "id", "parent_symbol_id", None, "indexed_at", paths=False)
    return x.select(F.col("node_id").alias("symbol_id"), "root_id", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(table(spark, d, "symbols"), "id", "parent_symbol_id", "name", "indexed_at").withColumnRenamed("node_id", "symbol_id")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    x = hierarchy.resolve(table(spark, d, "symbols"), "id", "parent_symbol_id", None, "indexed_at", paths=False, ancestors=True)
    return hierarchy.descendants(x)


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants)}

_LATEST = """
WITH RECURSIVE last AS (
  SELECT lower(trim(id)) AS key, arg_max(trim(id), indexed_at) AS id, nullif(arg_max(lower(trim(parent_symbol_id)), indexed_at), '') AS parent, arg_max(name, indexed_at) AS name
  FROM (SELECT id, indexed_at, coalesce(parent_symbol_id, '') AS parent_symbol_id, name FROM symbols WHERE trim(id) <> '') GROUP BY 1),
node AS (SELECT l.key, l.id, p.key AS parent, l.name FROM last l LEFT JOIN last p ON l.parent = p.key),
walk AS (
  SELECT key, id, id AS root, 0 AS depth, coalesce(name, id) AS path FROM node WHERE parent IS NULL
  UNION ALL SELECT n.key, n.id, w.root, w.depth + 1, w.path || '/' || coalesce(n.name, n.id) FROM walk w JOIN node n ON n.parent = w.key),
lost AS (SELECT n.key, n.id, n.parent FROM node n ANTI JOIN walk w ON w.key = n.key),
-- UNION drops what is there already, so going round a cycle ends
up AS (SELECT key, parent AS above FROM lost UNION SELECT u.key, l.parent FROM up u JOIN lost l ON l.key = u.above),
cyclic AS (SELECT DISTINCT key FROM up WHERE key = above),
ring AS (SELECT u.key, min(i.id) AS root FROM up u JOIN cyclic c ON c.key = u.above JOIN node i ON i.key = c.key GROUP BY 1)
"""
SQL = {
    # Up from every node, each ancestor once: round a cycle the walk ends where it would come to a node again.
    "p1_descendants": _LATEST.split(",\nwalk AS")[0]
    + """, climb AS (SELECT key, parent AS above, 1 AS distance, [key, parent] AS seen FROM node WHERE parent IS NOT NULL AND parent <> key
  UNION ALL SELECT c.key, n.parent, c.distance + 1, list_append(c.seen, n.parent) FROM climb c JOIN node n ON n.key = c.above WHERE n.parent IS NOT NULL AND NOT list_contains(c.seen, n.parent))
SELECT a.id AS ancestor_id, d.id AS descendant_id, CAST(c.distance AS INTEGER) AS distance FROM climb c JOIN node a ON a.key = c.above JOIN node d ON d.key = c.key""",
    "p1_found": _LATEST
    + "SELECT id AS symbol_id, root AS root_id, CAST(depth AS INTEGER) AS depth FROM walk UNION ALL SELECT l.id, r.root, CAST(CASE WHEN c.key IS NULL THEN -2 ELSE -1 END AS INTEGER) FROM lost l JOIN ring r ON r.key = l.key LEFT JOIN cyclic c ON c.key = l.key",
    "p1_paths": _LATEST
    + "SELECT id AS symbol_id, root AS root_id, CAST(depth AS INTEGER) AS depth, path FROM walk UNION ALL SELECT l.id, r.root, CAST(CASE WHEN c.key IS NULL THEN -2 ELSE -1 END AS INTEGER), NULL FROM lost l JOIN ring r ON r.key = l.key LEFT JOIN cyclic c ON c.key = l.key",
}
