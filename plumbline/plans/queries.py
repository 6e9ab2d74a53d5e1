"""Queries of the engine's operators over the tables of a data folder, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sketch, vector
from ..functions import text as T
from ..operators import graph, indexing, jobs, search, stats
from ..operators import relational as R
from ..runtime import cut, new_path, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- shared pieces -----------------------------------------------------------------------------------------

_EDGES = """edges AS (
  SELECT DISTINCT CAST(a.l_partkey AS VARCHAR) AS source_id, CAST(b.l_partkey AS VARCHAR) AS target_id,
    CASE a.l_returnflag WHEN 'R' THEN 'Calls' WHEN 'A' THEN 'References' ELSE 'Implements' END AS kind,
    CAST(a.l_suppkey AS VARCHAR) AS repo_id, a.l_orderkey * 10 + a.l_linenumber AS line
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between parts, stored once: consecutive lines of an order."""
    return stored(spark, f"edges of {d}", lambda: _edges(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to"))
    kind = F.when(F.col("l_returnflag") == "R", "Calls").when(F.col("l_returnflag") == "A", "References").otherwise("Implements")
    x = a.join(b, ["l_orderkey", "l_linenumber"])
    return x.select(F.col("l_partkey").cast("string").alias("source_id"), F.col("to").cast("string").alias("target_id"), kind.alias("kind"), F.col("l_suppkey").cast("string").alias("repo_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")).distinct()


_PARTS = "parts AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS file_path FROM part)"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"))


def _tok(c: str) -> str:
    """The tokens of a text in SQL: acronyms are set apart first, as its patterns can't look ahead."""
    apart = f"regexp_replace(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9]+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(regexp_extract_all({apart}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda t: lower(t)), lambda t: length(t) >= 2)"


def _once(c: str) -> str:
    """A list without repeats, in order of first occurrence."""
    return f"list_filter({c}, lambda t, i: list_position({c}, t) = i)"


def _words(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _text(c: Column | str) -> Column:
    """An array as one text, so results compare by value."""
    return F.array_join(c, " ")


_KEYWORDS = ",".join(f"'{w}'" for w in T.CSHARP_KEYWORDS)


def _identifiers(c: str) -> str:
    """The parts of a text's identifiers in SQL: of its first characters, without keywords and numbers, up to a number of them."""
    words = f"list_filter(regexp_extract_all(substring(coalesce({c}, ''), 1, 4000), '[A-Za-z_][A-Za-z0-9_]*'), lambda w: lower(w) NOT IN ({_KEYWORDS}))"
    parts = f"flatten(list_transform({words}, lambda w: {_once(_tok('w'))}))"
    return f"list_slice(list_filter({parts}, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_KEYWORDS})), 1, 256)"


def _simhash_sql(key: str, bags: str) -> str:
    """SimHash in SQL: bags is a query of the key and a list of tokens tk; hashes by folding characters in 128 bits."""
    fold = f"list_reduce(list_prepend({sketch.OFFSET}::HUGEINT, list_transform(string_split(token, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (xor(h, c) * {sketch.PRIME}::HUGEINT) % 18446744073709551616::HUGEINT)"
    signed = "CAST(CASE WHEN f >= 9223372036854775808::HUGEINT THEN f - 18446744073709551616::HUGEINT ELSE f END AS BIGINT)"
    return f"""bags AS ({bags}), tok AS (SELECT {key}, unnest(tk) AS token FROM bags), hashed AS (SELECT token, {fold} AS h FROM (SELECT DISTINCT token FROM tok)),
bits AS (SELECT {key}, b, sum(CASE WHEN (h >> b::INTEGER) & 1::HUGEINT = 1 THEN 1 ELSE -1 END) AS v FROM tok JOIN hashed USING (token), (SELECT unnest(range(64)) AS b) GROUP BY ALL),
prints AS (SELECT {key}, sum(CASE WHEN v > 0 THEN 1::HUGEINT << b::INTEGER ELSE 0::HUGEINT END) AS f FROM bits GROUP BY 1),
signed AS (SELECT g.{key}, coalesce({signed}, 0) AS fingerprint FROM (SELECT DISTINCT {key} FROM bags) g LEFT JOIN prints p ON p.{key} IS NOT DISTINCT FROM g.{key})"""


# -- scans, filters, projections ------------------------------------------------------------------------------


@query("SELECT DISTINCT id, name, kind FROM symbols WHERE id = (SELECT min(id) FROM symbols)")
def point_lookup(spark, d):
    s = table(spark, d, "symbols")
    first = s.agg(F.min("id")).first()[0]
    return R.where_given(s, id=first).select("id", "name", "kind").distinct()


@query("SELECT DISTINCT id, file_path FROM files WHERE id IN (SELECT file_id FROM file_heads WHERE head LIKE 'using %')")
def multi_id_lookup(spark, d):
    wanted = table(spark, d, "file_heads").where(F.col("head").startswith("using ")).select(F.col("file_id").alias("id"))
    return table(spark, d, "files").join(wanted, "id", "left_semi").select("id", "file_path").distinct()


@query("SELECT id, file_path, start_line, start_column FROM symbols WHERE kind = 'Method' AND branch_name = 'main' ORDER BY file_path, start_line")
def scoped_scan(spark, d):
    return R.scan(table(spark, d, "symbols"), ["file_path", "start_line"], kind="Method", branch_name="main").select("id", "file_path", "start_line", "start_column")


@query("SELECT id, language FROM files WHERE language = 'Rust'")
def optional_filter(spark, d):
    return R.where_given(table(spark, d, "files"), language="Rust", branch_name=None).select("id", "language")


@query("SELECT id, name FROM symbols WHERE name ILIKE 'settle%' OR qualified_name ILIKE 'settle%'")
def prefix_ilike(spark, d):
    return R.prefix(table(spark, d, "symbols"), "settle", "name", "qualified_name").select("id", "name")


@query("SELECT s.id, s.name FROM symbols s WHERE lower(s.name) IN (SELECT lower(name) FROM symbols WHERE kind = 'Namespace')")
def ci_equality(spark, d):
    s = table(spark, d, "symbols")
    keys = s.where("kind = 'Namespace' and name is not null").select(F.lower("name").alias("k")).distinct()
    return s.withColumn("k", F.lower("name")).join(keys, "k", "left_semi").select("id", "name")


@query("SELECT DISTINCT c.id, s.id AS symbol_id FROM code_chunks c JOIN symbols s ON lower(trim(split_part(s.qualified_name, '(', 1))) = lower(trim(split_part(c.symbol_name, '(', 1)))")
def base_name_join(spark, d):
    """Equality of names without their arguments, as one equi-join."""
    c = table(spark, d, "code_chunks").select("id", T.normalize_qualified("symbol_name").alias("b"))
    s = table(spark, d, "symbols").select(F.col("id").alias("symbol_id"), T.normalize_qualified("qualified_name").alias("b"))
    return c.join(s, "b").select("id", "symbol_id").distinct()


@query("SELECT EXISTS (SELECT 1 FROM chunk_vectors WHERE model = 'pip-mini-96') AS present")
def exists_check(spark, d):
    return table(spark, d, "chunk_vectors").where("model = 'pip-mini-96'").limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))


@query("SELECT id, file_path FROM files WHERE language NOT IN ('Unknown','Markdown','JSON','YAML','TOML','XML','HTML','CSS','SCSS','LESS') AND size_bytes <= 1500000")
def indexable_files(spark, d):
    return table(spark, d, "files").where(T.is_indexed_language("language") & (F.col("size_bytes") <= indexing.FILE_CHARS)).select("id", "file_path")


@query("SELECT id, symbol_kind FROM code_chunks WHERE symbol_kind IN ('Class','Interface','Struct','Enum','Method','Function','Constructor','Property')")
def chunked_kinds(spark, d):
    return table(spark, d, "code_chunks").where(F.col("symbol_kind").isin(*T.CHUNKED_KINDS)).select("id", "symbol_kind")


@query("SELECT id FROM code_chunks WHERE contains(lower(concat_ws(' ', symbol_name, signature, documentation, content)), 'ledger') AND contains(lower(concat_ws(' ', symbol_name, signature, documentation, content)), 'async')")
def all_terms_filter(spark, d):
    terms = F.array(F.lit("Ledger"), F.lit(" "), F.lit("async"))
    return table(spark, d, "code_chunks").where(T.all_terms_in(terms, "symbol_name", "signature", "documentation", "content")).select("id")


@query("SELECT id, coalesce(documentation, signature, concat_ws(' ', symbol_kind, symbol_name)) AS shown FROM code_chunks")
def fallback_content(spark, d):
    return table(spark, d, "code_chunks").select("id", T.fallback_content(F.col("documentation"), F.col("signature"), F.col("symbol_kind"), F.col("symbol_name")).alias("shown"))


@query("SELECT id, name FROM symbols WHERE qualified_name ILIKE '%merger%' AND kind IN ('Class', 'Struct') AND parent_symbol_id IS NOT NULL")
def substring_filter(spark, d):
    return table(spark, d, "symbols").where(F.col("qualified_name").ilike("%merger%") & F.col("kind").isin("Class", "Struct") & F.col("parent_symbol_id").isNotNull()).select("id", "name")


# -- joins ---------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT v.id, c.file_path FROM chunk_vectors v JOIN code_chunks c ON v.chunk_id = c.id WHERE c.language = 'Go'")
def inner_join_filtered(spark, d):
    c = table(spark, d, "code_chunks").where("language = 'Go'").select(F.col("id").alias("chunk_id"), "file_path")
    return table(spark, d, "chunk_vectors").select("id", "chunk_id").join(c, "chunk_id").select("id", "file_path").distinct()


@query(
    """WITH a AS (SELECT query_id, symbol_id, max(CAST(score AS DOUBLE)) AS s FROM search_rows WHERE profile = 'Fast' AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
b AS (SELECT query_id, symbol_id, max(CAST(score AS DOUBLE)) AS s FROM search_rows WHERE profile = 'Semantic' AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.symbol_id, b.symbol_id) AS symbol_id, round(0.3e0 * coalesce(a.s, 0) + 0.7e0 * coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.symbol_id = b.symbol_id"""
)
def full_outer_fusion(spark, d):
    s = table(spark, d, "search_rows").where("score is not null and not isnan(score)")
    side = lambda p, name: s.where(F.col("profile") == p).groupBy(F.struct("query_id", "symbol_id").alias("k")).agg(F.max(F.col("score").cast("double")).alias(name))
    return R.full_outer_scores(side("Fast", "bm25_score"), side("Semantic", "vector_score"), "k", 0.3, 0.7).select("k.*", F.round("score", 6).alias("score"))


@query("SELECT DISTINCT f.id, s.id AS symbol_id FROM files f LEFT JOIN symbols s ON f.repo_id = s.repo_id AND f.branch_name = s.branch_name AND f.file_path = s.file_path")
def composite_left_join(spark, d):
    keys = ["repo_id", "branch_name", "file_path"]
    return table(spark, d, "files").select("id", *keys).join(table(spark, d, "symbols").select(F.col("id").alias("symbol_id"), *keys), keys, "left").select("id", "symbol_id").distinct()


@query("WITH s AS (SELECT id, max(name) AS name FROM symbols GROUP BY 1) SELECT c.query_id, c.symbol_id, s.name, c.distance FROM (SELECT DISTINCT query_id, symbol_id, distance FROM similarity_candidates) c JOIN s ON c.symbol_id = s.id")
def lookup_join(spark, d):
    c = table(spark, d, "similarity_candidates").select("query_id", "symbol_id", "distance").distinct()
    s = table(spark, d, "symbols").groupBy(F.col("id").alias("symbol_id")).agg(F.max("name").alias("name"))
    return R.lookup_in_order(c, s, "symbol_id", "distance").select("query_id", "symbol_id", "name", "distance")


@query("SELECT DISTINCT symbol_id FROM search_rows WHERE profile = 'Hybrid' AND symbol_id NOT IN (SELECT symbol_id FROM similarity_candidates)")
def anti_context(spark, d):
    return table(spark, d, "search_rows").where("profile = 'Hybrid'").select("symbol_id").distinct().join(table(spark, d, "similarity_candidates").select("symbol_id"), "symbol_id", "left_anti")


@query("SELECT id, symbol_id FROM code_chunks WHERE symbol_id IS NULL OR symbol_id NOT IN (SELECT id FROM symbols WHERE kind = 'Property')")
def cascade_delete(spark, d):
    s = table(spark, d, "symbols")
    gone = s.where("kind = 'Property'").select("id").distinct()
    return R.cascade_delete(s, gone, "id", {"chunks": (table(spark, d, "code_chunks"), "symbol_id")})["chunks"].select("id", "symbol_id")


@query("SELECT id, CASE WHEN parent_symbol_id IN (SELECT id FROM symbols WHERE kind = 'Package') THEN NULL ELSE parent_symbol_id END AS parent_symbol_id FROM symbols")
def set_null_delete(spark, d):
    s = table(spark, d, "symbols")
    return R.set_null_where_deleted(s, s.where("kind = 'Package'"), "id", "parent_symbol_id").select("id", "parent_symbol_id")


@query("SELECT DISTINCT id, symbol_name FROM code_chunks WHERE id IN (SELECT chunk_id FROM chunk_vectors WHERE vector IS NOT NULL)")
def chunks_with_vector(spark, d):
    return table(spark, d, "code_chunks").join(table(spark, d, "chunk_vectors").where("vector is not null").select(F.col("chunk_id").alias("id")), "id", "left_semi").select("id", "symbol_name").distinct()


@query(
    """SELECT f.repo_id, count(DISTINCT s.id) AS symbols, count(DISTINCT f.id) AS files FROM files f LEFT JOIN symbols s ON s.repo_id = f.repo_id AND s.file_path = f.file_path GROUP BY 1"""
)
def fixture_stats(spark, d):
    f, s = table(spark, d, "files"), table(spark, d, "symbols")
    inside = s.join(f.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi").groupBy("repo_id").agg(F.countDistinct("id").alias("symbols"))
    return f.groupBy("repo_id").agg(F.countDistinct("id").alias("files")).join(inside, "repo_id", "left").select("repo_id", F.coalesce("symbols", F.lit(0)).alias("symbols"), "files")


# -- statistics ----------------------------------------------------------------------------------------------

_FILE_SUMS = "SELECT repo_id, count(DISTINCT id) AS file_count, CAST(sum(size_bytes) AS DOUBLE) AS total_size_bytes, CAST(sum(line_count) AS DOUBLE) AS total_lines, max(indexed_at) AS last_indexed_at FROM files GROUP BY 1"
_REPO_STATS = f"""WITH f AS ({_FILE_SUMS}),
s AS (SELECT repo_id, count(DISTINCT id) AS n, count(*) AS r FROM symbols GROUP BY 1), c AS (SELECT repo_id, count(DISTINCT id) AS n, count(*) AS r FROM code_chunks GROUP BY 1), v AS (SELECT repo_id, count(DISTINCT id) AS n, count(*) AS r FROM chunk_vectors GROUP BY 1)
SELECT r.id AS repo_id, r.name, coalesce(b.n, 0) AS branch_count, coalesce(f.file_count, 0) AS file_count, coalesce(s.n, 0) AS symbol_count, coalesce(c.n, 0) AS chunk_count, coalesce(v.n, 0) AS embedding_count, f.total_size_bytes * {{times}} AS total_size_bytes, f.total_lines * {{times}} AS total_lines, f.last_indexed_at
FROM repos r LEFT JOIN f ON f.repo_id = r.id LEFT JOIN s ON s.repo_id = r.id LEFT JOIN c ON c.repo_id = r.id LEFT JOIN v ON v.repo_id = r.id LEFT JOIN (SELECT repo_id, count(DISTINCT branch_name) AS n FROM files GROUP BY 1) b ON b.repo_id = r.id"""


def _repo_stats(spark, d, faithful):
    return stats.repo_stats(table(spark, d, "repos"), table(spark, d, "files"), table(spark, d, "symbols"), table(spark, d, "code_chunks"), table(spark, d, "chunk_vectors"), faithful)


@query(_REPO_STATS.format(times="1"))
def repo_stats(spark, d):
    return _repo_stats(spark, d, False)


@query(_REPO_STATS.format(times="(greatest(coalesce(b.n, 1), 1) * greatest(coalesce(s.r, 1), 1) * greatest(coalesce(c.r, 1), 1) * greatest(coalesce(v.r, 1), 1))"))
def repo_stats_fan_out(spark, d):
    """Sums multiplied as by a join of all tables before they were summed."""
    return _repo_stats(spark, d, True)


_COUNT = "(SELECT repo_id, branch_name, count(DISTINCT id) AS n FROM {t} GROUP BY ALL) {a} ON {a}.repo_id = f.repo_id AND {a}.branch_name = f.branch_name"
_STATES = "SELECT repo_id, branch_name, max((indexed_at, commit_sha)) AS h, max(CASE WHEN language = 'CSharp' THEN (indexed_at, commit_sha) END) AS i FROM files GROUP BY 1, 2"


@query(
    f"""WITH h AS ({_STATES}) SELECT f.repo_id, f.branch_name, arg_max(f.commit_sha, (f.indexed_at, f.commit_sha)) AS head_commit_sha, max(f.indexed_at) AS last_indexed_at, count(DISTINCT f.id) AS file_count, CAST(sum(f.size_bytes) AS BIGINT) AS total_size_bytes, CAST(sum(f.line_count) AS BIGINT) AS total_lines,
coalesce(max(s.n), 0) AS symbol_count, coalesce(max(c.n), 0) AS chunk_count, coalesce(max(v.n), 0) AS embedding_count, max(CASE WHEN h.i IS NULL THEN 'Pending' WHEN h.i[2] = h.h[2] THEN 'Completed' ELSE 'Stale' END) AS index_state, max(h.i[2]) AS indexed_commit_sha
FROM files f LEFT JOIN h ON h.repo_id = f.repo_id AND h.branch_name = f.branch_name LEFT JOIN {_COUNT.format(t='symbols', a='s')} LEFT JOIN {_COUNT.format(t='code_chunks', a='c')} LEFT JOIN {_COUNT.format(t='chunk_vectors', a='v')} GROUP BY 1, 2"""
)
def branch_stats(spark, d):
    f = table(spark, d, "files")
    return stats.branch_stats(f, table(spark, d, "symbols"), table(spark, d, "code_chunks"), table(spark, d, "chunk_vectors"), jobs.branch_states(_indexed(f)))


def _indexed(files):
    """A branch counts as indexed up to its newest C# file."""
    return files.select("repo_id", "branch_name", F.col("indexed_at").alias("at"), F.col("commit_sha").alias("head"), F.coalesce(F.col("language") == "CSharp", F.lit(False)).alias("indexed"))


@query(
    """WITH f AS (SELECT repo_id, language, count(DISTINCT id) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, CAST(sum(line_count) AS BIGINT) AS total_lines FROM files WHERE language IS NOT NULL GROUP BY ALL),
n AS (SELECT p.repo_id, p.language, count(DISTINCT s.id) AS symbol_count FROM (SELECT DISTINCT repo_id, file_path, language FROM files) p JOIN symbols s ON s.repo_id = p.repo_id AND s.file_path = p.file_path GROUP BY ALL)
SELECT f.*, coalesce(n.symbol_count, 0) AS symbol_count FROM f LEFT JOIN n ON n.repo_id = f.repo_id AND n.language = f.language"""
)
def language_stats(spark, d):
    return stats.language_stats(table(spark, d, "files").where("language is not null"), table(spark, d, "symbols"))


@query("SELECT repo_id, kind, count(DISTINCT id) AS symbol_count, count(DISTINCT file_path) AS file_count FROM symbols GROUP BY 1, 2")
def refreshed_stats(spark, d):
    """Statistics written anew, one by name and then all, and read from their snapshots."""
    into = new_path(spark, "stats")
    views = {"symbol_kinds": lambda: stats.symbol_kind_stats(table(spark, d, "symbols")), "languages": lambda: table(spark, d, "files").groupBy("language").agg(F.countDistinct("id").alias("files"))}
    stats.refresh(spark, into, views, "symbol_kinds")
    stats.refresh(spark, into, views)
    return stats.snapshot(spark, into, "symbol_kinds")


@query("SELECT repo_id, kind, count(DISTINCT id) AS symbol_count, count(DISTINCT file_path) AS file_count FROM symbols GROUP BY 1, 2")
def symbol_kind_stats(spark, d):
    return stats.symbol_kind_stats(table(spark, d, "symbols"))


@query(f"WITH {_EDGES} SELECT repo_id, kind, count(*) AS edge_count FROM edges GROUP BY 1, 2")
def edge_kind_stats(spark, d):
    return stats.edge_kind_stats(edges(spark, d))


@query(f"WITH {_EDGES} SELECT target_id, count(*) AS reference_count, count(DISTINCT CASE WHEN kind = 'Calls' THEN source_id END) AS call_count, count(DISTINCT CASE WHEN kind = 'References' THEN source_id END) AS ref_count FROM edges GROUP BY 1")
def hot_symbols(spark, d):
    return stats.hot_symbols(edges(spark, d))


@query(f"WITH {_EDGES}, {_PARTS} SELECT target_id, p.name, p.file_path, count(*) AS reference_count, count(DISTINCT CASE WHEN kind = 'Calls' THEN source_id END) AS call_count, count(DISTINCT CASE WHEN kind = 'References' THEN source_id END) AS ref_count FROM edges JOIN parts p ON p.id = target_id GROUP BY 1, 2, 3")
def hot_symbols_named(spark, d):
    return stats.hot_symbols_named(edges(spark, d), parts(spark, d))


@query("SELECT repo_id, branch_name, commit_sha, count(DISTINCT file_path) AS files_changed, count(DISTINCT id) AS symbols_changed, max(indexed_at) AS committed_at FROM symbols GROUP BY 1, 2, 3")
def recent_activity(spark, d):
    return stats.recent_activity(table(spark, d, "symbols"))


@query(
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS total, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS completed, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS pending,
round(100.0e0 * count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) / count(DISTINCT o_orderkey), 2) AS completed_percent FROM orders GROUP BY 1"""
)
def indexing_progress(spark, d):
    return stats.indexing_progress(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", {"completed": "F", "pending": "O"})


@query("SELECT DISTINCT lower(model) AS model FROM chunk_vectors WHERE model IS NOT NULL")
def distinct_models(spark, d):
    return stats.distinct_models(table(spark, d, "chunk_vectors"))


@query(f"WITH {_EDGES}, o AS (SELECT source_id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) SELECT coalesce(source_id, target_id) AS symbol_id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL JOIN i ON o.source_id = i.target_id")
def degree_counts(spark, d):
    return stats.degrees(edges(spark, d))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value FROM r WHERE k = CAST(ceil(0.95e0 * n) AS BIGINT)")
def nearest_rank(spark, d):
    return stats.nearest_rank(table(spark, d, "events"), ["event_type"], "value", 0.95)


@query(
    """WITH r AS (SELECT query_id, symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, symbol_id) AS k FROM (SELECT query_id, symbol_id, max(score) AS s FROM search_rows WHERE profile = 'Fast' AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)),
e AS (SELECT DISTINCT query_id, symbol_id FROM similarity_candidates WHERE distance <= 3),
h AS (SELECT query_id, max(CASE WHEN r.k <= 5 THEN 1 ELSE 0 END) AS hit FROM e LEFT JOIN r USING (query_id, symbol_id) GROUP BY 1) SELECT avg(hit) AS hit_rate, count(*) AS queries FROM h"""
)
def top_k_hit_rate(spark, d):
    s = table(spark, d, "search_rows").where("profile = 'Fast' and score is not null and not isnan(score)").groupBy("query_id", "symbol_id").agg(F.max("score").alias("s"))
    from pyspark.sql import Window

    ranked = s.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "symbol_id")))
    expected = table(spark, d, "similarity_candidates").where("distance <= 3").select("query_id", "symbol_id").distinct()
    return stats.top_k_hit_rate(ranked, expected, "query_id", "symbol_id", "k", 5)


@query("SELECT count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum(length(content) // 4) AS BIGINT) AS tokens FROM code_chunks")
def chunk_totals(spark, d):
    return stats.sizes(table(spark, d, "code_chunks"), "content")


@query("SELECT language, count(DISTINCT id) AS files FROM files GROUP BY 1")
def language_rollup(spark, d):
    return table(spark, d, "files").groupBy("language").agg(F.countDistinct("id").alias("files"))


# -- sorts, limits, sets -------------------------------------------------------------------------------------


@query("SELECT id, size_bytes FROM (SELECT DISTINCT id, size_bytes FROM files WHERE size_bytes IS NOT NULL) ORDER BY size_bytes DESC, id LIMIT 50")
def largest_files(spark, d):
    """A top-k report."""
    return table(spark, d, "files").where("size_bytes is not null").select("id", "size_bytes").distinct().orderBy(F.desc("size_bytes"), "id").limit(50)


@query("SELECT repo_id, id, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY indexed_at DESC, id) AS n FROM (SELECT DISTINCT repo_id, id, indexed_at FROM files)) WHERE n <= 5")
def per_group_take(spark, d):
    return R.top_per(table(spark, d, "files").select("repo_id", "id", "indexed_at").distinct(), ["repo_id"], 5, F.desc("indexed_at"), "id")


@query("SELECT id, max(indexed_at) AS indexed_at FROM symbols GROUP BY 1")
def keep_latest(spark, d):
    return R.first_per(table(spark, d, "symbols").select("id", "indexed_at"), ["id"], F.desc("indexed_at"))


@query(
    """WITH u AS (SELECT symbol_id, 0 AS side FROM search_rows WHERE profile = 'Fast' UNION ALL SELECT symbol_id, 1 FROM similarity_candidates) SELECT symbol_id, min(side) AS side FROM u GROUP BY 1"""
)
def concat_seen_once(spark, d):
    a = table(spark, d, "search_rows").where("profile = 'Fast'").select("symbol_id", F.lit(0).alias("side"))
    b = table(spark, d, "similarity_candidates").select("symbol_id", F.lit(1).alias("side"))
    return a.unionByName(b).groupBy("symbol_id").agg(F.min("side").alias("side"))


@query("SELECT id, distance_a, distance_b, greatest(distance_a, distance_b) AS most FROM (SELECT id, CAST(length(name) AS INTEGER) AS distance_a, CAST(length(coalesce(qualified_name, '')) AS INTEGER) AS distance_b FROM (SELECT id, max(name) AS name, max(qualified_name) AS qualified_name FROM symbols GROUP BY 1))")
def greatest_key(spark, d):
    s = table(spark, d, "symbols").groupBy("id").agg(F.max("name").alias("name"), F.max("qualified_name").alias("q"))
    x = s.select("id", F.length("name").alias("distance_a"), F.length(F.coalesce("q", F.lit(""))).alias("distance_b"))
    return x.withColumn("most", F.greatest("distance_a", "distance_b")).orderBy(F.desc("most"), "id")


# -- functions -----------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT id, array_to_string({_once(_tok('name'))}, ' ') AS tokens FROM symbols")
def tokenize_names(spark, d):
    return table(spark, d, "symbols").select("id", _text(T.tokens("name")).alias("tokens")).distinct()


@query(f"SELECT DISTINCT id, array_to_string({_identifiers('content')}, ' ') AS tokens FROM code_chunks")
def identifier_tokens(spark, d):
    return table(spark, d, "code_chunks").select("id", _text(T.identifier_tokens("content")).alias("tokens")).distinct()


@query(
    """WITH w AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(query_text, '[^\\p{L}\\p{N}_]+'), lambda t: lower(t)), lambda t: length(t) > 2 AND NOT list_contains([{stop}], t)) AS w FROM search_rows WHERE query_text IS NOT NULL)
SELECT DISTINCT query_id, array_to_string(list_filter(w, lambda t, i: list_position(w, t) = i), ' ') AS keywords FROM w""".replace("{stop}", ",".join(f"'{w}'" for w in T.STOP_WORDS))
)
def query_keywords(spark, d):
    return table(spark, d, "search_rows").where("query_text is not null").select("query_id", _text(T.keywords("query_text")).alias("keywords")).distinct()


@query(
    f"""SELECT DISTINCT query_id, array_to_string({_once("list_filter(regexp_extract_all(query_text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:_[a-z]+)+)\\b', 1), lambda w: length(w) > 2)")}, ' ') AS names,
array_to_string({_once("regexp_extract_all(query_text, '\\b[\\w/\\\\]+\\.\\w+\\b')")}, ' ') AS paths FROM search_rows"""
)
def query_symbol_names(spark, d):
    return table(spark, d, "search_rows").select("query_id", _text(T.symbol_names("query_text")).alias("names"), _text(T.file_paths("query_text")).alias("paths")).distinct()


@query("SELECT DISTINCT id, CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS lines, strlen(content) AS bytes, length(content) // 4 AS tokens FROM code_chunks WHERE content IS NOT NULL")
def text_sizes(spark, d):
    return table(spark, d, "code_chunks").where("content is not null").select("id", T.line_count("content").cast("long").alias("lines"), T.byte_size("content").cast("long").alias("bytes"), T.token_estimate("content").cast("long").alias("tokens")).distinct()


@query("SELECT DISTINCT id, array_to_string(list_slice(string_split(content, chr(10)), least(greatest(2, 1), len(string_split(content, chr(10)))), least(greatest(4, least(greatest(2, 1), len(string_split(content, chr(10))))), len(string_split(content, chr(10))))), chr(10)) AS lines FROM code_chunks WHERE trim(regexp_replace(content, '\\s', ' ', 'g')) <> ''")
def line_snippet(spark, d):
    return table(spark, d, "code_chunks").select("id", T.line_window("content", F.lit(2), F.lit(4)).alias("lines")).where("lines is not null").distinct()


@query(
    "SELECT DISTINCT file_path, CASE lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1)) "
    + " ".join(f"WHEN '{e}' THEN '{lang}'" for lang, exts in T.EXTENSIONS.items() for e in exts.split())
    + " ELSE 'Unknown' END AS detected FROM files WHERE file_path IS NOT NULL"
)
def detect_language(spark, d):
    return table(spark, d, "files").where("file_path is not null").select("file_path", T.detect_language("file_path").alias("detected")).distinct()


@query(
    "WITH h AS (SELECT DISTINCT file_id, lower(split_part(head, chr(10), 1)) AS l FROM file_heads WHERE head IS NOT NULL) SELECT file_id, CASE WHEN l NOT LIKE '#!%' THEN 'Unknown' "
    + " ".join(f"WHEN contains(l, '{tool}') THEN '{lang}'" for tool, lang in T.INTERPRETERS.items())
    + " ELSE 'Unknown' END AS detected FROM h"
)
def detect_by_content(spark, d):
    """Languages of heads under a name without an ending, by their first lines."""
    h = table(spark, d, "file_heads").where("head is not null").select("file_id", F.lower(F.substring_index("head", "\n", 1)).alias("l")).distinct()
    return h.select("file_id", T.detect_language(F.lit("bin/tool"), "l").alias("detected"))


@query("SELECT DISTINCT id, lower(trim(split_part(trim(qualified_name), '(', 1))) AS base, CASE WHEN list_extract(string_split(qualified_name, '.'), -1) = '' THEN qualified_name ELSE list_extract(string_split(qualified_name, '.'), -1) END AS simple FROM symbols WHERE qualified_name IS NOT NULL")
def name_parts(spark, d):
    return table(spark, d, "symbols").where("qualified_name is not null").select("id", T.normalize_qualified("qualified_name").alias("base"), T.simple_name("qualified_name").alias("simple")).distinct()


def _canonical_sql(c: str) -> str:
    """Special types in full: what must not come before a name is matched with it and put back."""
    for name, full in T.SPECIAL_TYPES.items():
        c = f"regexp_replace(regexp_replace({c}, '\\bSystem\\.{name}\\b', '{full}', 'g'), '(^|[^.A-Za-z0-9_]){name}\\b', '\\1{full}', 'g')"
    return c


@query(f"SELECT DISTINCT id, {_canonical_sql('signature')} AS signature FROM symbols WHERE language = 'CSharp' AND signature IS NOT NULL")
def canonical_signatures(spark, d):
    return table(spark, d, "symbols").where("language = 'CSharp' and signature is not null").select("id", T.canonical_types("signature").alias("signature")).distinct()


@query("SELECT DISTINCT symbol_id, fingerprint, CAST(fingerprint & 65535 AS INTEGER) AS low, CAST((fingerprint >> 16) & 65535 AS INTEGER) AS next FROM symbol_fingerprints WHERE fingerprint IS NOT NULL")
def band_split(spark, d):
    b = sketch.bands(F.col("fingerprint"))
    return table(spark, d, "symbol_fingerprints").where("fingerprint is not null").select("symbol_id", "fingerprint", b[0].alias("low"), b[1].alias("next")).distinct()


@query(f"WITH {_simhash_sql('token_', 'SELECT DISTINCT unnest(' + _tok('name') + ') AS token_, [unnest(' + _tok('name') + ')] AS tk FROM symbols')} SELECT token_ AS token, fingerprint AS hash FROM signed")
def fnv_hashes(spark, d):
    names = table(spark, d, "symbols").select(F.explode(T.tokens("name")).alias("token")).distinct()
    return names.select("token", sketch.fnv1a64("token").alias("hash"))


@query(f"WITH {_simhash_sql('doc_id', 'SELECT DISTINCT doc_id, ' + _tok('text') + ' AS tk FROM documents')} SELECT doc_id, fingerprint FROM signed")
def document_sketches(spark, d):
    return table(spark, d, "documents").select("doc_id", sketch.simhash(T.all_tokens("text")).alias("fingerprint")).distinct()


_SCOPE = ["repo_id", "branch_name", "language", "kind", "fingerprint_kind"]


@query(
    """WITH p AS (SELECT DISTINCT symbol_id, repo_id, branch_name, language, kind, fingerprint_kind, fingerprint, band0, band1, band2, band3 FROM symbol_fingerprints)
SELECT DISTINCT a.symbol_id AS seed_id, b.symbol_id, CAST(bit_count(xor(a.fingerprint, b.fingerprint)) AS INTEGER) AS distance FROM p a JOIN p b ON a.repo_id = b.repo_id AND a.branch_name = b.branch_name AND a.language = b.language AND a.kind = b.kind AND a.fingerprint_kind = b.fingerprint_kind AND a.symbol_id <> b.symbol_id
WHERE a.band0 = b.band0 OR a.band1 = b.band1 OR a.band2 = b.band2 OR a.band3 = b.band3"""
)
def band_candidates(spark, d):
    p = table(spark, d, "symbol_fingerprints").select("symbol_id", *_SCOPE, "fingerprint", "band0", "band1", "band2", "band3").distinct()
    return sketch.band_candidates(p, p, _SCOPE)


_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(
    f"""WITH s AS (SELECT DISTINCT id, name, {_GRAMS.format(c="name")} AS g FROM symbols), q AS (SELECT {_GRAMS.format(c="'LedgerMixer'")} AS g)
SELECT id, name, round(len(list_intersect(s.g, q.g)) * 1.0e0 / nullif(len(list_distinct(list_concat(s.g, q.g))), 0), 6) AS similarity FROM s, q WHERE round(len(list_intersect(s.g, q.g)) * 1.0e0 / nullif(len(list_distinct(list_concat(s.g, q.g))), 0), 6) >= 0.3"""
)
def trigram_fuzzy(spark, d):
    return search.stored_names(_grams_of_symbols(spark, d), ["id", "name"], "LedgerMixer")


def _first_vector(spark, d):
    r = table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()
    return [float(x) for x in r[0]]


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS distance FROM embeddings, q ORDER BY 2, 1 LIMIT 10"""
)
def cosine_topk(spark, d):
    return search.nearest_vectors(table(spark, d, "embeddings"), _first_vector(spark, d), 10, "cosine", "embedding", "vec_id").select("vec_id", "distance")


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS distance FROM embeddings, q ORDER BY 2, 1 LIMIT 10"""
)
def l2_topk(spark, d):
    return search.nearest_vectors(table(spark, d, "embeddings"), _first_vector(spark, d), 10, "l2", "embedding", "vec_id").select("vec_id", "distance")


@query("SELECT DISTINCT id, round_even(CAST(score AS DOUBLE), 2) AS score FROM (SELECT symbol_id AS id, score FROM search_rows WHERE score IS NOT NULL AND NOT isnan(score))")
def bankers_rounding(spark, d):
    return table(spark, d, "search_rows").where("score is not null and not isnan(score)").select(F.col("symbol_id").alias("id"), F.bround(F.col("score").cast("double"), 2).alias("score")).distinct()


# -- search --------------------------------------------------------------------------------------------------

_FAST = f"""WITH p AS (SELECT doc_id, unnest({_tok('text')}) AS token, 'D' AS label, 0.1e0 AS w FROM (SELECT DISTINCT doc_id, text FROM documents) UNION ALL SELECT doc_id, unnest({_tok('source')}), 'A', 1.0e0 FROM (SELECT DISTINCT doc_id, source FROM documents)),
h AS (SELECT doc_id, token, sum(w) AS s FROM p WHERE token IN ('stored', 'vectors') GROUP BY ALL)
SELECT doc_id, round(sum(s), 6) AS score FROM h GROUP BY 1 HAVING count(*) = 2"""


def _postings(spark, d):
    docs = table(spark, d, "documents").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("source").alias("source"))
    return search.postings(docs, "doc_id", {"text": ("text", "D"), "source": ("source", "A")})


@query(_FAST)
def fast_search(spark, d):
    """Weighted keyword search over documents: all terms, by label weights."""
    posting = stored(spark, f"document postings of {d}", lambda: _postings(spark, d), "token")
    return search.weighted(posting, "doc_id", ["stored", "vectors"])


def _words_of_documents(spark, d):
    return stored(spark, f"document words of {d}", lambda: search.word_postings(table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct().withColumn("digest", F.xxhash64("text")), ["doc_id", "digest"], "text"), "word")


def _words_of_chunks(spark, d):
    return stored(spark, f"chunk words of {d}", lambda: search.word_postings(table(spark, d, "code_chunks").select("id", "content").distinct().withColumn("digest", F.xxhash64("content")), ["id", "digest"], "content"), "word")


def _grams_of_symbols(spark, d):
    return stored(spark, f"name trigrams of {d}", lambda: search.gram_postings(table(spark, d, "symbols").select("id", "name").distinct(), ["id", "name"], "name"), "gram")


def build_indexes(spark, d):
    """Build what searches and graph queries read, once per session: postings, words, edges."""
    for build in (lambda s, f: stored(s, f"document postings of {f}", lambda: _postings(s, f), "token"), _words_of_documents, _words_of_chunks, _grams_of_symbols, edges):
        build(spark, d)


@query(f"SELECT DISTINCT doc_id FROM documents WHERE list_contains({_words('text')}, 'lease') AND list_contains({_words('text')}, 'expires') AND NOT list_contains({_words('text')}, 'benchmarks')")
def web_search(spark, d):
    return search.stored_matches(_words_of_documents(spark, d), ["doc_id", "digest"], search.web_query("lease expires -benchmarks")).select("doc_id").distinct()


@query(f"SELECT DISTINCT doc_id FROM documents WHERE contains(' ' || array_to_string({_words('text')}, ' ') || ' ', ' walks parents up ') AND len(list_filter({_words('text')}, lambda t: starts_with(t, 'index'))) > 0")
def phrase_and_prefix(spark, d):
    q = search.web_query('"walks parents up" index*')
    texts = table(spark, d, "documents").select("doc_id", F.xxhash64("text").alias("digest"), "text").distinct()
    return search.stored_matches(_words_of_documents(spark, d), ["doc_id", "digest"], q, texts).select("doc_id").distinct()


@query(
    f"""WITH t AS (SELECT DISTINCT id, {_words('content')} AS w FROM code_chunks), m AS (SELECT id, len(list_filter(w, lambda x: x IN ('await', 'async'))) / (1 + ln(1.0e0 + len(w))) AS r FROM t WHERE list_contains(w, 'await') AND list_contains(w, 'async'))
SELECT id, round(r, 6) AS rank FROM m"""
)
def full_text_chunks(spark, d):
    return search.stored_matches(_words_of_chunks(spark, d), ["id", "digest"], search.plain_query("await async")).select("id", "rank")


@query(
    f"""WITH t AS (SELECT doc_id, {_words('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
h AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (SELECT unnest(['search', 'index']) AS term)), g AS (SELECT * FROM h WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM g GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / mean))), 6) AS score FROM g JOIN f USING (term), n GROUP BY 1"""
)
def bm25_scores(spark, d):
    totals = stored(spark, f"document totals of {d}", lambda: table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(search.words("text"))).alias("mean")))
    return search.stored_bm25(_words_of_documents(spark, d), totals, "doc_id", ["search", "index"])


@query(
    f"""WITH c AS (SELECT DISTINCT id, {_words('content')} AS w FROM code_chunks), f AS (SELECT id AS chunk_id, max(round(len(list_filter(w, lambda x: x IN ('await', 'throw'))) / (1 + ln(1.0e0 + len(w))), 6)) AS b FROM c WHERE list_contains(w, 'await') AND list_contains(w, 'throw') GROUP BY 1),
v AS (SELECT id, chunk_id, CAST(vector AS DOUBLE[]) AS x FROM chunk_vectors WHERE model = 'tern-code-128' AND len(vector) = 128 AND len(list_filter(vector, lambda y: y IS NULL OR isnan(y))) = 0 AND len(list_filter(vector, lambda y: y <> 0)) > 0),
q AS (SELECT x AS q FROM v ORDER BY id LIMIT 1), d AS (SELECT v.id, v.chunk_id, round(1 - list_cosine_similarity(v.x, q.q), 6) AS d FROM v, q WHERE v.chunk_id IN (SELECT id FROM c) ORDER BY d, v.id LIMIT 40),
n AS (SELECT chunk_id, max(1 - d) AS s FROM d GROUP BY 1)
SELECT coalesce(f.chunk_id, n.chunk_id) AS chunk_id, coalesce(b, 0) AS bm25_score, coalesce(s, 0) AS vector_score, round(0.3e0 * coalesce(b, 0) + 0.7e0 * coalesce(s, 0), 6) AS score FROM f FULL JOIN n ON f.chunk_id = n.chunk_id ORDER BY score DESC, 1 LIMIT 20"""
)
def hybrid_search(spark, d):
    """Full text and vectors of chunks fused; the query vector is that of the first chunk with one."""
    v = table(spark, d, "chunk_vectors").where("model = 'tern-code-128' and size(vector) = 128 and exists(vector, x -> x <> 0) and forall(vector, x -> x is not null and not isnan(x))")
    q = [float(x) for x in v.orderBy("id").select("vector").first()[0]]
    return search.hybrid(table(spark, d, "code_chunks").select("id", "content", "repo_id").distinct(), v.select("id", "chunk_id", "vector"), "await throw", q, 20, ranked=search.stored_matches(_words_of_chunks(spark, d), ["id", "digest"], search.plain_query("await throw")))


@query("SELECT id, name, 1.0e0 AS similarity FROM (SELECT DISTINCT id, name FROM symbols) WHERE lower(name) = (SELECT min(lower(name)) FROM symbols WHERE kind = 'Method')")
def exact_name_search(spark, d):
    s = table(spark, d, "symbols")
    name = s.where("kind = 'Method'").agg(F.min(F.lower("name"))).first()[0]
    return search.names(s.select("id", "name").distinct(), name, fuzzy=False, k=None)


@query(
    """WITH u AS (SELECT repo_id, branch_name, language, kind, fingerprint_kind, fingerprint, min(symbol_id) AS a, max(symbol_id) AS b FROM symbol_fingerprints WHERE symbol_id IS NOT NULL GROUP BY ALL),
s AS (SELECT p.* FROM symbol_fingerprints p JOIN u ON p.symbol_id = u.a AND p.fingerprint = u.fingerprint AND p.fingerprint_kind = u.fingerprint_kind AND p.repo_id = u.repo_id AND p.branch_name = u.branch_name AND p.language = u.language AND p.kind = u.kind WHERE u.a <> u.b ORDER BY p.symbol_id, p.fingerprint_kind, p.fingerprint LIMIT 1)
SELECT p.symbol_id, CAST(min(bit_count(xor(p.fingerprint, s.fingerprint))) AS INTEGER) AS distance FROM symbol_fingerprints p JOIN s ON p.repo_id = s.repo_id AND p.branch_name = s.branch_name AND p.language = s.language AND p.kind = s.kind AND p.fingerprint_kind = s.fingerprint_kind AND p.symbol_id <> s.symbol_id
AND (p.band0 = s.band0 OR p.band1 = s.band1 OR p.band2 = s.band2 OR p.band3 = s.band3) GROUP BY 1"""
)
def similar_symbols(spark, d):
    """All that is like the first symbol whose sketch another one in its scope shares."""
    p = table(spark, d, "symbol_fingerprints").select("symbol_id", *_SCOPE, "fingerprint", "band0", "band1", "band2", "band3").distinct()
    shared = p.where("symbol_id is not null").groupBy(*_SCOPE, "fingerprint").agg(F.min("symbol_id").alias("symbol_id"), F.max("symbol_id").alias("last")).where("symbol_id <> last")
    seed = shared.orderBy("symbol_id", "fingerprint_kind", "fingerprint").first()
    own = p.where((F.col("symbol_id") != seed["symbol_id"]) | ((F.col("fingerprint_kind") == seed["fingerprint_kind"]) & (F.col("fingerprint") == seed["fingerprint"])))
    texts = p.select("symbol_id", F.col("kind").alias("text"))
    found, _ = search.similar(seed["symbol_id"], own, texts, [seed["kind"]], candidates=None, k=None)
    return found.select("symbol_id", "distance")


# -- graph ---------------------------------------------------------------------------------------------------


@query(f"WITH {_EDGES}, {_PARTS} SELECT e.source_id, p.name, e.kind, p.file_path, e.line FROM edges e JOIN parts p ON p.id = e.source_id WHERE e.target_id = '1'")
def find_references(spark, d):
    return graph.references(edges(spark, d), parts(spark, d), "1", k=None)


@query(f"WITH {_EDGES} SELECT target_id, kind, line FROM edges WHERE source_id = '1' AND kind = 'Calls'")
def find_dependencies(spark, d):
    return graph.dependencies(edges(spark, d), "1", "Calls", k=None)


@query(
    f"""WITH RECURSIVE {_EDGES}, c AS (SELECT source_id, target_id FROM edges WHERE kind = 'Calls'), w AS (SELECT '1' AS symbol_id, 0 AS depth UNION ALL SELECT c.target_id, w.depth + 1 FROM w JOIN c ON c.source_id = w.symbol_id WHERE w.depth < 3)
SELECT '1' AS start_id, symbol_id, depth, count(*) AS walks FROM w GROUP BY ALL"""
)
def call_chain(spark, d):
    start = spark.createDataFrame([("1",)], "symbol_id string")
    return graph.call_chain(edges(spark, d), start, 3)


@query(
    f"""WITH RECURSIVE {_EDGES}, c AS (SELECT source_id, target_id FROM edges WHERE kind = 'Calls'), w AS (SELECT '1' AS symbol_id, 0 AS depth UNION ALL SELECT c.target_id, w.depth + 1 FROM w JOIN c ON c.source_id = w.symbol_id WHERE w.depth < 5)
SELECT '1' AS start_id, symbol_id, depth, count(*) AS walks FROM w GROUP BY ALL"""
)
def call_chain_whole(spark, d):
    """call_chain to the depth of the operator itself, 5; call_chain stays at 3, as its SQL."""
    return graph.call_chain(edges(spark, d), spark.createDataFrame([("1",)], "symbol_id string"))


@query(
    f"""WITH {_EDGES}, o AS (SELECT source_id AS symbol_id, target_id AS other_id, kind AS relation, row_number() OVER (PARTITION BY source_id ORDER BY line, target_id, kind) AS n FROM edges),
i AS (SELECT target_id AS symbol_id, source_id AS other_id, 'CalledBy_' || kind AS relation, row_number() OVER (PARTITION BY target_id ORDER BY line, source_id, kind) AS n FROM edges)
SELECT symbol_id, other_id, relation FROM (SELECT * FROM o UNION ALL SELECT * FROM i) WHERE n <= 10"""
)
def related_symbols(spark, d):
    return graph.related(edges(spark, d), parts(spark, d).select(F.col("id").alias("symbol_id")))


@query(
    f"""WITH {_EDGES}, g AS (SELECT symbol_id, least(1.0e0, sum(w) / 20.0e0) AS g FROM (SELECT source_id AS symbol_id, 1 AS w FROM edges UNION ALL SELECT target_id, 2 FROM edges) GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS symbol_id, round(coalesce(g, 0), 6) AS graph_score, round(0.7e0 * (p_size / 50.0e0) + 0.3e0 * round(coalesce(g, 0), 6), 6) AS score FROM part LEFT JOIN g ON g.symbol_id = CAST(p_partkey AS VARCHAR)"""
)
def graph_rerank(spark, d):
    results = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol_id"), (F.col("p_size") / 50.0).alias("score"), F.col("p_partkey").alias("ordinal"))
    return graph.rerank(results, edges(spark, d)).select("symbol_id", "graph_score", "score")


@query("SELECT lower(parent_symbol_id) AS parent_id, count(DISTINCT lower(id)) AS child_count FROM symbols WHERE parent_symbol_id IS NOT NULL AND trim(parent_symbol_id) <> '' GROUP BY 1")
def parent_child(spark, d):
    return graph.children(table(spark, d, "symbols"))


# -- pipeline ------------------------------------------------------------------------------------------------


def _sources(spark, d):
    """Documents of source text as files."""
    x = table(spark, d, "documents").where("kind = 'source_file' and text is not null").groupBy("doc_id").agg(F.max("text").alias("content"), F.max("repo_id").alias("repo_id"))
    ext = F.when(F.col("content").contains("public sealed class"), "cs").when(F.col("content").rlike(r"(?m)^\s*(async )?def "), "py").when(F.col("content").rlike(r"(?m)^\s*(pub )?(async )?fn "), "rs").when(F.col("content").contains("func ("), "go").when(F.col("content").contains("import org."), "java").otherwise("ts")
    return x.select("repo_id", F.lit("main").alias("branch_name"), F.lit("0").alias("commit_sha"), F.concat(F.col("doc_id"), F.lit("."), ext).alias("file_path"), "content")


@query()
def extract_symbols(spark, d):
    return indexing.symbols(indexing.indexable(_sources(spark, d))).drop("edges")


@query()
def extract_edges(spark, d):
    """Edges of the C# chunks, each taken as a file, resolved against the symbols of all of them."""
    c = table(spark, d, "code_chunks").where("language = 'CSharp' and content is not null").groupBy("id").agg(F.max(F.struct("created_at", "repo_id", "branch_name", "commit_sha", "content")).alias("c"))
    s = indexing.symbols(c.select("c.repo_id", "c.branch_name", "c.commit_sha", F.concat("id", F.lit(".cs")).alias("file_path"), F.lit("CSharp").alias("language"), "c.content"))
    s = cut(s, "symbols")  # read for both sides
    e = indexing.edges_of(s)
    return indexing.resolve_edges(e, s, s.limit(0)).join(e.select("edge_id", "kind", "line"), "edge_id").select("edge_id", "source_id", "kind", "line", "target", "target_id", "step")


@query()
def chunk_windows(spark, d):
    f = indexing.indexable(_sources(spark, d))
    return indexing.chunks(indexing.symbols(f), f)


@query(
    f"""WITH l AS (SELECT id, arg_max(struct_pack(name := name, qualified_name := qualified_name, signature := signature, documentation := documentation), indexed_at) AS x FROM symbols GROUP BY 1),
{_simhash_sql('symbol_id', f"SELECT id AS symbol_id, list_concat({_once(_tok('x.name'))}, {_once(_tok('x.qualified_name'))}, {_once(_tok('x.signature'))}, {_once(_tok('x.documentation'))}, {_identifiers('x.signature')}) AS tk FROM l")}
SELECT symbol_id, fingerprint, CAST(fingerprint & 65535 AS INTEGER) AS band0, CAST((fingerprint >> 16) & 65535 AS INTEGER) AS band1, CAST((fingerprint >> 32) & 65535 AS INTEGER) AS band2, CAST((fingerprint >> 48) & 65535 AS INTEGER) AS band3 FROM signed"""
)
def symbol_sketches(spark, d):
    s = table(spark, d, "symbols").groupBy("id").agg(F.max(F.struct("indexed_at", "name", "qualified_name", "signature", "documentation")).alias("s")).select("id", "s.*").withColumn("snippet", F.col("signature"))
    return indexing.fingerprints(indexing.search_entries(s))


@query(
    """WITH c AS (SELECT DISTINCT id, symbol_name, repo_id, branch_name FROM code_chunks WHERE symbol_id IS NULL), s AS (SELECT lower(trim(qualified_name)) AS q, min(id) AS id FROM symbols WHERE qualified_name IS NOT NULL GROUP BY 1)
SELECT c.id AS edge_id, s.id AS target_id FROM c JOIN s ON s.q = lower(trim(c.symbol_name))"""
)
def edge_resolution(spark, d):
    """Chunks without a symbol, resolved by the name they give."""
    s = table(spark, d, "symbols").select("id", "repo_id", "branch_name", "name", "qualified_name", "parent_symbol_id")
    e = table(spark, d, "code_chunks").where("symbol_id is null").select(F.col("id").alias("edge_id"), F.lit(None).cast("string").alias("source_id"), F.col("symbol_name").alias("target"), "repo_id", "branch_name").distinct()
    return indexing.resolve_edges(e, s, s.limit(0)).where("step = 'batch exact'").select("edge_id", "target_id")


@query(
    """WITH s AS (SELECT id, x.repo_id AS repo_id, x.branch_name AS branch_name, x.file_path AS file_path, x.name AS name, x.q AS q, x.parent AS parent FROM (SELECT id, arg_max(struct_pack(repo_id := repo_id, branch_name := branch_name, file_path := file_path, name := name, q := qualified_name, parent := parent_symbol_id), indexed_at) AS x FROM symbols GROUP BY 1)),
c AS (SELECT id, x.repo_id AS repo_id, x.branch_name AS branch_name, x.file_path AS file_path, x.symbol_id AS symbol_id, x.target AS target FROM (SELECT id, arg_max(struct_pack(repo_id := repo_id, branch_name := branch_name, file_path := file_path, symbol_id := symbol_id, target := symbol_name), created_at) AS x FROM code_chunks WHERE symbol_name IS NOT NULL GROUP BY 1)),
n AS (SELECT repo_id, branch_name, file_path, min(id) AS near FROM s WHERE parent IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT c.id AS edge_id, coalesce(c.symbol_id, n.near) AS source_id, c.target, c.repo_id, c.branch_name, lower(trim(c.target)) AS q, lower(trim(split_part(trim(c.target), '(', 1))) AS b, lower(CASE WHEN list_extract(string_split(split_part(trim(c.target), '(', 1), '.'), -1) = '' THEN split_part(trim(c.target), '(', 1) ELSE list_extract(string_split(split_part(trim(c.target), '(', 1), '.'), -1) END) AS simple
  FROM c LEFT JOIN n ON n.repo_id = c.repo_id AND n.branch_name = c.branch_name AND n.file_path = c.file_path),
k AS (SELECT *, lower(trim(q)) AS whole, lower(trim(split_part(trim(q), '(', 1))) AS base, branch_name = 'main' AS main FROM s WHERE q IS NOT NULL),
r1 AS (SELECT whole, min(id) AS t FROM k WHERE main GROUP BY 1), r2 AS (SELECT repo_id, branch_name, whole, min(id) AS t FROM k WHERE NOT main GROUP BY 1, 2, 3),
r3 AS (SELECT base, min(id) AS t FROM k WHERE main GROUP BY 1 HAVING count(DISTINCT id) = 1), r4 AS (SELECT repo_id, branch_name, base, min(id) AS t FROM k WHERE NOT main GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1),
r5 AS (SELECT parent, lower(name) AS simple, min(id) AS t FROM s WHERE parent IS NOT NULL GROUP BY 1, 2),
x AS (SELECT e.*, o.parent AS up, r1.t AS t1, r2.t AS t2, r3.t AS t3, r4.t AS t4, r5.t AS t5, regexp_full_match(e.target, '[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}') AS guid
  FROM e LEFT JOIN r1 ON r1.whole = e.q LEFT JOIN r2 ON r2.repo_id = e.repo_id AND r2.branch_name = e.branch_name AND r2.whole = e.q LEFT JOIN r3 ON r3.base = e.b LEFT JOIN r4 ON r4.repo_id = e.repo_id AND r4.branch_name = e.branch_name AND r4.base = e.b
  LEFT JOIN s o ON o.id = e.source_id LEFT JOIN r5 ON r5.parent = o.parent AND r5.simple = e.simple)
SELECT edge_id, source_id, CASE WHEN guid THEN target ELSE coalesce(t1, t2, t3, t4, t5, target) END AS target_id,
CASE WHEN guid THEN 'id' WHEN t1 IS NOT NULL THEN 'batch exact' WHEN t2 IS NOT NULL THEN 'stored exact' WHEN t3 IS NOT NULL THEN 'batch base' WHEN t4 IS NOT NULL THEN 'stored base' WHEN t5 IS NOT NULL THEN 'sibling' ELSE 'unresolved' END AS step
FROM x WHERE guid OR coalesce(t1, t2, t3, t4, t5) IS NOT NULL OR up IS NOT NULL"""
)
def edge_resolution_steps(spark, d):
    """Every chunk an edge from its symbol, or else the first one with a parent in its file, to the name it gives, by all steps: main is the batch, other branches the store."""
    latest = lambda df, by, *cs: df.groupBy("id").agg(F.max(F.struct(by, *cs)).alias("x")).select("id", *[f"x.{c}" for c in cs])
    place = ["repo_id", "branch_name", "file_path"]
    s = latest(table(spark, d, "symbols"), "indexed_at", *place, "name", "qualified_name", "parent_symbol_id")
    c = latest(table(spark, d, "code_chunks").where("symbol_name is not null"), "created_at", *place, "symbol_id", "symbol_name")
    near = s.where("parent_symbol_id is not null").groupBy(*place).agg(F.min("id").alias("near"))
    e = c.join(near, place, "left").select(F.col("id").alias("edge_id"), F.coalesce("symbol_id", "near").alias("source_id"), F.col("symbol_name").alias("target"), "repo_id", "branch_name")
    s, main = s.drop("file_path"), F.col("branch_name") == "main"
    return indexing.resolve_edges(e, s.where(main), s.where(~main)).select("edge_id", "source_id", "target_id", "step")


@query("SELECT id, min(language) AS language FROM (SELECT id, language, 0 AS side FROM files WHERE branch_name = 'main' UNION ALL SELECT id, 'new', 1 FROM files WHERE id NOT IN (SELECT id FROM files WHERE branch_name = 'main')) GROUP BY 1")
def upsert_keep_old(spark, d):
    f = table(spark, d, "files")
    return R.upsert(f.where("branch_name = 'main'").select("id", "language"), f.select("id", F.lit("new").alias("language")), ["id"], update=False, order="language")


@query("SELECT id, CASE WHEN bool_or(coalesce(language, '') = 'Python') THEN 'new' WHEN bool_or(language IS NULL) THEN NULL ELSE min(language) END AS language FROM files GROUP BY 1")
def upsert_take_new(spark, d):
    """All states of all ids: of several old ones the first by language, null before others."""
    f = table(spark, d, "files").select("id", "language")
    return R.upsert(f, f.where("language = 'Python'").select("id", F.lit("new").alias("language")), ["id"], update=True, order="language")


@query(
    """WITH o AS (SELECT file_path, min(commit_sha) AS d FROM files WHERE branch_name = 'main' GROUP BY 1), n AS (SELECT file_path, min(commit_sha) AS d FROM files WHERE branch_name <> 'main' GROUP BY 1),
b AS (SELECT coalesce(o.file_path, n.file_path) AS file_path, o.d AS was, n.d AS now FROM o FULL JOIN n ON o.file_path = n.file_path),
a AS (SELECT now AS d, min(file_path) AS file_path FROM b WHERE was IS NULL GROUP BY 1), g AS (SELECT was AS d, min(file_path) AS old_file_path FROM b WHERE now IS NULL GROUP BY 1), m AS (SELECT a.file_path, g.old_file_path FROM a JOIN g ON a.d = g.d)
SELECT file_path, 'Renamed' AS change, old_file_path FROM m UNION ALL SELECT file_path, 'Added', NULL FROM b WHERE was IS NULL AND file_path NOT IN (SELECT file_path FROM m)
UNION ALL SELECT file_path, 'Deleted', NULL FROM b WHERE now IS NULL AND file_path NOT IN (SELECT old_file_path FROM m) UNION ALL SELECT file_path, 'Modified', NULL FROM b WHERE was <> now"""
)
def tree_diff(spark, d):
    f = table(spark, d, "files")
    side = lambda c: f.where(c).groupBy("file_path").agg(F.min("commit_sha").alias("digest"))
    return indexing.tree_diff(side("branch_name = 'main'"), side("branch_name <> 'main'"))


def _jobs(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == F.lit("click"), "Pending").when(F.col("event_type") == F.lit("view"), "Processing").otherwise("Completed")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").cast("string").alias("id"), status.alias("status"), F.lit(0).alias("attempts"), ts.alias("next_attempt_at"), F.when(status == "Processing", ts).alias("locked_at"), F.lit(None).cast("string").alias("locked_by"), ts.alias("created_at"), ts.alias("updated_at"))


@query(
    "WITH j AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'click' THEN 'Pending' WHEN 'view' THEN 'Processing' ELSE 'Completed' END AS status, ts FROM events), m AS (SELECT id FROM j WHERE status = 'Pending' ORDER BY ts, id LIMIT 64) SELECT id, CASE WHEN id IN (SELECT id FROM m) THEN 'Processing' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM m) THEN 1 ELSE 0 END AS attempts FROM j"
)
def job_claim(spark, d):
    return jobs.claim(_jobs(spark, d), 64, "worker", F.lit("2100-01-01").cast("timestamp")).select("id", "status", "attempts")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'click' THEN 'Pending' WHEN 'view' THEN 'Pending' ELSE 'Completed' END AS status FROM events")
def job_requeue_stale(spark, d):
    far = F.lit("2100-01-01").cast("timestamp")
    return jobs.requeue_stale(_jobs(spark, d), far, far).select("id", "status")


@query(
    """WITH h AS (SELECT repo_id, branch_name, max((indexed_at, commit_sha)) AS h, max(CASE WHEN language = 'CSharp' THEN (indexed_at, commit_sha) END) AS i FROM files GROUP BY 1, 2)
SELECT repo_id, branch_name, h[2] AS head_commit_sha, i[2] AS indexed_commit_sha, CASE WHEN i IS NULL THEN 'Pending' WHEN i[2] = h[2] THEN 'Completed' ELSE 'Stale' END AS index_state, NOT (i IS NOT NULL AND i[2] = h[2]) AS needs_indexing FROM h"""
)
def branch_state(spark, d):
    return jobs.branch_states(_indexed(table(spark, d, "files")))


@query(
    """WITH r AS (SELECT DISTINCT query_id, symbol_id, max(snippet) OVER (PARTITION BY query_id, symbol_id) AS snippet FROM search_rows), u AS (SELECT *, coalesce(sum(length(coalesce(snippet, ''))) OVER (PARTITION BY query_id ORDER BY symbol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r)
SELECT query_id, symbol_id, CASE WHEN 200 - used > 0 THEN substring(snippet, 1, CAST(200 - used AS BIGINT)) END AS snippet FROM u"""
)
def snippet_budget(spark, d):
    r = table(spark, d, "search_rows").groupBy("query_id", "symbol_id").agg(F.max("snippet").alias("snippet"))
    return R.running_budget(r, 200, "snippet", ["query_id"], "symbol_id")


@query("SELECT event_id, event_type, user_id FROM events")
def stream_index(spark, d):
    """Events read as a stream of several batches, one of which comes twice, deduplicated and upserted; the table as it stands in the end."""
    from ..streaming import changes

    into = new_path(spark, "stream")
    e = table(spark, d, "events").select("event_id", "ts", "event_type", "user_id")
    e.repartitionByRange(4, "ts").write.parquet(f"{into}/source")
    e.where("event_id % 4 = 0").repartition(1).write.mode("append").parquet(f"{into}/source")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{into}/source")
    stream = changes.deduplicated(stream, ["event_id"], "ts", "3650 days")
    changes.index_into(stream, f"{into}/table", ["event_id"], f"{into}/state", lambda df: df.select("event_id", "event_type", "user_id"), "event_type").awaitTermination()
    return changes.current(spark, f"{into}/table")
