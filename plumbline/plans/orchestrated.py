"""Queries of whole searches, over symbols, chunks and the edges that calls in chunks make, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indexing, orchestrator, search, stats
from ..runtime import stored, table
from .queries import _GRAMS, _SCOPE, _tok

QUERIES: dict = {}
SQL: dict[str, str] = {}

_CALL = r"([A-Za-z_][A-Za-z0-9_]*)\s*\("


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LATEST = """s AS (SELECT id, arg_max(struct_pack(repo_id := repo_id, branch_name := branch_name, name := name, qualified_name := qualified_name, signature := signature, documentation := documentation, kind := kind, parent := parent_symbol_id), indexed_at) AS x FROM symbols WHERE id IS NOT NULL GROUP BY 1),
sym AS (SELECT id, x.repo_id, x.branch_name, x.name, x.qualified_name, x.signature, x.documentation, x.kind, x.parent FROM s)"""


def latest_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each symbol, stored once."""
    cs = ["repo_id", "branch_name", "file_path", "name", "qualified_name", "kind", "language", "start_line", "signature", "documentation", "parent_symbol_id"]
    return stored(spark, f"symbols of {d}", lambda: table(spark, d, "symbols").where("id is not null").groupBy("id").agg(F.max(F.struct("indexed_at", *cs)).alias("x")).select("id", *[f"x.{c}" for c in cs]))


def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    cs = ["repo_id", "branch_name", "file_path", "language", "symbol_id", "symbol_name", "symbol_kind", "start_line", "signature", "content"]
    return table(spark, d, "code_chunks").where("id is not null").groupBy("id").agg(F.max(F.struct("created_at", *cs)).alias("x")).select("id", *[f"x.{c}" for c in cs])


def own_edges(spark: SparkSession, d: str) -> DataFrame:
    """Stored once: calls in the contents of chunks, to the one function or method of that name in the repository and branch, and from each symbol to its parent."""

    def build() -> DataFrame:
        c = table(spark, d, "code_chunks").where("symbol_id is not null and content is not null").select("symbol_id", "repo_id", "branch_name", "content").distinct()
        calls = c.select(F.col("symbol_id").alias("source_id"), "repo_id", "branch_name", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_CALL), F.lit(1)))).alias("name")).distinct()
        one = latest_symbols(spark, d).where(F.col("kind").isin("Method", "Function")).groupBy("repo_id", "branch_name", "name").agg(F.min("id").alias("target_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        x = calls.join(one, ["repo_id", "branch_name", "name"]).where("source_id <> target_id")
        s = latest_symbols(spark, d)
        up = s.where("parent_symbol_id is not null").select(F.col("id").alias("source_id"), F.lower(F.trim("parent_symbol_id")).alias("k"), "repo_id", F.coalesce("start_line", F.lit(0)).cast("long").alias("line"))
        up = up.join(s.select(F.lower("id").alias("k"), F.col("id").alias("target_id")), "k").where("source_id <> target_id")
        x = x.select("source_id", "target_id", F.lit("Calls").alias("kind"), F.lit(0).cast("long").alias("line"), "repo_id").distinct()
        return x.unionByName(up.select("source_id", "target_id", F.lit("MemberOf").alias("kind"), "line", "repo_id"))

    return stored(spark, f"call edges of {d}", build)


def tables(spark: SparkSession, d: str) -> orchestrator.Tables:
    s = latest_symbols(spark, d)
    fields = {"name": ("name", "A"), "qualified_name": ("qualified_name", "A"), "signature": ("signature", "B"), "documentation": ("documentation", "C")}
    postings = stored(spark, f"symbol postings of {d}", lambda: search.postings(s.withColumnRenamed("id", "symbol_id"), "symbol_id", fields), "token")
    prints = table(spark, d, "symbol_fingerprints").select("symbol_id", *_SCOPE, "fingerprint", "band0", "band1", "band2", "band3").distinct()
    return orchestrator.Tables(s, own_edges(spark, d), postings, s.select(F.col("id").alias("symbol_id"), F.col("signature").alias("snippet")), latest_chunks(spark, d), prints)


_CALLS = rf"""{_LATEST}, c AS (SELECT DISTINCT symbol_id, repo_id, branch_name, unnest(regexp_extract_all(content, '{_CALL}', 1)) AS name FROM code_chunks WHERE symbol_id IS NOT NULL AND content IS NOT NULL),
one AS (SELECT repo_id, branch_name, name, min(id) AS target_id FROM sym WHERE kind IN ('Method', 'Function') GROUP BY 1, 2, 3 HAVING count(*) = 1),
calls AS (SELECT DISTINCT c.symbol_id AS source_id, one.target_id, 'Calls' AS kind, c.repo_id FROM c JOIN one ON one.repo_id = c.repo_id AND one.branch_name = c.branch_name AND one.name = c.name WHERE c.symbol_id <> one.target_id
  UNION ALL SELECT c.id, p.id, 'MemberOf', c.repo_id FROM sym c JOIN sym p ON lower(p.id) = lower(trim(c.parent)) WHERE c.id <> p.id)"""


@query(f"WITH {_CALLS} SELECT source_id, target_id, kind, repo_id FROM calls")
def own_edge_list(spark, d):
    return own_edges(spark, d).select("source_id", "target_id", "kind", "repo_id")


@query(f"WITH {_CALLS} SELECT coalesce(o.source_id, i.target_id) AS symbol_id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM (SELECT source_id, count(*) AS n FROM calls GROUP BY 1) o FULL JOIN (SELECT target_id, count(*) AS n FROM calls GROUP BY 1) i ON o.source_id = i.target_id")
def own_degrees(spark, d):
    """Degrees over the engine's own edges."""
    return stats.degrees(own_edges(spark, d))


def _sim(c: str) -> str:
    return f"round(coalesce(len(list_intersect({c}, q.g)) * 1.0e0 / nullif(len(list_distinct(list_concat({c}, q.g))), 0), 0), 6)"


@query(f"WITH {_LATEST}, g AS (SELECT id, {_GRAMS.format(c='name')} AS a, {_GRAMS.format(c='qualified_name')} AS b FROM sym), q AS (SELECT {_GRAMS.format(c=chr(39) + 'settle ledger' + chr(39))} AS g) SELECT id, greatest({_sim('a')}, {_sim('b')}) AS similarity FROM g, q WHERE greatest({_sim('a')}, {_sim('b')}) >= 0.3")
def fuzzy_symbols(spark, d):
    """Symbols by name or qualified name, the better similarity of the two."""
    return search.fuzzy_names(latest_symbols(spark, d), "settle ledger", None).select("id", "similarity")


@query(
    f"""WITH {_LATEST}, g AS (SELECT id, {_GRAMS.format(c='name')} AS a, {_GRAMS.format(c='qualified_name')} AS b FROM sym), q AS (SELECT {_GRAMS.format(c="'LedgerMixer'")} AS g),
m AS (SELECT id, greatest({_sim('a')}, {_sim('b')}) AS similarity FROM g, q), n AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS ordinal FROM m WHERE similarity >= 0.3)
SELECT ordinal, id, 'symbol' AS type, 1.0e0 AS score FROM n WHERE ordinal <= 10"""
)
def ask_navigation(spark, d):
    """A top-k report, as all answers are."""
    return orchestrator.ask(tables(spark, d), "locate LedgerMixer").results.select("ordinal", "id", "type", "score")


@query(
    f"""WITH {_LATEST}, p AS (SELECT id, unnest({_tok('name')}) AS token, 1.0e0 AS w FROM sym UNION ALL SELECT id, unnest({_tok('qualified_name')}), 1.0e0 FROM sym UNION ALL SELECT id, unnest({_tok('signature')}), 0.4e0 FROM sym UNION ALL SELECT id, unnest({_tok('documentation')}), 0.2e0 FROM sym),
h AS (SELECT id, token, sum(w) AS s FROM p WHERE token IN ('ledger', 'async') GROUP BY ALL), r AS (SELECT id, round(sum(s), 6) AS score FROM h GROUP BY 1 HAVING count(*) = 2)
SELECT row_number() OVER (ORDER BY score DESC, id) AS ordinal, id, score FROM r ORDER BY score DESC, id LIMIT 10"""
)
def ask_fast(spark, d):
    return orchestrator.ask(tables(spark, d), "ledger async").results.select("ordinal", "id", "score")


@query(
    """WITH t AS (SELECT id, arg_max(content, created_at) AS content FROM code_chunks WHERE id IS NOT NULL GROUP BY 1), w AS (SELECT id, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') AS w FROM t),
m AS (SELECT id, round(len(list_filter(w, lambda x: x IN ('async', 'await'))) / (1 + ln(1.0e0 + len(w))), 6) AS r FROM w WHERE list_contains(w, 'async') AND list_contains(w, 'await'))
SELECT row_number() OVER (ORDER BY r DESC, id) AS ordinal, id, 0.5e0 AS score FROM m ORDER BY r DESC, id LIMIT 10"""
)
def ask_text(spark, d):
    return orchestrator.ask(tables(spark, d), "async await", profile="Hybrid").results.select("ordinal", "id", "score")


@query()
def ask_relations(spark, d):
    """What uses the symbol that most others point at: the symbol, those others, and chunks about it."""
    t = tables(spark, d)
    most = stats.degrees(t.edges).join(t.symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id").where(F.col("name").rlike("^[A-Z][a-z]+([A-Z][a-z]+)+$"))
    name = most.orderBy(F.desc("in_degree"), "symbol_id").select("name").first()
    return orchestrator.ask(t, f"what uses {name[0] if name else 'Nothing'}").results.select("ordinal", "id", "type", "symbol_name", "score", F.to_json("related").alias("related"))


@query()
def ask_similar(spark, d):
    """What is like the symbol with the smallest id whose sketch another one shares."""
    t = tables(spark, d)
    shared = t.prints.join(t.symbols.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").groupBy(*_SCOPE, "fingerprint").agg(F.min("symbol_id").alias("first"), F.max("symbol_id").alias("last"))
    seed = shared.where("first <> last").agg(F.min("first")).first()[0]
    answer = orchestrator.ask(t, f"similar:{seed}")
    if answer.results is None:
        return spark.createDataFrame([], "ordinal long, id string, score double, reasons string")
    return answer.results.select("ordinal", "id", "score", F.array_join("reasons", " ").alias("reasons"))


@query(
    """WITH m AS (SELECT repo_id, lower(model) AS model, max(len(vector)) AS dims FROM chunk_vectors WHERE model IS NOT NULL GROUP BY ALL)
SELECT repo_id, CASE WHEN count(*) = 1 THEN max(model) END AS model, CASE WHEN count(*) > 1 THEN 'embedding_model_ambiguous' END AS error FROM m GROUP BY 1"""
)
def sole_models(spark, d):
    """The model a query vector without one would be given, for every repository at once."""
    m = table(spark, d, "chunk_vectors").where("model is not null").select("repo_id", F.lower("model").alias("model")).distinct()
    x = m.groupBy("repo_id").agg(F.max("model").alias("model"), F.count(F.lit(1)).alias("n"))
    return x.select("repo_id", F.when(F.col("n") == 1, F.col("model")).alias("model"), F.when(F.col("n") > 1, "embedding_model_ambiguous").alias("error"))


@query("WITH m AS (SELECT lower(model) AS model, len(vector) AS dims, count(*) AS n FROM chunk_vectors WHERE model IS NOT NULL AND vector IS NOT NULL GROUP BY ALL) SELECT model, max(dims) AS dims FROM m GROUP BY 1")
def model_dims(spark, d):
    v = table(spark, d, "chunk_vectors").where("model is not null and vector is not null")
    return v.groupBy(F.lower("model").alias("model")).agg(F.max(F.size("vector")).alias("dims"))


@query(
    """WITH f AS (SELECT id, arg_max(language, indexed_at) AS language, arg_max(size_bytes, indexed_at) AS size_bytes FROM (SELECT id, indexed_at, coalesce(language, 'Unknown') AS language, coalesce(size_bytes, 0) AS size_bytes FROM files) GROUP BY 1)
SELECT count(*) AS files, count(*) FILTER (WHERE language NOT IN ('Unknown','Markdown','JSON','YAML','TOML','XML','HTML','CSS','SCSS','LESS') AND size_bytes <= 1500000) AS parsed, count(*) FILTER (WHERE language IN ('Unknown','Markdown','JSON','YAML','TOML','XML','HTML','CSS','SCSS','LESS')) AS skipped,
count(*) FILTER (WHERE language NOT IN ('Unknown','Markdown','JSON','YAML','TOML','XML','HTML','CSS','SCSS','LESS') AND size_bytes > 1500000) AS failed FROM f"""
)
def indexing_counters(spark, d):
    f = table(spark, d, "files").groupBy("id").agg(F.max(F.struct("indexed_at", F.coalesce("language", F.lit("Unknown")).alias("language"), F.coalesce("size_bytes", F.lit(0)).alias("size"))).alias("f")).select("id", "f.*")
    return indexing.counters(f, "language", F.col("size") <= indexing.FILE_CHARS)
