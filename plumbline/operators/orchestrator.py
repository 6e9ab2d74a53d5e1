"""From a query string to results: the searches an intent asks for, run in turn until one finds something.

Every search is a lazy plan over the tables; only whether it found anything is asked before the next one is
tried. Results: ordinal, id, type, symbol_name, qualified_name, symbol_kind, file_path, language, start_line,
signature, content, score, reasons, related (id, name, relation).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import graph, intent, search
from . import relational as R

#: Matches of a name, callers of a symbol, rows of context and what is looked at for them.
MATCHES, CALLERS, CONTEXT, LOOKED_AT = 5, 20, 3, 5
#: Scores by how a row was found.
EXACT, BY_KEYWORDS, CALLER, TEXT, CONTEXT_FACTOR = 1.0, 0.8, 0.9, 0.5, 0.5

_RELATED = "array<struct<id:string,name:string,relation:string>>"
COLUMNS = ["ordinal", "id", "type", "symbol_name", "qualified_name", "symbol_kind", "file_path", "language", "start_line", "signature", "content", "score", "reasons", "related"]


@dataclass(frozen=True)
class Tables:
    """symbols: id, repo_id, branch_name, file_path, name, qualified_name, kind, language, start_line, signature.
    edges: source_id, target_id, kind, line. postings: symbol_id, token, label, tf. snippets: symbol_id, snippet.
    chunks: id, repo_id, branch_name, file_path, language, symbol_name, symbol_kind, start_line, content.
    prints: as search.similar reads them.
    """

    symbols: DataFrame
    edges: DataFrame
    postings: DataFrame
    snippets: DataFrame
    chunks: DataFrame
    prints: DataFrame


@dataclass(frozen=True)
class Answer:
    parsed: intent.Parsed
    steps: list[str]
    results: DataFrame | None
    error: str | None = None


def _rows(df: DataFrame, type_: str, score: Column, **columns: Column) -> DataFrame:
    """df in the result's columns; what it lacks is null."""
    have = {"type": F.lit(type_), "score": score.cast("double"), "symbol_name": F.col("name") if "name" in df.columns else None, "symbol_kind": F.col("kind") if "kind" in df.columns else None} | columns
    kinds = {"ordinal": "bigint", "start_line": "int", "score": "double", "reasons": "array<string>", "related": _RELATED}
    out = []
    for c in COLUMNS:
        value = have.get(c)
        if value is None:
            value = F.col(c) if c in df.columns else F.lit(None)
        out.append(value.cast(kinds.get(c, "string")).alias(c))
    return df.select(*out)


def named(symbols: DataFrame, wanted: list[str], per_name: int) -> DataFrame:
    """The best fuzzy matches of each name, a symbol once, under the first name it matches: symbols' columns, at, similarity."""
    if not wanted:
        return symbols.withColumns({"at": F.lit(0), "similarity": F.lit(0.0)}).limit(0)
    names = F.posexplode(F.array(*[F.lit(w) for w in wanted])).alias("at", "wanted")
    x = symbols.select("*", names).withColumn("grams", T.trigrams("wanted"))
    x = x.withColumn("similarity", F.round(F.greatest(T.set_similarity(T.trigrams("name"), F.col("grams")), T.set_similarity(T.trigrams("qualified_name"), F.col("grams"))), 6))
    x = R.top_per(x.where(F.col("similarity") >= search.FUZZY), ["at"], per_name, F.desc("similarity"), "id")
    return R.first_per(x, ["id"], "at").drop("wanted", "grams")


def _numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """ordinal by order; df has at most a few hundred rows, the limits of the searches."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def navigation(symbols: DataFrame, p: intent.Parsed, k: int) -> DataFrame:
    """Symbols by the names in the query, or, if none matches, by its keywords taken together."""
    names = p.names or p.keywords
    found, score = named(symbols, names, k), EXACT
    if found.isEmpty():
        found, score = named(symbols, [" ".join(p.keywords)] if p.keywords else [], k), BY_KEYWORDS
    x = _numbered(found, "at", F.desc("similarity"), "id").where(F.col("ordinal") <= k)
    return _rows(x, "symbol", F.lit(score), reasons=F.array(F.concat(F.lit("match:"), F.col("name"))))


def relations(symbols: DataFrame, edges: DataFrame, p: intent.Parsed, k: int) -> DataFrame:
    """The symbols named, each with its first edges either way; if the question asks for what points at them, followed by that."""
    found = named(symbols, p.names or p.keywords, MATCHES)
    other = symbols.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    near = graph.related(edges, found.select(F.col("id").alias("symbol_id"))).join(other, "other_id")
    near = near.groupBy(F.col("symbol_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("other_id").alias("id"), F.col("other_name").alias("name"), "relation"))).alias("related"))  # at most 20 of each
    found = found.join(near, "id", "left")
    if not p.incoming:
        x = _numbered(found, "at", F.desc("similarity"), "id").where(F.col("ordinal") <= k)
        return _rows(x, "symbol", F.lit(EXACT), reasons=F.array(F.concat(F.lit("match:"), F.col("name"))))
    into = edges.join(found.select(F.col("id").alias("target_id"), F.col("at").alias("at"), F.col("similarity").alias("like"), F.col("name").alias("target_name")), "target_id")
    into = R.top_per(into, ["target_id"], CALLERS, "line", "source_id", "kind")
    into = into.select("target_id", "at", "like", "target_name", F.col("kind").alias("link"), F.col("source_id").alias("id"), "line").join(symbols, "id")
    both = found.select("*", F.col("similarity").alias("like"), F.col("id").alias("target_id"), F.lit(-1).cast("long").alias("line"), F.lit(None).cast("string").alias("link"), F.col("name").alias("target_name"))
    both = both.unionByName(into.select("*", F.lit(0.0).alias("similarity"), F.lit(None).cast(_RELATED).alias("related")).select(*both.columns))
    x = _numbered(both, "at", F.desc("like"), "target_id", F.col("link").isNotNull(), "line", "id").where(F.col("ordinal") <= k)
    caller = F.col("link").isNotNull()
    reason = F.when(caller, F.concat_ws(":", F.lower("link"), "target_name")).otherwise(F.concat(F.lit("match:"), F.col("name")))
    return _rows(x, "symbol", F.when(caller, CALLER).otherwise(EXACT), type=F.when(caller, "caller").otherwise("symbol"), reasons=F.array(reason))


def full_text(chunks: DataFrame, p: intent.Parsed, k: int) -> DataFrame:
    """Chunks with all the query's words, in order of rank, all of one score."""
    x = search.full_text(chunks, "id", "content", " ".join(p.keywords), k) if p.keywords else chunks.withColumn("rank", F.lit(0.0)).limit(0)
    x = _numbered(x, F.desc("rank"), "id")
    return _rows(x, "code_chunk", F.lit(TEXT), symbol_name=F.col("symbol_name"), symbol_kind=F.col("symbol_kind"))


def fast(t: Tables, symbols: DataFrame, p: intent.Parsed, k: int) -> DataFrame:
    """Symbols that hold all of the query's tokens, by label weights, from the stored postings."""
    tokens = list(dict.fromkeys(x for w in p.keywords for x in search.tokens_of(w)))
    if not tokens:
        return _rows(symbols.limit(0), "symbol", F.lit(0.0), ordinal=F.lit(0))
    hits = search.weighted(t.postings, "symbol_id", tokens, 2 * k).select(F.col("symbol_id").alias("id"), "score")
    x = hits.join(symbols, "id").join(t.snippets.select(F.col("symbol_id").alias("id"), F.col("snippet").alias("content")), "id", "left")
    x = _numbered(x, F.desc("score"), "id").where(F.col("ordinal") <= k)
    why = [F.lit(f"match:{w}") for w in p.keywords[:3]] + [F.lit(f"match:{n}") for n in p.names[:1]]
    return _rows(x, "symbol", F.col("score"), content=F.coalesce("content", "signature"), reasons=F.array_distinct(F.array(*why)))


def similar(t: Tables, p: intent.Parsed, k: int, repo: str | None, branch: str | None) -> tuple[DataFrame | None, str | None]:
    known = t.symbols.select(F.col("id").alias("symbol_id"), "kind", "language")
    found, error = search.similar(p.seed or "", t.prints, t.snippets.select("symbol_id", F.col("snippet").alias("text")), p.terms, k=min(k, 10), symbols=known, repo=repo, branch=branch)
    if found is None:
        return None, error
    x = found.select(F.col("symbol_id").alias("id"), "distance", F.col("score").alias("like")).join(t.symbols, "id")
    x = _numbered(x, "distance", "id")
    reasons = F.array(F.lit("similarity:simhash"), F.concat(F.lit("distance:"), F.col("distance").cast("string")))
    return _rows(x, "symbol", F.col("like"), reasons=reasons), None


def with_context(results: DataFrame, chunks: DataFrame, p: intent.Parsed) -> DataFrame:
    """Results, and after them a few chunks that speak of the same words, at half their score."""
    near = full_text(chunks, p, LOOKED_AT).join(results.select("id"), "id", "left_anti").orderBy("ordinal").limit(CONTEXT)
    near = near.withColumns({"type": F.lit("semantic_context"), "score": F.col("score") * CONTEXT_FACTOR, "ordinal": F.col("ordinal") + 1_000_000})
    return results.unionByName(near.select(*COLUMNS))


def reranked(results: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Results by score and degree. A result counts as the first symbol, by id, whose name begins with its own; reasons are dropped."""
    wanted = results.where("symbol_name is not null").select(F.lower("symbol_name").alias("wanted")).distinct()
    # As many names as there are results, which the searches bound.
    begins = symbols.select("id", F.lower("name").alias("name")).join(F.broadcast(wanted), F.col("name").startswith(F.col("wanted")))
    first = begins.groupBy("wanted").agg(F.min(F.struct("name", "id")).alias("s")).select("wanted", F.col("s.id").alias("symbol_id"))
    x = results.withColumn("wanted", F.lower("symbol_name")).join(first, "wanted", "left").drop("wanted")
    x = graph.rerank(x, edges).withColumn("reasons", F.lit(None).cast("array<string>"))
    return _numbered(x.withColumnRenamed("ordinal", "before"), F.desc("score"), "before").select(*COLUMNS)


def ask(t: Tables, query: str, profile: str = "Fast", k: int = 10, repo: str | None = None, branch: str | None = None, language: str | None = None) -> Answer:
    """The answer to a query string within a scope."""
    p = intent.parse(query)
    steps = intent.route(p, profile)
    scope = {"repo_id": repo, "branch_name": branch, "language": language}
    symbols, chunks = R.where_given(t.symbols, **scope), R.where_given(t.chunks, **scope)
    if steps[0] == "similar":
        found, error = similar(t, p, k, repo, branch)
        return Answer(p, steps, found, error)
    results = None
    for step in [s for s in steps if s != "rerank"]:
        if step == "navigation":
            results = navigation(symbols, p, k)
        elif step == "relations":
            results = relations(symbols, t.edges, p, k)
        elif step == "fast":
            results = fast(t, symbols, p, k)
        else:
            results = full_text(chunks, p, k)
        if not results.isEmpty():
            break
    if "rerank" in steps:
        results = reranked(results, symbols, t.edges)
    if p.intent == "Relations":
        results = with_context(results, chunks, p)
    return Answer(p, steps, results.orderBy("ordinal").limit(k + (CONTEXT if p.intent == "Relations" else 0)))


def resolve_model(vectors: DataFrame, dims: int | None, explicit: str | None = None, configured: str | None = None, **scope: str | None) -> tuple[str | None, str | None]:
    """The model a query vector belongs to: the one named, else the one set, else the only one stored; or an error code."""
    x = R.where_given(vectors, **scope).where(F.col("model").isNotNull())
    model = next((m.strip().lower() for m in (explicit, configured) if m and m.strip()), None)
    if model is None:
        stored = [r[0] for r in x.select(F.lower("model").alias("m")).distinct().limit(2).collect()]
        if len(stored) != 1:
            return None, "embedding_model_ambiguous" if stored else "embedding_model_not_found"
        model = stored[0]
    one = x.where(F.lower("model") == model).select(F.size("vector").alias("n")).where("n > 0").limit(1).collect()
    if not one:
        return None, "embedding_model_not_found"
    if dims is not None and one[0]["n"] != dims:
        return None, "embedding_dims_mismatch"
    return model, None


def query_vector(t: DataFrame, raw: str | None, dims: int | None, model: str | None, configured: str | None = None, **scope: str | None) -> tuple[list[float] | None, str | None, str | None]:
    """Values, model and error code of a query vector given as text, checked against the stored vectors."""
    values, named_model, error = V.parse_query_vector(raw, dims, model)
    if error:
        return None, named_model, error
    found, error = resolve_model(t, dims, named_model, configured, **scope)
    return (values, found, None) if error is None else (None, named_model, error)
