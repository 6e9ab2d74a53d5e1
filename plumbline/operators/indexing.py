"""From files to symbols, search entries, sketches, chunks and resolved edges, and back into tables.

files: repo_id, branch_name, commit_sha, file_path, language, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sketch
from ..functions import text as T
from . import extract
from . import relational as R

#: Lines of context around a symbol's chunk, its most characters, and most characters of an indexed file.
CONTEXT, CHUNK_CHARS, FILE_CHARS = 5, 30_000, 1_500_000
SCOPE = ["repo_id", "branch_name", "commit_sha", "file_path"]


def indexable(files: DataFrame, most: int = FILE_CHARS) -> DataFrame:
    """Files with text, no NUL in it, not over the size limit, in a language that is indexed."""
    lang = T.detect_language("file_path", "content")
    x = files.where(F.col("content").isNotNull() & (F.length("content") <= most) & ~F.col("content").contains("\x00"))
    return x.withColumn("language", lang).where(T.is_indexed_language("language"))


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of the files by their languages' grammars, with edges (kind, target as written, line)."""
    x = files.where(F.col("language").isin(*extract.LANGUAGES)).select(*SCOPE, "language", "content")
    return x.mapInPandas(extract.rows, extract.SCHEMA)


def edges_of(syms: DataFrame) -> DataFrame:
    """The edges of extracted symbols, to be resolved: edge_id, source_id, target, kind, line, repo_id, branch_name."""
    e = syms.select(F.col("id").alias("source_id"), "repo_id", "branch_name", F.posexplode("edges").alias("at", "e")).select("source_id", "repo_id", "branch_name", "at", "e.*")
    return e.select(F.sha1(F.concat_ws("|", "source_id", "at")).alias("edge_id"), "source_id", "target", "kind", "line", "repo_id", "branch_name")


def search_entries(syms: DataFrame, snippet: str = "snippet") -> DataFrame:
    """Tokens of each symbol by field, to be weighted A, A, B, C, D."""
    opt = lambda c: T.tokens(c) if c in syms.columns else F.array().cast("array<string>")
    return syms.select(F.col("id").alias("symbol_id"), T.tokens("name").alias("name_tokens"), opt("qualified_name").alias("qualified_tokens"), opt("signature").alias("signature_tokens"), opt("documentation").alias("documentation_tokens"), F.coalesce(F.col("literal_tokens"), F.array().cast("array<string>")).alias("literal_tokens") if "literal_tokens" in syms.columns else F.array().cast("array<string>").alias("literal_tokens"), F.col(snippet).alias("snippet"))


def fingerprints(entries: DataFrame) -> DataFrame:
    """SimHash over all fields' tokens and the snippet's identifiers, with bands."""
    stream = F.concat("name_tokens", "qualified_tokens", "signature_tokens", "documentation_tokens", "literal_tokens", T.identifier_tokens("snippet"))
    x = entries.select("symbol_id", sketch.simhash(stream).alias("fingerprint"))
    b = sketch.bands(F.col("fingerprint"))
    return x.select("symbol_id", "fingerprint", *[b[i].alias(f"band{i}") for i in range(4)])


def chunks(syms: DataFrame, files: DataFrame, context: int = CONTEXT, most: int = CHUNK_CHARS) -> DataFrame:
    """A chunk per symbol of a chunked kind: its lines with context, without it if over the limit, then cut; one per range of lines.

    A file meets its symbols gathered in one row, so its text is joined and split once, and ranges are deduplicated before texts are cut.
    """
    names = dict.fromkeys(syms.columns)
    parent = F.col("parent_symbol_id") if "parent_symbol_id" in names else F.lit(None).cast("string")
    own = F.coalesce("qualified_name", "name") if "qualified_name" in names else F.col("name")
    wanted = syms.where(F.col("kind").isin(*T.CHUNKED_KINDS))
    above = syms.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_symbol_name"))
    x = wanted.withColumn("parent_id", parent).join(above, "parent_id", "left")
    s = F.struct("start_line", "id", F.greatest("end_line", "start_line").alias("end_line"), own.alias("symbol_name"), F.col("kind").alias("symbol_kind"), "parent_symbol_name", "signature")
    x = x.groupBy(*SCOPE).agg(F.sort_array(F.collect_list(s)).alias("symbols"))  # one file's symbols
    x = x.join(files.select(*SCOPE, "language", "content"), SCOPE).withColumn("lines", F.split("content", "\n", -1)).drop("content")
    n = F.size("lines")
    part = lambda a, b: F.array_join(F.slice("lines", a, b - a + 1), "\n")

    def ranged(s: Column) -> Column:
        a, b = F.greatest(s["start_line"] - context, F.lit(1)), F.least(s["end_line"] + context, n)
        big = F.length(part(a, b)) > most
        return s.withField("a", F.when(big, s["start_line"]).otherwise(a)).withField("b", F.when(big, F.least(s["end_line"], n)).otherwise(b))

    x = x.withColumn("symbols", F.transform("symbols", ranged))
    seen = F.transform("symbols", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))
    x = x.withColumn("seen", seen)
    x = x.withColumn("symbols", F.filter("symbols", lambda s, i: F.array_position("seen", F.struct(s["a"].alias("a"), s["b"].alias("b"))) == i + 1))  # the first of a range
    x = x.withColumn("symbols", F.transform("symbols", lambda s: s.withField("content", F.left(part(s["a"], s["b"]), F.lit(most)))))
    x = x.select(*SCOPE, "language", F.explode("symbols").alias("s")).select(*SCOPE, "language", "s.*")
    key = F.sha1(F.concat_ws("|", "id", "a", "b"))
    return x.select(key.alias("id"), *SCOPE, F.col("id").alias("symbol_id"), "symbol_name", "symbol_kind", "language", "content", "start_line", "end_line", F.col("a").alias("chunk_start_line"), F.col("b").alias("chunk_end_line"), T.token_estimate("content").alias("token_count"), "parent_symbol_name", "signature")


def resolve_edges(edges: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """edges: edge_id, source_id, target, repo_id, branch_name. Adds target_id and step, the first fallback that found it.

    batch and stored: id, repo_id, branch_name, name, qualified_name, parent_symbol_id. In order: a target that is an
    id already; the exact name in the batch; in the store, within repository and branch; the name without its
    arguments if it belongs to one id only, in the batch, in the store; a sibling by simple name. An edge whose
    source has a parent is kept though nothing was found, others are dropped.
    """
    key = lambda strip: T.normalize_qualified("qualified_name", strip)
    exact = lambda df, keys, name: df.where("qualified_name is not null").groupBy(*keys, key(False).alias("q")).agg(F.min("id").alias(name))
    only = lambda df, keys, name: df.where("qualified_name is not null").groupBy(*keys, key(True).alias("b")).agg(F.min("id").alias(name), F.count_distinct("id").alias("n")).where("n = 1").drop("n")
    scope = ["repo_id", "branch_name"]
    x = edges.withColumns({"q": T.normalize_qualified("target", False), "b": T.normalize_qualified("target"), "simple": F.lower(T.simple_name(F.substring_index(F.trim("target"), "(", 1)))})
    x = x.join(exact(batch, [], "r1"), "q", "left").join(exact(stored, scope, "r2"), [*scope, "q"], "left")
    x = x.join(only(batch, [], "r3"), "b", "left").join(only(stored, scope, "r4"), [*scope, "b"], "left")
    every = batch.unionByName(stored).dropDuplicates(["id"])
    x = x.join(every.select(F.col("id").alias("source_id"), F.col("parent_symbol_id").alias("parent")), "source_id", "left")
    siblings = every.where("parent_symbol_id is not null").groupBy(F.col("parent_symbol_id").alias("parent"), F.lower("name").alias("simple")).agg(F.min("id").alias("r5"))
    x = x.join(siblings, ["parent", "simple"], "left")
    guid = T.is_guid("target")
    steps = F.when(guid, F.lit("id"))
    for name, c in (("batch exact", "r1"), ("stored exact", "r2"), ("batch base", "r3"), ("stored base", "r4"), ("sibling", "r5")):
        steps = steps.when(F.col(c).isNotNull(), F.lit(name))
    x = x.withColumns({"target_id": F.when(guid, F.col("target")).otherwise(F.coalesce("r1", "r2", "r3", "r4", "r5")), "step": steps.otherwise("unresolved")})
    return x.where(F.col("target_id").isNotNull() | F.col("parent").isNotNull()).select("edge_id", "source_id", "target", F.coalesce("target_id", "target").alias("target_id"), "step")


def reindex(tables: dict[str, DataFrame], changed: DataFrame, gone: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """tables: files, symbols, chunks, edges, entries, fingerprints as made here (those not given begin empty). changed: scope and content
    of new and changed files; gone: repo_id, branch_name, file_path of deleted ones.

    Everything of the changed and gone paths is replaced, in all tables, by what the changed files hold now; edges that
    point at symbols no longer there stay as they are. The second result is one row of counters: files, parsed, skipped, deleted, symbols, edges.
    """
    key = ["repo_id", "branch_name", "file_path"]
    lang = changed.withColumn("language", T.detect_language("file_path", "content"))
    kept = indexable(changed)
    syms = symbols(kept)
    plain = syms.drop("edges")
    own = edges_of(syms)
    stored = tables.get("symbols")
    names = lambda df: df.select("id", "repo_id", "branch_name", "name", "qualified_name", "parent_symbol_id")
    found = resolve_edges(own, names(plain), names(stored) if stored is not None else names(plain).limit(0)).join(own.select("edge_id", "kind", "line"), "edge_id")
    at = plain.select(F.col("id").alias("source_id"), *key)
    new = {
        "files": kept.select(*SCOPE, "language", F.octet_length("content").alias("size_bytes"), T.line_count("content").alias("line_count")),
        "symbols": plain,
        "chunks": chunks(plain, kept),
        "edges": found.join(at, "source_id").select("edge_id", *key, "source_id", "target_id", "kind", "line", "step"),
        "entries": search_entries(plain, "signature").join(plain.select(F.col("id").alias("symbol_id"), *key), "symbol_id"),
    }
    new["fingerprints"] = fingerprints(new["entries"]).join(plain.select(F.col("id").alias("symbol_id"), *key), "symbol_id")
    paths = changed.select(*key) if gone is None else changed.select(*key).unionByName(gone.select(*key))
    paths = paths.distinct()
    out = {}
    for name, df in new.items():
        old = tables.get(name)
        out[name] = R.delete_matching(old, paths, key).unionByName(df) if old is not None else df
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    report = counters(lang, "language", F.col("content").isNotNull() & (F.length("content") <= FILE_CHARS) & ~F.coalesce(F.col("content").contains("\x00"), F.lit(False)))
    for df, name in ((gone.select(*key).distinct() if gone is not None else paths.limit(0), "deleted"), (plain, "symbols"), (found, "edges")):
        report = report.crossJoin(F.broadcast(n(df, name)))  # one row each
    return out, report


def counters(files: DataFrame, language: str, fits: Column) -> DataFrame:
    """One row: files, those parsed, skipped for their language, and failed for what keeps them from being read (fits is false)."""
    wanted = T.is_indexed_language(language)
    n = lambda c: F.count(F.when(c, 1))
    return files.agg(F.count(F.lit(1)).alias("files"), n(wanted & fits).alias("parsed"), n(~wanted).alias("skipped"), n(wanted & ~fits).alias("failed"))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: file_path, digest. file_path, change (Added, Modified, Deleted, Renamed), old_file_path of a rename by equal digest."""
    both = old.select("file_path", F.col("digest").alias("was")).join(new.select("file_path", F.col("digest").alias("now")), "file_path", "full_outer")
    added, gone = both.where("was is null"), both.where("now is null")
    first = lambda df, d, name: df.groupBy(F.col(d).alias("digest")).agg(F.min("file_path").alias(name))
    moved = first(added, "now", "file_path").join(first(gone, "was", "old_file_path"), "digest")
    none = F.lit(None).cast("string").alias("old_file_path")
    parts = [
        moved.select("file_path", F.lit("Renamed").alias("change"), "old_file_path"),
        added.join(moved, "file_path", "left_anti").select("file_path", F.lit("Added").alias("change"), none),
        gone.join(moved.select(F.col("old_file_path").alias("file_path")), "file_path", "left_anti").select("file_path", F.lit("Deleted").alias("change"), none),
        both.where("was <> now").select("file_path", F.lit("Modified").alias("change"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
