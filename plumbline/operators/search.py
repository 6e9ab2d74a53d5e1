"""Keyword, full-text, fuzzy, vector, hybrid and similarity search over DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from . import relational as R

#: Weights of the labels A to D.
LABELS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Least trigram similarity that is a match; factors of BM25.
FUZZY, K1, B = 0.3, 1.2, 0.75


@dataclass(frozen=True)
class TextQuery:
    """Terms that must all occur, groups of which one must, terms that must not, phrases, prefixes."""

    all: list[str] = field(default_factory=list)
    any: list[list[str]] = field(default_factory=list)
    none: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)


_PART = re.compile(r'(-?)"([^"]*)"|(\S+)')
_TERM = re.compile(r"[A-Za-z0-9]+")


def plain_query(q: str) -> TextQuery:
    return TextQuery(all=list(dict.fromkeys(t.lower() for t in _TERM.findall(q))))


def web_query(q: str) -> TextQuery:
    """Words are all wanted; quotes make a phrase, a leading - excludes, or joins alternatives, a final * is a prefix."""
    want: list[list[str]] = []
    none: list[str] = []
    phrases: list[list[str]] = []
    prefixes: list[str] = []
    alternative = False
    for m in _PART.finditer(q):
        if m[2] is not None:
            words = [t.lower() for t in _TERM.findall(m[2])]
            if words and m[1]:
                none.extend(words)
            elif words:
                phrases.append(words)
            continue
        word = m[3]
        if word.lower() == "or":
            alternative = bool(want)
            continue
        terms = [t.lower() for t in _TERM.findall(word)]
        if not terms:
            continue
        if word.startswith("-"):
            none.extend(terms)
        elif word.endswith("*"):
            prefixes.append(terms[-1])
        elif alternative:
            want[-1].extend(terms)
        else:
            want.append(terms)
        alternative = False
    return TextQuery(all=[t for g in want if len(g) == 1 for t in g], any=[g for g in want if len(g) > 1], none=none, phrases=phrases, prefixes=prefixes)


def words(c: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _begins(p: str):
    return lambda x: x.startswith(p)


def _is(t: str):
    return lambda x: x == t


def matches(w: Column, q: TextQuery) -> Column:
    """Whether an array of words satisfies the query."""
    ok = F.lit(True)
    for t in q.all:
        ok = ok & F.array_contains(w, t)
    for g in q.any:
        ok = ok & F.arrays_overlap(w, F.array(*[F.lit(t) for t in g]))
    for t in q.none:
        ok = ok & ~F.array_contains(w, t)
    for p in q.prefixes:
        ok = ok & F.exists(w, _begins(p))
    for p in q.phrases:
        ok = ok & F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).contains(f" {' '.join(p)} ")
    return ok


_PART_OF_NAME = re.compile(T.TOKEN)


def tokens_of(word: str) -> list[str]:
    """The tokens of a driver-side word, as all_tokens gives them for a column."""
    return [t.lower() for t in _PART_OF_NAME.findall(re.sub("[^A-Za-z0-9]+", " ", word)) if len(t) >= 2]


def postings(df: DataFrame, key: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """fields: name to (column, label). One row per key, token and label: key, token, label, tf."""
    per = F.array(*[F.struct(F.lit(label).alias("label"), T.all_tokens(c).alias("tokens")) for c, label in fields.values()])
    x = df.select(key, F.explode(per).alias("f")).select(key, F.col("f.label").alias("label"), F.explode("f.tokens").alias("token"))
    return x.groupBy(key, "token", "label").agg(F.count(F.lit(1)).alias("tf"))


def word_postings(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The stored form of full text: one row per key and word: keys, word, tf, len (words of the text)."""
    x = df.select(*keys, words(text).alias("w"))
    x = x.select(*keys, F.size("w").alias("len"), F.explode("w").alias("word"))
    return x.groupBy(*keys, "len", "word").agg(F.count(F.lit(1)).alias("tf"))


def _terms(q: TextQuery) -> list[str]:
    """The query's terms that count for a rank."""
    return [*q.all, *(t for g in q.any for t in g), *(t for p in q.phrases for t in p)]


def stored_matches(posting: DataFrame, keys: list[str], q: TextQuery, texts: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Keys that satisfy a query, with rank, from stored word postings: only rows of the query's words are read.

    texts (keys and the text) is needed for phrases: there the words' order is looked up, of those alone that hold all
    of them. A query without any word wanted can't be answered from postings.
    """
    phrase_words = [t for p in q.phrases for t in p]
    if not (q.all or q.any or q.prefixes or phrase_words):
        raise ValueError("the query wants no word")
    wanted = F.col("word").isin([*_terms(q), *q.none])
    for p in q.prefixes:
        wanted = wanted | F.col("word").startswith(p)
    plain = TextQuery(all=[*q.all, *phrase_words], any=q.any, none=q.none, prefixes=q.prefixes)
    terms = _terms(q)
    tf = F.sum(F.when(F.col("word").isin(terms), F.col("tf")).otherwise(0)) if terms else F.lit(0)
    x = posting.where(wanted).groupBy(*keys).agg(F.collect_set("word").alias("w"), tf.alias("tf"), F.max("len").alias("len"))  # at most as many words as the query matches
    x = x.where(matches(F.col("w"), plain))
    if q.phrases:
        x = x.join(texts.select(*keys, F.col(text).alias("__text")), keys).where(matches(words("__text"), TextQuery(phrases=q.phrases))).drop("__text")
    return x.select(*keys, F.round(F.col("tf") / (1 + F.log(1.0 + F.col("len"))), 6).alias("rank"))


def stored_bm25(posting: DataFrame, totals: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """bm25 from stored word postings; totals: one row of n (texts) and mean (their words)."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    hits = posting.where(F.col("word").isin(terms))
    df_ = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # as many rows as terms
    y = hits.join(F.broadcast(df_), "word").crossJoin(F.broadcast(totals))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return y.groupBy(key).agg(F.round(F.sum(s), 6).alias("score")).orderBy(F.desc("score"), key)


def weighted(posting: DataFrame, key: str, terms: list[str], k: int | None = None) -> DataFrame:
    """Keys that hold all terms, by the sum of label weight times tf."""
    terms = list(dict.fromkeys(terms))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("label"))
    x = posting.where(F.col("token").isin(terms)).groupBy(key).agg(F.countDistinct("token").alias("have"), F.round(F.sum(weight * F.col("tf")), 6).alias("score"))
    x = x.where(F.col("have") == len(terms)).select(key, "score").orderBy(F.desc("score"), key)
    return x.limit(k) if k is not None else x


def bm25(df: DataFrame, key: str, text: str, terms: list[str], k: int | None = None, every: bool = False) -> DataFrame:
    """Okapi BM25 over the words of a column; every demands all terms."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    x = df.select(key, words(text).alias("w")).withColumn("len", F.size("w"))
    total = x.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    hits = x.select(key, "len", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.size(F.filter("w", _is(t))).alias("tf")) for t in terms])).alias("h")).select(key, "len", "h.*").where("tf > 0")
    df_ = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as terms
    y = hits.join(F.broadcast(df_), "term").crossJoin(F.broadcast(total))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    y = y.groupBy(key).agg(F.count(F.lit(1)).alias("have"), F.round(F.sum(s), 6).alias("score"))
    y = (y.where(F.col("have") == len(terms)) if every else y).select(key, "score").orderBy(F.desc("score"), key)
    return y.limit(k) if k is not None else y


def full_text(df: DataFrame, key: str, text: str, query: str | TextQuery, k: int | None = 10, **scope: str | None) -> DataFrame:
    """Rows whose text satisfies the query, by the number of occurrences of its terms; other columns are kept."""
    q = plain_query(query) if isinstance(query, str) else query
    w = words(text)
    terms = [*q.all, *(t for g in q.any for t in g), *(t for p in q.phrases for t in p)]
    x = R.where_given(df, **scope).where(matches(w, q)).withColumn("rank", F.size(F.filter(w, lambda v: v.isin(terms) if terms else F.lit(False))) / (1 + F.log(1.0 + F.size(w))))
    x = x.withColumn("rank", F.round("rank", 6)).orderBy(F.desc("rank"), key)
    return x.limit(k) if k is not None else x


def fuzzy_names(symbols: DataFrame, query: str, k: int | None = 50, least: float = FUZZY, **scope: str | None) -> DataFrame:
    """Symbols whose name or qualified name is like the query by trigrams, the greater similarity first."""
    q = T.trigrams(F.lit(query))
    sim = F.greatest(T.set_similarity(T.trigrams("name"), q), T.set_similarity(T.trigrams("qualified_name"), q))
    x = R.where_given(symbols, **scope).withColumn("similarity", F.round(sim, 6)).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id")
    return x.limit(k) if k is not None else x


def gram_postings(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The stored form of names: one row per key and trigram: keys, gram, n (trigrams of the name)."""
    x = df.select(*keys, T.trigrams(name).alias("g"))
    return x.select(*keys, F.size("g").alias("n"), F.explode("g").alias("gram"))


def stored_names(posting: DataFrame, keys: list[str], query: str, least: float = FUZZY) -> DataFrame:
    """Keys whose name is like the query, with similarity, from stored trigrams: only rows of the query's trigrams are read."""
    grams = grams_of(query)
    if not grams:
        return posting.select(*keys).withColumn("similarity", F.lit(0.0)).limit(0)
    x = posting.where(F.col("gram").isin(grams)).groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("shared"))
    x = x.withColumn("similarity", F.round(F.col("shared") / (F.col("n") + len(grams) - F.col("shared")), 6))
    return x.where(F.col("similarity") >= least).select(*keys, "similarity")


def grams_of(text: str) -> list[str]:
    """The trigrams of a driver-side text, as text.trigrams gives them for a column."""
    padded = [f"  {w} " for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return list(dict.fromkeys(w[i : i + 3] for w in padded for i in range(len(w) - 2)))


def names(symbols: DataFrame, query: str, fuzzy: bool = True, k: int | None = 10, **scope: str | None) -> DataFrame:
    """fuzzy_names, or with fuzzy off equality in any case with similarity 1 by name."""
    if fuzzy:
        return fuzzy_names(symbols, query, k, **scope)
    x = R.where_given(symbols, **scope).where(F.lower("name") == query.lower()).withColumn("similarity", F.lit(1.0)).orderBy("name", "id")
    return x.limit(k) if k is not None else x


def nearest_vectors(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """The k nearest rows to one vector among those of its length."""
    v, q = F.col(vector), V.literal(query)
    d = V.cosine_distance(v, q) if metric == "cosine" else V.l2_distance(v, q)
    x = vectors.where(v.isNotNull() & (F.size(v) == len(query))).withColumn("distance", F.round(d, 6))
    return x.where(F.col("distance").isNotNull() & ~F.isnan("distance")).orderBy("distance", key).limit(k)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, k: int = 10, text_weight: float = 0.3, vector_weight: float = 0.7, ranked: DataFrame | None = None, **scope: str | None) -> DataFrame:
    """Full-text rank and cosine similarity of chunks, outer-joined and added by weight; without a vector the text alone.

    ranked: id and rank of the chunks that match, where stored words have given them already.
    """
    chunks = R.where_given(chunks, **scope)
    if ranked is None:
        ranked = full_text(chunks, "id", "content", query, None)
    elif any(v is not None for v in scope.values()):
        ranked = ranked.join(chunks.select("id").distinct(), "id", "left_semi")
    found = ranked.groupBy(F.col("id").alias("chunk_id")).agg(F.max("rank").alias("bm25_score"))
    if vector is None:
        both = found.withColumns({"vector_score": F.lit(0.0), "score": F.lit(text_weight) * F.col("bm25_score")})
    else:
        near = nearest_vectors(vectors.join(chunks.select(F.col("id").alias("chunk_id")).distinct(), "chunk_id", "left_semi"), vector, 2 * k)
        near = near.groupBy("chunk_id").agg(F.max(1 - F.col("distance")).alias("vector_score"))
        both = R.full_outer_scores(found, near, "chunk_id", text_weight, vector_weight)
    return both.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(k)


def similar(seed: str, prints: DataFrame, snippets: DataFrame, terms: list[str], candidates: int | None = 2000, k: int | None = 10, *, symbols: DataFrame | None = None, repo: str | None = None, branch: str | None = None) -> tuple[DataFrame | None, str | None]:
    """Symbols near a seed's sketch within its scope: symbol_id, distance, score; or an error code.

    prints: symbol_id, repo_id, branch_name, language, kind, fingerprint_kind, fingerprint, band0 to band3.
    snippets: symbol_id, text, in which all terms must occur. symbols (symbol_id, kind, language), if given, must hold the
    seed, and candidates whose kind or language there is another than the seed's are left out. repo and branch, if given,
    must be the seed's. None for candidates or k is no limit.
    """
    if not seed.strip():
        return None, "seed_missing"
    at_home = symbols.where(F.col("symbol_id") == seed).limit(1).collect() if symbols is not None else None
    if at_home == []:
        return None, "seed_not_found"
    own = prints.where(F.col("symbol_id") == seed).limit(1).collect()
    if not own:
        return None, "seed_fingerprint_missing"
    s = own[0]
    if s["repo_id"] is None or s["branch_name"] is None:
        return None, "seed_scope_missing"
    if (repo is not None and repo != s["repo_id"]) or (branch is not None and branch != s["branch_name"]):
        return None, "seed_scope_mismatch"
    scope = {c: s[c] for c in ("repo_id", "branch_name", "language", "kind", "fingerprint_kind")}
    met = F.lit(False)
    for i in range(4):
        met = met | (F.col(f"band{i}") == s[f"band{i}"])
    d = F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(s["fingerprint"])))
    x = R.where_given(prints, **scope).where(met & (F.col("symbol_id") != seed)).withColumn("distance", d)
    x = R.first_per(x, ["symbol_id"], "distance")
    if candidates is not None:
        x = x.orderBy("distance", "symbol_id").limit(candidates)
    if at_home:
        same = R.where_given(symbols, kind=at_home[0]["kind"], language=at_home[0]["language"]).select("symbol_id").distinct()
        x = x.join(same, "symbol_id", "left_semi")
    if terms:
        x = x.join(snippets.groupBy("symbol_id").agg(F.max("text").alias("text")), "symbol_id").where(T.all_terms_in(F.array(*[F.lit(t) for t in terms]), "text"))
    x = x.select("symbol_id", "distance", (1 - F.col("distance") / 64.0).alias("score")).orderBy("distance", "symbol_id")
    return (x.limit(k) if k is not None else x), None
