"""Functions, search, graph, pipeline and stream operators on small literal inputs."""

from __future__ import annotations

import base64
import json
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.functions import sketch
from plumbline.functions import text as T
from plumbline.functions import vector as V
from plumbline.operators import extract, graph, indexing, intent, jobs, orchestrator, response, search, stats
from plumbline.operators import relational as R
from plumbline.plans import queries
from plumbline.sources import config, embeddings, files, git
from plumbline.streaming import changes


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("MyApp.Services.UserService.GetUserById"))) == ["my", "app", "services", "user", "service", "get", "by", "id"]
    got = one(spark, T.identifier_tokens(F.lit("class UserService { int id1; var url = parser; }")))
    assert {"user", "service", "url", "parser"} <= set(got) and not {"class", "int", "var", "id", "1"} & set(got)
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def _fnv(token):
    h = sketch.OFFSET
    raw = token.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * sketch.PRIME % (1 << 64)
    return h


def test_sketch(spark):
    known = {"user": 9036332894136256754, "service": -3731265738799406460}
    assert dict(zip(known, sketch.fnv_all(list(known)).view("int64").tolist())) == known
    tokens = ["", "a", "größe", "x" * 300, "\U0001f600z", "user"]
    assert sketch.fnv_all(tokens).tolist() == [_fnv(t) for t in tokens] and sketch.fnv_all([]).tolist() == []
    bags = [["a", "b", "a"], None, [], ["user"], [f"t{i}" for i in range(999)]]
    votes = [sum(1 << i for i in range(64) if b and 2 * sum(_fnv(t) >> i & 1 for t in b) > len(b)) for b in bags]
    assert sketch.simhash_all(bags).view("uint64").tolist() == votes
    df = spark.createDataFrame([(["user", "service", "login"],), (["user", "service", "login"],), (["user", "service", "logout"],), ([],)], "t array<string>")
    fp = [r[0] for r in df.select(sketch.simhash("t")).collect()]
    assert fp[0] == fp[1] != fp[2] and fp[3] == 0
    assert one(spark, sketch.bands(F.lit(0x0001000200030004))) == [4, 3, 2, 1]
    assert one(spark, sketch.hamming(F.lit(1), F.lit(-1))) == 63


def test_trigrams_lines_names(spark):
    assert one(spark, T.trigram_similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)
    assert one(spark, T.line_window(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert one(spark, T.line_window(F.lit(" \n"), F.lit(1), F.lit(1))) is None
    assert one(spark, T.line_count(F.lit(""))) == 0 and one(spark, T.line_count(F.lit("a\n"))) == 2
    assert one(spark, T.normalize_qualified(F.lit(" A.B(int) "))) == "a.b" and one(spark, T.simple_name(F.lit("A.B.C"))) == "C" and one(spark, T.simple_name(F.lit("A."))) == "A."
    assert one(spark, T.canonical_types(F.lit("M(int, string[], Printer)"))) == "M(System.Int32, System.String[], Printer)"
    assert one(spark, T.detect_language(F.lit("bin/run"), F.lit("#!/usr/bin/env node\nx"))) == "JavaScript"
    assert one(spark, T.detect_language(F.lit("a/Rakefile"))) == "Ruby" and one(spark, T.detect_language(F.lit("x.CS"))) == "CSharp" and one(spark, T.detect_language(F.lit("x"))) == "Unknown"


def test_query_vector():
    raw = base64.b64encode(struct.pack("<2f", 1.0, 2.0)).decode()
    assert V.parse_query_vector(raw, 2, " Model ")[:2] == ([1.0, 2.0], "model")
    assert V.parse_query_vector("!!", 2, None)[2] == "query_embedding_invalid_base64"
    assert V.parse_query_vector(raw, 3, None)[2] == "embedding_dims_mismatch"
    assert V.parse_query_vector(None, 3, None)[2] == "query_embedding_missing"
    assert V.parse_query_vector(raw, 5000, None)[2] == "query_embedding_dims_invalid"


def test_intent_and_response():
    assert intent.detect("what calls Login") == "Relations" and intent.parse("what calls Login").incoming
    assert intent.detect("explain the router") == "Documentation" and intent.detect("find UserService") == "Navigation"
    assert intent.detect("find validation logic") == "Search" and intent.detect("similar:abc x") == "Similar"
    p = intent.parse("similar:abc alpha beta")
    assert p.seed == "abc" and p.terms == ["alpha", "beta"]
    assert intent.route(intent.parse("what calls Login"), "Fast") == ["relations", "fast", "rerank"]
    text = response.compact([{"id": str(i), "content": "x" * 1000, "score": 0.126} for i in range(25)])
    out = json.loads(text)
    assert len(out["results"]) <= 10 and sum(len(r.get("content", "")) for r in out["results"]) <= 8000 and len(text.encode()) <= 16384 and out["total"] == 25
    assert len(response.suggestions(intent.parse("token cache"), [{"symbol_name": "A"}])) == 3


def test_search(spark):
    df = spark.createDataFrame([("1", "alpha beta gamma"), ("2", "alpha beta"), ("3", "beta delta"), ("4", None)], "id string, text string")
    ids = lambda q: sorted(r["id"] for r in df.where(search.matches(search.words("text"), search.web_query(q))).collect())
    assert ids("alpha beta") == ["1", "2"] and ids("alpha -gamma") == ["2"] and ids('"beta gamma"') == ["1"] and ids("gamma or delta") == ["1", "3"] and ids("del*") == ["3"]
    p = search.postings(df, "id", {"t": ("text", "B")})
    assert [r["id"] for r in search.weighted(p, "id", ["alpha", "beta"]).collect()] == ["1", "2"]
    prints = spark.createDataFrame([(s, "r", "b", "l", "k", "f", fp, fp & 0xFFFF, 0, 0, 0) for s, fp in (("a", 0), ("b", 1), ("c", 3))], "symbol_id string, repo_id string, branch_name string, language string, kind string, fingerprint_kind string, fingerprint long, band0 int, band1 int, band2 int, band3 int")
    texts = spark.createDataFrame([("b", "Alpha x"), ("c", "beta")], "symbol_id string, text string")
    found, error = search.similar("a", prints, texts, ["alpha"])
    assert error is None and [(r["symbol_id"], r["distance"]) for r in found.collect()] == [("b", 1)]
    assert search.similar("zz", prints, texts, [])[1] == "seed_fingerprint_missing" and search.similar(" ", prints, texts, [])[1] == "seed_missing"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "Calls", "r", 1), ("b", "c", "Calls", "r", 2), ("c", "a", "Calls", "r", 3), ("a", "c", "References", "r", 4)], "source_id string, target_id string, kind string, repo_id string, line long")
    chain = graph.call_chain(e, spark.createDataFrame([("a",)], "symbol_id string"), 3)
    assert sorted((r["symbol_id"], r["depth"]) for r in chain.collect()) == [("a", 0), ("a", 3), ("b", 1), ("c", 2)]
    results = spark.createDataFrame([("a", 0.5, 0), (None, 0.6, 1)], "symbol_id string, score double, ordinal int")
    got = {r["symbol_id"]: r for r in graph.rerank(results, e).collect()}
    assert got["a"]["graph_score"] == pytest.approx(0.2) and got["a"]["score"] == pytest.approx(0.41) and got[None]["score"] == 0.6
    assert stats.hot_symbols(e).where("target_id = 'c'").first()["call_count"] == 1


def test_call_chain_whole(spark, tmp_path):
    walk, flags = [1, 2, 3, 4, 2, 5, 6, 7, 8], "RRRRRRARR"
    lines = [(o, i, p, o, flags[i]) for o in (1, 2) for i, p in enumerate(walk)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    calls = [(str(a), str(b)) for a, b, f in zip(walk, walk[1:], flags) if f == "R"] * 2  # each order has its own edges
    level, want = {"1": 1}, {("1", 0): 1}
    for d in range(1, 6):
        ends = {}
        for a, b in calls:
            if a in level:
                ends[b] = ends.get(b, 0) + level[a]
        level = ends
        want |= {(k, d): n for k, n in ends.items()}
    got = queries.QUERIES["call_chain_whole"](spark, str(tmp_path)).collect()
    assert {(r["symbol_id"], r["depth"]): r["walks"] for r in got} == want and len(got) == len(want)
    assert {d for _, d in want} == {0, 1, 2, 3, 4, 5}


def test_index(spark):
    src = "class A:\n    def run(self, x):\n        return x\n\ndef main():\n    pass\n"
    f = spark.createDataFrame([("r", "b", "s", "a.py", src), ("r", "b", "s", "n.txt", "x"), ("r", "b", "s", "b.go", "type T struct {\nfunc (s *T) Do(a int) {\n")], "repo_id string, branch_name string, commit_sha string, file_path string, content string")
    f = indexing.indexable(f)
    s = indexing.symbols(f)
    assert sorted((r["kind"], r["name"], r["start_line"]) for r in s.collect()) == [("Class", "A", 1), ("Function", "Do", 2), ("Function", "main", 5), ("Method", "run", 2), ("Struct", "T", 1)]
    c = indexing.chunks(s, f, context=0)
    assert {r["content"] for r in c.where("symbol_name = 'main'").collect()} == {"def main():"}
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "5")], "file_path string, digest string")
    assert {(r[0], r[1], r[2]) for r in indexing.tree_diff(old, new).collect()} == {("b", "Modified", None), ("d", "Renamed", "c"), ("e", "Added", None)}


CSHARP = '''using System;
namespace My.Services
{
    /// <summary>Does work.</summary>
    [Serializable]
    public class Outer : Base, IWorker
    {
        private readonly IClock _clock;
        private DateTime _when = DateTime.Now, _then;
        public string Name { get; set; } = "a { b";
        public List<int> Items { get; }
        public Outer(IClock clock, int n = 3) { _clock = clock; Init(n); }
        public class Inner { public void M(int a) { } public T Echo<T>(T x) { return x; } }
        /* } */ public async Task<List<string>> Run(string name)
        {
            var y = new Foo(1);
            if (name == "hello } world") { _clock.Tick(); Work(); }
            return this.Load(y);
        }
        public void Work() => Hidden();
    }
    public interface IWorker { void Work(); }
    public enum Color { Red, Green }
}
'''


def test_csharp_symbols_and_edges(spark):
    got = {s.qualified: s for s in extract.extract("CSharp", CSHARP)}
    o = "My.Services.Outer"
    assert set(got) == {"My.Services", o, f"{o}._clock", f"{o}._when", f"{o}._then", f"{o}.Name", f"{o}.Items", f"{o}.Outer(IClock,System.Int32)", f"{o}.Inner", f"{o}.Inner.M(System.Int32)", f"{o}.Inner.Echo<T>(T)", f"{o}.Run(System.String)", f"{o}.Work()", "My.Services.IWorker", "My.Services.IWorker.Work()", "My.Services.Color"}
    edges = {q: [(k, t) for k, t, _ in s.edges] for q, s in got.items()}
    assert edges[o] == [("Inherits", "Base"), ("Implements", "My.Services.IWorker")] and got[o].documentation == "Does work."
    assert edges[f"{o}._clock"] == [("TypeOf", "IClock")] and edges[f"{o}._when"] == [("TypeOf", "DateTime")] and edges[f"{o}.Name"] == [] and edges[f"{o}.Items"] == [("TypeOf", "List<System.Int32>")]
    assert edges[f"{o}.Outer(IClock,System.Int32)"] == [("TypeOf", "IClock"), ("Calls", "Init")]
    assert edges[f"{o}.Run(System.String)"] == [("Returns", "Task<List<System.String>>"), ("Calls", "_clock.Tick"), ("Calls", f"{o}.Work()"), ("Calls", "Load")] and edges[f"{o}.Work()"] == []
    assert got[f"{o}.Run(System.String)"].literals == ["hello", "world"] and got[f"{o}.Inner.M(System.Int32)"].parent is got[f"{o}.Inner"]
    for broken in ("", "}}}", "class A {", "namespace X; class B { int", 'var s = "', "class A { void M( { }"):
        extract.extract("CSharp", broken)
    f = spark.createDataFrame([("r", "b", "s", "a.cs", CSHARP)], "repo_id string, branch_name string, commit_sha string, file_path string, content string")
    s = indexing.symbols(indexing.indexable(f))
    assert s.count() == len(got) and {r["name"]: r["end_line"] for r in s.collect()}["Run"] == 19
    resolved = {(r["target"], r["step"]) for r in indexing.resolve_edges(indexing.edges_of(s), s, s.limit(0)).collect()}
    assert ("My.Services.IWorker", "batch exact") in resolved and (f"{o}.Work()", "batch exact") in resolved and ("Load", "unresolved") in resolved
    c = {r["symbol_name"]: r for r in indexing.chunks(s, indexing.indexable(f), context=0).collect()}
    assert c[f"{o}.Run(System.String)"]["parent_symbol_name"] == "Outer" and c[f"{o}.Run(System.String)"]["content"].endswith("        }")


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("Python", 'class A:\n    async def run(self,\n            x=")"):\n        pass\n# def no():\ndef f(): pass\n', [("Class", "A", None), ("Method", "run", 'run(self, x=")")'), ("Function", "f", "f()")]),
        ("TypeScript", "export class A<T> {}\nexport async function go<T>(a: T,\n b = 2) {}\nconst h = async (x) => x;\n// function no()\n", [("Class", "A", None), ("Function", "go", "go(a: T, b = 2)"), ("Function", "h", None)]),
        ("Java", "public final class A {\n  @Override public <T> List<Map<String, T>> go(int a,\n    int b) { return new Foo(); }\n}\n", [("Class", "A", None), ("Method", "go", "go(int a, int b)")]),
        ("Go", "type T[K any] struct {\n}\nfunc (s *T) Do(a int) {\n}\n", [("Struct", "T", None), ("Function", "Do", "Do(a int)")]),
        ("Rust", "pub(crate) async fn go<T>(a: T) {}\npub struct S;\n", [("Function", "go", "go(a: T)"), ("Struct", "S", None)]),
    ],
)
def test_declarations(language, text, want):
    assert [(s.kind, s.name, s.signature) for s in extract.extract(language, text)] == want


def test_intents():
    for q, want in {
        "what calls UserService": "Relations", "callers of Login": "Relations", "what does Login call": "Relations", "who uses the cache": "Relations", "dependencies of Parser": "Relations", "classes that Parser is extended by": "Relations", "call graph of Run": "Relations",
        "explain the retry policy": "Documentation", "what is a ledger": "Documentation", "tell me about Router": "Documentation", "example for the parser": "Examples", "show me how to use Cache": "Examples",
        "code that handles token expiry": "Search", "find validation logic": "Search", "token expiry": "Search", "find UserService": "Navigation", "where is login declared": "Navigation", "similar:abc x": "Similar",
    }.items():
        assert intent.detect(q) == want, q
    assert intent.parse("callers of Login").incoming and intent.parse("who uses Cache").incoming and not intent.parse("what does Login call").incoming and not intent.parse("dependencies of Parser").incoming


def _tables(spark):
    symbols = [("1", "UserService", "N.UserService", "Class"), ("2", "Login", "N.UserService.Login", "Method"), ("3", "SignOff", "N.Gate.SignOff", "Method"), ("4", "TokenCache", "N.TokenCache", "Class")]
    cols = "id string, name string, qualified_name string, kind string"
    s = spark.createDataFrame(symbols, cols).withColumns({"repo_id": F.lit("r"), "branch_name": F.lit("b"), "file_path": F.concat("id", F.lit(".cs")), "language": F.lit("CSharp"), "start_line": F.lit(1), "signature": F.col("name")})
    e = spark.createDataFrame([("1", "2", "Calls", "r", 5), ("3", "2", "Calls", "r", 3), ("2", "4", "TypeOf", "r", 1)], "source_id string, target_id string, kind string, repo_id string, line long")
    p = search.postings(s.withColumnRenamed("id", "symbol_id"), "symbol_id", {"name": ("name", "A"), "qualified_name": ("qualified_name", "A")})
    c = spark.createDataFrame([("c1", "who calls login here"), ("c2", "the login of users"), ("c3", "nothing")], "id string, content string").withColumns({"repo_id": F.lit("r"), "branch_name": F.lit("b"), "file_path": F.lit("x.cs"), "language": F.lit("CSharp"), "symbol_name": F.lit(None).cast("string"), "symbol_kind": F.lit(None).cast("string"), "start_line": F.lit(1)})
    prints = spark.createDataFrame([(i, "r", "b", "CSharp", k, "f", fp, fp & 0xFFFF, 0, 0, 0) for i, k, fp in (("1", "Class", 0), ("4", "Class", 1), ("2", "Method", 3))], "symbol_id string, repo_id string, branch_name string, language string, kind string, fingerprint_kind string, fingerprint long, band0 int, band1 int, band2 int, band3 int")
    return orchestrator.Tables(s, e, p, s.select(F.col("id").alias("symbol_id"), F.col("name").alias("snippet")), c, prints)


def test_answers(spark):
    t = _tables(spark)
    rows = lambda q, **how: [(r["id"], r["type"], round(r["score"], 6)) for r in orchestrator.ask(t, q, **how).results.collect()]
    assert rows("find TokenCache") == [("4", "symbol", 1.0)]
    got = orchestrator.ask(t, "what calls Login").results.collect()
    # Two callers in the order of their lines, mixed with their degrees; then chunks about it at half the score of text.
    assert [(r["id"], r["type"]) for r in got[:3]] == [("2", "symbol"), ("3", "caller"), ("1", "caller")] and got[0]["score"] == pytest.approx(0.7 + 0.3 * (1 + 2 * 2) / 20) and {(r["relation"], r["name"]) for r in got[0]["related"]} == {("CalledBy_Calls", "UserService"), ("CalledBy_Calls", "SignOff"), ("TypeOf", "TokenCache")}
    assert [(r["type"], r["score"]) for r in got[3:]] == [("semantic_context", 0.25)] * len(got[3:])
    assert [r["type"] for r in orchestrator.ask(t, "dependencies of Login").results.collect()][0] == "symbol"
    assert rows("login service")[0][0] == "2"
    assert rows("login of users", profile="Hybrid")[0] == ("c2", "code_chunk", 0.5)
    assert rows("similar:1") == [("4", "symbol", round(1 - 1 / 64, 6))] and rows("similar:1 nothing") == []
    errors = {q: orchestrator.ask(t, q, **how).error for q, how in (("similar: ", {}), ("similar:zz", {}), ("similar:3", {}), ("similar:1", {"repo": "other"}))}
    assert list(errors.values())[:3] == ["seed_missing", "seed_not_found", "seed_fingerprint_missing"] and errors["similar:1"] == "seed_scope_mismatch"
    assert rows("find TokenCache", repo="other") == [] and rows("") == []


def test_model_resolution(spark):
    v = spark.createDataFrame([("r", "m1", [1.0, 2.0]), ("r", "m2", [1.0, 2.0, 3.0]), ("q", "m1", [1.0, 2.0])], "repo_id string, model string, vector array<float>")
    r = orchestrator.resolve_model
    assert r(v, 2, configured="M1") == ("m1", None) and r(v, 2, explicit="m2", configured="m1") == (None, "embedding_dims_mismatch")
    assert r(v, 2) == (None, "embedding_model_ambiguous") and r(v, 2, repo_id="q") == ("m1", None) and r(v, 2, explicit="zz") == (None, "embedding_model_not_found") and r(v.limit(0), 2) == (None, "embedding_model_not_found")


def test_edges_cascade(spark):
    cols = "id string, repo_id string, branch_name string, name string, qualified_name string, parent_symbol_id string"
    batch = spark.createDataFrame([("1", "r", "b", "M", "N.C.M(int)", "p"), ("2", "r", "b", "K", "N.C.K()", "p"), ("3", "r", "b", "L", "N.C.L(int)", "q"), ("4", "r", "b", "L", "N.C.L(str)", "q")], cols)
    stored = spark.createDataFrame([("9", "r", "b", "Z", "N.Z", None)], cols)
    e = spark.createDataFrame([("e1", "1", "n.c.k()"), ("e2", "1", "N.Z"), ("e3", "9", "N.C.M"), ("e4", "9", "N.C.L"), ("e5", "1", "Other.K"), ("e6", "1", "Nope")], "edge_id string, source_id string, target string").withColumns({"repo_id": F.lit("r"), "branch_name": F.lit("b")})
    got = {r["edge_id"]: (r["target_id"], r["step"]) for r in indexing.resolve_edges(e, batch, stored).collect()}
    assert got == {"e1": ("2", "batch exact"), "e2": ("9", "stored exact"), "e3": ("1", "batch base"), "e5": ("2", "sibling"), "e6": ("Nope", "unresolved")}


def test_edge_resolution_steps(spark, tmp_path):
    guid = "7d6e996c-4c27-5c10-3590-4e2653a6dd77"
    symbols = [("1", "main", "f", "M", "N.C.M(int)", "p", 1), ("2", "main", "f", "K", "N.C.K()", "p", 1), ("9", "dev", "g", "Z", "N.Z", None, 1), ("8", "dev", "g", "Y", "N.Y(int)", None, 1), ("1", "main", "f", "M", "N.Old", "q", 0)]
    chunks = [("e1", "main", "f", "1", "n.c.k()"), ("e2", "dev", "g", "9", "N.Z"), ("e3", "dev", "g", None, "N.C.M"), ("e4", "dev", "g", "9", "N.Y"), ("e5", "main", "f", "1", "Other.K"), ("e6", "main", "f", None, "Nope"), ("e7", "dev", "g", None, "Nope"), ("e8", "main", "f", "1", guid)]
    at = lambda x, c: x.withColumn("repo_id", F.lit("r")).write.parquet(f"{tmp_path}/{c}.parquet")
    at(spark.createDataFrame(symbols, "id string, branch_name string, file_path string, name string, qualified_name string, parent_symbol_id string, indexed_at int"), "symbols")
    at(spark.createDataFrame(chunks, "id string, branch_name string, file_path string, symbol_id string, symbol_name string").withColumn("created_at", F.lit(1)), "code_chunks")
    got = {r["edge_id"]: tuple(r)[1:] for r in queries.QUERIES["edge_resolution_steps"](spark, str(tmp_path)).collect()}
    assert got == {"e1": ("1", "2", "batch exact"), "e2": ("9", "9", "stored exact"), "e3": (None, "1", "batch base"), "e4": ("9", "8", "stored base"), "e5": ("1", "2", "sibling"), "e6": ("1", "Nope", "unresolved"), "e8": ("1", guid, "id")}


def test_jobs_and_upserts(spark):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    t = spark.createDataFrame([("a",), ("b",)], "target_id string")
    j = jobs.enqueue(t, "m", now)
    c = jobs.claim(j, 1, "w", now)
    assert sorted(r["status"] for r in c.collect()) == ["Pending", "Processing"]
    assert {r["status"] for r in jobs.requeue_stale(c, F.lit("2025-01-02").cast("timestamp"), now).collect()} == {"Pending"}
    assert {r["status"] for r in jobs.enqueue(t, None, now).collect()} == {"Blocked"} and jobs.enqueue(t, "m", now, enabled=False).count() == 0
    old, new = spark.createDataFrame([(1, "o")], "k int, v string"), spark.createDataFrame([(1, "n"), (2, "n")], "k int, v string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"], update=True).collect())) == [(1, "n"), (2, "n")]
    assert sorted(map(tuple, R.upsert(old, new, ["k"], update=False).collect())) == [(1, "o"), (2, "n")]
    b = spark.createDataFrame([("q", 1, "x" * 6), ("q", 2, "y" * 6)], "g string, o int, t string")
    assert [r["t"] for r in R.running_budget(b, 8, "t", ["g"], "o").orderBy("o").collect()] == ["x" * 6, "yy"]


def test_embedding_batches():
    def provider(texts):
        if len(texts) > 2 or texts == ["big"]:
            raise embeddings.TooLarge
        return [[float(len(t))] for t in texts]

    assert embeddings.embed(["a", "bb", "big", "cc"], provider) == [[1.0], [2.0], [3.0], [2.0]]
    assert embeddings.embed(["big"], provider) == [None] and embeddings.embed(["a"], lambda t: []) == [None] and embeddings.embed([], provider) == []


def test_sources(spark, tmp_path):
    (tmp_path / "r" / "bin").mkdir(parents=True)
    (tmp_path / "r" / "a.py").write_text("def f():\n")
    (tmp_path / "r" / "bin" / "x.py").write_text("no")
    (tmp_path / "r" / "b.dat").write_bytes(b"\x01\x00\x02")
    got = {r["file_path"]: r["content"] for r in files.tree(spark, str(tmp_path / "r"), "r", "b", "s").collect()}
    assert got == {"a.py": "def f():\n", "b.dat": None}
    big = tmp_path / "big.txt"
    big.write_bytes(bytes(range(97, 123)) * 10)
    parts = files.ranges(spark, spark.createDataFrame([(str(big), 260)], "path string, length long"), size=100, halo=5).orderBy("part").collect()
    assert [(r["start"], len(r["bytes"])) for r in parts] == [(0, 105), (100, 105), (200, 60)]
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"name": "n", "topK": 5, "queries": [{"query": "a", "expectedSymbols": ["S"]}]}))
    assert files.query_set(spark, str(q)).first()["expected_symbols"] == ["S"]
    assert files.glob_patterns(["x", "X"], ["f"], [".cs"]) == ["**/x/**", "**/f", "**/*.cs"]
    with pytest.raises(ValueError):
        config.Settings(profile="Slow")


def test_stream_is_idempotent(spark, tmp_path):
    src, into = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").write.parquet(src)
    for _ in range(2):
        s = spark.readStream.schema("k int, v string").parquet(src)
        changes.index_into(s, into, ["k"], str(tmp_path / "state"), order="v").awaitTermination()
    assert sorted(map(tuple, changes.current(spark, into).collect())) == [(1, "a"), (2, "c")]


def test_stream_rewrites_touched_parts_only(spark, tmp_path):
    src, into = str(tmp_path / "in"), str(tmp_path / "out")
    want = {}
    for n in range(5):
        rows = [(k, f"{n}") for k in ((0, 1, 2) if n == 0 else (n,))]
        want |= dict(rows)
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("k int, v string").parquet(src)
        changes.index_into(s, into, ["k"], str(tmp_path / "state"), order="v", parts=4).awaitTermination()
    assert dict(map(tuple, changes.current(spark, into).collect())) == want
    versions = changes._versions(spark, into)
    assert all(len(v) <= 2 for v in versions.values()) and sum(len(v) for v in versions.values()) <= 8


def test_git(spark, tmp_path):
    repo = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=A B", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\x01\x00")
    run("add", ".")
    run("commit", "-q", "-m", "first\n\nmore")
    (tmp_path / "a.py").rename(tmp_path / "c.py")
    (tmp_path / "d é.py").write_text("y\n")
    run("add", "-A")
    run("commit", "-q", "-m", "second")
    run("branch", "side", "HEAD~1")
    log = git.commits(spark, repo, "main").collect()
    assert [r["commit_message"] for r in log] == ["second", "first\n\nmore"] and log[0]["author_name"] == "A B" and log[0]["author_email"] == "a@b.c"
    heads = {r["name"]: r["head_commit_sha"] for r in git.branches(spark, repo).collect()}
    assert heads == {"main": log[0]["sha"], "side": log[1]["sha"]} and git.branch_exists(repo, "side") and not git.branch_exists(repo, "none")
    assert {tuple(r) for r in git.changes(spark, repo, heads["side"], heads["main"]).collect()} == {("c.py", "Renamed", "a.py"), ("d é.py", "Added", None)}
    assert {r["change"] for r in git.changes(spark, repo, None, heads["side"]).collect()} == {"Added"}
    got = {r["file_path"]: r["content"] for r in git.with_contents(git.tree(spark, repo, heads["side"]), repo).collect()}
    assert got == {"a.py": "x = 1\n", "b.bin": None} and git.tree(spark, repo, "0" * 40).count() == 0


def test_reindex(spark):
    cols = "repo_id string, branch_name string, commit_sha string, file_path string, content string"
    one = spark.createDataFrame([("r", "b", "1", "a.cs", CSHARP), ("r", "b", "1", "b.py", "def f():\n    pass\n"), ("r", "b", "1", "t.md", "text"), ("r", "b", "1", "x.py", "a\x00b")], cols)
    tables, report = indexing.reindex({}, one)
    assert report.first().asDict() | {"symbols": 0, "edges": 0} == {"files": 4, "parsed": 2, "skipped": 1, "failed": 1, "deleted": 0, "symbols": 0, "edges": 0} and report.first()["symbols"] == 17
    tables = {k: spark.createDataFrame(df.collect(), df.schema) for k, df in tables.items()}
    two = spark.createDataFrame([("r", "b", "2", "b.py", "def g():\n    pass\n")], cols)
    gone = spark.createDataFrame([("r", "b", "a.cs")], "repo_id string, branch_name string, file_path string")
    after, report = indexing.reindex(tables, two, gone)
    assert [r["name"] for r in after["symbols"].collect()] == ["g"] and report.first()["deleted"] == 1
    assert {r["file_path"] for r in after["files"].collect()} == {"b.py"} and after["edges"].count() == 0 and after["chunks"].count() == after["entries"].count() == after["fingerprints"].count() == 1


def test_http_embeddings():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, what):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(what).encode())

        def do_GET(self):
            self.answer(200, {"model": "m"})

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
            self.answer(413, {}) if len(texts) > 1 else self.answer(200, [[float(len(t))] for t in texts])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert embeddings.embed(["a", "bb", "ccc"], embeddings.http_provider(url)) == [[1.0], [2.0], [3.0]]
    assert embeddings.http_state(url) == (True, {"model": "m"})
    server.shutdown()
    server.server_close()
    assert embeddings.http_state(url)[0] is False and embeddings.embed(["a"], embeddings.http_provider(url, 1)) == [None]


def test_small_sources(spark, tmp_path):
    raw = base64.b64encode(struct.pack("<2f", 1.0, 2.0)).decode()
    df = spark.createDataFrame([(raw,), ("!!",), (None,), (" ",)], "t string")
    assert [r[0] for r in df.select(V.decoded("t")).collect()] == [[1.0, 2.0], None, None, None]
    assert config.load(argv=["run", "--context-lines", "2", "--profile=Hybrid", "--other", "x"]) == config.Settings(context_lines=2, profile="Hybrid")
    (tmp_path / "a" / "bin").mkdir(parents=True)
    (tmp_path / "a" / "x.cs").write_text("x")
    (tmp_path / "a" / "bin" / "y.dll").write_text("y")
    assert files.copy_corpus(str(tmp_path / "a"), str(tmp_path / "b")) == 1 and (tmp_path / "b" / "x.cs").read_text() == "x"
    assert stats.percent(1.0) == "100.0 %"
    with pytest.raises(KeyError):
        stats.refresh(spark, str(tmp_path / "s"), {}, "none")
    with pytest.raises(FileNotFoundError):
        stats.snapshot(spark, str(tmp_path / "s"), "none")


def test_stored_words(spark):
    """Answers from stored words are those from the texts, for every kind of query."""
    rows = [("1", "alpha beta gamma beta"), ("2", "alpha beta"), ("3", "beta delta"), ("4", None), ("5", "Gamma, beta-alpha"), ("6", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    p = search.word_postings(df, ["id"], "text")
    for q in ("alpha beta", "alpha -gamma", '"beta gamma"', "gamma or delta", "del*", '"beta alpha" gam*', "nothing", "alpha or zeta beta"):
        parsed = search.web_query(q)
        want = {r["id"]: r["rank"] for r in search.full_text(df, "id", "text", parsed, None).collect()}
        assert {r["id"]: r["rank"] for r in search.stored_matches(p, ["id"], parsed, df).collect()} == want, q
    with pytest.raises(ValueError):
        search.stored_matches(p, ["id"], search.web_query("-alpha"))
    totals = df.where("text is not null").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(search.words("text"))).alias("mean"))
    whole = {r["id"]: r["score"] for r in search.bm25(df.where("text is not null"), "id", "text", ["beta", "delta"]).collect()}
    assert {r["id"]: r["score"] for r in search.stored_bm25(p, totals, "id", ["beta", "delta"]).collect()} == whole


def test_stored_trigrams(spark):
    df = spark.createDataFrame([("1", "LedgerMixer"), ("2", "ledger"), ("3", "Other one"), ("4", None), ("5", "")], "id string, name string")
    p = search.gram_postings(df, ["id"], "name")
    for q in ("LedgerMixer", "ledger mixer", "other", "zz", "", "--"):
        want = {r["id"]: r["s"] for r in df.select("id", F.round(T.trigram_similarity("name", F.lit(q)), 6).alias("s")).where("s >= 0.3").collect()}
        assert {r["id"]: r["similarity"] for r in search.stored_names(p, ["id"], q).collect()} == want, q
