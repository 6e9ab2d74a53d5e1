"""The training-data operators against brute force, round trips and hand-written cases."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import abuse, doc_pairs, mixing, neardup, neighbours, packing, rank_fusion, source_filter, splitting, tokens

# -- 2: rankings ---------------------------------------------------------------------------------------------


def normal_quantile(p):
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def test_inverse_normal(spark):
    ps = [1e-13, 1e-9, 0.0001, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.98, 0.9999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", rank_fusion.inverse_normal(F.col("p")).alias("q")).collect()
    for r in got:
        assert r["q"] == pytest.approx(normal_quantile(r["p"]), abs=1e-13)


def test_fusion_against_brute_force(spark):
    r = random.Random(3)
    rows = [(q, f"L{k}", f"i{r.randrange(12)}", r.choice([None, float("nan"), r.randrange(-4, 4) * 10.0 ** k, 0.0, -0.0])) for q in (1, 2) for k in range(4) for _ in range(14)]
    rows += rows[:5] + [(None, "L0", "x", 1.0), (1, "L0", None, 1.0)]
    best = {}
    for q, l, i, v in rows:
        if q is not None and i is not None:
            v = None if v is None or v != v else v + 0.0
            old = best.get((q, l, i))
            best[q, l, i] = v if old is None else old if v is None else max(old, v)
    want = {}
    for q in (1, 2):
        items = sorted({i for a, _, i in best if a == q})
        score = collections.Counter()
        for k in range(4):
            vs = [best.get((q, f"L{k}", i)) for i in items]
            lows = [-1e300 if v is None else v for v in vs]
            for i, v in zip(items, lows):
                rank = sum(x < v for x in lows) + (sum(x == v for x in lows) + 1) / 2
                score[i] += normal_quantile((rank - 0.5) / len(items)) / 4
        want[q] = sorted(items, key=lambda i: (-round(score[i], 6), i))
    df = spark.createDataFrame(rows, "query int, list string, item string, value double")
    got = rank_fusion.fuse(df, {f"L{k}": 1.0 for k in range(4)}).orderBy("query", "place").collect()
    for q in (1, 2):
        assert [x["item"] for x in got if x["query"] == q] == want[q]
    assert rank_fusion.fuse(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "A", "x", 5.0), (1, "A", "y", None)], df.schema)
    assert [x["item"] for x in rank_fusion.fuse(one, k=1).collect()] == ["x"]


# -- 3: files ------------------------------------------------------------------------------------------------

HEADS = {
    "gen": ("src/A.cs", "CSharp", 2000, 60, "// <auto-generated>\n//  by a tool\nclass A\n{\n    int x;\n}\n"),
    "about": ("src/Writer.cs", "CSharp", 2000, 60, '// Writes the banner "do not edit" into the files.\nclass A\n{\n}\n'),
    "scratch": ("src/B.cs", "CSharp", 2000, 60, "// Unlike libx, this was written from scratch; nothing is copied from upstream.\nclass B\n{\n}\n"),
    "own": ("src/C.cs", "CSharp", 2000, 60, "// Copyright (c) 2024 the core team of this repository. All rights reserved.\nclass C\n{\n}\n"),
    "copied": ("src/D.cs", "CSharp", 2000, 60, "// Snapshot of libx 1.2 as shipped; bugs go to its own tracker.\nclass D\n{\n}\n"),
    "copied2": ("src/d.py", "Python", 2000, 60, "#!/usr/bin/env python\n# Snapshot of other-lib 0.9.1 as shipped; bugs go to its own tracker.\nclass D:\n    pass\n"),
    "talks": ("src/Talk.cs", "CSharp", 2000, 60, "// Reports bugs of a snapshot to the tracker that shipped it.\nclass T\n{\n}\n"),
    **{f"v{i}": (f"third_party/lib{i}/v.cs", "CSharp", 2000, 60, f"// Snapshot of lib{i} {i}.0 as shipped; bugs go to its own tracker.\nclass V\n{{\n}}\n") for i in range(5)},
    "prose": ("src/p.md", "Markdown", 90000, 1, "word other " * 300),
    "vendor": ("a/node_modules/x/y.ts", None, None, None, None),
    "notvendor": ("src/vendor_portal/y.ts", "TypeScript", 900, 30, "export class A {\n    run() {\n    }\n}\n"),
    "lock": ("package-lock.json", "JSON", 900, 30, "{\n}"),
    "min": ("src/x.js", "JavaScript", 90000, 1, "!function(){" + "var a=b(c,1);" * 30),
    "minhead": ("web/y.js", "JavaScript", 90000, 2, None),
    "big": ("src/Big.java", "Java", 900000, 30000, "public class Big {\n    int x;\n}\n"),
    "longline": ("src/L.cs", "CSharp", 9000, 200, 'class N { const string A = "' + "word other " * 28 + '"; }\n'),
    "bytes": ("src/t.go", "Go", 90000, 2000, "var t = []byte{\n" + "  0x1f, 0x2e, 0x3d, 0x4c, 0x5b,\n" * 10),
    "rows": ("src/r.py", "Python", 90000, 2000, "rows = [\n" + '  ("trace", 76973, 10382),\n' * 12),
    "blob": ("src/b.py", "Python", 90000, 2000, "BLOB = (\n" + ('  "' + "Ab3/" * 19 + '"\n') * 5),
    "few": ("src/f.py", "Python", 900, 30, "rows = [(1, 2), (3, 5)]  # expected values\nclass A:\n    def run(self):\n        return 1\n"),
    "odd": ("src/o.js", "JavaScript", 5, 900, "import { A } from './a';\n\nexport class B {\n    run(x) {\n        return x;\n    }\n}\n"),
    "empty": (None, None, None, None, ""),
}


def test_source_filter(spark):
    f = spark.createDataFrame([(k, v[0], v[1], v[2], v[3], "x") for k, v in HEADS.items()] * 2, "id string, file_path string, language string, size_bytes long, line_count int, head string")
    h = spark.createDataFrame([(k, v[4]) for k, v in HEADS.items() if v[4] is not None] * 2, "file_id string, head string")
    got = sorted(r[0] for r in source_filter.not_written(f, h).collect())
    assert got == sorted(["gen", "copied", "copied2", *(f"v{i}" for i in range(5)), "vendor", "lock", "min", "minhead", "bytes", "rows", "blob"])
    assert source_filter.written(f, h).count() == len(HEADS) - len(got)
    assert source_filter.not_written(f.limit(0), h).count() == 0 and source_filter.not_written(f, h.limit(0)).count() == 9
    why = {r["reason"]: r["files"] for r in source_filter.reasons(f, h).collect()}
    assert why == {None: len(HEADS) - len(got), "data": 3, "minified": 2, "lock file": 1, "third party path": 6, "generated banner": 1, "shared banner": 2}


def test_layout_alone_and_whole_heads(spark):
    """Statistics decide before any name does, and a banner at the end of a long opening comment counts."""
    long = "".join(f"// line {i} of a long notice\n" for i in range(300)) + "// Code generated by some tool. DO NOT EDIT.\npackage x\n"
    rows = [("vendor/a.js", "!function(){" + "var a=b(c,1);" * 30, "minified"), ("vendor/b.go", "var t = []byte{\n" + "  0x1f, 0x2e, 0x3d,\n" * 10, "data"), ("src/c.go", long, "generated banner")]
    f = spark.createDataFrame([(str(i), p, None, None, None) for i, (p, _, _) in enumerate(rows)], "id string, file_path string, language string, size_bytes long, line_count int")
    h = spark.createDataFrame([(str(i), t) for i, (_, t, _) in enumerate(rows)], "file_id string, head string")
    assert {r["file_id"]: r["reason"] for r in source_filter.judge(f, h).collect()} == {str(i): r for i, (_, _, r) in enumerate(rows)}


# -- 4: documentation ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,name,good",
    [
        ("Called by the loop once per leaf;\nmust not block for longer than 14 ms.", "Go", True),
        ("Works only once. Idempotent: a second call\n   for the same falcon changes nothing.", "Go", True),
        ("Settles the volley cluster.", "SettleVolleyCluster", False),
        ("Verifys the matrix station.", "verify_matrix_station", False),
        ("The sort meadow method.", "SortMeadow", False),
        ("TODO: document", "A", False), ("n/a", "A", False), ("...", "A", False), ("-----", "A", False), ("@param\n@return", "A", False), ("<summary></summary>", "A", False), ("FIXME add docs", "A", False),
        ("// if (a == b)\n// {\n//     c.d();\n// }", "A", False), ("// var x = await _a.B(c, d);", "A", False), ("# ======\n# helpers\n# ======", "A", False),
        ("// Copyright (c) 2021 the team.\n// Use of this file is governed by the LICENSE.", "A", False),
        ("Devuelve el más reciente y descarta los que ya no tienen.", "A", True), (None, "A", False), (" ", "A", False),
    ],
)
def test_describes(text, name, good):
    assert (doc_pairs.describes(text, name) is not None) == good


def test_capture():
    cs = 'int Other() { }\n\n    /// <summary>Keeps "{" and } in step.</summary>\n    [Pure]\n    public int Run(string s = ")")\n    {\n        var x = "}"; // }\n        if (x) { }\n    }\n\n    /// Next one.\n    void Next() { }\n'
    code, doc = doc_pairs.capture(cs, "public int Run(string s = \")\")", "C.Run", False)
    assert code.startswith("    [Pure]") and code.endswith("    }") and "Next" not in code and 'Keeps "{"' in doc
    py = 'x = run(1)\n# of another\n\n    @retry(3)\n    def run(self, a=")"):\n        """Walks up.\n        Stops."""\n        return 1\n\n    def other(self):\n        pass\n'
    code, doc = doc_pairs.capture(py, 'def run(self, a=")")', "C.run", True)
    assert code.startswith("    @retry") and "other" not in code and doc.startswith("Walks up.")
    assert doc_pairs.capture("// Licence\n\nvoid Go() { }", "void Go()", "Go", False)[1] == ""
    assert doc_pairs.capture(None, None, None, False) is None
    long = "/** Says much. */\nvoid go() {" + "a();{}" * 20000 + "}"
    assert doc_pairs.capture(long, "void go()", "go", False)[0].endswith("}")


@pytest.mark.parametrize(
    "body",
    [
        'var p = @"C:\\"; var q = @"a ""}"" b";', 'var p = $@"{x}\\";', 'var s = """\n  } " }\n""";', 'let s = r"\\}"; let t = r#"a " } "#;', "let s = `a ${f({b: `}`})} }`;", "var c = '}'; // }\n /* } */",
    ],
)
def test_capture_protects_strings(body):
    """Braces in strings of any kind end no body."""
    text = "/// Says what it does to the ledger.\npublic void Run(int a)\n{\n    " + body + "\n    end();\n}\n// after\n"
    code, doc = doc_pairs.capture(text, "public void Run(int a)", "Run", False)
    assert code.endswith("end();\n}") and "ledger" in doc


def test_capture_long_generics():
    kinds = ", ".join(f"Argument{i}" for i in range(40))
    code, doc = doc_pairs.capture(f"// Folds all its arguments.\npublic void Fold<{kinds}>(int a) {{ }}\n", None, "Fold", False)
    assert code.endswith("{ }") and "Folds" in doc


def test_pairs(spark):
    rows = [("1", "Method", "CSharp", "A.Go", "void Go()", "/// Walks the tree upwards.\nvoid Go() { }", " "), ("2", "Class", "CSharp", "A", "class A", "/// Walks the tree.\nclass A { }", "Walks the tree."), ("3", "Unknown", None, "Go", "func Go()", "func Go() { }", "Walks the tree."), (None, "Method", "Go", "Go", None, None, "x y z"), ("4", "Function", "Go", None, None, None, None)]
    df = spark.createDataFrame(rows * 2, "id string, symbol_kind string, language string, symbol_name string, signature string, content string, documentation string")
    assert {(r["chunk_id"], r["source"]) for r in doc_pairs.pairs(df).collect()} == {("1", "content"), ("3", "column")}
    assert sorted(r[0] for r in doc_pairs.described(df).collect()) == ["1", "3"] and doc_pairs.pairs(df.limit(0)).count() == 0


# -- 5: splitting --------------------------------------------------------------------------------------------


def _class(n, lines, crlf=False):
    out = ["using A.B;", "", "public sealed class C", "{"]
    for i in range(n):
        out += ["    /// Says what it does.", "    [Pure]", f"    public int M{i}(int a)", "    {"] + [f"        Call{i}(a, {j});" for j in range(lines)] + ["    }", ""]
    return ("\r\n" if crlf else "\n").join(out[:-1] + ["}"])


SPLIT = "id string, symbol_kind string, signature string, content string, chunk_start_line int, item string"


@pytest.mark.parametrize("size", [97, 1 << 16])
def test_pieces(spark, size):
    texts = {"c": _class(9, 10), "crlf": _class(7, 8, True), "big": _class(2, 60), "line": "x" * 2500, "flat": "\n".join(f"a{i}" for i in range(600)), "short": "a\nb"}
    rows = [(k, "Class", "class C", v, 11, "x") for k, v in texts.items()] * 2 + [(None, "Class", "", "y" * 5000, 1, ""), ("null", "Class", "", None, 1, "")]
    df = spark.createDataFrame(rows, SPLIT)
    got = splitting.pieces(df, 1000, 3, size=size).toPandas()
    assert set(got.chunk_id) == set(texts) - {"short"} and got.content.str.len().max() <= 1000
    for k, g in got.groupby("chunk_id"):
        g = g.sort_values("piece")
        assert "".join(c[o:] for c, o in zip(g.content, g.overlap_chars)) == texts[k]
        lines = texts[k].split("\n")
        for r in g.itertuples():
            assert r.content[r.overlap_chars :].split("\n")[0] in lines[r.start_line - 11]
    c = got[got.chunk_id == "c"].sort_values("piece")
    assert all(x[o:].startswith("    /// Says") for x, o in list(zip(c.content, c.overlap_chars))[1:])
    assert all(x[:o].count("\n") == 3 for x, o in list(zip(c.content, c.overlap_chars))[1:])


def test_file_pieces(spark, tmp_path):
    """A file over many byte ranges gives the pieces that its text as one cell gives, and comes back byte by byte."""
    text = _class(60, 12) + "\n" + "z" * 5000 + "\nend é\n"
    raw = text.encode()
    (tmp_path / "big.cs").write_bytes(raw)
    (tmp_path / "small.cs").write_bytes(b"a\nb\n")
    paths = spark.createDataFrame([(f"{tmp_path}/big.cs", len(raw)), (f"{tmp_path}/small.cs", 4), (f"{tmp_path}/big.cs", len(raw)), (None, 5000)], "path string, length long")
    got = splitting.file_pieces(paths, 1000, 3, size=512).toPandas().sort_values("piece")
    assert b"".join(bytes(c)[o:] for c, o in zip(got.content, got.overlap_chars)) == raw and set(got.path) == {f"{tmp_path}/big.cs"}
    cell = splitting.pieces(spark.createDataFrame([("c", "Class", "class C", text, 1, "")], SPLIT), 1000, 3, size=701).toPandas().sort_values("piece")
    same = len(cell) - 3  # the last ones hold the letter of two bytes or follow the long line
    assert got.start_line.tolist()[:same] == cell.start_line.tolist()[:same] and len(got) == len(cell)


def test_long_items_are_cut_in_linear_time(spark):
    """40,000 lines in one item: the stitching windows stream over them."""
    text = _class(4000, 6)
    got = splitting.pieces(spark.createDataFrame([("c", "Class", "class C", text, 1, "")], SPLIT), 2000, 3).toPandas().sort_values("piece")
    assert "".join(c[o:] for c, o in zip(got.content, got.overlap_chars)) == text


def test_member_cuts(spark):
    text = _class(5, 10)
    df = spark.createDataFrame([("c", "Class", "class C", text, 11, ""), ("big", "Class", "class C", _class(2, 60), 1, ""), ("fn", "Method", "int M()", text, 1, "")] * 2, SPLIT)
    got = sorted(tuple(r) for r in splitting.member_cuts(df, 700, 3).collect())
    lines = text.split("\n")
    starts = [11 + i for i, x in enumerate(lines) if x.startswith("    /// ")]
    assert [r[0] for r in got] == ["c"] * len(got) and {r[1] for r in got} == {starts[2], starts[4]}
    assert splitting.member_cuts(df.limit(0), 700, 3).count() == 0


# -- 6: neighbours -------------------------------------------------------------------------------------------


def test_neighbours_recall(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((60, 16))
    x = (base[r.integers(0, 60, 900)] + 0.4 * r.standard_normal((900, 16))).astype(np.float32)
    rows = [(f"v{i:04d}", "m", [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [("nan", "m", [float("nan")] * 16), ("zero", "m", [0.0] * 16), ("cut", "m", [1.0] * 9), ("null", "m", None), ("hole", "m", [1.0] * 15 + [None]), ("nomodel", None, [1.0] * 16), (None, "m", [1.0] * 16), ("alone", "other", [1.0] * 16)]
    df = spark.createDataFrame(rows + rows[:20] + bad, "id string, model string, vector array<float>")
    u = neighbours.usable(df, {}, 16)
    assert u.count() == 901
    got = neighbours.nearest(u, 5, sample=400, part=100, probes=(3, 6, 0.95), block=64)
    near = {k: set(g["near"]) for k, g in got.toPandas().groupby("id")}
    unit = neighbours._unit(x.astype(float))
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    truth = np.argsort(-sims, axis=1)[:, :5]
    recall = np.mean([len({f"v{j:04d}" for j in t} & near[f"v{i:04d}"]) / 5 for i, t in enumerate(truth)])
    assert recall >= 0.9 and "alone" not in near
    # Split over several levels, until a cell is a block; and asked for everywhere, which is brute force.
    deep = dict(sample=200, part=10, fan=6, block=64)
    assert neighbours.cells(u, **deep).selectExpr("max(size(split(cell, '/'))) as depth").first()["depth"] >= 3
    for probes, least in (((3, 6, 0.95), 0.9), ((6, 6, 1.0), 1.0)):
        near = {k: set(g["near"]) for k, g in neighbours.nearest(u, 5, probes=probes, **deep).toPandas().groupby("id")}
        assert np.mean([len({f"v{j:04d}" for j in t} & near[f"v{i:04d}"]) / 5 for i, t in enumerate(truth)]) >= least
    same = spark.createDataFrame([(f"s{i:03d}", "m", [1.0] * 16) for i in range(150)], "id string, model string, vector array<float>")
    few = neighbours.nearest(neighbours.usable(same, {}, 16), 5, sample=100, part=10, fan=6, block=64).toPandas()
    assert len(few) == 750 and set(few.near) <= {f"s{i:03d}" for i in range(6)}  # equal vectors: ties to the smaller id
    pairs = neighbours.mutual(got, 0.8).collect()
    assert pairs and all(a < b for a, b in pairs)
    assert neighbours.nearest(u.limit(0), 5).count() == 0


# -- 7: near-duplicates --------------------------------------------------------------------------------------


def _docs():
    r = random.Random(5)
    words = [f"w{i}" for i in range(800)]
    out = []
    for i in range(60):
        t = [r.choice(words) for _ in range(r.randrange(30, 90))]
        out.append((f"d{i:03d}", " ".join(t)))
        for j in range(r.randrange(3)):
            e = t[:]
            for _ in range(r.randrange(0, max(2, len(e) // 5))):
                e[r.randrange(len(e))] = r.choice(words)
            if j:
                r.shuffle(e)
            out.append((f"d{i:03d}_{j}", " ".join(e).upper() if j else "  ".join(e)))
    return out + [(None, "a b"), ("blank", "  "), ("nul", None)]


def test_near_duplicates(spark):
    docs = _docs()
    df = neardup.texts(spark.createDataFrame([(a, b, "x") for a, b in docs + docs[:30]], "i string, t string, id string"), "i", "t")
    bags = {i: collections.Counter(re.findall("[a-z0-9_]+", t.lower())) for i, t in docs if i and t and t.strip()}
    want = set()
    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s = sum((bags[a] & bags[b]).values())
            if s / (sum(bags[a].values()) + sum(bags[b].values()) - s) >= 0.7:
                want.add((a, b))
    got = {tuple(r) for r in neardup.pairs(df, 0.7).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    g = {r["id"]: r["group_id"] for r in neardup.groups(df, 0.7).collect()}
    assert set(g) == set(ids) and all(g[a] == g[b] for a, b in got) and all(v <= k for k, v in g.items())
    assert neardup.pairs(df.limit(0)).count() == 0


def test_pairs_of_hot_keys_are_split(spark):
    """Blocks lose and repeat no pair, whatever their size; single members and repeats of a member give none."""
    rows = [("hot", i) for i in range(70)] + [("few", i) for i in (1, 5, 9)] + [("one", 3)] + [("twice", 4), ("twice", 4)]
    df = spark.createDataFrame(rows, "key string, member long")
    want = sorted([(i, j) for i in range(70) for j in range(i + 1, 70)] + [(1, 5), (1, 9), (5, 9)])
    for block in (4, 16, 500):
        assert sorted(tuple(r) for r in neardup.pairs_within(df, block).collect()) == want
    assert neardup.pairs_within(df.limit(0)).count() == 0


def test_words_are_ascii():
    """Only ASCII letters have a case here: the Kelvin sign and the dotted I end words."""
    assert neardup._Bags().elements("ABC") == neardup._Bags().elements("abc")
    assert len(neardup._Bags().elements("a\u212ab")) == 2 and len(neardup._Bags().elements("a\u0130b")) == 2


def test_hot_roots_are_salted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_EDGES", 5)
    edges = [("a", f"n{i:03}") for i in range(90)] + [("x", "y"), ("y", "z")]
    got = {r["id"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"n{i:03}": "a" for i in range(90)}, "a": "a", "x": "x", "y": "x", "z": "x"}


def test_components(spark):
    r = random.Random(2)
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    edges = chain + [(f"m{r.randrange(30):02d}", f"m{r.randrange(30):02d}") for _ in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["id"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# -- 8 and 9: containers and mixes ---------------------------------------------------------------------------


def test_completion_beats_or_meets_best_fit():
    r = random.Random(4)
    for _ in range(20):
        sizes = [r.randrange(5, 60) for _ in range(40)]
        bins = packing.complete(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(40)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 100))
    assert len(packing.complete([6, 5, 4, 3, 3, 3], 12)) == 2 and packing.complete([], 10) == []


@pytest.mark.parametrize("seed", range(12))
def test_unbounded_completion_is_exact(seed):
    from functools import lru_cache

    r = random.Random(seed)
    sizes, capacity = [r.randrange(5, 60) for _ in range(9)], 100

    @lru_cache(None)
    def fewest(left):
        """Containers that the items of a bit mask need at least, by trying all sets around the first of them."""
        if not left:
            return 0
        head = (left & -left).bit_length() - 1
        rest, best, sub = left & (left - 1), 99, left & (left - 1)
        while True:
            if sizes[head] + sum(s for i, s in enumerate(sizes) if sub >> i & 1) <= capacity:
                best = min(best, 1 + fewest(rest & ~sub))
            if not sub:
                return best
            sub = (sub - 1) & rest

    got = packing.complete(sizes, capacity, branches=None, nodes=None, steps=None)
    assert len(got) == fewest((1 << len(sizes)) - 1) and sorted(i for b in got for i in b) == list(range(len(sizes)))


def test_fillings_leave_no_room_for_an_item():
    r = random.Random(8)
    cases = [(9, [5, 3]), (400, [1] * 450), (10_007, sorted((r.randrange(20, 60) for _ in range(500)), reverse=True))]
    cases += [(100, sorted((r.randrange(1, 60) for _ in range(30)), reverse=True)) for _ in range(20)]
    for room, sizes in cases:
        found = packing.fillings(room, sizes, 4)
        assert found
        for f in found:
            left = room - sum(sizes[i] for i in f)
            assert left >= 0 and len(set(f)) == len(f) and all(sizes[i] > left for i in range(len(sizes)) if i not in f)


def test_pack(spark):
    r = random.Random(6)
    sizes = {i: r.choice([1, 7, 33, 90, 250]) for i in range(300)}
    rows = [(i, s, "x") for i, s in sizes.items()] + [(0, 1, "x"), (None, 5, "x"), (998, 0, "x"), (999, None, "x")]
    got = packing.pack(spark.createDataFrame(rows, "item int, size int, container string"), 100, block=64).toPandas()
    assert got.groupby("container")["size"].sum().max() <= 100
    assert got.groupby("item")["size"].sum().to_dict() == {str(k): v for k, v in sizes.items()}
    assert got.groupby("item").size()[[str(k) for k, v in sizes.items() if v <= 100]].max() == 1
    assert got.container.nunique() <= 1.1 * sum(sizes.values()) / 100 + 2
    assert packing.pack(spark.createDataFrame([], "item int, size int"), 100).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 60000)], "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(df, "text", ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and 60000 <= got[4] <= 60010


@pytest.mark.parametrize("kind", ["words", "spaces", "nothing to cut", "digits", "accents"])
def test_token_counts_of_long_texts(kind):
    """Cutting a long text for speed changes no count."""
    r = random.Random(4)
    text = {
        "words": lambda: " ".join("".join(r.choices("abcdefg'’", k=r.randrange(1, 9))) for _ in range(60_000)),
        "spaces": lambda: "".join(r.choices("ab \n\t.", k=250_000)),
        "nothing to cut": lambda: ".x" * 110_000,
        "digits": lambda: "".join(r.choices("12 ", k=220_000)),
        "accents": lambda: "".join(r.choices("äé ß\u00a0x", k=220_000)),
    }[kind]()
    assert len(text) > tokens.STRETCH and tokens.count(text) == len(tokens.encoder().encode_ordinary(text))


def test_mix(spark):
    r = random.Random(7)
    rows = [(i, "big" if i % 3 else "small", r.randrange(1, 400)) for i in range(900)]
    targets = spark.createDataFrame([("big", 0.5, 2), ("Small ", 0.3, 3), ("none", 0.2, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    records = spark.createDataFrame(rows, "id int, source string, tokens long")
    drawn, report = mixing.mix(records, targets)
    rep = {x["source"]: x for x in report.collect()}
    assert rep["none"]["actual_share"] == 0 and abs(rep["big"]["actual_share"] - 0.625) < 0.01 and abs(rep["small"]["actual_share"] - 0.375) < 0.01
    limit = {"big": 2, "small": 3}
    assert all(x["copies"] <= limit[x["source"]] for x in drawn.collect()) and max(x["copies"] for x in drawn.collect()) >= 2
    assert mixing.mix(records.limit(0), targets)[0].count() == 0
    docs = spark.createDataFrame([(2, "A-b", "same text"), (1, " a_B", "same text"), (3, None, "x"), (4, "c", None)], "doc_id int, source string, text string")
    assert [tuple(x)[:2] for x in mixing.sized(docs).collect()] == [(1, "a_b")]


# -- 10: abuse -----------------------------------------------------------------------------------------------


FINE_LINES = ["the cache keeps one row per branch", "we rename the parser before the merge", "indexing took long on the old disk", "this stupid flaky test failed again", "callers get the other node instead"]
INSULTS = ["moron", "idiot", "imbecile", "asshole"]


def _abuse_docs(n, templates, names, every, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [r.choice(FINE_LINES) for _ in range(8)]
        if i % every == 0:
            lines[r.randrange(8)] = r.choice(templates).format(r.choice(names))
        out.append((". ".join(lines), float(i % every == 0)))
    return out


def test_abuse_held_out(spark):
    """Neither the templates nor the spellings of the test are among those that were fitted on."""
    train = _abuse_docs(150, ["you are a {} and everybody knows it", "get lost {} nobody asked you", "listen you {} just leave"], INSULTS, 3, 8)
    m, held = abuse.fit([t for t, _ in train], [v for _, v in train])
    y = np.array([v for _, v in train]) > 0.5
    assert held[y].min() > held[~y].max()
    test = _abuse_docs(80, ["only a {} would write that", "what a {} you must be", "the author is a {}"], ["morron", "1diot", "i d i o t", "imbeciles", "assholle"], 2, 9)
    got, bad = m.scores([t for t, _ in test]), np.array([v for _, v in test]) > 0.5
    assert got[bad].min() > 10 * got[~bad].max()
    assert m.scores([None, "  ", ""]).tolist() == [0, 0, 0]
    long = ". ".join(FINE_LINES * 3000)
    a, b = m.scores([long, long + ". get lost you morrron nobody asked you"])
    assert a < 0.1 and b > 0.9


def test_abuse_threshold():
    """Of a collection with 3 % to be excluded, labelled at 20 % with some errors: the threshold lies in the gap."""
    r = np.random.default_rng(1)
    counts = np.zeros(101, dtype=int)
    counts[[1, 10, 30]], counts[[85, 95]] = (4000, 4000, 1700), (100, 200)
    held, votes = np.concatenate([r.choice([0.85, 0.95], 100), r.choice([0.01, 0.1, 0.3], 400)]), np.repeat([1.0, 0.0], [100, 400])
    votes[[3, 200, 300]] = 1 - votes[[3, 200, 300]]
    assert 0.31 <= abuse.threshold(held, votes, counts) <= 0.85
    # Where nothing excluded is told from the rest, no more is found than the share among the labelled.
    blind = abuse.threshold(np.zeros(500), votes, counts)
    assert counts[int(round(blind * 100)) :].sum() / counts.sum() <= (votes > 0.5).mean()
    assert abuse.threshold(held, votes * 0, counts) == 1.0 and abuse.threshold(held, votes, counts * 0) == 1.0


def test_abuse_tables(spark):
    train = _abuse_docs(120, ["you are a {} and everybody knows it", "get lost {} nobody asked you"], INSULTS, 3, 8)
    docs = spark.createDataFrame([(i, "s-1", t, "x") for i, (t, _) in enumerate(train)] + [(0, "s-1", train[0][0], "y"), (900, None, None, None), (None, "x", "y", None)], "doc_id long, source string, text string, score string")
    labels = spark.createDataFrame([(i, int(v), "r1") for i, (_, v) in enumerate(train)] + [(0, 1, "r1"), (None, 1, "r"), (1, None, "r"), (2, 0, None)], "doc_id long, label int, rater string")
    every = {(r["doc_id"], r["score"] is not None) for r in abuse.scores(docs, labels).collect()}
    assert len(every) == 122 and all(has for _, has in every)
    found = [r["doc_id"] for r in abuse.found(docs, labels).collect()]
    assert len(found) == len(set(found)) and len(set(found) & set(range(0, 120, 3))) >= 36 and len(set(found) - set(range(0, 120, 3))) <= 4
    assert {x["source"] for x in abuse.rates(docs, labels).collect()} == {"s_1", None}
    assert abuse.found(docs.limit(0), labels.limit(0)).count() == 0
    none = abuse.scores(docs, labels.where("label = 0"))
    assert none.where("score is not null").count() == 1 and abuse.found(docs, labels.where("label = 0")).count() == 0


def test_abuse_words():
    """Spaced, leet and stretched spellings fold to one word, identifiers are taken apart, nothing inside code is left out."""
    words = lambda t: [w for w in map(abuse.folded, abuse.tokens(t)) if w]
    assert words("n a k e d") == ["naked"] and words("1d10t") == ["idiot"] and words("sooooo a$$hole") == ["soo", "asshole"]
    assert words("`StupidIdiot` idiot.Go ```you fool```") == ["stupid", "idiot", "idiot", "go", "you", "fool"]
    assert words("see https://x.org/a?b 42") == ["see", "codeword", "0"]
