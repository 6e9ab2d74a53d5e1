"""Hierarchies against a walk in plain Python, with the defined edge cases."""

from __future__ import annotations

import random

import pytest

from plumbline.operators import hierarchy as H

SCHEMA = "id string, parent string, name string, at int, depth string, root string"


def brute(rows):
    last = {}
    for i, p, n, at, *_ in rows:
        if i is None or not i.strip():
            continue
        k = i.strip().lower()
        p = (p or "").strip().lower() or None
        if k not in last or (at, i.strip(), p or "", n or "") > last[k][0]:
            last[k] = ((at, i.strip(), p or "", n or ""), i.strip(), p)
    parent = {k: v[2] for k, v in last.items()}
    out = {}
    for k in parent:
        seen, x = [], k
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            ring = seen[seen.index(x) :]
            out[last[k][1]] = (last[min(ring)][1], -1 if k in ring else -2)
        else:
            out[last[k][1]] = (last[seen[-1]][1], len(seen) - 1)
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["node_id"]: r for r in H.resolve(df, "id", "parent", "name", "at", **how).collect()}


CASES = [
    ("a", None, "A", 1, "x", "y"), ("b", "A", "B", 1, None, None), ("c", "b", None, 1, "x", "y"), ("b", "A", "B", 1, "x", "y"),
    ("d", "gone", "D", 1, "x", "y"), ("e", " ", "E", 1, "x", "y"), ("f", "f", "F", 1, "x", "y"), ("g", "h", "G", 1, "x", "y"), ("h", "i", "H", 1, "x", "y"),
    ("i", "g", "I", 1, "x", "y"), ("j", "h", "J", 1, "x", "y"), ("k", "j", "K", 1, "x", "y"), (None, "a", "N", 1, "x", "y"), ("  ", "a", "N", 1, "x", "y"), ("m", "a", "old", 1, "x", "y"), ("m", "c", "new", 2, "x", "y"),
]


def test_cases(spark):
    got = run(spark, CASES, ancestors=True)
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == brute(CASES)
    assert got["m"]["path"] == "A/B/c/new" and got["m"]["ancestors"] == ["a", "b", "c"]
    assert got["g"]["path"] is None and got["g"]["ancestors"] is None
    pairs = H.descendants(H.resolve(spark.createDataFrame(CASES, SCHEMA), "id", "parent", None, "at", paths=False, ancestors=True))
    assert {(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in pairs.collect() if r["ancestor_id"] == "a"} == {("a", "b", 1), ("a", "c", 2), ("a", "m", 3)}


def test_empty(spark):
    assert run(spark, []) == {}


def test_hot_parent_is_salted(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT_CHILDREN", 5)
    rows = [("r", None, "r", 1, "", "")] + [(f"c{i}", "r", "c", 1, "", "") for i in range(60)] + [(f"d{i}", "c1", "d", 1, "", "") for i in range(3)]
    assert {k: (r["root_id"], r["depth"]) for k, r in run(spark, rows).items()} == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest(spark, seed):
    r = random.Random(seed)
    rows = [(f"n{i}", r.choice([None, f"N{r.randrange(80)}", f"n{r.randrange(90)}"]), "x", r.randrange(3), "", "") for i in [r.randrange(80) for _ in range(120)]]
    assert {k: (x["root_id"], x["depth"]) for k, x in run(spark, rows).items()} == brute(rows)


def brute_pairs(rows):
    last = {}
    for i, p, _, at, *_ in rows:
        if i and i.strip():
            last[i.strip().lower()] = max(last.get(i.strip().lower(), (-1, "", "")), (at, i.strip(), (p or "").strip().lower()))
    out = set()
    for k in last:
        seen, x = [k], last[k][2]
        while x in last and x not in seen:
            out.add((last[x][1], last[k][1], len(seen)))
            seen.append(x)
            x = last[x][2]
    return out


@pytest.mark.parametrize("seed", [0, 3, 4])
def test_descendants_on_and_below_cycles(spark, monkeypatch, seed):
    monkeypatch.setattr(H, "HOT_CHILDREN", 3)
    r = random.Random(seed)
    rows = [(f"n{i}", r.choice([None, *[f"N{r.randrange(70)}"] * 5]), "x", r.randrange(3), "", "") for i in [r.randrange(70) for _ in range(110)]] if seed else CASES
    x = H.resolve(spark.createDataFrame(rows, SCHEMA), "id", "parent", None, "at", paths=False, ancestors=True)
    got = [tuple(p) for p in H.descendants(x).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    if not seed:
        assert {("j", "k", 1), ("h", "k", 2), ("i", "k", 3), ("g", "k", 4), ("h", "i", 2)} <= set(got)
        assert {p["node_id"]: p["cycle"] for p in x.where("depth = -1").collect()} == {"f": [], "g": ["i", "h"], "h": ["g", "i"], "i": ["h", "g"]}


def shuffled(spark, run):
    """What run gives, and the rows that were shuffled for it; no join is broadcast, as with large tables."""
    bus, store, jvm = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def so_far():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = so_far()
        got = run()
        return got, sum(n for k, n in so_far().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_long_chains_do_not_shuffle_their_edges_at_each_level(spark):
    rows = [(f"w{i}", None if i < 50 else f"w{i % 50}", "w", 1, "", "") for i in range(900)] + [(f"c{j}x{i}", f"c{j}x{i - 1}", "c", 1, "", "") for j in range(8) for i in range(24)]
    got, n = shuffled(spark, lambda: run(spark, rows, paths=False))
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == brute(rows)
    assert n < 9 * len(rows), n


def test_short_cycles_take_few_rounds_and_leave_the_trees_alone(spark):
    ring = lambda j: [(f"r{j}x{i}", f"r{j}x{(i + 1) % 3}", "r", 1, "", "") for i in range(3)] + [(f"t{j}", f"r{j}x0", "t", 1, "", "")]
    rows = [(f"w{i}", None if i < 50 else f"w{i % 50}", "w", 1, "", "") for i in range(400)] + [x for j in range(100) for x in ring(j)]
    got, n = shuffled(spark, lambda: run(spark, rows, paths=False))
    assert {k: (r["root_id"], r["depth"]) for k, r in got.items()} == brute(rows)
    assert n < 15 * len(rows), n


@pytest.mark.parametrize("tail, ring", [(0, 1), (0, 11), (1, 1), (9, 2), (17, 5), (3, 16), (33, 1)])
def test_rounds_suffice_for_long_ways_into_cycles(spark, monkeypatch, tail, ring):
    monkeypatch.setattr(H, "HOT_CHILDREN", 5)
    rows = [(f"{(i * 7) % ring:02d}", f"{((i + 1) * 7) % ring:02d}", "r", 1, "", "") for i in range(ring)] + [(f"a{i:02d}", f"a{i + 1:02d}" if i + 1 < tail else "00", "t", 1, "", "") for i in range(tail)]
    rows += [(f"leaf{i}", "00", "x", 1, "", "") for i in range(20)]
    assert {k: (r["root_id"], r["depth"]) for k, r in run(spark, rows, paths=False).items()} == brute(rows)
