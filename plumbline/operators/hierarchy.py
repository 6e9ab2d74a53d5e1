"""Parent-child rows to full hierarchies.

Level-wise frontier joins go down from the roots: each level joins the last one's nodes with the edges
that leave them, and so extends root, depth, path and ancestors. Edges that have been followed are dropped each
time half of them are, so that the levels of a few long chains do not read the whole table. Nodes no level
reaches hang on a cycle; there, pointer doubling over the unreached rest finds the cycle each of them runs into.

Defined results:
- rows whose id is null or blank are left out; ids compare without regard to case and outer blanks;
- of several rows of an id the one with the latest order column counts, ties by the greatest row;
- a parent that is null, blank or not among the ids makes a root: depth 0, its own root;
- a node on a cycle (its own parent included) has depth -1, one whose ancestors run into a cycle -2; for
  both the root is the smallest id on that cycle, and path is null, as it has no beginning;
- ancestors of a node of depth -2 are all nodes its parent links lead to, the cycle's first, each once; a node
  of depth -1 has null there, and the other members of its cycle in a column of their own, cycle;
- an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..runtime import cut, cut_counted, drop_path, new_path, partitions

#: A parent counts as hot, and its children are spread over salts, beyond this many children (and a quarter of a partition's even share).
HOT_CHILDREN = 50_000
SALTS = 16
#: A frontier of at most this many nodes is followed over several levels per write; only time depends on it.
SMALL, LEVELS = 20_000, 2


def _key(c: str) -> Column:
    k = F.lower(F.trim(F.col(c).cast("string")))
    return F.when(k != "", k)


def latest_nodes(df: DataFrame, id_col: str, parent_col: str, name_col: str | None, order_col: str | None) -> DataFrame:
    """One row per id: key, id, parent (a key or null), name; the latest by order_col."""
    order = F.col(order_col) if order_col else F.lit(0)
    name = F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")
    rows = df.select(_key(id_col).alias("key"), F.struct(order.alias("o"), F.trim(F.col(id_col).cast("string")).alias("id"), _key(parent_col).alias("parent"), name.alias("name")).alias("row"))
    last = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("row").alias("row"))
    return last.select("key", "row.id", "row.parent", "row.name")


def resolve(df: DataFrame, id_col: str, parent_col: str, name_col: str | None = None, order_col: str | None = None, *, paths: bool = True, ancestors: bool = False, separator: str = "/") -> DataFrame:
    """For each node: node_id, root_id, depth, and with paths path, with ancestors their ids from the root down, and cycle."""
    spark = df.sparkSession
    parts = partitions(spark)
    nodes = latest_nodes(df, id_col, parent_col, name_col, order_col)
    at_nodes, at_parents, at_base = (new_path(spark, what) for what in ("nodes", "parents", "base"))
    nodes, total = cut_counted(nodes if paths else nodes.select("key", "id", "parent"), path=at_nodes)
    # Children are counted per parent before anything is joined on it: a parent of a third of all rows is one row here.
    parents = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).join(nodes.select(F.col("key").alias("parent"), F.lit(True).alias("there")), "parent", "left")
    parents, _ = cut_counted(parents, path=at_parents)
    limit = max(HOT_CHILDREN, total // (4 * parts))  # at most 4 * parts parents can be hot
    big = parents.where(F.col("n") > limit).select("parent", "there").collect() if total > limit else []
    hot = [r["parent"] for r in big if r["there"]]
    gone = [r["parent"] for r in big if not r["there"]]
    missing = parents.where((F.col("n") <= limit) & F.col("there").isNull()).select("parent", F.lit(True).alias("missing"))
    linked = nodes.where("parent is not null").where(~F.col("parent").isin(hot + gone)) if big else nodes.where("parent is not null")
    base = linked.join(missing, "parent", "left").withColumn("parent", F.when(F.col("missing").isNull(), F.col("parent"))).drop("missing").unionByName(nodes.where("parent is null"))
    if big:
        base = base.unionByName(nodes.where(F.col("parent").isin(hot + gone)).withColumn("parent", F.when(F.col("parent").isin(hot), F.col("parent"))))
    base, _ = cut_counted(base, path=at_base)
    drop_path(spark, at_nodes)  # base holds all that is still needed
    drop_path(spark, at_parents)

    # One column links edges and frontier, so that the edges' partitioning and order serve every level's join.
    salted = lambda c, salt: F.when(F.col(c).isin(hot), F.concat_ws("#", c, salt)).otherwise(F.col(c)) if hot else F.col(c)
    spread = lambda c: F.explode(F.when(F.col(c).isin(hot), F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.concat_ws("#", F.col(c), s.cast("string")))).otherwise(F.array(c))) if hot else F.col(c)

    extra: list[str] = (["path"] if paths else []) + (["up"] if ancestors else [])

    def kept(edges: DataFrame, n: int) -> DataFrame:
        """n edges by link, in as many partitions as their share of the table is worth; a lost one is read again from the table."""
        # Two at least: a single one has no partitioning by link that joins could keep, so each would shuffle all edges once more.
        e = edges.repartition(max(2, -(-parts * n // max(total, 1))), "link").sortWithinPartitions("link").persist(StorageLevel.MEMORY_AND_DISK)
        e.count()
        return e

    def descend(start: DataFrame, nodes: DataFrame, what: str, free: str | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Start as level 0, and those of nodes that lie on the levels below it; and key, id and parent of those that do not, or None. The place free holds both at first."""
        e = nodes.where("parent is not null").select(salted("parent", F.pmod(F.hash("key"), F.lit(SALTS)).cast("string")).alias("link"), F.col("key").alias("child"), F.col("id").alias("child_id"), *(["name"] if paths else []), *(["parent"] if hot else []))
        table = new_path(spark, "edges")
        written, have = cut_counted(e, path=table)
        edges, left, into = kept(written, have), have, new_path(spark, what)
        first = start.withColumn("last", F.lit(True))
        frontier, n = cut_counted(first, path=f"{into}/block=0")
        if free:
            drop_path(spark, free)
        schema, level, followed, at = frontier.schema, 0, [], f"{into}/block=0"

        def open_() -> DataFrame:
            """Edges not followed yet: those of the last level are still to come."""
            read = spark.read.schema(schema)
            ends = read.parquet(at).where("not last")
            ends = read.parquet(*followed).unionByName(ends) if followed else ends
            return edges.join(ends.select(spread("key").alias("link")), "link", "left_anti")

        def below(nodes: DataFrame) -> DataFrame:
            # No literal differs from level to level, so that all share their generated code.
            ends = nodes.select(spread("key").alias("link"), "root", "depth", *extra, *([F.col("id").alias("parent_id")] if ancestors else []))
            step = [F.col("child").alias("key"), F.col("child_id").alias("id"), F.col("root"), (F.col("depth") + 1).alias("depth")]
            step += [F.concat(F.col("path"), F.lit(separator), F.coalesce("name", "child_id")).alias("path")] if paths else []
            step += [F.concat(F.col("up"), F.array("parent_id")).alias("up")] if ancestors else []
            return ends.join(edges, "link").select(*step)

        while n and left:
            levels = [below(frontier)]
            for _ in range(1, LEVELS if n <= SMALL else 1):
                levels.append(below(levels[-1]))
            block = levels[-1].withColumn("last", F.lit(True))
            for x in levels[:-1]:
                block = block.unionByName(x.withColumn("last", F.lit(False)))
            level += len(levels)
            followed.append(at)
            at, seen = f"{into}/block={level}", Observation()
            block.observe(seen, F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("last"), 1)).alias("ends")).write.parquet(at)
            frontier, n = spark.read.schema(schema).parquet(at).where("last"), seen.get["ends"]
            left -= seen.get["all"]
            if n and 0 < 2 * left <= have:
                former, table = table, new_path(spark, "edges")
                written, have = cut_counted(open_(), path=table)
                edges.unpersist()
                drop_path(spark, former)
                edges, followed = kept(written, have), []
        # Taken from the edges, which have all that is needed: the nodes need not be joined, and so shuffled, to find a few of them.
        rest = cut(open_().select(F.col("child").alias("key"), F.col("child_id").alias("id"), F.col("parent" if hot else "link").alias("parent")), "unreached") if left else None
        edges.unpersist()
        return spark.read.schema(schema).parquet(into), rest

    start = [F.col("key"), F.col("id"), F.col("id").alias("root"), F.lit(0).alias("depth")]
    start += [F.coalesce("name", "id").alias("path")] if paths else []
    start += [F.array().cast("array<string>").alias("up")] if ancestors else []
    reached, rest = descend(base.where("parent is null").select(*start), base, "levels", at_base)

    cyclic = _cycles(rest) if rest is not None else spark.createDataFrame([], "key string, id string, parent string, root string, depth int")
    no_path = [F.lit(None).cast("string").alias("path")] if paths else []
    if ancestors:
        cyclic = cut(cyclic.withColumn("name", F.lit(None).cast("string")), "cyclic")
        rings = _rings(cyclic.where("depth = -1")).select("key", "id", "root", F.lit(0).alias("depth"), *no_path, "up")
        under, _ = descend(rings, cyclic.where("depth = -2"), "below")
        on = F.col("depth") == 0
        cyclic = under.select("id", "root", F.when(on, -1).otherwise(-2).alias("depth"), *no_path, F.when(~on, F.col("up")).alias("up"), F.when(on, F.col("up")).alias("cycle"))
        reached = reached.withColumn("cycle", F.lit(None).cast("array<string>"))
    else:
        cyclic = cyclic.select("id", "root", "depth", *no_path)
    names = {"path": "path", "up": "ancestors", "cycle": "cycle"}
    both = reached.drop("key", "block", "last").unionByName(cyclic)
    return both.select(F.col("id").alias("node_id"), F.col("root").alias("root_id"), "depth", *[F.col(c).alias(names[c]) for c in [*extra, *(["cycle"] if ancestors else [])]])


def _cycles(lost: DataFrame) -> DataFrame:
    """Of nodes whose ancestors never end: key, id, parent, root (the smallest id on the cycle), depth -1 on it and -2 off it."""
    # After k rounds `to` is 2**k links up and `least` the smallest of the 2**k nodes passed, itself included.
    jump = lost.select("key", F.col("parent").alias("to"), F.struct("key", "id").alias("least"))
    spark, at, ends = lost.sparkSession, "", 0
    while True:
        ahead = jump.select(F.col("key").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        jump = jump.join(ahead, "to").select("key", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("fell"))
        former, at = at, new_path(spark, "jump")
        jump, _ = cut_counted(jump, path=at)
        if former:
            drop_path(spark, former)
        now = jump.agg(F.countDistinct("to").alias("ends"), F.max("fell").alias("fell")).first()
        # As many ends as a round before: links only permute them, so they are all nodes on cycles and no others. No least fell: twice as
        # far round a cycle finds none smaller, so each is its cycle's. It takes as many rounds as doubling needs for the longest way.
        if now["ends"] == ends and not now["fell"]:
            break
        ends = now["ends"]
    on = jump.select(F.col("to").alias("key")).distinct().join(jump.select("key", F.col("least.id").alias("root")), "key")
    on = cut(on, "on-cycle")
    off = jump.join(on.select("key"), "key", "left_anti").select("key", "to").join(on.withColumnRenamed("key", "to"), "to").select("key", "root", F.lit(-2).alias("depth"))
    return on.select("key", "root", F.lit(-1).alias("depth")).unionByName(off).join(lost, "key").select("key", "id", "parent", "root", "depth")


def _rings(on: DataFrame) -> DataFrame:
    """Of nodes on cycles: key, id, root, up (the other members of the cycle, the one farthest up first)."""
    ring = on.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("id", "parent")))).alias("of"), F.min("key").alias("first"), F.count(F.lit(1)).cast("int").alias("n"))
    walk = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array().cast("array<string>"), lambda w, _: F.concat(w, F.array(F.when(F.size(w) == 0, F.col("first")).otherwise(F.col("of")[F.element_at(w, -1)]["parent"]))))
    ring = ring.withColumn("walk", walk).withColumn("ids", F.transform("walk", lambda k: F.col("of")[k]["id"]))
    each = ring.select("root", "n", "walk", "ids", F.posexplode("walk").alias("at", "key"))
    return each.select("key", F.col("ids")[F.col("at")].alias("id"), "root", F.reverse(F.slice(F.concat("ids", "ids"), F.col("at") + 2, F.col("n") - 1)).alias("up"))


def descendants(resolved: DataFrame) -> DataFrame:
    """Ancestor pairs of a result with ancestors: ancestor_id, descendant_id, distance.

    Whatever the parent links of a node lead to is its ancestor, on cycles and below them too; only itself is not.
    """
    up = resolved.select(F.col("node_id").alias("descendant_id"), F.coalesce("ancestors", "cycle").alias("up"))
    return up.select("descendant_id", F.size("up").alias("n"), F.posexplode("up").alias("at", "ancestor_id")).select("ancestor_id", "descendant_id", (F.col("n") - F.col("at")).alias("distance"))
