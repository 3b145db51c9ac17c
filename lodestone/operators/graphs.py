"""Graph operators over edges(src, dst): degrees, reach, paths, cycles, order, resolution."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.shared import settle

# fixed values: method names that every type has
GENERIC_METHODS = "new default clone fmt from into as_ref as_mut deref drop eq ne cmp partial_cmp hash next iter len is_empty to_string index index_mut".split()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree), one shuffle: every edge counts once at either end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hotspots(edges: DataFrame, least: int = 5, k: int = 50, skip: list[str] | None = None) -> DataFrame:
    """The k nodes of highest degree, generic method names left out."""
    bare = F.element_at(F.split(F.col("node").cast("string"), "::"), -1)
    return degrees(edges).withColumn("degree", F.col("out_degree") + F.col("in_degree")).where((F.col("degree") >= least) & ~bare.isin(skip or GENERIC_METHODS)).orderBy(F.desc("degree"), "node").limit(k)


def reach(edges: DataFrame, starts: list, most_depth: int = 5, backwards: bool = False) -> DataFrame:
    """(node, depth): least number of steps from any start, up to most_depth; starts are left out.

    Breadth first, a level at a time: each level is one join of the frontier with the edges and an anti join with
    what has been seen, so cycles end and no path is counted twice.
    """
    spark = edges.sparkSession
    step = edges.select(F.col("dst").alias("a"), F.col("src").alias("b")) if backwards else edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    kind = step.schema["a"].dataType
    seen = spark.createDataFrame([(s, 0) for s in starts], ["node", "depth"]).select(F.col("node").cast(kind).alias("node"), F.col("depth").cast("int").alias("depth"))
    frontier = seen
    for d in range(1, most_depth + 1):
        new = frontier.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("n2")).distinct()
        frontier = settle(new.join(seen, F.col("n2") == F.col("node"), "left_anti").select(F.col("n2").alias("node"), F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, start, goal, most_depth: int = 10) -> DataFrame:
    """(step, node) of one shortest path; of equal paths the one that comes first by nodes. Empty if there is none.

    Distances back from the goal are found first; the path then follows, from the start, the smallest next node whose distance is one less.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    back = reach(edges, [goal], most_depth, backwards=True).unionByName(spark.createDataFrame([(goal, 0)], ["node", "depth"]).select(F.col("node").cast(kind).alias("node"), F.col("depth").cast("int").alias("depth")))
    back = settle(back)
    at, rows = start, []
    first = back.where(F.col("node") == F.lit(start).cast(kind)).first()
    if first is not None:
        rows.append((0, start))
        for d in range(first["depth"] - 1, -1, -1):
            at = edges.where(F.col("src") == F.lit(at).cast(kind)).join(back.where(F.col("depth") == d), F.col("dst") == F.col("node")).agg(F.min("dst")).first()[0]
            rows.append((len(rows), at))
    return spark.createDataFrame(rows, "step int, node string").select("step", F.col("node").cast(kind).alias("node")) if rows else spark.createDataFrame([], "step int, node string").select("step", F.col("node").cast(kind).alias("node"))


def short_cycles(edges: DataFrame, most_length: int = 3) -> DataFrame:
    """(length, path) of simple cycles of up to most_length nodes, each once, from its smallest node on."""
    step = edges.where("src <> dst").select("src", "dst").distinct()
    paths = step.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("path"))
    found = edges.where("src = dst").select(F.array("src").alias("path")).distinct()
    for length in range(2, most_length + 1):
        closing = step.select(F.col("src").alias("s"), F.col("dst").alias("d"))
        found = found.unionByName(paths.join(closing, (F.col("end") == F.col("s")) & (F.col("start") == F.col("d"))).select("path"))
        if length < most_length:
            paths = paths.join(closing, F.col("end") == F.col("s")).where((F.col("d") > F.col("start")) & ~F.array_contains("path", F.col("d"))).select("start", F.col("d").alias("end"), F.concat("path", F.array("d")).alias("path"))
    return found.select(F.size("path").alias("length"), "path")


def strong_components(edges: DataFrame, most_rounds: int = 10000) -> DataFrame:
    """(component, node) of the strongly connected components that hold a cycle of any length; component is the smallest node.

    Nodes without an edge in or out are trimmed. Every node then takes the smallest node that reaches it as its colour; the
    nodes of a colour that reach the colour's own node are its component, and leave. Raises if most_rounds do not suffice.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("component"), F.col("src").alias("node")).distinct()
    left, found = settle(edges.where("src <> dst").select("src", "dst").distinct()), []

    def rounds(what: str):
        yield from range(most_rounds)
        raise RuntimeError(f"strong_components: {what} did not settle")

    def within(e: DataFrame, nodes: DataFrame) -> DataFrame:
        return e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")

    for _ in rounds("components"):
        n = left.count()
        for _ in rounds("trimming"):
            left = settle(within(left, left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))))
            n, before = left.count(), n
            if n == before:
                break
        if not n:
            break
        colour = settle(left.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct())
        for _ in rounds("colours"):
            sent = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
            step = settle(colour.join(sent, "node").select("node", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("changed")))
            colour, changed = step.drop("changed"), not step.where("changed").isEmpty()
            if not changed:
                break
        # edges inside a colour, backwards from the colour's own node
        paint = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias("colour"))
        inside = settle(left.join(paint("src"), "src").join(paint("dst"), ["dst", "colour"]).select("src", "dst"))
        frontier = settle(colour.where("node = colour"))
        seen = frontier
        for _ in rounds("reach"):
            new = inside.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = settle(new.join(seen.select("node"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            seen = settle(seen.unionByName(frontier))
        found.append(seen.select(F.col("colour").alias("component"), "node"))
        rest = settle(colour.join(seen.select("node"), "node", "left_anti").select("node"))
        left = settle(within(left, rest))
    parts = loops.limit(0)
    for f in found:
        parts = parts.unionByName(f.join(f.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi"))
    return parts.unionByName(loops.join(parts.select("node"), "node", "left_anti").select("component", "node"))


def peel(edges: DataFrame, importers_first: bool = True) -> DataFrame:
    """(node, level) by Kahn's peeling, to the end however long the chains; nodes on or behind a cycle get no level (null)."""
    step = edges.select("src", "dst").where("src <> dst").distinct()
    if not importers_first:
        step = step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = settle(step)
    left = settle(step.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done = None
    for level in itertools.count():
        open_now = settle(left.join(step, F.col("node") == F.col("dst"), "left_anti").withColumn("level", F.lit(level)))
        if open_now.isEmpty():
            break
        done = open_now if done is None else done.unionByName(open_now)
        gone = open_now.select(F.col("node").alias("g"))
        left = settle(left.join(gone, F.col("node") == F.col("g"), "left_anti"))
        step = settle(step.join(gone, F.col("src") == F.col("g"), "left_anti"))
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls(caller, file, callee, scope_hint) with target: same file, then the scope the hint names, then the first key.

    functions(key, name, file). A callee that no function is called keeps its bare name.
    """
    scope = F.replace(F.coalesce("scope_hint", F.lit("")), F.lit("::"), F.lit("/"))
    c = calls.withColumn("bare", F.element_at(F.split("callee", r"::|\."), -1)).withColumn("scope", scope)
    f = functions.select(F.col("key").alias("fkey"), F.col("name").alias("bare"), F.col("file").alias("ffile"))
    same = f.groupBy("bare", F.col("ffile").alias("file")).agg(F.min("fkey").alias("same"))
    first = f.groupBy("bare").agg(F.min("fkey").alias("first"))
    # a name and scope are looked up once, however many calls there are
    hinted = c.where("scope <> ''").select("bare", "scope").distinct()
    inside = F.contains("ffile", F.concat(F.lit("/"), F.col("scope"), F.lit("/"))) | F.contains("ffile", F.concat(F.lit("/"), F.col("scope"), F.lit(".")))
    scoped = hinted.join(f, "bare").where(inside).groupBy("bare", "scope").agg(F.min("fkey").alias("scoped"))
    met = c.join(same, ["bare", "file"], "left").join(scoped, ["bare", "scope"], "left").join(first, "bare", "left")
    return met.select("caller", "file", "callee", "scope_hint", F.coalesce("same", "scoped", "first", "bare").alias("target"))


def find_function(functions: DataFrame, wanted: str) -> DataFrame:
    """The one function meant: exact, any case, after '::', at the end, then anywhere; then by key."""
    low, key = F.lower("key"), F.col("key")
    w = wanted.lower()
    place = F.when(key == wanted, 0).when(low == w, 1).when(F.endswith(key, F.lit("::" + wanted)), 2).when(F.endswith(key, F.lit(wanted)), 3).when(F.endswith(low, F.lit("::" + w)), 4).when(F.contains(low, F.lit(w)), 5)
    return functions.withColumn("place", place).where("place is not null").orderBy("place", "key").limit(1)


def unused(exports: DataFrame, imports: DataFrame, entry_points: Column) -> DataFrame:
    """exports(file, name) that no import(name) takes, entry points left out."""
    return exports.where(~entry_points).join(imports.select(F.col("name").alias("taken")).where("taken is not null").distinct(), F.col("name") == F.col("taken"), "left_anti")


def clusters(nodes: DataFrame, by: Column) -> DataFrame:
    return nodes.groupBy(by.alias("cluster")).agg(F.count("*").alias("n_nodes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def code_graph(edges: DataFrame, roots: list, depth: int = 3, most_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes (at most most_nodes, nearest first, then by id) and the edges among them."""
    near = reach(edges, roots, depth)
    start = edges.sparkSession.createDataFrame([(r, 0) for r in roots], ["node", "depth"]).select(F.col("node").cast(near.schema["node"].dataType).alias("node"), F.col("depth").cast("int").alias("depth"))
    nodes = settle(near.unionByName(start).orderBy("depth", "node").limit(most_nodes))
    kept = edges.select("src", "dst").distinct()
    kept = kept.join(nodes.select(F.col("node").alias("a")), F.col("src") == F.col("a")).join(nodes.select(F.col("node").alias("b")), F.col("dst") == F.col("b")).select("src", "dst")
    return nodes, kept


def merge_ranges(ranges: DataFrame, key: str = "path") -> DataFrame:
    """(key, start, end) with touching and overlapping ranges of a key made one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
