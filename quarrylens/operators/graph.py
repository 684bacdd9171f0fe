"""Edges between modules and symbols, and questions about them: reachability, cycles, callers, fan-out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import astfacts
from quarrylens.operators.symbols import definitions, local_name, module_of, usages
from quarrylens.session import Shelf, cut

#: Steps along edges between two checkpoints.
STEPS = 4
#: Rounds of steps before a graph is contracted; a contraction that takes less than one in LEAST edges is the last.
ROUNDS = 4
LEAST = 50
#: A block of whole numbers, in which points meet intervals, has 2^BLOCK of them.
BLOCK = 15


def alias_map(nodes: DataFrame) -> DataFrame:
    """path, local, target: what an imported name stands for; relative imports count from the module's package; the last binding wins."""
    alias = nodes.where("type = 'alias' AND name <> '*'")
    up, plain, source = F.coalesce("up_level", F.lit(0)), F.col("up_type") == "Import", F.coalesce("up_name", F.lit(""))
    parts = F.split(module_of(F.col("path")), r"\.")
    package = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), ".")
    source = F.when(up > 0, F.regexp_replace(F.concat(package, F.lit("."), source), r"^\.+|\.+$", "")).otherwise(source)
    target = F.when(plain, F.col("name")).otherwise(F.concat(source, F.lit("."), "name"))
    return alias.select("path", local_name().alias("local"), target.alias("target"), "node").groupBy("path", "local").agg(F.max_by("target", "node").alias("target"))


def edges(nodes: DataFrame) -> DataFrame:
    """src, dst, kind (CALLS, IMPORTS, INHERITS), path, line; as often as they stand there."""
    me, t = module_of(F.col("path")), F.col("type")
    imported = F.when((t == "alias") & (F.col("up_type") == "Import"), F.struct(F.col("name").alias("dst"), F.col("up_line").alias("line"))).when((t == "ImportFrom") & (F.col("name") != ""), F.struct(F.col("name").alias("dst"), "line"))
    imports = nodes.select(me.alias("src"), imported.alias("i"), F.lit("IMPORTS").alias("kind"), "path").where("i is not null").select("src", "i.dst", "kind", "path", "i.line")
    names = alias_map(nodes).withColumnRenamed("local", "name")
    refs = usages(nodes).where("kind IN ('call', 'load')").join(names, ["path", "name"], "left")
    calls = refs.select(F.coalesce("caller", me).alias("src"), F.coalesce("target", "qualified_name").alias("dst"), F.lit("CALLS").alias("kind"), "path", "line")
    bases = nodes.where("field = 'bases' AND type IN ('Name', 'Attribute')").join(names, ["path", "name"], "left")
    base = F.when(t == "Name", F.coalesce("target", "name")).otherwise(F.concat("owner", F.lit("."), "name"))
    inherits = bases.select(F.concat_ws(".", me, "up_name").alias("src"), base.alias("dst"), F.lit("INHERITS").alias("kind"), "path", F.col("up_line").alias("line")).where("dst is not null")
    return imports.unionByName(calls).unionByName(inherits)


def replace_files(table: DataFrame, changed: DataFrame) -> DataFrame:
    """A fact table with the rows of changed files (path) replaced by those of changed."""
    return table.join(changed.select("path").distinct(), "path", "left_anti").unionByName(changed)


@dataclass(frozen=True)
class Graph:
    """A dependency graph that can be carried from one state of a repository to the next: the node table, edges, and what
    seeds (node) reach."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame
    reach: DataFrame


def built(nodes: DataFrame, seeds: DataFrame) -> Graph:
    """The graph of a whole node table."""
    nodes, found = cut(nodes), cut(edges(nodes))
    return Graph(nodes, found, seeds, reachable(found, seeds))


def rebuilt(old: Graph, changed: DataFrame, seeds: DataFrame | None = None) -> Graph:
    """The graph after changed files (path, text; a null text where the file is gone) and, if given, with other seeds.

    Only changed files are parsed, and only their facts, aliases and edges are replaced. What is reached is mended: all that
    may hang on an edge or a seed that went is taken back, going along old edges from its end; what other nodes or
    seeds still reach of it comes back; and what new edges reach is added. The steps go along the taken and the new nodes,
    not along the whole graph.
    """
    seeds = old.seeds if seeds is None else seeds
    paths = cut(changed.select("path").distinct())
    fresh = cut(astfacts.ast_nodes(changed.where("text IS NOT NULL")))
    nodes = cut(old.nodes.join(paths, "path", "left_anti").unionByName(fresh))
    kept_edges = old.edges.join(paths, "path", "left_anti")
    now = cut(kept_edges.unionByName(edges(fresh)))
    return Graph(nodes, now, seeds, _mended(old, now, paths, seeds))


def _mended(old: Graph, now: DataFrame, paths: DataFrame, seeds: DataFrame) -> DataFrame:
    pair, touched = ["src", "dst"], paths.select("path")
    before = old.edges.join(touched, "path", "left_semi").select(*pair).distinct()
    after = now.join(touched, "path", "left_semi").select(*pair).distinct()
    gone = before.join(now.select(*pair), pair, "left_anti")  # another file may have the same edge
    ends = gone.join(old.reach, gone["src"] == old.reach["node"], "left_semi").select(F.col("dst").alias("node"))
    left_out = old.seeds.select("node").join(seeds.select("node"), "node", "left_anti")
    taken = _closure(old.edges, ends.unionByName(left_out).join(old.reach, "node", "left_semi"), None)
    kept = cut(old.reach.join(taken, "node", "left_anti"))
    # An old edge from what is kept into what was taken still holds, and so does a seed there.
    back = now.join(taken.withColumnRenamed("node", "dst"), "dst", "left_semi").unionByName(now.join(after, pair, "left_semi"))
    back = back.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    start = back.unionByName(seeds.select("node")).distinct().join(kept, "node", "left_anti")
    return cut(kept.unionByName(_closure(now, start, kept)))


def _closure(edges: DataFrame, start: DataFrame, known: DataFrame | None) -> DataFrame:
    """node: start and all that it reaches over edges, going no further where known nodes stand."""
    found = frontier = cut(start.select("node").distinct())
    parts = [found]
    while not frontier.isEmpty():
        step = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        step = step.join(found, "node", "left_anti")
        frontier = cut(step.join(known, "node", "left_anti") if known is not None else step)
        parts.append(frontier)
        found = reduce(DataFrame.unionByName, parts)
    return found


def _contracted(edges: DataFrame, put: Shelf, keep: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The core of different edges (src, dst), and the edges of the nodes that were taken out on the way, round by round: taken_src and
    taken_dst say which end was taken.

    A node with one way in or one way out at most, and not in keep (node), is taken out if no neighbour of that kind has a larger hash; edges
    from those before it to those behind it stand for it. So what reaches what stays as it is among the others, edges never grow in number, and a
    path of n nodes takes about log n rounds over fewer and fewer edges.
    """
    rounds: list[DataFrame] = []
    while True:
        end = lambda c, out: edges.select(F.col(c).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
        thin = end("src", 1).unionByName(end("dst", 0)).where("node IS NOT NULL").groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("least(out, into) <= 1")
        thin = thin.join(keep.hint("merge"), "node", "left_anti") if keep is not None else thin
        thin = put(thin.select("node", F.struct(F.xxhash64("node", F.lit(len(rounds))).alias("h"), "node").alias("place")))
        of = lambda t, c, mark: t.select(F.col("node").alias(c), *([F.col("place").alias(mark)] if "place" in t.columns else [F.lit(True).alias(mark)])).hint("merge")
        beside = edges.join(of(thin, "src", "s"), "src").join(of(thin, "dst", "d"), "dst")
        lower = beside.select(F.when(F.col("s") > F.col("d"), F.col("dst")).otherwise(F.col("src")).alias("node")).distinct()
        taken = put(thin.select("node").join(lower.hint("merge"), "node", "left_anti"))
        marked = edges.join(of(taken, "src", "s"), "src", "left").join(of(taken, "dst", "d"), "dst", "left")
        marked = put(marked.select("src", "dst", F.col("s").isNotNull().alias("taken_src"), F.col("d").isNotNull().alias("taken_dst")))
        n, out = marked.agg(F.count("*"), F.count_if(F.col("taken_src") | F.col("taken_dst"))).first()
        if out * LEAST <= n:
            return edges, rounds
        rounds.append(marked.where("taken_src OR taken_dst"))
        before, behind = marked.where("taken_dst").select("src", F.col("dst").alias("node")), marked.where("taken_src").select(F.col("src").alias("node"), "dst")
        across = before.join(behind.hint("merge"), "node").select("src", "dst").where("dst IS NULL OR src <> dst")
        edges = put(marked.where("NOT (taken_src OR taken_dst)").select("src", "dst").unionByName(across).distinct())


def _walked(steps: DataFrame, start: DataFrame, put: Callable[[DataFrame], DataFrame] = cut, rounds: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """node: start and what it reaches over steps, STEPS a round; and what the last of rounds has found, None where nothing is left to find."""
    found = frontier = start
    parts = [found]
    while rounds is None or len(parts) <= rounds:
        news = None
        for _ in range(STEPS):
            frontier = frontier.join(steps.hint("merge"), frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
            news = frontier if news is None else news.unionByName(frontier)
        frontier = put(news.distinct().join(found.hint("merge"), "node", "left_anti"))
        if frontier.isEmpty():
            return found, None
        parts.append(frontier)  # what was found before isn't written again
        found = reduce(DataFrame.unionByName, parts)
    return found, frontier


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: all that seeds (node) reach over edges (src, dst), themselves included. The graph and what has been found stay distributed.

    ROUNDS rounds of STEPS steps go along the graph itself, which is all that shallow graphs take. If more is left, the rest of the graph is
    contracted, so that the number of rounds doesn't follow the length of its paths; a node that was taken out is reached if one before it is.
    """
    steps = cut(edges.select("src", "dst").where("dst IS NULL OR src <> dst").distinct())
    found, frontier = _walked(steps, cut(seeds.select(F.col("node")).distinct()), rounds=ROUNDS)
    if frontier is None:
        return found
    put = Shelf(edges.sparkSession)
    rest = put(steps.join(found.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti").select("src", "dst"))
    core, rounds = _contracted(rest, put, frontier)
    more = put(_walked(core, frontier, put)[0])
    for near in reversed(rounds):
        into = near.where("taken_dst").join(more.select(F.col("node").alias("src")).hint("merge"), "src", "left_semi")
        more = put(more.unionByName(into.select(F.col("dst").alias("node")).distinct()))
    found = cut(found.join(frontier.hint("merge"), "node", "left_anti").unionByName(more))
    put.clear()
    return found


def dead_symbols(nodes: DataFrame, public_api: DataFrame | None = None, skip_tests: bool = True) -> DataFrame:
    """Symbols that neither public_api (node) nor what belongs to a __main__ module reaches, with the reason."""
    symbols = definitions(nodes).groupBy("qualified_name").agg(F.max_by(F.struct("name", "kind", "path", "line"), F.struct("path", "pre")).alias("s")).select("qualified_name", "s.*")
    live = symbols.where("endswith(qualified_name, '.__main__') OR contains(qualified_name, '.__main__.')").select(F.col("qualified_name").alias("node"))
    live = live.unionByName(public_api.select("node")) if public_api is not None else live
    dead = symbols.join(reachable(edges(nodes), live).withColumnRenamed("node", "qualified_name"), "qualified_name", "left_anti")
    if skip_tests:
        base = F.element_at(F.split("path", "/"), -1)
        dead = dead.where(~(base.startswith("test_") | base.endswith("_test.py")))
    reason = F.when(F.col("kind") == "import", "never_imported").when(F.col("kind").isin("function", "async_function", "class"), "never_called").otherwise("never_used")
    return dead.withColumn("reason", reason)


def cycles(edges: DataFrame) -> DataFrame:
    """node, cycle, size: nodes that lie on cycles of two nodes or more; a cycle is named by its smallest node.

    Nodes with one way in at most hang on trees, whose roots stand for them (_hung), and the same goes for ways out. In what is left the
    smallest id that reaches a node and is reached by it names its component: minima are passed forward and backward, and a component whose
    two minima agree is taken out, until nothing is left. A node of a tree is on its root's cycle if an edge from it or from a node
    below it leads there. No pairs are made.
    """
    put = Shelf(edges.sparkSession)
    left, nodes, trees, parts = put(edges.where("src <> dst").select("src", "dst").distinct()), None, [], []
    while True:
        nodes, seen = _ends(left, put)
        if max(seen["thin_in"], seen["thin_out"]) * LEAST <= seen["ends"]:
            break
        if seen["thin_in"] < seen["thin_out"]:  # what has one way out has one way in where edges are turned
            left, nodes = _turned(left), nodes.select("node", F.col("out").alias("into"), F.col("next").alias("last"))
        left, tree, ring = _hung(left, nodes, put)
        trees.append(tree)
        parts += [] if ring is None else [ring]
    while seen["ends"]:
        both, n = _spread(nodes, left, put)
        parts.append(both.where("f = b").select("node", F.col("f").alias("cycle")))
        if not n:
            break
        # A cycle's nodes share both minima: edges between nodes that don't are on none.
        of = lambda c, mark: both.where("f <> b").select(F.col("node").alias(c), F.struct("f", "b").alias(mark)).hint("merge")
        left = put(left.join(of("src", "cs"), "src").join(of("dst", "cd"), "dst").where("cs = cd").select("src", "dst"))
        nodes, seen = _ends(left, put)
    found = reduce(DataFrame.unionByName, parts) if parts else edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)
    for way, climb, levels in reversed(trees):
        of = lambda c, to: found.select(F.col("node").alias(c), F.col("cycle").alias(to)).hint("merge")
        near = way.where("src <> root").join(of("root", "a"), "root", "left").join(of("dst", "b"), "dst", "left").where("coalesce(a, root) = coalesce(b, dst)")
        marks = near.select(F.col("src").alias("node"), F.coalesce("a", "root").alias("cycle")).distinct()
        for k in range(levels):  # the nodes above, 1, 2, 4, ... steps up the tree
            up = climb.where(F.col("open") & (F.col("level") == k)).select("node", "at")
            marks = marks.join(up.hint("merge"), "node", "left").select(F.explode(F.array_compact(F.array("node", "at"))).alias("node"), "cycle").distinct()
            marks = put(marks) if k % STEPS == STEPS - 1 else marks
        found = put(found.unionByName(marks))
    # A node that names a component and was in none before is in it.
    found = put(found.unionByName(found.select(F.col("cycle").alias("node"), "cycle")).distinct())
    sizes = found.groupBy("cycle").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1")
    found = cut(found.join(sizes.hint("merge"), "cycle").select("node", F.col("first").alias("cycle"), "size"))
    put.clear()
    return found


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _ends(edges: DataFrame, put: Shelf) -> tuple[DataFrame, dict[str, int]]:
    """node, into, out, last, next of different edges (src, dst): how many ways lead in and out, and one of each; and counts of all."""
    end = lambda c, into: edges.select(F.col(c).alias("node"), F.lit(into).alias("into"), F.lit(1 - into).alias("out"), *(F.when(F.lit(x), F.col(o)).alias(n) for x, o, n in ((into == 1, "src", "last"), (into == 0, "dst", "next"))))
    nodes = end("src", 0).unionByName(end("dst", 1)).groupBy("node").agg(F.sum("into").alias("into"), F.sum("out").alias("out"), F.min("last").alias("last"), F.min("next").alias("next"))
    return put.counted(nodes, thin_in=F.count_if(F.col("into") <= 1), thin_out=F.count_if(F.col("out") <= 1), ends=F.coalesce(F.sum("into"), F.lit(0)))


def _hung(edges: DataFrame, nodes: DataFrame, put: Shelf) -> tuple[DataFrame, tuple[DataFrame, DataFrame, int], DataFrame | None]:
    """The edges (src, dst) between nodes with two ways in or more, where an edge from a node of a tree leads from the tree's root; the trees;
    and the cycles (node, cycle) of nodes with one way in, which nothing else leads to.

    Who has one way in hangs on the node before. Each looks as far up as the one it has seen last, so that a tree of n levels takes log n
    looks; those at which the root wasn't found are open. What hangs on a node without a way in, or below a cycle that has none from without, is on
    no cycle. Trees are: way (src, root, dst), the edges into nodes that are left; climb (node, level, at, open), the looks;
    and how many looks it takes to the last root.
    """
    name = put.name()
    before = nodes.select(F.col("node").alias("last"), F.col("into").alias("n")).hint("merge")
    first = nodes.where("into = 1").select("node", "last").join(before, "last")
    first = first.select("node", F.when(F.col("n") > 0, F.col("last")).alias("at"), F.col("node").alias("low"), (F.col("n") == 1).alias("open"), F.lit(0).alias("level"), F.lit(False).alias("lower"))
    climb, seen = put.counted(first, name, n=F.count_if(F.col("open")))
    level = deepest = 0
    ring, enough = None, False
    while seen["n"] and not enough:
        enough = seen["n"] <= 2**level  # open ones that aren't on or below a cycle are seen through by the next look
        mine, held = climb.where(F.col("open") & (F.col("level") == level)), climb.where(~F.col("open") | (F.col("level") == level))
        held = held.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("low").alias("other"), F.col("open").alias("more")).hint("merge")
        looked = mine.select("node", "at", "low").join(held, "at")
        level += 1
        looked = looked.select("node", F.col("to").alias("at"), F.least("low", "other").alias("low"), F.col("more").alias("open"), F.lit(level).alias("level"), (F.col("more") & (F.col("other") < F.col("low"))).alias("lower"))
        climb, seen = put.counted(looked, name, n=F.count_if(F.col("open")), done=F.count_if(~F.col("open")), lower=F.count_if(F.col("lower")))
        deepest = level if seen["done"] else deepest
        if seen["n"] and (enough or not seen["lower"]):
            # Those at which open ones look are all on cycles if no way up ends. If these are all the open ones, minima that stay are those of the cycles.
            lost = climb.where(F.col("open") & (F.col("level") == level))
            ring, on = put.counted(lost.join(lost.select(F.col("at").alias("node")).distinct().hint("merge"), "node", "left_semi").select("node", F.col("low").alias("cycle")), n=F.count("*"))
            enough = enough or on["n"] == seen["n"]
            ring = ring if enough else None
    fat = nodes.where("into > 1").select("node")
    place = climb.where("NOT open AND at IS NOT NULL").select(F.col("node").alias("src"), F.col("at").alias("root")).unionByName(fat.select(F.col("node").alias("src"), F.col("node").alias("root")))
    way = put(edges.join(fat.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi").join(place.hint("merge"), "src").select("src", "root", "dst"))
    return put(way.where("root <> dst").select(F.col("root").alias("src"), "dst").distinct()), (way, climb, deepest), ring


def _spread(nodes: DataFrame, edges: DataFrame, put: Shelf) -> tuple[DataFrame, int]:
    """node, f, b: the smallest node that reaches it and the smallest that it reaches, itself included; and of how many they differ.

    Both ways are gone at once, along edges and along turned ones; a node's edge to itself carries what it has.
    """
    way = lambda t, back: t.select(F.lit(back).alias("back"), "src", "dst")
    own = nodes.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), F.col("node").alias("src"), F.col("node").alias("dst"))
    ways = put(way(edges, False).unionByName(way(_turned(edges), True)).unionByName(own))
    now, seen = ways.groupBy("back", F.col("dst").alias("src")).agg(F.min("src").alias("least")), {"n": 1}
    while seen["n"]:
        for _ in range(STEPS):
            sent = ways.join(now.select("back", "src", "least").hint("merge"), ["back", "src"])
            now = sent.groupBy("back", "dst").agg(F.min("least").alias("least"), F.max(F.when(F.col("src") == F.col("dst"), F.col("least"))).alias("was")).withColumnRenamed("dst", "src")
        now, seen = put.counted(now, n=F.count_if(F.expr("least <> was")))  # a step that changes nothing is the last
    both = now.groupBy(F.col("src").alias("node")).agg(F.min(F.when(~F.col("back"), F.col("least"))).alias("f"), F.min(F.when(F.col("back"), F.col("least"))).alias("b"))
    both, seen = put.counted(both, n=F.count_if(F.expr("f <> b")))
    return both, seen["n"]


def transitive_imports(edges: DataFrame, module: str, spark: SparkSession) -> DataFrame:
    """node: all modules that a module imports, at any distance, without itself."""
    seed = spark.createDataFrame([(module,)], "node string")
    return reachable(edges.where("kind = 'IMPORTS'"), seed).where(F.col("node") != module)


def callers(edges: DataFrame) -> DataFrame:
    """dst, callers: distinct sources of each node, over all kinds of edges."""
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("callers"))


def fanout(edges: DataFrame) -> DataFrame:
    """src, fanout: how many modules a module imports."""
    return edges.where("kind = 'IMPORTS'").groupBy("src").agg(F.count_distinct("dst").alias("fanout"))


def dyadic_cells(lo: Column, hi: Column) -> Column:
    """An array of (level, cell) of the fewest stretches of 2^level whole numbers, from cell * 2^level on, that make up lo to hi:
    two of a level at most. Ends of 62 bits at most; without lo <= hi there are none."""

    def at(k: Column) -> Column:
        ends = lambda j: (-F.call_function("shiftright", -lo, j), F.call_function("shiftright", hi + 1, j))  # noqa: E731  # from, and up to
        (a, b), (up_a, up_b) = ends(k), ends(k + 1)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        outer = F.array(F.when(odd(a), a), F.when(odd(b), b - 1))  # what the level above leaves over at both ends
        inner = F.array(a, F.when(b - a > 1, a + 1))
        own = F.when(a >= b, F.array().cast("array<bigint>")).when(up_a < up_b, outer).otherwise(inner)
        return F.transform(F.filter(own, lambda x: x.isNotNull()), lambda x: F.struct(k.alias("level"), x.alias("cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(61)), at))


def innermost(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """point, lo, hi: of each different one of points (point) the shortest of intervals (lo, hi) that holds it, of equal ones
    that which begins first. All are whole numbers; intervals of any length may stand in one table, those that end before they
    begin or lack an end hold nothing, and points in no interval give no row.

    Each interval is cut into dyadic cells, of which one holds a point that the interval holds. A cell keeps its
    shortest interval alone, so nested ones don't multiply. Points and cells of one block of 2^BLOCK numbers meet in one group, to which each goes
    once; a group holds few blocks and is searched level by level. Cells larger than a block are looked up once for each block.
    """
    spans = intervals.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).where("lo <= hi")
    groups = (points.count() + 4 * spans.count()) // 2**BLOCK + 1
    put = Shelf(points.sparkSession)
    cells = spans.select("lo", "hi", F.explode(dyadic_cells(F.col("lo"), F.col("hi"))).alias("c")).groupBy("c.level", "c.cell").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("span"), "lo")).alias("best"))
    cells = put(cells.select("level", "cell", "best.span", "best.lo"))
    own = points.select(F.col("point").cast("long").alias("point")).where("point IS NOT NULL").distinct().withColumn("block", F.expr(f"shiftright(point, {BLOCK})"))
    large = cells.where(F.col("level") > BLOCK)
    levels = [r[0] for r in large.select("level").distinct().collect()]  # 62 at most
    probes = own.select("block").distinct().select("block", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level")).withColumn("cell", F.expr(f"shiftright(block, level - {BLOCK})"))
    whole = probes.join(large.hint("merge"), ["level", "cell"]).groupBy("block").agg(F.min(F.struct("span", "lo")).alias("best"))
    small = cells.where(F.col("level") <= BLOCK).select("level", "cell", "span", "lo", F.expr(f"shiftright(cell, {BLOCK} - level)").alias("block"))
    small = small.unionByName(whole.select(F.lit(BLOCK + 1).alias("level"), F.col("block").alias("cell"), "best.span", "best.lo", "block"))
    key = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("key")
    met = own.select(key, "point").groupBy("key").cogroup(small.select(key, "level", "cell", "span", "lo").groupBy("key")).applyInArrow(_shortest, "point long, lo long, hi long")
    found = cut(met)
    put.clear()
    return found


def _shortest(points: pa.Table, cells: pa.Table) -> pa.Table:
    """The points of a group that cells hold, with the smallest (span, lo) among them. Level BLOCK + 1 is that of what holds whole blocks."""
    point = points["point"].to_numpy()
    level, cell, span, lo = (cells[c].to_numpy() for c in ("level", "cell", "span", "lo"))
    best, first, hit = np.zeros_like(point), np.zeros_like(point), np.zeros(len(point), bool)
    for k in np.unique(level) if len(point) else ():
        at = np.flatnonzero(level == k)
        at = at[np.argsort(cell[at])]
        looked = point >> np.int64(min(k, BLOCK))
        place = np.minimum(np.searchsorted(cell[at], looked), len(at) - 1)
        here = at[place]
        better = (cell[here] == looked) & (~hit | (span[here] < best) | ((span[here] == best) & (lo[here] < first)))
        best[better], first[better] = span[here][better], lo[here][better]
        hit |= better
    return pa.table({"point": point[hit], "lo": first[hit], "hi": first[hit] + best[hit]})


def module_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (module, ...) with path: the first file whose dotted name or stem the module is. Equality on either key, no theta join."""
    keys = files.select("path", F.explode(F.array_distinct(F.array(module_of(F.col("path")), F.regexp_extract("path", r"([^/]*)\.py$", 1)))).alias("module"))
    return wanted.join(keys.groupBy("module").agg(F.min("path").alias("path")), "module")


def definition_lines(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted (path, name) with line: the first definition of a function or class of that name in the file, 0 without one."""
    defs = nodes.where("type IN ('FunctionDef', 'AsyncFunctionDef', 'ClassDef')").groupBy("path", "name").agg(F.min_by("line", "node").alias("line"))
    return wanted.join(defs, ["path", "name"], "left").withColumn("line", F.coalesce("line", F.lit(0)))
