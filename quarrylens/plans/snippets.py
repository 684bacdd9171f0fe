"""Queries over modules of which each holds one case of a rule, a cost or a kind of dead code: that of the module's key. The SQL
joins the keys with what each case is known to give, and never sees the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import tables
from quarrylens.operators import astfacts, complexity, graph, style, symbols
from quarrylens.plans.registry import query, table

DOC = '"""M."""\n'
WORK = 'def work(a: int) -> int:\n    """W."""\n'

#: Where a module stands, its text, and the rules that it breaks, each with line and context; {k} is the key. Cases that break
#: a rule and cases that nearly do stand together.
STYLE: list[tuple[str, str, list[tuple[str, int, str]]]] = [
    ("pkg/Mod_{k}.py", DOC, [("N001", 0, "Mod_{k}")]),
    ("pkg/mod_{k}.py", DOC, []),
    ("pkg/m_{k}.py", DOC + 'class lower:\n    """C."""\n', [("N002", 2, "lower")]),
    ("pkg/m_{k}.py", DOC + 'class Upper:\n    """C."""\n', []),
    ("pkg/m_{k}.py", DOC + 'def Work(a: int) -> int:\n    """W."""\n    return a\n', [("N003", 2, "Work")]),
    ("pkg/m_{k}.py", DOC + WORK + "    return a\n", []),
    ("pkg/m_{k}.py", DOC + "limit = {k}\n", [("N004", 2, "limit")]),
    ("pkg/m_{k}.py", DOC + "LIMIT = {k}\n_limit = {k}\n", []),
    ("pkg/m_{k}.py", DOC + "from typing import Any\nKind = Any\n", [("N005", 3, "Kind")]),
    ("pkg/m_{k}.py", DOC + "from typing import Any\nkind = Any\n__all__ = [Any]\n", []),
    ("pkg/m_{k}.py", DOC + 'def q(a: int) -> int:\n    """Q."""\n    return a\n', [("N007", 2, "q")]),
    ("pkg/m_{k}.py", DOC + 'def x(a: int) -> int:\n    """X."""\n    return a\n', []),
    ("pkg/m_{k}.py", DOC + 'class Wrong(ValueError):\n    """C."""\n', [("N009", 2, "Wrong")]),
    ("pkg/m_{k}.py", DOC + 'class WrongError(ValueError):\n    """C."""\n', []),
    ("tests/test_{k}.py", DOC + WORK + "    assert a\n    return a\n", [("N010", 2, "work")]),
    ("tests/test_{k}.py", DOC + 'def test_work(a: int) -> int:\n    """W."""\n    assert a\n    return a\n', []),
    ("pkg/m_{k}.py", DOC + "def work(a: int) -> int:\n    return a\n", [("D001", 2, "work")]),
    ("pkg/m_{k}.py", DOC + "def _work(a):\n    return a\n", [("N003", 2, "_work")]),
    ("pkg/m_{k}.py", DOC + "class Box:\n    pass\n", [("D002", 2, "Box")]),
    ("pkg/m_{k}.py", "LIMIT = {k}\n", [("D003", 0, "")]),
    ("pkg/m_{k}.py", DOC + 'def work(a: int) -> int:\n    """' + "w" * 90 + '."""\n    return a\n', [("D004", 2, "w" * 70 + "…")]),
    ("pkg/m_{k}.py", DOC + 'def work(a: int) -> int:\n    """' + "w" * 79 + '."""\n    return a\n', []),
    ("pkg/m_{k}.py", DOC + 'def work(a: int) -> int:\n    """One.\n    Two.\n    """\n    return a\n', [("D005", 2, "work")]),
    ("pkg/m_{k}.py", DOC + 'def work(a: int) -> int:\n    """One.\n\n    Two.\n    """\n    return a\n', []),
    ("pkg/m_{k}.py", DOC + 'def work(a: int) -> int:\n    """W.\n\n    Returns: a\n    """\n    yield a\n', [("D006", 2, "work")]),
    ("pkg/m_{k}.py", DOC + 'def work(a: int) -> int:\n    """W.\n\n    Yields: a\n    """\n    yield a\n', []),
    ("pkg/m_{k}.py", DOC + "from os import *\n", [("I001", 2, "from os import *")]),
    ("pkg/m_{k}.py", DOC + "from .. import util\n", [("I002", 2, "relative level=2")]),
    ("pkg/m_{k}.py", DOC + "import os, sys\n", [("I003", 2, "")]),
    ("pkg/m_{k}.py", DOC + "from decimal import Decimal\n", [("I004", 2, "from decimal import Decimal")]),
    ("pkg/m_{k}.py", DOC + "from decimal import getcontext\nfrom typing import List\n", [("I005", 3, "")]),
    ("pkg/m_{k}.py", DOC + "import numpy\nimport os\nimport sys\n", [("I005", 3, "")]),
    ("pkg/m_{k}.py", DOC + "import os\nimport sys\nimport numpy\n", []),
    ("pkg/m_{k}.py", DOC + 'def work(a: int = {}) -> int:\n    """W."""\n    return a\n', [("I006", 2, "work")]),
    ("pkg/m_{k}.py", DOC + 'def work(a: int = ()) -> int:\n    """W."""\n    return a\n', []),
    ("pkg/m_{k}.py", DOC + 'def work(a: int):\n    """W."""\n    return a\n', [("T001", 2, "work")]),
    ("pkg/m_{k}.py", DOC + 'def work(a, b: int) -> int:\n    """W."""\n    return a\n', [("T002", 2, "work")]),
    ("pkg/m_{k}.py", DOC + WORK + "    try:\n        return a\n    except:\n        return {k}\n", [("T003", 6, "work")]),
    ("pkg/m_{k}.py", DOC + WORK + "    try:\n        return a\n    except ValueError:\n        return {k}\n", []),
    ("pkg/m_{k}.py", DOC + WORK + "    if a:\n        a = 0\n" * 10 + "    return a\n", [("C001", 2, "work cc=11")]),
    ("pkg/m_{k}.py", DOC + WORK + "    if a:\n        a = 0\n" * 9 + "    return a\n", []),
    ("pkg/m_{k}.py", DOC + WORK + "    return [x for y in a for x in y]\n", [("C003", 2, "work")]),
    ("pkg/m_{k}.py", DOC + WORK + "    return [[x for x in y] for y in a]\n", []),
]
NO_TIME, NO_SPACE, STACK, BUILDS = "no loops or recursion detected", "in-place or constant extra space", "recursion_stack → O(depth) space", "list/set/dict comprehension → O(n) space"
#: The body of a function f_{k}(xs, n), what stands before it, and its classes of time and space with their reasons.
COSTS: list[tuple[str, str, int, int, str, str]] = [
    ("", "    return n\n", 0, 0, NO_TIME, NO_SPACE),
    ("", "    for x in xs:\n        n = x\n    return n\n", 2, 0, "single_loop → O(n)", NO_SPACE),
    ("", "    while n:\n        for x in xs:\n            n = x\n", 4, 0, "2_nested_loops → O(n²)", NO_SPACE),
    ("", "    for x in xs:\n        for y in x:\n            while n:\n                n = y\n", 5, 0, "3_nested_loops → O(n³) or worse", NO_SPACE),
    ("", "    return f_{k}(xs, n - 1)\n", 2, 2, "single_recursion → O(n)", STACK),
    ("", "    return f_{k}(xs, 1) + f_{k}(xs, 2)\n", 6, 2, "recursive_2_branches_no_memo → add @lru_cache", STACK),
    ("import functools\n@functools.lru_cache\n", "    return f_{k}(xs, 1) + f_{k}(xs, 2)\n", 3, 0, "memoized_recursion → O(n log n) or better", NO_SPACE),
    ("", "    n //= 2\n    return f_{k}(xs, n)\n", 1, 2, "tail_recursion_with_halving → O(log n)", STACK),
    ("", "    for x in xs:\n        n += x\n    return n\n", 4, 0, complexity.SAID["concat"], NO_SPACE),
    ("", "    for x in xs:\n        if x in n:\n            return x\n", 4, 0, complexity.SAID["search"], NO_SPACE),
    ("", "    for x in xs:\n        n = xs.index(x)\n", 4, 0, complexity.SAID["index"], NO_SPACE),
    ("", "    for x in xs:\n        xs.sort()\n", 4, 0, "sort_in_loop → O(n² log n), sort once outside loop", NO_SPACE),
    ("", "    xs.insert(0, n)\n    while n:\n        xs.insert(0, n)\n", 4, 0, "list.insert(0,x)_in_loop → use collections.deque.appendleft()", NO_SPACE),
    ("", "    xs.insert(0, n)\n    xs.sort()\n    return n in xs\n", 0, 0, NO_TIME, NO_SPACE),
    ("", "    return [x for y in xs for x in y]\n", 4, 2, "nested_comprehension → O(n²) or worse", BUILDS),
    ("", "    return {x for x in xs}\n", 0, 2, NO_TIME, BUILDS),
    ("", "    for x in xs:\n        n.append([x])\n", 2, 4, "single_loop → O(n)", "list_of_lists_accumulation → consider generator/streaming"),
    ("import bisect\n", "    for x in xs:\n        bisect.bisect(n, x)\n", 3, 0, "single_loop_with_sort_or_halving → O(n log n)", NO_SPACE),
]
#: Bodies of a function, and the lines right behind what ends a block, with its kind.
ENDS: list[tuple[str, list[tuple[int, str]]]] = [
    ("    return a\n    a = 1\n    a = 2\n", [(3, "return")]),
    ("    raise a\n    a = 1\n", [(3, "raise")]),
    ("    for x in a:\n        break\n        x = 1\n    return a\n", [(4, "break")]),
    ("    while a:\n        if a:\n            continue\n            a = 1\n        else:\n            return a\n            a = 2\n", [(5, "continue"), (8, "return")]),
    ("    try:\n        raise a\n        a = 1\n    finally:\n        return a\n        a = 2\n", [(4, "raise"), (7, "return")]),
    ("    return a\n    pass\n", []),
    ("    if a:\n        return 1\n    return 2\n", []),
]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _modules(spark: SparkSession, sf: str, cases: list[tuple[str, str]]) -> DataFrame:
    """path, text: the module of each supplier, of the case that its key has."""
    held = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "case int, path string, text string")
    k = F.col("s_suppkey").cast("string")
    rows = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(cases)).cast("int").alias("case")).join(F.broadcast(held), "case")
    return rows.select(*(F.replace(c, F.lit("{k}"), k).alias(c) for c in ("path", "text")))


def _sql(cases: list[tuple[str, list[tuple]]], columns: tuple[str, ...]) -> str:
    """The rows of each supplier's case: path and columns."""
    rows = ", ".join(f"({i}, {_text(path)}, {', '.join(_text(x) if isinstance(x, str) else str(x) for x in row)})" for i, (path, found) in enumerate(cases) for row in found)
    shown = ", ".join(f"replace({c}, '{{k}}', s_suppkey::VARCHAR) AS {c}" if any(isinstance(row[j], str) for _, found in cases for row in found) else c for j, c in enumerate(columns))
    return f"SELECT replace(path, '{{k}}', s_suppkey::VARCHAR) AS path, {shown} FROM supplier JOIN (VALUES {rows}) v(c, path, {', '.join(columns)}) ON s_suppkey % {len(cases)} = c"


@query(_sql([(path, found) for path, _, found in STYLE], ("rule", "line", "context")))
def style_every_rule(spark, sf):
    """Every rule of syntax that can be broken, over modules that break it and modules that nearly do."""
    return style.ast_violations(astfacts.ast_nodes(_modules(spark, sf, [(p, t) for p, t, _ in STYLE]))).select("path", "rule", "line", "context")


@query(_sql([("pkg/m_{k}.py", [("pkg.m_{k}.f_{k}", *row)]) for *_, a, b, c, d in COSTS for row in [(a, b, c, d)]], ("name", "time", "space", "time_reason", "space_reason")))
def complexity_every_pattern(spark, sf):
    """Every pattern of time and space costs, one a module."""
    held = _modules(spark, sf, [("pkg/m_{k}.py", f"{head}def f_{{k}}(xs, n):\n{body}") for head, body, *_ in COSTS])
    found = complexity.repository_estimates(astfacts.ast_nodes(held))
    return found.select("path", F.col("qualified_name").alias("name"), "time", "space", "time_reason", "space_reason")


@query(_sql([("pkg/m_{k}.py", found) for _, found in ENDS], ("line", "after_kind")))
def unreachable_every_kind(spark, sf):
    """Statements right behind each of the four that end a block, in bodies, branches and finally."""
    held = _modules(spark, sf, [("pkg/m_{k}.py", f"def f(a):\n{body}") for body, _ in ENDS])
    return symbols.unreachable_next(astfacts.ast_nodes(held)).select("path", "line", "after_kind")


IMPORTS: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("pkg/sub/m_{k}.py", "from . import a_{k}\n", [("a_{k}", "pkg.sub.a_{k}")]),
    ("pkg/sub/m_{k}.py", "from .. import a as b\nfrom ..x import y\n", [("b", "pkg.a"), ("y", "pkg.x.y")]),
    ("pkg/sub/m_{k}.py", "from .x import y, z as w\nfrom os.path import *\n", [("y", "pkg.sub.x.y"), ("w", "pkg.sub.x.z")]),
    ("m_{k}.py", "import a.b\nimport c.d as e\nfrom f import g\nfrom h import g\n", [("a", "a.b"), ("e", "c.d"), ("g", "h.g")]),
]


@query(_sql([(path, found) for path, _, found in IMPORTS], ("local", "target")))
def alias_map_relative(spark, sf):
    """What names stand for behind relative imports, renamed ones and ones that are bound twice."""
    return graph.alias_map(astfacts.ast_nodes(_modules(spark, sf, [(p, t) for p, t, _ in IMPORTS]))).select("path", "local", "target")


EXPORTS: list[tuple[str, str, list[tuple[str, bool]]]] = [
    ("m_{k}.py", "import os\n__all__ = ['f_{k}', 'os']\ndef f_{k}():\n    pass\ndef g():\n    pass\n", [("os", True), ("f_{k}", True), ("g", False), ("__all__", False)]),
    ("m_{k}.py", "__all__ = ('A',)\n__all__ = ['g']\nclass A:\n    pass\ndef g():\n    pass\n", [("A", True), ("g", False), ("__all__", False), ("__all__", False)]),
    ("m_{k}.py", "x, __all__ = 1, ['g']\ndef g():\n    pass\n", [("g", False)]),
]


@query(_sql([(path, found) for path, _, found in EXPORTS], ("name", "is_in_all")))
def exported_names(spark, sf):
    """Definitions, and whether __all__ names them: the first list or tuple that it alone is set to."""
    return symbols.definitions(astfacts.ast_nodes(_modules(spark, sf, [(p, t) for p, t, _ in EXPORTS]))).select("path", "name", "is_in_all")


@query(_sql([(path, found) for path, _, found in STYLE], ("rule", "line", "context")))
def style_rules_from_sql(spark, sf):
    """The same from SQL: a table function parses the files that a query names."""
    tables.register(spark)
    _modules(spark, sf, [(p, t) for p, t, _ in STYLE]).createOrReplaceTempView("module_files")
    return style.ast_violations(spark.sql("SELECT * FROM ast_facts(TABLE(module_files))")).select("path", "rule", "line", "context")


@query("""WITH m AS (SELECT o_custkey % 20 AS episode_id, (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS step, count(*) AS n, sum(o_orderkey % 7) AS w FROM orders GROUP BY ALL), b AS (SELECT *, first_value(n) OVER (PARTITION BY episode_id ORDER BY step) AS bn, first_value(w) OVER (PARTITION BY episode_id ORDER BY step) AS bw FROM m)
    SELECT episode_id, step, CASE WHEN bn <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (bn - n) / bn)) END AS n_score, CASE WHEN bw <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (bw - w) / bw)) END AS w_score FROM b""")
def delta_scores_from_sql(spark, sf):
    """Every number of a table of steps, scored against the first step of its episode by a table function."""
    tables.register(spark)
    table(spark, sf, "orders").createOrReplaceTempView("orders_read")
    spark.sql("SELECT o_custkey % 20 AS episode_id, int(year(o_orderdate) * 12 + month(o_orderdate)) AS step, count(*) AS n, sum(o_orderkey % 7) AS w FROM orders_read GROUP BY 1, 2").createOrReplaceTempView("episode_metrics")
    return spark.sql("SELECT * FROM delta_scores(TABLE(episode_metrics))")
