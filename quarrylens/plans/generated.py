"""A repository that the test tables describe: a module for each supplier, whose parts follow from its key. Queries read the
modules as source text; their SQL follows from the same keys, and never sees the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import paths
from quarrylens.operators import astfacts, complexity, graph, grading, lines, measures, patches, records, sinks, style, symbols
from quarrylens.plans.registry import query, table
from quarrylens.sources import code, tools

#: What a module has, from its key k and the step t of its snapshot, 0 for a repository without steps.
PARTS = {
    "doc": "k % 5 <> 0", "doc2": "k % 3 <> 1", "uses": "k % 4 = 0", "calls": "k % 5 = 2", "lft": "k % 3 = 0 AND NOT (t >= 1 AND k % 2 = 0)", "dead": "k % 6 = 0 AND t < 2",
    "camel": "k % 7 = 0", "typed": "k % 2 = 0 OR t = 2", "cls": "k % 8 = 0", "test": "k % 10 = 0", "bad": "k % 29 = 4",
}
BASE = "SELECT s_suppkey AS k, s_nationkey AS nation, t FROM supplier CROSS JOIN (SELECT unnest([{steps}]) AS t)"
FLAGS = ", ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END AS {c}" for c, e in PARTS.items())


def modules_sql(steps: str = "0") -> str:
    """The modules by their parts, with the lines on which these stand."""
    return f"""p AS (SELECT *, {FLAGS}, k % 13 + CASE WHEN t = 1 AND k % 3 = 0 THEN 2 ELSE 0 END AS br, k % 4 AS lp, k // 2 AS dep FROM ({BASE.format(steps=steps)})),
        d AS (SELECT *, CASE WHEN test = 1 THEN 'tests' ELSE 'pkg' END AS folder, CASE WHEN camel = 1 THEN 'Work_' ELSE 'work_' END || k AS fn, doc + 6 AS l_class, doc + 6 + 6 * cls AS l_def,
            doc2 + lft + 2 * br + CASE WHEN lp > 0 THEN lp + 1 ELSE 0 END + uses + calls + 1 + dead AS n_body FROM p),
        m AS (SELECT *, folder || '/mod_' || k || '.py' AS path, folder || '.mod_' || k AS module, l_def + n_body - dead AS l_ret, l_def + n_body + bad AS n_lines, nation::VARCHAR AS episode_id, t AS step FROM d)"""


WITH = f"WITH {modules_sql()}"
STEPS = f"WITH {modules_sql('0, 1, 2')}"


def _module_texts(spark: SparkSession, sf: str, steps: tuple[int, ...] = (0,)) -> DataFrame:
    """episode_id, step, path, text."""
    t = spark.createDataFrame([(x,) for x in steps], "t int")
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation")).crossJoin(F.broadcast(t))
    p = p.selectExpr("*", *(f"{e} AS {c}" for c, e in PARTS.items())).withColumn("br", F.expr("int(k % 13 + IF(t = 1 AND k % 3 = 0, 2, 0))")).withColumn("lp", F.col("k") % 4).withColumn("dep", F.floor(F.col("k") / 2))
    text = lambda *found: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in found))
    k, no = F.col("k"), F.array().cast("array<string>")
    some = lambda test, *found: F.when(F.col(test) if isinstance(test, str) else test, F.array(*(F.lit(x) if isinstance(x, str) else x for x in found))).otherwise(no)
    head = F.when(F.col("camel"), "Work_").otherwise("work_")
    types = F.when(F.col("typed"), "(a: int, b: int) -> int:").otherwise("(a, b):")
    branches = F.when(F.col("br") > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest("br", F.lit(1))), lambda i: F.array(F.concat(F.lit("    if a > "), i, F.lit(":")), F.concat(F.lit("        b = b + "), i))))).otherwise(no)
    loops = F.when(F.col("lp") == 1, F.array(*map(F.lit, ["    for x in a:", "        b = b + 1"]))).when(F.col("lp") == 2, F.array(*map(F.lit, ["    for x in a:", "        for y in x:", "            b = b + 1"])))
    loops = loops.when(F.col("lp") == 3, F.array(*map(F.lit, ["    for x in a:", "        for y in x:", "            for z in y:", "                b = b + 1"]))).otherwise(no)
    from_ = text("from pkg.mod_", F.col("dep"), " import work_", F.col("dep"))
    held = F.concat(
        some("doc", text('"""Part ', k, '."""')), F.array(F.lit("import os"), F.lit("import json as j"), from_, F.lit(""), F.lit("")),
        some("cls", text("class Box", k, "(Base):"), '    """Box."""', "    def fill(self, x):", "        return x", "", ""),
        F.array(text("def ", head, k, types)), some("doc2", '    """Work."""'), some("lft", "    left = a"), branches, loops, some("uses", "    print(os)"), some("calls", text("    b = work_", F.col("dep"), "(b)")),
        F.array(F.lit("    return b")), some("dead", "    return a"), some("bad", "def broken(:"),
    )
    folder = F.when(F.col("test"), "tests").otherwise("pkg")
    return p.select(F.col("nation").cast("string").alias("episode_id"), F.col("t").alias("step"), text(folder, "/mod_", k, ".py").alias("path"), F.concat(F.array_join(held, "\n"), F.lit("\n")).alias("text"))


_parsed: dict[tuple, DataFrame] = {}


def files(spark: SparkSession, sf: str) -> DataFrame:
    return _module_texts(spark, sf).select("path", "text")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The node table of the modules, parsed once a session and folder."""
    key = (spark.sparkContext.applicationId, sf, 0)
    if key not in _parsed:
        _parsed[key] = astfacts.ast_nodes(files(spark, sf)).persist()
    return _parsed[key]


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Three steps of each nation's modules, and their node table."""
    key = (spark.sparkContext.applicationId, sf, 3)
    texts = _module_texts(spark, sf, (0, 1, 2))
    if key not in _parsed:
        _parsed[key] = measures.snapshot_nodes(texts).persist()
    return texts, _parsed[key]


HAS_B = "(br > 0 OR lp > 0 OR calls = 1)"
FIRST_B = "CASE WHEN br > 0 THEN l_def + doc2 + lft + 2 WHEN lp > 0 THEN l_def + doc2 + lft + lp + 1 ELSE l_def + doc2 + lft + uses + 1 END"


@query(f"{WITH} SELECT path, CASE WHEN bad = 1 THEN 'partial' ELSE 'ok' END AS status, n_lines FROM m")
def ast_parse_status(spark, sf):
    return nodes(spark, sf).where("node = 0").select("path", "status", "n_lines")


@query(f"""{WITH} SELECT path, 'os' AS name, 'import' AS kind, doc + 1 AS line, 1 AS n FROM m UNION ALL SELECT path, 'j', 'import', doc + 2, 1 FROM m UNION ALL SELECT path, 'work_' || dep, 'import', doc + 3, 1 FROM m
    UNION ALL SELECT path, 'Box' || k, 'class', l_class, 1 FROM m WHERE cls = 1 UNION ALL SELECT path, 'fill', 'function', l_class + 2, 1 FROM m WHERE cls = 1 UNION ALL SELECT path, fn, 'function', l_def, 1 FROM m
    UNION ALL SELECT path, 'left', 'variable', l_def + doc2 + 1, 1 FROM m WHERE lft = 1 UNION ALL SELECT path, 'b', 'variable', {FIRST_B}, br + (lp > 0)::INT + calls FROM m WHERE {HAS_B}""")
def ast_definitions(spark, sf):
    return symbols.definitions(nodes(spark, sf)).groupBy("path", "name", "kind").agg(F.min("line").alias("line"), F.count("*").alias("n"))


@query(f"""{WITH}, u AS (SELECT path, 'a' AS name, 'load' AS kind, lft + br + (lp > 0)::INT + dead AS n FROM m UNION ALL SELECT path, 'b', 'load', br + (lp > 0)::INT + calls + 1 FROM m UNION ALL SELECT path, 'x', 'load', (lp > 1)::INT + cls FROM m
    UNION ALL SELECT path, 'y', 'load', (lp > 2)::INT FROM m UNION ALL SELECT path, 'os', 'load', uses FROM m UNION ALL SELECT path, 'print', unnest(['load', 'call']), uses FROM m UNION ALL SELECT path, 'work_' || dep, unnest(['load', 'call']), calls FROM m
    UNION ALL SELECT path, 'Base', 'load', cls FROM m UNION ALL SELECT path, 'int', 'load', 3 * typed FROM m) SELECT * FROM u WHERE n > 0""")
def ast_usages(spark, sf):
    return symbols.usages(nodes(spark, sf)).groupBy("path", "name", "kind").agg(F.count("*").alias("n"))


@query(f"""{WITH} SELECT path, fn AS name, module || '.' || fn AS qualified_name, 2 AS arg_count, typed = 1 AS has_return_annotation, doc2 = 1 AS has_docstring, n_body + 1 AS body_line_count FROM m
    UNION ALL SELECT path, 'fill', module || '.fill', 2, false, false, 2 FROM m WHERE cls = 1""")
def ast_functions(spark, sf):
    return symbols.function_info(nodes(spark, sf)).select("path", "name", "qualified_name", "arg_count", "has_return_annotation", "has_docstring", "body_line_count")


@query(f"{WITH} SELECT path, 'Box' || k AS name, 'Base' AS base, true AS has_docstring, 1 AS method_count, l_class AS line FROM m WHERE cls = 1")
def ast_classes(spark, sf):
    return symbols.class_info(nodes(spark, sf)).select("path", "name", F.element_at("base_names", 1).alias("base"), "has_docstring", "method_count", "line")


@query(f"""{WITH}, s AS (SELECT sum(2 * typed) AS annotated_params, sum(2 + cls) AS total_params, sum(typed) AS annotated_returns, sum(1 + cls) AS total_functions FROM m)
    SELECT *, annotated_params / total_params AS param_density, annotated_returns / total_functions AS return_density FROM s""")
def annotation_density(spark, sf):
    return symbols.annotation_stats(nodes(spark, sf))


@query(f"{WITH} SELECT path, 'os' AS name, doc + 1 AS line FROM m WHERE uses = 0 UNION ALL SELECT path, 'j', doc + 2 FROM m UNION ALL SELECT path, 'work_' || dep, doc + 3 FROM m WHERE calls = 0")
def unused_imports(spark, sf):
    return symbols.unused_imports(nodes(spark, sf)).select("path", "name", "line")


@query(f"{WITH} SELECT path, module || ':' || fn || '.left' AS name, l_def + doc2 + 1 AS line FROM m WHERE lft = 1")
def unused_variables(spark, sf):
    return symbols.unused_variables(nodes(spark, sf)).select("path", "name", "line")


@query(f"{WITH} SELECT path, l_ret + 1 AS line, 'return' AS after_kind, fn AS function_name FROM m WHERE dead = 1")
def unreachable_next(spark, sf):
    return symbols.unreachable_next(nodes(spark, sf)).select("path", "line", "after_kind", "function_name")


@query(f"{WITH} SELECT path, l_ret + 1 AS line FROM m WHERE dead = 1")
def unreachable_statements(spark, sf):
    return symbols.unreachable(nodes(spark, sf)).select("path", "line")


#: Dead code by kind in a module that is no test.
KINDS = f"""SELECT *, unnest(['unused_import', 'unused_variable', 'unreachable_block', 'dead_class', 'dead_function']) AS kind, unnest([1.0, 0.8, 1.2, 1.5, 1.5]) AS w,
    unnest([3 - uses - calls, lft, dead, cls + camel, 3 + cls + 1 - camel + lft + {HAS_B}::INT]) AS n FROM m WHERE test = 0"""


@query(f"{WITH} SELECT kind, sum(n) AS n FROM ({KINDS}) GROUP BY kind HAVING sum(n) > 0")
def dead_code(spark, sf):
    return symbols.dead_code(nodes(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT round(sum(w * n), 3) AS weighted_total, sum(n) AS raw_count FROM ({KINDS})")
def dead_code_total(spark, sf):
    return symbols.aggregate_dead(symbols.dead_code(nodes(spark, sf))).select("weighted_total", "raw_count")


@query(f"{WITH} SELECT path, 'fill' AS name, l_class + 2 AS line, (SELECT count(*) FROM m WHERE cls = 1) AS n FROM m WHERE cls = 1 AND (SELECT count(*) FROM m WHERE cls = 1) > 1")
def clone_groups(spark, sf):
    return symbols.clone_members(nodes(spark, sf)).select("path", "name", "line", "n")


@query(f"{WITH} SELECT path, unnest(['os', 'j', 'work_' || dep]) AS local, unnest(['os', 'json', 'pkg.mod_' || dep || '.work_' || dep]) AS target FROM m")
def alias_map(spark, sf):
    return graph.alias_map(nodes(spark, sf))


EDGE_ROWS = """SELECT module AS src, unnest(['os', 'json', 'pkg.mod_' || dep]) AS dst, 'IMPORTS' AS kind, 1 AS n FROM m UNION ALL SELECT module || '.Box' || k, 'Base', 'INHERITS', 1 FROM m WHERE cls = 1
    UNION ALL SELECT module || '.' || fn, 'pkg.mod_' || dep || '.work_' || dep, 'CALLS', 2 FROM m WHERE calls = 1"""


@query(f"{WITH} {EDGE_ROWS}")
def dependency_edges(spark, sf):
    return graph.edges(nodes(spark, sf)).where("kind <> 'CALLS' OR dst LIKE 'pkg.%'").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {modules_sql()}, r(node) AS (SELECT 'pkg.mod_' || k || '.work_' || k FROM m WHERE k % 10 = 7 UNION SELECT 'pkg.mod_' || dep || '.work_' || dep FROM r JOIN m ON node = module || '.' || fn WHERE calls = 1) SELECT module || '.' || fn AS qualified_name, 'never_called' AS reason FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE node = module || '.' || fn)")
def dead_symbols(spark, sf):
    public = files(spark, sf).select(F.regexp_extract("path", r"mod_(\d+)", 1).alias("k")).where("k % 10 = 7").select(F.concat(F.lit("pkg.mod_"), "k", F.lit(".work_"), "k").alias("node"))
    return graph.dead_symbols(nodes(spark, sf), public).where("kind = 'function' AND lower(name) LIKE 'work%'").select("qualified_name", "reason")


@query(f"{WITH}, e AS ({EDGE_ROWS}) SELECT dst, count(DISTINCT src) AS callers FROM e WHERE dst LIKE 'pkg.%' GROUP BY dst")
def symbol_callers(spark, sf):
    return graph.callers(graph.edges(nodes(spark, sf))).where("dst LIKE 'pkg.%'")


BROKEN = """SELECT path, 'N003' AS rule, l_def AS line, fn AS context, k, t, test, episode_id FROM m WHERE camel = 1 AND bad = 0 UNION ALL SELECT path, 'D001', l_def, fn, k, t, test, episode_id FROM m WHERE doc2 = 0 AND bad = 0 UNION ALL SELECT path, 'D001', l_class + 2, 'fill', k, t, test, episode_id FROM m WHERE cls = 1 AND bad = 0
    UNION ALL SELECT path, 'D003', 0, '', k, t, test, episode_id FROM m WHERE doc = 0 AND bad = 0 UNION ALL SELECT path, unnest(['T001', 'T002']), l_def, fn, k, t, test, episode_id FROM m WHERE typed = 0 AND bad = 0
    UNION ALL SELECT path, unnest(['T001', 'T002']), l_class + 2, 'fill', k, t, test, episode_id FROM m WHERE cls = 1 AND bad = 0 UNION ALL SELECT path, 'C001', l_def, fn || ' cc=' || (1 + br + lp), k, t, test, episode_id FROM m WHERE 1 + br + lp > 10 AND bad = 0"""
DIMENSION = "CASE rule[1] WHEN 'N' THEN 'naming' WHEN 'D' THEN 'docstrings' WHEN 'T' THEN 'type_hints' ELSE 'complexity' END"
TOTALS = """SELECT *, unnest(['naming', 'docstrings', 'imports', 'type_hints', 'complexity', 'formatting']) AS dimension, unnest([0.30, 0.25, 0.20, 0.10, 0.10, 0.05]) AS weight, unnest([0, 1, 2, 3, 4, 5]) AS place,
    unnest(CASE WHEN bad = 1 THEN [n_lines, n_lines, n_lines, n_lines, n_lines, n_lines] ELSE [2 + 2 * cls, 2 + cls, 4, 2 + 2 * cls, 1 + 2 * cls + n_lines, n_lines] END) AS total FROM m"""
SCORES = f"""v AS ({BROKEN}), c AS (SELECT dimension, sum(total) AS total, any_value(place) AS place FROM ({TOTALS}) GROUP BY dimension), n AS (SELECT {DIMENSION} AS dimension, count(*) AS n FROM v GROUP BY 1),
    s AS (SELECT dimension, place, coalesce(n, 0) AS n, total, greatest(0.0, 1 - coalesce(n, 0) / total) AS score FROM c LEFT JOIN n USING (dimension))"""


@query(f"{WITH} SELECT path, rule, line, context FROM ({BROKEN})")
def style_ast_rules(spark, sf):
    return style.ast_violations(nodes(spark, sf)).select("path", "rule", "line", "context")


@query(f"{WITH}, {SCORES} SELECT dimension, n, total, score FROM s")
def style_dimension_scores(spark, sf):
    n = nodes(spark, sf)
    found = style.file_violations(n, lines.source_lines(files(spark, sf)))
    return style.style_scores(found, style.checkable(n)).select("dimension", "n", "total", "score")


@query(f"{WITH}, v AS ({BROKEN}) SELECT rule, count(*) AS n FROM v GROUP BY rule ORDER BY count(*) DESC, min((path, line)), rule LIMIT 3")
def top_rules(spark, sf):
    return sinks.top_rules(style.file_violations(nodes(spark, sf), lines.source_lines(files(spark, sf))))


@query(f"{WITH}, {SCORES} SELECT dimension, score FROM (SELECT * FROM s ORDER BY score, place LIMIT 2) WHERE score < 1")
def weakest_dimensions(spark, sf):
    n = nodes(spark, sf)
    found = style.file_violations(n, lines.source_lines(files(spark, sf)))
    return sinks.weakest_dimensions(style.style_scores(found, style.checkable(n)))


@query(f"{WITH}, v AS ({BROKEN}) SELECT path, rule, line FROM v WHERE rule NOT IN ('D001', 'T002')")
def style_ignored_rules(spark, sf):
    return style.file_violations(nodes(spark, sf), lines.source_lines(files(spark, sf)), ignore=("D001", "T002")).select("path", "rule", "line")


ESTIMATE = """SELECT path, module || '.' || fn AS name, [0, 2, 4, 5][lp + 1] AS time, 0 AS space, ['no loops or recursion detected', 'single_loop → O(n)', '2_nested_loops → O(n²)', '3_nested_loops → O(n³) or worse'][lp + 1] AS reason, [0.0, 0.0, 3.0, 6.0][lp + 1] AS cost, * FROM m WHERE bad = 0
    UNION ALL SELECT path, module || '.fill', 0, 0, 'no loops or recursion detected', 0.0, * FROM m WHERE bad = 0 AND cls = 1"""


@query(f"{WITH} SELECT name, time, space, reason FROM ({ESTIMATE})")
def complexity_estimates(spark, sf):
    return complexity.repository_estimates(nodes(spark, sf)).select(F.col("qualified_name").alias("name"), "time", "space", F.col("time_reason").alias("reason"))


@query(f"{WITH} SELECT sum(cost) AS cost, count(*) AS n, coalesce(string_agg(DISTINCT reason, ';' ORDER BY reason) FILTER (time > 0), '') AS patterns FROM ({ESTIMATE})")
def complexity_cost(spark, sf):
    return complexity.bigo_metrics(complexity.repository_estimates(nodes(spark, sf))).select(F.col("bigO_cost_sum").alias("cost"), "n", F.array_join("patterns", ";").alias("patterns"))


@query(f"{WITH} SELECT name, cost FROM ({ESTIMATE}) ORDER BY cost DESC, name LIMIT 5")
def complexity_worst(spark, sf):
    rows = complexity.priced(complexity.repository_estimates(nodes(spark, sf))).withColumnRenamed("qualified_name", "name")
    return complexity.top_by(rows, "cost", ["name"]).select("name", "cost")


@query(f"{WITH} SELECT path, fn AS name, 1 + br + lp AS cc FROM m UNION ALL SELECT path, 'fill', 1 FROM m WHERE cls = 1")
def cyclomatic(spark, sf):
    return style.function_facts(nodes(spark, sf)).select("path", "name", "cc")


@query(f"{WITH} SELECT fn AS name, path FROM m")
def module_file_lookup(spark, sf):
    """By the dotted name of every other module, and by the stem of the rest."""
    k = F.regexp_extract("path", r"mod_(\d+)", 1).cast("long")
    f = symbols.function_info(nodes(spark, sf)).where("lower(name) LIKE 'work%'").withColumn("k", k)
    wanted = f.select("name", F.when(F.col("k") % 2 == 0, symbols.module_of(F.col("path"))).otherwise(F.concat(F.lit("mod_"), "k")).alias("module"))
    return graph.module_files(wanted, files(spark, sf)).select("name", "path")


@query(f"{WITH} SELECT path, 'work_' || k AS name, CASE WHEN camel = 1 THEN 0 ELSE l_def END AS line FROM m")
def definition_line(spark, sf):
    wanted = files(spark, sf).select("path", F.concat(F.lit("work_"), F.regexp_extract("path", r"mod_(\d+)", 1)).alias("name"))
    return graph.definition_lines(wanted, nodes(spark, sf))


@query(f"{WITH} SELECT DISTINCT folder AS path, true AS is_dir FROM m UNION ALL SELECT path, false FROM m")
def folder_listing(spark, sf):
    entries = code.tree(files(spark, sf).withColumn("size_bytes", F.length("text").cast("long")))
    return code.listing(entries, recursive=True).select("path", "is_dir")


@query(f"{WITH} SELECT path FROM m WHERE test = 0")
def symbol_file_list(spark, sf):
    return code.symbol_files(files(spark, sf)).select("path")


@query(f"{WITH} SELECT path, CASE k % 5 WHEN 0 THEN 'removed' ELSE 'edited' END AS change, CASE k % 5 WHEN 0 THEN 0 ELSE 1 END AS added, CASE k % 5 WHEN 0 THEN n_lines ELSE 0 END AS removed FROM m WHERE k % 5 < 2 UNION ALL SELECT 'new_' || k || '.py', 'added', 1, 0 FROM m WHERE k % 5 = 2")
def snapshot_diff(spark, sf):
    before = files(spark, sf).withColumn("k", F.regexp_extract("path", r"mod_(\d+)", 1).cast("long"))
    after = before.where("k % 5 <> 0").select("path", F.when(F.col("k") % 5 == 1, F.concat("text", F.lit("x = 1\n"))).otherwise(F.col("text")).alias("text"))
    new = before.where("k % 5 = 2").select(F.concat(F.lit("new_"), "k", F.lit(".py")).alias("path"), F.lit("x\n").alias("text"))
    return code.snapshot_diff(before.select("path", "text"), after.unionByName(new)).select("path", "change", "added", "removed")


@query("""WITH p AS (SELECT p_partkey AS k, 3 + p_size % 20 AS n FROM part)
    SELECT k, array_to_string(list_concat(['l1', 'X' || k, 'Y'], list_transform(range(3, n), lambda i: 'l' || i), ['']), chr(10)) AS text FROM p""")
def diff_apply(spark, sf):
    """Two hunks: the second line becomes two, and the last goes, a line further down than the diff's old lines say."""
    n = 3 + F.col("p_size") % 20
    old = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("l"), i)), "\n"), F.lit("\n"))
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -2,1 +2,2 @@\n-l2\n+X"), "p_partkey", F.lit("\n+Y\n@@ -"), n, F.lit(",1 +"), n + 1, F.lit(",0 @@\n-l"), n, F.lit("\n"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), patches.patched(old, diff).alias("text"))


@query("SELECT 'f' || s_suppkey || '.py' AS path, s_suppkey % 4 IN (0, 3) AS staged, s_suppkey % 4 IN (1, 3) AS unstaged, s_suppkey % 4 = 2 AS untracked FROM supplier")
def git_status(spark, sf):
    mark = F.element_at(F.array(*map(F.lit, ["M  ", " M ", "?? ", "MM "])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return tools.git_status(table(spark, sf, "supplier").select(F.concat(mark, F.lit("f"), "s_suppkey", F.lit(".py")).alias("line")))


@query(f"{WITH} SELECT k AS seq FROM m WHERE k % 4 = 0 AND k % 3 = 0 OR k % 4 = 1 AND test = 1 OR k % 8 = 6 OR k % 4 = 3 AND camel = 1")
def invariants_broken(spark, sf):
    held = files(spark, sf).withColumn("k", F.regexp_extract("path", r"mod_(\d+)", 1).cast("long"))
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ["no_edit", "file_exists", "no_delete", "symbol_present"])), (k % 4 + 1).cast("int"))
    name = F.concat(F.lit("mod_"), "k", F.lit(".py"))
    path = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit("pkg/"), name)).when(k % 8 == 6, F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    rules = held.select(k.alias("seq"), kind.alias("type"), path.alias("path"), F.concat(F.lit("work_"), "k").alias("symbol"), F.lit("m").alias("message"))
    headers = held.where("k % 3 = 0").select(F.concat(F.lit("+++ b/pkg/"), name).alias("line"))
    return grading.invariants_broken(rules, files(spark, sf), symbols.definitions(nodes(spark, sf)), headers).select("seq")


PLACES = "WITH f AS (SELECT CASE s_suppkey % 6 WHEN 0 THEN 'tests/a' || s_suppkey || '.py' WHEN 1 THEN 'test_a' || s_suppkey || '.py' WHEN 2 THEN 'src/test_a' || s_suppkey || '.py' WHEN 3 THEN 'src/a' || s_suppkey || '_test.py' WHEN 4 THEN 'testing/a' || s_suppkey || '.py' ELSE 'src/a' || s_suppkey || '.py' END AS path FROM supplier)"


@query(f"""{PLACES}, p AS (SELECT path, string_split(path, '/') AS p, string_split(path, '/')[-1] AS name FROM f)
    SELECT path, len(list_filter(p[1:len(p)-1], lambda x: starts_with(x, 'test'))) > 0 OR starts_with(name, 'test_') OR ends_with(name, '_test.py') AS lint, starts_with(name, 'test_') OR ends_with(name, '_test.py') OR list_has_any(p, ['tests', 'test']) AS symbol,
        len(list_filter(p, lambda x: starts_with(x, 'test'))) > 0 AS complexity, starts_with(name, 'test_') OR ends_with(name, '_test.py') AS graph, path LIKE 'test\\_%.py' ESCAPE '\\' OR path LIKE '%\\_test.py' ESCAPE '\\' OR path LIKE 'tests/%' AS style FROM p""")
def path_test_files(spark, sf):
    k = F.col("s_suppkey")
    at = F.element_at(F.array(*(F.concat(F.lit(a), k, F.lit(b)) for a, b in (("tests/a", ".py"), ("test_a", ".py"), ("src/test_a", ".py"), ("src/a", "_test.py"), ("testing/a", ".py"), ("src/a", ".py")))), (k % 6 + 1).cast("int"))
    p = F.col("path")
    held = table(spark, sf, "supplier").select(at.alias("path"))
    return held.select("path", paths.test_by_folder_or_name(p).alias("lint"), paths.test_by_name_or_tests(p).alias("symbol"), paths.test_by_any_part(p).alias("complexity"), paths.test_by_name(p).alias("graph"), paths.test_by_globs(p).alias("style"))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k, 'F001' AS rule, 1 AS line FROM s WHERE k % 2 = 1 UNION ALL SELECT k, 'F002', 2 + k % 3 FROM s WHERE k % 3 < 2
    UNION ALL SELECT k, 'F004', 3 + k % 3 FROM s WHERE k % 5 = 0 UNION ALL SELECT k, 'F003', 4 + k % 3 FROM s WHERE k % 7 = 0""")
def line_rules_formatting(spark, sf):
    """Texts whose white space depends on a key: an ideographic space or a no-break space ends a line, a tab stands before a comment."""
    k = F.col("s_suppkey")
    first = F.concat(F.lit("x = 1"), F.when(k % 4 == 1, "\u3000").when(k % 4 == 3, "\xa0").otherwise(""))
    blank = F.array_repeat(F.lit(""), (k % 3).cast("int"))
    rest = F.array(F.lit("def a():"), F.when(k % 5 == 0, "\ty = 2").otherwise("    y = 2"), F.when(k % 7 == 0, "z = 1; w = 2").otherwise("  \u2003# a; b"))
    text = F.array_join(F.concat(F.array(first), blank, rest), "\n")
    held = lines.source_lines(table(spark, sf, "supplier").select(k.cast("string").alias("path"), text.alias("text")))
    return lines.line_violations(held).select(F.col("path").cast("long").alias("k"), "rule", "line")


@query("""WITH s AS (SELECT s_suppkey AS k, 'f' || s_suppkey AS f FROM supplier)
    SELECT k, CASE k % 6 WHEN 0 THEN 'view_file' WHEN 1 THEN 'edit_file' WHEN 2 THEN 'edit_files' WHEN 5 THEN 'submit' ELSE 'list_directory' END AS kind, CASE k % 6 WHEN 0 THEN f WHEN 3 THEN '.' WHEN 4 THEN 'src' WHEN 5 THEN '.' END AS path,
        CASE k % 6 WHEN 1 THEN f END AS patch, CASE k % 6 WHEN 2 THEN f END AS first_patch FROM s""")
def action_parse(spark, sf):
    k = F.col("s_suppkey")
    forms = ['```json\n{"action_type": "view_file", "args": {"path": "f%d"}}\n```', '{"action_type": "edit_file", "args": {"path": "f%d", "new_content": "x"}}', '{"action_type": "edit_files", "args": {"patch": {"path": "f%d", "unified_diff": "d"}}}', "no action", '{"args": {"path": "src"}}', '{"action_type": "submit"}']
    said = F.element_at(F.array(*(F.replace(F.lit(x), F.lit("%d"), k.cast("string")) for x in forms)), (k % 6 + 1).cast("int"))
    a = tools.parse_actions(table(spark, sf, "supplier").select(k.alias("k"), said.alias("text"))).select("k", F.col("action.action_type").alias("kind"), "action.args.*")
    return a.select("k", "kind", "path", F.col("patch.path").alias("patch"), F.get("patches", F.lit(0))["path"].alias("first_patch"))


# Whole graders: from source text and reports to scores and what is said of them. Runs of tools are given, as tools aren't run here.

LINT_N = "sum(br + lft)"
RATE = "(10 + 5 * t + any_value(nation)) / 60"


def _sums(spark: SparkSession, sf: str) -> DataFrame:
    """episode_id, step, nation and what the runs of tools report: entries, passed, failed, covered."""
    t = spark.createDataFrame([(0,), (1,), (2,)], "t int")
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation")).crossJoin(F.broadcast(t))
    p = p.selectExpr("*", *(f"int({e}) AS {c}" for c, e in PARTS.items()), "int(k % 13 + IF(t = 1 AND k % 3 = 0, 2, 0)) AS br", "int(k % 4) AS lp")
    sums = p.groupBy("nation", "t").agg(F.sum(F.col("br") + F.col("lft")).alias("entries"), (3 * F.count("*")).alias("passed"), F.sum("dead").alias("failed"))
    return sums.select(F.col("nation").cast("string").alias("episode_id"), F.col("t").alias("step"), "nation", "entries", "passed", "failed", (10 + 5 * F.col("t") + F.col("nation")).alias("covered"))


def lint_runs(spark, sf):
    s = _sums(spark, sf)
    body = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("{}"), F.col("entries").cast("int")), ","), F.lit("]"))
    failed = (F.col("nation") % 11 == 3) & (F.col("step") == 1)
    return s.select("episode_id", "step", body.alias("stdout"), F.lit(" no such option ").alias("stderr"), F.when(failed, 2).otherwise(1).alias("return_code"), F.lit(False).alias("timed_out"))


def coverage_runs(spark, sf):
    s = _sums(spark, sf)
    said = F.concat("passed", F.lit(" passed, "), "failed", F.lit(" failed in 2s"))
    report = F.concat(F.lit('{"totals":{"covered_lines":'), "covered", F.lit(',"num_statements":60}}'))
    return s.select("episode_id", "step", said.alias("stdout"), F.lit(None).cast("string").alias("report"), report.alias("coverage"), F.lit("").alias("stderr"), F.lit(0).alias("return_code"), ((F.col("nation") % 9 == 4) & (F.col("step") == 1)).alias("timed_out"))


def complexity_runs(spark, sf):
    """What a tool that counts branches says of each file: here, the counts of the node table."""
    n = snapshots(spark, sf)[1]
    rows = n.where(F.col("type").isin(*symbols.FUNCTIONS)).select(paths.snap_of(F.col("path")).alias("snap"), paths.file_of(F.col("path")).alias("file"), F.struct("name", F.col("cc").alias("complexity"), F.lit("A").alias("rank")).alias("x"))
    per = rows.groupBy("snap", "file").agg(F.collect_list("x").alias("l")).groupBy("snap").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("file", "l")))).alias("stdout"))
    failed = (F.col("episode_id").cast("int") % 7 == 2) & (F.col("step") == 2)
    held = paths.snap_keys(per, measures.KEYS)
    return held.select("episode_id", "step", F.when(failed, "").otherwise(F.col("stdout")).alias("stdout"), F.when(failed, 3).otherwise(0).alias("return_code"), F.lit(False).alias("timed_out"))


BASELINE = "first_value({0}) OVER (PARTITION BY episode_id ORDER BY step)"
DELTA = "CASE WHEN {0} <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, ({0} - {1}) / {0})) END"

LINT = f"""l AS (SELECT episode_id, step, CASE WHEN any_value(nation) % 11 = 3 AND step = 1 THEN 0 ELSE {LINT_N} END::BIGINT AS c, any_value(nation) % 11 = 3 AND step = 1 AS failed FROM m GROUP BY episode_id, step),
    lb AS (SELECT *, {BASELINE.format("c")} AS b FROM l), lint AS (SELECT *, {DELTA.format("b", "c")}::DOUBLE AS score, greatest(0, c - b)::DOUBLE AS added FROM lb)"""


@query(f"""{STEPS}, {LINT} SELECT episode_id, step, score, added, CASE WHEN b = 0 THEN 'Lint: baseline was already clean (0 violations).' ELSE 'Lint: ' || b || ' → ' || c || ' violations (' || CASE WHEN c < b THEN '↓' || (b - c) WHEN c > b THEN '↑' || (c - b) ELSE '→0' END || ')  score=' || printf('%.2f', score) END AS said,
    CASE WHEN c > b THEN '[lint] regression: ' || (c - b) || ' new violation(s) introduced vs baseline.' ELSE '' END AS errors, CASE WHEN failed THEN '[lint] ruff failed: no such option' ELSE '' END AS tool_errors FROM lint""")
def grade_lint(spark, sf):
    g = grading.graded(measures.lint_measures(lint_runs(spark, sf)), grading.GRADERS["lint"])
    return g.select("episode_id", "step", "score", "added", *(F.array_join(c, "|").alias(c) for c in ("said", "errors", "tool_errors")))


SYMBOL = f"""y AS (SELECT episode_id, step, round(coalesce(sum(w * n), 0), 3)::DOUBLE AS c, coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT DISTINCT episode_id, step FROM m) LEFT JOIN ({KINDS}) USING (episode_id, step) GROUP BY episode_id, step),
    yb AS (SELECT *, {BASELINE.format("c")} AS b, {BASELINE.format("n")} AS nb FROM y), symbol AS (SELECT *, {DELTA.format("b", "c")}::DOUBLE AS score, round_even(greatest(0.0, c - b), 0)::DOUBLE AS added FROM yb)"""


#: The first three kinds of dead code that are left in a snapshot, file by file, symbols that nothing reaches last.
REMAINING = f"""kn AS (SELECT episode_id, step, kind, sum(n) AS n, min(path) AS first, list_position(['unused_import', 'unused_variable', 'unreachable_block', 'dead_function', 'dead_class'], kind) AS pass FROM ({KINDS}) WHERE n > 0 GROUP BY ALL),
    kt AS (SELECT *, row_number() OVER (PARTITION BY episode_id, step ORDER BY pass > 3, CASE WHEN pass > 3 THEN '' ELSE first END, pass) AS nth FROM kn),
    left_ AS (SELECT episode_id, step, ' Remaining: ' || string_agg(replace(kind, '_', ' ') || ' ×' || n, ', ' ORDER BY nth) || '.' AS remaining FROM kt WHERE nth <= 3 GROUP BY ALL)"""


@query(f"""{STEPS}, {SYMBOL}, {REMAINING} SELECT episode_id, step, score, added, n AS raw_count, c AS weighted_total, 'Dead code: ' || nb || ' → ' || n || ' (' || CASE WHEN nb > n THEN '-' || (nb - n) WHEN nb < n THEN '+' || (n - nb) || ' (regression)' ELSE 'no change' END || '). Weighted: ' || printf('%.1f', b) || ' → ' || printf('%.1f', c) || ' (' || printf('%.0f', score * 100) || '% eliminated).' || coalesce(remaining, '') AS said
    FROM symbol LEFT JOIN left_ USING (episode_id, step)""")
def grade_symbol(spark, sf):
    g = grading.graded(measures.symbol_measures(snapshots(spark, sf)[1]), grading.GRADERS["symbol"], ("raw_count", "weighted_total"))
    return g.select("episode_id", "step", "score", "added", "raw_count", "weighted_total", F.array_join("said", "|").alias("said"))


STYLE = f"""sv AS (SELECT episode_id, t AS step, {DIMENSION} AS dimension, count(*) AS n, count(*) FILTER (rule IN ('N003', 'D001')) AS e FROM ({BROKEN}) WHERE test = 0 GROUP BY ALL),
    st AS (SELECT episode_id, step, dimension, any_value(weight) AS weight, sum(total) AS total FROM ({TOTALS}) WHERE test = 0 GROUP BY ALL),
    sc AS (SELECT episode_id, step, coalesce(round(sum(weight * greatest(0.0, 1 - coalesce(n, 0) / total)), 4), 1.0)::DOUBLE AS c, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(e), 0)::BIGINT AS e FROM (SELECT DISTINCT episode_id, step FROM m) LEFT JOIN st USING (episode_id, step) LEFT JOIN sv USING (episode_id, step, dimension) GROUP BY episode_id, step),
    sb AS (SELECT *, {BASELINE.format("c")} AS b, {BASELINE.format("e")} AS eb FROM sc),
    style AS (SELECT *, round_even(CASE WHEN b >= 1 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END WHEN c < b THEN 0.0 ELSE greatest(0.0, least(1.0, (c - b) / greatest(1 - b, 0.01))) END, 4)::DOUBLE AS score, greatest(0, e - eb)::DOUBLE AS added FROM sb)"""


#: The most frequent rules and the weakest dimensions of each snapshot, as they are told.
TOLD = f"""rc AS (SELECT episode_id, t AS step, rule, count(*) AS n, min({{'p': path, 'l': line}}) AS first FROM ({BROKEN}) WHERE test = 0 GROUP BY episode_id, t, rule), rn AS (SELECT *, row_number() OVER (PARTITION BY episode_id, step ORDER BY n DESC, first, rule) AS nth FROM rc),
    rt AS (SELECT episode_id, step, string_agg(rule || '×' || n || ' (' || substr(d, 1, 30) || '…)', ', ' ORDER BY nth) AS rules FROM rn JOIN (VALUES {", ".join(f"('{r[0]}', '{r[3].replace(chr(39), chr(39) * 2)}')" for r in style.RULES)}) v(rule, d) USING (rule) WHERE nth <= 3 GROUP BY episode_id, step),
    dn AS (SELECT episode_id, step, dimension, greatest(0.0, 1 - coalesce(n, 0) / total) AS s, list_position(['naming', 'docstrings', 'imports', 'type_hints', 'complexity', 'formatting'], dimension) AS nr FROM st LEFT JOIN sv USING (episode_id, step, dimension)),
    dw AS (SELECT *, row_number() OVER (PARTITION BY episode_id, step ORDER BY s, nr) AS nth FROM dn), dt AS (SELECT episode_id, step, string_agg(dimension || '=' || printf('%.0f', s * 100) || '%', ', ' ORDER BY nth) AS dims FROM dw WHERE nth <= 2 AND s < 1 GROUP BY episode_id, step)"""


@query(f"""{STEPS}, {STYLE}, {TOLD} SELECT episode_id, step, score, added, n AS violations, e AS error_violations, c AS raw_score, CASE WHEN score >= 1 THEN '[Style] Gold standard — zero violations (Google Python Style Guide).'
        WHEN c < b THEN '[Style] Regression vs baseline (raw ' || printf('%.2f', c) || ' < baseline ' || printf('%.2f', b) || '). Top violations: ' || coalesce(rules, 'see violations list') || '.'
        ELSE '[Style] delta=' || printf('%.0f', score * 100) || '% (raw ' || printf('%.2f', b) || '→' || printf('%.2f', c) || '). Weakest dims: ' || coalesce(dims, '') || '. Top rules: ' || coalesce(rules, '') || '.' END AS said
    FROM style LEFT JOIN rt USING (episode_id, step) LEFT JOIN dt USING (episode_id, step)""")
def grade_style(spark, sf):
    texts, n = snapshots(spark, sf)
    g = grading.graded(measures.style_measures(n, texts), grading.GRADERS["style"], ("violations", "error_violations", "raw_score"))
    return g.select("episode_id", "step", "score", "added", "violations", "error_violations", "raw_score", F.array_join("said", "|").alias("said"))


COMPLEX = f"""xc AS (SELECT episode_id, step, sum(CASE WHEN test = 0 THEN greatest(0, br + lp - 9) ** 2 ELSE 0 END) AS cost, round(coalesce(sum(1 + br + lp + cls) FILTER (test = 0) / sum(1 + cls) FILTER (test = 0), 0), 3) AS av, sum(CASE WHEN test = 0 AND bad = 0 THEN [0.0, 0.0, 3.0, 6.0][lp + 1] ELSE 0.0 END)::DOUBLE AS o, any_value(nation) % 7 = 2 AND step = 2 AS failed FROM m GROUP BY episode_id, step),
    xd AS (SELECT * REPLACE (CASE WHEN failed THEN 0.0 ELSE cost END::DOUBLE AS cost, CASE WHEN failed THEN 0.0 ELSE av END::DOUBLE AS av) FROM xc),
    xb AS (SELECT *, {BASELINE.format("cost")} AS cb, {BASELINE.format("av")} AS ab, {BASELINE.format("o")} AS ob FROM xd),
    complex AS (SELECT *, round_even(greatest(0.01, least(1.0, 0.55 * CASE WHEN failed THEN {DELTA.format("ab", "av")} ELSE {DELTA.format("cb", "cost")} END + 0.45 * {DELTA.format("ob", "o")})), 4)::DOUBLE AS score FROM xb)"""


@query(f"""{STEPS}, {COMPLEX} SELECT episode_id, step, score, cost AS cc_cost_sum, av AS cc_avg, o AS bigO_cost_sum, CASE WHEN cost > cb OR o > ob THEN '[complexity] regression: CC cost ' || printf('%.1f→%.1f', cb, cost) || ', Big-O cost ' || printf('%.1f→%.1f', ob, o) ELSE '' END AS errors,
    '[Complexity] CC cost: ' || printf('%.1f→%.1f', cb, cost) || ' ' || CASE WHEN cost < cb THEN '↓' WHEN cost > cb THEN '↑' ELSE '→' END || ' (avg CC ' || printf('%.1f→%.1f', ab, av) || '); Big-O cost: ' || printf('%.1f→%.1f', ob, o) || ' ' || CASE WHEN o < ob THEN '↓' WHEN o > ob THEN '↑' ELSE '→' END || '. Score: ' || printf('%.3f', score) || ' (CC×0.55 + BigO×0.45).'
        || coalesce(' Worst fn: ' || chr(39) || w.name || chr(39) || ' (' || w.class || ', cost=' || printf('%.1f', w.cost) || '). Patterns: ' || CASE WHEN w.lp = 0 THEN 'none' ELSE w.reason END || '.', '') || CASE WHEN failed THEN '|[radon: radon exit 3]' ELSE '' END AS said
    FROM complex LEFT JOIN (SELECT episode_id, step, arg_min({{'name': name, 'lp': lp, 'cost': cost, 'class': ['O1', 'ON', 'ON2', 'ON3'][lp + 1], 'reason': reason}}, {{'c': -cost, 'p': path, 'f': place}}) AS w
        FROM (SELECT episode_id, step, path, module || '.' || fn AS name, lp, [0.0, 0.0, 3.0, 6.0][lp + 1] AS cost, ['', 'single_loop → O(n)', '2_nested_loops → O(n²)', '3_nested_loops → O(n³) or worse'][lp + 1] AS reason, 1 AS place FROM m WHERE bad = 0 AND test = 0
            UNION ALL SELECT episode_id, step, path, module || '.fill', 0, 0.0, '', 2 FROM m WHERE bad = 0 AND test = 0 AND cls = 1) GROUP BY ALL) USING (episode_id, step)""")
def grade_complexity(spark, sf):
    m = measures.complexity_measures(snapshots(spark, sf)[1], complexity_runs(spark, sf))
    g = grading.graded(m, grading.GRADERS["complexity"], ("cc_cost_sum", "cc_avg", "bigO_cost_sum"))
    return g.select("episode_id", "step", "score", "cc_cost_sum", "cc_avg", "bigO_cost_sum", F.array_join("errors", "|").alias("errors"), F.array_join("said", "|").alias("said"))


COVER = f"""vc AS (SELECT episode_id, step, any_value(nation) % 9 = 4 AND step = 1 AS late, 3 * count(*) AS p, sum(dead)::BIGINT AS f, round({RATE}, 4)::DOUBLE AS c FROM m GROUP BY episode_id, step, t),
    vd AS (SELECT *, CASE WHEN late THEN 0.0 ELSE round(p / (p + f), 4) END::DOUBLE AS rate, CASE WHEN late THEN 0.0 ELSE c END::DOUBLE AS cov FROM vc), vb AS (SELECT *, {BASELINE.format("cov")} AS b FROM vd)"""


@query(f"""{STEPS}, {COVER} SELECT episode_id, step, round_even(CASE WHEN late THEN 0.0 ELSE rate * CASE WHEN cov >= b - 0.02 THEN 1.0 ELSE 0.5 END END, 4)::DOUBLE AS score, round_even(CASE WHEN late THEN 0.0 ELSE rate * greatest(0.0, least(1.0, (cov - b) / greatest(0.8 - b, 0.01))) END, 4)::DOUBLE AS objective,
    CASE WHEN late THEN '[Coverage] pytest did not complete: pytest timed out' ELSE '[Coverage/constraint] ' || p || '/' || (p + f) || ' tests pass (' || printf('%.0f', rate * 100) || '%). Coverage: ' || printf('%.1f', b * 100) || '% → ' || printf('%.1f', cov * 100) || '% (' || CASE WHEN round((cov - b) * 100, 1) >= 0 THEN '+' ELSE '' END || printf('%.1f', round((cov - b) * 100, 1)) || 'pp)' || CASE WHEN cov >= b - 0.02 THEN '.' ELSE ' — dropped beyond 2% tolerance; score halved.' END END AS said FROM vb""")
def grade_coverage(spark, sf):
    """Both ways to see coverage: as something to keep, and as something to raise."""
    m = measures.coverage_measures(coverage_runs(spark, sf))
    keep, raise_ = (grading.graded(m, grading.coverage_grader(mode)) for mode in ("constraint", "objective"))
    both = keep.join(raise_.select("episode_id", "step", F.col("score").alias("objective")), ["episode_id", "step"])
    return both.select("episode_id", "step", "score", "objective", F.array_join("said", "|").alias("said"))


SPECS = [("lint", 0.30, 0), ("symbol", 0.20, 1), ("style", 0.20, 2), ("complexity", 0.15, 3), ("coverage", 0.15, 4)]


@query(f"""{STEPS}, {LINT}, {SYMBOL}, {STYLE}, {COMPLEX}, {COVER}
    SELECT episode_id, step, printf('%.4f', 0.30 * l.score + 0.20 * y.score + 0.20 * s.score + 0.15 * x.score + 0.15 * CASE WHEN late THEN 0.0 ELSE round_even(rate * CASE WHEN cov >= v.b - 0.02 THEN 1.0 ELSE 0.5 END, 4) END)::DOUBLE AS step_score, l.added > 0 OR y.added > 0 OR s.added > 0 AS is_regression,
        concat_ws(',', CASE WHEN l.added > 0 THEN l.added::BIGINT END, CASE WHEN y.added > 0 THEN printf('%.1f', y.added) END, CASE WHEN s.added > 0 THEN s.added::BIGINT END) AS penalties, 5 + CASE WHEN x.failed THEN 1 ELSE 0 END AS n_said
    FROM lint l JOIN symbol y USING (episode_id, step) JOIN style s USING (episode_id, step) JOIN complex x USING (episode_id, step) JOIN vb v USING (episode_id, step)""")
def grade_episode(spark, sf):
    """A whole pass: three snapshots of each episode, measured by five graders and weighed."""
    texts, n = snapshots(spark, sf)
    specs = spark.createDataFrame(SPECS, "grader_id string, weight double, place int")
    out = measures.grade_all(texts, n, lint_runs(spark, sf), complexity_runs(spark, sf), coverage_runs(spark, sf), specs)
    return out.select("episode_id", "step", "step_score", "is_regression", F.array_join("penalties", ",").alias("penalties"), F.size("said").alias("n_said"))


@query("SELECT round(avg(s), 6) AS overall FROM (SELECT arg_max(o_totalprice, o_orderkey) AS s FROM orders GROUP BY o_custkey)")
def overall_mean(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("step_score"))
    return grading.overall(o).select(F.round("overall", 6).alias("overall"))


@query("SELECT s_nationkey::VARCHAR AS task_id, round(sum(s_suppkey % 3 / 3.0), 9) AS total FROM supplier GROUP BY 1 HAVING abs(sum(s_suppkey % 3 / 3.0) - 1) > 0.01")
def weights_off(spark, sf):
    specs = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("task_id"), (F.col("s_suppkey") % 3 / 3.0).alias("weight"))
    return grading.weights_off(specs).select("task_id", F.round("total", 9).alias("total"))


@query("SELECT o_orderkey, (SELECT list_sort(list(r_name)) FROM region)[o_orderkey % (SELECT count(*) FROM region) + 1] AS task FROM orders")
def round_robin(spark, sf):
    return records.round_robin(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("count")), table(spark, sf, "region").select(F.col("r_name").alias("task"))).select("o_orderkey", "task")


@query("SELECT event_id, user_id % 20 + 15 - event_id % 40 AS remaining FROM events")
def remaining_budget(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 20 + 15).alias("max_steps"), (F.col("event_id") % 40).alias("step"))
    return records.remaining(e).select("event_id", "remaining")


@query("SELECT p_partkey, p_partkey % 4 IN (0, 2) AS safe FROM part")
def path_escapes(spark, sf):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("a/../b/"), k)).when(k % 4 == 1, F.concat(F.lit("a/../../b/"), k)).when(k % 4 == 2, F.concat(F.lit("./x"), k)).otherwise(F.concat(F.lit("/etc/"), k))
    return table(spark, sf, "part").select("p_partkey", paths.safe(path).alias("safe"))


@query("""SELECT p_partkey, 'Item ' || p_partkey || ': ' || p_size || chr(10) || CASE WHEN p_size > 30 THEN '  -> High value detected: ' || p_size || chr(10) || '    - Detail 1' || chr(10) || '    - Detail 2' || chr(10) || '    - Detail 3' || chr(10) ELSE '' END AS said FROM part WHERE p_size % 7 <> 0""")
def item_report(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("place"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("processed_value"))
    return records.item_report(rows, threshold=30).select(F.col("place").alias("p_partkey"), "said")


@query("WITH RECURSIVE t(node, level) AS (SELECT 1, 0 UNION ALL SELECT node * 2 + b, level + 1 FROM t, (VALUES (0), (1)) v(b) WHERE level < 4) SELECT node, level, 'analyzed_' || level AS analysis, (SELECT count(*) FROM region) AS data_count FROM t WHERE level < 4 UNION ALL SELECT node, level, 'max_depth_reached', NULL FROM t WHERE level = 4")
def tree_recursion(spark, sf):
    return records.recursive_analysis(table(spark, sf, "region"), 4)


@query("SELECT true AS whole, count(*) = count(c_acctbal) AND bool_and(c_custkey % 97 <> 0) AS broken FROM customer")
def self_check(spark, sf):
    """Records that all have their fields pass the check, and records of which some lack one don't."""
    c = table(spark, sf, "customer")
    whole = c.select(F.create_map(F.lit("id"), "c_custkey", F.lit("value"), F.col("c_acctbal").cast("long")).alias("m"))
    broken = c.select(F.when(F.col("c_custkey") % 97 == 0, F.create_map(F.lit("value"), F.lit(1))).otherwise(F.create_map(F.lit("id"), F.lit(1))).alias("m"))
    return records.self_check(whole, broken, "id", "m")


@query("SELECT c_custkey * 2 AS c_custkey, upper(c_name) AS c_name FROM customer WHERE c_acctbal > 0")
def record_active(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 0).alias("active"))
    return records.doubled(records.active(rows)).select("c_custkey", "c_name")
