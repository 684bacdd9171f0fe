"""Definitions, usages, unused and unreachable code, clones: relations over the node table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.paths import file_of, snap_of, test_by_name_or_tests

#: How much each kind of dead code counts.
WEIGHTS = {"unused_import": 1.0, "unused_variable": 0.8, "dead_function": 1.5, "dead_class": 1.5, "unreachable_block": 1.2}
TERMINATORS = ("Return", "Raise", "Continue", "Break")
FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
BLOCKS = ("body", "orelse", "finalbody")
#: The pass of dead_code that comes after all files.
LAST = 3


def module_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file_of(path), r"[/\\]", "."), r"\.py$", "")


def _is_def() -> Column:
    return F.col("type").isin(*FUNCTIONS, "ClassDef")


def local_name() -> Column:
    """What an alias binds: its own name, or the first part of what import names, or what from-import names."""
    return F.coalesce("as_name", F.when(F.col("up_type") == "Import", F.element_at(F.split("name", r"\."), 1)).otherwise(F.col("name")))


def definitions(nodes: DataFrame) -> DataFrame:
    """path, name, qualified_name, kind, line, col, is_public, is_in_all, pre."""
    t = F.col("type")
    kind = F.when(t == "ClassDef", "class").when(t == "AsyncFunctionDef", "async_function").when(t == "FunctionDef", "function")
    kind = kind.when((t == "alias") & ((F.col("up_type") == "Import") | (F.col("name") != "*")), "import")
    kind = kind.when((t == "Name") & F.col("field").isin("targets", "target") & F.col("up_type").isin("Assign", "AnnAssign") & (F.col("open_defs") <= 1), "variable")
    alias = t == "alias"
    found = nodes.withColumn("kind", kind).where("kind is not null").withColumn("local", F.when(alias, local_name()).otherwise(F.col("name")))
    line, col = F.when(_is_def(), F.col("line")).otherwise(F.col("up_line")), F.when(alias, F.col("up_col")).otherwise(F.col("col"))
    return found.select("path", F.col("local").alias("name"), F.concat_ws(".", "scope", "local").alias("qualified_name"), "kind", line.alias("line"), col.alias("col"), (~F.startswith("local", F.lit("_"))).alias("is_public"), F.coalesce("in_all", F.lit(False)).alias("is_in_all"), "pre")


def usages(nodes: DataFrame) -> DataFrame:
    """path, name, qualified_name, kind (load, attribute, call), line, col, caller; a call of a name is a load and a call."""
    t, load = F.col("type"), F.col("ctx") == "Load"
    dotted = (t == "Attribute") & F.col("owner").isNotNull()
    called = (F.col("field") == "func") & (F.col("up_type") == "Call")
    kinds = F.array(F.when((t == "Name") & load, "load"), F.when(dotted & load, "attribute"), F.when(called & ((t == "Name") & load | dotted), "call"))
    qualified = F.concat_ws(".", "owner", "name")
    return nodes.where(t.isin("Name", "Attribute")).select("path", "name", qualified.alias("qualified_name"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), "line", "col", "caller")


def function_info(nodes: DataFrame) -> DataFrame:
    """A row for each function: its arguments (self and cls too), annotations, docstring, lines and decorators."""
    return nodes.where(F.col("type").isin(*FUNCTIONS)).select(
        "path", "node", "name", F.concat_ws(".", module_of(F.col("path")), "name").alias("qualified_name"), "line", (F.col("type") == "AsyncFunctionDef").alias("is_async"), "arg_count", "unannotated", "params",
        F.col("returns").alias("has_return_annotation"), F.col("has_doc").alias("has_docstring"), (F.col("end_line") - F.col("line") + 1).alias("body_line_count"), F.col("decorators").alias("decorator_names"),
    )


def class_info(nodes: DataFrame) -> DataFrame:
    """A row for each class: bases, docstring, methods of its own body."""
    return nodes.where("type = 'ClassDef'").select("path", "name", F.concat_ws(".", module_of(F.col("path")), "name").alias("qualified_name"), "line", F.col("bases").alias("base_names"), F.col("has_doc").alias("has_docstring"), F.col("methods").alias("method_count"))


def annotation_stats(nodes: DataFrame) -> DataFrame:
    """One row: annotated and all parameters (without self and cls), annotated returns and all functions, densities."""
    f = function_info(nodes)
    one = f.agg(F.coalesce(F.sum(F.col("params") - F.col("unannotated")), F.lit(0)).alias("annotated_params"), F.coalesce(F.sum("params"), F.lit(0)).alias("total_params"), F.count_if("has_return_annotation").alias("annotated_returns"), F.count("*").alias("total_functions"))
    return one.withColumn("param_density", F.col("annotated_params") / F.greatest("total_params", F.lit(1))).withColumn("return_density", F.col("annotated_returns") / F.greatest("total_functions", F.lit(1)))


def unused_imports(nodes: DataFrame) -> DataFrame:
    """kind, name, path, line, weight of imports that no name, attribute or call of the file uses."""
    local = F.coalesce("as_name", F.element_at(F.split("name", r"\."), 1))
    bound = nodes.where("type = 'alias' AND name <> '*'").select("path", local.alias("name"), F.col("up_line").alias("line"), F.col("node").alias("seq"))
    return bound.join(usages(nodes).select("path", "name"), ["path", "name"], "left_anti").select(F.lit("unused_import").alias("kind"), "name", "path", "line", F.lit(WEIGHTS["unused_import"]).alias("weight"), "seq")


def unused_variables(nodes: DataFrame) -> DataFrame:
    """Names that a module or function body assigns, not private and not upper case, and that nothing below the body loads."""
    assigns = nodes.where("type IN ('Assign', 'AnnAssign') AND field = 'body'").where(F.col("up_type").isin("Module", *FUNCTIONS)).select("path", F.col("node").alias("parent"), F.col("parent").alias("body"), F.col("up_name").alias("func"), F.col("line").alias("at"), F.col("idx").alias("order"))
    stored = nodes.where("type = 'Name' AND field IN ('targets', 'target') AND up_type IN ('Assign', 'AnnAssign') AND NOT startswith(name, '_')").where(~((F.upper("name") == F.col("name")) & (F.lower("name") != F.col("name"))))
    assigned = stored.join(assigns, ["path", "parent"]).groupBy("path", "body", "func", "name").agg(F.max_by("at", F.struct("order", "idx")).alias("line"), F.min("node").alias("seq"))
    # A load belongs to the module and to the body of every function around it, unless it stands in that function's head.
    bodies = F.array_except(F.concat(F.array(F.lit(0)), "funcs"), "heads")
    loaded = nodes.where("type = 'Name' AND ctx = 'Load'").select("path", F.explode(bodies).alias("body"), "name").distinct()
    unused = assigned.join(loaded, ["path", "body", "name"], "left_anti")
    label = F.when(F.col("body") == 0, module_of(F.col("path"))).otherwise(F.concat(module_of(F.col("path")), F.lit(":"), "func"))
    return unused.select(F.lit("unused_variable").alias("kind"), F.concat_ws(".", label, "name").alias("name"), "path", "line", F.lit(WEIGHTS["unused_variable"]).alias("weight"), "seq")


def any_before(test: Column, partition: list[str], order: list[str]) -> Column:
    """Whether a row before this one passes the test."""
    return F.coalesce(F.max(test).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))


def just_before(value: Column | str, partition: list[str], order: list[str]) -> Column:
    return F.lag(value).over(Window.partitionBy(*partition).orderBy(*order))


def statements(nodes: DataFrame) -> DataFrame:
    """Statements with the block they stand in (parent, field) and whether they end it."""
    held = nodes.where(F.col("field").isin(*BLOCKS) & F.col("line").isNotNull())
    return held.withColumn("ends", F.col("type").isin(*TERMINATORS)).withColumn("block", F.struct("parent", "field"))


def unreachable(nodes: DataFrame) -> DataFrame:
    """Every statement after one that ends its block; blocks of match statements aren't looked at."""
    dead = statements(nodes).where("up_type <> 'match_case'").withColumn("dead", any_before(F.col("ends"), ["path", "block"], ["idx"])).where("dead")
    return dead.select(F.lit("unreachable_block").alias("kind"), F.concat(module_of(F.col("path")), F.lit(":"), "field", F.lit("@"), "parent", F.lit(":unreachable@L"), "line").alias("name"), "path", "line", F.lit(WEIGHTS["unreachable_block"]).alias("weight"), F.col("node").alias("seq"))


def unreachable_next(nodes: DataFrame) -> DataFrame:
    """Within functions, the statement right after one that ends its block, unless it is pass or an ellipsis; a statement of
    nested functions is given once for each."""
    block = ["path", "block"]
    s = statements(nodes).where(F.size("funcs") > 0).withColumn("after", F.when(just_before("ends", block, ["idx"]), F.lower(just_before("type", block, ["idx"])))).where("after is not null")
    s = s.where("type <> 'Pass' AND NOT (type = 'Expr' AND coalesce(value_const, '') = 'ellipsis')")
    around = F.when(F.col("type").isin(*FUNCTIONS), F.slice("func_names", 1, F.greatest(F.size("funcs") - 1, F.lit(0)))).otherwise(F.col("func_names"))
    return s.select("path", "line", F.col("after").alias("after_kind"), F.explode(around).alias("function_name"))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def aggregate_dead(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of dead code (kind, name, path, weight, pass, seq), for each value of by: weighted_total, raw_count, by_kind, and kinds in
    the order in which they come: file by file, symbols that nothing reaches last. Of equal path and name the first counts."""
    by = by or []
    unique = first_per_key(rows, [*by, "path", "name"], ["pass", "seq"])
    place = F.min(F.struct((F.col("pass") == LAST).alias("last"), "path", "pass", "seq"))
    kinds = unique.groupBy(*by, "kind").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), place.alias("place"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"])  # five kinds
    return kinds.groupBy(*by).agg(F.coalesce(F.round(F.sum("w"), 3), F.lit(0.0)).alias("weighted_total"), F.coalesce(F.sum("n"), F.lit(0)).alias("raw_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"), order.alias("kinds"))


def dead_code(nodes: DataFrame, reachable: DataFrame | None = None, skip_tests: bool = True) -> DataFrame:
    """The four passes together: unused imports and variables, unreachable statements, and symbols that reachable
    (qualified_name) doesn't hold. Without reachable no symbol is live. Test files are left out with skip_tests."""
    nodes = nodes.where(~test_by_name_or_tests(file_of(F.col("path")))) if skip_tests else nodes
    snap = snap_of(F.col("path")).alias("snap")
    symbols = definitions(nodes).groupBy(snap, "qualified_name").agg(F.max_by(F.struct("path", "name", "line"), F.struct("path", "pre")).alias("s"), F.min("pre").alias("seq"))
    symbols = symbols.join(reachable, "qualified_name", "left_anti") if reachable is not None else symbols
    first_upper = F.substring("s.name", 1, 1) != F.lower(F.substring("s.name", 1, 1))
    kind = F.when(first_upper, "dead_class").otherwise("dead_function")
    callables = symbols.select(kind.alias("kind"), F.col("qualified_name").alias("name"), F.col("s.path").alias("path"), F.col("s.line").alias("line"), F.lit(WEIGHTS["dead_function"]).alias("weight"), "seq")
    parts = [unused_imports(nodes), unused_variables(nodes), unreachable(nodes), callables]
    return reduce(DataFrame.unionByName, [part.withColumn("pass", F.lit(i)) for i, part in enumerate(parts)])


def clone_members(nodes: DataFrame, kinds: tuple[str, ...] = FUNCTIONS) -> DataFrame:
    """norm_hash, path, name, line, n of definitions whose shape others have too: a row each, however many they are."""
    found = nodes.where(F.col("type").isin(*kinds)).select("norm_hash", "path", "name", "line")
    often = found.groupBy("norm_hash").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(often, "norm_hash")


#: How much a stretch counts whose first occurrence is in another file.
CROSS_FILE = 1.2


def clone_runs(nodes: DataFrame) -> DataFrame:
    """path, line, end_line, statements, cross_file, weight: stretches of statements of functions that have come before.

    A window of three statements of a block has come before if the first window of its shape, by path and place in the
    snapshot, stands in another block or three statements or more before. Windows one statement apart make one stretch, so
    a copied block is one row and not one for each window; every copy but the first gives one. Windows meet the first of
    their shape alone, and no pairs of copies are made.
    """
    w = nodes.where("window IS NOT NULL").select(snap_of(F.col("path")).alias("snap"), "window", "path", "parent", "field", "idx", "line")
    first = w.groupBy("snap", "window").agg(F.min(F.struct("path", "parent", "field", "idx")).alias("f"))
    same = (F.col("f.path") == F.col("path")) & (F.col("f.parent") == F.col("parent")) & (F.col("f.field") == F.col("field"))
    hits = w.join(first, ["snap", "window"]).where(~same | (F.col("idx") - F.col("f.idx") >= 3)).withColumn("cross", F.col("f.path") != F.col("path"))
    block = ["path", "parent", "field"]
    runs = hits.withColumn("run", F.col("idx") - F.row_number().over(Window.partitionBy(*block).orderBy("idx"))).groupBy(*block, "run")
    found = runs.agg(F.min("line").alias("line"), F.min("idx").alias("idx"), (F.max("idx") + 2).alias("last"), F.max("cross").alias("cross_file"))
    ends = nodes.where("line IS NOT NULL AND parent IS NOT NULL").select(*block, F.col("idx").alias("last"), "end_line")
    out = found.join(ends, [*block, "last"])
    return out.select("path", "line", "end_line", (F.col("last") - F.col("idx") + 1).alias("statements"), "cross_file", F.when(F.col("cross_file"), CROSS_FILE).otherwise(1.0).alias("weight"))
