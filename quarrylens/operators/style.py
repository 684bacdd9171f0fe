"""Style rules over the node table and lines, their registry, and scores by dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.paths import file_of, snap_of, test_by_globs
from quarrylens.functions.text import strip
from quarrylens.operators.lines import line_violations
from quarrylens.operators.symbols import FUNCTIONS

#: The weights of the dimensions.
DIMENSIONS = {"naming": 0.30, "docstrings": 0.25, "imports": 0.20, "type_hints": 0.10, "complexity": 0.10, "formatting": 0.05}
#: Code, dimension and severity of each rule; N006 and N008 are registered and never fire. What is said of a rule
#: in a report is our own.
RULES = [
    ("N001", "naming", "error", "name of the module isn't in snake case"),
    ("N002", "naming", "error", "name of the class isn't in capitalized words"),
    ("N003", "naming", "error", "name of the function isn't in snake case"),
    ("N004", "naming", "warning", "literal of the module isn't in upper case"),
    ("N005", "naming", "warning", "variable of the module is named like a class"),
    ("N006", "naming", "warning", "private name doesn't begin with one underscore"),
    ("N007", "naming", "warning", "name has a single letter"),
    ("N008", "naming", "warning", "type variable isn't in capitalized words"),
    ("N009", "naming", "error", "exception class doesn't end in Error"),
    ("N010", "naming", "warning", "function of a test file asserts without test_ in front"),
    ("D001", "docstrings", "error", "public function has no docstring"),
    ("D002", "docstrings", "error", "public class has no docstring"),
    ("D003", "docstrings", "warning", "module has no docstring"),
    ("D004", "docstrings", "warning", "summary of the docstring is too long"),
    ("D005", "docstrings", "warning", "second line of the docstring isn't blank"),
    ("D006", "docstrings", "warning", "docstring of a generator says Returns"),
    ("I001", "imports", "error", "star import"),
    ("I002", "imports", "error", "relative import"),
    ("I003", "imports", "warning", "several imports in one statement"),
    ("I004", "imports", "warning", "import of a class in place of its module"),
    ("I005", "imports", "warning", "import behind those of a later group"),
    ("I006", "imports", "error", "default of an argument can change"),
    ("T001", "type_hints", "warning", "public function doesn't say what it returns"),
    ("T002", "type_hints", "warning", "public function has arguments without a type"),
    ("T003", "type_hints", "error", "except without a type"),
    ("C001", "complexity", "warning", "function has too many branches"),
    ("C002", "complexity", "warning", "line is too long"),
    ("C003", "complexity", "warning", "comprehension has several loops"),
    ("F001", "formatting", "warning", "white space ends the line"),
    ("F002", "formatting", "warning", "less than two blank lines before a definition"),
    ("F003", "formatting", "error", "semicolon between statements"),
    ("F004", "formatting", "error", "tab indents the line"),
]
#: Modules whose names may be imported one by one, methods exempt from naming, names of one letter that are allowed.
TYPING = ["typing", "collections.abc", "typing_extensions", "__future__"]
DUNDER = [
    "__init__", "__new__", "__repr__", "__str__", "__len__", "__eq__", "__hash__", "__call__", "__enter__", "__exit__", "__iter__", "__next__", "__contains__", "__getitem__", "__setitem__", "__delitem__", "__aenter__", "__aexit__", "__await__",
    "__aiter__", "__anext__", "__lt__", "__le__", "__gt__", "__ge__", "__add__", "__radd__", "__iadd__", "__mul__", "__rmul__", "__imul__", "__sub__", "__rsub__", "__isub__", "__truediv__", "__floordiv__", "__mod__", "__pow__", "__and__", "__or__",
    "__xor__", "__invert__", "__lshift__", "__rshift__", "__neg__", "__pos__", "__abs__", "__bool__", "__int__", "__float__", "__complex__", "__bytes__", "__format__", "__sizeof__", "__reduce__", "__reduce_ex__", "__getstate__", "__setstate__",
    "__copy__", "__deepcopy__", "__class_getitem__", "__init_subclass__", "__set_name__", "__get__", "__set__", "__delete__", "__missing__", "__reversed__", "__del__", "__slots__",
]
RULE_COUNTS = "array<struct<rule:string,n:bigint,said:string>>"
SINGLE = ["i", "j", "k", "n", "x", "y", "z", "v", "e", "f", "_"]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, dimension string, severity string, description string")


def snake(name: Column) -> Column:
    return name.rlike(r"^[a-z][a-z0-9_]*$") | (name == "_")


def upper_case(name: Column) -> Column:
    return name.rlike(r"^[A-Z][A-Z0-9_]*$")


def cap_words(name: Column) -> Column:
    return name.rlike(r"^[A-Z][a-zA-Z0-9]*$")


def shouts(name: Column) -> Column:
    return (F.upper(name) == name) & (F.lower(name) != name)


def public(name: Column) -> Column:
    return ~name.startswith("_")


def function_facts(nodes: DataFrame) -> DataFrame:
    """path, func, name, cc, yields, asserts, nested: a row for each function with what stands anywhere below it."""
    return nodes.where(F.col("type").isin(*FUNCTIONS)).select("path", F.col("node").alias("func"), "name", "cc", "yields", "asserts", "nested")


def _tests(max_line: int, max_cc: int) -> list[tuple]:
    """Each rule of syntax as the types of node it reads, a test of the node's row, and what it names."""
    c, name, file = F.col, F.col("name"), file_of(F.col("path"))
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    doc = F.split(strip(c("doc")), "\r\n|[\n\r]", -1)
    summary, second = F.get(doc, F.lit(0)), F.get(doc, F.lit(1))
    top = (c("field") == "targets") & (c("up_type") == "Assign") & (c("open_defs") == 0) & ~(name.startswith("__") & name.endswith("__"))
    literal = c("up_value_type") == "Constant"
    from_ = (c("up_type") == "ImportFrom") & c("up_name").isNotNull()
    starred = F.concat(F.lit("from "), F.coalesce("up_name", F.lit("None")), F.lit(" import *"))
    return [
        ("Module", [("N001", ~stem.isin("__init__", "__main__") & ~snake(stem), stem), ("D003", ~c("has_doc"))]),
        ("ClassDef", [("N002", ~cap_words(name), name), ("N009", F.exists("bases", lambda b: b.contains("Exception") | b.contains("Error")) & ~name.endswith("Error"), name), ("D002", public(name) & ~c("has_doc"), name)]),
        (FUNCTIONS, [
            ("N003", ~name.isin(*DUNDER) & ~snake(name), name), ("N007", (F.length(name) == 1) & ~name.isin(*SINGLE), name),
            ("N010", F.lower(file).contains("test") & public(name) & ~name.startswith("test_") & c("asserts"), name),
            ("D001", public(name) & ~c("has_doc"), name), ("D004", c("has_doc") & (F.length(summary) > max_line), F.concat(F.substring(summary, 1, max_line - 10), F.lit("…"))),
            ("D005", c("has_doc") & (strip(second) != ""), name), ("D006", c("has_doc") & c("yields") & c("doc").contains("Returns:") & ~c("doc").contains("Yields:"), name),
            ("T001", public(name) & ~c("returns"), name), ("T002", public(name) & (c("unannotated") > 0), name), ("I006", c("mutable"), name),
            ("C001", c("cc") > max_cc, F.concat(name, F.lit(" cc="), "cc")), ("C003", c("nested"), name),
        ]),
        ("Import", [("I003", c("count") > 1), ("I005", c("late"))]),
        ("ImportFrom", [("I002", c("level") > 0, F.concat(F.lit("relative level="), "level")), ("I005", c("late"))]),
        ("alias", [("I001", (c("up_type") == "ImportFrom") & (name == "*"), starred), ("I004", from_ & ~c("up_name").isin(*TYPING) & cap_words(name) & ~shouts(name), F.concat(F.lit("from "), "up_name", F.lit(" import "), "name"))]),
        ("Name", [("N004", top & literal & ~upper_case(name) & public(name), name), ("N005", top & ~literal & cap_words(name) & ~shouts(name), name)]),
    ]


def ast_violations(nodes: DataFrame, max_line: int = 80, max_cc: int = 10, compat: bool = True, ignore: tuple[str, ...] = ()) -> DataFrame:
    """rule, path, line, context of the rules that read syntax, without those to ignore; files that don't parse have none.

    One pass over the node table without a shuffle: a rule is a test of a node's own row. With compat, an empty docstring
    breaks its file, which then gives one row with the rule ERROR and no others.
    """
    one = lambda rule, context: F.struct(F.lit(rule).alias("rule"), context.cast("string").alias("context"))
    hits, t = [], F.col("type")
    kept = [k for kinds, _ in _tests(max_line, max_cc) for k in ((kinds,) if isinstance(kinds, str) else kinds) if k != "Name"]
    for kinds, tests in _tests(max_line, max_cc):
        mine = t.isin(*kinds) if isinstance(kinds, tuple) else t == kinds
        hits += [F.when(mine & test, one(rule, *(context or [F.lit("")]))) for rule, test, *context in tests if rule not in ignore]
    # A bare handler is one of every function around it.
    handlers = F.when((t == "ExceptHandler") & F.col("bare") & F.lit("T003" not in ignore), F.transform("func_names", lambda f: one("T003", f)))
    every = F.concat(F.filter(F.array(*hits), lambda x: x.isNotNull()), F.coalesce(handlers, F.array().cast("array<struct<rule:string,context:string>>")))
    if compat:
        error = F.when(t == "Module", F.array(one("ERROR", F.lit("empty docstring")))).otherwise(F.array().cast("array<struct<rule:string,context:string>>"))
        every = F.when(F.col("blank_doc").isNotNull(), error).otherwise(every)
    line = F.when(t.isin("alias", "Name"), F.col("up_line")).when((t == "Module") & F.col("blank_doc").isNotNull() & F.lit(compat), F.col("blank_doc")).otherwise(F.col("line"))
    # Of names only targets are asked for, which few are.
    nodes = nodes.where("status = 'ok'").where(t.isin(*kept) | (t == "Name") & (F.col("field") == "targets") | (t == "ExceptHandler"))
    return nodes.select("path", F.coalesce(line, F.lit(0)).alias("line"), F.explode(every).alias("v")).select("v.rule", "path", "line", "v.context")


def checkable(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, dimension, total: how many things each dimension checks, over all files; a file that doesn't parse counts by its lines.
    Read from the first row of each file."""
    c, lines_ = F.col, F.greatest("n_lines", F.lit(1))
    count = {"naming": c("n_funcs") + c("n_classes") + 1 + c("n_assigns"), "docstrings": c("n_public") + 1, "imports": c("n_imports") + 1, "type_hints": F.greatest(2 * c("n_public"), F.lit(1)), "complexity": c("n_funcs") + c("n_classes") + lines_, "formatting": lines_}
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.when(c("status") == "ok", x).otherwise(lines_).cast("long").alias("n")) for d, x in count.items()))
    by = by or []
    return nodes.where("coalesce(node, 0) = 0").select(*by, F.explode(each).alias("x")).groupBy(*by, "x.dimension").agg(F.sum("x.n").alias("total"))


def zero_filled(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts of each of the values, 0 where there is none."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return every.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def merged_weights(weights: dict[str, float] | None = None) -> dict[str, float]:
    """The weights of the dimensions with changes, by their sum; the usual ones if the sum isn't over 0."""
    kept = {**DIMENSIONS, **(weights or {})}
    kept = kept if sum(kept.values()) > 0 else DIMENSIONS
    return {d: w / sum(kept.values()) for d, w in kept.items()}


def style_scores(violations: DataFrame, totals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """dimension, n, total, score, weight: 1 less the share of what is checked that fails, not below 0."""
    spark = violations.sparkSession
    dims = spark.createDataFrame([(d, w, i) for i, (d, w) in enumerate(merged_weights(weights).items())], "dimension string, weight double, place int")
    n = violations.withColumn("dimension", rule_map(1)[F.col("rule")]).groupBy("dimension").agg(F.count("*").alias("n"))
    out = dims.join(n, "dimension", "left").join(totals, "dimension", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("n") / F.greatest(F.coalesce("total", F.lit(1)), F.lit(1))))


def rule_map(part: int) -> Column:
    """What a rule's code stands for: its dimension (1), severity (2) or what is said of it (3)."""
    return F.create_map(*(F.lit(x) for rule in RULES for x in (rule[0], rule[part])))


def file_violations(nodes: DataFrame, lines: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """rule, path, line, context of both kinds of rules; files that don't parse have none."""
    sound = nodes.where("status = 'ok' AND node = 0").select("path")
    return ast_violations(nodes, ignore=ignore).unionByName(line_violations(lines.join(sound, "path", "left_semi"), ignore=ignore))


def style_metrics(nodes: DataFrame, lines: DataFrame, by: list[str] | None = None, ignore: tuple[str, ...] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """by, raw_score, violations, error_violations, dims (dimension, score), rules (rule, n, said; most first, then by file and
    line) of files that aren't tests; by: columns of paths, none for one row over all. Without files nothing is wrong."""
    by = by or []
    is_file = ~test_by_globs(file_of(F.col("path")))
    nodes, lines = nodes.where(is_file), lines.where(is_file)
    keyed = lambda df: df.withColumn("snap", snap_of(F.col("path")))
    found = keyed(file_violations(nodes, lines, ignore))
    share = merged_weights(weights)
    text = F.struct((-F.col("n")).alias("m"), "place", "rule", "n", "description")
    per = found.groupBy(*by, "rule").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("place")).join(F.broadcast(rules(nodes.sparkSession)), "rule")  # 32 rules
    listed = F.transform(F.array_sort(F.collect_list(text)), lambda x: F.struct(x["rule"].alias("rule"), x["n"].alias("n"), x["description"].alias("said")))
    # One aggregate gives all that is asked of the violations, so that they are found once.
    wrong = [F.sum(F.when(F.col("dimension") == d, F.col("n")).otherwise(0)).alias(f"wrong_{d}") for d in DIMENSIONS]
    counts = per.groupBy(*by).agg(F.sum("n").alias("violations"), F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("error_violations"), listed.alias("rules"), *wrong)
    totals = checkable(keyed(nodes), by).groupBy(*by).agg(*(F.max(F.when(F.col("dimension") == d, F.col("total"))).alias(f"total_{d}") for d in DIMENSIONS))
    both = totals.join(counts, by, "left") if by else totals.crossJoin(counts)  # a row each
    score = {d: F.greatest(F.lit(0.0), 1 - F.coalesce(f"wrong_{d}", F.lit(0)) / F.greatest(f"total_{d}", F.lit(1))) for d in DIMENSIONS}
    any_ = F.col(f"total_{next(iter(DIMENSIONS))}").isNotNull()
    raw = F.when(any_, F.round(reduce(lambda x, y: x + y, (share[d] * score[d] for d in DIMENSIONS)), 4))
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), score[d].alias("score")) for d in DIMENSIONS))
    both = both.withColumns({"raw_score": raw, "dims": F.when(any_, dims).otherwise(F.array().cast("array<struct<dimension:string,score:double>>"))})
    none = F.array().cast(RULE_COUNTS)
    return both.select(*by, F.coalesce("raw_score", F.lit(1.0)).alias("raw_score"), F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("error_violations", F.lit(0)).alias("error_violations"), "dims", F.coalesce("rules", none).alias("rules"))
