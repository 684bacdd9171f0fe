"""Estimates of time and space complexity from syntax, and costs over a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions.paths import file_of, snap_of, test_by_name
from quarrylens.operators.symbols import module_of

#: Classes in order with their costs.
CLASSES = [(0, "O1", 0.0), (1, "OLOGN", 0.0), (2, "ON", 0.0), (3, "ONLOGN", 1.0), (4, "ON2", 3.0), (5, "ON3", 6.0), (6, "ONEXP", 10.0), (7, "UNKNOWN", 2.0)]
O1, OLOGN, ON, ONLOGN, ON2, ON3, ONEXP = range(7)
MEMO = ("lru_cache", "cache")
#: What is said of each pattern.
SAID = {
    "concat": "str_concat_in_loop → use ''.join(parts)",
    "search": "linear_search_in_loop → convert to set()",
    "index": "list.index_in_loop → use dict/set for O(1) lookup",
    "sort": "sort_in_loop → O(n² log n), sort once outside loop",
    "head": "list.insert(0,x)_in_loop → use collections.deque.appendleft()",
    "nested": "nested_comprehension → O(n²) or worse",
    "memo": "memoized_recursion → O(n log n) or better",
    "halving": "tail_recursion_with_halving → O(log n)",
    "single": "single_recursion → O(n)",
    "loop_sorted": "single_loop_with_sort_or_halving → O(n log n)",
    "loop": "single_loop → O(n)",
    "loops2": "2_nested_loops → O(n²)",
    "lists": "list_of_lists_accumulation → consider generator/streaming",
    "no_time": "no loops or recursion detected",
    "no_space": "in-place or constant extra space",
    "builds": "list/set/dict comprehension → O(n) space",
    "stack": "recursion_stack → O(depth) space",
}


def costs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "time int, class string, cost double")


def function_signals(nodes: DataFrame) -> DataFrame:
    """A row for each function: what its whole subtree shows. Every node counts for all functions around it."""
    held = nodes.where((F.col("status") == "ok") & (F.size("funcs") > 0))
    inside = held.withColumn("f", F.explode(F.arrays_zip("funcs", "func_names", "func_depths"))).withColumns({"func": F.col("f.funcs"), "own": F.col("f.func_names"), "own_depth": F.col("f.func_depths")})
    t, c = F.col("type"), F.col
    # A loop of the function around the node: one whose id is not below the function's own, as ids grow downwards.
    looped = F.exists("loops", lambda x: x > F.col("func"))
    method, call = (c("callee_type") == "Attribute"), t == "Call"
    is_in = F.concat(F.lit(" "), "op", F.lit(" ")).contains(" In ") & (t == "Compare")
    by_index = call & method & (c("callee") == "index")
    first_loop = F.filter("loops", lambda x: x > F.col("func"))[0]
    some = lambda x: F.coalesce(F.max(x), F.lit(False))
    return inside.groupBy("path", "func", "own").agg(
        F.max(F.when(t.isin("For", "While"), F.col("loop_depth") - F.col("own_depth")).otherwise(0)).alias("nesting"), F.count_if(call & (c("callee_type") == "Name") & (c("callee") == c("own"))).alias("recursive"),
        some(looped & (t == "AugAssign") & (c("op") == "Add") & (c("target_type") == "Name")).alias("concat"), F.min_by(F.when(is_in, "search").otherwise("index"), F.when(looped & (is_in | by_index), F.struct(first_loop.alias("l"), c("node")))).alias("which"),
        some(looped & (is_in | by_index)).alias("search"), some(looped & call & ((c("callee_type") == "Name") & (c("callee") == "sorted") | method & (c("callee") == "sort"))).alias("sort"),
        some(looped & call & method & (c("callee") == "insert") & (c("arg_type") == "Constant") & ((c("arg_const").isin("int", "float") & (c("arg_value").cast("double") == 0)) | (c("arg_const") == "bool") & (c("arg_value") == "False"))).alias("head"),
        some(t.isin("ListComp", "SetComp", "GeneratorExp") & (c("count") >= 2)).alias("nested"), some(looped & call & method & (c("callee") == "append") & c("arg_type").isin("ListComp", "List")).alias("lists"),
        some(t.isin("ListComp", "SetComp", "DictComp")).alias("builds"),
        some((t == "AugAssign") & c("op").isin("FloorDiv", "RShift") & c("value_text").isin("1", "2", "1.0", "2.0", "True") & (c("value_const") != "str") | call & c("callee").startswith("bisect") | (t == "Slice") & (c("field") == "slice") & c("floors")).alias("halves"),
        some((c("field") == "decorator_list") & (c("parent") == c("func")) & (t.isin("Name", "Attribute") & c("name").isin(*MEMO) | call & (c("callee_type") == "Name") & c("callee").isin(*MEMO))).alias("memo"),
        some((c("parent") == c("func")) & call & ((c("callee_type") == "Name") & (c("callee") == "sorted") | method & c("callee").isin("sort", "sorted"))).alias("top_sort"),
    )


def estimate(signals: DataFrame) -> DataFrame:
    """path, qualified_name, time, space, their reasons and the patterns, from a function's signals; of candidates in
    order the first that is worse than all before it gives the reason."""
    c = F.col
    many = F.concat(F.lit("recursive_"), "recursive", F.lit("_branches_no_memo → add @lru_cache"))
    deep = F.concat("nesting", F.lit("_nested_loops → O(n³) or worse"))
    one = lambda test, time, said: F.when(test, F.struct(F.lit(time).alias("time"), (F.lit(SAID[said]) if isinstance(said, str) else said).alias("said")))
    calls, once = c("recursive") > 0, c("recursive") == 1
    early = F.array(
        one(c("concat"), ON2, "concat"), one(c("search") & (c("which") == "search"), ON2, "search"), one(c("search") & (c("which") == "index"), ON2, "index"), one(c("sort"), ON2, "sort"), one(c("head"), ON2, "head"), one(c("nested"), ON2, "nested"),
        one(calls & c("memo"), ONLOGN, "memo"), one(~c("memo") & (c("recursive") >= 2), ONEXP, many), one(~c("memo") & once & c("halves"), OLOGN, "halving"), one(~c("memo") & once & ~c("halves"), ON, "single"),
    )
    fast = c("top_sort") | c("halves")
    late = F.array(one((c("nesting") == 1) & fast, ONLOGN, "loop_sorted"), one((c("nesting") == 1) & ~fast, ON, "loop"), one(c("nesting") == 2, ON2, "loops2"), one(c("nesting") >= 3, ON3, deep))
    kept = lambda a: F.filter(a, lambda x: x.isNotNull())
    worst = lambda a: F.coalesce(F.array_max(F.transform(a, lambda x: x["time"])), F.lit(O1))
    df = signals.withColumn("early", kept(early)).withColumn("found", F.when(worst(c("early")) < ON2, F.concat("early", kept(late))).otherwise(c("early")))
    first = lambda a, top, none: F.when(top == O1, F.lit(none)).otherwise(F.filter(a, lambda x: x["time"] == top)[0]["said"])
    time = worst(c("found"))
    space = F.when(c("lists"), ON2).when(c("builds") | calls & ~c("memo"), ON).otherwise(O1)
    space_reason = F.when(c("lists"), SAID["lists"]).when(c("builds"), SAID["builds"]).when(calls & ~c("memo"), SAID["stack"]).otherwise(SAID["no_space"])
    return df.select("path", "func", F.concat_ws(".", module_of(c("path")), "own").alias("qualified_name"), time.alias("time"), space.alias("space"), first(c("found"), time, SAID["no_time"]).alias("time_reason"), space_reason.alias("space_reason"), F.transform("found", lambda x: x["said"]).alias("patterns"))


def repository_estimates(nodes: DataFrame, skip_tests: bool = False) -> DataFrame:
    """One estimate for each name of a snapshot: of functions with one qualified name the last in breadth-first order counts."""
    nodes = nodes.where(~test_by_name(file_of(F.col("path")))) if skip_tests else nodes
    last = Window.partitionBy("snap", "qualified_name").orderBy(F.desc("path"), F.desc("func"))
    return estimate(function_signals(nodes)).withColumn("snap", snap_of(F.col("path"))).withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def quadratic_cost(cc: Column, threshold: int = 10) -> Column:
    return F.pow(F.greatest(F.lit(0), cc - threshold), F.lit(2))


def cc_metrics(functions: DataFrame, threshold: int = 10, by: list[str] | None = None) -> DataFrame:
    """by, cc_cost_sum, cc_avg, n of functions (cc): one row for each value of by."""
    return functions.groupBy(*(by or [])).agg(F.coalesce(F.sum(quadratic_cost(F.col("cc"), threshold)), F.lit(0.0)).alias("cc_cost_sum"), F.coalesce(F.avg("cc"), F.lit(0.0)).alias("cc_avg"), F.count("*").alias("n"))


def priced(estimates: DataFrame) -> DataFrame:
    return estimates.join(F.broadcast(costs(estimates.sparkSession)), "time", "left").withColumn("cost", F.coalesce("cost", F.lit(2.0)))  # 8 rows


def bigo_metrics(estimates: DataFrame, by: list[str] | None = None, *more: Column) -> DataFrame:
    """by, bigO_cost_sum, n, patterns (each once) of estimates, and more aggregates of them with their prices: one row for each value of by."""
    patterns = F.array_sort(F.array_distinct(F.flatten(F.collect_set("patterns"))))  # as many as SAID, and numbers of branches
    return priced(estimates).groupBy(*(by or [])).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("bigO_cost_sum"), F.count("*").alias("n"), patterns.alias("patterns"), *more)


def top_by(rows: DataFrame, cost: str, keys: list[str], k: int = 5) -> DataFrame:
    """The k rows of the greatest cost, ties in the order of keys."""
    return rows.orderBy(F.desc(cost), *keys).limit(k)
