"""Operators on records: statistics, batches, reports, pairs and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.session import cut


#: Rows that an operator on all pairs or all triples of a table takes at most.
MOST_PAIRS, MOST_TRIPLES = 10_000, 1_000


def small(df: DataFrame, most: int) -> DataFrame:
    """df, if it has no more rows than that; an error else, as the work grows with their square or cube."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def compute_stats(df: DataFrame, column: str) -> DataFrame:
    """mean, minimum, maximum: one row, zeros for no values."""
    zero = F.lit(0.0)
    return df.agg(F.coalesce(F.avg(column), zero).alias("mean"), F.coalesce(F.min(column), zero).alias("minimum"), F.coalesce(F.max(column), zero).alias("maximum"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def filter_above(df: DataFrame, key: str, threshold: float) -> DataFrame:
    return df.where(F.coalesce(F.col(key), F.lit(0)) > threshold)


def active_above_mean(df: DataFrame, value: str, active: Column) -> DataFrame:
    """total, n, mean, above: one row; above counts active rows over the mean. Two passes, no window over all rows."""
    stats = df.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.count("*").alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))
    above = df.crossJoin(F.broadcast(stats.select("mean"))).agg(F.count_if(active & (F.col(value) > F.col("mean"))).alias("above"))  # one row to all
    return stats.crossJoin(above)


def batches(df: DataFrame, size: int, partition: list[str], order: list[str], item: str) -> DataFrame:
    """partition, batch, items: runs of size rows in order, the last one shorter."""
    nth = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    placed = df.withColumn("nth", nth).withColumn("batch", F.floor(F.col("nth") / size).cast("int"))
    return placed.groupBy(*partition, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(item).alias("item")))), lambda x: x["item"]).alias("items"))


def report(df: DataFrame, columns: list[str], order: list[str], group: list[str]) -> DataFrame:
    """Lines of columns joined by bars, in order, as one text for each group."""
    line = F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns))
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("report"))


def last_n(df: DataFrame, n: int, partition: list[str], order: list[str], item: str, name: str = "history") -> DataFrame:
    return df.withColumn(name, F.collect_list(item).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(n - 1), 0)))


def repeated_before(df: DataFrame, n: int, partition: list[str], order: list[str], item: str, value: str) -> DataFrame:
    """looping: whether the n rows before are all value."""
    before = F.collect_list(item).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-n, -1))
    return df.withColumn("looping", (F.size(before) == n) & F.forall(before, lambda x: x == value))


def pair_mean(df: DataFrame, value: str) -> DataFrame:
    """mean_distance of |v_i - v_j| over all pairs of different rows: one row. From ranks, so that no pair is made; rows are
    sorted in ranges, and each range counts on from those before it."""
    held = cut(df.select(F.col(value).alias("v")).repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = held.groupBy("part").agg(F.count("*").alias("size"))  # a row a range
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = held.count()
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("v"))).join(F.broadcast(before), "part")
    total = ranked.agg(F.sum(F.col("v") * (2 * (F.col("r") + F.col("before")) - n - 1)).alias("s"))
    return total.select((2 * F.col("s") / F.greatest(F.lit(n * (n - 1)), F.lit(1))).alias("mean_distance"))


def pairs(df: DataFrame, key: str, value: str, distinct: bool = False) -> DataFrame:
    """Every pair of a small table, the diagonal too unless distinct."""
    df = small(df, MOST_PAIRS)
    a, b = (df.select(F.col(key).alias(f"{s}_key"), F.col(value).alias(f"{s}_value")) for s in "ab")
    return a.join(b, F.col("a_key") != F.col("b_key")) if distinct else a.crossJoin(b)


def triples(df: DataFrame, key: str, value: str) -> DataFrame:
    """Every i < j < k of a small table."""
    df = small(df, MOST_TRIPLES)
    a, b, c = (df.select(F.col(key).alias(f"{s}_key"), F.col(value).alias(f"{s}_value")) for s in "abc")
    return a.join(b, F.col("a_key") < F.col("b_key")).join(c, F.col("b_key") < F.col("c_key"))


def upper_median_distance(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, median: of each row the upper median of its distances to the others."""
    d = pairs(df, key, value, distinct=True).groupBy(F.col("a_key").alias(key)).agg(F.sort_array(F.collect_list(F.abs(F.col("a_value") - F.col("b_value")))).alias("d"))
    return d.select(key, F.element_at("d", F.floor(F.size("d") / 2).cast("int") + 1).alias("median"))


def doubled(df: DataFrame, drop_prefix: str = "_") -> DataFrame:
    """Numbers doubled, text in upper case, columns with a prefix left out."""
    kinds = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    return df.select(*(((F.col(c) * 2) if t in kinds else F.upper(c) if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes if not c.startswith(drop_prefix)))


def validated(df: DataFrame, value: str, low: float, high: float, share: float = 0.3) -> DataFrame:
    """Values cast and scaled to 0..1; if over share of the rows have no number, none is kept."""
    number = F.expr(f"try_cast(`{value}` AS DOUBLE)")
    bad = df.agg(F.avg(F.when(number.isNull(), 1.0).otherwise(0.0)).alias("bad"))
    kept = df.withColumn("number", number).where("number is not null").crossJoin(F.broadcast(bad)).where(F.col("bad") <= share)  # one row to all
    return kept.withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("number") - low) / (high - low)))).drop("bad")


def recursive_analysis(df: DataFrame, depth: int) -> DataFrame:
    """node, level, analysis, data_count: what halving a table again and again says at each node of a full binary tree of that
    depth, by a recursive query; no_data at the root of an empty table."""
    spark, n = df.sparkSession, df.count()
    if not n and depth > 0:
        return spark.createDataFrame([(1, 0, "no_data", None)], "node int, level int, analysis string, data_count long")
    tree = spark.sql(f"WITH RECURSIVE t(node, level) AS (SELECT 1, 0 UNION ALL SELECT node * 2 + b, level + 1 FROM t CROSS JOIN (VALUES (0), (1)) v(b) WHERE level < {int(depth)}) SELECT node, level FROM t")
    inner = F.col("level") < depth
    return tree.select("node", "level", F.when(inner, F.concat(F.lit("analyzed_"), "level")).otherwise("max_depth_reached").alias("analysis"), F.when(inner, F.lit(n).cast("long")).alias("data_count"))


def item_report(df: DataFrame, threshold: float = 50, details: int = 3) -> DataFrame:
    """place, said: a text for each row (place, processed_value) that has a value, with details where it is over the threshold."""
    value = F.col("processed_value").cast("string")
    more = F.concat(F.lit("  -> High value detected: "), value, F.lit("\n"), *(F.lit(f"    - Detail {i + 1}\n") for i in range(details)))
    said = F.concat(F.lit("Item "), "place", F.lit(": "), value, F.lit("\n"), F.when(F.col("processed_value") > threshold, more).otherwise(""))
    return df.where("processed_value is not null").select("place", said.alias("said"))


def active(df: DataFrame) -> DataFrame:
    """Rows that active says are; none where it is null."""
    return df.where("coalesce(active, false)")


def round_robin(picks: DataFrame, tasks: DataFrame) -> DataFrame:
    """picks (count) with task: the tasks in the order of their names, one after the other, as often as need be."""
    names = small(tasks, MOST_PAIRS).agg(F.array_sort(F.collect_list("task")).alias("names"))  # one row to all
    return picks.crossJoin(F.broadcast(names)).withColumn("task", F.element_at("names", (F.pmod("count", F.size("names")) + 1).cast("int"))).drop("names")


def remaining(df: DataFrame) -> DataFrame:
    """df (max_steps, step) with the steps that remain, which may be below 0."""
    return df.withColumn("remaining", F.col("max_steps") - F.col("step"))


def folded_products(df: DataFrame, key: str, series: str) -> DataFrame:
    """a_key, b_key, product: of each pair of arrays the sum of products in order, over their common length."""
    both = pairs(df, key, series)
    n = F.least(F.size("a_value"), F.size("b_value"))
    zipped = F.zip_with(F.slice("a_value", F.lit(1), n), F.slice("b_value", F.lit(1), n), lambda x, y: x * y)
    return both.select("a_key", "b_key", F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x).alias("product"))


#: Factors by category, and by the range of the value with exceptions by category.
FACTORS = {"A": 2.0, "B": 2.0, "C": 2.0, "D": 1.5}
RANGES = [(10.0, 2.0, {}), (50.0, 1.5, {"A": 1.8}), (100.0, 1.2, {"B": 1.3, "C": 1.4}), (None, 1.1, {"D": 1.05, "E": 1.0, "F": 1.0})]
PRIORITIES = {"high": 1.1, "low": 0.95}
CATEGORIES = ("A", "B", "C", "D", "E")


def _lookup(key: Column, table: dict[str, float], default: Column) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def preprocessed(df: DataFrame) -> DataFrame:
    """Rows (value, is_text, category, keep_zeros, has_alt, alt_value) with processed_value: numbers over 0 times the
    factor of their category (1 for others, 1.1 for none), text that is a number times 1.5; without a value 0.8 of
    alt_value if there is one. Values of 0 or less stay, without a processed value, if keep_zeros says so; all other
    rows go."""
    number = F.expr("try_cast(value AS DOUBLE)")
    factor = F.when(F.col("category").isNull(), 1.1).otherwise(_lookup(F.col("category"), FACTORS, F.lit(1.0)))
    value = F.when(F.col("value").isNull(), F.when(F.col("has_alt"), F.coalesce("alt_value", F.lit(0.0)) * 0.8)).when(F.col("is_text"), number * 1.5).when(number > 0, number * factor)
    zero = F.col("value").isNotNull() & ~F.col("is_text") & (number <= 0) & F.coalesce("keep_zeros", F.lit(False))
    return df.withColumn("processed_value", value).where(F.col("processed_value").isNotNull() | zero)


def transformed(df: DataFrame) -> DataFrame:
    """Rows (processed_value, category, priority) with multiplier_used and transformed_value; rows without a processed
    value go. Results over 100 are scaled by priority: 0.98 for none, 1 for others."""
    v, category = F.col("processed_value"), F.coalesce("category", F.lit(""))
    used = F.lit(None).cast("double")
    for limit, factor, special in reversed(RANGES):
        own = _lookup(category, special, F.lit(factor))
        used = own if limit is None else F.when(v < limit, own).otherwise(used)
    by_priority = F.when(F.col("priority").isNull(), 0.98).otherwise(_lookup(F.col("priority"), PRIORITIES, F.lit(1.0)))
    raw = v * F.col("multiplier_used")
    return df.where(v.isNotNull()).withColumn("multiplier_used", used).withColumn("transformed_value", F.when(raw > 100, raw * by_priority).otherwise(raw))


def normalized(df: DataFrame, share: float = 0.3) -> DataFrame:
    """id, value, category, priority of rows (id, value, category); none if more than share of the rows have an error: no
    id, or a value that is no number, which becomes 0."""
    number = F.expr("try_cast(value AS DOUBLE)")
    bad = F.col("id").isNull() | F.col("value").isNotNull() & number.isNull()
    errors = df.agg(F.coalesce(F.avg(bad.cast("double")), F.lit(1.0)).alias("errors"))
    category = F.when(F.col("category").isNull(), "DEFAULT").when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("UNKNOWN")
    rows = df.where("id is not null").select("id", F.coalesce(number, F.lit(0.0)).alias("value"), category.alias("category"))
    priority = F.when(F.col("value") <= 0, "none").when(F.col("category") == "A", "high").when(F.col("category").isin("B", "C"), "medium").otherwise("low")
    return rows.withColumn("priority", priority).crossJoin(F.broadcast(errors)).where(F.col("errors") <= share).drop("errors")  # one row to all


def record_complexity(df: DataFrame, key: str, value: str) -> DataFrame:
    """avg_correlation, pattern_score, complexity_score of a small table: one row, from its pairs and triples."""
    a, b = F.col("a_value"), F.col("b_value")
    apart = F.abs(a - b)
    tie = F.when((a > 0) & (b > 0), F.when(apart < 10, 0.9).when(apart < 50, 0.6).otherwise(0.3)).when((a == 0) | (b == 0), 0.1).otherwise(-0.5)
    mean = pairs(df, key, value, distinct=True).agg(F.coalesce(F.avg(tie), F.lit(0.0)).alias("avg_correlation"))
    c = F.col("c_value")
    near, run = (F.abs(a - b) < 5) & (F.abs(b - c) < 5), (a > b) & (b > c) | (a < b) & (b < c)
    score = F.when((a > 0) & (b > 0) & (c > 0), F.when(near, 1.0).when(run, 0.5))
    return mean.crossJoin(triples(df, key, value).agg(F.coalesce(F.sum(score), F.lit(0.0)).alias("pattern_score"))).withColumn("complexity_score", 0.7 * F.col("avg_correlation") + 0.3 * F.col("pattern_score"))


def all_have(df: DataFrame, field: str, records: str) -> DataFrame:
    """valid: whether every map has a field; one row."""
    return df.agg(F.coalesce(F.bool_and(F.map_contains_key(records, field)), F.lit(True)).alias("valid"))


def self_check(whole: DataFrame, broken: DataFrame, field: str, records: str) -> DataFrame:
    """whole, broken: whether the records of each pass the check for a field, of which the first should and the second shouldn't."""
    a, b = (all_have(df, field, records).withColumnRenamed("valid", n) for df, n in ((whole, "whole"), (broken, "broken")))
    return a.crossJoin(b)  # a row each


#: The least and the greatest value of an action's parameters.
LIMITS = {"line_start": (1, None), "line_end": (1, None), "max_depth": (1, 8), "context_lines": (0, 10), "max_results": (1, 200), "patches": (1, 20), "timeout_sec": (1, 120), "note_length": (None, 500), "query_length": (1, None)}


def valid_parameters(df: DataFrame) -> DataFrame:
    """valid, and broken: the names of the parameters among the columns that are out of their limits; null is no value."""
    broken = [F.when(F.col(c) < lo if hi is None else F.col(c) > hi if lo is None else ~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in LIMITS.items() if c in df.columns]
    return df.withColumn("broken", F.filter(F.array(*broken), lambda x: x.isNotNull())).withColumn("valid", F.size("broken") == 0)
