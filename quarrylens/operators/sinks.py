"""What leaves the engine: snapshots, JSON, reports to people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.lines import source_lines, split_lines
from quarrylens.operators.style import DIMENSIONS, rules


def write_snapshot(files: DataFrame, path: str) -> None:
    """Adds files (episode_id, step, path, text) as partitions; a step that is written again replaces its own partition."""
    files.write.partitionBy("episode_id", "step").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def top_rules(violations: DataFrame, k: int = 3) -> DataFrame:
    """rule, n of the rules that are broken most; ties go to the rule that came first (path, line)."""
    n = violations.groupBy("rule").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("first"))
    return n.orderBy(F.desc("n"), "first", "rule").limit(k).select("rule", "n")


def weakest_dimensions(scores: DataFrame, k: int = 2) -> DataFrame:
    """dimension, score of the k lowest scores, those of 1 left out after the cut; ties keep the order of the dimensions."""
    places = {d: i for i, d in enumerate(DIMENSIONS)}
    order = F.create_map(*(F.lit(x) for d, i in places.items() for x in (d, i)))[F.col("dimension")]
    return scores.orderBy("score", order).limit(k).where(F.col("score") < 1).select("dimension", "score")


def changes_by_rule(before: DataFrame, after: DataFrame) -> DataFrame:
    """rule, before, after, said: counts of two snapshots and an arrow between them, where they differ."""
    a, b = (d.groupBy("rule").agg(F.count("*").alias(n)) for d, n in ((before, "before"), (after, "after")))
    both = a.join(b, "rule", "full").na.fill(0, ["before", "after"]).where("before <> after")
    return both.withColumn("said", F.concat("rule", F.lit(": "), "before", F.lit(" → "), "after"))


def with_rule_text(violations: DataFrame) -> DataFrame:
    """violations (rule) with dimension, severity, description."""
    return violations.join(F.broadcast(rules(violations.sparkSession)), "rule")  # 32 rows


def initial_view(files: DataFrame, limit: int = 100) -> DataFrame:
    """path, lineno, text: the first lines of the first file at the root of each episode (episode_id, path, text)."""
    first = files.where(~F.contains("path", F.lit("/"))).groupBy("episode_id").agg(F.min_by(F.struct("path", "text"), "path").alias("f")).select(F.concat("episode_id", F.lit(":"), "f.path").alias("path"), "f.text")
    return source_lines(first).where(F.col("lineno") <= limit)


def first_view(files: DataFrame, status: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """What an agent sees first of each episode of files (episode_id, path, text), a row each: tree (path, is_dir; folders first, then by
    path), active_file, the first file at the root by name, with its first lines as file_content, line_start, line_end and
    total_file_lines, and staged, unstaged and untracked paths of status (episode_id, path, staged, unstaged, untracked).

    Without a file at the root the view is empty. The tree of an episode is one row; its texts are not.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = files.where(F.contains("path", F.lit("/"))).select("episode_id", F.explode(ups).alias("path")).distinct()
    entries = files.select("episode_id", "path", F.lit(False).alias("is_dir")).unionByName(folders.withColumn("is_dir", F.lit(True)))
    order = F.array_sort(F.collect_list(F.struct((~F.col("is_dir")).alias("o"), "path", "is_dir")))
    tree = entries.groupBy("episode_id").agg(F.transform(order, lambda e: F.struct(e["path"].alias("path"), e["is_dir"].alias("is_dir"))).alias("tree"))
    first = files.where(~F.contains("path", F.lit("/"))).groupBy("episode_id").agg(F.min_by(F.struct("path", "text"), "path").alias("f"))
    shown = first.select("episode_id", F.col("f.path").alias("active_file"), split_lines(F.coalesce("f.text", F.lit(""))).alias("l"))
    shown = shown.select("episode_id", "active_file", F.array_join(F.slice("l", 1, limit), "\n").alias("file_content"), F.lit(1).alias("line_start"), F.least(F.size("l"), F.lit(limit)).alias("line_end"), F.size("l").alias("total_file_lines"))
    out = tree.join(shown, "episode_id", "left")
    if status is not None:
        kinds = ("staged", "unstaged", "untracked")
        out = out.join(status.groupBy("episode_id").agg(*(F.array_sort(F.collect_list(F.when(F.col(k), F.col("path")))).alias(k) for k in kinds)), "episode_id", "left")
        out = out.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in kinds})
    return out


def carried(events: DataFrame, columns: list[str]) -> DataFrame:
    """Events (episode_id, step, columns) where a null keeps the value of the step before."""
    w = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("episode_id", "step", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns))
