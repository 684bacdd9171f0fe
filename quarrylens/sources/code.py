"""Repositories as tables: files, trees, scenarios."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions import paths
from quarrylens.operators import patches


def read_sources(spark: SparkSession, root: str, glob: str = "*.py", exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), text, size_bytes, mtime of the source files under root, without the folders that are always left out
    and those of exclude; bad bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    below = F.regexp_replace("path", f"^.*?\\Q{base}\\E/", "")
    return files.select(below.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")).where(~paths.excluded(F.col("path"), exclude))


def tree(files: DataFrame) -> DataFrame:
    """path, is_dir, size_bytes of files and of all folders above them; folders first, then by path."""
    parts = F.split("path", "/")
    ups = files.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i < F.size(parts), F.array_join(F.slice(parts, F.lit(1), i), "/"))), lambda x: x.isNotNull())).alias("path")).distinct()
    every = files.select("path", F.lit(False).alias("is_dir"), "size_bytes").unionByName(ups.select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size_bytes")))
    return every.orderBy(F.desc("is_dir"), "path")


def listing(entries: DataFrame, folder: str = "", recursive: bool = False, max_depth: int = 1) -> DataFrame:
    """What stands in a folder; recursively max_depth levels below its own entries, so max_depth + 1 levels in all."""
    inside = entries.where(F.col("path").startswith(f"{folder}/")) if folder else entries
    depth = F.size(F.split("path", "/")) - (folder.count("/") + 1 if folder else 0)
    return inside.where((depth <= (max_depth + 1 if recursive else 1)) & ~F.arrays_overlap(F.split("path", "/"), F.array(F.lit(".git")))).orderBy(F.desc("is_dir"), "path")


def python_files(files: DataFrame, exclude: list[str]) -> DataFrame:
    keep: Column = F.col("path").endswith(".py")
    for pattern in exclude:
        keep = keep & ~paths.glob_match(F.col("path"), pattern)
    return files.where(keep).orderBy("path")


def lint_files(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("is_dir") & F.col("path").endswith(".py") & ~paths.test_by_folder_or_name(F.col("path")))


def symbol_files(files: DataFrame, tests: bool = False) -> DataFrame:
    """Python files in the order of their paths, test files only with tests."""
    keep = F.col("path").endswith(".py")
    return files.where(keep if tests else keep & ~paths.test_by_name_or_tests(F.col("path"))).orderBy("path")


def snapshot_diff(before: DataFrame, after: DataFrame, only: list[str] | None = None) -> DataFrame:
    """path, change (added, removed, edited), added, removed (lines), diff (hunks) between two snapshots (path, text); only some paths if given."""
    both = before.select("path", F.col("text").alias("old")).join(after.select("path", F.col("text").alias("new")), "path", "full")
    both = both.where(F.col("path").isin(*only)) if only else both
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "edited")
    found = both.withColumn("change", change).where("change is not null").withColumn("lines", patches.line_changes("old", "new"))
    return found.select("path", "change", "lines.added", "lines.removed", "lines.diff")


def task_folders(spark: SparkSession, root: str) -> list[str]:
    """The names of the folders below root, sorted; FileNotFoundError without root."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory())


def scenario(spark: SparkSession, path: str) -> dict:
    """A scenario's settings with defaults; ValueError where a part has the wrong shape. Read by Spark, a small file."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    raw = yaml.safe_load(text) or {}
    if not isinstance(raw, dict):
        raise ValueError("a scenario must be a mapping")
    for key, kind in (("graders", dict), ("invariants", list), ("test_paths", list)):
        if not isinstance(raw.get(key, kind()), kind):
            raise ValueError(f"{key} must be a {kind.__name__}")
    graders = {k: {"weight": float(v)} if isinstance(v, (int, float)) else dict(v or {}) for k, v in raw.get("graders", {}).items()}
    return {"slug": raw.get("slug", Path(path).parent.name), "name": raw.get("name", ""), "description": raw.get("description", ""), "language": raw.get("language", "python"), "max_steps": int(raw.get("max_steps", 20)), "graders": graders, "invariants": raw.get("invariants", []), "test_paths": raw.get("test_paths", [])}


def grader_specs(spark: SparkSession, scenarios: list[dict]) -> DataFrame:
    rows = [(s["slug"], g, float(v.get("weight", 0.0)), float(v["target_coverage"]) if v.get("target_coverage") is not None else None) for s in scenarios for g, v in s["graders"].items()]
    return spark.createDataFrame(rows, "task_id string, grader_id string, weight double, target_coverage double")
