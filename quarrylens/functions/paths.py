"""Predicates on paths: globs, test files, exclusions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that aren't scanned, and endings of generated files.
EXCLUDED = ("__pycache__", ".git", ".venv", "venv", "env", ".mypy_cache", ".pytest_cache", "node_modules", "dist", "build", "*.egg-info", "migrations")
GENERATED = ("_pb2.py", "_pb2_grpc.py", "_thrift.py")


#: Stands in a path before the name of its snapshot.
SNAP = "\x1f"


def in_snapshot(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files (keys, path, text) with the keys in the path, so that one run of the operators measures many snapshots."""
    return files.withColumn("path", F.concat_ws(SNAP, "path", *(F.col(k).cast("string") for k in keys))).drop(*keys)


def file_of(path: Column) -> Column:
    return F.substring_index(path, SNAP, 1)


def snap_of(path: Column) -> Column:
    """The name of the snapshot of a path, empty if there is none."""
    return F.substring(path, F.length(file_of(path)) + 2, F.length(path))


def snap_keys(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """df (snap, ...) with the keys, names with types, that in_snapshot put into it."""
    parts = F.split("snap", SNAP)
    return df.select(*(F.get(parts, F.lit(i)).cast(kind).alias(k) for i, (k, kind) in enumerate(keys.items())), *(c for c in df.columns if c != "snap"))


def safe(path: Column) -> Column:
    """Whether a relative path stays below its root, whatever dots it has; absolute ones don't."""
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    moves = F.transform(steps, lambda p: F.when(p == "..", -1).otherwise(1))
    depths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(moves), F.lit(1))), lambda i: F.aggregate(F.slice(moves, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    return ~path.startswith("/") & (F.array_min(depths) >= 0)


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob over a whole string; * goes over slashes."""
    out = fnmatch.translate(pattern)
    return re.sub(r"^\(\?s:(.*)\)(\\Z|\\z)$", r"(?s)^(?:\1)$", out)


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern).replace("$", r"\z"))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def excluded(path: Column, names: tuple[str, ...] = (), defaults: tuple[str, ...] = EXCLUDED) -> Column:
    """A part equals a name (no globs), one of the defaults too, or the ending says that the file is generated."""
    generated = F.lit(False)
    for ending in GENERATED:
        generated = generated | path.endswith(ending)
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, (*defaults, *names)))) | generated


def test_by_folder_or_name(path: Column) -> Column:
    """For lint: a folder that starts with test, or a file test_* or *_test.py."""
    folders = F.slice(parts(path), F.lit(1), F.size(parts(path)) - 1)
    return F.exists(folders, lambda p: p.startswith("test")) | base(path).startswith("test_") | base(path).endswith("_test.py")


def test_by_name_or_tests(path: Column) -> Column:
    """For symbols: a file test_* or *_test.py, or a part tests or test."""
    return base(path).startswith("test_") | base(path).endswith("_test.py") | F.arrays_overlap(parts(path), F.array(F.lit("tests"), F.lit("test")))


def test_by_any_part(path: Column) -> Column:
    """For complexity: any part, the file too, starts with test."""
    return F.exists(parts(path), lambda p: p.startswith("test"))


def test_by_name(path: Column) -> Column:
    """For the graph: a file test_* or *_test.py."""
    return base(path).startswith("test_") | base(path).endswith("_test.py")


def test_by_globs(path: Column) -> Column:
    """For style: globs over the whole path, so that test_*.py is a file at the root."""
    return glob_match(path, "test_*.py") | glob_match(path, "*_test.py") | glob_match(path, "tests/**")


def ignored(path: Column, patterns: list[str]) -> Column:
    """A part matches a line of an ignore file; comments, blank lines and negations don't count; .git always does."""
    kept = [p.strip().rstrip("/") for p in patterns if p.strip() and not p.strip().startswith(("#", "!"))]
    out = F.arrays_overlap(parts(path), F.array(F.lit(".git")))
    for p in kept:
        any_part = (lambda pattern: lambda part: glob_match(part, pattern))(p)
        out = out | F.exists(parts(path), any_part)
    return out
