"""Measures of whole snapshots of repositories, one row each, and the grades that they earn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.paths import file_of, in_snapshot, snap_keys, snap_of, test_by_any_part
from quarrylens.operators import astfacts, complexity, grading, lines, style, symbols
from quarrylens.sources import tools

KEYS = {"episode_id": "string", "step": "int"}


def snapshot_nodes(files: DataFrame) -> DataFrame:
    """The node table of files (episode_id, step, path, text). It is read several times: persist or write it."""
    return astfacts.ast_nodes(in_snapshot(files, list(KEYS)))


def _kept(metrics: DataFrame, nodes: DataFrame, zeros: dict) -> DataFrame:
    """A row for every snapshot of nodes, with zeros where metrics have none."""
    every = nodes.where("coalesce(node, 0) = 0").select(snap_of(F.col("path")).alias("snap")).distinct()
    out = every.join(metrics, "snap", "left")
    return snap_keys(out.withColumns({c: F.coalesce(c, v) for c, v in zeros.items()}), KEYS)


def symbol_measures(nodes: DataFrame) -> DataFrame:
    """episode_id, step, weighted_total, raw_count, by_kind, kinds: dead code of each snapshot, test files left out."""
    dead = symbols.dead_code(nodes).withColumn("snap", snap_of(F.col("path")))
    none = {"weighted_total": F.lit(0.0), "raw_count": F.lit(0).cast("long"), "by_kind": F.create_map().cast("map<string,bigint>"), "kinds": F.array().cast("array<string>")}
    return _kept(symbols.aggregate_dead(dead, ["snap"]), nodes, none)


def style_measures(nodes: DataFrame, files: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """episode_id, step, raw_score, violations, error_violations, dims, rules of each snapshot. Without files nothing is wrong."""
    lined = lines.source_lines(in_snapshot(files, list(KEYS)).select("path", "text"))
    clean = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(1.0).alias("score")) for d in style.DIMENSIONS))
    none = {"raw_score": F.lit(1.0), "violations": F.lit(0).cast("long"), "error_violations": F.lit(0).cast("long"), "dims": clean, "rules": F.array().cast(style.RULE_COUNTS)}
    return _kept(style.style_metrics(nodes, lined, ["snap"], ignore), nodes, none)


def duplication_measures(nodes: DataFrame) -> DataFrame:
    """episode_id, step, duplicate_blocks, duplicate_weight, cross_file of each snapshot: stretches that have come before."""
    runs = symbols.clone_runs(nodes).groupBy(snap_of(F.col("path")).alias("snap"))
    found = runs.agg(F.count("*").alias("duplicate_blocks"), F.round(F.sum("weight"), 3).alias("duplicate_weight"), F.count_if("cross_file").alias("cross_file"))
    return _kept(found, nodes, {"duplicate_blocks": F.lit(0).cast("long"), "duplicate_weight": F.lit(0.0), "cross_file": F.lit(0).cast("long")})


def complexity_measures(nodes: DataFrame, runs: DataFrame, threshold: int = 10) -> DataFrame:
    """episode_id, step, cc_cost_sum, cc_avg, cc_fns, bigO_cost_sum, bigO_fns, patterns, worst, tool_error of each snapshot: runs
    (episode_id, step, stdout, return_code, timed_out) are those of the tool that counts branches."""
    keys = list(KEYS)
    reports = tools.complexity_report(runs.where(~F.col("timed_out")), keys).where(~test_by_any_part(F.col("file")))
    cc = complexity.cc_metrics(reports, threshold, keys).withColumnRenamed("n", "cc_fns").withColumn("cc_avg", F.round("cc_avg", 3))
    estimates = complexity.repository_estimates(nodes.where((F.col("status") == "ok") & ~test_by_any_part(file_of(F.col("path")))), skip_tests=True)
    worst = F.min(F.struct((-F.col("cost")).alias("c"), "path", "func", "qualified_name", "class", "patterns")).alias("w")
    big = complexity.bigo_metrics(estimates, ["snap"], worst).withColumnRenamed("n", "bigO_fns")
    big = big.withColumn("worst", F.struct(F.col("w.qualified_name"), F.col("w.class"), (-F.col("w.c")).alias("cost"), F.col("w.patterns"))).drop("w")
    sized = _kept(big, nodes, {"bigO_cost_sum": F.lit(0.0), "bigO_fns": F.lit(0).cast("long"), "patterns": F.array().cast("array<string>")})
    out = sized.join(cc, keys, "left").join(tools.complexity_errors(runs).select(*keys, "tool_error"), keys, "left")
    return out.withColumns({"cc_cost_sum": F.coalesce("cc_cost_sum", F.lit(0.0)), "cc_avg": F.coalesce("cc_avg", F.lit(0.0)), "cc_fns": F.coalesce("cc_fns", F.lit(0)), "tool_error": F.coalesce("tool_error", F.lit(""))})


def lint_measures(runs: DataFrame) -> DataFrame:
    """episode_id, step, violations, tool_error (as people read it) of runs (episode_id, step, stdout, stderr, return_code, timed_out)."""
    said = F.when(F.col("tool_error") == "timeout", "ruff timed out").when(F.col("tool_error") == "exit", F.trim("stderr")).when(F.col("tool_error") == "json", "the report is no JSON array")
    return tools.lint_report(runs).select(*KEYS, "violations", said.alias("tool_error"))


def coverage_measures(runs: DataFrame) -> DataFrame:
    """episode_id, step and the counts, rates and errors of test runs; see tools.test_runs."""
    return tools.test_runs(runs).select(*KEYS, "passed", "failed", "errors", "total", "pass_rate", "line_coverage", "branch_coverage", "timed_out", "run_error")


def grade_all(files: DataFrame, nodes: DataFrame, lint: DataFrame, cc: DataFrame, tests: DataFrame, specs: DataFrame, coverage: grading.Grader | None = None) -> DataFrame:
    """One whole pass: every snapshot of files (episode_id, step, path, text), with its node table and the runs of the three
    tools, measured and graded against the first of its episode; see grading.step_scores."""
    held = {"lint": lint_measures(lint), "symbol": symbol_measures(nodes), "style": style_measures(nodes, files), "complexity": complexity_measures(nodes, cc), "coverage": coverage_measures(tests)}
    grades = [grading.graded(m, coverage if name == "coverage" and coverage else grading.GRADERS[name]) for name, m in held.items()]
    return grading.step_scores(reduce(DataFrame.unionByName, grades), specs)
