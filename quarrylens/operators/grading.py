"""Graders: metrics of snapshots, scores against the first snapshot of an episode, and their weighted sum."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions import scoring


@dataclass(frozen=True)
class Grader:
    """metrics: names of the columns it reads of the current (x) and the baseline snapshot (b_x); score and added: their
    expressions; said: texts for people, errors and tool_errors, from the same columns and score; penalty: added as text."""

    name: str
    metrics: tuple[str, ...]
    score: Callable[[], Column]
    added: Callable[[], Column]
    said: Callable[[], Column] = lambda: F.array().cast("array<string>")
    errors: Callable[[], Column] = lambda: F.array().cast("array<string>")
    tool_errors: Callable[[], Column] = lambda: F.array().cast("array<string>")
    penalty: Callable[[], Column] = lambda: F.col("added").cast("long").cast("string")


GRADERS: dict[str, Grader] = {}


def register(grader: Grader) -> Grader:
    if grader.name in GRADERS:
        raise ValueError(f"there is a grader {grader.name!r} already")
    GRADERS[grader.name] = grader
    return grader


#: What graders say; names in braces are filled in.
FORMATS = {
    "lint": "Lint: {before} → {now} violations ({arrow})  score={score}",
    "lint clean": "Lint: baseline was already clean (0 violations).",
    "lint worse": "[lint] regression: {added} new violation(s) introduced vs baseline.",
    "lint failed": "[lint] ruff failed: {error}",
    "lint failed before": "[lint] ruff failed at baseline: {error}",
    "symbol": "Dead code: {before} → {now} ({direction}). Weighted: {weight before} → {weight} ({score} eliminated).{remaining}",
    "symbol better": "-{n}",
    "symbol worse": "+{n} (regression)",
    "symbol same": "no change",
    "symbol kind": "{kind} ×{n}",
    "symbol remaining": " Remaining: {kinds}.",
    "style gold": "[Style] Gold standard — zero violations (Google Python Style Guide).",
    "style worse": "[Style] Regression vs baseline (raw {now} < baseline {before}). Top violations: {rules}.",
    "style": "[Style] delta={score} (raw {before}→{now}). Weakest dims: {dims}. Top rules: {rules}.",
    "style rule": "{rule}×{n} ({said}…)",
    "style dim": "{dim}={score}",
    "style no rules": "see violations list",
    "complexity": "[Complexity] CC cost: {cc before}→{cc} {cc arrow} (avg CC {avg before}→{avg}); Big-O cost: {big before}→{big} {big arrow}. Score: {score} (CC×0.55 + BigO×0.45).{worst}",
    "complexity worst": " Worst fn: '{function}' ({class}, cost={cost}). Patterns: {patterns}.",
    "complexity failed": "[radon: {error}]",
    "complexity worse": "[complexity] regression: CC cost {cc before}→{cc}, Big-O cost {big before}→{big}",
    "duplication": "[Duplication] {before} → {now} duplicate block(s), {cross} across files. Score: {score}.",
    "duplication worse": "[duplication] regression: {added} more duplicate block(s) than at baseline.",
    "coverage failed": "[Coverage] pytest did not complete: {error}",
    "coverage late": "pytest timed out after unknowns",
    "coverage kept": "[Coverage/constraint] {passed}/{total} tests pass ({rate}). Coverage: {before} → {now} ({change}pp).",
    "coverage lost": "[Coverage/constraint] {passed}/{total} tests pass ({rate}). Coverage: {before} → {now} ({change}pp) — dropped beyond 2% tolerance; score halved.",
    "coverage worse": "[Coverage/objective] Coverage regressed: {before} → {now} ({change}pp). Target: {target}. Tests: {passed}/{total}.",
    "coverage reached": "[Coverage/objective] Target reached! Coverage {now} ≥ {target}. Tests: {passed}/{total}.",
    "coverage raised": "[Coverage/objective] Coverage: {before} → {now} ({change}pp, {score} toward {target}). Tests: {passed}/{total} ({rate}).",
}


def fill(name: str, **parts: Column | str) -> Column:
    """A format with columns in its braces, whose names have underscores for spaces; a text is the name of a column."""
    pieces = re.split(r"\{([\w ]+)\}", FORMATS[name])
    return F.concat(*(F.lit(x) if i % 2 == 0 else F.col(p) if isinstance(p := parts[x.replace(" ", "_")], str) else p for i, x in enumerate(pieces)))


def texts(*found: Column) -> Column:
    """An array of the texts that aren't null."""
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def shown(x: Column | str, digits: int) -> Column:
    """A number with so many digits, half to even on its exact binary value, as python_round has it."""
    return scoring.python_format((F.col(x) if isinstance(x, str) else x).cast("double"), digits)


def percent(x: Column | str, digits: int = 0) -> Column:
    return F.concat(shown((F.col(x) if isinstance(x, str) else x) * 100, digits), F.lit("%"))


def _lint_said() -> Column:
    b, c = F.col("b_violations"), F.col("violations")
    arrow = F.when(c < b, F.concat(F.lit("↓"), b - c)).when(c > b, F.concat(F.lit("↑"), c - b)).otherwise("→0")
    return texts(F.when(b == 0, fill("lint clean")).otherwise(fill("lint", before=b, now=c, arrow=arrow, score=shown("score", 2))))


def _symbol_said() -> Column:
    b, c = F.col("b_raw_count"), F.col("raw_count")
    direction = F.when(b > c, fill("symbol better", n=b - c)).when(b < c, fill("symbol worse", n=c - b)).otherwise(fill("symbol same"))
    kinds = F.transform(F.slice("kinds", 1, 3), lambda k: fill("symbol kind", kind=F.replace(k, F.lit("_"), F.lit(" ")), n=F.element_at("by_kind", k)))
    remaining = F.when(F.size("kinds") > 0, fill("symbol remaining", kinds=F.array_join(kinds, ", "))).otherwise("")
    return texts(fill("symbol", before=b, now=c, direction=direction, weight_before=shown("b_weighted_total", 1), weight=shown("weighted_total", 1), score=percent("score"), remaining=remaining))


def _style_said() -> Column:
    rules = F.array_join(F.transform(F.slice("rules", 1, 3), lambda r: fill("style rule", rule=r["rule"], n=r["n"], said=F.substring(r["said"], 1, 30))), ", ")
    weak = F.slice(F.array_sort("dims", lambda x, y: F.when(x["score"] < y["score"], -1).when(x["score"] > y["score"], 1).otherwise(0)), 1, 2)
    two = [F.get(weak, F.lit(i)) for i in (0, 1)]
    dims = F.array_join(texts(*(F.when(d["score"] < 1, fill("style dim", dim=d["dimension"], score=percent(d["score"]))) for d in two)), ", ")
    b, c = shown("b_raw_score", 2), shown("raw_score", 2)
    worse = fill("style worse", now=c, before=b, rules=F.when(rules == "", fill("style no rules")).otherwise(rules))
    better = fill("style", score=percent("score"), before=b, now=c, dims=dims, rules=rules)
    return texts(F.when(F.col("score") >= 1, fill("style gold")).when(F.col("raw_score") < F.col("b_raw_score"), worse).otherwise(better))


def _complexity_parts() -> dict[str, Column]:
    arrow = lambda x: F.when(F.col(x) < F.col(f"b_{x}"), "↓").when(F.col(x) > F.col(f"b_{x}"), "↑").otherwise("→")
    held = {"cc": "cc_cost_sum", "avg": "cc_avg", "big": "bigO_cost_sum"}
    return {k: shown(x, 1) for k, x in held.items()} | {f"{k}_before": shown(f"b_{x}", 1) for k, x in held.items()} | {f"{k}_arrow": arrow(x) for k, x in held.items()}


def _complexity_said() -> Column:
    worst = F.col("worst")
    patterns = F.when(F.size(worst["patterns"]) > 0, F.array_join(worst["patterns"], ", ")).otherwise("none")
    tail = F.when(worst.isNotNull(), fill("complexity worst", function=worst["qualified_name"], **{"class": worst["class"]}, cost=shown(worst["cost"], 1), patterns=patterns)).otherwise("")
    return texts(fill("complexity", **_complexity_parts(), score=shown("score", 3), worst=tail), F.when(F.col("tool_error") != "", fill("complexity failed", error="tool_error")))


def _complexity_errors() -> Column:
    worse = (F.col("cc_cost_sum") > F.col("b_cc_cost_sum")) | (F.col("bigO_cost_sum") > F.col("b_bigO_cost_sum"))
    return texts(F.when(worse, fill("complexity worse", **_complexity_parts())))


def _duplication_said() -> Column:
    return texts(fill("duplication", before=F.col("b_duplicate_blocks"), now=F.col("duplicate_blocks"), cross=F.col("cross_file"), score=percent("score")))


def _coverage_failed() -> Column:
    return F.col("run_error") != ""


def _coverage_said(target: Column | None) -> Column:
    b, c = F.col("b_line_coverage"), F.col("line_coverage")
    points = F.round((c - b) * 100, 1)
    parts = {"before": percent(b, 1), "now": percent(c, 1), "change": F.concat(F.when(points >= 0, "+").otherwise(""), shown(points, 1)), "passed": "passed", "total": "total", "rate": percent("pass_rate")}
    if target is None:
        text = F.when(c >= b - 0.02, fill("coverage kept", **parts)).otherwise(fill("coverage lost", **parts))
    else:
        parts |= {"target": percent(target, 1), "score": percent("score")}
        text = F.when(c < b, fill("coverage worse", **parts)).when(F.col("score") >= 1, fill("coverage reached", **parts)).otherwise(fill("coverage raised", **parts))
    return texts(F.when(_coverage_failed(), fill("coverage failed", error="run_error")).otherwise(text))


def coverage_grader(mode: str = "constraint", target: float = 0.80) -> Grader:
    """The grader of test runs: coverage as something to keep, or as something to raise to a target."""
    if mode == "objective":
        score = lambda: scoring.coverage_objective("pass_rate", "line_coverage", "b_line_coverage", F.lit(target))
    else:
        score = lambda: scoring.coverage_constraint("pass_rate", "line_coverage", "b_line_coverage")
    errors = lambda: texts(F.when(F.col("timed_out"), fill("coverage late")))
    said = lambda: _coverage_said(F.lit(target) if mode == "objective" else None)
    return Grader(
        "coverage", ("pass_rate", "line_coverage"), lambda: scoring.python_round(F.when(_coverage_failed(), 0.0).otherwise(score()), 4), lambda: F.lit(0), said, errors,
        lambda: texts(F.when(_coverage_failed(), F.col("run_error"))))


register(Grader(
    "lint", ("violations", "tool_error"), lambda: scoring.lint_score("b_violations", "violations")[0], lambda: scoring.lint_score("b_violations", "violations")[1], _lint_said,
    lambda: texts(F.when(F.col("added") > 0, fill("lint worse", added=F.col("added").cast("long")))), lambda: texts(fill("lint failed", error="tool_error"), fill("lint failed before", error="b_tool_error")),
))
register(Grader("symbol", ("weighted_total", "raw_count"), lambda: scoring.symbol_score("b_weighted_total", "weighted_total")[0], lambda: scoring.symbol_score("b_weighted_total", "weighted_total")[1], _symbol_said, penalty=lambda: shown("added", 1)))
register(Grader(
    "style", ("raw_score", "violations", "error_violations"), lambda: scoring.python_round(scoring.style_score("b_raw_score", "raw_score", "violations"), 4),
    lambda: F.greatest(F.lit(0), F.col("error_violations") - F.col("b_error_violations")), _style_said,
))
register(Grader(
    "complexity", ("cc_cost_sum", "cc_avg", "bigO_cost_sum", "tool_error"), lambda: scoring.python_round(scoring.complexity_score("b_cc_cost_sum", "cc_cost_sum", "b_bigO_cost_sum", "bigO_cost_sum", F.when((F.col("tool_error") != "") | (F.col("b_tool_error") != ""), scoring.delta_score("b_cc_avg", "cc_avg"))), 4),
    lambda: F.lit(0), _complexity_said, _complexity_errors,
))
register(coverage_grader())
register(Grader(
    "duplication", ("duplicate_weight", "duplicate_blocks"), lambda: scoring.delta_score("b_duplicate_weight", "duplicate_weight"), lambda: F.greatest(F.lit(0), F.col("duplicate_blocks") - F.col("b_duplicate_blocks")), _duplication_said,
    lambda: texts(F.when(F.col("added") > 0, fill("duplication worse", added=F.col("added").cast("long")))),
))
register(Grader("mock", (), lambda: F.lit(0.5), lambda: F.lit(0)))


def graded(snapshots: DataFrame, grader: Grader, carry: tuple[str, ...] = ()) -> DataFrame:
    """episode_id, step, grader_id, score, added, said, errors, tool_errors, penalty of snapshots (episode_id, step, metrics), and
    the columns to carry; the first step is the baseline. Metrics that only texts read may be absent, and then those texts are empty."""
    first = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    have = [m for m in grader.metrics if m in snapshots.columns]
    both = snapshots.select("*", *(F.first(m).over(first).alias(f"b_{m}") for m in have))
    for m in grader.metrics:
        if m not in have:
            none = F.lit(None).cast("string" if m == "tool_error" else "double")
            both = both.withColumns({m: none, f"b_{m}": none})
    out = both.withColumn("score", grader.score().cast("double")).withColumn("added", grader.added().cast("double"))
    out = out.withColumn("errors", grader.errors()).withColumn("tool_errors", grader.tool_errors()).withColumn("penalty", F.when(F.col("added") > 0, grader.penalty()))
    needed = READ.get(grader.name, ())
    out = out.withColumn("said", grader.said() if set(needed) <= set(snapshots.columns) else F.array().cast("array<string>"))
    return out.select("episode_id", "step", F.lit(grader.name).alias("grader_id"), "score", "added", "said", "errors", "tool_errors", "penalty", *carry)


#: What the texts of a grader read besides its metrics.
READ = {"duplication": ("cross_file",), "symbol": ("kinds", "by_kind", "raw_count"), "style": ("rules", "dims"), "complexity": ("worst", "tool_error", "cc_avg"), "coverage": ("passed", "total", "run_error", "timed_out")}
MOST_SPECS = 10_000


def step_scores(grades: DataFrame, specs: DataFrame) -> DataFrame:
    """episode_id, step, step_score, is_regression, penalties, said, errors, tool_errors of grades under specs (grader_id,
    weight, and place where equal weights keep an order); lists are in the order of falling weights, then places, then names.
    The sum is rounded to four digits and not clamped. There are MOST_SPECS specs at most."""
    if specs.limit(MOST_SPECS + 1).count() > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    specs = specs if "place" in specs.columns else specs.withColumn("place", F.lit(0))
    rows = grades.join(F.broadcast(specs.select("grader_id", "weight", "place")), "grader_id")
    text = F.array().cast("array<string>")
    held = {c: F.col(c) if c in grades.columns else text for c in ("said", "errors", "tool_errors")}
    penalty = F.col("penalty") if "penalty" in grades.columns else F.when(F.col("added") > 0, F.col("added").cast("long").cast("string"))
    rows = rows.select("episode_id", "step", "weight", "score", "added", F.struct((-F.col("weight")).alias("w"), "place", "grader_id", penalty.alias("penalty"), *(v.alias(k) for k, v in held.items())).alias("r"))
    out = rows.groupBy("episode_id", "step").agg(F.sum(F.col("weight") * F.col("score")).alias("sum"), F.max(F.col("added") > 0).alias("is_regression"), F.array_sort(F.collect_list("r")).alias("r"))
    part = lambda c: lambda x: x[c]
    listed = [F.flatten(F.transform("r", part(c))).alias(c) for c in held]
    return out.select("episode_id", "step", scoring.python_round("sum", 4).alias("step_score"), "is_regression", F.filter(F.transform("r", lambda x: x["penalty"]), lambda x: x.isNotNull()).alias("penalties"), *listed)


def unknown_graders(specs: DataFrame) -> DataFrame:
    """Of specs (grader_id, ...) those that name no grader, with a warning: they are left out of every score."""
    return specs.where(~F.col("grader_id").isin(*GRADERS)).withColumn("warning", F.concat(F.lit("unknown grader '"), "grader_id", F.lit("' is left out")))


def overall(scores: DataFrame) -> DataFrame:
    """overall: the mean of the last step_score of each task (task, step, step_score), over tasks: one row."""
    last = scores.groupBy("task").agg(F.max_by("step_score", "step").alias("s"))
    return last.agg(F.avg("s").alias("overall"))


def weights_off(specs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """task_id, total of tasks whose weights don't sum to 1."""
    return specs.groupBy("task_id").agg(F.sum("weight").alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def active(specs: DataFrame) -> DataFrame:
    return specs.where("weight > 0")


def normalized(specs: DataFrame) -> DataFrame:
    """Weights by their sum; one row of sums goes to all rows."""
    return specs.crossJoin(F.broadcast(specs.agg(F.sum("weight").alias("total")))).withColumn("weight", F.col("weight") / F.col("total")).drop("total")


def invariants_broken(invariants: DataFrame, files: DataFrame, definitions: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """Invariants (seq, type, path, symbol, message) that don't hold: no_edit, file_exists, no_delete, symbol_present.

    no_edit fails where a line of a diff (line) that starts with --- or +++ holds the path. With a column episode_id in all tables,
    rules, files and diffs of an episode meet each other alone, by a join on it. Lines are cut into all their stretches of the lengths that
    paths of rules have, which meet the paths by equality, so that no rule is held against each line.
    """
    keys = [c for c in ("episode_id",) if all(c in t.columns for t in (invariants, files, definitions, diff_lines))]
    have, names = files.select(*keys, "path").distinct(), definitions.select(*keys, "path", F.col("name").alias("symbol")).distinct()
    headers = diff_lines.where(F.col("line").startswith("---") | F.col("line").startswith("+++")).select(*keys, "line").distinct()
    rules = invariants.where("type = 'no_edit'")
    lengths = rules.where("path IS NOT NULL").groupBy(*keys).agg(F.collect_set(F.length("path")).alias("lengths"))
    headers = headers.join(lengths, keys) if keys else headers.crossJoin(F.broadcast(lengths))
    headers = headers.select(*keys, "line", F.explode("lengths").alias("n")).where("n <= length(line)")
    held = headers.select(*keys, "line", "n", F.explode(F.expr("sequence(1, length(line) - n + 1)")).alias("at")).select(*keys, F.expr("substring(line, at, n)").alias("path"))
    edited = rules.join(held.distinct(), [*keys, "path"], "left_semi")
    missing = invariants.where("type IN ('file_exists', 'no_delete')").join(have, [*keys, "path"], "left_anti")
    lost = invariants.where("type = 'symbol_present'").join(names, [*keys, "path", "symbol"], "left_anti")
    columns = invariants.columns
    return edited.select(*columns).unionByName(missing.select(*columns)).unionByName(lost.select(*columns))
