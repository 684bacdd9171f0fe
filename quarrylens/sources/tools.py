"""Reports of tools: JSON text becomes rows, failures become errors and not exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import counts_in, strip


def lint_report(runs: DataFrame) -> DataFrame:
    """violations, tool_error of runs (stdout, return_code, timed_out): how many entries the report has, none for no text; 0
    with an error for a timeout, an exit that isn't 0 or 1, or text that isn't a JSON array."""
    n = F.when(strip(F.coalesce("stdout", F.lit(""))) == "", 0).otherwise(F.json_array_length(F.col("stdout")))
    error = F.when(F.col("timed_out"), "timeout").when(~F.col("return_code").isin(0, 1), "exit").when(n.isNull(), "json")
    return runs.withColumn("tool_error", error).withColumn("violations", F.when(error.isNull(), n).otherwise(0))


def complexity_report(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, file, name, cc, grade from the JSON map of lists in stdout; what is no list gives no rows, missing fields their defaults."""
    entries = F.from_json("stdout", "map<string,string>")
    keys = keys or []
    each = runs.where(F.col("return_code") <= 1).select(*keys, F.explode(entries).alias("file", "list"))
    rows = each.where(F.trim("list").startswith("[")).select(*keys, "file", F.explode(F.from_json("list", "array<struct<name:string,complexity:int,rank:string>>")).alias("x"))
    return rows.select(*keys, "file", F.coalesce("x.name", F.lit("?")).alias("name"), F.coalesce("x.complexity", F.lit(0)).alias("cc"), F.coalesce("x.rank", F.lit("A")).alias("grade"))


def complexity_errors(runs: DataFrame) -> DataFrame:
    """runs with tool_error: why a run has no report, empty if it has one."""
    late = F.when(F.col("timed_out"), "radon timed out").when(F.col("return_code") > 1, F.concat(F.lit("radon exit "), "return_code"))
    return runs.withColumn("tool_error", F.coalesce(late, F.when(F.from_json("stdout", "map<string,string>").isNull(), "radon JSON parse failed"), F.lit("")))


def run_counts(runs: DataFrame) -> DataFrame:
    """passed, failed, errors, pass_rate from the summary of report (JSON), or else from the text of stdout."""
    summary = F.from_json("report", "summary struct<passed:int,failed:int,errors:int,error:int>")["summary"]
    text = F.col("stdout")
    get = lambda json, word: F.when(summary.isNotNull(), F.coalesce(json, F.lit(0))).otherwise(counts_in(text, word))
    both = F.coalesce(summary["errors"], F.lit(0)) + F.coalesce(summary["error"], F.lit(0))
    out = runs.select("*", get(summary["passed"], "passed").alias("passed"), get(summary["failed"], "failed").alias("failed"), get(both, "error").alias("errors"))
    return out.withColumn("pass_rate", F.col("passed") / F.greatest(F.col("passed") + F.col("failed") + F.col("errors"), F.lit(1)))


def test_runs(runs: DataFrame) -> DataFrame:
    """runs (stdout, report, coverage: JSON texts; return_code, stderr, timed_out) with passed, failed, errors, total, pass_rate,
    line_coverage, branch_coverage and run_error; a run that didn't end well has only zeros and the error."""
    held = coverage_totals(run_counts(runs).withColumns({"_report": F.col("report"), "report": F.col("coverage")})).withColumn("report", F.col("_report")).drop("_report")
    error = F.when(F.col("timed_out"), "pytest timed out").when(F.col("return_code") != 0, F.when(strip(F.coalesce("stderr", F.lit(""))) == "", "pytest failed").otherwise(F.col("stderr"))).otherwise("")
    well = F.col("run_error") == ""
    held = held.withColumn("run_error", error).withColumn("pass_rate", F.round("pass_rate", 4)).withColumn("total", F.col("passed") + F.col("failed") + F.col("errors"))
    return held.withColumns({c: F.when(well, F.col(c)).otherwise(F.lit(0)) for c in ("passed", "failed", "errors", "total", "pass_rate", "line_coverage", "branch_coverage")})


_SUMMARY = "struct<covered_lines:bigint,num_statements:bigint,covered_branches:bigint,num_branches:bigint>"


def _ratio(part, whole):
    return F.coalesce(part, F.lit(0)) / F.greatest(F.coalesce(whole, F.lit(0)), F.lit(1))


def coverage_totals(runs: DataFrame) -> DataFrame:
    t = F.from_json("report", f"totals {_SUMMARY}")["totals"]
    return runs.select("*", F.round(_ratio(t["covered_lines"], t["num_statements"]), 4).alias("line_coverage"), F.round(_ratio(t["covered_branches"], t["num_branches"]), 4).alias("branch_coverage"))


def coverage_files(runs: DataFrame) -> DataFrame:
    """file, line, branch of each file of the report."""
    files = runs.select(F.explode(F.from_json("report", f"files map<string,struct<summary:{_SUMMARY}>>")["files"]).alias("file", "x"))
    s = F.col("x.summary")
    return files.select("file", _ratio(s["covered_lines"], s["num_statements"]).alias("line"), _ratio(s["covered_branches"], s["num_branches"]).alias("branch"))


def git_status(text: DataFrame) -> DataFrame:
    """path, staged, unstaged, untracked from the porcelain lines in text (line)."""
    x, y = F.substring("line", 1, 1), F.substring("line", 2, 1)
    new = F.col("line").startswith("??")
    return text.where(F.length("line") > 3).select(F.expr("substring(line, 4)").alias("path"), (~new & (x != " ")).alias("staged"), (~new & (y != " ")).alias("unstaged"), new.alias("untracked"))


#: What an action's parameters may hold; other names are left out.
PARAMETERS = "struct<path:string,recursive:boolean,max_depth:int,line_start:int,line_end:int,query:string,file_glob:string,context_lines:int,max_results:int,command:string,timeout_sec:int,note:string,paths:array<string>,patch:struct<path:string,new_content:string,unified_diff:string>,patches:array<struct<path:string,new_content:string,unified_diff:string>>,new_content:string,unified_diff:string>"


def parse_actions(texts: DataFrame) -> DataFrame:
    """texts (text) with action (action_type, args) out of what a model wrote: JSON, in a code fence or not.

    Without a type it is list_directory; without args these are the path "."; text that isn't a JSON object is
    list_directory of ".". The arguments of edit_file without a patch become one, and the patch of edit_files a list.
    """
    read = F.from_json(F.trim(F.regexp_replace("text", "```(?:json)?|```", "")), f"struct<action_type:string,args:{PARAMETERS}>", {"mode": "PERMISSIVE"})
    whole = F.try_parse_json(F.trim(F.regexp_replace("text", "```(?:json)?|```", "")))
    valid = whole.isNotNull() & (F.schema_of_variant(whole).startswith("OBJECT"))
    kind = F.when(valid, F.coalesce(F.col("_a.action_type"), F.lit("list_directory"))).otherwise("list_directory")
    here = F.from_json(F.lit('{"path":"."}'), PARAMETERS)
    args = F.when(valid, F.coalesce(F.col("_a.args"), here)).otherwise(here)
    a = F.col("_args")
    bare = (F.col("_kind") == "edit_file") & a["patch"].isNull() & a["path"].isNotNull() & (a["new_content"].isNotNull() | a["unified_diff"].isNotNull())
    single = (F.col("_kind") == "edit_files") & a["patches"].isNull() & a["patch"].isNotNull()
    patch = F.struct(a["path"].alias("path"), a["new_content"].alias("new_content"), a["unified_diff"].alias("unified_diff"))
    empty = F.from_json(F.lit("{}"), PARAMETERS)
    fixed = F.when(bare, empty.withField("patch", patch)).when(single, empty.withField("patches", F.array(a["patch"]))).otherwise(a)
    held = texts.withColumn("_a", read).withColumn("_kind", kind).withColumn("_args", args)
    return held.withColumn("action", F.struct(F.col("_kind").alias("action_type"), fixed.alias("args"))).drop("_a", "_kind", "_args")
