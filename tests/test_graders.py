"""Whole graders, what they say, and the operators that the test tables don't reach."""

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import paths, text
from quarrylens.operators import astfacts, complexity, grading, graph, lines, measures, patches, records, sinks, style, symbols
from quarrylens.sources import code, tools
from quarrylens.streaming import episode

BEFORE = '"""M."""\nimport os\nimport sys\n\n\ndef Run(a, b=[]):\n    left = a\n    return b\n    print(b)\n'
AFTER = '"""M."""\nimport sys\n\n\ndef run(a: int, b: int) -> int:\n    """Run."""\n    return sys.maxsize + a + b\n'


@pytest.fixture(scope="module")
def repo(spark):
    rows = [("e", 0, "pkg/m.py", BEFORE), ("e", 1, "pkg/m.py", AFTER), ("e", 0, "tests/test_m.py", BEFORE), ("e", 1, "tests/test_m.py", BEFORE), ("f", 0, "a.py", "x = (\n"), ("f", 1, "a.py", "x = 1\n"), ("g", 0, "test_only.py", BEFORE)]
    files = spark.createDataFrame(rows, "episode_id string, step int, path string, text string")
    return files, measures.snapshot_nodes(files).persist()


def by_key(df, *columns):
    return {(r["episode_id"], r["step"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_grades_of_dead_code(repo):
    m = measures.symbol_measures(repo[1])
    got = by_key(m, "raw_count", "weighted_total")
    # Imports os and sys, the variable left, a statement after return, and the symbols os, sys, Run and left; then sys and run.
    assert got["e", 0] == (8, round(2 + 0.8 + 1.2 + 4 * 1.5, 3)) and got["e", 1] == (2, 3.0) and got["g", 0] == (0, 0.0)
    g = {(r["episode_id"], r["step"]): r for r in grading.graded(m, grading.GRADERS["symbol"]).collect()}
    assert g["e", 1]["score"] == pytest.approx(0.7) and g["e", 1]["said"] == ["Dead code: 8 → 2 (-6). Weighted: 10.0 → 3.0 (70% eliminated). Remaining: dead function ×2."]
    assert g["g", 0]["score"] == 1.0 and g["f", 1]["penalty"] == "1.0" and g["f", 1]["said"][0].startswith("Dead code: 0 → 1 (+1 (regression))")
    assert g["e", 0]["said"][0].endswith("Remaining: unused import ×2, unused variable ×1, unreachable block ×1.")


def test_grades_of_style(repo):
    files, nodes = repo
    m = measures.style_measures(nodes, files)
    got = by_key(m, "violations", "error_violations", "raw_score")
    # N003, D001, T001, T002 and I006 in the first; nothing in the second. A file that doesn't parse has none, nor has a test.
    assert got["e", 0][:2] == (5, 3) and got["e", 1] == (0, 0, 1.0) and got["f", 0][0] == 0 and got["g", 0] == (0, 0, 1.0)
    g = {(r["episode_id"], r["step"]): r for r in grading.graded(m, grading.GRADERS["style"]).collect()}
    assert g["e", 1]["score"] == 1.0 and g["e", 1]["said"] == ["[Style] Gold standard — zero violations (Google Python Style Guide)."]
    assert g["e", 0]["score"] == 0.0 and "Weakest dims: " in g["e", 0]["said"][0] and "×1 (" in g["e", 0]["said"][0]
    ignored = measures.style_measures(nodes, files, ignore=("N003", "T002"))
    assert by_key(ignored, "violations")["e", 0] == (3,)


def test_grades_of_lint(spark):
    rows = [("e", 0, "[{},{}]", "", 1, False), ("e", 1, "[{},{},{}]", "", 1, False), ("e", 2, "", "", 0, False), ("e", 3, "", " no such file ", 2, False), ("e", 4, "[]", "", 0, True), ("f", 0, "[]", "", 0, False)]
    runs = spark.createDataFrame(rows, "episode_id string, step int, stdout string, stderr string, return_code int, timed_out boolean")
    g = {(r["episode_id"], r["step"]): r for r in grading.graded(measures.lint_measures(runs), grading.GRADERS["lint"]).collect()}
    assert g["e", 1]["said"] == ["Lint: 2 → 3 violations (↑1)  score=0.00"] and g["e", 1]["errors"] == ["[lint] regression: 1 new violation(s) introduced vs baseline."] and g["e", 1]["penalty"] == "1"
    assert g["e", 2]["score"] == 1.0 and g["e", 2]["said"] == ["Lint: 2 → 0 violations (↓2)  score=1.00"] and g["e", 0]["said"][0].endswith("(→0)  score=0.00")
    assert g["e", 3]["tool_errors"] == ["[lint] ruff failed: no such file"] and g["e", 4]["tool_errors"] == ["[lint] ruff failed: ruff timed out"]
    assert g["f", 0]["said"] == ["Lint: baseline was already clean (0 violations)."] and g["f", 0]["score"] == 1.0


def test_grades_of_complexity(spark, repo):
    report = '{"pkg/m.py": [{"name": "Run", "complexity": %d, "rank": "A"}], "tests/test_m.py": [{"name": "t", "complexity": 99}], "x.py": {"error": "bad"}}'
    rows = [("e", 0, report % 15, 0, False), ("e", 1, "", 2, False), ("f", 0, report % 5, 1, False), ("f", 1, report % 12, 0, False), ("g", 0, "no json", 0, False)]
    runs = spark.createDataFrame(rows, "episode_id string, step int, stdout string, return_code int, timed_out boolean")
    m = measures.complexity_measures(repo[1], runs)
    got = by_key(m, "cc_cost_sum", "cc_avg", "cc_fns", "tool_error")
    assert got["e", 0] == (25.0, 15.0, 1, "") and got["f", 0] == (0.0, 5.0, 1, "") and got["g", 0][3] == "radon JSON parse failed"
    g = {(r["episode_id"], r["step"]): r for r in grading.graded(m, grading.GRADERS["complexity"]).collect()}
    # The tool failed at the second step: the mean counts in place of the cost, and is 0.
    assert g["e", 1]["score"] == pytest.approx(0.55 + 0.45) and g["e", 1]["said"][-1] == "[radon: radon exit 2]"
    assert g["f", 1]["errors"] == ["[complexity] regression: CC cost 0.0→4.0, Big-O cost 0.0→0.0"] and g["e", 0]["score"] == pytest.approx(0.45)
    assert "Worst fn: 'pkg.m.Run' (O1, cost=0.0). Patterns: none." in g["e", 0]["said"][0]


def test_grades_of_coverage(spark):
    cover = '{"totals":{"covered_lines":%d,"num_statements":100}}'
    rows = [("e", 0, "8 passed, 2 failed", cover % 60, 0, "", False), ("e", 1, "10 passed", cover % 70, 0, "", False), ("e", 2, "9 passed, 1 error", cover % 50, 0, "", False), ("e", 3, "", cover % 90, 1, "boom", False), ("e", 4, "", "", 0, "", True), ("e", 5, "5 passed", cover % 85, 0, "", False)]
    runs = spark.createDataFrame(rows, "episode_id string, step int, stdout string, coverage string, return_code int, stderr string, timed_out boolean").withColumn("report", F.lit(None).cast("string"))
    m = measures.coverage_measures(runs)
    g = {r["step"]: r for r in grading.graded(m, grading.coverage_grader()).collect()}
    assert [g[i]["score"] for i in range(6)] == [0.8, 1.0, 0.45, 0.0, 0.0, 1.0]
    assert g[1]["said"] == ["[Coverage/constraint] 10/10 tests pass (100%). Coverage: 60.0% → 70.0% (+10.0pp)."] and g[2]["said"][0].endswith("(-10.0pp) — dropped beyond 2% tolerance; score halved.")
    assert g[3]["tool_errors"] == ["boom"] and g[4]["errors"] == ["pytest timed out after unknowns"] and g[4]["said"] == ["[Coverage] pytest did not complete: pytest timed out"]
    o = {r["step"]: r for r in grading.graded(m, grading.coverage_grader("objective", 0.8)).collect()}
    assert [o[i]["score"] for i in range(3)] == [0.0, 0.5, 0.0] and o[5]["score"] == 1.0
    assert o[1]["said"] == ["[Coverage/objective] Coverage: 60.0% → 70.0% (+10.0pp, 50% toward 80.0%). Tests: 10/10 (100%)."] and "regressed" in o[2]["said"][0] and "Target reached" in o[5]["said"][0]


def test_dispatcher_orders_what_is_said(spark):
    rows = [("e", 1, "b", 0.5, 2.0, ["B1", "B2"], ["eb"], [], "2"), ("e", 1, "a", 1.0, 0.0, ["A"], [], ["ta"], None), ("e", 1, "c", 0.2, 1.0, ["C"], ["ec"], [], "1.0"), ("e", 1, "unknown", 1.0, 0.0, ["no"], [], [], None)]
    grades = spark.createDataFrame(rows, "episode_id string, step int, grader_id string, score double, added double, said array<string>, errors array<string>, tool_errors array<string>, penalty string")
    specs = spark.createDataFrame([("c", 0.3, 0), ("b", 0.3, 1), ("a", 0.4, 2)], "grader_id string, weight double, place int")
    r = grading.step_scores(grades, specs).first()
    assert (r["said"], r["errors"], r["tool_errors"], r["penalties"]) == (["A", "C", "B1", "B2"], ["ec", "eb"], ["ta"], ["1.0", "2"]) and r["step_score"] == 0.61 and r["is_regression"]


def test_a_whole_pass(spark, repo):
    files, nodes = repo
    keys = files.select("episode_id", "step").distinct()
    lint = keys.select("*", F.lit("[{}]").alias("stdout"), F.lit("").alias("stderr"), F.lit(1).alias("return_code"), F.lit(False).alias("timed_out"))
    cc = lint.withColumn("stdout", F.lit("{}"))
    tests = keys.select("*", F.lit("1 passed").alias("stdout"), F.lit(None).cast("string").alias("report"), F.lit("").alias("coverage"), F.lit(0).alias("return_code"), F.lit("").alias("stderr"), F.lit(False).alias("timed_out"))
    specs = spark.createDataFrame([("lint", 0.2), ("symbol", 0.2), ("style", 0.2), ("complexity", 0.2), ("coverage", 0.2)], "grader_id string, weight double")
    got = {(r["episode_id"], r["step"]): r for r in measures.grade_all(files, nodes, lint, cc, tests, specs).collect()}
    assert len(got["e", 1]["said"]) == 5 and got["e", 1]["step_score"] == pytest.approx(0.2 * (0 + 0.7 + 1 + 1 + 1)) and not got["e", 1]["is_regression"]


def test_regrading_a_stream(spark, repo, tmp_path):
    """Edits that come as a stream get the grades that the batch gives."""
    files, nodes = repo
    files.where("step = 1").write.partitionBy("episode_id").parquet(str(tmp_path / "in"))
    edits = spark.readStream.schema("step int, path string, text string, episode_id string").parquet(str(tmp_path / "in")).select("episode_id", "step", "path", "text")
    got = {tuple(r) for r in episode.regrade(edits, files.where("step = 0"), str(tmp_path / "out")).select("episode_id", "step", "grader_id", F.round("score", 6)).collect()}
    want = grading.graded(measures.symbol_measures(nodes), grading.GRADERS["symbol"]).unionByName(grading.graded(measures.style_measures(nodes, files), grading.GRADERS["style"]))
    assert got == {tuple(r) for r in want.where("step = 1").select("episode_id", "step", "grader_id", F.round("score", 6)).collect()} and len(got) == 4


def test_white_space_of_lines(spark):
    long = "x" * 90
    rows = [f"\t# http://{long}", "\t# a; b", "a = 1\xa0", "a = 1　", "a = 1", "\x0b\tx; y"]
    got = {(r["rule"], r["line"]) for r in lines.line_violations(spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(rows)], "path string, lineno int, text string")).collect()}
    assert got == {("F004", 1), ("F004", 2), ("F001", 3), ("F001", 4), ("F003", 6)}
    assert lines.line_violations(spark.createDataFrame([("p", 1, "a = 1 ")], "path string, lineno int, text string"), ignore=("F001",)).count() == 0
    n = astfacts.ast_nodes(spark.createDataFrame([("m.py", '"""M."""\n\n\ndef f():\n    """One.\n\t\n    Two."""\n')], "path string, text string"))
    assert "D005" not in {r["rule"] for r in style.ast_violations(n).collect()}


def test_test_files_have_no_dead_code(spark):
    rows = [("test_main.py", "import os\n"), ("tests/x.py", "import os\n"), ("main.py", "import os\n"), ("testing/y.py", "import os\n")]
    n = astfacts.ast_nodes(spark.createDataFrame(rows, "path string, text string"))
    assert {r["path"] for r in symbols.dead_code(n).collect()} == {"main.py", "testing/y.py"} and symbols.dead_code(n, skip_tests=False).select("path").distinct().count() == 4


@pytest.mark.parametrize(("pattern", "hits"), [(r"a+b", ["a+b"]), (r"a\+b", ["aab", "ab"]), (r"x{2}", ["x{2}"]), (r"x\{2\}", ["xx"]), (r"\(q\)", ["(q)", "q"]), ("(q)", ["(q)"]), (r"idiot\|moron", ["idiot", "moron"]), ("*z", ["*z"]), ("[[:digit:]]7", ["47"]), ("^q$", ["q"]), ("m^", ["m^"]), ("[]x]x", ["xx"]), (r"[a\]+", ["a+b"])])
def test_basic_patterns(spark, pattern, hits):
    rows = ["a+b", "aab", "ab", "x{2}", "xx", "(q)", "q", "idiot", "moron", "*z", "47", "m^"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert sorted(r[0] for r in df.where(F.col("t").rlike(text.basic_regex(pattern))).collect()) == sorted(hits)


def test_unused_names_in_deep_heads(spark):
    n = astfacts.ast_nodes(spark.createDataFrame([("g.py", "def g(x=a.b.c.d.e.f.h.i.j.k.l): a = 1\n")], "path string, text string"))
    assert [r["name"] for r in symbols.unused_variables(n).collect()] == ["g:g.a"]


def test_exports_and_late_imports(spark):
    source = "import sys\nfrom x import Y\nimport os\nimport re\n__all__ = ['f', 'Y']\n__all__ = ['g']\n\n\ndef f():\n    pass\n\n\ndef g():\n    pass\n"
    n = astfacts.ast_nodes(spark.createDataFrame([("m.py", source)], "path string, text string"))
    assert {r["name"] for r in symbols.definitions(n).where("is_in_all").collect()} == {"f", "Y"}
    assert [r["line"] for r in style.ast_violations(n).where("rule = 'I005'").collect()] == [3]


def test_actions_are_repaired(spark):
    rows = [(1, '{"action_type": "edit_file", "args": {"patch": {"path": "a", "new_content": "x"}}}'), (2, "[1]"), (3, '"text"'), (4, '{"action_type": "git_diff", "args": {"paths": ["a", "b"]}}'), (5, ""), (6, None)]
    got = {r["id"]: r["action"] for r in tools.parse_actions(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got[1]["args"]["patch"]["path"] == "a" and got[4]["args"]["paths"] == ["a", "b"]
    assert all(got[i]["action_type"] == "list_directory" and got[i]["args"]["path"] == "." for i in (2, 3, 5, 6))


def test_bounds_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(records, "MOST_PAIRS", 3)
    rows = spark.createDataFrame([(i, float(i)) for i in range(4)], "k int, v double")
    with pytest.raises(ValueError):
        records.pairs(rows, "k", "v")
    assert records.pairs(rows.limit(3), "k", "v").count() == 9


def test_limits_of_parameters(spark):
    """Of each parameter the least and the greatest value pass, and those beside them don't; null is no value."""
    for name, (lo, hi) in records.LIMITS.items():
        inside = [x for x in (lo, hi) if x is not None] + [None]
        outside = ([lo - 1] if lo is not None else []) + ([hi + 1] if hi is not None else [])
        df = spark.createDataFrame([(x,) for x in inside + outside], f"{name} int")
        assert [r["broken"] for r in records.valid_parameters(df).collect()] == [[]] * len(inside) + [[name]] * len(outside)


def test_estimates_of_one_name(spark):
    """Of two functions with one qualified name the last in breadth-first order counts."""
    source = "def f(xs):\n    for x in xs:\n        pass\n\n\nclass C:\n    def f(self, xs):\n        for x in xs:\n            for y in x:\n                pass\n"
    n = astfacts.ast_nodes(spark.createDataFrame([("m.py", source)], "path string, text string"))
    assert [(r["qualified_name"], r["time"]) for r in complexity.repository_estimates(n).collect()] == [("m.f", 4)]


def test_folders_and_paths(spark, tmp_path):
    for x in ("b", "a"):
        (tmp_path / x).mkdir()
    (tmp_path / "f").write_text("")
    assert code.task_folders(spark, str(tmp_path)) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        code.task_folders(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([("a/b",), ("../a",), ("a/../..",), ("/a",), ("a/./..",), ("",)], "p string")
    assert [r[0] for r in df.select(paths.safe(F.col("p"))).collect()] == [True, False, False, False, True, True]
    files = spark.createDataFrame([("b.py",), ("tests/a.py",), ("x.txt",)], "path string")
    assert [r[0] for r in code.symbol_files(files).collect()] == ["b.py"] and [r[0] for r in code.symbol_files(files, tests=True).collect()] == ["b.py", "tests/a.py"]
    assert [r[0] for r in code.python_files(files, ["tests/**"]).collect()] == ["b.py"]
    entries = files.withColumn("is_dir", F.lit(False))
    assert [r["path"] for r in code.lint_files(entries).collect()] == ["b.py"]


def test_diffs_of_snapshots(spark):
    a = spark.createDataFrame([("x", "1\n2\n3\n"), ("y", "1")], "path string, text string")
    b = spark.createDataFrame([("x", "1\n3\n4\n"), ("z", "")], "path string, text string")
    got = {r["path"]: r for r in code.snapshot_diff(a, b).collect()}
    assert (got["x"]["added"], got["x"]["removed"]) == (1, 1) and "@@ -1,3 +1,3 @@" in got["x"]["diff"] and got["y"]["change"] == "removed" and got["z"]["added"] == 0
    assert patches.apply_diff("1\n2\n3\n", got["x"]["diff"]) == "1\n3\n4\n" and code.snapshot_diff(a, b, only=["z"]).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("e", 1, "a.py", "x"), ("e", 2, "a.py", "y")], "episode_id string, step int, path string, text string")
    sinks.write_snapshot(rows, str(tmp_path / "s"))
    sinks.write_snapshot(rows.where("step = 2").withColumn("text", F.lit("z")), str(tmp_path / "s"))
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["x", "z"]
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    v = spark.createDataFrame([("N003", "a", 1), ("D001", "a", 2)], "rule string, path string, line int")
    assert {(r["rule"], r["dimension"], r["severity"]) for r in sinks.with_rule_text(v).collect()} == {("N003", "naming", "error"), ("D001", "docstrings", "error")}
    assert [tuple(r) for r in sinks.changes_by_rule(v, v.where("rule = 'N003'")).collect()] == [("D001", 1, 0, "D001: 1 → 0")]
    view = sinks.initial_view(spark.createDataFrame([("e", "b.py", "2"), ("e", "a.py", "1\n2"), ("e", "p/a.py", "0")], "episode_id string, path string, text string"))
    assert [(r["path"], r["text"]) for r in view.orderBy("lineno").collect()] == [("e:a.py", "1"), ("e:a.py", "2")]


def test_transitive_imports_and_intervals(spark):
    e = spark.createDataFrame([("a", "b", "IMPORTS"), ("b", "c", "IMPORTS"), ("c", "a", "IMPORTS"), ("c", "d", "CALLS")], "src string, dst string, kind string")
    assert {r[0] for r in graph.transitive_imports(e, "a", spark).collect()} == {"b", "c"}
    points, spans = spark.createDataFrame([(5,), (50,), (None,), (5,)], "point int"), spark.createDataFrame([(0, 9), (4, 6), (3, 5), (9, 2), (None, 7)], "lo int, hi int")
    assert {tuple(r) for r in graph.innermost(points, spans).collect()} == {(5, 3, 5)}
    assert graph.innermost(points, spans.limit(0)).count() == graph.innermost(points.limit(0), spans).count() == 0
