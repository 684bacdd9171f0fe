"""Semantics that the test tables don't show."""

import math

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import paths, scoring, text
from quarrylens.operators import astfacts, complexity, grading, graph, lines, patches, records, style, symbols
from quarrylens.sources import code, tools


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_quadratic_cost(spark):
    df = spark.createDataFrame([(10,), (15,), (26,), (5,)], "cc int")
    assert [r[0] for r in df.select(complexity.quadratic_cost(F.col("cc"))).collect()] == [0, 25, 256, 0]


def test_cc_metrics(spark):
    m = complexity.cc_metrics(spark.createDataFrame([(15,), (5,), (8,)], "cc int")).first()
    assert (m["cc_cost_sum"], m["n"]) == (25, 3) and math.isclose(m["cc_avg"], 28 / 3)


def test_scores(spark):
    df = spark.createDataFrame([(0.0, 5.0), (100.0, 50.0), (10.0, 20.0), (None, 1.0)], "b double, c double")
    assert [r[0] for r in df.select(scoring.delta_score("b", "c")).collect()][:3] == [1.0, 0.5, 0.0]
    row = spark.range(1).select(scoring.complexity_score(F.lit(100.0), F.lit(50.0), F.lit(50.0), F.lit(25.0)).alias("a"), scoring.complexity_score(F.lit(1.0), F.lit(9.0), F.lit(1.0), F.lit(9.0)).alias("b"), scoring.style_score(F.lit(1.0), F.lit(1.0), F.lit(0)).alias("c"), scoring.coverage_objective(F.lit(1.0), F.lit(0.8), F.lit(0.6), F.lit(0.9)).alias("d")).first()
    assert row["a"] == 0.5 and row["b"] == 0.01 and row["c"] == 1.0 and math.isclose(row["d"], 2 / 3)


def test_rounding_is_that_of_python(spark):
    assert spark.range(1).select(scoring.python_round(F.lit(2.675), 2)).first()[0] == 2.67


@pytest.mark.parametrize(("scores", "total"), [([(1, 0.8, 0.9)], 0.72), ([(1, 0.5, 0.8), (1, 0.3, 0.9), (1, 0.2, 0.7)], 0.81)])
def test_dispatch(spark, scores, total):
    grades = spark.createDataFrame([("e", 1, f"g{i}", s, 5.0 if i == 0 else 0.0) for i, (_, _, s) in enumerate(scores)], "episode_id string, step int, grader_id string, score double, added double")
    specs = spark.createDataFrame([(f"g{i}", w) for i, (_, w, _) in enumerate(scores)], "grader_id string, weight double")
    row = grading.step_scores(grades, specs).first()
    assert math.isclose(row["step_score"], total) and row["penalties"] == ["5"] and row["is_regression"]


def test_graders_are_registered_once():
    with pytest.raises(ValueError):
        grading.register(grading.GRADERS["lint"])


def test_dead_code_first_counts(spark):
    rows = [("unused_import", "a", "f", 1, 1.0, 0, 0), ("dead_function", "b", "f", 2, 0.8, 2, 0), ("dead_function", "a", "f", 9, 1.5, 2, 1)]
    got = symbols.aggregate_dead(spark.createDataFrame(rows, "kind string, name string, path string, line int, weight double, pass int, seq int")).first()
    assert (got["weighted_total"], got["raw_count"]) == (1.8, 2)


def test_tolerant_parse():
    assert astfacts.tolerant_parse("x = 1\ndef f(:\n")[1] == "partial"
    assert astfacts.tolerant_parse("def f(:\n")[1] == "partial"
    assert astfacts.tolerant_parse("try:\n    x = 1\nfoo bar\n")[1] == "failed"


def test_unparsable_files_keep_a_row(spark):
    n = astfacts.ast_nodes(spark.createDataFrame([("a.py", "try:\n    x = 1\nfoo bar\n"), ("b.py", None), ("c.py", "")], "path string, text string"))
    assert {(r["path"], r["status"]) for r in n.collect()} == {("a.py", "failed"), ("b.py", "ok"), ("c.py", "ok")}


def test_empty_repository_scores_one(spark):
    n = astfacts.ast_nodes(spark.createDataFrame([], "path string, text string"))
    empty = spark.createDataFrame([], "path string, lineno int, text string")
    assert style.style_metrics(n, empty).first()["raw_score"] == pytest.approx(1.0)


def test_line_breaks_are_universal(spark):
    got = lines.source_lines(spark.createDataFrame([("a", "x\r\ny\x0bz w\n")], "path string, text string"))
    assert [r["text"] for r in got.orderBy("lineno").collect()] == ["x", "y", "z", "w"]


def test_semicolons_in_quotes(spark):
    df = spark.createDataFrame([("a = ';'",), ("a; b",), ("# a; b",), ("s = 'x;",), ("x = 1  # a;",)], "t string")
    assert [r[0] for r in df.select(lines.bare_semicolon(F.col("t"))).collect()] == [False, True, False, False, True]


def test_globs(spark):
    df = spark.createDataFrame([("test_a.py",), ("x/test_a.py",), ("tests/a/b.py",), ("x/a_test.py",)], "p string")
    assert [r[0] for r in df.select(paths.test_by_globs(F.col("p"))).collect()] == [True, False, True, True]


def test_excludes_are_no_globs(spark):
    df = spark.createDataFrame([("a.egg-info/x.py",), ("build/x.py",), ("x_pb2.py",)], "p string")
    assert [r[0] for r in df.select(paths.excluded(F.col("p"))).collect()] == [False, True, True]


def test_ignore_files(spark):
    df = spark.createDataFrame([("a/x.log",), ("a/x.py",), (".git/config",), ("out/y",)], "p string")
    assert [r[0] for r in df.select(paths.ignored(F.col("p"), ["*.log", "# c", "!x", "out/"])).collect()] == [True, False, True, True]


def test_ranged_read_beyond_100_is_empty(spark):
    rows = spark.createDataFrame([("a", i, "x") for i in range(1, 201)], "path string, lineno int, text string")
    assert lines.read_lines(rows, 150).count() == 0 and lines.read_lines(rows, 150, 160).count() == 11


def test_reports(spark):
    runs = spark.createDataFrame([("[]", 0, False), ('[{"code":"E"}]', 1, False), ("invalid json", 1, False), ("[]", 2, False), ("[]", 0, True)], "stdout string, return_code int, timed_out boolean")
    assert one(tools.lint_report(runs), "violations", "tool_error") == [(0, None), (1, None), (0, "json"), (0, "exit"), (0, "timeout")]
    said = spark.createDataFrame([("10 passed, 2 failed, 1 error", None), ("", '{"summary":{"passed":3,"error":1}}')], "stdout string, report string")
    assert one(tools.run_counts(said), "passed", "failed", "errors") == [(10, 2, 1), (3, 0, 1)]


def test_diffs():
    assert patches.apply_diff("line1\nline2\nline3\n", "@@ -2 +2 @@\n-line2\n+line2_modified\n") == "line1\nline2_modified\nline3\n"


def test_edits_in_order(spark):
    files = spark.createDataFrame([("a", "1\n")], "path string, text string")
    edits = spark.createDataFrame([("a", 2, None, "@@ -1 +1 @@\n-2\n+3\n"), ("a", 1, "2\n", None), ("a", 3, "x", "y"), ("b", 1, "new", None)], "path string, seq int, new_content string, unified_diff string")
    assert {tuple(r) for r in patches.apply_edits(files, edits).collect()} == {("a", "3\n"), ("b", "new")}


def test_reading_sources(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes(b"x = 1\n\xff")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "b.py").write_text("")
    got = code.read_sources(spark, str(tmp_path)).collect()
    assert [(r["path"], r["text"]) for r in got] == [("pkg/a.py", "x = 1\n�")]


def test_scenario(spark, tmp_path):
    (tmp_path / "scenario.yaml").write_text("slug: s\ngraders:\n  lint: 0.5\n  coverage: {weight: 0.5, target_coverage: 0.9}\n")
    s = code.scenario(spark, str(tmp_path / "scenario.yaml"))
    assert grading.active(code.grader_specs(spark, [s])).count() == 2
    (tmp_path / "scenario.yaml").write_text("graders: [1]\n")
    with pytest.raises(ValueError):
        code.scenario(spark, str(tmp_path / "scenario.yaml"))


def test_cycles_and_replacing(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "f"), ("f", "d")], "src string, dst string")
    assert {(r["node"], r["cycle"], r["size"]) for r in graph.cycles(e).collect()} == {("a", "a", 2), ("b", "a", 2), ("d", "d", 3), ("e", "d", 3), ("f", "d", 3)}
    t = spark.createDataFrame([("p", 1), ("q", 2)], "path string, v int")
    assert {tuple(r) for r in graph.replace_files(t, spark.createDataFrame([("q", 3)], "path string, v int")).collect()} == {("p", 1), ("q", 3)}


def test_cycles_of_the_whole_table(spark, sf):
    """The query over the edges of all customers against a plain search for what reaches each other."""
    from quarrylens.plans import relational

    next_: dict[int, set[int]] = {}
    for r in relational._edges(spark, sf).collect():
        next_.setdefault(r["src"], set()).add(r["dst"])
    reach = {}
    for start in next_:
        seen, todo = set(), [start]
        while todo:
            news = next_.get(todo.pop(), set()) - seen
            seen |= news
            todo += news
        reach[start] = seen
    groups = {a: {b for b in reach[a] if a in reach.get(b, ())} | {a} for a in next_}
    want = {(a, min(g), len(g)) for a, g in groups.items() if len(g) > 1}
    assert {tuple(r) for r in relational.import_cycles(spark, sf).select("node", "cycle", "size").collect()} == want
    assert len(want) > 99


def test_text_functions(spark):
    row = spark.range(1).select(text.slugify(F.lit(" Hello,  World! ")).alias("s"), text.safe_divide(F.lit(1.0), F.lit(0.0)).alias("d"), text.normalize_score(F.lit(150.0), F.lit(0.0), F.lit(100.0)).alias("n"), text.normalize_score(F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias("e"), text.strip_fence(F.lit('```json\n{"a":1}\n```')).alias("f")).first()
    assert tuple(row) == ("hello-world", 0.0, 1.0, 0.0, '{"a":1}')


def test_batches(spark):
    got = records.batches(spark.createDataFrame([("k", i) for i in range(10)], "k string, i int"), 3, ["k"], ["i"], "i")
    assert sorted(len(r["items"]) for r in got.collect()) == [1, 3, 3, 3]


def test_empty_docstring_is_an_error_row(spark):
    n = astfacts.ast_nodes(spark.createDataFrame([("a.py", 'def f():\n    ""\n')], "path string, text string"))
    assert [r["rule"] for r in style.ast_violations(n).collect()] == ["ERROR"]


def test_long_lines_that_are_exempt(spark):
    long = "x" * 90
    rows = [f"a = {long}", f"# http://{long}", f"#  see http://{long}", long, f"a = {long}  # noqa", f"# pylint: {long} x"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(lines.too_long(F.col("t"))).collect()] == [True, False, True, False, False, False]


def test_deep_heads_and_slices(spark):
    """A default is no part of the body and a floor division halves, however deep they stand."""
    deep = "-" * 20
    code = f"def f(a={deep}x):\n    x = 1\n\n\ndef g(v, n):\n    return g(v[: {deep}(n // 2)], n)\n"
    nodes = astfacts.ast_nodes(spark.createDataFrame([("m.py", code)], "path string, text string"))
    assert [r["name"] for r in symbols.unused_variables(nodes).collect()] == ["m:f.x"]
    assert {r["func"]: r["halves"] for r in complexity.function_signals(nodes).collect()}[max(r["node"] for r in nodes.where("name = 'g' AND type = 'FunctionDef'").collect())]
