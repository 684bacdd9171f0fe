"""What changes: diffs, cut texts, intervals, graphs carried over edits, clones, snapshots and facts by content, streams, sources, table functions."""

import difflib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import tables, text
from quarrylens.operators import astfacts, content, grading, graph, measures, patches, symbols
from quarrylens.plans import changes
from quarrylens.sources import repository
from quarrylens.streaming import actions


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_diffs_of_lines_that_look_like_marks():
    r, bits = random.Random(0), ["-- ", "++ ", "@@ -1 +1 @@", " x", "-", "+", "", "a\r", "b\x0c", "\\ No", "diff "]
    whole = lambda: "\n".join(r.choice(bits) + str(r.randint(0, 3)) for _ in range(r.randint(0, 12))) + r.choice(["", "\n"])
    for _ in range(4000):
        a, b = whole(), whole()
        lines = difflib.unified_diff(patches._lines(a), patches._lines(b), "a", "b", n=r.randint(0, 3))
        diff = "".join(x if x.endswith("\n") else f"{x}\n{patches.NO_BREAK}\n" for x in lines)
        assert patches.apply_diff(a, diff) == b
    assert patches.apply_diff("-- a\nb\nc\n", "--- x\n+++ x\n@@ -1,3 +1,2 @@\n--- a\n b\n c\n") == "b\nc\n"
    assert patches.apply_diff("a\nb\n", "@@ -1,2 +1,2 @@\n\n-b\n+c\n") == "\nc\n"  # an empty line is context
    assert patches.apply_diff("", "--- /dev/null\n+++ b/x\n@@ -0,0 +1 @@\n+a\n") == "a\n" and patches.apply_diff("a\n", "no diff") == "a\n"


def test_texts_cut_within_characters(spark):
    whole = "aé中😀z" * 3
    df = spark.createDataFrame([(whole, i) for i in range(40)] + [("", 3), (None, 3)], "t string, n int")
    for t, n, got in df.select("t", "n", text.truncate_bytes(F.col("t"), F.col("n"))).collect():
        data = (t or "").encode()
        assert got == (None if not t else t if len(data) <= n else data[:n].decode("utf-8", "replace") + text.CUT)
    assert spark.range(1).select(text.truncate_bytes(F.lit("x" * 9000))).first()[0] == "x" * 8192 + text.CUT


def test_intervals_of_any_length(spark):
    """Against every pair: intervals of one number up to the whole range, negative ones, equal ones."""
    r = random.Random(4)
    spans = [(lo := r.randint(-5000, 5000), lo + int(10 ** r.uniform(0, 6)) - 1) for _ in range(200)] + [(-(2**60), 2**60), (7, 7), (7, 7), (9, 8)]
    points = [r.randint(-6000, 20_000) for _ in range(500)] + [7, 2**59, -(2**61)]
    got = rows(graph.innermost(spark.createDataFrame([(p,) for p in points], "point long"), spark.createDataFrame(spans, "lo long, hi long")), "point", "lo", "hi")
    best = {p: min(((hi - lo, lo, hi) for lo, hi in spans if lo <= p <= hi), default=None) for p in points}
    assert got == sorted(((p, *b[1:]) for p, b in best.items() if b), key=str)


def test_dyadic_cells_make_up_their_interval(spark):
    spans = [(-9, 22), (0, 0), (0, 63), (1, 63), (-64, 63), (5, 4), (-(2**61) + 1, 2**61 - 3)]
    df = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", graph.dyadic_cells(F.col("lo"), F.col("hi")).alias("c"))
    for lo, hi, cells in df.collect():
        ranges = sorted((c["cell"] << c["level"], (c["cell"] + 1) << c["level"]) for c in cells)
        assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])) and (ranges[0][0], ranges[-1][1]) == (lo, hi + 1) if lo <= hi else not ranges
        assert max([0, *(sum(c["level"] == k for c in cells) for k in range(62))]) <= 2


MODULE = "from pkg.m{b} import f{b}\n\n\ndef f{a}(x):\n    return {call}\n\n\ndef g{a}(x):\n    return f{a}(x)\n"


def module(a, b, calls):
    return f"pkg/m{a}.py", MODULE.format(a=a, b=b, call=f"f{b}(x)" if calls else "x")


def test_graph_carried_over_edits_is_that_of_a_full_build(spark):
    """Random edits, among them cycles that lose their only way in, files that go and come, and other seeds."""
    r = random.Random(6)
    files = dict(module(a, r.randrange(12), r.random() < 0.6) for a in range(12))
    table = lambda held: spark.createDataFrame(list(held.items()), "path string, text string")
    seeds = spark.createDataFrame([("pkg.m0.g0",), ("pkg.m5.f5",), ("pkg.gone",)], "node string")
    now = graph.built(astfacts.ast_nodes(table(files)), seeds)
    for step in range(5):
        edit = {}
        for a in r.sample(range(12), 3):
            path, source = module(a, r.randrange(12), r.random() < 0.6)
            edit[path] = source if r.random() < 0.75 else None
        files = {p: t for p, t in {**files, **edit}.items() if t is not None}
        seeds = spark.createDataFrame([("pkg.m3.g3",), ("pkg.m5.f5",)], "node string") if step == 2 else None
        now = graph.rebuilt(now, table(edit), seeds)
        want = graph.built(astfacts.ast_nodes(table(files)), now.seeds)
        assert rows(now.edges, "src", "dst", "kind", "path", "line") == rows(want.edges, "src", "dst", "kind", "path", "line")
        assert rows(now.reach, "node") == rows(want.reach, "node")


def test_cycles_that_lose_their_way_in(spark):
    """Nodes of a cycle reach each other, and go all the same when nothing else reaches them."""
    files = [("a.py", "from b import f\n\n\ndef start():\n    return f()\n"), ("b.py", "from c import g\n\n\ndef f():\n    return g()\n"), ("c.py", "from b import f\n\n\ndef g():\n    return f()\n")]
    old = graph.built(astfacts.ast_nodes(spark.createDataFrame(files, "path string, text string")), spark.createDataFrame([("a.start",)], "node string"))
    assert {"b.f", "c.g"} <= {r[0] for r in old.reach.collect()}
    now = graph.rebuilt(old, spark.createDataFrame([("a.py", "def start():\n    return 1\n")], "path string, text string"))
    assert rows(now.reach, "node") == [("a.start",)]


def test_rebuild_reads_changed_files_alone(spark, monkeypatch):
    seen, real = [], astfacts.ast_nodes
    files = [module(a, (a + 1) % 8, True) for a in range(8)]
    old = graph.built(astfacts.ast_nodes(spark.createDataFrame(files, "path string, text string")), spark.createDataFrame([("pkg.m0.f0",)], "node string"))
    monkeypatch.setattr(astfacts, "ast_nodes", lambda f: seen.extend(r["path"] for r in f.collect()) or real(f))
    graph.rebuilt(old, spark.createDataFrame([module(3, 5, False)], "path string, text string"))
    assert seen == ["pkg/m3.py"]


CLONES = [
    ("a.py", "def f(x, y):\n    x = y + 1\n    y = x * 2\n    if x:\n        return y\n    return x\n"),
    ("b.py", "def g(p, q):\n    p = q + 7\n    q = p * 9\n    if p:\n        return q\n    return p\n\n\ndef h(p, q):\n    print(p)\n    p = q + 7\n    q = p * 9\n    if p:\n        return q\n"),
    ("c.py", 'def k(x, y):\n    x = y - 1\n    """Said."""\n    y = x * 2\n    if x:\n        return y\n'),
    ("d.py", "def r(x):\n    x = 1\n    x = 2\n    x = 3\n    x = 4\n    x = 5\n    x = 6\n"),
]


def test_clone_runs(spark):
    """A pair shares one run; windows are named on their own; a stretch doesn't repeat what overlaps it."""
    got = rows(symbols.clone_runs(astfacts.ast_nodes(spark.createDataFrame(CLONES, "path string, text string"))), "path", "line", "end_line", "statements", "cross_file", "weight")
    assert got == [("b.py", 11, 14, 3, True, 1.2), ("b.py", 2, 6, 4, True, 1.2), ("d.py", 5, 7, 3, False, 1.0)]


def test_duplication_is_graded(spark):
    files = [("e", 0, *f) for f in CLONES] + [("e", 1, *f) for f in CLONES[:1]] + [("e", 2, *f) for f in CLONES[:2]]
    m = measures.duplication_measures(measures.snapshot_nodes(spark.createDataFrame(files, "episode_id string, step int, path string, text string")))
    g = grading.graded(m, grading.GRADERS["duplication"])
    assert rows(g.withColumn("score", F.round("score", 4)), "step", "score", "added") == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.2941, 0.0)]
    assert g.where("step = 2").first()["said"] == ["[Duplication] 3 → 2 duplicate block(s), 2 across files. Score: 29%."]


TREE = {"a.py": "1\n2\n", "p/b.py": "x\n", "p/q/c.py": "y\n", "r/s/t/d.py": "z\n"}


def state(spark, **episodes):
    return spark.createDataFrame([(e, p, t) for e, files in episodes.items() for p, t in files.items()], "episode_id string, path string, text string")


def test_commits_by_content(spark, tmp_path):
    store = str(tmp_path / "store")
    assert rows(content.commit(store, state(spark, e=TREE, o=TREE), 0), "episode_id", "step") == [("e", 0), ("o", 0)]
    n = lambda name: content.held(spark, store, name).count()
    before = [n(t) for t in content.TABLES]
    assert before == [4, 9, 2]  # two episodes with equal trees share all texts and folders
    assert content.commit(store, state(spark, e=TREE, o=TREE), 1).count() == 0 and [n(t) for t in content.TABLES] == before
    edited = {**TREE, "p/q/c.py": "y\nw\n", "p/new.py": None}
    del edited["a.py"]
    assert rows(content.commit(store, state(spark, e=edited, o=TREE), 2), "episode_id", "step") == [("e", 2)]
    assert n("texts") == 6 and content.held(spark, store, "commits").where("step = 2").first()["parent"] == 0
    assert rows(content.files_at(spark, store, 0), "episode_id", "path", "text") == sorted(((e, p, t) for e in "eo" for p, t in TREE.items()), key=str)
    assert rows(content.files_at(spark, store, 9).where("episode_id = 'e'"), "path", "text") == sorted(((p, t or "") for p, t in edited.items()), key=str)
    diff = content.commit_diff(spark, store, 0, 2)
    assert rows(diff, "episode_id", "path", "change", "added", "removed") == [("e", "a.py", "removed", 0, 2), ("e", "p/new.py", "added", 0, 0), ("e", "p/q/c.py", "edited", 1, 0)]
    assert diff.where("path = 'p/q/c.py'").first()["diff"] == "--- a\n+++ b\n@@ -1 +1,2 @@\n y\n+w\n"
    assert rows(content.changed_entries(spark, store, 0, 2)[1], "episode_id", "prefix") == [("e", ""), ("e", "p"), ("e", "p/q")]  # r and o aren't opened
    assert rows(content.commit_diff(spark, store, 0, 2, only=["p/q"]), "path") == [("p/q/c.py",)]
    assert content.commit_diff(spark, store, 2, 2).count() == 0


def test_two_reads_of_a_store_in_one_plan(spark, tmp_path):
    store = str(tmp_path / "store")
    content.commit(store, state(spark, e=TREE), 0)
    first = content.files_at(spark, store, 5)
    content.commit(store, state(spark, e={"z.py": "new"}), 1)
    assert first.unionByName(content.files_at(spark, store, 5)).count() == 5


def test_facts_by_content(spark, tmp_path, monkeypatch):
    """Of three snapshots of which a tenth changes a tenth is parsed anew, and the table is that of a parse of all."""
    parsed, real = [], astfacts.ast_nodes
    monkeypatch.setattr(astfacts, "ast_nodes", lambda f: parsed.append(f.count()) or real(f))
    body = lambda a, v: f'"""M."""\n\n\nclass C:\n    def f(self, x):\n        return x + {a} + {v}\n'
    for step in range(3):
        files = spark.createDataFrame([(f"p{a}/m.py", body(a, step if a == step else 0)) for a in range(10)] + [("copy.py", body(0, 0)), ("empty.py", None)], "path string, text string")
        got = content.known_nodes(files, str(tmp_path / "facts"))
        assert got.columns == list(astfacts.COLUMNS)
        columns = [F.col(c).cast("string") for c in astfacts.COLUMNS]
        assert rows(got, *columns) == rows(real(files), *columns)
    assert parsed == [11, 1, 1]


def test_parse_is_dealt_to_all_cores(spark):
    files = spark.range(40).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.concat(F.lit("x = "), "id").alias("text")).coalesce(1)
    used = astfacts.ast_nodes(files).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= spark.sparkContext.defaultParallelism


def test_invariants_of_episodes(spark):
    rules = spark.createDataFrame([("e", 1, "no_edit", "tests/x.py", None, "m"), ("o", 2, "no_edit", "tests/x.py", None, "m"), ("o", 3, "file_exists", "a.py", None, "m"), ("e", 4, "symbol_present", "a.py", "f", "m"), ("e", 5, "no_edit", "x.p", None, "m"), ("e", 6, "no_edit", "x.py", None, "m")], "episode_id string, seq int, type string, path string, symbol string, message string")
    files, defs = spark.createDataFrame([("e", "a.py")], "episode_id string, path string"), spark.createDataFrame([("e", "a.py", "f")], "episode_id string, path string, name string")
    lines = spark.createDataFrame([("e", "+++ b/src/tests/x.py\t2024"), ("e", "--- /dev/null"), ("o", "+ +++ b/tests/x.py")], "episode_id string, line string")
    assert rows(grading.invariants_broken(rules, files, defs, lines), "seq") == [(1,), (3,), (5,), (6,)]


def test_unknown_graders_are_told(spark):
    specs = spark.createDataFrame([("lint", 1.0), ("lnit", 1.0)], "grader_id string, weight double")
    assert rows(grading.unknown_graders(specs), "grader_id", "warning") == [("lnit", "unknown grader 'lnit' is left out")]


START = datetime(2024, 1, 1)


def event(key, seq, hours, kind, path="a.py", paths=None, query=None, a=None, b=None):
    return (key, seq, START + timedelta(hours=hours), kind, path, paths, query, a, b)


def played(spark, tmp_path, batches, **options):
    for batch in batches:
        spark.createDataFrame(batch, actions.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(actions.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with actions.state_store(spark):
        out, dropped = actions.run_to_end(actions.episode_stream(stream, **options), str(tmp_path / "run"))
        return {(r["episode_id"], r["seq"], r["run"]): r for r in out.collect()}, dropped


def test_contexts_are_carried_over_micro_batches(spark, tmp_path):
    got, dropped = played(spark, tmp_path, [
        [event("e", 0, 0, "view_file"), event("e", 1, 1, "reset", "root.py"), event("e", 2, 2, "list_directory", "src"), event("e", 3, 3, "view_file", "b.py", a=3, b=9)],
        [event("e", 4, 4, "search_codebase", query="q"), event("e", 5, 5, "git_diff"), event("e", 6, 6, "edit_files", paths=[]), event("e", 7, 7, "edit_files", paths=["c.py", "d.py"])],
        [event("e", 8, 8, "edit_file", "c.py"), event("e", 9, 9, "run_shell"), event("e", 10, 10, "apply_patch"), event("e", 11, 11, "submit"), event("e", 12, 12, "view_file")],
        [event("e", 13, 13, "reset", "root.py"), event("e", 14, 14, "view_file", "z.py")]])
    seen = {seq: (r["step"], r["tree"], r["shows"], r["active_file"], r["line_start"], r["edits"], r["graded"], r["files_edited"], r["done"]) for (_, seq, _), r in got.items()}
    assert seen == {
        1: (0, ".", "file:root.py", "root.py", None, 0, False, 0, False), 2: (1, "src", "file:root.py", "root.py", None, 0, False, 0, False), 3: (2, "src", "file:b.py", "b.py", 3, 0, False, 0, False),
        4: (3, "src", "search:q", None, None, 0, False, 0, False), 5: (4, "src", "search:q", None, None, 0, False, 0, False), 6: (5, "src", "search:q", None, None, 1, True, 0, False),
        7: (6, "src", "file:d.py", "d.py", None, 2, True, 2, False), 8: (7, "src", "file:c.py", "c.py", None, 3, True, 2, False), 9: (8, "src", "file:c.py", "c.py", None, 3, False, 2, False),
        11: (9, "src", "file:c.py", "c.py", None, 3, False, 2, True), 13: (0, ".", "file:root.py", "root.py", None, 0, False, 0, False), 14: (1, ".", "file:z.py", "z.py", None, 0, False, 0, False),
    }
    assert got["e", 11, 1]["recent"] == "git_diff,edit_files,edit_files,edit_file,run_shell,submit" and dropped == 0
    with actions.state_store(spark):
        at = {b: actions.state_table(spark, str(tmp_path / "run/state"), "episode", b).first()["value"] for b in (0, 1, 3)}
        edited = rows(actions.state_table(spark, str(tmp_path / "run/state"), "edited", 1), "*")
    assert (at[0]["step"], at[1]["step"], at[3]["run"], at[3]["step"]) == (2, 6, 2, 1) and len(edited) == 2 and spark.conf.get("spark.sql.streaming.stateStore.providerClass") != actions.PROVIDER


def test_idle_episodes_end_by_a_timer(spark, tmp_path):
    """A timer ends what nothing comes to any more, an event that comes too late finds its episode ended, and late rows are dropped."""
    got, dropped = played(spark, tmp_path, [
        [event("idle", 1, 0, "reset"), event("idle", 2, 1, "view_file"), event("back", 3, 0, "reset"), event("live", 4, 0, "reset")],
        [event("live", 5, 9, "view_file"), event("back", 6, 12, "view_file"), event("late", 7, 9, "reset")],
        [event("live", 8, 18, "edit_file")],
        [event("late", 9, 2, "view_file"), event("live", 10, 27, "submit")]], late="3 hours", idle_hours=10.0)
    assert {k: (r["action_type"], r["step"], r["done"]) for k, r in got.items() if k[0] != "live"} == {
        ("idle", 1, 1): ("reset", 0, False), ("idle", 2, 1): ("view_file", 1, False), ("idle", None, 1): ("idle", 1, True), ("back", 3, 1): ("reset", 0, False), ("back", None, 1): ("idle", 0, True), ("late", 7, 1): ("reset", 0, False), ("late", None, 1): ("idle", 0, True),
    }
    assert dropped == 1 and [got["live", s, 1]["step"] for s in (4, 5, 8, 10)] == [0, 1, 2, 3]


def test_late_rows_join_no_session(spark, tmp_path):
    batches = [[("e", 1, 0), ("e", 2, 1)], [("e", 3, 30), ("o", 4, 30)], [("o", 6, 31)], [("e", 5, 1.5), ("e", 7, 90)]]
    for batch in batches:
        spark.createDataFrame([(k, s, START + timedelta(hours=h)) for k, s, h in batch], "episode_id string, seq long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("episode_id string, seq long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, dropped = actions.run_to_end(actions.sessions(stream, "2 hours", "4 hours"), str(tmp_path / "run"))
    assert rows(out, "episode_id", "events", "last_seq") == [("e", 1, 3), ("e", 2, 2), ("o", 2, 6)] and dropped == 1


def test_dealt_keeps_the_order(spark, tmp_path):
    events = spark.range(100).select(F.col("id").alias("seq"))
    path = actions.dealt(events, "seq", 4, str(tmp_path / "in"))
    assert spark.read.parquet(path).count() == 100
    actions.dealt(events.limit(0), "seq", 4, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_streams_of_the_queries_have_several_micro_batches(spark, sf):
    folder = changes._store(spark, "stream-test")
    with actions.state_store(spark):
        out, _ = actions.run_to_end(actions.episode_stream(changes._action_stream(spark, sf, folder)), folder)
        assert out.select("batch").distinct().count() >= 4


@pytest.fixture
def tree(tmp_path):
    files = {"top.py": "t", "notes.txt": "n", ".gitignore": "*.gen.py\nskip/\n# x\n!top.py\n", "pkg/a.py": "a", "pkg/b.gen.py": "b", "pkg/.gitignore": "only_here.py\n", "pkg/only_here.py": "o", "pkg/sub/only_here.py": "o", "lib/only_here.py": "kept", "pkg/sub/c.py": "\xe9", "skip/d.py": "d", "lib/x_pb2.py": "p", "lib/__pycache__/e.py": "e", "lib/extra/f.py": "f"}
    for path, held in files.items():
        (tmp_path / "repo" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / path).write_bytes(held.encode("latin-1"))
    return tmp_path


@pytest.mark.parametrize("levels", ["0", "1", "2", "5"])
def test_repository_source(spark, tree, levels):
    repository.register(spark)
    df = spark.read.format("repository").option("path", str(tree / "repo")).option("levels", levels).option("exclude", "extra").load()
    assert rows(df, "path", "text", "size_bytes") == [("lib/only_here.py", "kept", 4), ("pkg/a.py", "a", 1), ("pkg/sub/c.py", "�", 1), ("top.py", "t", 1)]


def test_repository_source_opens_what_a_filter_wants(spark, tree, monkeypatch):
    repository.register(spark)
    df = spark.read.format("repository").option("path", str(tree / "repo")).load()
    assert rows(df.where("path = 'pkg/a.py'"), "text") == [("a",)]
    assert rows(df.where("path LIKE 'lib/%' AND size_bytes > 1"), "path") == [("lib/only_here.py",)]
    assert rows(df.where(F.col("path").isin("top.py", "pkg/sub/c.py", "none.py")), "path") == [("pkg/sub/c.py",), ("top.py",)]
    assert rows(df.where("path = 'top.py' AND path LIKE 'lib/%'"), "path") == []
    opened, real = [], repository.Tree.bytes_of
    monkeypatch.setattr(repository.Tree, "bytes_of", lambda self, path: opened.append(path) or real(self, path))
    reader = repository.RepositoryReader(repository.Tree(str(tree / "repo"), "*.py", ()), 1)
    left = list(reader.pushFilters([repository.StringStartsWith(("path",), "lib/"), repository.EqualTo(("size_bytes",), 4)]))
    assert [f.attribute for f in left] == [("size_bytes",)] and [p.path for p in reader.partitions()] == ["", "lib"]
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 2 and {x for x in opened if x.endswith(".py")} == {"lib/only_here.py", "lib/extra/f.py"}


def test_scenarios_are_rows(spark, tmp_path):
    repository.register(spark)
    for name, held in {"easy": "slug: lint\nname: Lint\nmax_steps: 15\ngraders: {lint: 0.7, coverage: {weight: 0.3, target_coverage: 0.8}}\ninvariants:\n- {type: no_edit, path: tests/}\ntest_paths: [tests]\n", "bare": "", "bad": "graders: [1]\n", "worse": "a: b: c\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "scenario.yaml").write_text(held)
    (tmp_path / "none").mkdir()
    got = {r["path"].split("/")[0]: r for r in spark.read.format("scenarios").option("path", str(tmp_path)).load().collect()}
    assert set(got) == {"easy", "bare", "bad", "worse"}
    e = got["easy"]
    assert (e["slug"], e["max_steps"], e["language"], e["invariants"], e["test_paths"], e["error"]) == ("lint", 15, "python", [{"type": "no_edit", "path": "tests/"}], ["tests"], None)
    assert {k: tuple(v) for k, v in e["graders"].items()} == {"lint": (0.7, None), "coverage": (0.3, 0.8)}
    assert (got["bare"]["slug"], got["bare"]["max_steps"], got["bare"]["error"]) == ("bare", 20, None) and got["bad"]["error"] == "graders must be a dict" and got["worse"]["error"]


def test_table_functions(spark):
    tables.register(spark)
    files = spark.createDataFrame([("a.py", "def f(x):\n    return x\n", 7), ("b.py", "def broken(:", 8), ("c.py", None, 9)], "path string, text string, size int")
    files.createOrReplaceTempView("some_files")
    columns = [F.col(c).cast("string") for c in astfacts.COLUMNS]
    got = spark.sql("SELECT * FROM ast_facts(TABLE(some_files) PARTITION BY path)")
    assert got.columns == [*astfacts.COLUMNS, "file_size"] and rows(got, *columns) == rows(astfacts.ast_nodes(files), *columns)
    spark.createDataFrame([("e", 2, 4, None), ("e", 1, 8, 2.0), ("o", 1, 0, 1.0), ("e", 3, 16, 1.0)], "episode_id string, step int, n int, w double").createOrReplaceTempView("some_metrics")
    assert rows(spark.sql("SELECT * FROM delta_scores(TABLE(some_metrics))"), "*") == [("e", 1, 0.0, 0.0), ("e", 2, 0.5, None), ("e", 3, 0.0, 0.5), ("o", 1, 1.0, 0.0)]
    with pytest.raises(Exception, match="lacks text"):
        spark.sql("SELECT * FROM ast_facts(TABLE(SELECT 'a' AS path))")
