"""Work that grows with the tables and not faster."""

import random

from pyspark.sql import functions as F

from quarrylens.operators import grading, graph


def test_more_rules_than_a_join_of_all_with_all_takes(spark):
    """12,000 rules without an episode_id; every third path stands in a header, the empty one in each, a null one in none."""
    ids = spark.range(12_000)
    rules = ids.select(*_rule(F.col("id"), F.concat(F.lit("mod_"), "id", F.lit(".py"))))
    rules = rules.unionByName(spark.range(1).select(*_rule(F.lit(-1), F.lit("")))).unionByName(spark.range(1).select(*_rule(F.lit(-2), F.lit(None).cast("string"))))
    headers = ids.where("id % 3 = 0").select(F.concat(F.lit("+++ b/pkg/mod_"), "id", F.lit(".py")).alias("line"))
    files, defs = spark.createDataFrame([("a.py",)], "path string"), spark.createDataFrame([("a.py", "f")], "path string, name string")
    got = {r[0] for r in grading.invariants_broken(rules, files, defs, headers).select("seq").collect()}
    assert got == {-1, *range(0, 12_000, 3)}


def _rule(seq, path):
    return seq.cast("long").alias("seq"), F.lit("no_edit").alias("type"), path.alias("path"), F.lit("").alias("symbol"), F.lit("m").alias("message")


def _components(edges):
    """Python's own: node -> the set of nodes that it reaches and that reach it."""
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)

    def reach(start, way):
        seen, stack = {start}, [start]
        while stack:
            for x in way.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return seen

    return reach, out, into


def test_long_paths_and_cycles(spark):
    """Paths of 300 nodes, cycles of 200 joined by single edges, a tail, loops and a random part. Rounds of steps alone would take 75 and more."""
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 200) for i in range(200)] + [(2000 + i, 2000 + (i + 1) % 200) for i in range(200)]
    edges += [(250, 1007), (1050, 2003), (300, 300), (2100, 3000), (3000, 3001), (3001, 3000), (3001, 3001)] + [(4000 + rnd.randrange(60), 4000 + rnd.randrange(60)) for _ in range(110)] + [(4000, 1000)]
    table = spark.createDataFrame(edges, "src long, dst long")
    reach, out, into = _components(edges)
    walks, real = [], graph._walked
    graph._walked = lambda steps, start, *a, **k: walks.append(steps.count()) or real(steps, start, *a, **k)
    try:
        got = [r[0] for r in graph.reachable(table, spark.createDataFrame([(0,), (77777,)], "node long")).collect()]
    finally:
        graph._walked = real
    assert sorted(got) == sorted(reach(0, out) | {77777})
    assert walks[1] <= 60  # what is left to walk along
    both = {n: reach(n, out) & reach(n, into) for n in set(out) | set(into)}
    assert {tuple(r) for r in graph.cycles(table).collect()} == {(n, min(c), len(c)) for n, c in both.items() if len(c) > 1}


def test_intervals_across_blocks(spark):
    """Intervals that begin, end and stand around blocks of numbers, negative ones too, against all pairs."""
    b = 2**graph.BLOCK
    rnd = random.Random(5)
    ends = [k * b + x for k in (-2, -1, 0, 1, 2, 700) for x in (-1, 0, 1)]
    spans = [(lo, lo + n) for lo in ends for n in (0, 1, b - 1, b, 3 * b)] + [(-5 * b, 900 * b)] + [(x := rnd.randrange(-3 * b, 3 * b), x + rnd.randrange(4 * b)) for _ in range(60)]
    points = [*ends, *(rnd.randrange(-6 * b, 6 * b) for _ in range(200)), 901 * b]
    got = graph.innermost(spark.createDataFrame([(p,) for p in points], "point long"), spark.createDataFrame(spans, "lo long, hi long"))
    want = {p: min(held, key=lambda s: (s[1] - s[0], s[0])) for p in points if (held := [s for s in spans if s[0] <= p <= s[1]])}
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_snapshots_are_measured_once(spark, sf):
    """Rules are held against lines and signals gathered from nodes once a query, not once for each thing that is asked of them."""
    from quarrylens.plans import generated

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(generated.grade_style(spark, sf)).count("posexplode(") == 1
    assert plan(generated.grade_complexity(spark, sf)).count("explode(arrays_zip(") == 1


def test_one_row_of_metrics_for_all_files(spark):
    """Without a key there is one row, of no files too."""
    from quarrylens.operators import astfacts, complexity, lines, style

    files = spark.createDataFrame([("a.py", "def f(x):\n    for y in x:\n        for z in y:\n            print(z)\n\n\ndef Bad(x):\n    for y in x:\n        print(y)\n")], "path string, text string")
    n = astfacts.ast_nodes(files)
    got = style.style_metrics(n, lines.source_lines(files)).first()
    assert [(d["dimension"], round(d["score"], 3)) for d in got["dims"]] == [("naming", 0.667), ("docstrings", 0.0), ("imports", 1.0), ("type_hints", 0.0), ("complexity", 1.0), ("formatting", 1.0)]
    assert (got["raw_score"], got["violations"], got["rules"][0]["rule"]) == (0.55, 8, "D001")
    none = style.style_metrics(n.limit(0), lines.source_lines(files.limit(0))).first()
    assert (none["raw_score"], none["violations"], none["dims"], none["rules"]) == (1.0, 0, [], [])
    big = complexity.bigo_metrics(complexity.repository_estimates(n)).first()
    assert (big["bigO_cost_sum"], big["n"], big["patterns"]) == (3.0, 2, ["2_nested_loops → O(n²)", "single_loop → O(n)"])
    assert tuple(complexity.bigo_metrics(complexity.repository_estimates(n.limit(0))).first()) == (0.0, 0, [])


def test_few_jobs_for_cycles(spark):
    """Trees, which stand one below the other 40 deep and more, and cycles without a way in go in few jobs, a few for each doubling of their depth; taking
    nodes that aren't neighbours out of the graph round by round took 353."""
    n = 9000
    ids = spark.range(n).select(F.col("id").alias("src"))
    table = ids.select("src", ((F.col("src") * 17 + 3) % n).alias("dst")).unionByName(ids.where("src % 5 = 0").select("src", ((F.col("src") * 5 + 1) % n).alias("dst")))
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    found = graph.cycles(table)
    assert jobs() - before <= 150
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len({r[0] for r in rows})
    sizes = {}
    for _, cycle, size in rows:
        sizes.setdefault(cycle, []).append(size)
    assert all(len(x) == x[0] for x in sizes.values()) and {c for _, c, _ in rows} <= {r[0] for r in rows}
