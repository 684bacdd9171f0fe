"""Queries on what changes from one state of a repository to the next: edits, graphs, snapshots, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylens.operators import astfacts, content, grading, graph, measures, patches, sinks, symbols
from quarrylens.plans import generated
from quarrylens.plans.registry import query, table
from quarrylens.session import shared_folder
from quarrylens.streaming import actions

#: Lines that look like the marks of a diff: what stands before a line follows from its document and place.
MARKS = ("-- ", "++ ", "@@ -1 +1 @@ ", "- ", "+")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, i, [{", ".join(f"'{x}'" for x in MARKS)}][1 + (doc_id + i) % {len(MARKS)}] || line AS line FROM l),
    n AS (SELECT doc_id, i, CASE WHEN (doc_id + i) % 11 = 5 THEN line || '!' ELSE line END || CASE WHEN (doc_id + i) % 13 = 1 THEN chr(10) || '--- new' ELSE '' END AS line FROM m WHERE (doc_id + i) % 7 <> 3)
    SELECT d.doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS edited_sha256 FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""")
def diff_roundtrip(spark, sf):
    """Documents whose lines look like marks of a diff, edited; the diff of both, applied to the first, gives the second."""
    place = lambda i: F.col("doc_id") + i
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), F.concat(F.element_at(F.array(*map(F.lit, MARKS)), (place(i) % len(MARKS) + 1).cast("int")), x).alias("x"))).alias("l"))
    kept = F.filter("l", lambda r: place(r["i"]) % 7 != 3)
    edited = F.transform(kept, lambda r: F.concat(r["x"], F.when(place(r["i"]) % 11 == 5, "!").otherwise(""), F.when(place(r["i"]) % 13 == 1, "\n--- new").otherwise("")))
    both = docs.select("doc_id", F.array_join(F.transform("l", lambda r: r["x"]), "\n").alias("old"), F.array_join(edited, "\n").alias("new"))
    diffs = both.withColumn("diff", patches.line_changes("old", "new")["diff"])
    return diffs.select("doc_id", F.sha2(patches.patched("old", "diff"), 256).alias("edited_sha256"))


@query("SELECT 'm' || s_suppkey || '.py' AS path, count(*) OVER (PARTITION BY s_suppkey % 4) AS n FROM supplier QUALIFY count(*) OVER (PARTITION BY s_suppkey % 4) > 1")
def clones_by_annotation(spark, sf):
    """Functions that differ in the annotation of an argument alone, and in names and numbers: the first makes another shape."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ["a", "a: int", "a: str", "a: 'x'"])), (k % 4 + 1).cast("int"))
    body = F.concat(F.lit("def same("), F.when(k % 3 == 0, F.regexp_replace(kind, "^a", "b")).otherwise(kind), F.lit("):\n    c = "), k, F.lit("\n    return c + "), F.when(k % 3 == 0, "b").otherwise("a"), F.lit("\n"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("path"), body.alias("text"))
    return symbols.clone_members(astfacts.ast_nodes(files)).select("path", "n")


#: Every edge of the modules m: what functions load and call, bases, and imports.
ALL_EDGES = """SELECT module AS src, unnest(['os', 'json', 'pkg.mod_' || dep]) AS dst, 'IMPORTS' AS kind, 1 AS n FROM m UNION ALL SELECT module || '.Box' || k, 'Base', 'INHERITS', 1 FROM m WHERE cls = 1 UNION ALL SELECT module, 'Base', 'CALLS', 1 FROM m WHERE cls = 1
    UNION ALL SELECT module || '.fill', 'x', 'CALLS', 1 FROM m WHERE cls = 1 UNION ALL SELECT src, dst, 'CALLS', n FROM (SELECT module || '.' || fn AS src, unnest(['a', 'b', 'x', 'y', 'os', 'print', 'int', 'pkg.mod_' || dep || '.work_' || dep]) AS dst,
        unnest([lft + br + (lp > 0)::INT + dead, br + (lp > 0)::INT + calls + 1, (lp > 1)::INT, (lp > 2)::INT, uses, 2 * uses, 3 * typed, 2 * calls]) AS n FROM m) WHERE n > 0"""


@query(f"{generated.WITH} SELECT src, dst, kind, sum(n) AS n FROM ({ALL_EDGES}) GROUP BY ALL")
def all_edges(spark, sf):
    return graph.edges(generated.nodes(spark, sf)).groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


@query(f"{generated.WITH} SELECT dst, count(DISTINCT src) AS callers FROM ({ALL_EDGES}) GROUP BY dst")
def all_callers(spark, sf):
    return graph.callers(graph.edges(generated.nodes(spark, sf)))


#: The modules after an edit: some call their dependency no longer, some do so now, and some are gone.
EDITED = "m AS (SELECT * REPLACE (CASE WHEN k % 15 = 7 THEN 0 WHEN k % 15 = 8 THEN 1 ELSE calls END AS calls) FROM m0 WHERE k % 31 <> 30)"


@query(f"""WITH RECURSIVE {generated.modules_sql().replace(" m AS (", " m0 AS (")}, {EDITED}, e AS ({ALL_EDGES}), r(node) AS (SELECT 'pkg.mod_' || k || '.work_' || k FROM m0 WHERE k % 10 = 7 UNION SELECT dst FROM r JOIN e ON node = src)
    SELECT src AS node, 'edge' AS part, count(DISTINCT dst) AS n FROM e GROUP BY src UNION ALL SELECT node, 'reached', 1 FROM r""")
def incremental_rebuild(spark, sf):
    """The graph of all modules, carried over an edit of some: its edges, and all that the public functions reach."""
    files = generated.files(spark, sf).withColumn("k", F.regexp_extract("path", r"mod_(\d+)", 1).cast("long"))
    k = F.col("k")
    seeds = files.where(k % 10 == 7).select(F.concat(F.lit("pkg.mod_"), "k", F.lit(".work_"), "k").alias("node"))
    call = F.concat(F.lit("    b = work_"), F.floor(k / 2), F.lit("(b)\n"))
    text = F.when(k % 31 == 30, F.lit(None)).when(k % 15 == 7, F.replace("text", call, F.lit(""))).otherwise(F.replace("text", F.lit("    return b\n"), F.concat(call, F.lit("    return b\n"))))
    edited = files.where((k % 31 == 30) | (k % 15 == 7) | (k % 15 == 8)).select("path", text.alias("text"))
    now = graph.rebuilt(graph.built(generated.nodes(spark, sf), seeds), edited)
    each = now.edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("n"))
    return each.select("node", F.lit("edge").alias("part"), "n").unionByName(now.reach.select("node", F.lit("reached").alias("part"), F.lit(1).cast("long").alias("n")))


#: The events as actions of episodes, one a user: all eight kinds, and resets.
ACTIONS = {
    "episode_id": "CAST(user_id AS STRING)", "seq": "event_id", "at": "ts",
    "action_type": "CASE event_type WHEN 'signup' THEN 'reset' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'view_file' ELSE 'list_directory' END WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'search_codebase' ELSE 'git_diff' END WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'edit_file' ELSE 'edit_files' END ELSE CASE WHEN event_id % 2 = 0 THEN 'submit' ELSE 'run_shell' END END",
    "path": "CASE WHEN event_type = 'view' AND event_id % 2 = 1 THEN concat('dir', event_id % 3) ELSE concat('f', event_id % 5) END",
    "paths": "CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN {empty} ELSE {two} END END", "query": "concat('q', event_id % 4)",
    "line_start": "CASE WHEN event_id % 4 = 0 THEN event_id % 7 + 1 END", "line_end": "CASE WHEN event_id % 4 = 0 THEN event_id % 7 + 20 END",
}
_DUCK, _SPARK = {"empty": "[]::VARCHAR[]", "two": "['g1', concat('f', event_id % 5)]"}, {"empty": "CAST(array() AS array<string>)", "two": "array('g1', concat('f', event_id % 5))"}


def _action_stream(spark, sf, folder):
    events = table(spark, sf, "events").selectExpr(*(f"{e.format(**_SPARK) if n == 'paths' else e} AS {n}" for n, e in ACTIONS.items()))
    return spark.readStream.schema(actions.EVENTS).option("maxFilesPerTrigger", 1).parquet(actions.dealt(events, "seq", 4, f"{folder}/in"))


def _episode_sql(of: str = "TRUE", mark: str = "(SELECT max(tm) FROM a)") -> str:
    """live: actions that count, with the run's number, step and context, of those events that fit of; idle: runs that
    ended because nothing came. mark: the latest time of events that the last micro-batch has seen before it."""
    shows = "CASE WHEN action_type IN ('reset', 'view_file', 'edit_file') THEN 'file:' || path WHEN action_type = 'edit_files' AND len(paths) > 0 THEN 'file:' || paths[-1] WHEN action_type = 'search_codebase' THEN 'search:' || query END"
    run = "PARTITION BY episode_id, run ORDER BY seq"
    return f"""a AS (SELECT {", ".join(f"{e.format(**_DUCK) if n == 'paths' else e} AS {'tm' if n == 'at' else n}" for n, e in ACTIONS.items())} FROM events), o AS (SELECT * FROM a WHERE {of}),
        r AS (SELECT *, count(*) FILTER (action_type = 'reset') OVER (PARTITION BY episode_id ORDER BY seq) AS run, lead(tm) OVER (PARTITION BY episode_id ORDER BY seq) AS after FROM o),
        g AS (SELECT *, coalesce(tm > lag(tm) OVER ({run}) + INTERVAL 72 HOUR, false) AS gap, coalesce(lag(action_type) OVER ({run}) = 'submit', false) AS closed, {shows} AS shown FROM r WHERE run > 0),
        live AS (SELECT *, count(*) FILTER (action_type <> 'reset') OVER ({run}) AS step, count(*) FILTER (action_type LIKE 'edit_%') OVER ({run}) AS edits, action_type LIKE 'edit_%' AS graded, action_type = 'submit' AS done,
                last_value(CASE action_type WHEN 'reset' THEN '.' WHEN 'list_directory' THEN path END IGNORE NULLS) OVER ({run}) AS tree, last_value(CASE WHEN shown IS NOT NULL THEN {{'s': shown, 'a': CASE WHEN action_type = 'view_file' THEN line_start END, 'b': CASE WHEN action_type = 'view_file' THEN line_end END}} END IGNORE NULLS) OVER ({run}) AS c,
                len(list_distinct(flatten(list(CASE action_type WHEN 'edit_file' THEN [path] WHEN 'edit_files' THEN paths ELSE [] END) OVER ({run})))) AS files_edited,
                list(action_type) OVER ({run} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS six, row_number() OVER (PARTITION BY episode_id, run ORDER BY seq DESC) = 1 AS last
            FROM (SELECT *, bool_or(gap OR closed) OVER ({run}) AS ended FROM g) WHERE NOT ended),
        idle AS (SELECT * FROM live WHERE last AND action_type <> 'submit' AND (after > tm + INTERVAL 72 HOUR OR after IS NULL AND epoch_ms(tm) + 72 * 3600000 <= epoch_ms({mark}) - 24 * 3600000))"""


_SHOWN = "tree, CASE WHEN c.s LIKE 'file:%' THEN c.s[6:] END AS active_file, c.s AS shows, c.a::BIGINT AS line_start, c.b::BIGINT AS line_end, files_edited::BIGINT AS files_edited, coalesce(array_to_string(list_filter(six, lambda x: x <> 'reset'), ','), '') AS recent"


@query(f"WITH {_episode_sql()} SELECT episode_id, seq, run, step, action_type, edits, graded, done, {_SHOWN} FROM live UNION ALL SELECT episode_id, NULL, run, step, 'idle', edits, false, true, {_SHOWN} FROM idle")
def episode_actions_stream(spark, sf):
    """Four micro-batches of actions with typed state, a timer for episodes on which nothing comes, and one batch more in which it rings."""
    folder = f"{shared_folder(spark)}/actions-{uuid.uuid4().hex[:12]}"
    with actions.state_store(spark):
        return actions.run_to_end(actions.episode_stream(_action_stream(spark, sf, folder)), folder)[0].drop("batch")


_PARTS = "(SELECT min(event_id) + (max(event_id) - min(event_id)) * {0}::DOUBLE FROM events)"


@query(f"""WITH {_episode_sql("seq <= " + _PARTS.format(0.5), "(SELECT max(tm) FROM a WHERE seq <= " + _PARTS.format(0.25) + ")")}, last AS (SELECT * FROM live WHERE last QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY run DESC) = 1)
    SELECT u.episode_id, coalesce(l.run, 0) AS run, coalesce(l.step, 0) AS step, coalesce(l.edits, 0) AS edits, l.run IS NULL OR l.action_type = 'submit' OR i.run IS NOT NULL OR coalesce(l.ended_since, false) AS done
    FROM (SELECT DISTINCT episode_id FROM o) u LEFT JOIN (SELECT *, after > tm + INTERVAL 72 HOUR AS ended_since FROM last) l ON l.episode_id = u.episode_id LEFT JOIN idle i ON i.episode_id = l.episode_id AND i.run = l.run""")
def episode_state_at(spark, sf):
    """The state of each episode as it stood after the second of four micro-batches, read from the checkpoint after the last."""
    folder = f"{shared_folder(spark)}/actions-{uuid.uuid4().hex[:12]}"
    with actions.state_store(spark):
        actions.run_to_end(actions.episode_stream(_action_stream(spark, sf, folder)), folder)
        held = actions.state_table(spark, f"{folder}/state", "episode", 1)
        return spark.createDataFrame(held.select(F.col("key.episode_id").alias("episode_id"), "value.run", "value.step", "value.edits", "value.done").toArrow())  # read while the store is set


@query("""WITH e AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR, true) AS new FROM events), s AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
    SELECT user_id::VARCHAR AS episode_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events, max(event_id) AS last_seq FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def event_sessions(spark, sf):
    """Stretches of a user's events without a gap of six hours that are over when the last event has come, from four micro-batches."""
    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex[:12]}"
    return actions.run_to_end(actions.sessions(_action_stream(spark, sf, folder)), folder)[0].drop("batch")


def _store(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _committed(spark, sf):
    """A store with three snapshots of each nation's modules, and a fourth that is the third again."""
    store, texts = _store(spark, "commits"), generated.snapshots(spark, sf)[0]
    for step in range(4):
        content.commit(store, texts.where(F.col("step") == min(step, 2)).select("episode_id", "path", "text"), step)
    return store


@query(f"""WITH {generated.modules_sql("0")} SELECT episode_id, path, 'edited' AS change, (k % 2)::INTEGER AS added, CASE WHEN k % 6 = 0 THEN 2 ELSE 1 END AS removed FROM m WHERE k % 6 = 0 OR k % 2 = 1""")
def commit_diff(spark, sf):
    """What --stat says of the first and the last commit of each episode."""
    return content.commit_diff(spark, _committed(spark, sf), 0, 3).select("episode_id", "path", "change", "added", "removed")


@query("SELECT s_nationkey::VARCHAR AS episode_id, unnest(CASE WHEN bool_or(s_suppkey % 2 = 1 OR s_suppkey % 3 = 0) THEN CASE WHEN bool_or(s_suppkey % 3 = 0) THEN [0, 1, 2] ELSE [0, 2] END ELSE [0] END) AS step, count(*) AS files FROM supplier GROUP BY s_nationkey")
def commits_made(spark, sf):
    """The commits of each episode and how many files they have; a state that is that of the commit before makes none."""
    store = _committed(spark, sf)
    made = content.held(spark, store, "commits")
    files = content.files_at(spark, store, 3).groupBy("episode_id").agg(F.count("*").alias("files"))
    return made.join(files, "episode_id").select("episode_id", "step", "files")


@query(f"""WITH {generated.modules_sql("0, 1, 2")} SELECT step, path, fn AS name, module || '.' || fn AS qualified_name, n_body + 1 AS body_line_count FROM m""")
def measured_by_content(spark, sf):
    """Functions of three snapshots, one after the other, where only texts that are new are parsed."""
    store, texts = _store(spark, "facts"), generated.snapshots(spark, sf)[0]
    out = None
    for step in (0, 1, 2):
        n = content.known_nodes(texts.where(F.col("step") == step).select("path", "text"), store)
        f = symbols.function_info(n).where("name <> 'fill'").select(F.lit(step).alias("step"), "path", "name", "qualified_name", "body_line_count")
        out = f if out is None else out.unionByName(f)
    return out


#: Statements of the function of a module, by kind, and windows of three of them with the first of each kind.
_WINDOWS = """c AS (SELECT *, list_concat(CASE WHEN lft = 1 THEN ['L'] ELSE [] END, list_transform(range(br), lambda i: 'I'), CASE WHEN lp > 0 THEN ['F' || lp] ELSE [] END, CASE WHEN uses = 1 THEN ['U'] ELSE [] END, CASE WHEN calls = 1 THEN ['C'] ELSE [] END, ['R'], CASE WHEN dead = 1 THEN ['A'] ELSE [] END) AS s FROM m),
    w AS (SELECT episode_id, step, path, k, unnest(range(1, len(s) - 1)) AS i, s, len(s) AS n FROM c), x AS (SELECT *, s[i] || s[i + 1] || s[i + 2] AS win FROM w),
    f AS (SELECT *, first_value({'path': path, 'i': i}) OVER (PARTITION BY {by} win ORDER BY path, i) AS first FROM x), h AS (SELECT *, first.path <> path AS cross_file, i - row_number() OVER (PARTITION BY episode_id, step, path ORDER BY i) AS run FROM f WHERE first.path <> path OR i - first.i >= 3),
    runs AS (SELECT episode_id, step, path, min(i) AS i, max(i) - min(i) + 3 AS statements, bool_or(cross_file) AS cross_file FROM h GROUP BY episode_id, step, path, run)"""


@query(f"{generated.WITH}, {_WINDOWS.replace('{by}', '')} SELECT path, count(*) AS runs, sum(statements)::BIGINT AS statements, bool_or(cross_file) AS cross_file FROM runs GROUP BY path")
def clone_runs(spark, sf):
    runs = symbols.clone_runs(generated.nodes(spark, sf))
    return runs.groupBy("path").agg(F.count("*").alias("runs"), F.sum("statements").cast("long").alias("statements"), F.max("cross_file").alias("cross_file"))


@query(f"""{generated.STEPS}, {_WINDOWS.replace('{by}', 'episode_id, step,')}, dup AS (SELECT episode_id, step, count(r.path) AS n, coalesce(round(sum(CASE WHEN cross_file THEN 1.2 WHEN NOT cross_file THEN 1.0 END), 3), 0)::DOUBLE AS w, count(*) FILTER (cross_file) AS x FROM (SELECT DISTINCT episode_id, step FROM m) LEFT JOIN runs r USING (episode_id, step) GROUP BY ALL),
    b AS (SELECT *, first_value(n) OVER (PARTITION BY episode_id ORDER BY step) AS bn, first_value(w) OVER (PARTITION BY episode_id ORDER BY step) AS bw FROM dup), s AS (SELECT *, CASE WHEN bw <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (bw - w) / bw)) END AS score FROM b)
    SELECT episode_id, step, score, greatest(0, n - bn)::DOUBLE AS added, '[Duplication] ' || bn || ' → ' || n || ' duplicate block(s), ' || x || ' across files. Score: ' || printf('%.0f', score * 100) || '%.' AS said FROM s""")
def grade_duplication(spark, sf):
    m = measures.duplication_measures(generated.snapshots(spark, sf)[1])
    return grading.graded(m, grading.GRADERS["duplication"]).select("episode_id", "step", "score", "added", F.array_join("said", "|").alias("said"))


@query(f"""{generated.WITH}, r AS (SELECT n::VARCHAR AS episode_id, 'a' || i || '.py' AS path, 90 + n * i AS lines FROM (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_nationkey % 5 > 0) CROSS JOIN (VALUES (1), (2)) r(i)),
    e AS (SELECT episode_id, path, false AS is_dir FROM m UNION ALL SELECT episode_id, path, false FROM r UNION ALL SELECT DISTINCT episode_id, folder, true FROM m),
    t AS (SELECT episode_id, string_agg(CASE WHEN is_dir THEN path || '/' ELSE path END, ' ' ORDER BY NOT is_dir, path) AS tree FROM e GROUP BY episode_id)
    SELECT t.episode_id, tree, r.path AS active_file, CASE WHEN lines > 100 THEN 100 ELSE lines END::INTEGER AS line_end, lines::INTEGER AS total_file_lines, CASE WHEN lines IS NOT NULL THEN array_to_string(list_transform(range(least(lines, 100)), lambda i: 'l' || i), chr(10)) END AS file_content, coalesce(u, '') AS untracked
    FROM t LEFT JOIN r ON r.episode_id = t.episode_id AND r.path = 'a1.py' LEFT JOIN (SELECT episode_id, string_agg(path, ' ' ORDER BY path) AS u FROM m WHERE k % 3 = 0 GROUP BY episode_id) s ON s.episode_id = t.episode_id""")
def first_view(spark, sf):
    """What is seen first of each nation's modules: the tree, the first file at the root, of which not all have one, and the status."""
    n = F.col("s_nationkey")
    nations = table(spark, sf, "supplier").select("s_nationkey").distinct().where(n % 5 > 0).select("s_nationkey", F.explode(F.array(F.lit(2), F.lit(1))).alias("i"))
    top = nations.select(n.cast("string").alias("episode_id"), F.concat(F.lit("a"), "i", F.lit(".py")).alias("path"), F.array_join(F.transform(F.sequence(F.lit(0), 89 + n * F.col("i")), lambda j: F.concat(F.lit("l"), j)), "\n").alias("text"))
    files = generated._module_texts(spark, sf).select("episode_id", "path", "text")
    new = files.where(F.regexp_extract("path", r"mod_(\d+)", 1).cast("long") % 3 == 0).select("episode_id", "path", F.lit(False).alias("staged"), F.lit(False).alias("unstaged"), F.lit(True).alias("untracked"))
    v = sinks.first_view(files.unionByName(top), new)
    shown = F.array_join(F.transform("tree", lambda e: F.when(e["is_dir"], F.concat(e["path"], F.lit("/"))).otherwise(e["path"])), " ")
    return v.select("episode_id", shown.alias("tree"), "active_file", "line_end", "total_file_lines", "file_content", F.array_join("untracked", " ").alias("untracked"))
