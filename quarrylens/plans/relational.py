"""Operators as queries over the test tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions import paths, scoring, text
from quarrylens.operators import complexity, grading, graph, lines, records, sinks, style, symbols
from quarrylens.plans.registry import query, table
from quarrylens.session import shared_folder
from quarrylens.sources import code, tools
from quarrylens.streaming import episode
from quarrylens.streaming.actions import dealt

LONG = "length(line) > 80 AND NOT ((starts_with(trim(line), '#') AND contains(line, 'http') AND NOT contains(ltrim(trim(line), '# '), ' ')) OR contains(line, 'pylint:') OR contains(line, 'noqa') OR NOT contains(trim(line), ' '))"
LINES = "SELECT doc_id::VARCHAR AS path, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS lineno, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL"


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.source_lines(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), universal=False)


@query(f"""WITH l AS ({LINES}) SELECT path, count(*) AS n_lines, count(*) FILTER ({LONG}) AS n_long, greatest(0.0, 1 - count(*) FILTER ({LONG}) / count(*)) AS score FROM l GROUP BY path""")
def style_line_scores(spark, sf):
    own = _doc_lines(spark, sf).groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(lines.too_long(F.col("text"))).alias("n_long"))
    return own.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("n_long") / F.col("n_lines")))


@query(f"WITH l AS ({LINES}) SELECT path, lineno AS line, 'len=' || length(line) AS context FROM l WHERE {LONG}")
def line_rule_c002(spark, sf):
    return lines.line_violations(_doc_lines(spark, sf)).where("rule = 'C002'").select("path", "line", "context")


@query("""WITH l AS (SELECT page_id::VARCHAR AS path, generate_subscripts(string_split(html, chr(10)), 1)::INTEGER AS lineno, trim(unnest(string_split(html, chr(10)))) AS s FROM pages)
    SELECT path, lineno AS line, substr(s, 1, 40) AS context FROM l WHERE contains(s, ';') AND NOT starts_with(s, '#') AND contains(regexp_replace(s, '"[^"]*("|$)|''[^'']*(''|$)', '', 'g'), ';')""")
def line_rule_f003(spark, sf):
    files = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    return lines.line_violations(lines.source_lines(files, universal=False)).where("rule = 'F003'").select("path", "line", "context")


@query(f"""WITH l AS ({LINES}), h AS (SELECT path, lineno, row_number() OVER (PARTITION BY path ORDER BY lineno) AS nth FROM l WHERE regexp_matches(line, '(?i)idiot|moron')),
    c AS (SELECT path, unnest(range(lineno - 1, lineno + 2))::INTEGER AS lineno, lineno AS src FROM h WHERE nth <= 2)
    SELECT l.path, l.lineno, bool_or(c.lineno = c.src) AS hit FROM l JOIN c ON c.path = l.path AND c.lineno = l.lineno GROUP BY l.path, l.lineno""")
def grep_context(spark, sf):
    return lines.grep(_doc_lines(spark, sf), r"idiot\|moron", ignore_case=True, context=1, limit=2).select("path", "lineno", "hit")


@query(f"WITH l AS ({LINES}) SELECT path, lineno, length(line) AS n FROM l WHERE lineno BETWEEN 2 AND 4")
def ranged_read(spark, sf):
    return lines.read_lines(_doc_lines(spark, sf), 2, 4).select("path", "lineno", F.length("text").alias("n"))


URLS = "SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages"


def _urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


@query(f"WITH u AS ({URLS}) SELECT page_id, regexp_replace(regexp_replace(path, '[/\\\\]', '.', 'g'), '\\.py$', '') AS module FROM u")
def path_module_name(spark, sf):
    return _urls(spark, sf).select("page_id", symbols.module_of(F.col("path")).alias("module"))


@query(f"""WITH u AS ({URLS}), p AS (SELECT *, string_split(path, '/') AS p FROM u)
    SELECT page_id, regexp_matches(path, '^m\\..*/en/.*$') AS by_glob, len(list_filter(p[1:len(p)-1], lambda x: starts_with(x, 'th'))) > 0 AS by_folder,
        list_has_any(p, ['en', 'fr']) AS by_part FROM p""")
def path_predicates(spark, sf):
    p = F.col("path")
    folders = F.slice(paths.parts(p), F.lit(1), F.size(paths.parts(p)) - 1)
    return _urls(spark, sf).select("page_id", paths.glob_match(p, "m.*/en/*").alias("by_glob"), F.exists(folders, lambda x: x.startswith("th")).alias("by_folder"), paths.excluded(p, ("en", "fr"), ()).alias("by_part"))


@query("""WITH f AS (SELECT DISTINCT regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path FROM pages), p AS (SELECT path, string_split(path, '/') AS p FROM f),
    d AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS i FROM p))
    SELECT path, false AS is_dir FROM f UNION ALL SELECT path, true FROM d""")
def file_tree(spark, sf):
    files = table(spark, sf, "pages").select(F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path")).distinct().withColumn("size_bytes", F.lit(0).cast("long"))
    return code.tree(files).select("path", "is_dir")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unused_anti_join(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("""WITH i AS (SELECT o_orderkey AS lo, o_orderkey + o_custkey % 40 AS hi FROM orders), p AS (SELECT DISTINCT l_orderkey AS point FROM lineitem)
    SELECT point, lo, hi FROM (SELECT point, lo, hi, row_number() OVER (PARTITION BY point ORDER BY hi - lo, lo) AS nth FROM p JOIN i ON point BETWEEN lo AND hi) WHERE nth = 1""")
def innermost_interval_join(spark, sf):
    i = table(spark, sf, "orders").select(F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.pmod("o_custkey", F.lit(40))).alias("hi"))
    return graph.innermost(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("point")), i)


@query("""WITH i AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN o_orderkey - o_orderkey % 4096 ELSE o_orderkey - o_custkey % 7 END AS lo, o_orderkey + CASE WHEN o_custkey % 97 = 0 THEN 1000000 WHEN o_custkey % 5 = 0 THEN o_custkey ELSE o_custkey % 3 END AS hi FROM orders),
    p AS (SELECT DISTINCT l_orderkey * 3 - 1000 AS point FROM lineitem)
    SELECT point, b.lo AS lo, b.hi AS hi FROM (SELECT point, arg_min({'lo': lo, 'hi': hi}, {'span': hi - lo, 'lo': lo}) AS b FROM p JOIN i ON point BETWEEN lo AND hi GROUP BY point)""")
def nested_intervals(spark, sf):
    """Intervals of one number up to a million, nested and crossing, and points of which some are in none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lo = F.when(c % 50 == 0, k - k % 4096).otherwise(k - c % 7)
    hi = k + F.when(c % 97 == 0, 1_000_000).when(c % 5 == 0, c).otherwise(c % 3)
    return graph.innermost(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 3 - 1000).alias("point")), table(spark, sf, "orders").select(lo.alias("lo"), hi.alias("hi")))


@query("SELECT r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def enrich_dimensions(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH f AS (SELECT lang, CASE WHEN length(text) > 500 THEN 1.5 ELSE 0.8 END AS w FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1)
    SELECT round(sum(w), 3) AS weighted_total, count(*) AS raw_count FROM f""")
def first_dedup_weighted(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("kind"), F.col("text").alias("name"), F.lit("d").alias("path"), F.when(F.length("text") > 500, 1.5).otherwise(0.8).alias("weight"), F.lit(0).alias("pass"), F.col("doc_id").alias("seq"))
    return symbols.aggregate_dead(rows).select("weighted_total", "raw_count")


@query("SELECT d.t AS event_type, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('refund')) d(t) LEFT JOIN events ON event_type = d.t GROUP BY d.t")
def zero_filled_dims(spark, sf):
    return style.zero_filled(table(spark, sf, "events"), "event_type", ["click", "error", "purchase", "refund"])


MONTHS = "SELECT o_custkey % 20 AS episode_id, (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS step, count(*) AS violations FROM orders GROUP BY ALL"


def _months(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 20).alias("episode_id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("step")).agg(F.count("*").alias("violations"))


@query(f"""WITH m AS ({MONTHS}), b AS (SELECT *, first_value(violations) OVER (PARTITION BY episode_id ORDER BY step) AS base FROM m)
    SELECT episode_id, step, CASE WHEN base <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (base - violations) / base)) END AS score, greatest(0, violations - base)::DOUBLE AS added FROM b""")
def clamp_delta_score(spark, sf):
    return grading.graded(_months(spark, sf), grading.GRADERS["lint"]).select("episode_id", "step", "score", "added")


@query(f"""WITH m AS ({MONTHS}), b AS (SELECT *, first_value(violations) OVER (PARTITION BY episode_id ORDER BY step) AS base FROM m),
    g AS (SELECT episode_id, step, greatest(0.0, least(1.0, (base - violations) / base)) AS lint, greatest(0, violations - base) AS added FROM b)
    SELECT episode_id, step, printf('%.4f', 0.7 * lint + 0.3 * 0.5)::DOUBLE AS step_score, added > 0 AS is_regression, CASE WHEN added > 0 THEN added::BIGINT::VARCHAR ELSE '' END AS penalties FROM g""")
def weighted_step_score(spark, sf):
    months = _months(spark, sf)
    grades = grading.graded(months, grading.GRADERS["lint"]).unionByName(grading.graded(months, grading.GRADERS["mock"]))
    specs = spark.createDataFrame([("lint", 0.7), ("mock", 0.3)], "grader_id string, weight double")
    out = grading.step_scores(grades, specs)
    return out.select("episode_id", "step", "step_score", "is_regression", F.array_join("penalties", ",").alias("penalties"))  # to three digits: four are rounded from binary values


@query("SELECT l_orderkey, l_linenumber, greatest(0, l_quantity::INTEGER - 10) ** 2 AS cost FROM lineitem ORDER BY cost DESC, l_orderkey, l_linenumber LIMIT 5")
def quadratic_cost_topk(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", complexity.quadratic_cost(F.col("l_quantity").cast("int")).alias("cost"))
    return complexity.top_by(rows, "cost", ["l_orderkey", "l_linenumber"])


@query("SELECT round(sum(greatest(0, l_quantity - 10) ** 2), 2) AS cc_cost_sum, round(avg(l_quantity), 6) AS cc_avg, count(*) AS n FROM lineitem")
def cc_metrics(spark, sf):
    m = complexity.cc_metrics(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("cc")))
    return m.select(F.round("cc_cost_sum", 2).alias("cc_cost_sum"), F.round("cc_avg", 6).alias("cc_avg"), "n")


@query("""SELECT user_id, min(event_id) AS event_id FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE value < seen GROUP BY user_id""")
def running_max_order(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "events").withColumn("seen", F.max("value").over(w)).where("value < seen").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, event_id FROM (SELECT *, coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM events) WHERE dead")
def prefix_terminator(spark, sf):
    dead = symbols.any_before(F.col("event_type") == "purchase", ["user_id"], ["event_id"])
    return table(spark, sf, "events").withColumn("dead", dead).where("dead").select("user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events) WHERE after = 'purchase' AND event_type <> 'view'")
def lead_terminator(spark, sf):
    after = symbols.just_before("event_type", ["user_id"], ["event_id"])
    return table(spark, sf, "events").withColumn("after", after).where("after = 'purchase' AND event_type <> 'view'").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_id, len(b) = 2 AND len(list_filter(b, lambda x: x <> 'click')) = 0 AS looping FROM (SELECT user_id, event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NOT NULL
    UNION ALL SELECT user_id, min(event_id), false FROM events GROUP BY user_id""")
def loop_detect(spark, sf):
    return records.repeated_before(table(spark, sf, "events"), 2, ["user_id"], ["event_id"], "event_type", "click").select("user_id", "event_id", "looping")


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), ',') AS history FROM conversations")
def last6_history(spark, sf):
    return records.last_n(table(spark, sf, "conversations"), 6, ["conv_id"], ["turn"], "role").select("conv_id", "turn", F.array_join("history", ",").alias("history"))


@query("SELECT conv_id, (nth // 3)::INTEGER AS batch, string_agg(role, ',' ORDER BY nth) AS items FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations) GROUP BY conv_id, nth // 3")
def batching(spark, sf):
    return records.batches(table(spark, sf, "conversations"), 3, ["conv_id"], ["turn"], "role").select("conv_id", "batch", F.array_join("items", ",").alias("items"))


EDGES = "SELECT c_custkey AS src, (c_custkey * 17 + 3) % (SELECT count(*) FROM customer) AS dst, 'IMPORTS' AS kind FROM customer UNION ALL SELECT c_custkey, (c_custkey * 5 + 1) % (SELECT count(*) FROM customer), 'CALLS' FROM customer WHERE c_custkey % 5 = 0"


def _edges(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    n = c.count()
    one = c.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 17 + 3) % n).alias("dst"), F.lit("IMPORTS").alias("kind"))
    return one.unionByName(c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 5 + 1) % n).alias("dst"), F.lit("CALLS").alias("kind")))


@query(f"WITH RECURSIVE e AS ({EDGES}), r(node) AS (SELECT 1::BIGINT UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def reachability(spark, sf):
    return graph.reachable(_edges(spark, sf), spark.createDataFrame([(1,)], "node long"))


@query(f"WITH RECURSIVE e AS ({EDGES}), r(node) AS (SELECT 2::BIGINT UNION SELECT dst FROM r JOIN e ON src = node WHERE kind = 'IMPORTS') SELECT node FROM r WHERE node <> 2")
def transitive_imports(spark, sf):
    e = _edges(spark, sf).where("kind = 'IMPORTS'")
    return graph.reachable(e, spark.createDataFrame([(2,)], "node long")).where("node <> 2")


@query(f"""WITH RECURSIVE e AS ({EDGES}),
    r(a, b) AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
    m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)
    SELECT node, cycle, count(*) OVER (PARTITION BY cycle) AS size FROM m""")
def import_cycles(spark, sf):
    return graph.cycles(_edges(spark, sf))


@query(f"WITH e AS ({EDGES}) SELECT dst, count(DISTINCT src) AS callers FROM e GROUP BY dst")
def callers(spark, sf):
    return graph.callers(_edges(spark, sf))


@query(f"WITH e AS ({EDGES}) SELECT src, count(DISTINCT dst) AS fanout FROM e WHERE kind = 'IMPORTS' GROUP BY src")
def module_fanout(spark, sf):
    return graph.fanout(_edges(spark, sf))


@query("SELECT md5(regexp_replace(text, '[0-9]+', '0', 'g')) AS norm_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def clone_hash_groups(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.regexp_replace("text", "[0-9]+", "0")).alias("norm_hash"), "doc_id")
    return d.groupBy("norm_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def _runs(spark, sf):
    k = F.col("o_orderkey")
    body = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), 1 + k % 4), lambda i: F.concat(F.lit('{"code":"E'), i, F.lit('"}'))), ","), F.lit("]"))
    return table(spark, sf, "orders").select(k, F.when(k % 5 == 0, "invalid json").otherwise(body).alias("stdout"), F.when(k % 11 == 0, 2).otherwise(1).alias("return_code"), (k % 13 == 0).alias("timed_out"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'timeout' WHEN o_orderkey % 11 = 0 THEN 'exit' WHEN o_orderkey % 5 = 0 THEN 'json' END AS tool_error,
    CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN 0 ELSE 1 + o_orderkey % 4 END::INTEGER AS violations FROM orders""")
def lint_report_ingest(spark, sf):
    return tools.lint_report(_runs(spark, sf)).select("o_orderkey", "tool_error", "violations")


@query("""SELECT 'f' || (n_nationkey % 3) AS file, n_name AS name, (n_nationkey * 2)::INTEGER AS cc, CASE WHEN n_nationkey % 2 = 0 THEN 'B' ELSE 'A' END AS grade FROM nation""")
def complexity_report_ingest(spark, sf):
    n = table(spark, sf, "nation")
    one = F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") * 2).alias("complexity"), F.when(F.col("n_nationkey") % 2 == 0, "B").alias("rank"))
    per = n.groupBy(F.concat(F.lit("f"), F.col("n_nationkey") % 3).alias("file")).agg(F.to_json(F.collect_list(one)).alias("list"))
    runs = per.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "file", F.lit('":'), "list")), ","), F.lit(',"bad":"x"}')).alias("stdout")).withColumn("return_code", F.lit(0))
    return tools.complexity_report(runs)


@query("""SELECT l_orderkey, l_linenumber, l_linenumber AS passed, (l_partkey % 3)::INTEGER AS failed, 1 AS errors, l_linenumber / (l_linenumber + l_partkey % 3 + 1) AS pass_rate FROM lineitem""")
def regex_counts(spark, sf):
    said = F.concat("l_linenumber", F.lit(" passed, "), F.col("l_partkey") % 3, F.lit(" failed, 1 error in 2s"))
    runs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", said.alias("stdout"), F.lit(None).cast("string").alias("report"))
    return tools.run_counts(runs).select("l_orderkey", "l_linenumber", "passed", "failed", "errors", "pass_rate")


@query("""SELECT p_partkey, round(least(p_size, 40) / 50.0, 4)::DOUBLE AS line_coverage, 0.0 AS branch_coverage FROM part""")
def coverage_report_ingest(spark, sf):
    covered = F.least("p_size", F.lit(40))
    report = F.concat(F.lit('{"totals":{"covered_lines":'), covered, F.lit(',"num_statements":50,"covered_branches":0,"num_branches":0}}'))
    return tools.coverage_totals(table(spark, sf, "part").select("p_partkey", report.alias("report"))).select("p_partkey", "line_coverage", "branch_coverage")


@query("""SELECT 'f' || p_partkey AS file, p_size / 50.0::DOUBLE AS line, 0.5::DOUBLE AS branch FROM part""")
def coverage_files_ingest(spark, sf):
    report = F.concat(F.lit('{"files":{"f'), "p_partkey", F.lit('":{"summary":{"covered_lines":'), "p_size", F.lit(',"num_statements":50,"covered_branches":1,"num_branches":2}}}}'))
    return tools.coverage_files(table(spark, sf, "part").select(report.alias("report")))


@query("SELECT round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS minimum, max(c_acctbal) AS maximum FROM customer")
def stats(spark, sf):
    return records.compute_stats(table(spark, sf, "customer"), "c_acctbal").withColumn("mean", F.round("mean", 4))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def count_by(spark, sf):
    return records.count_by(table(spark, sf, "customer"), "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE coalesce(c_acctbal, 0) > 5000")
def filter_above(spark, sf):
    return records.filter_above(table(spark, sf, "customer"), "c_acctbal", 5000).select("c_custkey")


@query("SELECT round(sum(c_acctbal), 2) AS total, count(*) AS n, round(avg(c_acctbal), 4) AS mean, (SELECT count(*) FROM customer WHERE c_nationkey % 2 = 0 AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)) AS above FROM customer")
def active_above_mean(spark, sf):
    out = records.active_above_mean(table(spark, sf, "customer"), "c_acctbal", F.col("c_nationkey") % 2 == 0)
    return out.select(F.round("total", 2).alias("total"), "n", F.round("mean", 4).alias("mean"), "above")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: trim(x)), '|') AS parts FROM part")
def csv_line(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.csv_line(F.col("p_type"), " "), "|").alias("parts"))


@query("SELECT p_partkey, CASE WHEN contains(p_brand, '#') THEN trim(string_split(p_brand, '#')[1]) END AS k, CASE WHEN contains(p_brand, '#') THEN trim(substr(p_brand, strpos(p_brand, '#') + 1)) END AS v FROM part")
def key_value(spark, sf):
    m = table(spark, sf, "part").select("p_partkey", text.key_value(F.col("p_brand"), "#").alias("m"))
    return m.select("p_partkey", F.map_keys("m")[0].alias("k"), F.map_values("m")[0].alias("v"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE p_retailprice / (p_size % 3) END AS q, greatest(0.0, least(1.0, (p_retailprice - 1000.0) / 500.0)) AS s FROM part")
def divide_and_normalize(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.safe_divide(F.col("p_retailprice"), F.col("p_size") % 3).alias("q"), text.normalize_score(F.col("p_retailprice"), F.lit(1000.0), F.lit(1500.0)).alias("s"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name || ' -- É!')), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" -- É!"))).alias("slug"))


@query("SELECT n_regionkey, string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS report FROM nation GROUP BY n_regionkey")
def report(spark, sf):
    return records.report(table(spark, sf, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"], ["n_regionkey"])


@query("SELECT count(*) AS n, sum(abs(a.n_nationkey - b.n_nationkey))::BIGINT AS total FROM nation a, nation b")
def pair_join(spark, sf):
    return records.pairs(table(spark, sf, "nation"), "n_nationkey", "n_nationkey").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a_value") - F.col("b_value"))).alias("total"))


@query("SELECT count(*) AS n, count(*) FILTER (a.n_regionkey = b.n_regionkey AND b.n_regionkey = c.n_regionkey) AS same FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_nationkey < c.n_nationkey")
def triple_pattern(spark, sf):
    t = records.triples(table(spark, sf, "nation"), "n_nationkey", "n_regionkey")
    return t.agg(F.count("*").alias("n"), F.count_if((F.col("a_value") == F.col("b_value")) & (F.col("b_value") == F.col("c_value"))).alias("same"))


@query("SELECT a AS n_nationkey, d[len(d) // 2 + 1] AS median FROM (SELECT a.n_nationkey AS a, list_sort(list(abs(a.n_nationkey - b.n_nationkey))) AS d FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey GROUP BY 1)")
def median_distance_outliers(spark, sf):
    return records.upper_median_distance(table(spark, sf, "nation"), "n_nationkey", "n_nationkey")


@query("SELECT round(avg(abs(a.s_acctbal - b.s_acctbal)), 4) AS mean_distance FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey")
def pair_mean_distance(spark, sf):
    return records.pair_mean(table(spark, sf, "supplier"), "s_acctbal").select(F.round("mean_distance", 4).alias("mean_distance"))


@query("""WITH v AS (SELECT n_regionkey AS k, list(n_nationkey::DOUBLE ORDER BY n_nationkey) AS s FROM nation GROUP BY 1)
    SELECT a.k AS a_key, b.k AS b_key, list_inner_product(a.s[1:least(len(a.s), len(b.s))], b.s[1:least(len(a.s), len(b.s))]) AS product FROM v a, v b""")
def correlation_fold(spark, sf):
    v = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list(F.col("n_nationkey").cast("double"))).alias("s"))
    return records.folded_products(v, "k", "s")


@query("SELECT region.r_regionkey * 2 AS r_regionkey, upper(r_name) AS r_name FROM region")
def record_transform(spark, sf):
    return records.doubled(table(spark, sf, "region").withColumn("_hidden", F.lit(1)))


@query("SELECT c_custkey, c_acctbal AS number, greatest(0.0, least(1.0, c_acctbal / 10000.0)) AS scaled FROM customer WHERE c_custkey % 10 <> 0")
def validate_and_normalize(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("v"))
    return records.validated(rows, "v", 0.0, 10000.0).select("c_custkey", "number", "scaled")


ACTIONS = "SELECT user_id::VARCHAR AS episode_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'reset' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'edit_file' ELSE 'edit_files' END WHEN 'error' THEN 'submit' ELSE 'view_file' END AS action_type FROM events"


def actions(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "signup", "reset").when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, "edit_file").otherwise("edit_files")).when(kind == "error", "submit").otherwise("view_file")
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").alias("seq"), name.alias("action_type"))


@query(f"""WITH a AS ({ACTIONS}), r AS (SELECT *, count(*) FILTER (action_type = 'reset') OVER (PARTITION BY episode_id ORDER BY seq) AS run FROM a), l AS (SELECT *, max(run) OVER (PARTITION BY episode_id) AS last FROM r),
    e AS (SELECT *, coalesce(bool_or(action_type = 'submit') OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM l WHERE run = last),
    c AS (SELECT *, run > 0 AND NOT ended AND action_type <> 'reset' AS counts FROM e)
    SELECT episode_id, count(*) FILTER (counts) AS step, count(*) FILTER (counts AND action_type IN ('edit_file', 'edit_files')) AS edits, bool_or(counts AND action_type = 'submit') AS done FROM c GROUP BY episode_id""")
def episode_state(spark, sf):
    return episode.episode_table(actions(spark, sf))


@query(f"""WITH a AS ({ACTIONS}), r AS (SELECT *, count(*) FILTER (action_type = 'reset') OVER (PARTITION BY episode_id ORDER BY seq) AS run FROM a), l AS (SELECT *, max(run) OVER (PARTITION BY episode_id) AS last FROM r),
    e AS (SELECT *, coalesce(bool_or(action_type = 'submit') OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM l WHERE run = last),
    c AS (SELECT *, run > 0 AND NOT ended AND action_type <> 'reset' AS counts FROM e)
    SELECT episode_id, count(*) FILTER (counts) AS step, count(*) FILTER (counts AND action_type IN ('edit_file', 'edit_files')) AS edits, bool_or(counts AND action_type = 'submit') AS done FROM c GROUP BY episode_id""")
def episode_state_stream(spark, sf):
    """The same from a stream: the events table is read as one, and the last state of each key is kept."""
    kind = F.col("event_type")
    name = F.when(kind == "signup", "reset").when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, "edit_file").otherwise("edit_files")).when(kind == "error", "submit").otherwise("view_file")
    states = episode.episode_states(_event_stream(spark, sf).select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").alias("seq"), name.alias("action_type")))
    rows = episode.to_folder(states, _new_folder(spark, "episodes"))
    last = rows.groupBy("episode_id").agg(F.max_by(F.struct("step", "edits", "done"), F.col("batch")).alias("s"))
    return last.select("episode_id", "s.step", "s.edits", "s.done")


def _event_stream(spark, sf):
    """The events as a stream of four micro-batches, in the order of their numbers."""
    events = table(spark, sf, "events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(dealt(events, "event_id", 4, _new_folder(spark, "events")))


def _new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT episode_id, step, last_value(value IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY step) AS value FROM (SELECT user_id AS episode_id, event_id AS step, CASE WHEN event_type = 'view' THEN value END AS value FROM events)")
def context_carry_over(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("step"), F.when(F.col("event_type") == "view", F.col("value")).alias("value"))
    return sinks.carried(e, ["value"])


@query("SELECT episode_id::VARCHAR AS episode_id, step, last_value(value IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY step) AS value FROM (SELECT user_id AS episode_id, event_id AS step, CASE WHEN event_type = 'view' THEN value END AS value FROM events)")
def context_carry_stream(spark, sf):
    """The same from a stream, with the value in the state of each episode."""
    e = _event_stream(spark, sf).select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").alias("step"), F.when(F.col("event_type") == "view", F.col("value")).cast("double").alias("value"))
    return episode.to_folder(episode.carried_stream(e), _new_folder(spark, "carried"), "append").drop("batch")


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_wire(spark, sf):
    return sinks.as_json(table(spark, sf, "region").select("r_regionkey", "r_name"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 400 AS n FROM documents),
    c AS (SELECT *, list_max(list_filter(range(0, n + 1), lambda i: strlen(left(t, i)) <= n)) AS k FROM d)
    SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN strlen(t) <= n THEN t ELSE left(t, k) || CASE WHEN strlen(left(t, k)) < n THEN chr(65533) ELSE '' END || chr(10) || '… [truncated to 8 KB]' END AS head FROM c""")
def truncated_output(spark, sf):
    """Texts cut at 0 to 399 bytes, within characters too."""
    return table(spark, sf, "documents").select("doc_id", text.truncate_bytes(F.col("text"), F.col("doc_id") % 400).alias("head"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def iso_times(spark, sf):
    return table(spark, sf, "events").select("event_id", text.iso_time(F.col("ts")).alias("iso"))


@query(f"""WITH m AS ({MONTHS}), b AS (SELECT *, first_value(violations) OVER (PARTITION BY episode_id ORDER BY step) AS base FROM m)
    SELECT episode_id, step, printf('%.4f', greatest(0.01, 0.55 * greatest(0.0, least(1.0, (base - violations) / base)) + 0.45 * greatest(0.0, least(1.0, (base - violations) / base))))::DOUBLE AS score FROM b""")
def complexity_score(spark, sf):
    m = _months(spark, sf).select("episode_id", "step", F.col("violations").alias("cc_cost_sum"), F.col("violations").alias("bigO_cost_sum"))
    return grading.graded(m, grading.GRADERS["complexity"]).select("episode_id", "step", "score")


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0.0 WHEN p_size % 2 = 0 THEN greatest(0.0, least(1.0, (p_size / 50.0 - 0.2) / 0.7)) * 0.9 ELSE 0.9 * CASE WHEN p_size / 50.0::DOUBLE >= 0.2::DOUBLE - 0.02::DOUBLE THEN 1.0 ELSE 0.5 END END AS score FROM part""")
def coverage_score(spark, sf):
    rate, cover, base = F.lit(0.9), F.col("p_size") / 50.0, F.lit(0.2)
    mode = F.when(F.col("p_size") % 2 == 0, "objective")
    score = scoring.coverage_score(mode, F.col("p_size") % 7 == 0, scoring.coverage_constraint(rate, cover, base), scoring.coverage_objective(rate, cover, base, F.lit(0.9)))
    return table(spark, sf, "part").select("p_partkey", score.alias("score"))


@query("SELECT p_partkey, greatest(0.0, 1 - p_size / 30 * 0.5) AS factor FROM part")
def efficiency_decay(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scoring.decay("p_size", F.lit(30), F.lit(0.5)).alias("factor"))


@query("SELECT s_suppkey, s_acctbal / sum(s_acctbal) OVER () AS weight FROM supplier")
def weight_normalization(spark, sf):
    return grading.normalized(table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("weight")))


ITEMS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 13 <> 0 THEN (p_size - 5)::DOUBLE END AS v, p_partkey % 7 = 0 AS is_text, CASE WHEN p_partkey % 11 <> 0 THEN chr((65 + p_partkey % 6)::INTEGER) END AS category,
    p_partkey % 2 = 0 AS keep_zeros, p_partkey % 3 = 0 AS has_alt, p_retailprice AS alt_value, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'other' END AS priority FROM part"""
PROCESSED = f"""SELECT *, CASE WHEN v IS NULL THEN CASE WHEN has_alt THEN alt_value * 0.8 END WHEN is_text THEN v * 1.5 WHEN v > 0 THEN v * CASE WHEN category IS NULL THEN 1.1 WHEN category IN ('A', 'B', 'C') THEN 2.0 WHEN category = 'D' THEN 1.5 ELSE 1.0 END END AS processed FROM ({ITEMS})"""


def _items(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 13 != 0, (F.col("p_size") - 5).cast("double").cast("string")).alias("value"), (k % 7 == 0).alias("is_text"), F.when(k % 11 != 0, F.char(65 + k % 6)).alias("category"), (k % 2 == 0).alias("keep_zeros"),
        (k % 3 == 0).alias("has_alt"), F.col("p_retailprice").alias("alt_value"), F.when(k % 4 == 0, "high").when(k % 4 == 1, "low").when(k % 4 == 2, "other").alias("priority"))


@query(f"SELECT id, round(processed, 6) AS processed_value FROM ({PROCESSED}) WHERE processed IS NOT NULL OR (v IS NOT NULL AND NOT is_text AND v <= 0 AND keep_zeros)")
def record_preprocess(spark, sf):
    return records.preprocessed(_items(spark, sf)).select("id", F.round("processed_value", 6).alias("processed_value"))


@query(f"""WITH m AS (SELECT *, CASE WHEN processed < 10 THEN 2.0 WHEN processed < 50 THEN CASE WHEN category = 'A' THEN 1.8 ELSE 1.5 END WHEN processed < 100 THEN CASE category WHEN 'B' THEN 1.3 WHEN 'C' THEN 1.4 ELSE 1.2 END
        ELSE CASE category WHEN 'D' THEN 1.05 WHEN 'E' THEN 1.0 WHEN 'F' THEN 1.0 ELSE 1.1 END END::DOUBLE AS multiplier_used FROM ({PROCESSED}) WHERE processed IS NOT NULL)
    SELECT id, multiplier_used, round(processed * multiplier_used * CASE WHEN processed * multiplier_used <= 100 THEN 1.0 WHEN priority = 'high' THEN 1.1 WHEN priority = 'low' THEN 0.95 WHEN priority IS NULL THEN 0.98 ELSE 1.0 END, 4) AS transformed_value FROM m""")
def record_complex_transform(spark, sf):
    return records.transformed(records.preprocessed(_items(spark, sf))).select("id", "multiplier_used", F.round("transformed_value", 4).alias("transformed_value"))


@query(f"""WITH n AS (SELECT id, coalesce(v, 0.0) AS value, CASE WHEN category IS NULL THEN 'DEFAULT' WHEN category IN ('A', 'B', 'C', 'D', 'E') THEN category ELSE 'UNKNOWN' END AS category FROM ({ITEMS}))
    SELECT *, CASE WHEN value <= 0 THEN 'none' WHEN category = 'A' THEN 'high' WHEN category IN ('B', 'C') THEN 'medium' ELSE 'low' END AS priority FROM n""")
def record_normalize(spark, sf):
    return records.normalized(_items(spark, sf).select("id", "value", "category"))


@query("""WITH v AS (SELECT n_nationkey AS k, (n_nationkey * 3 - 6)::DOUBLE AS v FROM nation),
    p AS (SELECT avg(CASE WHEN a.v > 0 AND b.v > 0 THEN CASE WHEN abs(a.v - b.v) < 10 THEN 0.9 WHEN abs(a.v - b.v) < 50 THEN 0.6 ELSE 0.3 END WHEN a.v = 0 OR b.v = 0 THEN 0.1 ELSE -0.5 END::DOUBLE) AS c FROM v a JOIN v b ON a.k <> b.k),
    t AS (SELECT sum(CASE WHEN a.v > 0 AND b.v > 0 AND c.v > 0 THEN CASE WHEN abs(a.v - b.v) < 5 AND abs(b.v - c.v) < 5 THEN 1.0 WHEN a.v > b.v AND b.v > c.v OR a.v < b.v AND b.v < c.v THEN 0.5 END END)::DOUBLE AS s FROM v a JOIN v b ON a.k < b.k JOIN v c ON b.k < c.k)
    SELECT round(c, 6) AS avg_correlation, s AS pattern_score, round(0.7 * c + 0.3 * s, 6) AS complexity_score FROM p, t""")
def record_complexity(spark, sf):
    v = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 3 - 6).cast("double").alias("v"))
    out = records.record_complexity(v, "n_nationkey", "v")
    return out.select(F.round("avg_correlation", 6).alias("avg_correlation"), "pattern_score", F.round("complexity_score", 6).alias("complexity_score"))


@query("SELECT count(*) = count(json_extract(props, '$.k')) AS valid FROM events")
def record_field_check(spark, sf):
    return records.all_have(table(spark, sf, "events").select(F.from_json("props", "map<string,string>").alias("m")), "k", "m")


@query("SELECT conv_id, turn, turn BETWEEN 0 AND 10 AND length(text) BETWEEN 1 AND 500 AS valid FROM (SELECT conv_id, turn, CASE WHEN length(text) < 1 THEN NULL ELSE text END AS text FROM conversations) WHERE text IS NOT NULL")
def action_parameters(spark, sf):
    c = table(spark, sf, "conversations").where("length(text) >= 1").select("conv_id", "turn", F.col("turn").alias("context_lines"), F.length("text").alias("note_length"))
    return records.valid_parameters(c).select("conv_id", "turn", "valid")
