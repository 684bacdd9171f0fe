"""The thin queries over the test tables, and SQL for the same results where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import arc, centroids, chat, decontam, linededup, minhash, periodic, pieces, quality, substring, tokencount, topk, toxicity
from quarrylens.llm.shared import staged

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of the row may not be learned; a row without an id has none to learn."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), train=~held_out())
    out = toxicity.toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_topk(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str = pieces.DEFAULT_MODEL) -> DataFrame:
    """The model file at hand was made as a BPE model (its trainer says so): its scores are negated ranks of merges and not
    log-probabilities. The segmentation is the one of the best sum of them; tokenizers aren't trained here."""
    out = pieces.round_trip(_table(spark, sf_dir, "documents"), model)
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(_table(spark, sf_dir, "conversations"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_passages(_table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_quality_resample(spark: SparkSession, sf_dir: str, max_target: int = 50_000) -> DataFrame:
    """The target is at most max_target texts that labels call good, those of the lowest hash; the share to keep is that of good labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where("quality is not null")
    good = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)
    good = spark.createDataFrame(good.toArrow())  # max_target rows at most
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    return quality.importance_resample(docs, docs.join(F.broadcast(good), "doc_id"), share)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arc.archive_roundtrip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, final = centroids.lloyd(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024.0, dim=64, seed="3:")
    own = staged(own, "clusters")
    digest = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(final)]
    inertia = own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i"))  # a row a centroid
    whole = inertia.agg(F.sum("i").cast("long").alias("inertia"))
    each = inertia.select("cluster", F.col("i").cast("long").alias("cluster_inertia")).join(spark.createDataFrame(digest, "cluster int, centroid_sha256 string"), "cluster")
    out = own.join(F.broadcast(each), "cluster").join(F.broadcast(whole))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def with_periods(docs: DataFrame) -> DataFrame:
    """The documents, of which those whose crc32 of the doc_id is divisible by 10 go on in a circle from some word to the end."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1))
    own = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"), F.floor(h / 10).alias("g"))
    own = own.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse_runs(with_periods(_table(spark, sf_dir, "documents")), least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    out = out.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str, model: str = pieces.DEFAULT_MODEL) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), model, limit=4096)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_toxicity, op3_line_dedup, op4_exact_topk, op5_sentencepiece, op6_chat_format, op7_substring_dedup, op8_quality_resample, op9_decontamination, op10_warc, op11_centroid_clustering, op12_periodic_runs, op13_token_counts)}

WS = r"[\x20\x09-\x0D]"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = f"regexp_extract_all({{}}, '[^{WS[1:-1]}]+')"



def _lloyd_sql(k: int, rounds: int) -> str:
    """Rounds one by one; all numbers are whole and below 2^53, so that doubles hold them."""
    steps = f"""
        v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, x AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"""
    for i in range(rounds + 1):
        steps += f""",
        a{i} AS MATERIALIZED (SELECT vec_id, x, cluster, d FROM (SELECT vec_id, x, cluster, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM v, c{i})
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)"""
        if i < rounds:
            steps += f""",
        s{i} AS (SELECT cluster, p, sum(y) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS p, unnest(x)::BIGINT AS y FROM a{i}) GROUP BY cluster, p),
        m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p)::DOUBLE[] AS c FROM s{i} GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""
    return f"""WITH {steps}
        SELECT vec_id, cluster::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT r.d, p.v FROM r JOIN p ON r.c = p.u),
        m AS (SELECT d, min(c) AS c FROM r GROUP BY d), l AS (SELECT u, count(*) AS k FROM p GROUP BY u)
        SELECT s.doc_id, len(s) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM s JOIN m ON d = s.doc_id""",
    "op3_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
        keyed AS (SELECT *, {LOWER.format(f"regexp_replace(line, '^{WS}+|{WS}+$', '', 'g')")} AS k FROM lines),
        often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (o.k IS NOT NULL AND last <> doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (o.k IS NULL OR last = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN often o USING (k) GROUP BY doc_id""",
    "op4_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.x) = 0 THEN 0 ELSE list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[]) END::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op6_chat_format": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY pos) AS turns, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered FROM t GROUP BY conv_id)
        SELECT conv_id, n AS n_turns, rendered FROM c WHERE NOT EXISTS (
            SELECT 1 FROM c d WHERE d.turns[1] IS NOT DISTINCT FROM c.turns[1] AND (d.n > c.n OR d.n = c.n AND d.conv_id < c.conv_id) AND d.turns[1:c.n] IS NOT DISTINCT FROM c.turns)""",
    "op7_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
        a AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
        g AS (SELECT doc_id, i, hash(w[i:i + 49]) AS h, md5(array_to_string(w[i:i + 49], ' ')) AS m FROM a),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h, m) < doc_id AS gone FROM g),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE gone),
        e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM w),
        k AS (SELECT e.doc_id, count(c.p) AS r, coalesce(string_agg(e.x, ' ' ORDER BY e.p) FILTER (c.p IS NULL), '') AS t FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY e.doc_id)
        SELECT w.doc_id, len(w.w) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS f FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes,
            list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h || '00', 1 + (i * 5) // 4, 3))::INTEGER) >> (7 - (i * 5) % 4)) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
        FROM d""",
    "op11_centroid_clustering": _lloyd_sql(8, 10),
    "op12_periodic_runs": f"""
        WITH RECURSIVE bytes AS (SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM bytes WHERE k < 8),
        crc AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 4294967295::BIGINT AS c, 0 AS k FROM documents UNION ALL
            SELECT doc_id, s, xor(crc.c >> 8, bytes.c), crc.k + 1 FROM crc JOIN bytes ON bytes.k = 8 AND bytes.b = (xor(crc.c, ascii(s[crc.k + 1])) & 255) WHERE crc.k < length(s)),
        h AS (SELECT doc_id, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g FROM crc WHERE k = length(s)),
        w0 AS (SELECT doc_id, h, g, {WORDS.format("coalesce(text, '')")} AS w FROM documents JOIN h USING (doc_id)),
        w1 AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM w0),
        w2 AS (SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM w1),
        w AS (SELECT doc_id, len(w) AS n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM w2),
        s AS (SELECT doc_id, n, unnest(range(n - 5)) AS i, w FROM w WHERE n >= 12),
        x AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 6], ' ') AS six FROM s),
        same AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.six = b.six AND b.i > a.i AND b.i - a.i <= a.n // 2),
        island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM same),
        stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM island GROUP BY doc_id, q, o HAVING count(*) + 5 >= greatest(12 - q, q)),
        run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
        best AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, {{'a': -length, 'b': start, 'c': period}}) AS r,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM run GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
        each AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS x FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, r.start::BIGINT AS start, r.length::BIGINT AS length, r.period::BIGINT AS period, (1000 * r.length // r.period)::BIGINT AS exponent_milli,
            sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM w LEFT JOIN best ON best.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id""",
}
