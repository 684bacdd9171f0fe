"""Exact top-k search by inner product: score histograms are refined until they give each query's kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.shared import lean, staged

BLOCK = 2048
BINS = 1024
#: Blocks of queries and of candidates in a cell of the grid that one task scores, at most.
Q_BLOCKS, C_BLOCKS = 16, 16


def _pack(scale: float, block: int):
    """Blocks of whole-number vectors: as many blocks a partition as its rows and dimensions need."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, rows = zip(*held.pop(dim), strict=True)
            m = np.array(rows, np.int64)
            big = int(np.abs(m).max(initial=0))
            norm = int(np.ceil(np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0))))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary()), pa.array([float(norm)]), pa.array([float(big)])], ["dim", "n", "ids", "m", "norm", "big"])

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vector is None or None in vector:
                    continue
                x = np.floor(scale * np.asarray(vector, np.float64))
                if np.isfinite(vector).all():
                    if np.abs(x).max(initial=0) >= 2**62:
                        raise ValueError(f"a component of vector {key} leaves 62 bits")
                    held.setdefault(len(x), []).append((key, x.astype(np.int64)))
                    if len(held[len(x)]) >= block:
                        yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return run


def _scores(dim: int, sizes: tuple[int, int], q: bytes, c: bytes, exact32: bool, exact64: bool) -> np.ndarray:
    a, b = (np.frombuffer(x, np.int64).reshape(n, dim) for x, n in zip((q, c), sizes, strict=True))
    if exact32:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact64 else a @ b.T


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair of blocks: its row, the ids of queries and candidates, and the scores; pairs whose longest vectors can't
    reach the lowest score that a query still asks for are left out."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names) if n not in ("q_ids", "c_ids")}
            low = np.frombuffer(r["lows"], np.int64)
            if r["q_norm"] * r["c_norm"] < low.min(initial=2**62):
                continue
            reach = r["dim"] * r["q_big"] * r["c_big"]
            q, c = (batch.column(batch.schema.get_field_index(n))[i].values.to_numpy() for n in ("q_ids", "c_ids"))
            scores = _scores(r["dim"], (len(q), len(c)), r["q_m"], r["c_m"], reach < 2**24, reach < 2**53)
            yield r, q, c, scores


def _histograms(k: int):
    """query_id, bin, n of scores under the query's bounds, summed over all blocks of candidates that a task has for a block
    of queries; sent are the bins down to that sum's kth score, as the kth score over all is no lower."""

    def out(q: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
        flat[:, 0] = 0
        over = np.cumsum(flat[:, ::-1], 1)[:, ::-1] - flat  # how many lie above each bin
        row, at = np.nonzero((flat > 0) & (over < k))
        return pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array((at - 1).astype(np.int32)), pa.array(flat[row, at].astype(np.int64))], ["query_id", "bin", "n"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, total = None, None, None
        for r, q, c, scores in _pairs(batches):
            low, width = np.frombuffer(r["lows"], np.int64), np.frombuffer(r["widths"], np.int64)
            bins = (scores - low[:, None]) // width[:, None]
            bins[q[:, None] == c[None, :]] = -1
            bins = np.clip(bins, -1, BINS) + 1  # 0: below, BINS + 1: above
            flat = np.bincount((bins + (np.arange(len(q)) * (BINS + 2))[:, None]).ravel(), minlength=len(q) * (BINS + 2)).reshape(len(q), BINS + 2)
            if r["qb"] == block:
                total += flat
                continue
            if block is not None:
                yield out(ids, total)
            block, ids, total = r["qb"], q, flat
        if block is not None:
            yield out(ids, total)

    return run


def _select(k: int):
    """Candidates above the kth score, and of those that tie with it the k of smallest id."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, q, c, scores in _pairs(batches):
            low = np.frombuffer(r["lows"], np.int64)
            order = np.argsort(c, kind="stable")
            c, scores = c[order], scores[:, order]
            own = q[:, None] == c[None, :]
            tie = (scores == low[:, None]) & ~own
            row, at = np.nonzero((scores > low[:, None]) & ~own | tie & (np.cumsum(tie, 1) <= k))
            yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(c[at]), pa.array(scores[row, at])], ["query_id", "vec_id", "score"])

    return run


QUERY = ("qb", "dim", "q_ids", "q_m", "q_norm", "q_big")


def _with_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks with the bounds that are known for their queries, in the order of their rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            known = {b["query_id"]: (b["low"], b["width"]) for b in r["bounds"] or ()}
            low, width = np.array([known.get(x, (-(2**62), 1)) for x in r["q_ids"]], np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n))[i : i + 1] for n in QUERY] + [pa.array([x.tobytes()], pa.binary()) for x in (low, width)], [*QUERY, "lows", "widths"])


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each of queries (both: vec_id, embedding).

    Components become floor(scale * x); the score is their integer inner product (64-bit, wrapping). Ties go to the
    smaller vec_id, a query's own vec_id is left out, vectors of different lengths have no score, and with fewer than
    k candidates all are given. Vectors that are null or hold a null or non-finite component take no part; nor do rows with
    a null vec_id. Empty vectors score 0 among each other, and a component that leaves 62 bits is an error. Repeated rows with one vec_id are candidates each; of several
    vectors that the queries have under one vec_id the smallest, compared component by component, is the query.

    Every pass scores all pairs of a query block with a candidate block anew (matrix products) and keeps no scores:
    the first passes only gather, for each query, how many scores fall in each of BINS equal ranges, and narrow the
    range that holds the kth score until it is one whole number; the last pass keeps what reaches it. A task takes up to
    Q_BLOCKS by C_BLOCKS pairs of blocks and sums its counts over the candidates, so that what is sent grows with
    queries times tasks.
    """
    q_name = "qb long, dim int, q_ids array<long>, q_m binary, q_norm double, q_big double"
    clean = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null")
    packed = "dim int, n int, ids array<long>, m binary, norm double, big double"
    cand = staged(clean(vectors).mapInArrow(_pack(scale, block), packed), "vectors")
    valid = clean(queries).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    mine = valid.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    mine = staged(mine.mapInArrow(_pack(scale, block), packed).withColumn("qb", F.monotonically_increasing_id()), "queries")
    both = mine.groupBy("dim").agg(F.max("norm").alias("q")).join(cand.groupBy("dim").agg(F.max("norm").alias("c")), "dim")
    reach = min(int(both.agg(F.max(F.col("q") * F.col("c"))).first()[0] or 0) + 1, 2**62)
    q_count, c_count = mine.count(), cand.count()
    rows = max(1, -(-q_count // Q_BLOCKS))  # cells of the grid of queries and candidates: of few blocks, as many as there are tasks for
    cols = max(1, -(-c_count // C_BLOCKS), min(c_count, 2 * vectors.sparkSession.sparkContext.defaultParallelism // rows))
    blocks = mine.select("qb", "dim", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("norm").alias("q_norm"), F.col("big").alias("q_big"))
    c_blocks = cand.select("dim", F.col("ids").alias("c_ids"), F.col("m").alias("c_m"), F.col("norm").alias("c_norm"), F.col("big").alias("c_big"))
    c_blocks = c_blocks.withColumn("col", F.pmod(F.xxhash64("c_ids"), F.lit(cols)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    span = -(-(2 * reach + 1) // BINS)
    own = staged(mine.select("qb", F.explode("ids").alias("query_id")), "query-blocks")
    bounds = own.select("query_id", F.lit(-reach).cast("long").alias("low"), F.lit(span).cast("long").alias("width"), F.lit(k).cast("long").alias("want"))

    def scored(bounds: DataFrame) -> DataFrame:
        per_block = own.join(bounds, "query_id").groupBy("qb").agg(F.collect_list(F.struct("query_id", "low", "width")).alias("bounds"))  # at most block of them
        q = blocks.join(per_block, "qb").mapInArrow(_with_bounds, f"{q_name}, lows binary, widths binary")
        q = q.withColumn("row", F.pmod(F.xxhash64("qb"), F.lit(rows)).cast("int")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
        # Stated queries against all rows, in blocks. The merge takes block by block of the queries.
        return q.join(c_blocks.hint("merge"), ["row", "col", "dim"])

    while True:
        counts = scored(bounds).mapInArrow(_histograms(k), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        found = counts.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).join(bounds, "query_id").where("above < want")
        last = found.groupBy("query_id", "low", "width", "want").agg(F.min_by(F.struct("bin", "above"), "bin").alias("b"))
        bounds = staged(last.select("query_id", (F.col("low") + F.col("b.bin") * F.col("width")).alias("low"), F.when(F.col("width") > 1, F.ceil(F.col("width") / BINS)).otherwise(0).cast("long").alias("width"), (F.col("want")).alias("want")), "bounds")
        span = span if span <= 1 else -(-span // BINS)
        if bounds.where("width > 0").isEmpty():
            break
        bounds = bounds.withColumn("width", F.greatest("width", F.lit(1)))
    best = scored(bounds.withColumn("width", F.lit(1).cast("long"))).mapInArrow(_select(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
