"""Quality selection: importance weights from hashed n-gram models of target and raw text, and Gumbel top-k sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import U64, grams, hash64, lean, mix, staged, words

BUCKETS = 10_000
#: Log-odds a word or pair of words; larger ones sample more evenly.
TEMPERATURE = 0.05


def hashed_grams(text: str | None, buckets: int) -> np.ndarray:
    """The buckets of all words and pairs of words, A-Z lower-cased."""
    w = words(text)
    if not w:
        return np.empty(0, np.int64)
    h = hash64([x.lower() for x in w])
    return (np.concatenate([mix(h, 51), grams(h, 2)]) % U64(buckets)).astype(np.int64)


def _counts(buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                g = hashed_grams(text, buckets)
                if len(g):
                    total += np.bincount(g, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_model(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log-probabilities of the buckets, from the counts over all texts, plus one each."""
    got = docs.select("text").mapInArrow(_counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # buckets rows at most
    n = np.ones(buckets)
    n[got["bucket"].to_numpy()] += got["n"].to_numpy()
    return np.log(n / n.sum())


def _score(ratio, buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = [], []
            for text in batch.column(1).to_pylist():
                g = hashed_grams(text, buckets)
                total.append(float(ratio.value[g].sum()))
                count.append(len(g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.float64()), pa.array(count, pa.int64())], ["doc_id", "log_weight", "n_grams"])

    return run


def largest(rows: DataFrame, key: str, k: int, ties: str, bins: int = 4096) -> DataFrame:
    """The k rows of the largest key, ties going to the smaller value of ties: counts in bins are refined until the kth
    key is known. The driver sees bins rows at a time; no rows are sorted."""
    if k <= 0:
        return rows.limit(0)
    n, lo, hi = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    if k >= n:
        return rows
    above = 0
    while True:
        width = (hi - lo) / bins
        if not width > abs(hi) * 1e-15:
            break
        at = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        inside = rows.where(F.col(key).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("bin")).collect()
        for r in inside:
            if above + r["n"] >= k:
                break
            above += r["n"]
        lo, hi = r["lo"], r["hi"]
        if lo == hi or r["n"] <= bins:
            break
    rest = rows.where(F.col(key).between(lo, hi)).orderBy(F.desc(key), ties).limit(k - above)  # bins rows, or rows with one key
    return rows.where(F.col(key) > hi).unionByName(rest)


def sampling_key(log_weight: Column, doc_id: Column, seed: Column) -> Column:
    """The log-weight plus Gumbel noise, which a hash of the seed and doc_id gives, the same in every run: the rows of the
    k largest keys are a sample without replacement in which the weights are the odds."""
    u = (F.shiftrightunsigned(F.xxhash64(seed, F.coalesce(doc_id, F.lit(-1))), 11).cast("double") + 0.5) / float(1 << 53)
    return log_weight - F.log(-F.log(u))


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, temperature: float = TEMPERATURE, seed: int = 1) -> DataFrame:
    """doc_id, log_weight, n_grams, key of documents (doc_id, text); see importance_resample."""
    spark = docs.sparkSession
    docs, target = (d.select(*([F.col("doc_id").cast("long").alias("doc_id")] if "doc_id" in d.columns else []), F.col("text").cast("string").alias("text")) for d in (docs, target))
    ratio = spark.sparkContext.broadcast(bucket_model(target, buckets) - bucket_model(docs, buckets))
    scored = docs.mapInArrow(_score(ratio, buckets), "doc_id long, log_weight double, n_grams long")
    tempered = F.col("log_weight") / F.greatest("n_grams", F.lit(1)) / F.lit(temperature)
    return scored.withColumn("key", sampling_key(tempered, F.col("doc_id"), F.lit(seed)))


def importance_resample(docs: DataFrame, target: DataFrame, share: float, buckets: int = BUCKETS, temperature: float = TEMPERATURE, seed: int = 1) -> DataFrame:
    """doc_id, log_weight, n_grams, key, kept: documents sampled without replacement by their importance weights.

    The weight of a text is the ratio of its chances under two models of hashed words and word pairs: one of the
    target texts and one of all texts, both counted over whole texts. As that ratio grows with the length of a text
    until no noise could tell two texts apart, it is tempered: a text's odds are exp(log_weight / n_grams / temperature),
    so that at TEMPERATURE a text whose words are likelier by a factor of exp(TEMPERATURE) each has e times the odds.
    kept marks round(share * rows) rows, those of the largest key, the logarithm of the odds plus Gumbel noise; ties go
    to the smaller doc_id. Null and empty texts have odds of 1. Repeated rows are sampled together where their doc_id is
    the same; a row with a null doc_id counts as doc_id -1. Other columns are ignored.
    """
    rows = staged(importance_scores(docs, target, buckets, temperature, seed), "weights")
    k = round(share * rows.count())
    best = largest(rows.select("doc_id", "key").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), "key", k, "doc_id")
    edge = best.agg(F.min(F.struct("key", -F.col("doc_id"))).alias("e")).first()["e"] if k else None
    kept: Column = F.lit(False) if edge is None else (F.col("key") > edge[0]) | (F.col("key") == edge[0]) & (F.coalesce("doc_id", F.lit(-1)) <= -edge[1])
    return rows.withColumn("kept", kept)
