"""Benchmark decontamination: CGK embeddings of item-sized windows meet items in bit-sampling LSH, edit distances confirm."""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import U64, grams, hash64, lean, mix, slices

#: Keys of a walk, and places of a key.
TABLES, SAMPLED = 4, 3
#: The share of windows at the greatest distance that a key must find; as many walks are taken as reach it, MOST_WALKS at most.
RECALL, MOST_WALKS = 0.999, 128
#: Items that are held in memory at once, and bytes of their texts; more are taken in blocks.
ITEMS, ITEM_BYTES = 20_000, 32_000_000
#: Words of windows that are embedded or compared at once.
AT_ONCE = 250_000
WORD = re.compile(r"\w+")
PAD = U64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in lower case."""
    return hash64([w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.lower())]) if text else np.empty(0, U64)


def allowed(n: int, share: float) -> int:
    """Edits that a window of n words may be away: less than share of them differ, counted in whole words."""
    return int(share * n + 1e-9)


@functools.lru_cache(256)
def _functions(n: int, walks: int, seed: int) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """The random function of each step and walk for windows of n words, and which places of the walks the keys sample; the
    first walks are the same however many follow."""
    salt, wanted = np.empty((3 * n, walks), U64), defaultdict(list)
    for walk in range(walks):
        rng = np.random.default_rng((seed, n, walk))
        for table, place in np.ndindex(TABLES, SAMPLED):
            wanted[int(rng.integers(0, 3 * n))].append((walk, table, place))
        salt[:, walk] = rng.integers(0, 2**63, 3 * n).astype(U64)
    return salt, wanted


def embed_keys(windows: np.ndarray, walks: int, seed: int = 1) -> np.ndarray:
    """LSH keys of rows of n symbols: each row walks several times through its symbols; a random function of step and
    symbol says whether to step on, so that rows a few edits apart fall into step again and their walks differ in few of
    3n places. A key is a hash of SAMPLED places of one walk; each walk has TABLES keys."""
    rows, n = windows.shape
    salt, wanted = _functions(n, walks, seed)
    padded = np.concatenate([windows, np.full((rows, 1), PAD, U64)], 1)
    at, row = np.zeros((rows, walks), np.int64), np.arange(rows)[:, None]
    got = np.zeros((rows, walks, TABLES, SAMPLED), U64)
    for step in range(3 * n):
        symbol = padded[row, at]
        for walk, table, place in wanted.get(step, ()):
            got[:, walk, table, place] = symbol[:, walk]
        x = (symbol ^ salt[step]) * U64(0xBF58476D1CE4E5B9)
        at = np.minimum(at + (x >> U64(63)).astype(np.int64), n)
    key = np.zeros((rows, walks, TABLES), U64)
    for place in range(SAMPLED):
        key = mix(key + got[..., place], place + 3)
    return mix(key + np.arange(walks * TABLES).astype(U64).reshape(walks, TABLES), 9).reshape(rows, -1)


def edited(x: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """x after random edits of new words, cut or filled to its length."""
    out = x.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(out) + 1)), int(rng.integers(0, 3))
        out[at : at + (kind < 2)] = [int(rng.integers(0, 2**62))] * (kind != 1)
    return np.array((out + rng.integers(0, 2**62, len(x)).tolist())[: len(x)], U64)


@functools.lru_cache(4096)
def walks_for(n: int, edits: int, recall: float = RECALL) -> int:
    """How many walks find the recall of windows of n words that are that many edits away: measured on random pairs with the very
    functions that will be used, and half as many again."""
    if not edits:
        return 1
    rng = np.random.default_rng((7, n))
    a = rng.integers(0, 2**62, (300, n)).astype(U64)
    b = np.array([edited(x, edits, rng) for x in a])
    walks = 8
    while True:
        hit = (embed_keys(a, walks) == embed_keys(b, walks)).reshape(len(a), walks, TABLES).any(2)
        enough = np.flatnonzero(np.maximum.accumulate(hit, 1).mean(0) >= recall)
        if len(enough):
            return min(MOST_WALKS, -(-3 * (int(enough[0]) + 1) // 2))
        if walks >= MOST_WALKS:
            raise ValueError(f"{MOST_WALKS} walks don't find {recall} of the windows of {n} words with {edits} edits; a smaller share of edits is needed")
        walks *= 2


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances between the rows of a and b, both of n symbols."""
    rows, n = a.shape
    last = np.tile(np.arange(n + 1, dtype=np.int16), (rows, 1))
    ramp = np.arange(n + 1, dtype=np.int16)
    for i in range(n):
        best = np.empty_like(last)
        best[:, 0] = i + 1
        best[:, 1:] = np.minimum(last[:, :-1] + (a[:, i : i + 1] != b), last[:, 1:] + 1)
        last = np.minimum.accumulate(best - ramp, 1) + ramp  # what insertions reach
    return last[:, n]


class Items:
    """Items by their length in words: symbols, LSH keys, and the runs of words one of which a window within reach shares."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], share: float):
        self.share, by_n = share, defaultdict(list)
        for key, t in rows:
            if len(t):
                by_n[len(t)].append((key, t))
        self.n, seeds = {}, defaultdict(list)
        for n, items in by_n.items():
            t = np.array([x for _, x in items], U64)
            walks = walks_for(n, allowed(n, share))
            keys = embed_keys(t, walks)
            order = np.argsort(keys.ravel(), kind="stable")
            self.n[n] = (np.array([k for k, _ in items]), t, keys.ravel()[order], order // keys.shape[1], walks)
            # n words with k edits keep a run of n // (k + 1) words whole.
            run = n // (allowed(n, share) + 1)
            width = 1 << (run.bit_length() - 1)
            for x in t:
                g = grams(x, width)
                seeds[width].append(np.stack([g, np.full(len(g), n, U64), np.arange(len(g)).astype(U64)], 1))
        self.seeds = {}
        for width, parts in seeds.items():
            s = np.unique(np.concatenate(parts), axis=0)
            marks = np.zeros(1 << 20, bool)
            marks[(s[:, 0] & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds[width] = (s[:, 0].copy(), s[:, 1].astype(np.int64), s[:, 2].astype(np.int64), marks)

    def windows(self, t: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the starts of windows of a text that share a run with an item at about the same place."""
        found = defaultdict(list)
        for width, (seed, n, offset, marks) in self.seeds.items():
            g = grams(t, width)
            at = np.flatnonzero(marks[(g & U64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(seed, g[at], "left"), np.searchsorted(seed, g[at], "right")
            for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                for i in range(a, b):
                    found[int(n[i])].append(p - int(offset[i]))
        out = {}
        for n, starts in found.items():
            k = allowed(n, self.share)
            if len(t) < n - k:
                continue
            s = (np.unique(np.array(starts))[:, None] + np.arange(-(k // 2) - 1, k // 2 + 2)).ravel()
            out[n] = np.unique(np.clip(s, 0, max(0, len(t) - n)))
        return out

    def hits(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """Index of the text, item, start, length, distance: of each text and item the nearest window, the first of equal ones."""
        wanted = defaultdict(list)
        for i, t in enumerate(texts):
            if len(t):
                for n, starts in self.windows(t).items():
                    wanted[n].append((i, starts))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, parts in wanted.items():
            ids, t, keys, owner, walks = self.n[n]
            step = max(1, AT_ONCE // n)
            doc = np.concatenate([np.full(len(s), i) for i, s in parts])
            start = np.concatenate([s for _, s in parts])
            for at in range(0, len(doc), step):
                d, s = doc[at : at + step], start[at : at + step]
                w = np.full((len(d), n), PAD, U64)
                for i in np.unique(d):
                    mine = np.flatnonzero(d == i)
                    text = texts[i]
                    m = min(n, len(text))
                    w[mine, :m] = text[s[mine][:, None] + np.arange(m)]
                own = embed_keys(w, walks)
                lo, hi = np.searchsorted(keys, own.ravel(), "left"), np.searchsorted(keys, own.ravel(), "right")
                hit = np.flatnonzero(lo < hi)
                count = (hi - lo)[hit]
                row = np.repeat(hit // own.shape[1], count)
                item = owner[np.repeat(lo[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                pair = np.unique(np.stack([row, item], 1), axis=0)
                for a in range(0, len(pair), step):
                    row, item = pair[a : a + step].T
                    dist = edit_distances(w[row], t[item])
                    for r, it, x in zip(*(v[dist <= allowed(n, self.share)].tolist() for v in (row, item, dist)), strict=True):
                        key, value = (int(d[r]), int(ids[it])), (x, int(s[r]), n)
                        if key not in best or value < best[key]:
                            best[key] = value
        return [(i, item, s, n, x) for (i, item), (x, s, n) in sorted(best.items())]


def _find(held):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            for part in slices(batch, 1, 4_000_000, 1000):
                ids = part.column(0).to_pylist()
                rows = items.hits([tokens(x) for x in part.column(1).to_pylist()])
                cols = list(zip(*rows, strict=True)) or [()] * 5
                hashes = part.column(2).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in cols[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:]), hashes], ["doc_id", "item_id", "start", "n_words", "distance", "text_hash"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """doc_id, item_id, start, n_words, distance, text_hash: documents (doc_id, text) that hold a benchmark item (item_id, text).

    A document holds an item of n words if one of its windows of n words is at most share * n word edits away (fewer
    words than n count as edits); given is the nearest window, the first of equal ones, from word start on. Words are
    runs of letters, digits and underscores in lower case. Null and empty texts and items hold nothing and are held by
    nothing; repeated documents give their rows again, repeated items are one, an item_id with several texts is held
    if one of them is; rows with a null doc_id or item_id take no part. text_hash, Spark's xxhash64 of the text, tells
    texts of one doc_id apart. Other columns are ignored.

    Windows are embedded where the text shares a run of words with an item, at about the same place of the item, that
    any window within reach must share. An embedded window that meets an item under one of the keys, of which there are as
    many as RECALL takes, is confirmed by its edit distance. Items are held by every task, ITEMS of them or ITEM_BYTES of
    text at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    found = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # about ITEMS rows
        held = spark.sparkContext.broadcast(Items([(r["item_id"], tokens(r["text"])) for r in mine], share))
        part = docs.mapInArrow(_find(held), "doc_id long, item_id long, start long, n_words long, distance long, text_hash long")
        found = part if found is None else found.unionByName(part)
    return found
