"""Line deduplication: documents probe sharded minimal perfect hashes of all lines, with arrays of fingerprints and counts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import U64, lean, mix, rest, slices, staged, typed

KEYS_PER_SHARD = 200_000
PROBES_PER_TASK = 400_000
SLICE = 4_000_000  # bytes of text at once


class PerfectHash:
    """A minimal perfect hash in levels: at each level a bit marks the slots that exactly one key hits, the other keys
    go on to the next level, and the rank of a key's bit is its index."""

    LEVELS, LOAD = 40, 1.5

    def __init__(self, keys: np.ndarray):
        rest, self.bits, self.before, self.sizes, base = keys, [], [], [], 0
        for level in range(self.LEVELS):
            if not len(rest):
                break
            size = -(-int(self.LOAD * len(rest) + 64) // 64) * 64
            at = (mix(rest, level) % U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            marks = np.packbits(alone, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(marks).astype(np.int64)
            self.bits.append(marks)
            self.before.append((base + np.cumsum(counts) - counts).astype(np.int64))
            self.sizes.append(size)
            base += int(counts.sum())
            rest = rest[~alone[at]]
        self.left, self.base = np.sort(rest), base

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key that was built in; any index or -1 for others."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                return out
            at = (mix(keys[todo], level) % U64(size)).astype(np.int64)
            word, bit = self.bits[level][at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1))).astype(np.int64)
            out[todo[hit]] = (self.before[level][at >> 6] + below)[hit]
            todo = todo[~hit]
        if len(self.left) and len(todo):
            at = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            out[todo] = np.where(self.left[at] == keys[todo], self.base + at, -1)
        return out


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _line_hashes(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 1, SLICE)):
            ids, found = [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text:
                    keys = {k for line in text.encode("utf-8", "surrogatepass").split(b"\n") if (k := line_key(line, min_chars))}
                    ids.append(np.full(len(keys), doc, np.int64))
                    found += map(xxhash.xxh3_128_digest, keys)
            h = np.frombuffer(b"".join(found), ">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*ids, np.empty(0, np.int64)])), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "h", "fp"])

    return run


@dataclass
class LineIndex:
    """A perfect hash over the distinct line hashes of a shard and, by its index: 16 bits of fingerprint, the number of
    documents up to limit, and for keys that reach it, by their rank among those, the largest document.

    Every line of the corpus is in it, so that a key finds its own place; the fingerprint tells others apart. Keys whose
    routing halves are equal stand in spare.
    """

    hash: PerfectHash
    prints: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    last: np.ndarray
    limit: int
    spare: dict[tuple[int, int], tuple[int, int]]

    @classmethod
    def build(cls, h: np.ndarray, fp: np.ndarray, n: np.ndarray, last: np.ndarray, limit: int) -> LineIndex:
        keys, first = np.unique(h, return_index=True)
        twins = np.isin(h, h[np.setdiff1d(np.arange(len(h)), first)])  # keys that share their routing half
        spare = {(int(h[i]), int(fp[i])): (min(int(n[i]), limit), int(last[i])) for i in np.flatnonzero(twins)}
        ph = PerfectHash(keys)
        order = np.empty(len(keys), np.int64)
        order[ph.index(keys)] = first
        counts = np.minimum(n[order], limit).astype(np.min_scalar_type(limit))
        often = counts >= limit
        return cls(ph, fp[order].astype(np.uint64).astype(np.uint16), counts, np.cumsum(often, dtype=np.int32), last[order][often], limit, spare)

    def repeated_elsewhere(self, doc: np.ndarray, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Whether limit documents hold the key of each probe, and its document isn't the largest of them."""
        at = self.hash.index(h)
        hit = (at >= 0) & (self.prints[at] == fp.astype(np.uint64).astype(np.uint16)) & (self.counts[at] >= self.limit)
        drop = np.zeros(len(h), bool)
        drop[hit] = self.last[self.rank[at[hit]] - 1] != doc[hit]
        for i in np.flatnonzero(np.isin(h, np.array([k for k, _ in self.spare], U64))) if self.spare else ():
            n, last = self.spare.get((int(h[i]), int(fp[i])), (0, 0))
            drop[i] = n >= self.limit and last != doc[i]
        return drop


def _build(min_docs: int):
    def run(table: pa.Table) -> pa.Table:
        h, fp, n, last = (table[c].to_numpy() for c in ("h", "fp", "n", "last"))
        blob = pickle.dumps(LineIndex.build(h.view(np.uint64), fp.view(np.uint64), n, last, min_docs), 5)
        return pa.table({"shard": table["shard"][:1], "index": pa.array([blob], pa.binary())}, schema=pa.schema([("shard", pa.int32()), ("index", pa.binary())]))

    return run


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])
    if not right.num_rows or not left.num_rows:
        return schema.empty_table()
    index = pickle.loads(right["index"][0].as_py())
    doc, h, fp = (left[c].to_numpy() for c in ("doc_id", "h", "fp"))
    drop = index.repeated_elsewhere(doc, h.view(np.uint64), fp.view(np.uint64))
    return pa.table([doc[drop], h[drop], fp[drop]], schema=schema)


def _strip(min_chars: int, carry: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 1, SLICE)):
            kept, n_lines, n_dropped = [], [], []
            digests = np.stack([part.column(2).values.field(f).to_numpy() for f in ("h", "fp")], 1).astype(">i8").view("V16").ravel()
            edges = part.column(2).offsets.to_numpy()
            for text, lo, hi in zip(part.column(1), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                body = text.as_py().encode("utf-8", "surrogatepass") if text.is_valid else b""
                n_lines.append(body.count(b"\n") + 1)
                n_dropped.append(0)
                if lo < hi:
                    gone = set(digests[lo:hi].tolist())
                    lines = [x for x in body.split(b"\n") if not ((k := line_key(x, min_chars)) and xxhash.xxh3_128_digest(k) in gone)]
                    n_dropped[-1] = n_lines[-1] - len(lines)
                    body = b"\n".join(lines)
                kept.append(body)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *rest(part, carry)], ["doc_id", "text", "n_lines", "n_dropped", *carry])

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: each document without the lines that repeat across documents.

    A line's key is the line stripped of space and \\x09-\\x0D and with A-Z lower-cased. Keys of min_chars code points
    that stand in min_docs documents keep their lines in the largest doc_id that holds them alone. A null or empty
    text is one empty line and comes back empty. Rows with a null doc_id take no part and give no row; rows that
    repeat a doc_id count as one document, and each gives a row. Of other columns, carry names those that come along.

    Lines become 128-bit hashes: 64 bits route and index, some of the others are the fingerprint. The distinct hashes of
    all lines are spread over shards of KEYS_PER_SHARD keys on average, and the count array of a shard says which lines
    repeat; a shard that many lines probe, such as that of a line in a third of all documents, is copied to as many
    tasks as its probes need.
    """
    names = [f"c_{c}" for c in carry]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry)).where("doc_id is not null")
    lines = staged(docs.select("doc_id", "text").mapInArrow(_line_hashes(min_chars), "doc_id long, h long, fp long"), "lines")
    keys = staged(lines.groupBy("h", "fp").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"), F.count("*").alias("probes")), "line-keys")
    shards = max(1, -(-keys.count() // KEYS_PER_SHARD))
    shard = F.pmod(F.shiftright("h", 7), F.lit(shards)).cast("int").alias("shard")
    index = staged(keys.select(shard, "h", "fp", "n", "last").groupBy("shard").applyInArrow(_build(min_docs), "shard int, index binary"), "line-index")
    copies = keys.groupBy(shard).agg(F.ceil(F.sum("probes") / PROBES_PER_TASK).cast("int").alias("copies"))  # a row a shard
    copies = F.broadcast(copies) if shards < 100_000 else copies
    probes = lines.withColumn("shard", shard).join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int")).select("shard", "copy", "doc_id", "h", "fp")
    held = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "index")
    gone = probes.groupBy("shard", "copy").cogroup(held.groupBy("shard", "copy")).applyInArrow(_probe, "doc_id long, h long, fp long")
    gone = gone.groupBy("doc_id").agg(F.collect_set(F.struct("h", "fp")).alias("gone"))  # at most the lines of one document
    found = docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone", *names)
    out = found.mapInArrow(_strip(min_chars, names), f"doc_id long, text string, n_lines long, n_dropped long{typed(docs, names)}")
    return out.withColumnsRenamed({f"c_{c}": c for c in carry})
