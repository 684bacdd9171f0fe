"""Removal of repeated passages: FM-indexes of text segments find what stands in an earlier document too."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import U64, discard, hash64, lean, mix, signed, staged, typed, words

GRAM = 10
#: How many of a window's smallest hashes of GRAM words make its route, from level to level; at the last level all its words do.
LEVELS = (1, 6, 0)
#: Words in an index, and bytes of different segments that a route may have before the next level splits it.
SHARD_WORDS, ROUTE_BYTES = 300_000, 1 << 16
#: By how many symbols suffixes are sorted; patterns are shorter.
SORTED = 64
#: Longer words stand in segments by their SHA-256, behind a byte that no text has.
LONG_WORD = 72
#: Windows whose hashes are compared at once.
AT_ONCE = 20_000


def sums(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n hashes: sums under odd multipliers."""
    out = np.zeros(max(0, len(h) - n + 1), U64)
    for i in range(n):
        out += h[i : i + len(out)] * (mix(np.array([i], U64), 77)[0] | U64(1))
    return mix(out)


def routes(h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each window of length word hashes, of its k smallest hashes of GRAM words or, if k is 0, of all its words;
    and where runs of windows with one hash, and with their smallest GRAM words at one place, begin.

    Equal windows have equal routes, and the more hashes count, the fewer others share them. No run is longer than a window.
    """
    if not k:
        return sums(h, length), np.arange(len(h) - length + 1)
    view = np.lib.stride_tricks.sliding_window_view(sums(h, GRAM), length - GRAM + 1)
    at = view.argmin(1) + np.arange(len(view))
    out = view[np.arange(len(view)), at - np.arange(len(view))]
    if k > 1:
        for i in range(0, len(view), AT_ONCE):
            least = np.sort(np.partition(view[i : i + AT_ONCE], k - 1, axis=1)[:, :k], axis=1)
            out[i : i + AT_ONCE] = sums(least.ravel(), k)[::k]
    return out, np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(out) != 0)])


class FMIndex:
    """An FM-index of segments of symbols with the wavelet matrix of its Burrows-Wheeler transform, and the smallest owner
    of any range of suffixes. Suffixes are sorted by their first SORTED symbols, which is enough for shorter patterns.

    It holds a bit and half a bit of counts for each symbol and level of the matrix, and for owners, by their rank in 32
    bits, the least of 1, 2, 4, 8 and 16 places in a row and of runs of blocks of 16.
    """

    FINE = 4

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        """text: symbols, 0 behind each segment; owner: of each place."""
        n = len(text)
        rank, order, reach = text.astype(np.int64), np.argsort(text, kind="stable"), 1
        while reach < SORTED:
            second = np.zeros(n, np.int64)
            second[: n - reach] = rank[reach:] + 1
            key = rank * (n + int(rank.max(initial=0)) + 2) + second
            order = np.argsort(key, kind="stable")
            steps = np.r_[0, np.diff(key[order]) != 0]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(steps)
            reach *= 2
            if rank[order[-1]] == n - 1:
                break
        self.n = n
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))]
        self.levels, x = [], text[order - 1].astype(np.int32)
        for bit in range(max(1, int(text.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = (x >> bit) & 1 == 1
            marks = np.packbits(np.r_[ones, np.zeros(-n % 64 + 64, bool)], bitorder="little").view(np.uint64)
            counts = np.cumsum(np.bitwise_count(marks), dtype=np.int32)
            self.levels.append((bit, marks, np.r_[np.int32(0), counts[:-1]], int(n - ones.sum())))
            x = np.concatenate([x[~ones], x[ones]])
        self.shift = self.before[:-1] - self.descend(np.arange(len(self.before) - 1), np.zeros(len(self.before) - 1, np.int64))
        self.owners, place = np.unique(owner, return_inverse=True)
        self.fine = [place.reshape(-1)[order].astype(np.int32)]
        for k in range(min(self.FINE, max(0, n.bit_length() - 1))):
            last = self.fine[-1]
            self.fine.append(np.minimum(last[: -(1 << k)], last[1 << k :]))
        self.coarse = [self.fine[-1][:: 1 << self.FINE]] if len(self.fine) > self.FINE else []
        while self.coarse and len(self.coarse[-1]) > (half := 1 << (len(self.coarse) - 1)):
            self.coarse.append(np.minimum(self.coarse[-1][:-half], self.coarse[-1][half:]))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first at symbols of the transform that are symbol end below the last level."""
        for bit, marks, counts, zeros in self.levels:
            word = at >> 6
            ones = counts[word] + np.bitwise_count(marks[word] & ((U64(1) << (at & 63).astype(np.uint64)) - U64(1)))
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of symbol + pattern from those of patterns."""
        m = len(symbol)
        at = self.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.shift[symbol], 2)
        return at[:m], at[m:]

    def first_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner in ranges that aren't empty."""
        out = np.empty(len(lo), np.int32)
        level = np.minimum(np.frexp((hi - lo).astype(np.float64))[1] - 1, len(self.fine) - 1)
        for k in np.unique(level):  # a run from each end; longer ranges have whole blocks between them
            own = level == k
            out[own] = np.minimum(self.fine[k][lo[own]], self.fine[k][hi[own] - (1 << int(k))])
        wide = np.flatnonzero(hi - lo > 2 << self.FINE)
        first, last = (lo[wide] + (1 << self.FINE) - 1) >> self.FINE, hi[wide] >> self.FINE
        level = np.frexp((last - first).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            blocks = np.minimum(self.coarse[k][first[own]], self.coarse[k][last[own] - (1 << int(k))])
            out[wide[own]] = np.minimum(out[wide[own]], blocks)
        return self.owners[out]


def shared_windows(segments: list[list[bytes]], owners: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Of each segment of words the ranges under windows that a segment of a smaller owner holds.

    The windows of a segment that are still open start at a to b. Backward search runs from the end of window a; if it
    fails at word p, windows that start up to p hold the failing run and are closed. If it gets through, it runs from
    the end of window b as far as it goes, and all windows in what it matched are covered.
    """
    symbols = pa.array([w for s in segments for w in s], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int32)
    sizes = np.array([len(s) for s in segments])
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
    text[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols + 1
    index = FMIndex(text, np.repeat(owners, sizes + 1))
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    seg = np.flatnonzero(sizes >= length)
    a, b = np.zeros(len(seg), np.int64), sizes[seg] - length
    first = np.ones(len(seg), bool)  # from the end of window a, else of b
    at = a + length  # the pattern is [at, end) of the segment
    lo, hi = np.zeros(len(seg), np.int64), np.full(len(seg), index.n, np.int64)
    while len(seg):
        symbol = text[starts[seg] + at - 1]
        new_lo, new_hi = index.extend(symbol, lo, hi)
        some = new_lo < new_hi
        good = some.copy()
        good[some] = index.first_owner(new_lo[some], new_hi[some]) < owners[seg[some]]
        at = at - good
        lo, hi = np.where(good, new_lo, lo), np.where(good, new_hi, hi)
        through = good & (at <= a)
        ended = ~good | through | ~first & (b + length - at >= SORTED - 1)
        # Of the searches that have ended, close what they decide.
        for i in np.flatnonzero(ended & ~first & (at <= b)):
            out[seg[i]].append((int(at[i]), int(b[i]) + length))
        for i in np.flatnonzero(through & first):
            out[seg[i]].append((int(a[i]), int(a[i]) + length))
        failed_first, passed_first = first & ~good, first & through
        failed_last = ~first & ended
        a = np.where(failed_first, at, a)  # the word before at fails: windows that start before at are closed
        a = np.where(passed_first, a + 1, a)
        b = np.where(failed_last, np.minimum(at - 1, b - 1), b)
        first = np.where(ended, ~passed_first, first)
        end = np.where(first, a, b) + length
        at = np.where(ended, end, at)
        lo, hi = np.where(ended, 0, lo), np.where(ended, index.n, hi)
        going = a <= b
        seg, a, b, first, at, lo, hi = (x[going] for x in (seg, a, b, first, at, lo, hi))
    return out


def _tokens(body: str | bytes | None) -> list[bytes]:
    """The words of a text, long ones by their digest; or those of a segment."""
    if isinstance(body, bytes):
        return body.split()
    return [w if len(w) <= LONG_WORD else b"\xff" + hashlib.sha256(w).hexdigest().encode() for w in words(body)]


def _found(w: list[bytes], length: int, k: int) -> np.ndarray:
    return signed(np.unique(routes(hash64(w), length, k)[0])) if len(w) >= length else np.empty(0, np.int64)


def _survey(length: int):
    """A row for each text: how many words, a mark of their sequence, and the routes of its windows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                n, marks, found = [], [], []
                for text in part.column(2).to_pylist():
                    w = _tokens(text)
                    n.append(len(w))
                    marks.append(xxhash.xxh3_128_digest(b" ".join(w)))
                    found.append(_found(w, length, LEVELS[0]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["owner", "mark_of_text", "n", "mark", "found"])

    return run


def _routes(length: int, level: int):
    """The keys and the routes of segments, at a level."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = [_found(_tokens(b), length, LEVELS[level]) for b in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.list_(pa.int64()))], [*part.schema.names[:3], "found"])

    return run


def _segments(length: int, level: int):
    """Of rows (two keys, owner, body, routes): the runs of windows with one of these routes; the words of each, how many,
    and where in the body they start."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                row, kept, starts, sizes, bodies = [], [], [], [], []
                for i, (body, routed) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    w = _tokens(body)
                    route, edges = routes(hash64(w), length, LEVELS[level])
                    ends = np.r_[edges[1:], len(route)]
                    route = signed(route[edges])
                    places: dict[tuple[int, bytes], list[int]] = {}
                    for j in np.flatnonzero(np.isin(route, np.array(routed, np.int64))):
                        places.setdefault((int(route[j]), b" ".join(w[edges[j] : ends[j] - 1 + length])), []).append(int(edges[j]))
                    for (r, b), at in places.items():
                        row.append(i)
                        kept.append(r)
                        starts.append(at)
                        sizes.append(b.count(b" ") + 1)
                        bodies.append(b)
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns[:3]), pa.array(kept, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())], [*part.schema.names[:3], "to", "starts", "size", "body"])

    return run


def _index(length: int):
    """Rows (to, body, owner) in the order of their route: covered ranges of each body, from an index of some routes at a time."""

    def flush(held: list[tuple[int, list[bytes], int, str]]) -> pa.RecordBatch:
        ranges = shared_windows([w for _, w, _, _ in held], np.array([f for _, _, f, _ in held], np.int64), length)
        return pa.RecordBatch.from_arrays([pa.array([r for r, _, _, _ in held], pa.int64()), pa.array([h for _, _, _, h in held]), pa.array([f for _, _, f, _ in held], pa.int64()), pa.array([[list(y) for y in x] for x in ranges], pa.list_(pa.list_(pa.int32())))], ["to", "form", "first", "ranges"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for to, body, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if size >= SHARD_WORDS and to != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append((to, body.split(), first, hashlib.md5(body).hexdigest()))
                size += len(held[-1][1])
        if held:
            yield flush(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            texts, n, gone, spans = [], [], [], []
            for text, copy, ranges in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                w = words(text)
                keep = np.full(len(w), not copy)
                for lo, hi in [] if copy else ranges or ():
                    keep[lo:hi] = False
                edge = np.flatnonzero(np.diff(np.r_[False, ~keep, False].astype(np.int8)))
                spans.append(edge.astype(np.int64))
                n.append(len(w))
                gone.append(int(len(w) - keep.sum()))
                texts.append(b" ".join(w if keep.all() else [x for x, y in zip(w, keep.tolist(), strict=True) if y]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "text", "n_words", "n_removed", "spans"])


def _covered(rows: DataFrame, found: DataFrame, keys: list[str], length: int, level: int = 0) -> DataFrame:
    """keys, ranges: the ranges of words of rows (keys, owner, body) under windows that stand in a row of a smaller owner.

    found: keys, owner and the routes of the windows. A route that one owner alone has is dropped. What is left of a
    body goes, by route, to indexes; equal segments are one there. Routes with more than ROUTE_BYTES of different segments go on
    to the next level, where more of a window's words make its route; so an index is never larger than SHARD_WORDS and one such route.
    """
    name = f"{level}-"
    each = found.select(*keys, "owner", F.explode("found").alias("to"))
    # Written, so that the join with it can split the partition of a route that very many rows have.
    common = staged(each.groupBy("to").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo < hi").select("to"), name + "common")
    routed = staged(each.join(common, "to").groupBy(*keys).agg(F.collect_set("to").alias("routed")), name + "routed")  # at most the windows of a row
    parts = rows.join(routed, keys).select(*keys, "owner", "body", "routed").mapInArrow(_segments(length, level), f"{typed(rows, [*keys, 'owner'])[2:]}, to long, starts array<int>, size int, body binary")
    parts = staged(parts, name + "segments")
    distinct = staged(parts.groupBy("to", "body").agg(F.min("owner").alias("first")), name + "distinct")
    last = level + 1 == len(LEVELS)  # a route has one window here
    hot = staged(distinct.groupBy("to").agg(F.sum(F.length("body")).alias("bytes")).where(F.lit(not last) & (F.col("bytes") > ROUTE_BYTES)).select("to"), name + "hot")
    calm = distinct.join(hot, "to", "left_anti").repartition("to").sortWithinPartitions("to")
    solved = calm.mapInArrow(_index(length), "to long, form string, first long, ranges array<array<int>>")
    again_ = []
    if not hot.isEmpty():
        again = staged(distinct.join(hot, "to", "left_semi").select("to", F.md5("body").alias("hex"), F.col("first").alias("owner"), "body").withColumnRenamed("to", "was"), name + "again")
        deeper = _covered(again, again.mapInArrow(_routes(length, level + 1), "was long, hex string, owner long, found array<long>"), ["was", "hex"], length, level + 1)
        known = again.join(deeper, ["was", "hex"], "left").select(F.col("was").alias("to"), F.col("hex").alias("form"), F.col("owner").alias("first"), "ranges")
        solved = solved.unionByName(known)
        again_ = [again]
    solved = staged(solved, name + "solved")
    discard(common, routed, distinct, hot, *again_)
    met = parts.select(*keys, "owner", "to", "starts", "size", F.md5("body").alias("form")).join(solved, ["to", "form"])
    whole = F.transform("starts", lambda s: F.array(s, s + F.col("size")))
    shifted = F.flatten(F.transform("starts", lambda s: F.transform("ranges", lambda r: F.transform(r, lambda x: x + s))))
    ranges = met.select(*keys, F.when(F.col("owner") > F.col("first"), whole).otherwise(shifted).alias("ranges")).where(F.size("ranges") > 0)
    return ranges.groupBy(*keys).agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def dedup_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, text, n_words, n_removed, spans of documents (doc_id, text) without repeated passages.

    A window of length words goes if its words also stand in a document with a smaller doc_id; text is the words that
    no such window covers, joined by a space, and spans are the starts and ends of what went. Words are separated by
    space and \\x09-\\x0D and compared as they are. Windows are judged on the input. Null and empty texts have no words.
    Rows with a null doc_id take no part and give no row; repeated rows give their rows again. Rows with one doc_id and
    different texts are parts of one document: each is cut by itself, and none by the others. Other columns are ignored.

    Equal word sequences collapse to the smallest doc_id first. Windows are routed by their smallest hash of GRAM words to
    shards, each with an FM-index of bounded size; see _covered. Segments carry the words themselves (those over
    LONG_WORD bytes by SHA-256), so that hashes decide only where windows meet.
    """
    if not GRAM < length < SORTED:
        raise ValueError(f"length must be from {GRAM + 1} to {SORTED - 1}")
    docs = docs.select(F.col("doc_id").cast("long").alias("owner"), F.xxhash64(F.col("text").cast("string")).alias("mark_of_text"), F.col("text").cast("string").alias("body")).where("owner is not null")
    keys = ["owner", "mark_of_text"]
    rows = staged(docs.mapInArrow(_survey(length), "owner long, mark_of_text long, n long, mark binary, found array<long>"), "survey")
    long = rows.where(F.col("n") >= length)
    repeated = staged(long.groupBy("mark").agg(F.min("owner").alias("rep"), F.max("owner").alias("last")).where("rep < last").select("mark", "rep"), "repeated")
    copies = staged(long.join(repeated, "mark").where("owner > rep").select(*keys).distinct().withColumn("copy", F.lit(True)), "copies")
    named = ["id", "mark_of_text"]  # the id of a row, which is also its owner
    alone = long.join(copies, keys, "left_anti").withColumn("id", F.col("owner"))
    ranges = _covered(docs.withColumn("id", F.col("owner")), alone, named, length).withColumnRenamed("id", "owner")
    discard(rows, repeated)
    known = docs.join(copies, keys, "left").join(ranges, keys, "left")
    return known.select(F.col("owner").alias("doc_id"), F.col("body").alias("text"), F.coalesce("copy", F.lit(False)).alias("copy"), "ranges").mapInArrow(_cut, "doc_id long, text string, n_words long, n_removed long, spans array<long>")
