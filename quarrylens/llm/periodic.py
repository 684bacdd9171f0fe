"""Periodic runs of words: planes of bits of word numbers are shifted by each lag, and long stretches without a mismatch stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import U64, lean, mix, rest, slices, typed, words

#: Lags below are shifted one by one; beyond, those at which a block of words recurs.
NEAR = 64
#: Planes after which a lag without a long stretch is given up.
FIRST = 3
SLICE = 4_000_000


def numbered(tokens: list[bytes]) -> np.ndarray:
    """The number of each word among the different ones."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(x, len(known)) for x in tokens], np.int64)


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane j holds bit j of all numbers, that of word i at place i."""
    wide = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> j) & 1, bitorder="little").tobytes(), "little") for j in range(wide)]


def long_ones(bits: int, least: int) -> int:
    """The places at which least ones follow in a row: the stretch that is known to be ones doubles with each step."""
    have = 1
    while bits and 2 * have <= least:
        bits &= bits >> have
        have *= 2
    return bits & (bits >> (least - have)) if have < least else bits


def stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """Start and length of the longest stretches, of least words or more, that equal the words lag further on."""
    full = (1 << (n - lag)) - 1
    differ = 0
    for p in planes[:FIRST]:
        differ |= p ^ (p >> lag)
    at = long_ones((differ & full) ^ full, least)
    if at and len(planes) > FIRST:
        for p in planes[FIRST:]:
            differ |= p ^ (p >> lag)
        at = long_ones((differ & full) ^ full, least)
    out, start = [], 0
    while at:
        skip = (at & -at).bit_length() - 1
        at >>= skip
        more = (~at & (at + 1)).bit_length() - 1
        out.append((start + skip, more + least - 1))
        at >>= more
        start += skip + more
    return out


def _recurring(h: np.ndarray, block: int, n: int, reach: np.ndarray) -> np.ndarray | None:
    """Lags from 2 * block to below 4 * block at which a block that starts at a multiple of its length recurs, ascending;
    None if no stretch of this length comes twice at all. h: hashes of the words from each place on, block of them."""
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    if new.all():
        return None
    group = np.cumsum(new) - 1
    place = group * (n + 1) + order  # ascending
    own = np.empty(len(h), np.int64)
    own[order] = group
    a = np.arange(0, len(h), block)
    base = own[a] * (n + 1)
    lo = np.searchsorted(place, base + np.minimum(a + 2 * block, n))
    hi = np.searchsorted(place, base + np.minimum(a + 4 * block, n))
    many = hi - lo
    at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    a = np.repeat(a, many)
    lag = order[at] - a
    return np.unique(lag[(lag <= n // 2) & (a + lag + block > reach[a])])


def periodic_runs(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """Start, length and period of all runs of numbers, by start and then period.

    A stretch of mismatch-free places of a lag, as long as the lag, is a run of that period unless a shorter one gives the
    same words: a shorter period of as many words divides the lag, so its run has the same ends and came before.

    A run of period q, from 2 * block to below 4 * block, has a stretch of q places, which holds a whole block that starts
    at a multiple of its length: only lags at which such a block recurs can have a run. Each block looks at places within
    its own reach alone, 2n of them for all blocks of a length. Two places in one run of a period up to block are
    left out: a run of another period that shares so many words with it would have the same period.
    """
    n = len(ids)
    if n < least:
        return []
    planes = bit_planes(ids)
    found: dict[tuple[int, int], int] = {}

    def look(lag: int) -> None:
        for start, size in stretches(planes, n, lag, max(least - lag, lag)):
            found.setdefault((start, size + lag), lag)

    for lag in range(1, min(NEAR - 1, n // 2) + 1):
        look(lag)
    h, width, block = mix(ids.astype(U64)), 1, NEAR // 2
    while 2 * block <= n // 2:
        with np.errstate(over="ignore"):
            while width < block:
                h = mix(h[:-width] * U64(3) + h[width:], 7)
                width *= 2
        reach = np.zeros(n, np.int64)
        for (start, size), period in found.items():
            if period <= block:
                reach[start] = max(reach[start], start + size)
        lags = _recurring(h, block, n, np.maximum.accumulate(reach))
        if lags is None:
            break
        for lag in lags.tolist():
            look(lag)
        block *= 2
    return sorted((start, size, period) for (start, size), period in found.items())


def _by_start(runs: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "length": k, "period": q} for s, k, q in sorted(runs, key=lambda r: (r[0], r[2]))]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs(least: int, carry: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE, rows=500):
                n, runs, texts = [], [], []
                for text in part.column(1).to_pylist():
                    own = words(text)
                    found = periodic_runs(numbered(own), least) if own else []
                    kept = np.ones(len(own), bool)
                    for start, size, period in found:
                        kept[start + period : start + size] = False
                    n.append(len(own))
                    runs.append(_by_start(found))
                    texts.append(b" ".join(own if kept.all() else [own[i] for i in np.flatnonzero(kept).tolist()]).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(runs, RUNS), pa.array(texts, pa.string()), *rest(part, carry)], ["doc_id", "n_words", "runs", "text", *carry])

    return run


def collapse_runs(docs: DataFrame, least: int = 12, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, runs, text of documents (doc_id, text): the periodic runs of each whole text, and the text without
    their repeats.

    A word is a stretch outside of space and \\x09-\\x0D. A run is a stretch of words with smallest period q, of at least
    least words and 2 * q, that no neighbouring word extends with that period; runs may overlap. Given are its start (from
    0), length and period, by start and then period. text: the words, joined by one space, without those that any run
    holds behind its first q words. A null or empty text has no words, no runs and an empty text. Every row gives a row,
    repeated ones and those with a null doc_id too; of other columns, carry names those that come along.
    """
    names = [f"c_{c}" for c in carry]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    out = docs.mapInArrow(_runs(least, names), f"doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string{typed(docs, names)}")
    return out.withColumnsRenamed({f"c_{c}": c for c in carry})
