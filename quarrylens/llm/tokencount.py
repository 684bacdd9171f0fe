"""Token counts of a BPE piece model: what is one token as a whole is looked up, only the rest is merged."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.pieces import MARK, NORMAL, SLICE, UNKNOWN, _fields, read_model
from quarrylens.llm.shared import lean, rest, slices, typed

#: The kind of a BPE model in a model file, and of pieces by which texts are cut before they are merged.
BPE, USER, UNUSED = 2, 4, 5
#: Parts whose counts a task remembers, besides those of one slice of texts.
ROOM = 500_000


class Merges:
    """The merges of a model file, on their own: which pieces two neighbours may become, and which of two goes first."""

    def __init__(self, data: bytes):
        top = {key: dict(_fields(value)) for key, value in _fields(data) if key in (2, 3)}
        trained, spec = top.get(2, {}), top.get(3, {})
        pieces = read_model(data)
        if trained.get(3, 1) != BPE or trained.get(24) or spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1) or any(kind in (USER, UNUSED) for *_, kind in pieces):
            raise ValueError("a BPE model is needed that leaves texts as they are, marks the white space before words, and has no pieces of its user")
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.fallback = bool(trained.get(35)) and any(kind == UNKNOWN for *_, kind in pieces)
        inner = any(MARK in p.lstrip(MARK) for p in self.score)
        breaks = any("\n" in p for p in self.score)
        # Neighbours on both sides of these borders stand in no piece, so that no merge goes over them.
        self.parts = re.compile("(?s).+" if inner else f"{MARK}+[^{MARK}]*|[^{MARK}]+" if breaks else f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")

    def merge(self, part: str) -> list[str]:
        """The symbols that are left when no two neighbours are a piece: the pair of the best score goes first, of equal ones the leftmost."""
        score, s = self.score, list(part)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        pairs = [(-score[two], i, len(two)) for i in range(len(s) - 1) if (two := s[i] + s[i + 1]) in score]
        heapq.heapify(pairs)
        while pairs:
            _, left, size = heapq.heappop(pairs)
            right = after[left]
            if not s[left] or right >= len(s) or len(s[left]) + len(s[right]) != size:
                continue  # one of the two has become something else
            s[left], s[right] = s[left] + s[right], ""
            after[left] = after[right]
            if after[left] < len(s):
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < len(s) and (two := s[a] + s[b]) in score:
                    heapq.heappush(pairs, (-score[two], a, len(two)))
        return [x for x in s if x]

    def count(self, part: str) -> int:
        """The tokens of a part; a character without a piece is one token for each of its bytes, and without byte pieces
        a stretch of such characters is one."""
        left = self.merge(part)
        if self.fallback:
            return sum(1 if x in self.score else len(x.encode()) for x in left)
        return sum(x in self.score or i == 0 or left[i - 1] in self.score for i, x in enumerate(left))

    def whole(self) -> list[str]:
        """The pieces that come out as one token when they stand alone: merged here, before any text is read. Some don't,
        because better merges within them lead elsewhere."""
        return [p for p in self.score if self.merge(p) == [p]]


class Table:
    """The merges as numbers, for many parts at once: which symbol two neighbours become and how soon, by binary search."""

    NONE = np.iinfo(np.int32).max
    WIDE = 48  # characters of a part that is merged together with others
    ROWS = 5_000

    def __init__(self, merges: Merges):
        score = merges.score
        names = sorted(score, key=lambda p: -score[p])
        chars = sorted({c for p in names for c in p} - set(names))
        number = {p: i for i, p in enumerate(names + chars)}
        after = len(number)  # four more symbols: characters in no piece, by the bytes they have
        self.weight = np.array([1] * len(names) + [len(c.encode()) for c in chars] + [1, 2, 3, 4], np.int32)
        order = np.cumsum([0] + [score[x] > score[y] for x, y in zip(names, names[1:])]) if names else []
        pairs = sorted((number[p[:i]] << 32 | number[p[i:]], number[p]) for p in names for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.makes = np.array([x for _, x in pairs] + [0], np.int32)
        self.soon = np.append(np.array(order, np.int32)[self.makes[:-1]], np.int32(self.NONE))
        code = np.arange(0x110000)
        self.symbol = (after + np.searchsorted([0x80, 0x800, 0x10000], code, side="right")).astype(np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, the last where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1).astype(np.int32)

    def counts(self, parts: list[str]) -> np.ndarray:
        """Merges.count of parts of up to WIDE characters, for a model with byte pieces: those of a length together, a merge
        in each row at a time."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts, out = np.cumsum(n) - n, np.zeros(len(parts), np.int64)
        order = np.argsort(n, kind="stable")
        for a in range(0, len(order), self.ROWS):
            rows = order[a : a + self.ROWS]
            place = np.arange(int(n[rows[-1]]))
            inside = place < n[rows][:, None]
            out[rows] = self._merged(codes[np.minimum(starts[rows][:, None] + place, len(codes) - 1)], inside)
        return out

    def _merged(self, s: np.ndarray, inside: np.ndarray) -> np.ndarray:
        done = np.zeros(len(s), np.int64)
        rows, left = np.arange(len(s)), inside.sum(1)
        none = np.int32(len(self.keys) - 1)
        pair = np.where(inside[:, 1:], self._pairs(s[:, :-1], s[:, 1:]), none)
        cost = np.where(inside, self.weight[s], np.int32(0))
        place = np.arange(s.shape[1])
        while len(rows):
            soon = self.soon[pair]
            at = soon.argmin(1) if soon.shape[1] else np.zeros(len(rows), np.int64)  # the leftmost of equal ones
            every = np.arange(len(rows))
            live = soon[every, at] < self.NONE if soon.shape[1] else np.zeros(len(rows), bool)
            done[rows[~live]] = cost[~live].sum(1)
            rows, left, s, pair, cost, at = rows[live], left[live] - 1, s[live], pair[live], cost[live], at[live]
            if not len(rows):
                break
            every = every[: len(rows)]
            makes = self.makes[pair[every, at]]
            gone = place[1:] > at[:, None]  # what stands behind the merged pair moves up
            s = np.c_[np.where(place[:-1] > at[:, None], s[:, 1:], s[:, :-1]), s[:, -1:]]
            cost = np.c_[np.where(place[:-1] > at[:, None], cost[:, 1:], cost[:, :-1]), np.zeros((len(rows), 1), np.int32)]
            pair = np.c_[np.where(gone[:, :-1], pair[:, 1:], pair[:, :-1]), np.full((len(rows), 1), none)]
            s[every, at], cost[every, at] = makes, 1
            pair[every, at] = np.where(at + 1 < left, self._pairs(makes, s[every, np.minimum(at + 1, s.shape[1] - 1)]), none)
            ahead = np.flatnonzero(at > 0)
            pair[ahead, at[ahead] - 1] = self._pairs(s[ahead, at[ahead] - 1], makes[ahead])
            most = int(left.max())
            s, cost, pair, place = s[:, :most], cost[:, :most], pair[:, : most - 1], place[:most]
        return done


class Counter:
    """Counts the tokens of texts; each different part is looked up once for many texts."""

    def __init__(self, merges: Merges, whole: list[str]):
        self.merges, self.table = merges, Table(merges) if merges.fallback else None
        self.ones = dict.fromkeys(whole, 1)
        self.known = dict(self.ones)

    def _learn(self, parts: list[str]) -> None:
        """Merges parts that are new."""
        many = [x for x in parts if len(x) <= Table.WIDE] if self.table else []
        if many:
            self.known.update(zip(many, self.table.counts(many).tolist(), strict=True))
        self.known.update((x, self.merges.count(x)) for x in parts if not self.table or len(x) > Table.WIDE)

    def all(self, texts: list[str]) -> np.ndarray:
        parts: list[str] = []
        ends = [0]
        find = self.merges.parts.findall
        for text in texts:
            if text:
                parts += find(MARK + text.replace(" ", MARK))
            ends.append(len(parts))
        if not parts:
            return np.zeros(len(texts), np.int64)
        if len(self.known) > ROOM:  # what is one token as a whole stays
            self.known = dict(self.ones)
        self._learn(list(set(parts).difference(self.known)))
        each = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        return np.diff(np.r_[0, np.cumsum(each)][np.array(ends)])


def _count(held, carry: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, whole = held.value
        counter = Counter(Merges(data), whole)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                n = counter.all([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), *rest(part, carry)], ["doc_id", "n_bytes", "n_tokens", *carry])

    return run


def token_counts(docs: DataFrame, model: str | bytes, limit: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of documents (doc_id, text): what the model's library counts for each whole text.

    model is a BPE model file (or its bytes) that leaves texts as they are; another kind is an error. No tokens of begin or end
    are counted, and the strings of special tokens within a text are text. A null or empty text has no bytes and no tokens.
    over_limit: more than limit tokens. Every row gives a row, repeated ones and those with a null doc_id too; of other
    columns, carry names those that come along.

    Texts are cut where no piece goes across. Which pieces are one token when they stand alone is found on the driver,
    once and without any text; what is sent to the tasks is the model and that list, a vocabulary and not data.
    """
    data = model if isinstance(model, bytes) else Path(model).read_bytes()
    held = docs.sparkSession.sparkContext.broadcast((data, Merges(data).whole()))
    names = [f"c_{c}" for c in carry]
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), *(F.col(c).alias(f"c_{c}") for c in carry))
    out = docs.mapInArrow(_count(held, names), f"doc_id long, n_bytes long, n_tokens long{typed(docs, names)}")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *(F.col(f"c_{c}").alias(c) for c in carry))
