"""Subword pieces: Unigram Viterbi segmentation over a double-array trie, byte fallback, and exact decoding."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import lean, rest, slices, typed

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Bytes of text whose parts are segmented together.
SLICE = 1_500_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {5: 4, 1: 8}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + n]
            at += n


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and kind of each id."""
    out = []
    for key, value in _fields(data):
        if key == 1:
            f = dict(_fields(value))
            out.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie of byte strings: the child of node by byte c is base[node] + c if check says it belongs to node."""

    def __init__(self, keys: dict[bytes, int]):
        trie: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in trie[node]:
                    trie[node][c] = len(trie)
                    trie.append({})
                node = trie[node][c]
            ends[node] = value
        size = 2 * len(trie) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        place, start, todo = {0: 0}, 1, [0]
        for node in todo:
            kids = sorted(trie[node])
            value[place[node]] = ends.get(node, -1)
            if not kids:
                continue
            slot, passed, full = start, 0, 0  # of the first child
            while True:
                if slot + 512 >= len(check):
                    for x, empty in ((base, 0), (check, -1), (value, -1)):
                        x.extend([empty] * len(x))
                passed += 1
                if check[slot] >= 0:
                    full += 1
                elif slot > kids[0] and all(check[slot - kids[0] + c] < 0 for c in kids):
                    break
                slot += 1
            if full > 0.9 * passed:  # a crowded stretch isn't searched again
                start = slot
            at = slot - kids[0]
            base[place[node]] = at
            for c in kids:
                check[at + c] = place[node]
                place[trie[node][c]] = at + c
                todo.append(trie[node][c])
        self.base, self.check, self.value = base, check, value


class Pieces:
    """Encodes and decodes with the pieces of a model; segments between white space are remembered, room of them at most."""

    WIDE = 48  # bytes of a part that is segmented together with others

    def __init__(self, data: bytes, room: int = 400_000):
        self.pieces = read_model(data)
        keys = {p.encode(): i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.trie = DoubleArray(keys)
        self.scores = [s for _, s, _ in self.pieces]
        self.unknown = min(s for _, s, kind in self.pieces if kind == NORMAL) - 10.0
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unk = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.shown = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)
        breaks = any("\n" in p for p, _, _ in self.pieces)
        # No piece goes over these borders, so that the best segmentation is that of the parts.
        self.parts = re.compile("(?s).+" if inner or breaks else f"{MARK}+[^{MARK}\n\0]*|[^{MARK}\n\0]+|\n|\0")
        self.room, self.known = room, {}
        self.bases, self.checks, self.values = (np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.weights = np.array(self.scores)

    def _bytes(self, data: bytes) -> list[int]:
        return [self.byte_ids.get(b, self.unk) for b in data] if self.byte_ids else [self.unk]

    def segment(self, part: str) -> tuple[int, ...]:
        """The ids of the best path: the sum of the scores of its pieces is the largest; of equal ones the last found with longer first pieces stays."""
        if part == "\0":
            return tuple(self._bytes(MARK.encode()))
        s, base, check, value, scores = part.encode("utf-8", "surrogatepass"), self.trie.base, self.trie.check, self.trie.value, self.scores
        n, low = len(s), float("-inf")
        best, back = [low] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here == low:
                continue
            first = s[at]
            wide = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            node, single = 0, False
            for to in range(at, n):
                child = base[node] + s[to]
                if check[child] != node or not child:
                    break
                node = child
                piece = value[node]
                if piece >= 0:
                    if to + 1 - at == wide:
                        single = True
                    total = here + scores[piece]
                    if total > best[to + 1]:
                        best[to + 1], back[to + 1] = total, (at, piece)
            if not single and here + self.unknown > best[at + wide]:
                best[at + wide], back[at + wide] = here + self.unknown, (at, -1)
        out: list[int] = []
        to = n
        while to:
            at, piece = back[to]
            out += self._bytes(s[at:to])[::-1] if piece < 0 else [piece]
            to = at
        return tuple(out[::-1])

    def segment_all(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """segment() of each of many parts: the ids of all in a row and how many each has. Short parts are sorted by length
        and go through the trie together, step by step."""
        starts = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8)
        n = np.diff(starts)
        short = (n > 0) & (n <= self.WIDE) & ~((n == 1) & (data[np.minimum(starts[:-1], len(data) - 1)] == 0))
        sizes = np.zeros(len(parts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # rows, their ids in a row
        order = np.flatnonzero(short)[np.argsort(n[short], kind="stable")]
        again = [np.flatnonzero(~short)]
        for a in range(0, len(order), 20_000):
            mine = order[a : a + 20_000]
            own, longest = n[mine], int(n[mine[-1]])
            place = np.arange(longest)
            text = np.where(place < own[:, None], data[np.minimum(starts[mine][:, None] + place, len(data) - 1)], 0).astype(np.int32)
            ids, count, whole = self._paths(text, own)
            again.append(mine[~whole])
            mine, ids, count = mine[whole], ids[whole], count[whole]
            sizes[mine] = count
            back = ids[:, ::-1]  # the last piece comes first in ids
            done.append((mine, back[np.arange(ids.shape[1])[::-1] < count[:, None]]))
        for k in np.concatenate(again).tolist():
            ids = np.array(self.segment(parts[k].as_py()), np.int32)
            sizes[k] = len(ids)
            done.append((np.array([k]), ids))
        flat, at = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        for rows, ids in done:
            size = sizes[rows]
            flat[np.repeat(at[rows] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        return flat, sizes

    def _paths(self, text: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids from the last to the first, how many, and whether there were pieces for all of a row."""
        rows, longest = text.shape
        best = np.full((rows, longest + 5), -np.inf)
        best[:, 0] = 0.0
        came, piece = np.zeros((rows, longest + 5), np.int16), np.full((rows, longest + 5), -1, np.int32)
        for at in range(longest):
            live = np.flatnonzero((best[:, at] > -np.inf) & (at < n))
            if not len(live):
                continue
            first = text[live, at]
            wide = np.zeros(rows, np.int64)
            wide[live] = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            single, node, on = np.zeros(rows, bool), np.zeros(len(live), np.int32), live
            for to in range(at, longest):
                child = self.bases[node] + text[on, to]
                ok = (self.checks[child] == node) & (child > 0) & (to < n[on])
                on, node = on[ok], child[ok]
                if not len(on):
                    break
                value = self.values[node]
                have = value >= 0
                hit, value = on[have], value[have]
                single[hit[wide[hit] == to + 1 - at]] = True
                total = best[hit, at] + self.weights[value]
                better = total > best[hit, to + 1]
                hit = hit[better]
                best[hit, to + 1], came[hit, to + 1], piece[hit, to + 1] = total[better], at, value[better]
            rest = live[~single[live]]
            end = np.minimum(at + wide[rest], n[rest])
            total = best[rest, at] + self.unknown
            better = total > best[rest, end]
            rest, end = rest[better], end[better]
            best[rest, end], came[rest, end], piece[rest, end] = total[better], at, -1
        out, count, whole = [], np.zeros(rows, np.int64), np.ones(rows, bool)
        every, to = np.arange(rows), n.copy()
        while (to > 0).any():
            own = piece[every, to]
            going = to > 0
            whole &= ~going | (own >= 0)
            out.append(own)
            count += going
            to = np.where(going, came[every, to], 0)
        return np.stack(out, 1), count, whole

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and where each text ends. Parts are numbered, each different one is segmented once,
        and the ids are gathered by number."""
        parts: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                parts += self.parts.findall(MARK + text.replace(MARK, "\0").replace(" ", MARK))
            ends.append(len(parts))
        if not parts:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        flat, sizes = self.segment_all(coded.dictionary)
        number = coded.indices.to_numpy()
        size = sizes[number]
        after = np.cumsum(size)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - (after - size), size) + np.arange(int(after[-1]))]
        return ids, np.r_[0, after][np.array(ends)]

    def encode(self, text: str) -> array:
        """A space becomes the marker, and one stands before the text. A marker of the text itself becomes its bytes
        (a NUL of the text is a byte anyway), so that decoding gives the text back."""
        out = array("i")
        if not text:
            return out
        if "\0" in text:
            for k, x in enumerate(text.split("\0")):
                out.extend([self.byte_ids.get(0, self.unk)] if k else [])
                out.extend(self.encode(x) if not k else self._encode(x.replace(MARK, "\0").replace(" ", MARK)))
            return out if text[0] != "\0" else array("i", self.segment(MARK)) + out
        out.extend(self._encode(MARK + text.replace(MARK, "\0").replace(" ", MARK)))
        return out

    def _encode(self, marked: str) -> array:
        out, known = array("i"), self.known
        for part in self.parts.findall(marked):
            ids = known.get(part)
            if ids is None:
                if len(known) >= self.room:
                    known.clear()
                ids = known[part] = self.segment(part)
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        shown = self.shown
        data = b"".join([shown[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _ids(pieces: Pieces, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts in a batch, in a row, and where each text's end."""
    texts = [x or "" for x in part.column(1).to_pylist()]
    odd = {i: pieces.encode(x) for i, x in enumerate(texts) if "\0" in x}
    ids, ends = pieces.encode_all(["" if i in odd else x for i, x in enumerate(texts)])
    for i, own in odd.items():
        ids = np.concatenate([ids[: ends[i]], np.frombuffer(own, np.int32), ids[ends[i] :]])
        ends[i + 1 :] += len(own)
    return ids, ends


def _texts(pieces: Pieces, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([pieces.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def _encode(held, carry: list[str], back: bool = False):
    """back: the decoded text too."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids, ends = _ids(pieces, part)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                more = [_texts(pieces, ids, ends)] if back else []
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *more, *rest(part, carry)], ["doc_id", "ids", *["decoded"] * back, *carry])

    return run


def _decode(held, carry: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(1)
                flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, _texts(pieces, flat, ends), *rest(part, carry)], ["doc_id", "ids", "decoded", *carry])

    return run


def _model(df: DataFrame, model: str | bytes):
    return df.sparkSession.sparkContext.broadcast(model if isinstance(model, bytes) else Path(model).read_bytes())  # a vocabulary, not data


def encode(docs: DataFrame, model: str | bytes = DEFAULT_MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids of documents (doc_id, text): the ids of the best segmentation of each whole text.

    The score of a segmentation is the sum of the scores of its pieces in the model file (a path, or its bytes);
    characters without a piece become byte pieces. A null or empty text has no ids. Every row gives a row, repeated
    ones and those with a null doc_id too; of other columns, carry names those that come along.
    """
    names = [f"c_{c}" for c in carry]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    out = docs.mapInArrow(_encode(_model(docs, model), names), f"doc_id long, ids array<int>{typed(docs, names)}")
    return out.withColumnsRenamed({f"c_{c}": c for c in carry})


def decode(encoded: DataFrame, model: str | bytes = DEFAULT_MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, decoded of encoded (doc_id, ids): the text behind the ids; null ids give an empty text. For ids
    that encode gave, it is the text that was encoded."""
    names = [f"c_{c}" for c in carry]
    encoded = encoded.select("doc_id", "ids", *(F.col(c).alias(f"c_{c}") for c in carry))
    out = encoded.mapInArrow(_decode(_model(encoded, model), names), f"doc_id long, ids array<int>, decoded string{typed(encoded, names)}")
    return out.withColumnsRenamed({f"c_{c}": c for c in carry})


def round_trip(docs: DataFrame, model: str | bytes = DEFAULT_MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, decoded: encode() and then decode() in one pass, with one Python worker a task and not two."""
    names = [f"c_{c}" for c in carry]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    out = docs.mapInArrow(_encode(_model(docs, model), names, back=True), f"doc_id long, ids array<int>, decoded string{typed(docs, names)}")
    return out.withColumnsRenamed({f"c_{c}": c for c in carry})
