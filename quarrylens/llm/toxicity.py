"""Toxicity: disguised words are restored by a noisy-channel decoder, then texts are scored by learned word features."""

from __future__ import annotations

import functools
import re
import string
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import lean, rest, slices, typed

ORDER, SYMBOLS = 4, 32
SLICE = 4_000_000  # bytes of text at once
BORDER, MASK = 0, 32**3 - 1
#: The letters that signs can stand for, and signs that can stand between the letters of a word.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
BETWEEN = " .-_*'~·"
#: Log-probabilities of the channel: a sign for a letter, a star for any letter, a sign between letters, a letter written
#: again and again, one written twice, a break kept.
SIGN, STAR, GAP, AGAIN, TWICE, BREAK = -1.0, -3.0, -0.7, -0.5, -4.0, -1.0
#: More stars in a row than this are no letters. From so many transitions on a step of the search is taken over all states at once.
STARS, DENSE = 16, 3000
#: Spans up to this length are remembered.
SHORT = 100
CROWD = re.compile(r"\*{%d,}" % (STARS + 1))
PREFIXES = (3, 4, 5, 6, 7)
TIMES = (2, 3, 5)


def _symbol_table() -> np.ndarray:
    """Letters up to U+024F by their base letter, 1 to 26; 0 for what is no letter, 27 for other letters."""
    out = np.zeros(0x250, np.int64)
    for code in range(0x250):
        base = unicodedata.normalize("NFD", chr(code).lower())[:1]
        out[code] = ord(base) - 96 if "a" <= base <= "z" else 27 if chr(code).isalpha() else BORDER
    return out


TABLE = _symbol_table()
LETTERS = " abcdefghijklmnopqrstuvwxyz?"


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 0x250, TABLE[np.minimum(codes, 0x24F)], 27)
    keep = (out != BORDER) | np.r_[True, out[:-1] != BORDER]
    return out[keep]


def count_grams(text: str) -> np.ndarray:
    """Cells of all 4-grams of a text whose words are kept apart by one border."""
    s = np.r_[[BORDER] * (ORDER - 1), symbols(text), BORDER]
    cell = np.zeros(len(s) - ORDER + 1, np.int64)
    for i in range(ORDER):
        cell = cell * SYMBOLS + s[i : i + len(cell)]
    return cell


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**ORDER, np.int64)
    for part in (x for batch in batches for x in slices(batch, 0, SLICE)):
        for text in part.column(0).to_pylist():
            if text:
                cells = count_grams(text)
                if len(cells) > 200_000:
                    total += np.bincount(cells, minlength=len(total))
                else:
                    at, n = np.unique(cells, return_counts=True)
                    total[at] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities of a symbol after three others, from the counts over all texts; 2^20 cells at most."""
    counts = docs.select("text").mapInArrow(_gram_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # as many rows as there are cells at most
    n = np.zeros(SYMBOLS**ORDER)
    n[got["cell"].to_numpy()] = got["n"].to_numpy()
    n = n.reshape((SYMBOLS,) * ORDER)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for width in range(1, ORDER + 1):
        c = n.sum(axis=tuple(range(ORDER - width))) if width < ORDER else n
        p = (c + 2.0 * p) / (c.sum(-1, keepdims=True) + 2.0)
    return np.log(p).astype(np.float32).ravel()


@functools.lru_cache(4096)
def _base(ch: str) -> str:
    return unicodedata.normalize("NFD", ch)[:1]


#: Arcs are the symbol that is written (None: nothing) and a log-probability; these are shared by all lattices.
ONE = [[(x, 0.0)] for x in range(28)]
ANY = [(None, GAP), (BORDER, BREAK), *((x, STAR) for x in range(1, 27))]


def lattice(token: str) -> list[list[tuple[int | None, float]]]:
    """For each character of a token in lower case what it may stand for.

    A letter is its base letter, or nothing where it repeats the one before. A sign of LEET is one of its letters; signs
    that end the token may also be a break. A sign of BETWEEN is nothing or a break, and a star any letter too, unless
    more than STARS of them stand in a row: no word hides so many letters. Other letters are one symbol, other
    characters a break.
    """
    token, out, last = token.lower(), [], ""
    closing = len(token.rstrip("!$"))
    crowded = {i for m in CROWD.finditer(token) for i in range(*m.span())}
    for at, ch in enumerate(token):
        base = ch if "a" <= ch <= "z" else _base(ch)
        if "a" <= base <= "z":
            arcs = ONE[ord(base) - 96]
            if base == last:
                arcs = [*arcs, (None, AGAIN if ch * 3 in token[max(0, at - 2) : at + 3] else TWICE)]
            last = base
        else:
            if ch in LEET:
                arcs = [(ord(x) - 96, SIGN) for x in LEET[ch]]
                if ch == last:
                    arcs.append((None, AGAIN if ch * 3 in token[max(0, at - 2) : at + 3] else TWICE))
                if at >= closing:
                    arcs.append((BORDER, BREAK))  # at the end it may be no letter
            elif ch == "*" and at not in crowded:
                arcs = ANY
            elif ch in BETWEEN:
                arcs = ANY[:2]
            else:
                arcs = ONE[27 if ch.isalpha() else BORDER]
            last = ch
        out.append(arcs)
    return out


def _step(states: list[int], scores: list[float], arcs: list, lm: np.ndarray | array) -> tuple[list[int], list[float], list[int], list[int]]:
    """One step of the search: the states that follow, their scores, the places of what came before, the symbols (-1: none)."""
    place: dict[int, int] = {}
    best, before, written = [], [], []
    for i, state in enumerate(states):
        for symbol, cost in arcs:
            if symbol is None or not symbol and not state & 31:
                to, value, symbol = state, scores[i] + cost, -1
            else:
                to, value = (state * SYMBOLS + symbol) & MASK, scores[i] + cost + lm[state * SYMBOLS + symbol]
            at = place.setdefault(to, len(best))
            if at == len(best):
                best.append(value)
                before.append(i)
                written.append(symbol)
            elif best[at] < value:
                best[at], before[at], written[at] = value, i, symbol
    return list(place), best, before, written


def _dense_step(states: list[int], scores: list[float], arcs: list, lm: np.ndarray | array) -> tuple[list[int], list[float], list[int], list[int]]:
    """_step over all states at once."""
    width = SYMBOLS**3
    now, place = np.full(width, -np.inf), np.zeros(width, np.int64)
    now[states], place[states] = scores, np.arange(len(states))
    every, ends = np.arange(width), np.arange(width) % SYMBOLS == BORDER
    best, before, symbol = np.full(width, -np.inf), np.zeros(width, np.int64), np.full(width, -1)
    for quiet, cost in [(ends, c) for x, c in arcs if x == BORDER] + [(True, c) for x, c in arcs if x is None]:
        better = quiet & (now + cost > best)
        best[better], before[better], symbol[better] = (now + cost)[better], every[better], -1
    written = [(x, c) for x, c in arcs if x is not None]
    if written:
        x, cost = (np.array(v) for v in zip(*written, strict=True))
        grid = (now[:, None] + np.asarray(lm).reshape(width, SYMBOLS)[:, x] + cost).reshape(SYMBOLS, -1, len(x))
        if BORDER in x:
            grid[:, np.arange(width // SYMBOLS) % SYMBOLS == BORDER, x == BORDER] = -np.inf
        first, value = grid.argmax(0), grid.max(0)
        rest = np.arange(width // SYMBOLS)[:, None]
        to, came = rest * SYMBOLS + x, first * (width // SYMBOLS) + rest
        better = value > best[to]
        best[to[better]], before[to[better]], symbol[to[better]] = value[better], came[better], np.broadcast_to(x, to.shape)[better]
    alive = np.flatnonzero(best > -np.inf)
    return alive.tolist(), best[alive].tolist(), place[before[alive]].tolist(), symbol[alive].tolist()


def decode(token: str, lm: np.ndarray | array) -> str:
    """The most likely text behind a token: the best path through its lattice under the model, by Viterbi search.

    A state is the last three symbols. Where only one is left, what led to it is decided and given out, so that a long
    token costs time in proportion to its length, and memory to the longest stretch in which readings differ.
    """
    out, state, at, steps = [], 0, 0, lattice(token)
    while at < len(steps):
        if len(steps[at]) == 1:  # one state, and one way on
            symbol = steps[at][0][0]
            if symbol != BORDER or state & 31:
                state = (state * SYMBOLS + symbol) & MASK
                out.append(symbol)
            at += 1
            continue
        states, scores, back = [state], [0.0], []
        while at < len(steps) and (len(states) > 1 or not back):
            states, scores, *way = (_dense_step if len(states) * len(steps[at]) > DENSE else _step)(states, scores, steps[at], lm)
            back.append(way)
            at += 1
        if at == len(steps):
            scores = [score + (float(lm[x * SYMBOLS]) if x & 31 else 0.0) for x, score in zip(states, scores, strict=True)]
        best = scores.index(max(scores))
        state, path = states[best], []
        for before, written in reversed(back):
            path.append(written[best])
            best = before[best]
        out += [x for x in reversed(path) if x >= 0]
    return "".join(LETTERS[x] for x in out).strip()


#: Letters and signs for letters, one by one, with one or two signs between.
SPACED = re.compile(r"(?<![^\W_])(?:(?:[^\W_]|[@$!|+(€£¡])[ .\-_*'~·]{1,2}){2,}(?:[^\W_]|[@$!|+(€£¡])(?![^\W_])")
DOUBLED = re.compile(r"([a-z])\1", re.I)
EDGE = "\"'`.,;:?#%&*=<>{}[])\\/~^_-"
SIGNED = re.compile(r"[^\W\d_]")
#: Letters with marks and their base letters.
PLAIN = {code: LETTERS[TABLE[code]] for code in range(128, 0x250) if 0 < TABLE[code] < 27}


def _byte_table(chars: str, beyond: int) -> np.ndarray:
    """Which first bytes of characters may be one of chars; all from beyond on."""
    out = np.zeros(256, bool)
    out[[x.encode()[0] for x in chars]] = True
    out[beyond:] = True
    return out


ALNUM = _byte_table(string.ascii_letters + string.digits, 256)
UNITS = _byte_table(string.ascii_letters + string.digits + "".join(LEET), 128)
SIGNS = _byte_table(BETWEEN, 256)


def may_be_spaced(text: str) -> bool:
    """Whether SPACED can match; true too often rather than too seldom."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    b = np.r_[b[(b & 0xC0) != 0x80], np.zeros(6, np.uint8)]  # first bytes of characters
    unit, sign, n = UNITS[b], SIGNS[b], len(b) - 6
    one = sign[1 : n + 4] & unit[2 : n + 5]
    two = sign[1 : n + 4] & sign[2 : n + 5] & unit[3 : n + 6]
    hop = one | two
    start = unit[:n] & ~np.r_[False, ALNUM[b]][:n]
    return bool((start & (one[:n] & hop[2 : n + 2] | two[:n] & hop[3 : n + 3])).any())


def suspects(text: str) -> set[str]:
    """Spans of a text that may hide a word: letters mixed with signs, letters apart, words with a letter twice in a row.
    Signs at the edges of a token don't count."""
    found = set()
    for core in set(text.split()):
        if not core.isalpha():
            core = core.strip(EDGE)
            if not core.isalpha():
                if SIGNED.search(core):
                    found.add(core)
                continue
        if DOUBLED.search(core if core.isascii() else core.translate(PLAIN)):
            found.add(core)
    if may_be_spaced(text):
        found.update(m.group() for m in SPACED.finditer(text))
    return found


class Decoder:
    """Decodes spans under a model and remembers a bounded number of short ones."""

    def __init__(self, lm: np.ndarray, room: int = 400_000):
        self.lm, self.room, self.known = array("f", lm.astype(np.float32).tobytes()), room, {}

    def __call__(self, span: str) -> str | None:
        """What a span reads as, None if that is what stands there."""
        if span in self.known:
            return self.known[span]
        out = decode(span, self.lm)
        out = None if out.split() == WORD.findall(fold(span)) else out
        if len(span) <= SHORT:
            if len(self.known) >= self.room:
                self.known.clear()
            self.known[span] = out
        return out


_decoders: dict[int, Decoder] = {}


def decoder_of(lm: np.ndarray) -> Decoder:
    """The decoder under a model; a worker keeps the last one, so that its next tasks know what has been decoded."""
    key = xxhash.xxh3_64_intdigest(lm.tobytes())
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(lm)
    return _decoders[key]


WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.lower()


def stem(feature: str) -> str:
    """What a text must hold to have the feature."""
    return feature.split("#")[0].rstrip("$")


def features(text: str, restored: set[str]) -> set[str]:
    """Words, marked by a closing $, prefixes, and prefixes that come several times (#2), of the text and of what was restored from it."""
    found = Counter(WORD.findall(fold(text)))
    for x in restored:
        found.update(x.split())
    heads: Counter = Counter()
    for w, n in found.items():
        for k in PREFIXES:
            if len(w) >= k:
                heads[w[:k]] += n
    return {f"{w}$" for w in found} | set(heads) | {f"{p}#{k}" for p, n in heads.items() if n > 1 for k in TIMES if n >= k}


@dataclass
class Model:
    """weights: the chance that a text with the feature is toxic; base: that of a text without any."""

    lm: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    base: float = 0.05

    def score(self, text: str, restored: set[str]) -> float:
        low, hidden = fold(text), " ".join(restored)
        stems = [f for f in self.weights if stem(f) in low or stem(f) in hidden]
        clean = 1 - self.base
        if stems:
            have = features(text, restored)
            for f in stems:
                if f in have:
                    clean *= 1 - self.weights[f]
        return 1 - clean


def _restored(text: str, decoder: Decoder) -> set[str]:
    """What suspects of a text read as, where that isn't what stands there."""
    return {y for x in suspects(text) if (y := decoder(x)) is not None} if text else set()


def _counts(model) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, n = decoder_of(model.value), (Counter(), Counter())
        for part in (x for batch in batches for x in slices(batch, 1, SLICE)):
            for text, toxic in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                n[toxic].update(features(text or "", _restored(text or "", decoder)))
        keys = list(n[1])  # what no toxic text has is no sign of toxicity
        rest = [k for k in n[0] if k not in n[1]]
        for i in range(0, len(keys) + len(rest), 50_000):
            part = (keys + rest)[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[1][k] for k in part], pa.int64()), pa.array([n[0][k] for k in part], pa.int64())], ["feature", "toxic", "clean"])

    return run


def _incidence(model, place) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(model.value)
        for part in (x for batch in batches for x in slices(batch, 1, SLICE)):
            out = [sorted(place.value[f] for f in features(t or "", _restored(t or "", decoder)) if f in place.value) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array(out, pa.list_(pa.int32()))], ["toxic", "have"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_toxic: int = 10_000, max_clean: int = 20_000, max_candidates: int = 20_000, max_incidence: int = 10_000_000, max_features: int | None = None) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic); train says which doc_id may be learned from.

    The character model counts all texts. The features are learned from a bounded sample of the labelled rows: the
    max_toxic and max_clean ones of the lowest hash of doc_id. Clean rows are weighed by how many labelled ones each
    stands for next to a toxic one, so that the mix is that of all labels. Of the features that stand almost only in toxic texts
    those are taken, one by one, that explain most of the toxic texts not explained so far, so that a word that is
    only frequent among copies of one toxic text isn't taken for a sign. Null labels are no labels. The driver holds
    the texts of the candidates: the max_candidates that most toxic texts have, and of these as many as stand
    max_incidence times in the sample.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lm = spark.sparkContext.broadcast(language_model(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(train) if train is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    picked = spark.createDataFrame(picked.toArrow())  # max_toxic + max_clean rows at most
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = {k: min(1.0, most / max(1, size.get(k, 0))) for k, most in ((1, max_toxic), (0, max_clean))}
    mix = rate[1] / rate[0]  # clean rows for each sampled one, where a sampled toxic one counts as one
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    stats = rows.mapInArrow(_counts(lm), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    best = stats.where((F.col("t") >= 3) & (F.col("t") >= F.lit(9 * mix) * F.col("c"))).orderBy(F.desc("t"), F.desc(F.length("feature")), "feature").limit(max_candidates).collect()
    held = np.cumsum([r["t"] + r["c"] for r in best])
    best = best[: int(np.searchsorted(held, max_incidence, "right"))]  # known before they are gathered
    place = spark.sparkContext.broadcast({r["feature"]: i for i, r in enumerate(best)})
    got = rows.mapInArrow(_incidence(lm, place), "toxic int, have array<int>").toArrow()
    texts = [(x, t) for x, t in zip(got["have"].to_pylist(), got["toxic"].to_pylist(), strict=True)]
    holders: list[list[int]] = [[] for _ in best]
    for i, (have, toxic) in enumerate(texts):
        for f in have if toxic else ():
            holders[f].append(i)
    n_toxic, chosen, stems = sum(t for _, t in texts), [], [stem(r["feature"]) for r in best]
    for least in (max(4, n_toxic // 200), max(8, n_toxic // 50)):  # once for every toxic text, then again for its other signs
        left = np.array([t == 1 for _, t in texts], bool)
        gain = np.array([len(h) for h in holders], np.int64)
        barred = set()  # a longer or shorter form of a chosen stem is the same sign
        for f in chosen:
            barred |= {g for g, x in enumerate(stems) if x.startswith(stems[f]) or stems[f].startswith(x)}
        gain[list(barred)] = -len(texts)
        while (max_features is None or len(chosen) < max_features) and len(gain) and gain[f := int(gain.argmax())] >= least:
            chosen.append(f)
            gain[[g for g, x in enumerate(stems) if x.startswith(stems[f]) or stems[f].startswith(x)]] = -len(texts)
            for i in holders[f]:
                if left[i]:
                    left[i] = False
                    for g in texts[i][0]:
                        gain[g] -= 1
    weights = {best[f]["feature"]: (best[f]["t"] + 0.5) / (best[f]["t"] + 0.5 + mix * (best[f]["c"] + 0.5)) for f in chosen}
    taken = set(chosen)
    unexplained = [t for have, t in texts if not taken & set(have)]
    toxic = sum(unexplained) + 0.5
    return Model(lm.value, weights, toxic / (toxic + mix * (len(unexplained) - sum(unexplained) + 9.5)))


def _score(model, carry: list[str]) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        decoder = decoder_of(m.lm)
        for part in (x for batch in batches for x in slices(batch, 1, SLICE)):
            scores, shown = [], []
            for text in part.column(1).to_pylist():
                restored = _restored(text or "", decoder)
                scores.append(min(1.0, max(0.0, m.score(text or "", restored))))
                shown.append(sorted(restored))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(shown, pa.list_(pa.string())), *rest(part, carry)], ["doc_id", "score", "restored", *carry])

    return run


def toxicity(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, restored of documents (doc_id, text): the chance that a text is toxic, and what was restored.

    Spans that may hide a word (letters mixed with signs, single letters apart, a letter twice in a row) are decoded by
    Viterbi search over the lattice of their readings under the character model; words of the text and of the decoded
    spans are then looked up among the learned features, each an independent cause. Tokens of any length are decoded as
    one lattice, in time that grows with their length. Null and empty texts have the base chance. Every row gives a row, repeated ones and those with a null doc_id too; of other columns, carry names those that come along.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    names = [f"c_{c}" for c in carry]
    out = docs.mapInArrow(_score(held, names), f"doc_id long, score double, restored array<string>{typed(docs, names)}")
    return out.withColumnsRenamed({f"c_{c}": c for c in carry})
