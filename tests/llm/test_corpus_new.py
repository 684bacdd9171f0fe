"""Centroids, periodic runs and token counts: brute force, edges, and each method's own parts."""

import itertools
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quarrylens.llm import centroids, periodic, pieces, queries, tokencount
from test_corpus_edges import ODD, nothing, odd  # noqa: F401


def plain_runs(x, least=12):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("near", [1 << 30, 64, 4])
def test_runs_against_all_lags(monkeypatch, near):
    """Nested and overlapping runs of all lengths; with near, lags are tried one by one up to there, and by recurring blocks beyond."""
    monkeypatch.setattr(periodic, "NEAR", near)
    r = random.Random(near)
    for _ in range(150):
        x, size = [], r.randint(0, 500)
        while len(x) < size:
            own = [r.randrange(r.choice([1, 2, 3, 1000])) for _ in range(r.choice([1, 2, 5, 20, 70, 150]))]
            x += (own * r.randint(1, 6))[: r.randint(1, 400)]
            x += x[-r.randint(1, len(x)) :] if r.random() < 0.3 else []
        assert periodic.periodic_runs(periodic.numbered([str(v).encode() for v in x])) == plain_runs(x)


def test_runs_of_long_texts():
    """Lags of thousands of words, found among a million."""
    r = random.Random(5)
    word = [r.randrange(1 << 40) for _ in range(250_000)]
    text = [r.randrange(1 << 40) for _ in range(200_000)] + word * 3 + [7] * 50
    assert periodic.periodic_runs(np.unique(text, return_inverse=True)[1]) == [(200_000, 750_000, 250_000), (950_000, 50, 1)]


def test_long_ones_doubles():
    r = random.Random(1)
    for _ in range(300):
        bits, least = r.getrandbits(90) | r.getrandbits(90), r.randint(1, 20)
        assert periodic.long_ones(bits, least) == sum(1 << i for i in range(91) if all(bits >> j & 1 for j in range(i, i + least)))


def test_runs_edges(spark, odd, nothing):  # noqa: F811
    got = {r["doc_id"]: r for r in periodic.collapse_runs(odd, carry=("kept",)).collect()}
    assert len(got) == len({k for k, _ in ODD}) and periodic.collapse_runs(odd).count() == len(ODD) and periodic.collapse_runs(nothing).count() == 0
    assert [(x["start"], x["length"], x["period"]) for x in got[6]["runs"]] == [(0, 60_000, 1)] and got[6]["text"] == "x"
    assert got[1]["runs"] == got[2]["runs"] == [] and got[1]["text"] == got[3]["text"] == "" and got[10]["n_words"] == 3 and got[8]["kept"] == "x"
    twice = spark.createDataFrame([(1, "a b c d e f " * 2 + "z " * 12 + "q")], "doc_id long, text string")
    row = periodic.collapse_runs(twice).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 12, 6), (12, 12, 1)] and row["text"] == "a b c d e f z q"


def test_turned_texts(spark):
    """One document in ten goes on in a circle, as the plain rule has it; null, empty and repeated rows keep theirs."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(k % 90))) for k in range(300)] + [(3, None), (None, "a b"), (7, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in queries.with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)

    def turned(key, text):
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        w, g = (text or "").split(), h // 10
        if h % 10 or not w:
            return text
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(len(w)))

    assert got == sorted(((k, turned(k, t)) for k, t in rows), key=str)


def plain_lloyd(x, ids, k, rounds):
    import hashlib

    order = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest())[:k]
    c = [x[i] for i in order]
    near = lambda: [min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True)), j)) for v in x]
    for _ in range(rounds):
        at = near()
        for j in range(len(c)):
            own = [v for v, a in zip(x, at, strict=True) if a == j]
            c[j] = [sum(d) // len(own) for d in zip(*own, strict=True)] if own else c[j]
    return near(), c


@pytest.mark.parametrize(("seed", "block", "k"), [(1, 2048, 8), (2, 40, 8), (3, 2048, 3), (4, 7, 30)])
def test_lloyd_against_plain_rounds(spark, seed, block, k):
    """Groups of vectors of every width, many of them equal, so that centroids tie and stay empty."""
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(r.normal(0, 8, 4), s, (40, 4)) for s in (0.01, 0.3, 3, 0)] + [np.repeat(r.integers(-2, 3, (3, 4)), 30, 0)])
    ids = r.permutation(len(x)).tolist()
    v = spark.createDataFrame([(i, row.tolist(), "x") for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, cluster string").repartition(3)
    got, final = centroids.lloyd(v, k=k, rounds=4, scale=1.0, dim=4, block=block)
    whole = np.floor(x).astype(int).tolist()
    labels, want = plain_lloyd(whole, ids, k, 4)
    assert final == want
    assert {(r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()} == {(i, a, sum((p - q) ** 2 for p, q in zip(v, want[a], strict=True))) for i, a, v in zip(ids, labels, whole, strict=True)}


def test_lloyd_edges(spark):
    good = [float(i) for i in range(4)]
    rows = [(1, good), (2, None), (3, []), (4, good[:3]), (5, [None, *good[:3]]), (6, [float("nan"), *good[:3]]), (7, [float("inf"), *good[:3]]), (None, good), (1, good)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, final = centroids.lloyd(v, k=8, rounds=2, dim=4)
    assert [tuple(r) for r in got.collect()] == [(1, 0, 0)] * 2 and final == [[1024 * i for i in range(4)]] * 2  # ties go to the smaller number
    none, final = centroids.lloyd(v.limit(0), dim=4)
    assert none.count() == 0 and none.columns == got.columns and final == []
    with pytest.raises(Exception, match="beyond"):
        centroids.lloyd(v.unionByName(spark.createDataFrame([(9, [1e9] * 4)], "vec_id long, embedding array<double>")), dim=4)


def test_cover_tree():
    """Children lie within half the reach of their node, apart from each other, and every point is in one leaf."""
    r = np.random.default_rng(7)
    x = np.floor(np.concatenate([r.normal(m, s, (200, 3)) for m, s in ((0, 1), (50, 5), (900, 40))]) * 10)
    tree, order = centroids.cover_tree(x, 4)
    y = x[order]
    far = lambda a, b: np.sqrt(((a - b) ** 2).sum(-1))
    leaves = []
    for i in range(len(tree.at)):
        assert far(y[tree.lo[i] : tree.hi[i]], y[tree.at[i]]).max() == pytest.approx(tree.radius[i])
        kids = range(tree.first[i], tree.first[i] + tree.kids[i])
        if not len(kids):
            leaves.append((tree.lo[i], tree.hi[i]))
            assert tree.hi[i] - tree.lo[i] <= 4 or tree.radius[i] == 0
            continue
        reach = 2.0 ** (np.ceil(np.log2(tree.radius[i])) - 1)
        assert all(tree.radius[k] <= reach for k in kids) and sorted(range(tree.lo[i], tree.hi[i])) == sorted(p for k in kids for p in range(tree.lo[k], tree.hi[k]))
        assert all(far(y[tree.at[a]], y[tree.at[b]]) > reach for a, b in itertools.combinations(kids, 2)) and tree.at[i] in [tree.at[k] for k in kids]
    assert sum(b - a for a, b in leaves) == len(x)


def test_node_pairs_are_pruned():
    """Of vectors in far groups few distances are computed, and whole nodes are assigned."""
    r = np.random.default_rng(9)
    groups = r.integers(-10**6, 10**6, (20, 8))
    x = (groups[:, None] + r.integers(-50, 50, (20, 100, 8))).reshape(-1, 8)
    tree, order = centroids.cover_tree(x)
    y, ctree = x[order], centroids.cover_tree(groups, 1)
    whole, at, own, computed = centroids.nearest(y, tree, groups, *ctree)
    label = np.full(len(y), -1)
    label[at] = own
    for a, b, c in whole:
        label[a:b] = c
    assert (label == ((y[:, None] - groups) ** 2).sum(2).argmin(1)).all() and computed < len(y) and max(b - a for a, b, _ in whole) == 100


def test_whole_tokens_are_proved():
    """Pieces that better merges within them take apart aren't in the list; the others are one token as the library counts."""
    merges = tokencount.Merges(open(pieces.DEFAULT_MODEL, "rb").read())
    whole = set(merges.whole())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    for p in random.Random(1).sample(sorted(whole), 3000):
        if p.startswith("▁") and p != "▁":
            assert len(sp.encode(p[1:].replace("▁", " "))) == 1, p
    apart = tokencount.Merges(open(pieces.DEFAULT_MODEL, "rb").read())
    apart.score = {"a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0, "bc": -1.0, "ab": -2.0, "cd": -3.0, "abcd": -9.0}
    assert apart.merge("ab") == ["ab"] and apart.merge("abcd") == ["a", "bc", "d"] and "abcd" not in apart.whole()


def test_token_counts_are_those_of_the_library(spark, sf, odd, nothing):  # noqa: F811
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    docs = {k: t or "" for k, t in zip(*(pq.read_table(f"{sf}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")), strict=True)}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_counts(spark, sf).collect()}
    assert got == {k: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for k, t in docs.items()}
    rows = tokencount.token_counts(odd, pieces.DEFAULT_MODEL, carry=("text", "kept")).collect()
    assert len(rows) == len(ODD) and all(r["n_tokens"] == len(sp.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode()) for r in rows)
    assert tokencount.token_counts(nothing, pieces.DEFAULT_MODEL).count() == 0


def test_merges_of_odd_texts():
    """Special strings, markers, control characters, characters without a piece and long parts, in both ways to merge."""
    merges = tokencount.Merges(open(pieces.DEFAULT_MODEL, "rb").read())
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    r, bits = random.Random(2), ["a", "b", "the", "▁", " ", "  ", "\0", "\n", "\r", "\t", "<s>", "</s>", "<unk>", "<0x0A>", "😀", "é", "中", "ing", ".", "​", "﻿", "x" * 50, "é", "Ж"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", " ", "▁", "\n", "\0", "ab" * 5000]
    counter = tokencount.Counter(merges, merges.whole())
    assert counter.all(texts).tolist() == [len(sp.encode(t)) for t in texts]
    for text in texts[:300]:
        parts = merges.parts.findall("▁" + text.replace(" ", "▁")) if text else []
        assert sum(map(merges.count, parts)) == len(sp.encode(text))


def test_other_models_are_an_error(spark):
    with pytest.raises(ValueError, match="BPE"):
        tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string"), b"")
