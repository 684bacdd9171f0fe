"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and each operator's own ideas."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylens.llm import arc, chat, components, decontam, linededup, minhash, pieces, quality, queries, substring, topk, toxicity

WORDS = "alpha bravo carol delta eagle fancy gamma hotel india joker kappa lemon mango noble ocean pilot queen robin sugar tango".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a" * 200_000), (6, "x " * 60_000), (None, "no id"), (7, "one"), (7, "one"), (8, prose(1, 300)), (9, prose(1, 300)), (10, "\0 ▁ é😀\r\n")]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with odd texts, and columns named as those that operators make."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "h", "rep", "key", "route", "score", "ids", "kept", "first", "lang", "source")}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def test_minhash_edges(odd, nothing):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, 3, 85).collect()}
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert (7, 1, 4, False) in got and (9, 298, 8, False) in got and (6, 1, 6, True) in got
    assert all(x[0] is not None for x in got) and minhash.near_duplicates(odd, 3, 85).count() == len(ODD) - 1
    assert minhash.near_duplicates(nothing).count() == 0


def test_minhash_chain(spark):
    """Links go through documents in between, and copies share a class."""
    base = prose(5, 200).split()
    texts = [" ".join(base[:i] + [f"new{k}" for k in range(i)] + base[i:]) if i else " ".join(base) for i in (0, 3, 6, 9, 12, 15)]
    rows = [(10 + i, t) for i, t in enumerate(texts)] + [(30, texts[0]), (40, prose(6, 200))]
    sets = {k: set(minhash.shingle_set(t, 3).tolist()) for k, t in rows}
    group = {k: {k} for k, _ in rows}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                merged = group[a] | group[b]
                for k in merged:
                    group[k] = merged
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {k: min(group[k]) for k in sets}


def test_minhash_links_short_texts_that_share_one_band(spark):
    """Texts of 8 and 9 words, 4 and 5 shingles of which 4 are common, whose filled bands agree only once."""
    rows, rows_of = [], minhash.band_rows(0.8)
    for i in range(40_000):
        w = [f"w{i}x{k}" for k in range(9)]
        a, b = (minhash.registers(minhash.shingle_set(" ".join(x), 5))[: minhash.BUCKETS // rows_of * rows_of].reshape(-1, rows_of) for x in (w[:8], w))
        if ((a == b).all(1) & (a != minhash.EMPTY).any(1)).sum() == 1:
            rows += [(2 * len(rows), " ".join(w[:8])), (2 * len(rows) + 1, " ".join(w))]
        if len(rows) == 4:
            break
    assert len(rows) == 4
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sum(r["kept"] for r in got) == 2


def test_minhash_of_repeated_ids(spark):
    """Each text of a doc_id has its own links."""
    a, b = prose(41, 120), prose(42, 120)
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " tail"), (4, prose(43, 50)), (4, prose(44, 50)), (5, prose(44, 50)), (1, a)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 4, False)]


@pytest.mark.parametrize("block", [4, 500])
def test_minhash_of_lookalikes(spark, monkeypatch, block):
    """A large group of texts alike but unlinked, with linked ones among them, met in blocks of any size."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r, base, rows = random.Random(3), prose(50, 100).split(), []
    for k in range(60):
        w = list(base)
        for i in r.sample(range(100), 6):
            w[i] = f"own{k}x{i}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, "end"]))] if k % 3 == 0 else [(2 * k, " ".join(w))]
    sets = {k: set(minhash.shingle_set(t, 3).tolist()) for k, t in rows}
    group = {k: k for k in sets}
    for x in sets:
        for y in sets:
            if group[x] != group[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                low, high = sorted((group[x], group[y]))
                group = {k: low if v == high else v for k, v in group.items()}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == group and 30 < len(set(group.values())) < 75


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (3, 85)])
def test_minhash_recall_at_the_threshold(spark, shingle, percent):
    """Pairs as far apart as linked pairs may be, of texts of 8 to 400 words: at least 99.9 percent are linked."""
    r, rows, pairs = random.Random(shingle), [], 0
    while pairs < 1500:
        w = [f"w{pairs}x{i}" for i in range(r.randint(8, 400))]
        other = list(w)
        best = None
        for i in r.sample(range(len(w)), min(len(w), 30)):  # edits until the next would break the link
            other[i] = f"e{pairs}x{i}"
            a, b = (set(zip(*(x[j:] for j in range(shingle)))) for x in (w, other))
            if 100 * len(a & b) < percent * len(a | b):
                break
            best = list(other)
        if best:
            rows += [(2 * pairs, " ".join(w)), (2 * pairs + 1, " ".join(best))]
            pairs += 1
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.999 * pairs and all(v // 2 == k // 2 for k, v in got.items())


def test_hyperminhash_estimates():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 6000).astype(np.uint64)
    for share in (0.3, 0.6, 0.9):
        both = int(2000 * share)
        rest = (2000 - both) // 2
        a, b = np.unique(pool[: both + rest]), np.unique(np.r_[pool[:both], pool[3000 : 3000 + rest]])
        j, n = minhash.estimate(*(minhash.short(minhash.registers(x))[None] for x in (a, b)), *(np.array([len(x)]) for x in (a, b)))
        assert abs(j[0] - both / (both + 2 * rest)) < 0.15 and n[0] == minhash.BUCKETS


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r["u"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_line_dedup_edges(spark, odd, nothing):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.dedup_lines(odd).collect()}
    assert got[1] == (1, 0, "") and got[2] == (1, 0, "") and got[3] == (2, 0, " \t\n ")
    assert linededup.dedup_lines(nothing).count() == 0
    line = "The same line in several documents"
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nend") for i in range(1, 5)] + [(1, f"{line}")]
    got = {(r["doc_id"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 0)}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 50_000).astype(np.uint64))
    assert sorted(linededup.PerfectHash(keys).index(keys).tolist()) == list(range(len(keys)))
    assert linededup.PerfectHash(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]


def test_count_array_decides(spark, monkeypatch):
    """The arrays of a shard tell which keys repeat; without its counts no line goes."""
    h, fp = np.array([5, 6, 7, 7, 9], np.uint64), np.array([1, 2, 3, 4, 2**63 + 5], np.uint64)
    index = linededup.LineIndex.build(h, fp, np.array([3, 2, 1, 900, 300]), np.array([10, 11, 12, 13, 14]), 3)
    assert index.prints.dtype == np.uint16 and index.counts.dtype == np.uint8 and index.counts.max() == 3
    doc = np.array([1, 10, 1, 1, 13, 1, 2, 1])
    at = [0, 0, 1, 3, 3, 2, 4, 4]
    other = np.array([0, 0, 0, 0, 0, 0, 0, 1], np.uint64)
    assert index.repeated_elsewhere(doc, h[at], fp[at] ^ other).tolist() == [True, False, False, True, False, False, True, False]
    index.counts[:] = 0
    assert index.repeated_elsewhere(doc, h[at], fp[at]).tolist() == [False, False, False, True, False, False, False, False]
    rows = spark.createDataFrame([(i, "the same long line in all\nown line %d of this document" % i) for i in range(5)], "doc_id long, text string")
    assert sum(r["n_dropped"] for r in linededup.dedup_lines(rows).collect()) == 4
    build = linededup.LineIndex.build
    monkeypatch.setattr(linededup.LineIndex, "build", classmethod(lambda cls, h, fp, n, last, limit: build(h, fp, n * 0, last, limit)))
    cut = linededup._build(3)(pa.table({"shard": pa.array([0], pa.int32()), "h": [1], "fp": [1], "n": [9], "last": [4]}))
    probe = pa.table({"shard": pa.array([0], pa.int32()), "copy": pa.array([0], pa.int32()), "doc_id": [1], "h": [1], "fp": [1]})
    assert linededup._probe(probe, cut).num_rows == 0


def test_hot_line_over_several_copies(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PROBES_PER_TASK", 50)
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 100)
    rows = [(i % 290, f"A line that stands in every document\nown line number {i} of this document\nshort\n  a LINE that {i % 150} has twice  ") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    owners = {}
    for k, t in rows:
        for x in t.split("\n"):
            owners.setdefault(x.strip().lower(), set()).add(k)
    gone = lambda x, k: len(x.strip()) >= 20 and len(owners[x.strip().lower()]) >= 3 and max(owners[x.strip().lower()]) != k
    want = sorted((k, "\n".join(x for x in t.split("\n") if not gone(x, k))) for k, t in rows)
    assert sorted((r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs).collect()) == want


def test_topk_edges(spark):
    rows = [(1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (10, []), (7, [1.0]), (8, [1.0, 0.5]), (None, [1.0, 1.0]), (9, [-3.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_topk(v, v.where("vec_id in (1, 3, 6, 7)"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 5120), (1, 2, 8, 5120), (6, 1, 10, 0)]
    with pytest.raises(Exception, match="62 bits"):
        topk.exact_topk(v.unionByName(spark.createDataFrame([(11, [1e300])], "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))), v, 2).count()
    assert topk.exact_topk(v.limit(0), v, 2).count() == 0


def test_topk_against_all_scores(spark):
    r = np.random.default_rng(3)
    m = r.integers(-3, 4, (500, 6)) / 2
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.exact_topk(v, v.where("vec_id % 50 = 0"), k=7, block=64).collect()}
    whole = np.floor(64 * m).astype(int)
    for q in range(0, 500, 50):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(500) if c != q)[:7]
        assert [got[q, k + 1] for k in range(7)] == [(c, -s) for s, c in best]


@pytest.mark.parametrize(("rows", "cols"), [(1, 1), (1, 40), (3, 2)])
def test_topk_sums_counts_within_a_task(spark, monkeypatch, rows, cols):
    """Many blocks in a cell, ties between blocks, long vectors beside short ones, and queries that come twice."""
    monkeypatch.setattr(topk, "Q_BLOCKS", rows)
    monkeypatch.setattr(topk, "C_BLOCKS", cols)
    r = np.random.default_rng(8)
    m = np.floor(r.standard_normal((400, 4)) * np.where(r.random((400, 1)) < 0.1, 20, 1) * 4) / 4
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    twice = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m) if i % 40 == 0] + [(40, [99.0] * 4), (80, [None] * 4)], "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.exact_topk(v, twice, k=9, block=16).collect()}
    whole = np.floor(64 * m).astype(int)
    for q in range(0, 400, 40):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in range(400) if c != q)[:9]
        assert [got[q, k + 1] for k in range(9)] == [(c, -s) for s, c in best]


def test_chat_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (5, 0, "user", ""), (6, 0, "user", "hi"), (6, 0, "user", "hi"), (None, 0, "user", "x"), (7, None, None, None)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("a", F.lit(1)).withColumn("at", F.lit(2))
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.chat_format(t).collect()}
    assert set(got) == {1, 4, 5, 6, 7}
    assert got[1] == (2, "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n") and got[4][1] == got[5][1] and got[6][0] == 2
    assert chat.chat_format(t.limit(0)).count() == 0


def test_passages_edges(spark, odd, nothing):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.dedup_passages(odd).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[8] == (300, 0) and got[9] == (300, 300) and got[6] == (60_000, 0)
    assert substring.dedup_passages(nothing).count() == 0


def plain_passages(rows, length):
    """The words that are left of each row, by all windows of all documents; rows with one doc_id are one document."""
    first = {}
    for k, t in sorted(rows):
        w = t.split()
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), k)
    out = []
    for k, t in rows:
        w = t.split()
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < k:
                keep[i : i + length] = [False] * length
        out.append((k, " ".join(x for x, y in zip(w, keep, strict=True) if y)))
    return sorted(out)


def cut_passages(spark, rows, length=50):
    return sorted((x["doc_id"], x["text"]) for x in substring.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), length).collect())


@pytest.mark.parametrize("room", [0, 2000, 1 << 17])
def test_passages_against_all_windows(spark, monkeypatch, room):
    """Shared passages with edits, repeats within a document, very long words, periodic texts; routes split at every level, at some, at none."""
    monkeypatch.setattr(substring, "ROUTE_BYTES", room)
    r = random.Random(4)
    passages = [prose(100 + i, 130).split() for i in range(4)]
    passages[0][60] = "w" * 500
    rows = []
    for k in range(40):
        w = prose(k, r.randint(5, 60)).split()
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages))
            if r.random() < 0.6:
                p[r.randrange(len(p))] = f"edit{k}"
            a = r.randint(0, 60)
            w += p[a : a + r.randint(40, 130)] + prose(1000 + k, r.randint(0, 5)).split()
        rows.append((k, " ".join(w)))
    rows += [(100, "x " * 300), (101, prose(1, 10) + " x" * 120), (102, "a b " * 90), (103, "b a " * 70), (104, "w" * 499 + "v " + " ".join(passages[0][61:120]))]
    assert cut_passages(spark, rows) == plain_passages(rows, 50)


@pytest.mark.parametrize("room", [0, 1 << 17])
def test_passages_of_repeated_ids(spark, monkeypatch, room):
    """What is found in one text of a doc_id isn't cut from its other texts."""
    monkeypatch.setattr(substring, "ROUTE_BYTES", room)
    a, b, c, d, e = (prose(700 + i, 200) for i in range(5))
    rows = [(1, a), (5, a), (5, b), (1, c), (6, d), (6, e), (6, d), (7, f"{prose(800, 9)} {d[:900]}"), (6, f"own words {c}"), (2, None), (2, "")]
    want = plain_passages([(k, t or "") for k, t in rows], 50)
    assert cut_passages(spark, rows) == want
    assert (5, b) in want and (6, e) in want and (5, "") in want


def test_hot_route(spark, monkeypatch):
    """A passage in 300 documents, each with its own words around it, and a template with a word of each document's own: no
    index gets much more than its share, and nothing is lost."""
    monkeypatch.setattr(substring, "ROUTE_BYTES", 4000)
    shared, template = prose(900, 120), prose(901, 100).split()
    rows = [(k, f"{prose(2000 + k, 30)} {shared} {prose(3000 + k, 30)} {' '.join(template[:40])} name{k} {' '.join(template[40:])}") for k in range(300)]
    assert cut_passages(spark, rows) == plain_passages(rows, 50)


def test_fm_index_counts():
    r = np.random.default_rng(5)
    text = np.r_[r.integers(1, 5, 300), 0]
    index = substring.FMIndex(text, np.arange(len(text)))
    for n in (1, 2, 3, 5):
        pattern = text[40 : 40 + n]
        lo, hi = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        places = [i for i in range(len(text) - n + 1) if (text[i : i + n] == pattern).all()]
        assert hi[0] - lo[0] == len(places) and index.first_owner(lo, hi)[0] == min(places)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 33, 700])
def test_least_owner_of_ranges(n):
    r = np.random.default_rng(n)
    text = np.r_[r.integers(1, 90, n - 1), 0]
    owner = r.integers(10**12, 2 * 10**12, n)
    index = substring.FMIndex(text, owner)
    held = index.owners[index.fine[0]]
    lo, hi = np.array([(i, j) for i in range(n) for j in range(i + 1, n + 1)][:: max(1, n // 40)]).T
    assert index.first_owner(lo, hi).tolist() == [held[a:b].min() for a, b in zip(lo, hi, strict=True)]


def test_arc_versions():
    body = "á\r\n\r\nx\n".encode()
    for version in (1, 2):
        head = {"url": "http://a b/", "ip": "1.2.3.4", "date": "20010203040506", "type": "text/html", "length": str(len(body))}
        data = arc.arc_version_block(version) + (arc.arc_header(version, head) + body + b"\n") * 2
        found = list(arc.parse_arc(data))
        assert [b for _, b in found] == [body, body] and found[0][0]["url"] == "http://a%20b/"
        record = arc.warc_record(found[0][0], body, "7")
        (h, content), = arc.parse_warc(record + arc.END)
        assert content == body and h["WARC-Date"] == "2001-02-03T04:05:06Z" and h["WARC-Type"] == "response"
    with pytest.raises(ValueError):
        list(arc.parse_arc(b"http://a 1.2.3.4 2001 text/html\n"))
    with pytest.raises(ValueError):
        list(arc.parse_arc(b"http://a 1.2.3.4 20010203040506 text/html 99\nshort"))


def test_http_records():
    """Content with an HTTP head becomes an HTTP response; its payload and digest are those of what follows the head."""
    fields = {"url": "http://a/", "ip": "1.2.3.4", "date": "20010203040506", "type": "text/html"}
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nHTTP/"
    (h, body), = arc.parse_warc(arc.warc_record(fields, content, "7") + arc.END)
    assert h["Content-Type"].startswith("application/http") and body == content
    assert h["X-Payload-Length"] == "12" and h["WARC-Payload-Digest"] == "sha1:" + arc.payload_digest(b"<p>\r\n\r\nHTTP/")
    (r, body), = arc.parse_warc(arc.warc_record(fields, content, "8", "7") + arc.END)
    assert body.endswith(arc.END) and body.startswith(b"HTTP/") and b"<p>" not in body and r["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    assert arc.http_payload(b"HTTP/1.1 and no end") == (b"", b"HTTP/1.1 and no end")


def test_pieces_of_files_and_wrong_digests(spark, tmp_path):
    """Payloads that hold and end with parts of what separates records come back whole; a changed payload is found."""
    bodies = ["", "\r\n", "\r\n\r\n", "x\r\n", "x\r\n\r", "\r\n\r\n\r\n\r\nWARC/1.1\r\n", "y" * 300_000]
    rows = spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string").withColumn("url", F.lit("u"))
    arc.write_warc(rows.coalesce(1), f"{tmp_path}/a", records_per_file=3)
    got = {r["page_id"]: bytes(r["content"]).decode() for r in arc.read_warc(spark, f"{tmp_path}/a").collect()}
    assert got == dict(enumerate(bodies))
    record = arc.warc_record({"url": "u", "ip": "-", "date": "-", "type": "text/html"}, b"right", "1").replace(b"right", b"wrong")
    batch = pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["value"])
    with pytest.raises(ValueError, match="digest"):
        list(arc._read(iter([pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in [p]], ["value"]) for p in batch.column(0)[0].as_py().split(arc.END)])))


def test_warc_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "a\r\n\r\nb"), (4, "u", "a\r\n\r\nb"), (4, "u", "a\r\n\r\nb"), (None, "u", "x"), (5, "u", "é" * 100_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("first", F.lit(2))
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in arc.archive_roundtrip(p).select("page_id", "payload_bytes", "record_type", F.coalesce("refers_to", F.lit(-1)).alias("refers_to")).collect())
    assert got == [(1, 0, "response", -1), (2, 0, "revisit", 1), (3, 6, "response", -1), (4, 6, "revisit", 3), (4, 6, "revisit", 3), (5, 200_000, "response", -1)]
    assert {r["record_type"] for r in arc.archive_roundtrip(p, min_bytes=1000).collect()} == {"response"}
    assert arc.archive_roundtrip(p.limit(0)).count() == 0


def test_toxicity_edges(spark, odd, nothing):
    rows = [(i, f"{prose(i, 20)} {'nasty' if i % 4 == 0 else 'fine'} {prose(i + 500, 5)}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 160)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in got)
    hidden = spark.createDataFrame([(1, "so n4sty"), (2, "n a s t y"), (3, "naaaasty"), (4, "n.a.s.t.y"), (5, "a nice t3st"), (6, "")], "doc_id long, text string")
    assert [r["score"] >= 0.7 for r in toxicity.toxicity(hidden, model).orderBy("doc_id").collect()] == [True, True, True, True, False, False]
    assert toxicity.toxicity(odd, model).count() == len(ODD) and toxicity.toxicity(nothing, model).count() == 0
    blank = toxicity.fit(nothing, labels.limit(0))
    assert 0 <= toxicity.toxicity(docs, blank).first()["score"] <= 1


def test_toxicity_finds_every_disguise_that_is_decoded():
    """Letters apart with two signs or with signs for letters, letters doubled, a sign as the last letter."""
    for x in ("m. o. r. o. n", "t r @ s h", "l o $ e r", "s t u p ! d", "$ t u p i d", "i·d·i·o·t", "iiddiioott", "sstuupid", "jerk$", "ÉÉric"):
        assert x in toxicity.suspects(f"you are {x}, he said"), x
    assert toxicity.suspects("you are a plain one, he said. I saw it") == set()
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("ab c.-*'·é$!@(1 €\nZ_x~") for _ in range(r.randint(0, 12)))
        assert toxicity.may_be_spaced(t) or not toxicity.SPACED.search(t), t


def a_language(texts):
    """A character model counted over a few texts."""
    n = np.zeros(toxicity.SYMBOLS**toxicity.ORDER)
    for t in texts:
        np.add.at(n, toxicity.count_grams(t), 1)
    n = n.reshape((toxicity.SYMBOLS,) * toxicity.ORDER)
    return np.log((n + 0.01) / (n.sum(-1, keepdims=True) + 0.32)).astype(np.float32).ravel()


def every_reading(token, lm):
    """The best score of a text over all paths of a token's lattice, one by one."""
    best = {}
    for path in itertools.product(*toxicity.lattice(token)):
        state, score, text = 0, 0.0, ""
        for symbol, cost in path:
            score += cost
            if symbol is not None and (symbol or state & 31):
                score += float(lm[state * 32 + symbol])
                state, text = (state * 32 + symbol) & 32767, text + toxicity.LETTERS[symbol]
        score += float(lm[state * 32]) if state & 31 else 0.0
        best[text.strip()] = max(best.get(text.strip(), -1e9), score)
    return best


@pytest.mark.parametrize("dense", [0, 3000])
def test_decoder_against_all_readings(monkeypatch, dense):
    """Both ways to take a step give a reading of the best score that any path has."""
    monkeypatch.setattr(toxicity, "DENSE", dense)
    lm, r = a_language([prose(i, 300) for i in range(5)] + ["hello little idiot letter"] * 20), random.Random(9)
    tokens = ["1d10t", "he11o!", "l.e.t", "i d i", "h*l", "**a", "a**", "!!", "", "e\u00e9e", "\u4e2d1\u4e2d", "$$!"] + ["".join(r.choice("abilot1!$0. -*|e") for _ in range(r.randint(1, 6))) for _ in range(40 if dense == 0 else 400)]
    for token in tokens:
        if token.count("*") > 2 or token.count("*") > 1 and len(token) > 4:
            continue
        readings = every_reading(token, lm)
        assert readings[toxicity.decode(token, lm)] == pytest.approx(max(readings.values()), abs=1e-4), token


def test_decoder_takes_long_tokens():
    """200,000 characters without a space, plain, with repetitions and with signs, and long runs of stars: a second each."""
    lm, r = a_language([prose(1, 2000)]), random.Random(1)
    plain = "".join(r.choice("abcdefghij") for _ in range(200_000))
    for token in (plain, "aaa" + plain, "1000" + plain, "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60_000)), "f" + "*" * 60 + "k", "f" + "*" * 16 + "k", "f" + "*" * 200_000 + "k"):
        began = time.perf_counter()
        found = toxicity.decode(token, lm)
        assert time.perf_counter() - began < 2 and (token != plain or len(found) > 150_000)
    assert toxicity.decode("x" * 30 + "*" * 17 + "y", lm).endswith("y")


def test_toxicity_reads_new_disguises(spark):
    rows = [(i, f"{prose(i, 20)} {'stupid' if i % 4 == 0 else 'fine'} {prose(i + 500, 5)}") for i in range(160)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int"))
    hidden = ["so s t u p ! d", "$ t u p i d", "s. t. u. p. i. d", "sstuuppiidd", "so st$upid!", "a fine one!"]
    got = toxicity.toxicity(spark.createDataFrame(list(enumerate(hidden)), "doc_id long, text string"), model)
    assert [r["score"] >= 0.7 for r in got.orderBy("doc_id").collect()] == [True, True, True, True, False, False]


def test_toxicity_learns_all_signs(spark):
    """210 words, each in four toxic texts and no other."""
    names = ["".join(chr(97 + (i * 7 + k * k * 11 + i // 26 * (k + 3)) % 26) for k in range(7)) + chr(97 + i % 26) + chr(97 + i // 26) for i in range(210)]
    rows = [(i, f"{names[i // 4]} and so on" if i < 840 else "and so on") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id < 840) AS toxic"))
    assert all(any(toxicity.stem(f) in x for f in model.weights) for x in names) and len(model.weights) > 200


def test_toxicity_keeps_the_mix_of_labels(spark):
    """A sample that holds a sixth of the clean rows judges features and chances as all labelled rows do."""
    rows = [(i, f"{prose(i, 12)} {'nasty' if i % 10 == 0 and i % 20 else ''} {'weird' if i % 20 == 0 or i % 40 == 7 else ''}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 = 0) AS toxic")
    whole, part = toxicity.fit(docs, labels), toxicity.fit(docs, labels, max_toxic=80, max_clean=120)
    assert "nasty$" in part.weights or any(f.startswith("nas") for f in part.weights)
    assert not any(f.startswith("wei") for m in (whole, part) for f in m.weights)
    assert part.base == pytest.approx(whole.base, rel=0.25)


def test_quality_edges(spark, odd, nothing):
    got = quality.importance_resample(odd, odd.where("doc_id = 8"), 0.5)
    assert got.count() == len(ODD) and got.where("kept").count() >= len(ODD) // 2
    assert quality.importance_resample(nothing, nothing, 0.5).count() == 0
    rows = spark.createDataFrame([(i, 1.0) for i in range(5000)], "doc_id long, key double")
    assert {r["doc_id"] for r in quality.largest(rows, "key", 10, "doc_id").collect()} == set(range(10))
    rows = spark.createDataFrame([(i, float(i % 977)) for i in range(20_000)], "doc_id long, key double")
    assert sorted((-r["key"], r["doc_id"]) for r in quality.largest(rows, "key", 333, "doc_id").collect()) == sorted((-float(i % 977), i) for i in range(20_000))[:333]


def test_pieces_edges(odd, nothing):
    got = {r["doc_id"]: r["decoded"] for r in pieces.decode(pieces.encode(odd)).collect()}
    assert all(got[k] == (t or "") for k, t in ODD)
    again = pieces.round_trip(odd, carry=("lang",)).collect()
    assert len(again) == len(ODD) and all(got[r["doc_id"]] == r["decoded"] and r["lang"] == "x" for r in again)
    assert pieces.encode(nothing).count() == 0 and pieces.round_trip(nothing).count() == 0


def test_decontamination_edges(spark, odd, nothing):
    items = spark.createDataFrame([(1, prose(1, 300)), (2, None), (3, ""), (4, "one"), (None, "one"), (4, "one")], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(odd, items).collect()}
    assert got == {(8, 1, 0), (9, 1, 0), (4, 4, 0), (7, 4, 0)}
    assert decontam.contaminated(nothing, items).count() == 0 and decontam.contaminated(odd, items.limit(0)).count() == 0


def test_decontamination_recall():
    """Items with edits, among other words: recall against exact edit distances of all windows is 0.95 at least."""
    r = random.Random(6)
    texts = [prose(200 + i, 30 + i) for i in range(20)]
    held = decontam.Items([(i, decontam.tokens(t)) for i, t in enumerate(texts)], 0.2)
    found = total = 0
    for trial in range(300):
        item = trial % 20
        x = texts[item].split()
        for _ in range(r.randint(0, decontam.allowed(len(x), 0.2))):
            p = r.randrange(len(x))
            x[p : p + r.randint(0, 1)] = [f"e{trial}"] * r.randint(0, 1)
        t = decontam.tokens(" ".join([prose(trial, 30), *x, prose(trial + 7, 30)]))
        own = decontam.tokens(texts[item])
        w = np.lib.stride_tricks.sliding_window_view(t, len(own))
        if decontam.edit_distances(w, np.tile(own, (len(w), 1))).min() <= decontam.allowed(len(own), 0.2):
            total += 1
            found += any(h[1] == item for h in held.hits([t]))
    assert total > 200 and found >= 0.95 * total


@pytest.mark.parametrize("n", [5, 10, 21, 40, 100, 300])
def test_keys_reach_their_recall(n):
    """Pairs other than those that the number of walks was measured on, at the greatest distance."""
    k, rng = decontam.allowed(n, 0.2), np.random.default_rng(n)
    a = rng.integers(0, 2**62, (500, n)).astype(np.uint64)
    b = np.array([decontam.edited(x, k, rng) for x in a])
    walks = decontam.walks_for(n, k)
    hit = (decontam.embed_keys(a, walks) == decontam.embed_keys(b, walks)).any(1)
    assert hit.mean() >= 0.99 and walks <= decontam.MOST_WALKS


def test_long_items(spark):
    """An item of 3,000 words, edited, within a text of 9,000."""
    item = prose(70, 3000)
    w = item.split()
    for i in range(0, 3000, 11):
        w[i] = f"new{i}"
    rows = [(1, f"{prose(71, 3000)} {' '.join(w)} {prose(72, 3000)}"), (2, prose(73, 9000))]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 9)]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 2)
    items = spark.createDataFrame([(i, prose(300 + i, 20)) for i in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(i, 10) + " " + prose(300 + i, 20)) for i in range(7)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()} == {(i, i) for i in range(7)}


def test_pipeline_keeps_other_texts_of_an_id(spark):
    """A second text of a doc_id is judged by itself: it goes only if another document has it, or an item is in it."""
    a, b, c = prose(81, 80), prose(82, 80), prose(83, 80)
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "de", "s", 1), (6, c, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [(1, a, "en"), (5, b, "de"), (6, c, "en")]


def test_pipeline_stages(spark, odd, nothing, sf):
    """Each stage takes what the one before kept, whatever it holds."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for start in (odd, docs, nothing):
        now = start.select(*corpus_pipeline.COLUMNS)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = {r[0] for r in now.select("doc_id").collect()}
            now = stage(spark, now, sf).cache()
            assert {r[0] for r in now.select("doc_id").collect()} <= before
            assert i == len(corpus_pipeline.STAGES) - 1 or now.columns == corpus_pipeline.COLUMNS


def test_pipeline_decisions(spark, sf):
    """The stages' decisions against plain versions of them, each on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(stage(spark, held[-1], sf).cache())
    rows = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in held]
    # toxicity: the scores of the operator, each below the bound
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), train=~queries.held_out())
    assert set(rows[1]) == {r["doc_id"] for r in toxicity.toxicity(docs, model).collect() if r["score"] < 0.7}
    # lines: of those in three documents only the one in the last stays
    owners = {}
    for k, t in rows[1].items():
        for x in t.split("\n"):
            owners.setdefault(linededup.line_key(x.encode(), 20), set()).add(k)
    goes = lambda x, k: (key := linededup.line_key(x.encode(), 20)) and len(owners[key]) >= 3 and max(owners[key]) != k
    assert rows[2] == {k: "\n".join(x for x in t.split("\n") if not goes(x, k)) for k, t in rows[1].items()}
    # near duplicates: one of each group that links of similarity 0.8 make
    sets = {k: set(minhash.shingle_set(t, 5).tolist()) for k, t in rows[2].items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(rows[3]) == {k for k in keys if find(k) == k}
    # decontamination: no document with an item's words stays
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in " ".join(t.lower().split()) for t in rows[4].values() for i in items)
    assert all(rows[5][k] == t for k, t in rows[4].items()) and set(rows[5]) == set(rows[4])
