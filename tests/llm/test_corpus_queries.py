"""The thin queries against SQL, or against plain versions where SQL can't express them."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylens.llm import decontam, pieces, quality, queries, toxicity
from test_corpus_edges import every_reading


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_toxicity_of_held_out_rows(spark):
    """On the larger table: the small one has too few toxic rows to learn from."""
    sf = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, sf).toPandas()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(x).encode()) % 3 == 1 for x in got.doc_id]).all()
    j = got[got.held_out].merge(labels)
    assert (j[j.toxic == 1].predicted.mean() > 0.8) and (j[j.toxic == 0].predicted.mean() < 0.01)


def test_toxicity_against_plain_scores(spark):
    """Every text's score from its learned signs, looked for one by one; short spans are decoded by trying all their readings."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), train=~queries.held_out())

    def reading(span):
        ways = math.prod(len(x) for x in toxicity.lattice(span))
        if ways > 300:
            return toxicity.decode(span, model.lm)
        best = every_reading(span, model.lm)
        own = toxicity.decode(span, model.lm)
        assert best[own] == pytest.approx(max(best.values()), abs=1e-3)
        return own

    def plain(text):
        spans = set()
        for token in text.split():
            core = token.strip(toxicity.EDGE)
            folded = [toxicity.LETTERS[s] for s in toxicity.symbols(core)]
            if core.isalpha() and any(x == y and x in "abcdefghijklmnopqrstuvwxyz" for x, y in itertools.pairwise(folded)) or not core.isalpha() and any(c.isalpha() for c in core):
                spans.add(core)
        spans |= set(toxicity.SPACED.findall(text))
        words = Counter(re.findall(r"[^\W\d_]+", text.lower()))
        for x in spans:
            y = reading(x).split()
            if y != re.findall(r"[^\W\d_]+", x.lower()):
                words.update(y)
        clean = 1 - model.base
        for sign, chance in model.weights.items():
            if sign.endswith("$"):
                have = sign[:-1] in words
            else:
                head, _, times = sign.partition("#")
                have = sum(n for w, n in words.items() if w.startswith(head)) >= int(times or 1)
            clean *= 1 - chance if have else 1
        return 1 - clean

    got = {r["doc_id"]: r["score"] for r in queries.op2_toxicity(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(got) == set(texts) and model.weights
    for key, text in texts.items():
        assert got[key] == pytest.approx(plain(text), abs=1e-9), key


def test_pieces_against_a_plain_search_of_whole_texts(spark, sf):
    """The ids of the query have the best sum of scores that a search over each whole text finds, without parts or trie."""
    p = pieces.Pieces(open(pieces.DEFAULT_MODEL, "rb").read())
    scores = {s: x for s, x, kind in p.pieces if kind in (pieces.NORMAL, pieces.USER)}
    longest = max(map(len, scores))
    got = {r["doc_id"]: r["ids"] for r in queries.op5_sentencepiece(spark, sf).collect()}
    byte_ids = {i: b for b, i in p.byte_ids.items()}
    for doc, text in list(pq.read_table(f"{sf}/documents.parquet").to_pandas().set_index("doc_id").text.items()):
        s = pieces.MARK + text.replace(" ", pieces.MARK)
        if pieces.MARK in text or "\0" in text or len(s) > 6000:
            continue
        best = [0.0] + [-math.inf] * len(s)
        for at in range(len(s)):
            for to in range(at + 1, min(len(s), at + longest) + 1):
                score = scores.get(s[at:to], p.unknown if to == at + 1 else None)
                if score is not None and best[at] + score > best[to]:
                    best[to] = best[at] + score
        own, left = 0.0, b""
        for i in got[doc]:
            if i in byte_ids:
                left += bytes([byte_ids[i]])
                continue
            own, left = own + p.scores[i] + p.unknown * len(left.decode()), b""
        assert own + p.unknown * len(left.decode()) == pytest.approx(best[-1], rel=1e-9), doc


def test_pieces_give_the_text_back(spark, sf):
    import hashlib

    got = queries.op5_sentencepiece(spark, sf).toPandas().set_index("doc_id")
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas().set_index("doc_id")
    assert len(got) == len(docs) and (got.n_tokens == got.ids.map(len)).all()
    for key, text in docs.text.items():
        assert got.decoded_sha256[key] == hashlib.sha256(text.encode()).hexdigest()


def test_quality_keeps_the_share_and_prefers_good_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality_resample(spark, sf).toPandas()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    assert got.kept.sum() == round(labels.quality.mean() * len(got))
    j = got.merge(labels)
    assert j[j.quality == 1].kept.mean() > 0.9 and j[j.quality == 0].kept.mean() < 0.4
    # The noise decides too: what is kept isn't the top by weight.
    plain = (got.log_weight / got.n_grams.clip(lower=1)).rank(ascending=False) <= got.kept.sum()
    assert 0.01 < (plain & ~got.kept).mean() < 0.1


def test_quality_against_plain_counts(spark, sf):
    """Both models counted gram by gram over whole texts, and the k largest keys of all rows sorted."""
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas().set_index("doc_id").text
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    good = set(labels[labels.quality == 1].doc_id)
    grams = {}
    for key, text in docs.items():
        w = [x.lower() for x in text.encode().split()]
        h = quality.hash64(w)
        grams[key] = [int(x) % quality.BUCKETS for x in quality.mix(h, 51)] + [int(quality.grams(h[i : i + 2], 2)[0]) % quality.BUCKETS for i in range(len(w) - 1)]
    target, raw = (Counter(g for k in keys for g in grams[k]) for keys in (good, grams))
    log = lambda c, g: math.log((c[g] + 1) / (sum(c.values()) + quality.BUCKETS))
    ratio = {g: log(target, g) - log(raw, g) for g in raw}
    got = queries.op8_quality_resample(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for key, g in grams.items():
        assert got.n_grams[key] == len(g) and got.log_weight[key] == pytest.approx(sum(ratio[x] for x in g), abs=1e-6)
    k = round(labels.quality.mean() * len(docs))
    order = sorted(got.index, key=lambda d: (-got.key[d], d))
    assert set(got.index[got.kept]) == set(order[:k])


def test_sample_follows_the_odds(spark):
    """Over 30,000 seeds the largest of five keys, and the two largest, come as often as the odds say."""
    odds = [1.0, 2.0, 3.0, 0.5, 8.0]
    rows = spark.createDataFrame([(i, math.log(x)) for i, x in enumerate(odds)], "doc_id long, log_weight double")
    seeds = spark.range(30_000).withColumnRenamed("id", "seed")
    keyed = rows.crossJoin(seeds).withColumn("key", quality.sampling_key(F.col("log_weight"), F.col("doc_id"), F.col("seed")))
    place = Window.partitionBy("seed").orderBy(F.desc("key"))
    drawn = keyed.withColumn("place", F.row_number().over(place)).where("place <= 2").groupBy("doc_id", "place").count().collect()
    n = {(r["doc_id"], r["place"]): r["count"] / 30_000 for r in drawn}
    total = sum(odds)
    for i, x in enumerate(odds):
        second = sum(y / total * x / (total - y) for j, y in enumerate(odds) if j != i)
        assert n[i, 1] == pytest.approx(x / total, abs=0.012) and n[i, 2] == pytest.approx(second, abs=0.012)


def test_decontamination_against_all_windows(spark, sf):
    """Exact edit distances of every window of every document with every item."""
    docs = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pandas()
    want = set()
    tokens = {k: decontam.tokens(t) for k, t in zip(items.item_id, items.text, strict=True)}
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        t = decontam.tokens(text)
        for item, x in tokens.items():
            n = len(x)
            # Each edit takes away one of the item's different words at most, so windows with fewer of them are out of reach.
            least = len(np.unique(x)) - decontam.allowed(n, 0.2)
            if len(t) < n or len(np.intersect1d(t, x)) < least:
                continue
            w = np.lib.stride_tricks.sliding_window_view(t, n)
            near = np.flatnonzero([len(np.intersect1d(r, x)) >= least for r in w])
            if len(near) and (decontam.edit_distances(w[near], np.tile(x, (len(near), 1))) <= decontam.allowed(n, 0.2)).any():
                want.add((int(doc), int(item)))
    got = queries.op9_decontamination(spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_pieces_match_a_plain_search():
    p = pieces.Pieces(open(pieces.DEFAULT_MODEL, "rb").read())
    scores = {s.encode(): x for s, x, kind in p.pieces if kind == pieces.NORMAL}

    def best(s: bytes) -> float:
        out = [0.0] + [-math.inf] * len(s)
        for b in range(1, len(s) + 1):
            out[b] = max((out[a] + scores.get(s[a:b], -math.inf) for a in range(b)), default=-math.inf)
        return out[-1]

    for word in ("▁the", "▁thinking,", "▁enonst", "▁unlich", "▁queción"):
        assert sum(p.scores[i] for i in p.segment(word)) == pytest.approx(best(word.encode()))
