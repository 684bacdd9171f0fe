"""Near-duplicate documents by HyperMinHash: banded registers find pairs, estimates and full shingle sets confirm them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.components import components
from quarrylens.llm.shared import U64, discard, grams, hash64, lean, mix, signed, slices, staged, words

BUCKETS = 192
#: How likely a pair at the threshold may share less than two bands.
MISS = 1e-5
#: Sets up to this size are linked by one band alone: they fill few bands, and sharing less than two is likelier than MISS
#: up to 6 shingles at 80 percent (5e-4 for 4 and 5), while sharing none is not (2e-6).
SMALL = 8
MANTISSA = 10
#: Members of a group that meet at once; fewer, but SMALL_BLOCK at least, where that spreads a group over up to BLOCKS blocks; and parts
#: that the members of each group are dealt to while they get their block.
BLOCK, SMALL_BLOCK, BLOCKS, SALTS = 300, 100, 12, 64
EMPTY = 0xFFFF


def band_rows(share: float) -> int:
    """Registers in a band: as many as keep the chance to miss a pair at the threshold below MISS."""

    def miss(p: float, bands: int) -> float:
        return (1 - p) ** bands + bands * p * (1 - p) ** (bands - 1)

    return max([r for r in range(1, 17) if miss(share**r, BUCKETS // r) <= MISS], default=1)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text with A-Z lower-cased; of all its words if they are fewer."""
    w = words(text)
    if not w:
        return np.empty(0, U64)
    h = hash64([x.lower() for x in w])
    return np.unique(grams(h, min(n, len(h))))


def registers(items: np.ndarray) -> np.ndarray:
    """Of each bucket the leading zeros and the first mantissa bits of its smallest hash, in 16 bits."""
    bucket = ((mix(items, 101) >> U64(32)) * U64(BUCKETS)) >> U64(32)
    rank = mix(items, 102)
    order = np.argsort(rank)[::-1]
    least = np.zeros(BUCKETS, U64)
    full = np.zeros(BUCKETS, bool)
    at = bucket[order].astype(np.int64)
    least[at] = rank[order]  # the last one written is the smallest
    full[at] = True
    zeros = 63 - np.floor(np.log2(np.maximum(least >> U64(11), U64(1)).astype(np.float64))).astype(np.int64) - 11
    shift = np.maximum(63 - zeros - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> shift) & U64((1 << MANTISSA) - 1)
    out = (np.minimum(zeros, 62).astype(np.uint64) << U64(MANTISSA)) | mantissa
    return np.where(full, out, U64(EMPTY)).astype(np.uint16)


def short(regs: np.ndarray) -> np.ndarray:
    """Registers in a byte each, for estimates: 0 for an empty one, else a hash of it from 1 to 255."""
    return np.where(regs == EMPTY, 0, 1 + mix(regs.astype(np.uint64), 5) % U64(255)).astype(np.uint8)


def chance_match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How likely short registers of unrelated sets of these sizes agree: the same leading zeros and mantissa, or one byte for both."""
    level = np.arange(53)
    ka, kb = (np.maximum(x / BUCKETS, 1.0)[:, None] for x in (a, b))
    p = [(1 - 0.5 ** (level + 1)) ** k - np.where(level, (1 - 0.5**level) ** k, 0.0) for k in (ka, kb)]
    same = (p[0] * p[1]).sum(1) / 2**MANTISSA
    return same + (1 - same) / 255


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of short registers, less what agrees by chance, and how many buckets they rest on."""
    used = (ra != 0) | (rb != 0)
    n = np.maximum(used.sum(1), 1)
    same, chance = ((ra == rb) & used).sum(1) / n, chance_match(na.astype(float), nb.astype(float))
    return np.maximum(0.0, (same - chance) / (1 - chance)), n


def _sketch(n: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                sizes, marks, regs, mini = [], [], [], []
                for text in part.column(1).to_pylist():
                    items = shingle_set(text, n)
                    sizes.append(len(items))
                    marks.append(_mark(items))
                    own = registers(items)
                    regs.append(own.tobytes())
                    mini.append(short(own).tobytes())
                m = np.frombuffer(b"".join(marks), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(m[:, 0].copy()), pa.array(m[:, 1].copy()), pa.array(regs, pa.binary()), pa.array(mini, pa.binary()), part.column(2)], ["doc_id", "n", "s1", "s2", "regs", "mini", "text_hash"])

    return run


def _bands(rows: int):
    """key, rep, n for each band that has a register; bands without one say nothing."""
    bands = BUCKETS // rows

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            key = np.zeros(r.shape[:2], U64)
            for i in range(rows):
                key = mix(key + r[:, :, i], i + 11)
            key = mix(key + np.arange(bands).astype(U64)[None, :], 31)
            doc, band = np.nonzero((r != EMPTY).any(2))
            yield pa.RecordBatch.from_arrays([pa.array(signed(key[doc, band])), batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc))], ["key", "rep", "n"])

    return run


def _likely(share: float):
    """Pairs whose estimate is no more than five standard deviations below the threshold."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BUCKETS) for i in (4, 5))
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            j, n = estimate(ra, rb, na, nb)
            keep = pa.array(j >= share - 5 * np.sqrt(share * (1 - share) / n))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["u", "v"])

    return run


def _mark(items: np.ndarray) -> bytes:
    """A set's mark; s1 and s2 are its halves."""
    return xxhash.xxh3_128_digest(items.tobytes())


def _sets(n: int):
    """node, items: the sets of texts that have the mark of their class; a doc_id may have other texts too."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4_000_000, 500):
                nodes, found = [], []
                for node, text, s1, s2 in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    items = shingle_set(text, n)
                    if _mark(items) == struct.pack(">qq", s1, s2):
                        nodes.append(node)
                        found.append(items.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "items"])

    return run


def _items(docs: DataFrame, classes: DataFrame, need: DataFrame, n: int) -> DataFrame:
    """node, items of the classes of need (node): the full set, from the text of any row that has it. Written, so that joins
    with it can split the partition of a class that very many pairs have."""
    at = need.distinct().join(classes, "node").select(F.col("rep").alias("doc_id"), "node", "s1", "s2")
    texts = docs.join(at, "doc_id").select("node", "text", "s1", "s2")
    return staged(texts.mapInArrow(_sets(n), "node long, items binary").groupBy("node").agg(F.first("items").alias("items")), "sets")


def _confirm(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, both = [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), U64) for x in (a, b))
                at = np.searchsorted(b, a)
                shared = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
                total = len(a) + len(b) - shared
                keep.append(100 * shared >= percent * total)
                both.append(1 - shared / max(total, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_()), pa.array(both, pa.float64())], ["u", "v", "linked", "distance"])

    return run


def _tested(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """u, v, linked, distance of the pairs (u, v) of classes whose estimates pass, from their full sets."""
    a, b = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("mini").alias(f"r{x}")) for x in "uv")
    near = pairs.join(a, "u").join(b, "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    near = staged(near.select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(_likely(percent / 100), "u long, v long"), f"{name}-likely")
    sets = _items(docs, classes, near.select(F.explode(F.array("u", "v")).alias("node")), n)
    full = near.join(sets.withColumnsRenamed({"node": "u", "items": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "items": "b"}), "v")
    out = staged(full.select("u", "v", "a", "b").mapInArrow(_confirm(percent), "u long, v long, linked boolean, distance double"), name)
    discard(near, sets)
    return out


def _partners(c: np.ndarray, size: np.ndarray, mini: np.ndarray, own: np.ndarray, lo: int, hi: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each member of a block: the members of other components that may be linked with it by size and estimate, and the estimates."""
    share = percent / 100
    for i in np.flatnonzero(own == lo):
        at = np.arange(i + 1, len(c)) if lo == hi else np.flatnonzero(own == hi)
        at = at[(c[at] != c[i]) & (np.minimum(size[at], size[i]) * 100 >= np.maximum(size[at], size[i]) * percent)]
        if len(at):
            same = mini[at] == mini[i]
            used = np.maximum(((mini[at] != 0) | (mini[i] != 0)).sum(1), 1)
            agree = (same & (mini[i] != 0)).sum(1) / used
            near = np.flatnonzero(agree >= share - 5 * np.sqrt(share * (1 - share) / used) - 0.01)
            chance = chance_match(size[at[near]].astype(float), np.full(len(near), float(size[i])))
            j = (agree[near] - chance) / (1 - chance)
            ok = j >= share - 5 * np.sqrt(share * (1 - share) / used[near])
            yield int(i), at[near[ok]], j[ok]


def _block(table: pa.Table) -> tuple:
    c, size, own = (table[x].to_numpy() for x in ("c", "n", "own"))
    lo, hi = (table[x][0].as_py() for x in ("lo", "hi"))
    return c, size, np.frombuffer(b"".join(table["mini"].to_pylist()), np.uint8).reshape(-1, BUCKETS), own, lo, hi


def _with_partners(percent: int):
    """Members of blocks that may be linked with a member of another component."""

    def run(table: pa.Table) -> pa.Table:
        some = np.zeros(table.num_rows, bool)
        for i, at, _ in _partners(*_block(table), percent):
            if len(at):
                some[i] = some[at] = True
        keep = table.filter(pa.array(some))
        return keep.select(["hub", "lo", "hi", "rep", "c", "own", "n", "mini"])

    return run


def _links_between(percent: int):
    """Links that join components of a block, or of two blocks: enough of them to join all that are linked."""

    def run(table: pa.Table) -> pa.Table:
        rep, c = table["rep"].to_numpy(), table["c"].to_numpy()
        items = [np.frombuffer(x, U64) for x in table["items"].to_pylist()]
        root, out = {x: x for x in c.tolist()}, []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, at, j in _partners(*_block(table), percent):
            for k in at[np.argsort(-j, kind="stable")]:
                a, b = find(int(c[i])), find(int(c[k]))
                if a == b:
                    continue
                x, y = items[i], items[k]
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[place] == x).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    root[max(a, b)] = min(a, b)
                    out.append((int(rep[i]), int(rep[k])))
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, n_links, text_hash of documents (doc_id, text).

    Two documents are linked if their sets of word shingles (A-Z lower-cased) have 100 * intersection >= percent *
    union; component_id is the smallest doc_id that links reach. A text with fewer words has one shingle, all its
    words; a null or empty text has none and is linked with nothing. Rows with a null doc_id take no part and give no
    row. Repeated rows give a row each; of a doc_id with several texts each row has its own set and links, and they share
    nothing but the id; text_hash, Spark's xxhash64 of the text, tells them apart. Other columns are ignored. class_id is
    the smallest doc_id with the same set; n_links counts the confirmed links of the class, which are enough to connect
    all that is linked.

    Equal sets collapse to classes first. Classes meet where bands of compressed registers agree, two of them at
    least, or one if the sets are small: a pair at the threshold is missed with a chance below MISS. In each bucket the
    member whose bands are the most common is compared with the others. Where a bucket still has several components, its
    members meet in blocks of bounded size: registers are compared within a task, full sets of members that have a likely
    partner, and only links that join components leave the task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = staged(keyed.mapInArrow(_sketch(shingle), "doc_id long, n int, s1 long, s2 long, regs binary, mini binary, text_hash long"), "sketches")
    one = F.first(F.struct("n", "regs", "mini")).alias("x")  # the same for all rows of a class
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), one).select(F.monotonically_increasing_id().alias("node"), "rep", "s1", "s2", "x.*")
    classes = staged(classes, "classes")  # once written, a class keeps its node
    banded = classes.select("node", "n", "regs").mapInArrow(_bands(band_rows(percent / 100)), "key long, rep long, n int")
    sizes = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = staged(banded.join(sizes, "key").select("key", "rep", "n", "m"), "buckets")
    # A pair at the threshold shares two buckets, so that a member of one bucket alone has no link, unless its set is small.
    weight = met.groupBy("rep", "n").agg(F.sum("m").alias("weight"), F.count("*").alias("k")).where(f"k > 1 or n <= {SMALL}").select("rep", "weight")
    members = staged(met.join(weight, "rep").select("key", "rep", "n", "weight"), "members")
    hub = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"), "n")).alias("h")).select("key", (-F.col("h.rep")).alias("hub"), F.col("h.n").alias("hn"))
    pairs = members.join(hub, "key").where((F.col("rep") != F.col("hub")) & (F.least("n", "hn") * 100 >= F.greatest("n", "hn") * percent))
    pairs = pairs.select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct()
    tested = _tested(pairs, classes, docs, shingle, percent, "links")
    links = tested.where("linked").select("u", "v")
    label = components(links)

    # What is left: buckets with several components. Their members meet around the hub, in blocks.
    marked = members.select("key", "rep").join(label.withColumnRenamed("u", "rep"), "rep", "left").join(hub.select("key", "hub"), "key").withColumn("c", F.coalesce("component", "rep"))
    mixed = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo <> hi and k > 2").select("key")
    open_ = staged(marked.join(mixed, "key").select("hub", "rep", "c").distinct(), "open")
    size = F.count("*")
    large = open_.groupBy("hub").agg(F.greatest(F.ceil(size / BLOCK), F.least(F.ceil(size / SMALL_BLOCK), F.lit(BLOCKS))).cast("int").alias("blocks")).where("blocks > 1")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = open_.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(large, ["hub", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "own").alias("lo"), F.greatest(i, "own").alias("hi")))
    dealt = own.withColumn("pair", F.explode(others)).select("hub", "pair.lo", "pair.hi", "rep", "c", "own")
    sketched = classes.select(F.col("node").alias("rep"), "n", "mini")
    place = "hub long, lo int, hi int, rep long, c long, own int, n int, mini binary"  # a member that stays takes its sketch along
    left = staged(dealt.join(sketched, "rep").groupBy("hub", "lo", "hi").applyInArrow(_with_partners(percent), place), "partners")
    sets = _items(docs, classes, left.select(F.col("rep").alias("node")), shingle).withColumnRenamed("node", "rep")
    found = left.join(sets, "rep").groupBy("hub", "lo", "hi").applyInArrow(_links_between(percent), "u long, v long")
    links = links.unionByName(found)
    links = staged(links, "all-links")
    discard(met, members, open_, left, tested)
    label = staged(components(links).withColumnRenamed("u", "node"), "labels")
    least = label.join(classes, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    count = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = classes.select("s1", "s2", "node", "rep").join(label.join(least, "component").select("node", "component_id"), "node", "left").join(count, "node", "left").drop("node")
    out = rows.select("doc_id", "n", "s1", "s2", "text_hash").join(named, ["s1", "s2"], "left")
    component = F.coalesce("component_id", "rep", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash")
