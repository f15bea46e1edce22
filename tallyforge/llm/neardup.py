"""Near-duplicate documents by one-permutation hashing (operator 5).

One hash per shingle serves all bins; optimal densification fills empty bins from full ones by a fixed random walk of bins. Bands
of bins make buckets. In a bucket every document is compared with one centre only (a star), so a bucket of n documents has n - 1
candidate pairs. Pairs are confirmed on their full shingle sets. Further rounds draw other centres in the buckets that still hold
more than one component, until a round finds no new link. These rounds only join most documents early: after them every pair of
different components that shares a bucket is compared, or ruled out by its lengths or by prefixes that share no shingle. Small
buckets are taken pair by pair, larger ones are split by the rarest shingles of their documents, and groups that stay large are
compared in blocks that return links only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import byte_rows, durable, map_batches
from tallyforge.llm.components import components

#: Rounds of stars around drawn centres at most, before the buckets that still hold several components are exhausted.
ROUNDS = 1
#: Groups of up to so many documents are compared pair by pair; larger ones are split first, and then dealt in blocks.
SMALL = 32
#: Documents on each side of a block.
BLOCK = 256
#: Cells of the table of shingle counts that orders prefixes. Shingles that share a cell are ordered by hash, so any size is exact.
CELLS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be divided out again
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all rows, and each word's row. Words are runs without blanks; A-Z is lowered."""
    n = len(raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    upper = (raw >= 65) & (raw <= 90)
    edge = np.zeros(n + 1, bool)
    edge[start[end > start]] = True
    before = np.ones(n, bool)
    before[1:] = blank[:-1]
    first = np.flatnonzero(~blank & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = blank[1:] | edge[1:n]
    last = np.flatnonzero(~blank & after) + 1
    power, back = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + upper * np.uint64(32) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[last] - total[first]) * back[first]
    row = np.searchsorted(end, first, side="right")
    return _mix(h + (last - first).astype(np.uint64) * _BASE), row


def shingle_sets(raw: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = 2) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's runs of `width` words; a shorter row's words make one shingle."""
    words, row = word_hashes(raw, start, end)
    counts = np.bincount(row, minlength=len(start))
    edges = np.concatenate([[0], np.cumsum(counts)])
    runs = max(0, len(words) - width + 1)
    h = np.full(runs, np.uint64(width), np.uint64)
    for k in range(width):
        h = _mix(h * _BASE + words[k : k + runs])
    out = []
    for a, z in zip(edges[:-1], edges[1:]):
        if z - a >= width:
            out.append(np.unique(h[a : z - width + 1]))
        elif z > a:
            x = np.uint64(z - a)
            for w in words[a:z]:
                x = _mix(np.array([x], np.uint64) * _BASE + w)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """Band hashes of a sorted set of hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows = bands, rows
        self.bins = bands * rows
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], np.uint64)
        self.seed, self.walk = seed, []

    def steps(self, k: int) -> np.ndarray:
        """The k-th 32 steps of every bin's walk; it has no end."""
        while len(self.walk) <= k:
            self.walk.append(np.random.default_rng([self.seed, len(self.walk)]).integers(0, self.bins, (32, self.bins)))
        return self.walk[k]

    def bins_of(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of every bin; an empty bin takes that of the first full bin on its walk."""
        at = np.searchsorted(hashes, self.edges)
        upto = np.append(at[1:], len(hashes))
        full = at < upto
        out = hashes[np.minimum(at, len(hashes) - 1)]
        left = np.flatnonzero(~full)
        k = 0
        while len(left):
            ways = self.steps(k)[:, left]
            hit = full[ways]
            found = hit.any(0)
            out[left[found]] = out[ways[hit.argmax(0), np.arange(len(left))][found]]
            left, k = left[~found], k + 1
        return out

    def bands_of(self, hashes: np.ndarray) -> np.ndarray:
        values = self.bins_of(hashes).reshape(self.bands, self.rows)
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            h = _mix(h * _BASE + values[:, k])
        return h.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, in integers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, n_shingles, print (a digest of the whole set) and its band hashes; no print or band without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in batches:
            sets = shingle_sets(*byte_rows(b.column("text")), width)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            hashes = [signer.bands_of(s) if len(s) else None for s in sets]
            cols = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "print", "bands"])

    return map_batches(docs.select("doc_id", "text"), sign, "doc_id long, n_shingles long, print binary, bands array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets are similar."""
    text = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    left = pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, known = None, None
        for batch in batches:
            one = shingle_sets(*byte_rows(batch.column("text_a")), width)
            yes = np.zeros(len(one), bool)
            for i, (b, text) in enumerate(zip(batch.column("b").to_pylist(), batch.column("text_b"))):
                if centre is None or centre != (b, text):  # rows come sorted by b
                    centre, known = (b, text), shingle_sets(*byte_rows(pa.array([text.as_py()], pa.string())), width)[0]
                yes[i] = similar(one[i], known, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes))

    return map_batches(both, check, "a long, b long")


def _owned(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with `own`, the component so far of each rep."""
    return groups.join(labels.select(F.col("id").alias("rep"), F.col("component").alias("own")), "rep")


def merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after further links. Only the links' components are contracted, however many documents they hold."""
    one, other = (labels.select(F.col("id").alias(n), F.col("component").alias(f"own_{n}")) for n in "ab")
    between = found.join(one, "a").join(other, "b").select(F.col("own_a").alias("a"), F.col("own_b").alias("b")).distinct()
    moves = durable(components(between), "moves").select(F.col("id").alias("component"), F.col("component").alias("to"))
    return durable(labels.join(moves, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def several(groups: DataFrame, key: str) -> DataFrame:
    """(key, size) of the groups that hold several components, written so that what is joined with it has two plain sides: the engine
    then broadcasts a small one, or splits hot groups."""
    sizes = groups.groupBy(key).agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    return durable(sizes.select(key, "size"), "several")


def _across(groups: DataFrame, key: str, percent: int) -> DataFrame:
    """The distinct pairs (a, b), a > b, of different components in one group whose lengths allow a link."""
    one, other = (groups.select(key, F.col("rep").alias(n), F.col("own").alias(f"own_{n}"), F.col("n_shingles").alias(f"n_{n}")) for n in "ab")
    pairs = one.join(other, key).where(f"a > b AND own_a <> own_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return pairs.select("a", "b").distinct()


def redrawn(buckets: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b), a > b, of this round's stars: in each bucket of several components one member is drawn by hash
    as the centre, and meets the members of other components whose lengths allow a link."""
    now = _owned(buckets.select("band", "rep", "n_shingles"), labels)
    drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "band", "rep").alias("h"), "rep", "own", "n_shingles"))
    centres = now.groupBy("band").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), drawn.alias("c")).where("lo < hi")
    # written first: the join below then has two plain sides, of which the engine broadcasts a small one or splits hot buckets
    centres = durable(centres.select(F.col("band").alias("at"), F.col("c.rep").alias("centre"), F.col("c.own").alias("other"), F.col("c.n_shingles").alias("n_centre")), "centres")
    meets = (F.col("band") == F.col("at")) & (F.col("own") != F.col("other"))
    meets = meets & (100 * F.least("n_shingles", "n_centre") >= percent * F.greatest("n_shingles", "n_centre"))
    return now.join(centres, meets).select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()


def full_sets(own: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rep, n_shingles, shingles) of the texts of `reps`; the shingles are a sorted set as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(*byte_rows(b.column("text")), width)
            cols = [b.column("rep"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "n_shingles", "shingles"])

    rows = own.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "text")
    return map_batches(rows, run, "rep long, n_shingles long, shingles binary").where("n_shingles > 0")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n_shingles, token): of each set the rarest shingles, so many that two similar sets share at least one of theirs.

    A set of n has at least ceil(n * percent / 100) shingles in common with a similar one; the first n + 1 less that many, in one
    order for all sets, then hold a common one. The order is by counts per cell, a table of fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for s in b.column("shingles"):
                np.add.at(total, (np.frombuffer(s.as_py(), np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    for r in map_batches(sets.select("shingles"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.cell] = r.n
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            out = []
            for s in b.column("shingles"):
                s = np.frombuffer(s.as_py(), np.uint64)
                order = np.lexsort((s, known[(s % np.uint64(CELLS)).astype(np.int64)]))
                out.append(s[order[: len(s) + 1 + (-len(s) * percent) // 100]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n_shingles"), pa.array(out, pa.list_(pa.int64()))], names=["rep", "n_shingles", "tokens"])

    return map_batches(sets, first, "rep long, n_shingles long, tokens array<long>").select("rep", "n_shingles", F.explode("tokens").alias("token"))


def block_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all similar documents of different components in each group (token, rep, own).

    Per group, documents of the largest component (`main`) and the others are dealt to blocks; main meets only the others.
    """
    sizes = groups.groupBy("token", "own").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("own", F.struct("n", "own")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    parts = sizes.select("token", "main", F.ceil(F.col("n_main") / BLOCK).alias("k_main"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).alias("k"))
    rows = groups.join(parts, "token").withColumn("is_main", F.col("own") == F.col("main"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("k_main")).otherwise(F.col("k"))))
    place = lambda main, i, j, left, right: F.struct(F.lit(main).alias("main"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    yes, no, at = F.lit(True), F.lit(False), F.col("at")
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    with_main = F.transform(upto("k"), lambda i: place(True, i, at, no, yes))
    others = F.concat(F.transform(upto("k"), lambda j: place(False, F.least(at, j), F.greatest(at, j), at <= j, at >= j)), F.transform(upto("k_main"), lambda j: place(True, at, j, yes, no)))
    dealt = rows.select("token", "rep", "own", F.explode(F.when(F.col("is_main"), with_main).otherwise(others)).alias("p")).select("token", "rep", "own", "p.*")

    def compare(t: pa.Table) -> pa.Table:
        reps, owns = t.column("rep").to_pylist(), t.column("own").to_pylist()
        own_sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        right = [k for k, y in enumerate(t.column("right").to_pylist()) if y]
        up = {o: o for o in owns}

        def find(o: int) -> int:
            while up[o] != o:
                up[o] = o = up[up[o]]
            return o

        a, b = [], []
        if right:
            size = np.array([len(own_sets[k]) for k in right])
            known, flat = np.unique(np.concatenate([own_sets[k] for k in right]), return_inverse=True)
            edge = np.concatenate([[0], np.cumsum(size)[:-1]])
            seen = np.zeros(len(known), np.int32)
            for x in [k for k, y in enumerate(t.column("left").to_pylist()) if y]:
                s = own_sets[x]
                hit = np.minimum(np.searchsorted(known, s), len(known) - 1)
                hit = hit[known[hit] == s]
                seen[hit] = 1
                both = np.add.reduceat(seen[flat], edge).astype(np.int64)
                seen[hit] = 0
                for k in np.flatnonzero(100 * both >= percent * (len(s) + size - both)).tolist():
                    p, q = find(owns[x]), find(owns[right[k]])
                    if p != q:
                        up[p] = q
                        a.append(reps[x])
                        b.append(reps[right[k]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.join(sets.select("rep", "shingles"), "rep").groupBy("token", "main", "i", "j").applyInArrow(compare, "a long, b long")


def exhaust(own: DataFrame, buckets: DataFrame, labels: DataFrame, tried: DataFrame, width: int, percent: int) -> DataFrame:
    """Labels when no bucket holds a similar pair of different components any more."""
    now = _owned(buckets.select("band", "rep", "n_shingles"), labels)
    mixed = durable(now.join(several(now, "band"), "band"), "mixed")

    def by_pairs(groups: DataFrame, key: str) -> None:
        nonlocal labels, tried
        fresh = durable(_across(groups, key, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = durable(confirm(own, fresh, width, percent), "links")
        if not found.isEmpty():
            labels = merged(labels, found)
        tried = tried.unionByName(fresh)

    small = mixed.where(f"size <= {SMALL}")
    if not small.isEmpty():
        by_pairs(small, "band")
    # what is still mixed among the large ones is split by the shingles of prefixes
    now = _owned(mixed.where(f"size > {SMALL}").select("band", "rep"), labels)
    large = durable(now.join(several(now, "band"), "band").select("rep").distinct(), "large")
    if large.isEmpty():
        return labels
    sets = durable(full_sets(own, large, width), "sets")
    tokens = durable(prefixes(sets, percent), "prefixes")

    def groups() -> DataFrame:
        known = _owned(tokens, labels)
        return known.join(several(known, "token"), "token")

    by_pairs(groups().where(f"size <= {SMALL}"), "token")
    left = durable(groups().where(f"size > {SMALL}").select("token", "rep", "own").distinct(), "groups")
    if not left.isEmpty():
        found = durable(block_links(left, sets, percent), "links")
        if not found.isEmpty():
            labels = merged(labels, found)
    return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept.

    Rows whose text is null, empty or blank have no shingle and are linked with nothing. Rows of one doc_id count as one document.
    A null doc_id takes no part: its component_id is null and kept is true. Other columns are ignored. Texts are read whole, however
    long. Sets are compared by 64-bit hashes of their shingles, equal sets by a 128-bit digest of these.
    """
    signed = durable(signatures(docs, width, bands, rows), "signatures")
    real = signed.where(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
    # equal sets are one node from here on: the row of the smallest id carries its bands
    least = real.groupBy("print").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "n_shingles", "bands")).alias("x"))
    nodes = durable(least.select("print", "x.*"), "nodes")
    banded = nodes.select("rep", "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("z")).where("centre < z").drop("z")
    buckets = durable(banded.join(durable(shared, "shared"), "band").distinct(), "buckets")
    # only texts that share a bucket are compared: they are taken out once, however many rounds follow
    reps = durable(buckets.select("rep").distinct(), "reps")
    own = durable(docs.select("doc_id", "text").join(reps.withColumnRenamed("rep", "doc_id"), "doc_id"), "texts")
    tried = durable(buckets.select(F.col("rep").alias("a"), F.col("centre").alias("b")).where("a <> b").distinct(), "pairs")
    links = durable(confirm(own, tried, width, percent), "links")
    joined = durable(components(links), "joined").withColumnRenamed("id", "rep")
    labels = durable(reps.join(joined, "rep", "left").select(F.col("rep").alias("id"), F.coalesce("component", "rep").alias("component")), "labels")
    tried = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for turn in range(1, ROUNDS + 1):
        fresh = durable(redrawn(buckets, labels, turn, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = durable(confirm(own, fresh, width, percent), "links")
        tried = tried.unionByName(fresh)
        if found.isEmpty():
            break
        labels = merged(labels, found)
    labels = exhaust(own, buckets, labels, tried, width, percent)
    known = labels.withColumnRenamed("id", "rep")
    classes = durable(nodes.select("print", "rep").join(known, "rep", "left").select("print", F.coalesce("component", "rep").alias("component")), "classes")
    out = signed.select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
