"""Vectors as packed bytes, and the two operators on them: near-duplicates by an inverted multi-index (operator 4) and nearest
neighbours by collision counting (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm.common import durable, keep_fraction
from tallyforge.llm.components import components


def packed(table: DataFrame, key: str, column: str) -> DataFrame:
    """(id, dim, v) of the vectors that can be compared: their length, and themselves as float64 bytes.

    Left out: null ids, null, empty or zero vectors, null or non-finite components. Only vectors of one length are compared.
    """
    use = table.select(F.col(key).cast("long").alias("id"), F.col(column).alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = b.column("x"), b.column("id")
            flat = x.flatten()
            if not len(flat):
                continue
            holes = np.asarray(flat.is_null())
            v = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            size = np.diff(np.asarray(x.offsets)).astype(np.int64)
            first = np.cumsum(size) - size
            total = lambda a: np.add.reduceat(a, first)  # noqa: E731  no row is empty
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                norm = total(v * v)
            good = np.isfinite(norm) & (norm > 0) & (total(holes.astype(np.int64)) == 0)
            rows = [v[a : a + n].tobytes() for a, n, g in zip(first, size, good) if g]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(size[good].astype(np.int32)), pa.array(rows, pa.binary())], names=["id", "dim", "v"])

    return use.mapInArrow(pack, "id long, dim int, v binary")


def matrix(cells, dim: int) -> np.ndarray:
    """Rows of packed bytes as a matrix."""
    return np.frombuffer(b"".join(cells), np.float64).reshape(-1, dim)


def by_length(b: pa.RecordBatch, step: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, unit vectors) of the vectors of a batch, some at a time."""
    dims = b.column("dim").to_numpy()
    raw = b.column("v")
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            yield int(dim), part, unit(matrix((raw[int(r)].as_py() for r in part), int(dim)))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def kmeans(a: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    c = a[rng.choice(len(a), k, replace=False)].copy()
    for _ in range(steps):
        near = np.concatenate([squared(a[lo : lo + 1024], c).argmin(1) for lo in range(0, len(a), 1024)])
        n = np.bincount(near, minlength=k)
        for d in range(a.shape[1]):
            total = np.bincount(near, weights=a[:, d], minlength=k)
            c[:, d] = np.where(n > 0, total / np.maximum(n, 1), c[:, d])
    return c


class Grid:
    """Two codebooks whose product is the grid, and the distance to which the traversal of cells has to go.

    A vector's cells are visited by the sum of its two halves' squared distances to the cell's centres (less the smallest). The
    traversal goes on until `reach`, which is the distance at which the wanted share of partners exactly at the threshold, drawn
    in random directions around a sample, has been met. A pair is found if either side visits the other's cell.
    """

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.one, self.two = (kmeans(np.ascontiguousarray(h), k, rng) for h in (sample[:, : self.half], sample[:, self.half :]))
        self.k, self.reach = k, 0.0
        if k == 1:
            return
        away = rng.normal(size=sample.shape)
        away -= (away * sample).sum(1, keepdims=True) * sample
        away = unit(away + 1e-300)
        other = cosine * sample + np.sqrt(1 - cosine * cosine) * away
        at, gap = np.arange(1024), []
        for lo in range(0, len(sample), 1024):
            a, b = self.excess(sample[lo : lo + 1024])
            i, j = divmod(self.home(other[lo : lo + 1024]), k)
            gap.append(a[at[: len(a)], i] + b[at[: len(a)], j])
        self.reach = float(np.quantile(np.concatenate(gap), recall))

    def excess(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = squared(v[:, : self.half], self.one), squared(v[:, self.half :], self.two)
        return a - a.min(1, keepdims=True), b - b.min(1, keepdims=True)

    def home(self, v: np.ndarray) -> np.ndarray:
        a, b = self.excess(v)
        return a.argmin(1) * self.k + b.argmin(1)

    def visits(self, v: np.ndarray) -> Iterator[np.ndarray]:
        """For each row, its cells in multi-sequence order up to `reach`."""
        for a, b in zip(*self.excess(v)):
            i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            i, far = i[a[i] <= self.reach], b[j]
            upto = np.searchsorted(far, self.reach - a[i], side="right")
            cell = np.concatenate([x * self.k + j[:n] for x, n in zip(i, upto)])
            dist = np.concatenate([a[x] + far[:n] for x, n in zip(i, upto)])
            yield cell[np.argsort(dist, kind="stable")]


def fit_grids(nodes: DataFrame, cosine: float, recall: float, cell_rows: int, sample_rows: int) -> dict[int, Grid]:
    """A grid per length of vectors. The number of codes follows the number of vectors, so cells stay as full at any size; the
    sample has `sample_rows` vectors, or 16 per code where these are more (a documented bound: it grows as the square root)."""
    grids = {}
    for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # one row per length
        own = nodes.where(F.col("dim") == r.dim)
        k = max(1, round((r.n / cell_rows) ** 0.5))
        want = max(sample_rows, 16 * k)
        rows = own.where(keep_fraction(F.col("rep"), min(1.0, want / r.n))).orderBy("rep").select("v").toPandas() if k > 1 else ()
        if not len(rows):
            rows = own.orderBy("rep").limit(1).select("v").toPandas()
        sample = unit(matrix(rows["v"], r.dim))
        grids[r.dim] = Grid(sample, min(k, len(sample)), cosine, recall)
    return grids


def near_vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = 0.9, recall: float = 0.95, sample_rows: int = 8192, cell_rows: int = 200, home_rows: int = 1024, guest_rows: int = 2048) -> DataFrame:
    """One row per row of `table`: vec_id, n_links (other rows with a cosine of at least `cosine`), component_id and kept.

    The codebooks are fitted on a sample (see fit_grids); every vector is indexed. Equal vectors are one node with a count. A
    cell's vectors and its visitors are dealt in blocks, so that no cell, however full, is one task's; a block returns sums per
    vector and the edges of a star per local component, never its pairs. Vectors are compared with those of their own length.
    Vectors that cannot be compared (see packed) link with nothing and keep their own id; a null id gives a null component and is
    kept. Rows of one id count as one node. Other columns are ignored, whatever their names.
    """
    vectors = durable(packed(table, key, column), "vectors")
    nodes = durable(vectors.groupBy("dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "nodes")
    ids = table.select(F.col(key).cast("long").alias("vec_id"))
    shared = table.sparkSession.sparkContext.broadcast(fit_grids(nodes, cosine, recall, cell_rows, sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, _, x in by_length(b):
                grid = shared.value[dim]
                cells, at = np.unique(np.concatenate([grid.home(x), *grid.visits(x)]), return_inverse=True)
                here = np.bincount(at[: len(x)], minlength=len(cells))
                there = np.bincount(at[len(x) :], minlength=len(cells))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), dim, np.int32)), pa.array(cells), pa.array(here), pa.array(there)], names=["dim", "cell", "here", "there"])

    parts = lambda c, rows: F.greatest(F.lit(1), F.ceil(F.sum(c) / rows)).cast("int")
    load = nodes.select("dim", "v").mapInArrow(count, "dim int, cell long, here long, there long").groupBy("dim", "cell").agg(parts("here", home_rows).alias("homes"), parts("there", guest_rows).alias("guests"), F.sum("here").alias("here"))
    # only full cells are dealt to several blocks; cells without a vector of their own have no one to visit
    load = durable(load.where("here > 0").drop("here"), "load")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector goes as host to its own cell, and as guest to the cells that it visits."""
        for b in batches:
            for dim, rows, x in by_length(b, 256):
                grid = shared.value[dim]
                cells = list(grid.visits(x))
                cell = np.concatenate([grid.home(x), *cells])
                at = pa.array(np.concatenate([rows, np.repeat(rows, [len(c) for c in cells])]))
                guest = np.arange(len(cell)) >= len(x)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(guest), *(b.column(c).take(at) for c in ("dim", "rep", "copies", "v"))], names=["cell", "guest", "dim", "rep", "copies", "v"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        g, h = pdf[pdf["guest"]], pdf[~pdf["guest"]]
        none = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "low": pd.Series(dtype="int64")})
        if not len(g) or not len(h):
            return none
        dim = int(pdf["dim"].iloc[0])
        grid = shared.value[dim]
        a, b = unit(matrix(g["v"], dim)), unit(matrix(h["v"], dim))
        gi, hi = g["rep"].to_numpy(), h["rep"].to_numpy()
        near = (a @ b.T >= cosine) & (gi[:, None] != hi)
        some, any_ = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(some):
            return none
        near, a, b, gi, hi = near[some][:, any_], a[some], b[any_], gi[some], hi[any_]
        gc, hc = g["copies"].to_numpy()[some], h["copies"].to_numpy()[any_]
        # a host that visits its guest's cell counts this guest there; else it counts it here
        i, j = divmod(grid.home(a), grid.k)
        da, db = grid.excess(b)
        lone = near & ~((da[:, i] + db[:, j]).T <= grid.reach)
        links_g, links_h = near @ hc, gc @ lone
        low_g, low_h = gi.copy(), hi.copy()
        big = np.iinfo(np.int64).max
        while True:
            new_h = np.minimum(low_h, np.where(near, low_g[:, None], big).min(0))
            new_g = np.minimum(low_g, np.where(near, new_h[None, :], big).min(1))
            if (new_g == low_g).all() and (new_h == low_h).all():
                break
            low_g, low_h = new_g, new_h
        return pd.DataFrame({"rep": np.concatenate([gi, hi]), "links": np.concatenate([links_g, links_h]), "low": np.concatenate([low_g, low_h])})

    sent = nodes.select("dim", "rep", "copies", "v").mapInArrow(send, "cell long, guest boolean, dim int, rep long, copies long, v binary")
    spread = F.xxhash64(F.lit("deal"), "rep")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.transform(upto("guests"), lambda j: F.struct(F.pmod(spread, F.col("homes")).cast("int").alias("i"), j.alias("j")))
    theirs = F.transform(upto("homes"), lambda i: F.struct(i.alias("i"), F.pmod(spread, F.col("guests")).cast("int").alias("j")))
    dealt = sent.join(load, ["dim", "cell"]).select("dim", "cell", "guest", "rep", "copies", "v", F.explode(F.when(F.col("guest"), theirs).otherwise(mine)).alias("block"))
    met = durable(dealt.groupBy("dim", "cell", "block").applyInPandas(meet, "rep long, links long, low long"), "met")
    sums = met.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = durable(components(met.select(F.col("rep").alias("a"), F.col("low").alias("b"))), "labels").withColumnRenamed("id", "rep")
    known = nodes.join(sums, "rep", "left").join(labels, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = vectors.join(durable(known, "known"), "v").groupBy(F.col("id").alias("vec_id")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = ids.join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))


class Collisions:
    """Sorted projections of one block of vectors, with query-centred windows that grow by virtual rehashing.

    At radius r a window reaches `width * r` to both sides of the query on each line, so a vector at distance r collides on a line
    with one fixed probability, whatever r is. Windows grow and a vector's collisions are counted on; vectors with at least `share`
    of all lines are verified. The search ends when `k` verified vectors lie within the radius, or when the windows hold the whole
    block. `verified` counts the vectors that were compared with a query.
    """

    def __init__(self, ids: np.ndarray, raw: np.ndarray, lines: np.ndarray, width: float, share: float, start: float, grow: float):
        self.ids, self.raw = ids, raw
        self.norm = np.sqrt((raw * raw).sum(1))
        p = (raw / self.norm[:, None]) @ lines
        self.order = np.argsort(p, axis=0).T.copy()
        self.sorted = np.take_along_axis(p.T, self.order, 1)
        self.need = int(np.ceil(share * lines.shape[1]))
        # no two unit vectors are further apart than 2; the last windows hold every vector
        radii = start * grow ** np.arange(int(np.ceil(np.log(2 / start) / np.log(grow))) + 1)
        self.radii = np.append(radii, np.inf)
        self.reach = width * self.radii
        self.verified = 0

    def nearest(self, query_id: int, q: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the nearest vectors found, nearest first, equal ones by id."""
        n = self.sorted.shape[1]
        q_norm = np.sqrt((q * q).sum())
        hits = np.zeros(n, np.int64)
        done = self.ids == query_id
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        los = np.array([np.searchsorted(s, x - self.reach, side="left") for s, x in zip(self.sorted, at)]).T
        his = np.array([np.searchsorted(s, x + self.reach, side="right") for s, x in zip(self.sorted, at)]).T
        old_lo = old_hi = None
        for radius, lo, hi in zip(self.radii, los.tolist(), his.tolist()):
            if old_lo is None:
                parts = [o[a:z] for o, a, z in zip(self.order, lo, hi)]
            else:
                parts = [o[a:z] for o, a, z in zip(self.order, lo, old_lo)] + [o[a:z] for o, a, z in zip(self.order, old_hi, hi)]
            old_lo, old_hi = lo, hi
            hits += np.bincount(np.concatenate(parts), minlength=n)
            fresh = np.flatnonzero((hits >= self.need) & ~done)
            if len(fresh):
                done[fresh] = True
                self.verified += len(fresh)
                v = self.raw[fresh]
                ids = np.concatenate([ids, self.ids[fresh]])
                scores = np.concatenate([scores, (v * q).sum(1) / (self.norm[fresh] * q_norm)])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k and 2 - 2 * scores[-1] <= radius * radius:
                break
        return ids, scores


def nearest_neighbours(table: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 5, lines: int = 128, width: float = 0.95, share: float = 0.62, start: float = 0.8, grow: float = 1.06, block_rows: int = 8192, query_rows: int = 512, seed: int = 5) -> DataFrame:
    """The k nearest rows found for every query by cosine: query_id, rank from 1, vec_id, score.

    All rows are indexed, in blocks of about `block_rows`; queries come in blocks of about `query_rows`, and each pair of blocks
    is one task's work in bounded memory. A query's own id is no candidate, whatever its row holds. Vectors are compared with those
    of their own length. Vectors that cannot be compared (see packed) take no part on either side; fewer than k candidates give as
    many rows. Ties go to the smaller id; repeated rows are candidates each. Of several query rows with one id, that whose vector
    is smallest by length and bytes is asked. Other columns are ignored, whatever their names.
    """
    vectors = durable(packed(table, key, column), "vectors")
    asked = packed(queries, key, column).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.*")
    asked = durable(asked, "queries")
    schema = "query_id long, vec_id long, score double"
    # one row per length of vectors: blocks of rows, parts of queries
    tall = lambda n, rows: F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(0)) / rows)).cast("int")
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n")).join(asked.groupBy("dim").agg(F.count("*").alias("m")), "dim")
    sizes = durable(sizes.select("dim", tall(F.col("n"), block_rows).alias("blocks"), tall(F.col("m"), query_rows).alias("parts")), "sizes")
    salt = lambda name, m: F.pmod(F.xxhash64(F.lit(name), "id", "v"), F.col(m)).cast("int")
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    data = vectors.join(sizes, "dim").select("dim", salt("row", "blocks").alias("block"), upto("parts").alias("part"), F.lit(False).alias("asks"), "id", "v")
    probe = asked.join(sizes, "dim").select("dim", upto("blocks").alias("block"), salt("query", "parts").alias("part"), F.lit(True).alias("asks"), "id", "v")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        out = []
        if len(mine) and len(theirs):
            dim = int(pdf["dim"].iloc[0])
            axes = np.random.default_rng([seed, dim]).normal(size=(dim, lines))
            index = Collisions(mine["id"].to_numpy(), matrix(mine["v"], dim), axes, width, share, start, grow)
            q = matrix(theirs["v"], dim)
            at = unit(q) @ axes
            for i, query_id in enumerate(theirs["id"].to_numpy()):
                ids, scores = index.nearest(query_id, q[i], at[i], k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = durable(data.unionByName(probe).groupBy("dim", "block", "part").applyInPandas(search, schema), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
