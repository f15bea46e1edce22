"""Vector operators against brute force."""

import numpy as np

from tallyforge.llm.vectors import Collisions, near_vectors, nearest_neighbours, unit
from tests.llm.test_neardup import roots


def planted(seed=3, n=1500, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for g in range(0, 300, 10):
        for j in range(1, rng.integers(2, 10)):
            x[g + j] = x[g + j - 1] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.3])
    x[700:900] = x[699] + rng.normal(size=(200, dim)) * 0.02
    return x


def test_links_and_components(spark):
    x = planted()
    rows = [(i * 7 % 2003, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] * 16, 1), (3004, [1.0], 1), (None, rows[0][1], 1)]
    t = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links int")
    out = near_vectors(t, home_rows=64, guest_rows=128, cell_rows=20).collect()
    assert len(out) == len(rows) + len(odd)
    ids = np.array([r[0] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want_links = dict(zip(ids.tolist(), near.sum(1).tolist()))
    want = roots(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(near)) if a < b])
    got = {r.vec_id: r for r in out}
    total, have = sum(want_links.values()), sum(got[i].n_links for i in want_links)
    assert 0.98 * total <= have <= total and all(got[i].n_links <= want_links[i] for i in want_links)
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.98
    assert all(got[i].component_id == i and got[i].n_links == 0 and got[i].kept for i in range(3000, 3005)) and got[None].kept
    assert near_vectors(t.limit(0)).count() == 0


def test_equal_vectors_count(spark):
    t = spark.createDataFrame([(i, [1.0, 2.0, 3.0, float(i > 7)]) for i in range(10)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(t).collect()}
    assert got == {i: (9, 0) for i in range(10)}


def test_nearest(spark):
    x = planted(4)
    x[20] = x[21]
    t = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(9000, None, "y"), (9050, [0.0] * 16, "y")], "vec_id long, embedding array<double>, rank string")
    out = nearest_neighbours(t, t.where("vec_id % 50 = 0"), block_rows=400, query_rows=16).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, len(x), 50):
        own = out[out.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        s = u @ u[q]
        np.testing.assert_allclose(own.score, s[own.vec_id], atol=1e-12)
        s[q] = -2
        hit += len(set(np.argsort(-s, kind="stable")[:5]) & set(own.vec_id))
        total += 5
    assert hit / total >= 0.95 and not set(out.query_id) & {9000, 9050}
    few = t.where("vec_id < 3")
    assert nearest_neighbours(few, few).count() == 6
    assert nearest_neighbours(t.limit(0), t.limit(0)).count() == 0


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.1]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.1]), (5, [1.0]), (6, []), (7, [2.0, -1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(t).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7)}
    found = sorted((r.query_id, r.rank, r.vec_id) for r in nearest_neighbours(t, t).collect())
    assert found == [(1, 1, 2), (1, 2, 7), (2, 1, 1), (2, 2, 7), (3, 1, 4), (4, 1, 3), (7, 1, 1), (7, 2, 2)]


def test_ties_and_repeated_ids(spark):
    rows = [(9, [1.0, 0.0]), (9, [0.0, 1.0]), (4, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [1.0, 1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = nearest_neighbours(t, t.where("vec_id = 9"), k=3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in own] == [(1, 3), (2, 4), (3, 4)]
    assert {r.score for r in own} == {1 / np.sqrt(2)} or np.allclose([r.score for r in own], 0.5**0.5)


def test_planted_partners_in_64_dimensions(spark):
    rng = np.random.default_rng(8)
    base = unit(rng.normal(size=(4000, 64)))
    away = rng.normal(size=(1000, 64))
    away = unit(away - (away * base[:1000]).sum(1, keepdims=True) * base[:1000])
    cos = rng.uniform(0.9, 0.95, (1000, 1))
    x = np.vstack([base, cos * base[:1000] + np.sqrt(1 - cos**2) * away])
    t = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in near_vectors(t, cell_rows=20).collect()}
    u = unit(x)
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert sum(found.values()) >= 0.95 * want.sum() and all(found[i] <= want[i] for i in found)


def test_few_vectors_are_verified():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8192, 64))
    u = unit(x)
    axes = np.random.default_rng([5, 64]).normal(size=(64, 128))
    index = Collisions(np.arange(len(x)), x, axes, 0.95, 0.62, 0.8, 1.06)
    hit = 0
    for q in range(40):
        ids, _ = index.nearest(q, x[q], u[q] @ axes, 5)
        s = u @ u[q]
        s[q] = -2
        hit += len(set(ids) & set(np.argsort(-s)[:5]))
    assert hit >= 0.9 * 200 and index.verified <= 0.2 * 40 * len(x)
