"""Near duplicates against all pairs, components against union-find, and edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import neardup
from tallyforge.llm.common import byte_rows
from tallyforge.llm.components import components
from tallyforge.llm.neardup import Signer, near_duplicates, shingle_sets


def plain_set(text, width=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def truth(rows, width=2):
    sets = {i: plain_set(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, roots(ids, links)


def test_set_sizes_match():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB é\t\n\x0b") for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "one", None]
    got = shingle_sets(*byte_rows(pa.array(texts)))
    assert [len(s) for s in got] == [len(plain_set(t)) for t in texts]
    assert not np.intersect1d(got[-2], shingle_sets(*byte_rows(pa.array(["one one"])))[0]).size


def test_densified_bins_estimate_similarity():
    s = Signer(24, 4)
    rng = np.random.default_rng(2)
    u = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2))
    a, b = u[:50], u[10:]
    x = np.mean([s.bins_of(a) == s.bins_of(b)])
    assert abs(x - 40 / 60) < 0.25 and (s.bins_of(u[:1]) == u[0]).all()


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({i for e in links for i in e}, links)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        text = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 30, 80]))]
        for _ in range(rng.choice([1, 1, 4, 12])):
            t = list(text)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows) * 3 % 1009, " ".join(t)))
            text = t if rng.random() < 0.5 else text  # chains
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "Same Text"), (5004, "same\ttext"), (5005, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, "Same Text", "y")], "doc_id long, text string, component_id string")
    sets, want = truth(rows)
    out = near_duplicates(docs, width=2).collect()
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == len(rows) + 1
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert near_duplicates(docs.limit(0), width=2).count() == 0


def boilerplate(pairs, others):
    """Texts of a shared passage and a few own words: any two are just too unlike for a link, except the first ones with their twins."""
    rng = random.Random(21)
    passage, word = [f"b{i}" for i in range(100)], lambda: f"x{rng.randrange(10**9)}"
    rows = [passage + [word() for _ in range(13)] for _ in range(others)]
    rows += [t[:102] + [word() for _ in range(11)] for t in rows[:pairs]]
    order = rng.sample(range(len(rows)), len(rows))
    return [(i, " ".join(rows[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("small, block", [(32, 256), (4, 64)])
def test_no_pair_of_a_mixed_bucket_is_left_out(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = boilerplate(4, 400)
    _, want = truth(rows)
    assert len(set(want.values())) == 400
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_blocks_join_all_similar_documents(spark):
    rng = random.Random(4)
    base = [[rng.randrange(1 << 40) for _ in range(40)] for _ in range(12)]
    sets = {i: sorted({*base[i % 12][rng.randrange(5) :], rng.randrange(1 << 40)}) for i in range(700)}
    own = {i: (0 if i % 12 == 0 and i < 600 else i) for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})]
    groups = spark.createDataFrame([(7, i, own[i]) for i in sets], "token long, rep long, own long")
    table = spark.createDataFrame([(i, len(s), bytearray(np.array(s, np.uint64).tobytes())) for i, s in sets.items()], "rep long, n_shingles long, shingles binary")
    found = [(r.a, r.b) for r in neardup.block_links(groups, table, 80).collect()]
    assert {*map(frozenset, found)} <= {*map(frozenset, links)}
    known = [(i, o) for i, o in own.items()]
    assert roots(sets, found + known) == roots(sets, links + known)
