"""N-best segmentation against all segmentations, and exact round trips."""

import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyforge.llm.pieces import SCALE, SPACE, Lattice, decode, segment
from tallyforge.llm.tokens import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
L = Lattice(MODEL)


def every(text):
    """(score, ids) of all segmentations of a marked text, without the lattice."""
    if not text:
        return [(0, ())]
    out = []
    for end in range(1, len(text) + 1):
        if hit := L.known.get(text[:end]):
            out += [(hit[1] + s, (hit[0], *ids)) for s, ids in every(text[end:])]
    if text[0] not in L.known:
        raw = text[0].encode()
        out += [(len(raw) * L.byte_score + s, (*(L.byte[b] for b in raw), *ids)) for s, ids in every(text[1:])]
    return out


@given(st.text(alphabet="the anér\n ", min_size=1, max_size=11), st.integers(1, 6))
@settings(max_examples=120, deadline=None)
def test_n_best_of_all_segmentations(text, n):
    ways = {ids: s / SCALE for s, ids in every(SPACE + text.replace(" ", SPACE))}
    got = L.encode(text, n)
    assert [s for s, _ in got] == sorted(ways.values(), reverse=True)[:n]
    assert all(ways[tuple(ids)] == s for s, ids in got) and len({tuple(i) for _, i in got}) == len(got)
    assert all(L.decode(ids) == text for _, ids in got)


@given(st.text(alphabet="aeinrst\n ", min_size=1, max_size=30))
@settings(max_examples=300, deadline=None)
def test_forward_and_search_choose_the_same(text):
    for word in text.split():
        ((_, ids),) = L.search(word, 1)
        _, _, (best,) = L.forward([word])
        assert ids == best


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_round_trip(text):
    for _, ids in L.encode(text, 3):
        assert L.decode(ids) == text


@pytest.mark.parametrize("text", ["▁ a▁", "\U0010ffff x ▁", "", " ", "  two  ", "a\n\nb", "😀", "x" * 3000])
def test_odd_texts(text):
    for _, ids in L.encode(text, 3):
        assert L.decode(ids) == text


def test_batches_keep_results():
    small = Lattice(MODEL, most=5)
    batch = [f"word{i} other{i % 3} thing" for i in range(20)]
    assert [small.encode_batch([t], 3)[0] for t in batch] == L.encode_batch(batch, 3)


def test_words_of_unlike_lengths():
    """A short word keeps its second choice beside one that is hundreds of letters longer."""
    words = sorted(["▁short", "▁thing", "▁é", "▁" + "ab" * 80, "▁" + "ab" * 1500], key=len)
    score, gap, ids = L.forward(words)
    for i, w in enumerate(words):
        ways = L.search(w, 2)
        assert (score[i], ids[i], gap[i]) == (*ways[0], ways[0][0] - ways[1][0])


@given(st.lists(st.tuples(st.text(alphabet="thein é\n▁", max_size=30), st.integers(0, 400)), max_size=6), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_batches_as_by_search(parts, n):
    batch = [text + " " + "ab" * long for text, long in parts]
    assert Lattice(MODEL, most=30).encode_batch(batch, n) == [L._spelt_out(t, n) for t in batch]


def test_new_words_cost_little():
    """Some 36,000 new words, against a plain loop on the same core."""
    draw = random.Random(1)
    text = " ".join({"".join(draw.choice("aeinrstohdlu") for _ in range(draw.randrange(3, 12))) for _ in range(40_000)})

    def took(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    plain, own = zip(*((took(lambda: sum(range(2_000_000))), took(lambda: lattice.encode(text, 3))) for lattice in [Lattice(MODEL) for _ in range(5)]))
    assert min(own) < 9 * min(plain)


@pytest.mark.parametrize("word", ["x" * 100_000, "thein" * 20_000, "".join(chr(97 + i * i % 26) for i in range(100_000))])
def test_long_words(word):
    start = time.time()
    ways = L.encode(word, 3)
    assert time.time() - start < 40 and len(ways) == 3  # seconds on a free core
    assert all(L.decode(ids) == word for _, ids in ways) and len({tuple(ids) for _, ids in ways}) == 3
    assert ways[0][0] >= ways[1][0] >= ways[2][0]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the thing", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "é ▁", 9), (4, "long word " * 20_000, 9)], "doc_id long, text string, ids int")
    out = segment(docs, MODEL).collect()
    assert len(out) == 6 and all(r.exact and r.counts == [len(i) for i in r.ids] and len(r.scores) == len(r.ids) for r in out)
    assert all(zlib.crc32(np.array(i, "<i4").tobytes()) == c for r in out for i, c in zip(r.ids, r.crcs))
    assert {r.doc_id for r in out if r.counts == [0]} == {2, 3} and [r.scores for r in out if r.doc_id == 2] == [[0.0]]
    assert segment(docs.limit(0), MODEL, with_ids=False).count() == 0
    second = segment(docs, MODEL).selectExpr("doc_id", "get(ids, 1) AS ids", "1 AS text")
    got = {r.doc_id: r.text for r in decode(second, MODEL).collect()}
    assert got[1] == "the thing" and got[2] is None and got[4] == "long word " * 20_000
