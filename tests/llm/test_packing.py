"""Packing against brute force, and its edge cases."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyforge.llm.packing import closest_fill, pack, pack_plan, padding
from tallyforge.llm.tokens import DocumentTokenizer, tokenizer_path


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_closest_fill_is_optimal(left, capacity):
    used = closest_fill(left, capacity)
    assert all(n <= left[k] for k, n in used.items())
    options = [range(n + 1) for n in left.values()]
    best = max(s for c in itertools.product(*options) if (s := sum(k * n for k, n in zip(left, c))) <= capacity)
    assert sum(k * n for k, n in used.items()) == best


def test_plan_places_all_pieces():
    rng = np.random.default_rng(3)
    counts = {k: int(n) for k, n in zip(range(1, 2049), rng.integers(1, 900, 2048))}
    plan = pack_plan(counts)
    got = defaultdict(int)
    for times, used in plan:
        assert sum(k * n for k, n in used.items()) <= 2048
        for k, n in used.items():
            got[k] += times * n
    assert dict(got) == counts
    assert padding(plan) < 0.02 * sum(k * n for k, n in counts.items())


@pytest.mark.parametrize("text", ["", " ", "a", "a  b", "x \n y", "a\n\nb", "<|endoftext|> a<|endoftext|>", "it's 12 é ü", "\x1c a", "😀 😀\n😀", "tab\tx"])
def test_ids_match_the_library(text):
    tok = DocumentTokenizer(tokenizer_path())
    assert tok.ids(text).tolist() == tok.library.encode(text, add_special_tokens=False).ids


def test_pack_rows(spark):
    long = "thin anon " * 3000
    rows = [(1, long, "x"), (2, None, "x"), (3, "", None), (3, "", None), (None, "one two", "y"), *[(10 + i, "same text here", "y") for i in range(300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = pack(docs, tokenizer_path()).collect()
    tok = DocumentTokenizer(tokenizer_path())
    want = defaultdict(int)
    for doc_id, text, _ in rows:
        ids = np.append(tok.ids(text), np.uint32(1)).astype("<u4")
        for at in range(0, len(ids), 2048):
            want[doc_id, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)] += 1
    got = defaultdict(int)
    seqs = defaultdict(list)
    for r in out:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        seqs[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(docs.limit(0), tokenizer_path()).count() == 0
