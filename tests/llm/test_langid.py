"""Code lengths against a plain PPM, and held-out accuracy."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tallyforge.llm.common import byte_rows, held_out
from tallyforge.llm.langid import fit, fold, identify

SF = "/root/testdata/sf0.01"


def plain_bits(train: dict, langs: list[str], alphabet: int, codes: list[int], lang: str) -> float:
    """PPM with method C and exclusion, symbol by symbol."""
    total = 0.0
    for i in range(3, len(codes)):
        p, gone, factor = None, set(), 1.0

        def dist(k):
            ctx = tuple(codes[i - k : i]) if k > 0 else ()
            if k < 0:
                return {s: 1 / alphabet for s in range(alphabet)}
            below = dist(k - 1)
            c = train[lang, k].get(ctx)
            if not c:
                return below
            n, q = sum(c.values()), len(c)
            left = {s: v for s, v in below.items() if s not in c}
            if not left:
                return {s: c[s] / n for s in c}
            z = sum(left.values())
            return {s: c[s] / (n + q) for s in c} | {s: q / (n + q) * v / z for s, v in left.items()}

        d = dist(3)
        assert abs(sum(d.values()) - 1) < 1e-9
        total -= np.log2(d[codes[i]])
    return total


def test_code_lengths_are_those_of_ppm(spark):
    rows = [(1, "abab Abba ab", "x"), (2, "bcbc cb; cbc", "y"), (3, "aab baa É", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = fit(docs)
    train = defaultdict(lambda: defaultdict(Counter))
    for _, text, lang in rows:
        sym, (first, last) = fold(*byte_rows(pa.array([text])))
        c = m.symbol[sym].tolist()
        for i in range(3, len(c)):
            for k in range(4):
                train[lang, k][tuple(c[i - k : i]) if k else ()][c[i]] += 1
    for text in ("abba cab", "zzz", "É b", "b" * 50):
        sym, _ = fold(*byte_rows(pa.array([text])))
        want = [plain_bits(train, m.languages, m.size, m.symbol[sym].tolist(), lang) for lang in m.languages]
        got, _ = m.code_lengths(*byte_rows(pa.array(["", text, None])))
        np.testing.assert_allclose(got[1], want, rtol=1e-5)
        assert not got[0].any() and not got[2].any()


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs.where(~held_out(docs.doc_id)))
    got = identify(docs, model, keep=("doc_id", "lang")).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.99
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !?", "a"), (None, "the thing and of", "b"), (5, "der die und " * 20_000, None), (5, "der die und " * 20_000, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    res = identify(odd, model).collect()
    by = {r.doc_id: r for r in res}
    assert len(res) == 6 and [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[5].lang_pred == "de" and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in res)
    none = fit(docs.limit(0))
    assert none is None and {r.lang_pred for r in identify(odd, none).collect()} == {"und"}
    assert identify(odd.limit(0), model).count() == 0
