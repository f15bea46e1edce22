"""Multiple-instance learning: gradient, held-out accuracy, located sentences and edge cases."""

import re

import numpy as np

from tallyforge.llm.common import held_out
from tallyforge.llm.toxicity import BITS, Model, Scorer, document_score, features, fit, noisy_or, score, slope

SF = "/root/testdata/sf0.1"


def test_noisy_or_by_hand():
    m = Model(np.zeros(1 << 18), -2.0)
    for f in features("moron"):
        m.weights[f] = 1.0
    got = Scorer(m).sentences("Fine day. You MORON!\nİ moron")
    assert [(s, e) for s, e, _ in got] == [(0, 8), (9, 19), (21, 28)]
    z = -2.0 + len(features("moron"))
    p = 1 / (1 + np.exp(-z))
    np.testing.assert_allclose([x for *_, x in got][1:], [p, p])
    np.testing.assert_allclose(noisy_or([0.5, 0.5]), 0.75)
    np.testing.assert_allclose(document_score([0.5, 0.5, 0.01]), 0.75)
    np.testing.assert_allclose(document_score([0.05, 0.05]), 0.49 * (1 - 0.95**2))
    assert document_score([0.001] * 100_000) <= 0.49 and document_score([]) == 0


def test_held_out_and_located(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels.where(~held_out(labels.doc_id)))
    got = score(docs, model).join(labels, "doc_id").where(held_out(labels.doc_id)).toPandas()
    en = got[got.toxic == 1]
    assert got[got.toxic == 0].predicted.mean() < 0.03 and en.predicted.mean() > 0.75
    # clean documents joined to one of 100,000 letters and more stay clean, and one toxic sentence in it is still seen
    clean = " ".join(r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").where("text IS NOT NULL").orderBy("doc_id").limit(60).collect())
    bad = docs.where(docs.doc_id == int(en.sort_values("score").doc_id.iloc[-1])).first().text
    long = spark.createDataFrame([(1, clean), (2, clean + "\n" + bad)], "doc_id long, text string")
    assert len(clean) > 100_000 and {r.doc_id: r.predicted for r in score(long, model).collect()} == {1: 0, 2: 1}
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = " ".join(texts[r.doc_id][s["start"] : s["end"]].lower() for r in en.itertuples() for s in r.offending)
    assert "idiot" in words or "moron" in words or "stupid" in words


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "you idiot. fine", 0), (3, "you idiot. fine", 0), (None, "ok. " * 50_000, 0), (4, "kind words", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (2, None), (1, 1)], "doc_id long, toxic int")
    model = fit(docs, labels)
    out = score(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert fit(docs, labels.limit(0)) is None
    assert {r.score for r in score(docs, None).collect()} == {0.0}
    assert score(docs.limit(0), model).count() == 0


def test_slopes_by_finite_differences():
    rng = np.random.default_rng(1)
    label, plain = np.array([1.0, 0, 1, 0, 1]), np.array([0.0, 3, 2, 0, 5])
    doc = np.array([0, 0, 1, 2, 3, 3])
    sent, feat = np.array([0, 0, 1, 2, 3, 4, 5, 5]), np.array([0, 1, 2, 1, 3, 0, 2, 3])
    for _ in range(20):
        w, b, e = rng.normal(size=4), rng.normal() - 1, 1e-6
        at = lambda w, b: slope(label, plain, doc, sent, feat, w, b)[0]
        _, dw, db = slope(label, plain, doc, sent, feat, w, b)
        steps = np.eye(4) * e
        np.testing.assert_allclose(dw, [(at(w + s, b) - at(w - s, b)) / (2 * e) for s in steps], rtol=1e-4, atol=1e-6)
        np.testing.assert_allclose(db, (at(w, b + e) - at(w, b - e)) / (2 * e), rtol=1e-4, atol=1e-6)


def test_query_against_plain_scores(spark):
    """op2_toxicity on a whole table against a sum over words, written out from the model that the query's own fit gives."""
    from tallyforge.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels.where(~held_out(labels.doc_id)))
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        none = strong = 1.0
        for s in re.split(r"[.!?\n]+", (r.text or "").lower()):
            if s:
                z = model.bias + sum(model.weights[f] for w in set(re.findall(r"[^\W\d_]+", s)) for f in features(w))
                p = 1 / (1 + np.exp(-z))
                none *= 1 - p
                strong *= 1 - p if p >= 0.1 else 1
        np.testing.assert_allclose(got[r.doc_id].score, max(1 - strong, 0.49 * (1 - none)), atol=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and model.weights.shape == (1 << BITS,)


def test_wide_sample_needs_no_broadcast(spark):
    """More marks than the checked size: the join is a shuffle and the model the same."""
    docs = spark.createDataFrame([(i, "you fool. fine" if i % 2 else "kind words") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    many = labels.unionByName(spark.range(1000, 1400).selectExpr("id AS doc_id", "int(id % 2) AS toxic"))
    model = fit(docs, many, rows_per_label=40)
    assert model is None or np.isfinite(model.weights).all()
    assert (fit(docs, labels).weights == fit(docs.repartition(3), labels).weights).all()
