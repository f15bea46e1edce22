"""Toxicity by multiple-instance learning (operator 2).

A document is a bag of sentences. A sentence's score is a logistic of the summed weights of its words and word prefixes; the
document's score is the noisy-or of its sentences. Only documents have labels in training, the gradient runs through the
noisy-or, and afterwards the sentence scores say where in the text the label comes from. In scoring, sentences below `FLOOR` alone
make no document toxic: each clean sentence has a small score, and thousands of them in one long text would add up to certainty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import durable, keep_fraction, map_batches, texts

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Features are hashed into 2**BITS weights.
BITS = 18
PREFIXES = (3, 4, 5, 6)
#: Sentences that score less are no evidence by themselves, and the most that all sentences give a document without further evidence.
FLOOR, WEAK = 0.1, 0.49
SPANS = "array<struct<start:int,end:int,score:double>>"


def features(word: str) -> list[int]:
    """The hashed features of a lower-case word: itself, and its beginnings."""
    out = [zlib.crc32(b"=" + word.encode()) & (1 << BITS) - 1]
    out += [zlib.crc32(b"^" + word[:k].encode()) & (1 << BITS) - 1 for k in PREFIXES if len(word) > k]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float


#: A bag: label, number of sentences without a kept feature, sizes of the others, their features sentence by sentence.
Bag = tuple[int, int, np.ndarray, np.ndarray]


def slope(label: np.ndarray, plain: np.ndarray, doc: np.ndarray, sent: np.ndarray, feat: np.ndarray, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """Log-likelihood of the labels under the noisy-or, and its slopes by the weights and the bias.

    doc: the bag of each sentence with features; sent, feat: which sentence has which feature; plain: further sentences per bag.
    """
    z = b + np.bincount(sent, weights=w[feat], minlength=len(doc))
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    bare = 1 / (1 + np.exp(-b))
    none = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(label)) + plain * np.log1p(-bare))
    some = np.maximum(1 - none, 1e-9)
    scale = np.where(label > 0, none / some, -1.0)
    step = p * scale[doc]
    likelihood = float(np.where(label > 0, np.log(some), np.log(np.maximum(none, 1e-300))).sum())
    return likelihood, np.bincount(feat, weights=step[sent], minlength=len(w)), float(step.sum() + (plain * bare * scale).sum())


def _learn(bags: list[Bag], steps: int, rate: float, decay: float) -> Model:
    """Gradient ascent on the likelihood of the document labels; a feature counts once in a sentence."""
    label = np.array([y for y, _, _, _ in bags], float)
    plain = np.array([m for _, m, _, _ in bags], float)
    doc = np.repeat(np.arange(len(bags)), [len(s) for _, _, s, _ in bags])
    sent = np.repeat(np.arange(len(doc)), np.concatenate([s for _, _, s, _ in bags]))
    used, feat = np.unique(np.concatenate([f for _, _, _, f in bags]), return_inverse=True)
    w, b = np.zeros(len(used)), float(np.log(1e-3))
    gw, gb = np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        _, dw, db = slope(label, plain, doc, sent, feat, w, b)
        dw -= decay * w
        gw += dw * dw
        gb += db * db
        w += rate * dw / np.sqrt(gw)
        b += rate * db / np.sqrt(gb)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights, b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", rows_per_label: int = 3000, least: int = 2, lift: float = 2.0, steps: int = 300, rate: float = 0.5, decay: float = 0.05) -> Model | None:
    """Learn from the whole texts of about `rows_per_label` labelled rows of either label, chosen by a hash: a documented bound.

    A feature is kept if at least `least` documents of label 1 have it, in a share at least `lift` times that of label 0: sentences
    are marked by what speaks for label 1, and the bias speaks for label 0. Features are counted where the texts are, and only kept
    ones are sent. Rows without text or with another label than 0 and 1 are left out; a document counts once for each of its labels,
    and as often as it is repeated. None if a label has no row.
    """
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).alias("label"))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rare = lambda y: keep_fraction(F.col("key").cast("string"), min(1.0, rows_per_label / counts[y]))
    marks = marks.where(F.when(F.col("label") == 1, rare(1)).otherwise(rare(0))).distinct()
    if marks.count() <= 8 * rows_per_label:  # the sample's size is checked, then the texts need no shuffle
        marks = F.broadcast(marks)
    bags = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(marks, "key").select("text", "label")
    bags = durable(bags, "labelled")  # a bounded sample, read twice

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for y, t in zip(b.column("label").to_pylist(), texts(b)):
                n[y, list({f for w in set(_WORD.findall(t.lower())) for f in features(w)})] += 1
                total[y] += 1
        some = np.flatnonzero(n.any(0))  # after the last cell: the numbers of documents
        cols = [np.append(some, 1 << BITS), np.append(n[0, some], total[0]), np.append(n[1, some], total[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cell", "clean", "toxic"])

    n = np.zeros((2, (1 << BITS) + 1), np.int64)
    sums = map_batches(bags, count, "cell long, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    n[:, sums["cell"].to_numpy(np.int64)] = sums[["clean", "toxic"]].to_numpy(np.int64).T  # a table of fixed size
    if not n[:, -1].all():
        return None
    clean, toxic = (n[y, :-1] for y in (0, 1))
    wanted = (toxic >= least) & ((toxic + 0.5) / (n[1, -1] + 1) >= lift * (clean + 0.5) / (n[0, -1] + 1))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        for b in batches:
            plain, sizes, feats = [], [], []
            for t in texts(b):
                own = [sorted({f for w in set(_WORD.findall(s)) for f in features(w) if kept[f]}) for s in _SENTENCE.findall(t.lower())]
                hit = [x for x in own if x]
                plain.append(len(own) - len(hit))
                sizes.append(np.array([len(x) for x in hit], "<i4").tobytes())
                feats.append(np.array([f for x in hit for f in x], "<i4").tobytes())
            cols = [b.column("label").cast(pa.int32()), pa.array(plain, pa.int64()), pa.array(sizes, pa.binary()), pa.array(feats, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["label", "plain", "sizes", "feats"])

    got = map_batches(bags, read, "label int, plain long, sizes binary, feats binary").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("label", "plain", "sizes", "feats"))))
    return _learn([(y, m, np.frombuffer(s, "<i4"), np.frombuffer(f, "<i4")) for y, m, s, f in rows], steps, rate, decay)


class Scorer:
    """Scores sentences; the weight of a word is looked up once and kept for at most `most` words."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = float(self.model.weights[features(word)].sum())
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = w
        return w

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence, in code points of the text."""
        out, known, weight, bias = [], self.known, self.weight, self.model.bias
        # lower() can lengthen single characters; then words are lowered one by one
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        for m in _SENTENCE.finditer(low):
            z = bias
            for w in set(_WORD.findall(m.group())):
                v = known.get(w)
                z += weight(w) if v is None else v
            out.append((m.start(), m.end(), 1 / (1 + float(np.exp(-z))) if abs(z) < 30 else float(z > 0)))
        return out


def noisy_or(scores: list[float]) -> float:
    none = 1.0
    for p in scores:
        none *= 1 - p
    return 1 - none


def document_score(scores: list[float]) -> float:
    """The noisy-or of the sentences from `FLOOR` on; that of all sentences counts too, but gives at most `WEAK`."""
    return max(noisy_or([p for p in scores if p >= FLOOR]), WEAK * noisy_or(scores))


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), locate: float = 0.5) -> DataFrame:
    """The columns of `keep`, with score, predicted (score >= 0.5) and the sentences whose own score is at least `locate`.

    A null or empty text, or no model, has score 0 and no sentence. A score of exactly 0.5 is predicted 1. Repeated rows are scored
    each; texts are scored whole, in memory that follows the longest. Other columns are left out, whatever their names.
    """
    source = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + f", score double, predicted int, offending {SPANS}"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for b in batches:
            total, spans = [], []
            for t in texts(b, "__text"):
                own = scorer.sentences(t) if scorer else []
                total.append(document_score([p for _, _, p in own]))
                spans.append([{"start": s, "end": e, "score": p} for s, e, p in own if p >= locate])
            more = [pa.array(total, pa.float64()), pa.array([int(p >= 0.5) for p in total], pa.int32()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "score", "predicted", "offending"])

    return map_batches(source, run, schema)
