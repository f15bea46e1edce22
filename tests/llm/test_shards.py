"""Training order: the permutation, exact bytes of every record, and resuming."""

import os
import zlib

import numpy as np
import pytest

from tallyforge.llm.shards import TrainingOrder, feistel, write_training_order
from tallyforge.llm.tokens import DocumentTokenizer, tokenizer_path


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    x = np.arange(size)
    y = feistel(x, size, 5)
    assert sorted(y) == list(range(size)) and (feistel(y, size, 5, back=True) == x).all()
    if size > 50:
        assert (y != feistel(x, size, 6)).any() and abs(np.corrcoef(x, y)[0, 1]) < 0.5


def test_shards(spark, tmp_path):
    rows = [(i, f"thin anon er {i} " * (i * 7 % 300), "x") for i in range(200)] + [(900, None, "x"), (901, "", "x"), (5, "again é", "y"), (5, "again é", "y"), (None, "no id", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = write_training_order(docs, tokenizer_path(), f"file://{tmp_path}/out", length=64, shard_bytes=40_000).collect()
    tok = DocumentTokenizer(tokenizer_path())
    want = []
    for doc_id, text, _ in rows:
        ids = np.append(tok.ids(text), 50_256).astype("<u2")
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want.append((str(doc_id), k // 64, len(part), zlib.crc32(np.append(part, np.full(64 - len(part), 50_256)).astype("<u2").tobytes())))
    assert sorted((str(r.doc_id), r.sequence, r.n_tokens, r.ids_crc32) for r in out) == sorted(want)
    assert sorted(r.slot for r in out) == list(range(len(want)))
    files = sorted(os.listdir(tmp_path / "out"))
    assert len([f for f in files if f.endswith(".bin")]) == len({r.shard for r in out}) > 3 and not [f for f in files if f.startswith(".shard") and not f.endswith(".crc")]
    by = {r.slot: r for r in out}
    order = TrainingOrder(f"file://{tmp_path}/out")
    assert len(order) == len(want) and order.kind == "<u2"
    for first in (0, 17, len(want) - 1):
        got = list(order.records(first))
        assert [zlib.crc32(r.tobytes()) for r in got] == [by[s].ids_crc32 for s in range(first, len(want))]
    rewritten = write_training_order(docs, tokenizer_path(), f"file://{tmp_path}/out", length=64, shard_bytes=400_000).collect()
    assert len(rewritten) == len(want) and len(TrainingOrder(f"{tmp_path}/out")) == len(want)
    order = [r.doc_id for r in sorted(out, key=lambda r: r.slot) if r.doc_id is not None]
    assert order != sorted(order)
    assert write_training_order(docs.limit(0), tokenizer_path(), f"file://{tmp_path}/none", length=64).count() == 0


def test_long_texts_and_wide_ids(spark, tmp_path):
    rows = [(1, "thin anon er " * 500_000), (2, "short"), (2, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = write_training_order(docs, tokenizer_path(), f"{tmp_path}/wide", length=512, end_id=70_000).collect()
    order = TrainingOrder(f"{tmp_path}/wide")
    assert order.kind == "<u4" and len(order) == len(out) and out[0].n_tokens <= 512
    parts = {(r.doc_id, r.sequence): rec for r, rec in zip(sorted(out, key=lambda r: r.slot), order.records())}
    ids = np.concatenate([parts[1, k] for k in range(len(out) - 2)])
    tok = DocumentTokenizer(tokenizer_path())
    whole = tok.ids(rows[0][1])
    assert (ids[: len(whole)] == whole).all() and (ids[len(whole) :] == 70_000).all()
    with pytest.raises(ValueError):
        write_training_order(docs, tokenizer_path(), f"{tmp_path}/bad", end_id=-1)
