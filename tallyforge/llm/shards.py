"""Token ids in training order as fixed-stride binary shards (operator 10).

Each document gives sequences of `length` ids; the last one is filled up. A first pass reads nothing but text lengths: as a
byte-level id stands for one byte at least, they bound the number of sequences of each document, and so every possible sequence
has an index in one range. A keyed Feistel network with cycle-walking permutes exactly that range. Shards are equal ranges of the
permuted values; each is written by one task in rising order, so the unused values close up and a sequence's global slot is its
shard's first slot plus its record number. One tokenisation and one shuffle are all that is needed.

A shard is a plain file of little-endian ids, `length` to a record: unsigned 16-bit ones, or 32-bit ones where the vocabulary is
larger. `index.json` beside the shards holds the record size and each shard's number of records, so a reader finds any slot with
one look at a list in memory and one seek. A shard appears under its name only when it is complete; a task that runs again
replaces it with the same bytes, and what failed tasks have left is removed at the end. The folder is the caller's and stays.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm.common import durable, map_batches, shared_folder
from tallyforge.llm.tokens import DocumentTokenizer

ROUNDS = 8
_SENT = "shard int, place long, doc_id long, sequence long, n_tokens int, ids binary"
_WROTE = "shard int, record long, place long, doc_id long, sequence long, n_tokens int, ids_crc32 long"


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def round_keys(key: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(key).integers(0, 1 << 63, ROUNDS)]


def feistel(index: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of range(size): a balanced Feistel network on the next even number of bits, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_scramble(left, k) & mask), left
            else:
                left, right = right, left ^ (_scramble(right, k) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(size))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _store(path: str):
    """(file system, path in it) of any store that pyarrow knows; on Hadoop stores it needs libhdfs, as cluster nodes have."""
    from pyarrow import fs

    # both spellings of a local URI
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def _remove(spark: SparkSession, pattern: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in store.globStatus(where) or []:
        store.delete(f.getPath(), True)


def write_training_order(docs: DataFrame, tokenizer: str, path: str, length: int = 512, key: int = 20_24, end_id: int = 50_256, shard_bytes: int = 32 << 20) -> DataFrame:
    """Write the shards below `path` and return one row per sequence: slot, shard, record, doc_id, sequence, n_tokens, ids_crc32.

    Every row's ids are followed by `end_id`, which also fills the last record; n_tokens counts the ids before the filling and
    ids_crc32 covers the whole record. A null or empty text has one record, a null doc_id stays null. Repeated rows are written
    each. An empty table writes no shard. Texts are cut whole, however long. Shards of an earlier run below `path` are replaced.
    Other columns are left out, whatever their names. `docs` has to come from files or from a checkpoint, so that a partition read
    again holds the same rows in the same order; a task that finds otherwise fails rather than writing a wrong place.
    """
    kind = DocumentTokenizer(tokenizer).kind(end_id)
    wide = np.dtype(kind).itemsize
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    _remove(spark, f"{path}/shard-*.bin")
    _remove(spark, f"{path}/index.json")
    bound = F.floor((F.coalesce(F.octet_length("text"), F.lit(0)) + length) / length).cast("long")  # ceil((bytes + 1) / length)
    sums = {r["p"]: r["n"] for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(bound).alias("n")).collect()}
    size = sum(sums.values())
    if not size:
        return spark.createDataFrame([], "slot long, shard int, record long, doc_id long, sequence long, n_tokens int, ids_crc32 long")
    first, at = {}, 0
    for p in sorted(sums):
        first[p], at = at, at + sums[p]
    shards = max(1, -(-size * length * wide // shard_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, p = DocumentTokenizer(tokenizer), TaskContext.get().partitionId()
        at = first.get(p, 0)
        end = np.array([end_id], "<u4")
        for b in batches:
            index, who, number, count, ids = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = np.concatenate([tok.ids(text), end]).astype(kind)
                for k in range(0, len(own), length):
                    index.append(at + k // length)
                    who.append(doc_id)
                    number.append(k // length)
                    count.append(len(own[k : k + length]))
                    ids.append(zlib.compress(own[k : k + length].tobytes(), 1))
                at += (len((text or "").encode()) + length) // length
            place = feistel(np.array(index, np.int64), size, key)
            cols = [pa.array([int(x) * shards // size for x in place], pa.int32()), pa.array(place), pa.array(who, pa.int64()), pa.array(number, pa.int64()), pa.array(count, pa.int32()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "place", "doc_id", "sequence", "n_tokens", "ids"])
        if at != first.get(p, 0) + sums.get(p, 0):
            raise RuntimeError("this partition holds other rows than when it was measured: pass docs read from files or a checkpoint")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        shard, out, temporary, record = None, None, "", 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/shard-{shard:06d}.bin")

        for b in batches:
            numbers, crc = [], []
            for s, count, data in zip(b.column("shard").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids")):
                if s != shard:
                    close()
                    shard, record, temporary = s, 0, f"{root}/.shard-{s:06d}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                whole = zlib.decompress(data.as_py()) + np.full(length - count, end_id, kind).tobytes()
                out.write(whole)
                numbers.append(record)
                crc.append(zlib.crc32(whole))
                record += 1
            kept = {c: b.column(c) for c in ("place", "doc_id", "sequence", "n_tokens")}
            cols = [b.column("shard"), pa.array(numbers, pa.int64()), *kept.values(), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "record", *kept, "ids_crc32"])
        close()

    sent = map_batches(docs, cut, _SENT)
    # equal ranges of the permuted values go to one task each; the engine sorts (and spills) before the shard is streamed out
    ranged = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place")
    wrote = durable(ranged.mapInArrow(write, _WROTE), "manifest")
    counts = sorted((r["shard"], r["n"]) for r in wrote.groupBy("shard").agg(F.count("*").alias("n")).collect())  # one row per shard
    _remove(spark, f"{path}/.shard-*")
    held = dict(counts)
    records = [held.get(s, 0) for s in range(shards)]
    starts = [0, *accumulate(records)][:-1]
    store, root = _store(path)
    with store.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"length": length, "kind": kind, "end_id": end_id, "key": key, "records": records}).encode())
    base = spark.createDataFrame(list(enumerate(starts)), "shard int, first long")
    return wrote.join(base, "shard").select((F.col("first") + F.col("record")).alias("slot"), "shard", "record", "doc_id", "sequence", "n_tokens", "ids_crc32")


class TrainingOrder:
    """Reads sequences by their slots: one seek, then on through the shards in order."""

    def __init__(self, path: str):
        self.store, self.root = _store(path)
        with self.store.open_input_stream(f"{self.root}/index.json") as f:
            index = json.loads(f.read())
        self.length, self.kind, self.end_id = index["length"], index["kind"], index["end_id"]
        self.starts = [0, *accumulate(index["records"])]

    def __len__(self) -> int:
        return self.starts[-1]

    def records(self, slot: int = 0) -> Iterator[np.ndarray]:
        """The records from `slot` on."""
        size = self.length * np.dtype(self.kind).itemsize
        while slot < len(self):
            shard = bisect_right(self.starts, slot) - 1
            with self.store.open_input_file(f"{self.root}/shard-{shard:06d}.bin") as f:
                f.seek(size * (slot - self.starts[shard]))
                while data := f.read(size):
                    yield np.frombuffer(data, self.kind)
            slot = self.starts[shard + 1]


def shard_folder(spark: SparkSession, name: str = "training-order") -> str:
    """A folder in the shared one that is kept when the application ends."""
    return f"{shared_folder(spark)}/{name}"
