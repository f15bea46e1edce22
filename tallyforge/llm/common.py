"""Shared pieces: durable tables in the cluster's shared folder, Arrow mapping, crc32 folds, documents columns."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of one Arrow batch; long texts then stay within a Python worker's memory.
BATCH_ROWS = 512
#: And its bytes: the vectorised operators need some tens of bytes for each byte of a batch. One longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Only on one machine (as in tests) may the cluster name none: then a temporary folder is taken, and set as the session's. On a
    cluster that is an error, as executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tallyforge"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts go to Python in small batches, so that memory follows the longest text and not their number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_fraction(key: Column, fraction: float) -> Column:
    """A fixed share of the rows by a hash of their key: the same rows at each run."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_003)) < F.lit(int(fraction * 1_000_003) + 1)


def documents_only(df: DataFrame) -> DataFrame:
    return df.select(*DOCUMENT_COLUMNS)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Python strings; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def byte_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, with where each row starts and ends. Nulls are empty."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, end = at[:-1].copy(), at[1:].copy()
    if col.null_count:
        gone = ~np.asarray(col.is_valid())
        end[gone] = start[gone]
    return raw[at[0] : at[-1]], start - at[0], end - at[0]


def tojson(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))
