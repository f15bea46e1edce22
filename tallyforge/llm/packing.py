"""Packing documents into fixed windows by minimum bin slack (operator 8).

Every document is cut into full windows and one remainder, so that no cut depends on other documents. The remainders are then
described by nothing but a histogram of their lengths (at most one row per length, whatever the corpus holds). The plan is made
on that histogram: the longest length that is left opens a window, a bitset subset-sum over the lengths that are left finds the
fill closest to the capacity, back-tracking gives how often each length is used, and the pattern is repeated as often as the
counts allow. Rows then look up their place by their number among the rows of equal length. The numbering is salted: a length
that a third of all rows share is numbered in as many groups as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm.common import durable, map_batches
from tallyforge.llm.tokens import DocumentTokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of every whole text: its place, length and the crc32 of its ids.

    A null or empty text has the end id alone. Repeated rows and null ids give their own pieces. Other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = DocumentTokenizer(tokenizer)
        end = np.array([end_id], "<u4")
        for b in batches:
            who, start, length, crc, total = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.concatenate([tok.ids(text.as_py()), end])
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    who.append(doc_id)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (who, start, length, crc, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select("doc_id", "text"), cut, PIECES)


def closest_fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """How often each length is used in the multiset whose sum is closest to `capacity` without passing it.

    `left` has counts by length. Longer lengths are offered first and the search ends at an exact fill. The reachable sums are a
    bitset in one integer; counts are split into powers of two, and the steps kept give the counts back.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in left if x <= capacity), reverse=True):
        n = min(left[length], capacity // length)
        part = 1
        while n > 0:
            part = min(part, n)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            n -= part
            part *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            used[length] = used.get(length, 0) + part
    return used


def pack_plan(counts: dict[int, int], window: int = 2048) -> list[tuple[int, dict[int, int]]]:
    """(repeats, how often each length is used) by minimum bin slack until every counted piece has a place."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while left:
        first = max(left)
        rest = {k: v - (k == first) for k, v in left.items() if v > (k == first)}
        used = closest_fill(rest, window - first)
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        plan.append((times, used))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For the n-th piece of a length: where the plan puts it, as arrays sorted by length and first number."""
    taken: dict[int, int] = {}
    sequence, rows = 0, []
    for times, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "uses", "sequence", "offset"), table.T))


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Every piece with its sequence and its offset there; sequences hold at most `window` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. An empty table gives no row. Rows that
    are the same in all columns may change places with each other, which leaves the result as it is.
    """
    spark = docs.sparkSession
    pieces = durable(token_pieces(docs, tokenizer, window, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    if not counts:
        return spark.createDataFrame([], PACKED)
    total = sum(counts.values())
    group = max(64, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = [1] + [max(1, -(-counts.get(k, 0) // group)) for k in range(1, window + 1)]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(F.lit(salts), F.col("length").cast("int") + 1)))
    # at most `window` + 4 * partitions rows
    sizes = sorted((r["length"], r["salt"], r["n"]) for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    before: dict[tuple[int, int], int] = {}
    done: dict[int, int] = {}
    for length, salt, n in sizes:
        before[length, salt] = done.get(length, 0)
        done[length] = before[length, salt] + n
    width = max(salts) + 1
    group_key = np.array([k * width + s for k, s in sorted(before)], np.int64)
    group_first = np.array([before[k] for k in sorted(before)], np.int64)
    places = _places(pack_plan(counts, window))
    span = max(counts.values()) + 1
    place_key = places["length"] * span + places["first"]
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = salted.withColumn("number", F.row_number().over(order) - F.lit(1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, number = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "number"))
            number = number + group_first[np.searchsorted(group_key, length * width + salt)]
            at = np.searchsorted(place_key, length * span + number, side="right") - 1
            repeat, spot = np.divmod(number - places["first"][at], places["uses"][at])
            more = [pa.array(places["sequence"][at] + repeat), pa.array(places["offset"][at] + spot * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), *more], names=PACKED.replace(" long", "").split(", "))

    return numbered.mapInArrow(place, PACKED)


def padding(plan: list[tuple[int, dict[int, int]]], window: int = 2048) -> int:
    """Pad ids that the plan leaves: a sequence is padded to the window unless its size is a power of two."""
    sizes = [(t, sum(k * n for k, n in used.items())) for t, used in plan]
    return sum(t * (window - s) for t, s in sizes if s & (s - 1))
