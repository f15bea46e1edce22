"""Language identification by prediction by partial matching (operator 1).

Each language has a variable-order context tree over folded bytes. A symbol's probability in a context is its count against the
context's total and its number of different symbols (escape method C); an escape goes to the next shorter context, whose
distribution is renormalised over the symbols not yet seen. The statistics are frozen after training, so the code length of every
(context, symbol) is a constant: a cell for what was seen in the context in any language, and otherwise the context's escape plus the
shorter context's constant. All languages share one table, whose size follows what was seen; no context is left out. The code length
of a whole text is a sum of table entries. The language with the shortest code wins, of equal ones the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import byte_rows, keep_fraction, map_batches

ORDER = 3
#: Symbols: 0 any ASCII byte that is no letter (runs count once), 1-26 letters without case, 27-154 the bytes from 128.
SYMBOLS = 155
#: Bits a symbol if all were equally likely: a text that takes more is in no learned language.
CHANCE = float(np.log2(SYMBOLS))
_FOLD = np.zeros(256, np.uint8)
for _i in range(26):
    _FOLD[65 + _i] = _FOLD[97 + _i] = 1 + _i
_FOLD[128:] = np.arange(27, 155)


def fold(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows in one array, ORDER blanks before each row, and where each row's own symbols start and end."""
    n = len(start)
    length = end - start
    row = np.repeat(np.arange(n), length)
    at = np.arange(len(row)) + np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if n else row
    data = raw[at]
    sym = _FOLD[data]
    if len(sym) > 1:  # upper-case Latin-1 letters in UTF-8: C3 80 to C3 9E
        big = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        sym[big] += 0x20
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (row[1:] != row[:-1])
        sym, row = sym[keep], row[keep]
    counts = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts + ORDER)[:-1]]).astype(np.int64) + ORDER if n else np.zeros(0, np.int64)
    out = np.zeros(len(sym) + ORDER * n, np.uint8)
    out[np.arange(len(sym)) + ORDER * (row + 1)] = sym
    return out, np.stack([first, first + counts])


@dataclass
class Model:
    """Frozen statistics. row_of: the longest known context of any three symbols. cell_of[row * size + symbol]: the cell of what was seen
    in that context, or -1, and then escape[row] bits lead to the context up[row]. bits and escape have a column per language."""

    languages: list[str]
    symbol: np.ndarray
    size: int
    row_of: np.ndarray
    cell_of: np.ndarray
    bits: np.ndarray
    escape: np.ndarray
    up: np.ndarray

    def code_lengths(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every row under every language, and its number of symbols."""
        sym, (first, last) = fold(raw, start, end)
        total = np.zeros((len(first), len(self.languages)))
        a, code = self.size, self.symbol[sym]
        step = max(1024, 2_000_000 // max(1, len(self.languages)))
        for lo in range(ORDER, len(code), step):
            hi = min(lo + step, len(code))
            c = code[lo - ORDER : hi]
            key = (c[:-3].astype(np.int32) * a + c[1:-2]) * a + c[2:-1]
            row, s3 = self.row_of[key], c[3:]
            cell = self.cell_of[row * a + s3]
            cells = self.bits[cell]
            at = np.flatnonzero(cell < 0)
            row, s3, spent = row[at], s3[at], 0.0
            while len(at):  # the empty context has a cell for every symbol
                spent = spent + self.escape[row]
                row = self.up[row]
                cell = self.cell_of[row * a + s3]
                hit = cell >= 0
                cells[at[hit]] = spent[hit] + self.bits[cell[hit]]
                at, row, s3, spent = at[~hit], row[~hit], s3[~hit], spent[~hit]
            i, j = np.searchsorted(last, lo, side="right"), np.searchsorted(first, hi, side="left")
            s, e = np.clip(first[i:j], lo, hi) - lo, np.clip(last[i:j], lo, hi) - lo
            full = np.flatnonzero(e > s)
            if len(full):
                cuts = np.stack([s[full], e[full]], 1).ravel()
                cells = np.vstack([cells, np.zeros((1, cells.shape[1]), cells.dtype)])
                total[i + full] += np.add.reduceat(cells, cuts, axis=0, dtype=np.float64)[::2]
        return total, last - first


def _compile(languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """gram: four symbols in base SYMBOLS. The lower orders' counts follow from these, as each position has a full context."""
    parts = np.stack([gram // SYMBOLS**k % SYMBOLS for k in (3, 2, 1, 0)])
    seen = np.unique(np.append(parts.ravel(), 0))
    size = len(seen) + 1  # the last one stands for all symbols that were never seen
    symbol = np.full(SYMBOLS, size - 1, np.int32)
    symbol[seen] = np.arange(len(seen))
    g = symbol[parts].astype(np.int64)
    key3 = (g[0] * size + g[1]) * size + g[2]
    contexts = [np.zeros(1, np.int64)] + [np.unique(key3 % size**k) for k in (1, 2, 3)]
    base = np.cumsum([0] + [len(c) for c in contexts])
    cell_of = np.full(base[-1] * size, -1, np.int32)
    escape, up = np.zeros((base[-1], len(languages)), np.float32), np.zeros(base[-1], np.int32)
    bits, first, shorter = [], 0, (np.arange(size), np.full((size, len(languages)), 1.0 / size))  # order -1
    for k, known in enumerate(contexts):
        pairs, at = np.unique(np.concatenate([key3 % size**k * size + g[3], np.arange(size if k == 0 else 0)]), return_inverse=True)
        c = np.zeros((len(pairs), len(languages)))
        np.add.at(c, (at[: len(gram)], lang), count)
        row = np.searchsorted(known, pairs // size)
        starts = np.searchsorted(row, np.arange(len(known)))
        below = shorter[1][np.searchsorted(shorter[0], pairs % size ** max(k, 1))]
        n, q = np.add.reduceat(c, starts), np.add.reduceat((c > 0).astype(float), starts)
        left = 1 - np.add.reduceat(np.where(c > 0, below, 0), starts)
        closed = q >= size  # every symbol has been seen: nothing is left to escape to
        q = np.where(closed, 0, q)
        leave = np.where((n > 0) & ~closed, q / np.maximum(n + q, 1) / np.maximum(left, 1e-300), 1.0)
        p = np.where(c > 0, c / np.maximum(n + q, 1)[row], leave[row] * below)
        cell_of[(base[k] + row) * size + pairs % size] = first + np.arange(len(pairs))
        escape[base[k] : base[k + 1]] = -np.log2(leave)
        if k:
            up[base[k] : base[k + 1]] = base[k - 1] + np.searchsorted(contexts[k - 1], known % size ** (k - 1))
        bits.append(-np.log2(p).astype(np.float32))
        first, shorter = first + len(pairs), (pairs, p)
    every = np.arange(size**3, dtype=np.int64)
    row_of = np.zeros(size**3, np.int32)
    for k in (1, 2, 3):
        short = every % size**k
        at = np.minimum(np.searchsorted(contexts[k], short), len(contexts[k]) - 1)
        hit = contexts[k][at] == short
        row_of[hit] = base[k] + at[hit]
    return Model(languages, symbol, size, row_of, cell_of, np.concatenate(bits), escape, up)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows_per_language: int = 1500, most_languages: int = 256) -> Model | None:
    """Statistics of whole texts of about `rows_per_language` rows of each language, chosen by a hash of `key`: a documented bound.
    So is `most_languages`: of more values of `lang` those with most rows are learned, of equal ones the first by name.

    Rows whose text or language is null are left out. None if no row is left. Each partition counts its own four-symbol runs
    before the shuffle; the driver gets sums, whose number is bounded by the sample. Repeated rows count as often as they occur.
    """
    use = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    rows = use.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    counts = {r["lang"]: r["n"] for r in rows}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.lit(False)
    for name in languages:
        share = share | ((F.col("lang") == name) & keep_fraction(F.coalesce(F.col("key").cast("string"), F.lit("")), min(1.0, rows_per_language / counts[name])))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sym, (first, last) = fold(*byte_rows(b.column("text")))
            names = np.array([languages.index(x) for x in b.column("lang").to_pylist()], np.int64)
            s = sym.astype(np.int64)
            run = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
            own = np.concatenate([np.arange(a, z) for a, z in zip(first, last)]) - ORDER if len(first) else np.zeros(0, np.int64)
            who = np.repeat(names, last - first)
            both, n = np.unique(who * SYMBOLS**4 + run[own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], names=["gram", "n"])

    sums = map_batches(use.where(share), grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    gram = sums["gram"].to_numpy(np.int64)
    order = np.argsort(gram)
    gram, n = gram[order], sums["n"].to_numpy(np.float64)[order]
    if not len(gram):
        return None
    return _compile(languages, gram // SYMBOLS**4, gram % SYMBOLS**4, n)


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, with lang_pred, score (posterior under equal priors) and bits_per_symbol, of every row.

    A text that is null or has no letter, and any text where no language was learned, gives `und` with score 0. Of languages with
    equal code lengths the first by name is given. Repeated rows are scored each; texts are scored whole, in bounded steps. Other
    columns are left out, whatever their names.
    """
    source = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", lang_pred string, score double, bits_per_symbol double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            col = b.column("__text")
            lettered = np.array([any(map(str.isalpha, t.as_py() or "")) for t in col], bool)
            if model is None:
                lettered[:] = False
            names, conf, rate = np.full(len(col), "und", object), np.zeros(len(col)), np.zeros(len(col))
            if lettered.any():
                bits, n = model.code_lengths(*byte_rows(col))
                best = bits.argmin(1)
                top = bits[np.arange(len(best)), best]
                conf = np.where(lettered, 1 / np.exp2(np.maximum(top[:, None] - bits, -1000)).sum(1), 0)
                names = np.where(lettered, np.array(model.languages, object)[best], "und")
                rate = np.where(lettered, top / np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(conf), pa.array(rate)], names=[*b.schema.names[:-1], "lang_pred", "score", "bits_per_symbol"])

    return map_batches(source, score, schema)
