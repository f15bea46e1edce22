"""SentencePiece encoding and decoding with the n best segmentations (operator 6).

The lattice of a text has a node per character boundary and an edge per piece. Forward Viterbi gives the best score from the
start to every node; these are exact heuristics for an A-star search that runs backward from the end, so hypotheses leave the
queue in order of their full scores and each one popped at the start is the next best segmentation.

No piece crosses the beginning of a word (this is checked when the model is read), so a text's lattice is a chain of its words'
lattices. The forward scores of all new words of a batch are computed together, with the backward ones: the best path that leaves
a word's best path anywhere gives the exact cost of its second choice. Only the n - 1 words of a text whose second choice costs
least (the first ones of equal cost) can take part in its n best segmentations; these words go through the A-star search.

Log-probabilities are whole multiples of 2**-20, so sums are exact and equal scores are equal wherever they are computed. Of equal
best segmentations that with the shortest piece wins, looking from the end; further ones of equal score come in the order in which
the search, which goes on where it went last, meets them.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import map_batches, texts

SPACE = "▁"
_WORD = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
#: Code points that no text uses; one that is absent from the text stands for a space mark that the text itself holds.
_ABSENT = [chr(c) for c in range(0x10FFFE, 0x10FFFF + 1)] + [chr(c) for c in range(0xFDD0, 0xFDF0)]


_POWER = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    out = []
    for base in (_POWER, pow(_POWER, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _finish(h: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(size, np.uint64)
    return h ^ (h >> np.uint64(29))


def _hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of whole words, equal to those of the same characters inside a longer one."""
    size = np.array([len(w) for w in words])
    inside = np.arange(size.max()) < size[:, None]
    raw = np.zeros(inside.shape, np.uint64)
    raw[inside] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4") + np.uint64(1)
    return _finish((raw * _powers(size.max())[0]).sum(1, dtype=np.uint64), size)


def _runs(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The values flat[first : first + count] of all runs, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((first - ends + count).astype(kind), count)
    at += np.arange(total, dtype=kind)
    return flat[at]


class _Rows(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = out = len(self)
        return out


#: Parts of a unit of log-probability, and a score below all others.
SCALE, NONE = 1 << 20, -(1 << 60)


class Lattice:
    """Pieces and log-probabilities of a model file, with exact n-best search.

    A unigram model's scores are taken as they are (`zipf=False`). The scores of a BPE file are merge ranks and no probabilities;
    with `zipf` a piece's log-probability follows from its rank by Zipf's law.
    """

    def __init__(self, path: str, zipf: bool = True, most: int = 200_000):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scores = {i: m.get_score(i) for i in normal}
        if zipf:
            ranked = sorted((i for i in normal if scores[i] > -1e8), key=lambda i: (-scores[i], i))
            scores = {i: -math.log(r + 1) for r, i in enumerate(ranked, 1)}
            # pieces without a rank (runs of spaces) cost as much as the last one
            scores |= {i: -math.log(len(ranked) + 2) for i in normal if i not in scores}
        self.known = {self.pieces[i]: (i, round(scores[i] * SCALE)) for i in normal}
        self.longest = max(map(len, self.known))
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.known):
            raise ValueError("a piece crosses the beginning of a word: this model's texts cannot be segmented word by word")
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.byte_score = round((min(s for s in scores.values() if s > -1e8) - 10) * SCALE)
        self.spelt, self.spelt_size = np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt])
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size
        self.most = most
        self._forget()
        self.ways: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
        keys = _hashes([p for p in self.known])
        order = np.argsort(keys)
        self.hash = keys[order]
        self.hash_id = np.array([self.known[p][0] for p in self.known])[order]
        self.hash_score = np.array([self.known[p][1] for p in self.known])[order]
        self.seen = np.zeros(1 << 20, bool)  # the first 20 bits of all hashes: most substrings are no pieces
        self.seen[keys >> np.uint64(44)] = True

    def _forget(self) -> None:
        """No words: their rows, and by row the best score, the cost of the second choice and where the best ids are."""
        self.row = _Rows()
        self.ids = np.zeros(0, "<i4")
        self.best_score, self.second_gap, self.ids_at, self.ids_count = (np.zeros(0, np.int64) for _ in range(4))

    def edges(self, word: str, mark: str = "") -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """By end node: (start node, score, ids). A character without a piece of its own is spelt in bytes."""
        out: list[list] = [[] for _ in range(len(word) + 1)]
        for end in range(1, len(word) + 1):
            single = False
            for start in range(max(0, end - self.longest), end):
                if hit := self.known.get(word[start:end]):
                    out[end].append((start, hit[1], (hit[0],)))
                    single = single or start == end - 1
            if not single:
                c = word[end - 1]
                raw = (SPACE if c == mark else c).encode()
                out[end].append((end - 1, len(raw) * self.byte_score, tuple(self.byte[b] for b in raw)))
        return out

    def search(self, word: str, n: int, mark: str = "") -> list[tuple[int, bytes]]:
        """The n best (score, ids), best first. Hypotheses are rows of a table that point to the one behind them."""
        edges = self.edges(word, mark)
        best = [0] + [NONE] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max(best[start] + s for start, s, _ in edges[end])
        behind: list[tuple[int, tuple[int, ...]]] = [(-1, ())]
        queue = [(-best[-1], 0, len(word), 0)]  # bound, age, node, score so far; of equal bounds the youngest is taken
        out = []
        while queue and len(out) < n:
            bound, age, node, total = heapq.heappop(queue)
            if node == 0:
                ids, at = [], -age
                while at > 0:
                    at, piece = behind[at]
                    ids.extend(piece)
                out.append((-bound, np.array(ids, "<i4").tobytes()))
                continue
            for start, s, piece in edges[node]:  # the shortest piece last
                behind.append((-age, piece))
                heapq.heappush(queue, (-(best[start] + total + s), 1 - len(behind), start, total + s))
        return out

    def forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Best score, cost of the second choice (beyond -NONE / 2 if there is none) and ids of the best of each word, for words in order of length."""
        score, gap, ids, count = self._forward(words)
        cut = [0, *np.cumsum(count).tolist()]
        return score, gap, [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def _forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """forward, with the ids of all words one after the other, and their numbers.

        Tables have a row per node and a column per word. At a node only the columns of words that reach it are worked on: scores
        beyond a word's end would add up NONE until they overflow.
        """
        n, size = len(words), np.array([len(w) for w in words])
        most = int(size[-1])
        wide = min(self.longest, most)
        raw = np.zeros((n, most), np.uint64)
        raw[np.arange(most) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        raw = np.ascontiguousarray(raw.T)
        power, back = _powers(most + 1)
        total = np.zeros((most + 1, n), np.uint64)
        np.cumsum((raw + np.uint64(1)) * power[:most, None], axis=0, out=total[1:])
        edge = np.full((most + 1, wide + 1, n), NONE, np.int64)
        for k in range(1, wide + 1):
            key = _finish((total[k:] - total[:-k]) * back[: most + 1 - k, None], k).ravel()
            maybe = np.flatnonzero(self.seen[key >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hash, key[maybe]), len(self.hash) - 1)
            hit = self.hash[at] == key[maybe]
            end, word = np.divmod(maybe[hit], n)
            edge[end + k, k, word] = self.hash_score[at[hit]]
        spelt = edge[1:, 1] == NONE
        edge[1:, 1][spelt] = self.byte_score * (1 + (raw[spelt] > 0x7F) + (raw[spelt] > 0x7FF) + (raw[spelt] > 0xFFFF))
        first = np.searchsorted(size, np.arange(most + 1)).tolist()
        ahead, came = np.zeros((most + 1, n), np.int64), np.zeros((most + 1, n), np.int64)
        for end in range(1, most + 1):
            upto, live = min(wide, end), first[end]
            ways = ahead[end - upto : end, live:][::-1] + edge[end, 1 : upto + 1, live:]
            came[end, live:] = ways.argmax(0) + 1
            ahead[end, live:] = ways.max(0)
        score = ahead[size, np.arange(n)]
        on = np.zeros((most + 1, n), bool)
        at = size.copy()
        live = np.arange(n)
        while live.size:
            on[at[live], live] = True
            at[live] -= came[at[live], live]
            live = live[at[live] > 0]
        behind = np.full((most + 1, n), NONE, np.int64)
        behind[size, np.arange(n)] = 0
        second = np.full(n, 2 * NONE, np.int64)
        for end in range(most, 0, -1):
            upto, live = min(wide, end), first[end]
            ways = edge[end, 1 : upto + 1, live:] + behind[end, live:]
            before = behind[end - upto : end, live:]
            np.maximum(before, ways[::-1], out=before)
            ways += ahead[end - upto : end, live:][::-1]
            cols = np.flatnonzero(on[end, live:])
            ways[came[end, live + cols] - 1, cols] = 2 * NONE
            np.maximum(second[live:], ways.max(0), out=second[live:])
        return score, score - second, *self._spell(words, total, back, came, on)

    def _spell(self, words: list[str], total: np.ndarray, back: np.ndarray, came: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids along the best paths, and their number by word: `on` has the paths' nodes, `came` the lengths of the pieces that end there."""
        word, end = np.nonzero(on.T)
        k = came[end, word]
        key = _finish((total[end, word] - total[end - k, word]) * back[end - k], k)
        at = np.minimum(np.searchsorted(self.hash, key), len(self.hash) - 1)
        ids, count = self.hash_id[at].astype("<i4"), np.ones(len(at), np.int64)
        spelt = np.flatnonzero(self.hash[at] != key)
        chars = [words[w][e - 1].encode() for w, e in zip(word[spelt].tolist(), end[spelt].tolist())]
        count[spelt] = [len(c) for c in chars]
        start = np.cumsum(count) - count
        ids = np.repeat(ids, count)
        for s, c in zip(start[spelt].tolist(), chars):
            ids[s : s + len(c)] = [self.byte[b] for b in c]
        return ids, np.bincount(word, count, len(words)).astype(np.int64)

    def learn(self) -> None:
        """Keep the best segmentation of the words that got a row since the last call."""
        known = len(self.best_score)
        if known == len(self.row):
            return
        words = list(islice(self.row, known, None))
        order = sorted(range(len(words)), key=[len(w) for w in words].__getitem__)
        words = [words[i] for i in order]
        found = []
        at = 0
        while at < len(words):
            upto = at + 1  # about 1.5 million cells at a time
            while upto < len(words) and (upto + 1 - at) * len(words[upto]) <= 100_000:
                upto += 1
            found.append(self._forward(words[at:upto]))
            at = upto
        score, gap, ids, count = map(np.concatenate, zip(*found))
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        first = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.best_score, self.second_gap = np.concatenate([self.best_score, score[back]]), np.concatenate([self.second_gap, gap[back]])
        self.ids_at, self.ids_count = np.concatenate([self.ids_at, first[back]]), np.concatenate([self.ids_count, count[back]])

    def _choices(self, word: str, n: int, mark: str = "") -> list[tuple[int, bytes]]:
        """search, kept for words of usual length."""
        if mark or len(word) > 32:
            return self.search(word, n, mark)
        if (word, n) not in self.ways:
            if len(self.ways) >= self.most:
                self.ways.clear()
            self.ways[word, n] = self.search(word, n)
        return self.ways[word, n]

    def _chain(self, words: list[str], n: int, total: int, gaps: np.ndarray, best: bytes, ends: np.ndarray, mark: str = "") -> list[tuple[float, bytes]]:
        """The n best (score, ids) of a text from its words' scores' sum, the costs of their second choices, the best ids and where each word's end."""
        out = [(total / SCALE, best)]
        if n == 1:
            return out
        ways: list[tuple[int, tuple[tuple[int, bytes], ...]]] = [(0, ())]
        for k in sorted(k for k in np.argsort(gaps, kind="stable")[: n - 1].tolist() if gaps[k] < -NONE // 2):
            (top, _), *others = self._choices(words[k], n, mark)
            more = ways + [(cost + top - s, (*picks, (k, ids))) for cost, picks in ways for s, ids in others]
            ways = heapq.nsmallest(n, more, key=lambda w: w[0])
        for cost, picks in ways[1:]:
            parts, at = [], 0
            for k, ids in picks:
                parts += best[at : 4 * int(ends[k - 1]) if k else 0], ids
                at = 4 * int(ends[k])
            out.append(((total - cost) / SCALE, b"".join([*parts, best[at:]])))
        return out

    def encode_batch(self, batch: list[str], n: int = 1) -> list[list[tuple[float, bytes]]]:
        """Per text its n best segmentations, best first: (score, ids as 32-bit integers). An empty text has the empty one.

        Words are kept for the next batches; where there are more than `most`, all are forgotten before the next one.
        """
        if len(self.row) > self.most:
            self._forget()
        marked = [self._marked(t) for t in batch]
        split = [[] if m or not t else _WORD.findall(SPACE + t.replace(" ", SPACE)) for t, m in zip(batch, marked)]
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        self.learn()
        score, gaps, count = self.best_score[rows], self.second_gap[rows], self.ids_count[rows]
        ids, ends = _runs(self.ids, self.ids_at[rows], count), np.cumsum(count)
        out = []
        at = before = 0
        for t, words, m in zip(batch, split, marked):
            if m:
                out.append(self._spelt_out(t, n))
                continue
            own = slice(at, at := at + len(words))
            upto = int(ends[at - 1]) if at else 0
            out.append(self._chain(words, n, int(score[own].sum()), gaps[own], ids[before:upto].tobytes(), ends[own] - before))
            before = upto
        return out

    def _marked(self, text: str) -> bool:
        return SPACE in text or any(c in text for c in _ABSENT[:2])

    def _spelt_out(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """A text that holds the space mark itself: another character stands for it, and all words go through the search."""
        mark = next(c for c in _ABSENT if c not in text)
        words = _WORD.findall(SPACE + text.replace(SPACE, mark).replace(" ", SPACE))
        ways = [self.search(w, min(n, 2), mark) for w in words]
        gaps = np.array([w[0][0] - w[1][0] if len(w) > 1 else -NONE for w in ways], np.int64)
        ends = np.cumsum([len(w[0][1]) // 4 for w in ways])
        return self._chain(words, n, sum(w[0][0] for w in ways), gaps, b"".join(w[0][1] for w in ways), ends, mark)

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The n best segmentations of one text as (score, ids), best first."""
        return [(s, np.frombuffer(raw, "<i4").tolist()) for s, raw in self.encode_batch([text], n)[0]]

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """The text of a segmentation; bytes are joined before they are read as UTF-8."""
        ids = np.asarray(ids, np.int64)
        return _runs(self.spelt, self.spelt_at[ids], self.spelt_size[ids]).tobytes().decode("utf-8", "replace")[1:]


def segment(docs: DataFrame, model: str, n: int = 3, zipf: bool = True, with_ids: bool = True, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, with the n best segmentations, best first: scores, counts (of ids), crcs (the crc32 of the ids as
    little-endian 32-bit integers) and, if asked for, ids; and exact (decoding the best gives the text).

    A null or empty text has one segmentation, without ids, of score 0. Fewer than n are all there are. Repeated rows are encoded
    each; texts are encoded whole, in memory that follows the longest word and batch. Equal scores: see the module. Other columns
    are left out, whatever their names.
    """
    source = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema += ", scores array<double>, counts array<int>, crcs array<long>, exact boolean" + ", ids array<array<int>>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model, zipf)
        for b in batches:
            own = texts(b, "__text")
            best = lattice.encode_batch(own, n)
            exact = [lattice.decode(np.frombuffer(ways[0][1], "<i4")) == t for ways, t in zip(best, own)]
            more = [
                pa.array([[s for s, _ in ways] for ways in best], pa.list_(pa.float64())),
                pa.array([[len(raw) // 4 for _, raw in ways] for ways in best], pa.list_(pa.int32())),
                pa.array([[zlib.crc32(raw) for _, raw in ways] for ways in best], pa.list_(pa.int64())),
                pa.array(exact),
            ]
            if with_ids:
                more.append(pa.array([[np.frombuffer(raw, "<i4") for _, raw in ways] for ways in best], pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "scores", "counts", "crcs", "exact", "ids"][: b.num_columns - 1 + len(more)])

    return map_batches(source, run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, with the text of each row's ids (array<int>). Null ids give a null text, none the empty one."""
    source = rows.select(*(F.col(c) for c in keep), F.col(ids).cast("array<int>").alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model)
        for b in batches:
            out = [None if own is None else lattice.decode(own) for own in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*b.schema.names[:-1], text])

    return map_batches(source, run, schema)
