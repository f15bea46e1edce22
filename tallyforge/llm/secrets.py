"""Secret scans with a random forest that removes false positives (operator 3).

A scan of a whole text finds candidates: long runs with digits or mixed case, dotted tokens, values behind a cue such as
"password=", passwords in addresses, and private key blocks. No candidate has a greatest length, and those that overlap are one.
A random forest decides which are secrets. Its features are the candidate's length, its character transitions, how much of it
dictionary words cover, the path of the document and the neighbouring words; it is trained from labelled findings. The dictionary
is a parameter: the words of a public tokenizer's vocabulary file serve well.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import map_batches, texts
from tallyforge.llm.tokens import tokenizer_path

# fixed values: cues, benign neighbours, known beginnings of keys, words of paths that hold no live secrets
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private", "access_key", "client_secret")
BENIGN = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "integrity", "uuid", "guid", "isbn", "card", "phone", "order", "invoice", "version", "build", "revision", "etag", "image", "example", "sample", "trace", "session")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ", "npm_", "SG.", "-----BEGIN")
QUIET_PATHS = ("test", "example", "sample", "fixture", "doc", "mock", "lock", "vendor", "demo")
WORDS = ("example", "sample", "test", "dummy", "change", "changeme", "your", "here", "secret", "password", "token", "placeholder", "insert", "replace", "admin", "user", "default", "value", "string", "name", "key", "redacted", "null", "none", "true", "false", "localhost", "config", "service", "client", "server", "index", "module", "image", "button", "handler", "width", "height", "value", "version", "release")

_RUN = re.compile(r"[A-Za-z0-9_+/-]{12,}={0,2}")
_DIGIT = re.compile(r"[0-9]")
_UPPER_INSIDE = re.compile(r"[a-z][A-Z]")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]++)+|[A-Za-z0-9_-]{16,}+(?:\.[A-Za-z0-9_-]{16,}+)+)")
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|passphrase|pwd|secret|token|credentials?|(?:api|access|private|secret)[_-]?key)[\"']?[ \t]*(?:=>|:=|[=:])\s{0,3}[\"']?([^\s\"',;]{6,})|bearer[ \t]+([^\s\"',;]{12,})")
_ADDRESS = re.compile(r"://[^\s/:@]*+:([^\s/@]{3,}+)@")
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_LINES = re.compile(r"(?:(?:\\[rn]|\s)*+[A-Za-z0-9+/=]{16,}+)++")
_NEAR = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
#: The neighbouring words are those within so many characters of a candidate: part of the features' definition, no bound on what is found.
REACH = 40


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of key blocks, in one pass: from a mark to its END mark, or over the lines of key material if the text breaks off."""
    b, e = _BEGIN.search(text), None
    while b:
        after = _BEGIN.search(text, b.end())
        if e is None or e.start() < b.end():
            e = _END.search(text, b.end())
        if e and not (after and after.start() < e.start()):
            yield b.start(), e.end()
        elif lines := _LINES.match(text, b.end()):
            yield b.start(), lines.end()
        if e is None and after is None:
            return
        b = after


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of all candidates of a whole text, by start; those that overlap are one candidate."""
    spans = []
    for m in _RUN.finditer(text):
        s, e = m.span()
        if _DIGIT.search(text, s, e) or e - s >= 20 and _UPPER_INSIDE.search(text, s, e):
            spans.append((s, e))
    if "." in text:
        spans += [m.span() for m in _DOTTED.finditer(text)]
    spans += [m.span(m.lastindex) for m in _ASSIGNED.finditer(text)]
    if "://" in text:
        spans += [m.span(1) for m in _ADDRESS.finditer(text)]
    if "-----BEGIN" in text:
        spans += _blocks(text)
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if not out or s >= out[-1][1]:
            out.append((s, e))
        else:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


@dataclass
class Transitions:
    """Log-probabilities of letter pairs in words."""

    table: np.ndarray

    @staticmethod
    def learn(words: Iterable[str]) -> Transitions:
        n = np.ones((28, 28))
        for w in words:
            codes = [26, *(ord(c) - 97 if "a" <= c <= "z" else 27 for c in w.lower()), 26]
            for a, b in zip(codes, codes[1:]):
                n[a, b] += 1
        return Transitions(np.log(n / n.sum(1, keepdims=True)))

    def mean(self, text: str) -> float:
        codes = [ord(c) - 97 if "a" <= c <= "z" else 27 for c in text.lower()]
        if len(codes) < 2:
            return 0.0
        return float(self.table[codes[:-1], codes[1:]].mean())


def dictionary(path: str) -> tuple[str, ...]:
    """The words of at least four letters that begin a word in a vocabulary file of pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (m.id_to_piece(i) for i in range(m.get_piece_size()))
    return tuple(sorted({p[1:].lower() for p in pieces if p.startswith("\u2581") and len(p) > 4 and p[1:].isalpha()}))


class Dictionary:
    """Finds all its words in a text in one pass."""

    def __init__(self, words: Iterable[str]):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for w in {w for w in words if len(w) >= 4}:
            self.words.add_word(w, len(w))
        if len(self.words):
            self.words.make_automaton()

    def covered(self, text: str) -> float:
        """The share of the characters that words cover."""
        if not len(self.words) or not text:
            return 0.0
        free: list[tuple[int, int]] = []  # ends rise, so spans that overlap are on top of the stack
        for end, size in self.words.iter(text.lower()):
            start = end + 1 - size
            while free and free[-1][1] > start:
                start = min(start, free.pop()[0])
            free.append((start, end + 1))
        return sum(e - s for s, e in free) / len(text)


def features(value: str, path: str, before: str, after: str, transitions: Transitions, known: Dictionary) -> list[float]:
    n = len(value)
    counts = Counter(value)
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    longest = max(len(m.group()) for m in re.finditer(r"(.)\1*", value, re.S))
    near = [w.lower() for w in _NEAR.findall(before)][-3:]
    far = [w.lower() for w in _NEAR.findall(after)][:2]
    tail = before.rstrip(" \"'")
    low_path = path.lower()
    return [
        float(n), *share, entropy, changes, transitions.mean(value), known.covered(value), len(counts) / n, longest / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)), float(value.startswith(PREFIXES)),
        float(any(q in low_path for q in QUIET_PATHS)), float(any(c in w for w in near for c in CUES)),
        float(bool(near) and any(c in near[-1] for c in CUES) and tail.endswith(("=", ":"))), float(any(w in BENIGN for w in near + far)),
        float(before.endswith(('"', "'"))), float(n in (32, 40, 64)), float("-" in value),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left, right, share of secrets."""

    trees: list[tuple[np.ndarray, ...]]
    transitions: Transitions
    words: tuple[str, ...] = WORDS

    @cached_property
    def known(self) -> Dictionary:
        return Dictionary(self.words)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}  # each worker builds its own

    def features(self, value: str, path: str, before: str, after: str) -> list[float]:
        return features(value, path, before, after, self.transitions, self.known)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (live := np.flatnonzero(feature[at] >= 0)).size:
                node = at[live]
                low = x[live, feature[node]] <= threshold[node]
                at[live] = np.where(low, left[node], right[node])
            total += value[at]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[np.ndarray, ...]:
    """One tree by the Gini index; each node tries a random subset of the features."""
    nodes: list[list[float]] = []
    stack = [(np.arange(len(y)), 0, -1, 0)]
    tries = max(1, int(math.sqrt(x.shape[1])) + 1)
    while stack:
        rows, level, parent, side = stack.pop()
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if parent >= 0:
            nodes[parent][2 + side] = at
        if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            continue
        best = (1e-9, -1, 0.0)
        p = y[rows].mean()
        whole = 2 * p * (1 - p)
        for f in rng.choice(x.shape[1], tries, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, s = x[rows[order], f], np.cumsum(y[rows[order]])
            n = np.arange(1, len(rows) + 1)
            ok = np.flatnonzero(v[:-1] < v[1:])
            ok = ok[(n[ok] >= least) & (len(rows) - n[ok] >= least)]
            if not len(ok):
                continue
            a, b = s[ok] / n[ok], (s[-1] - s[ok]) / (len(rows) - n[ok])
            gain = whole - (n[ok] * 2 * a * (1 - a) + (len(rows) - n[ok]) * 2 * b * (1 - b)) / len(rows)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                low, high = float(v[ok[k]]), float(v[ok[k] + 1])
                best = (float(gain[k]), int(f), (low + high) / 2 if (low + high) / 2 < high else low)
        if best[1] < 0:
            continue
        nodes[at][:2] = best[1], best[2]
        low = x[rows, best[1]] <= best[2]
        stack += [(rows[~low], level + 1, at, 1), (rows[low], level + 1, at, 0)]
    a = np.array(nodes)
    return a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]


Finding = tuple[str, str, str, str, int]


def labelled_findings(seed: int = 17, each: int = 220, words: tuple[str, ...] = WORDS) -> list[Finding]:
    """(candidate, path, text before, text after, label): made findings of the usual kinds, secrets and false positives alike."""
    r = random.Random(seed)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    url = alnum + "-_"
    word = lambda: r.choice(words)
    prose = lambda: " ".join(word() for _ in range(4))
    paths = ["src/app.py", "config/prod.env", "deploy.sh", "mail/inbox", "notes.txt", "settings.yml", "main.tf", ""]
    quiet = ["tests/test_login.py", "docs/example.md", "package-lock.json", "vendor/lib.js", "fixtures/a.json"]
    cue = lambda: r.choice(["password=", "passwd: ", 'secret = "', "token = \"", "api_key=", "apiKey: '", "auth_token=", "client_secret=", "pwd=", "credentials: ", "access_key = "])
    mark = lambda: r.choice(["commit ", "sha256:", "md5 ", "checksum=", "integrity: ", "uuid ", "order ", "build ", "digest ", "etag: "])
    plain = lambda: r.choice(["", " ", "(", "see ", "at ", "id "])
    size = lambda: r.choice([100, 300, 1000, 4000])
    block = lambda kind, lines: f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(lines) + f"\n-----END {kind}PRIVATE KEY-----"
    rows: list[Finding] = []

    def put(value: str, before: str, label: int, path: str | None = None) -> None:
        rows.append((value, path or r.choice(paths), f"{prose()} {before}", f"{r.choice(['', chr(34), ' '])} {prose()}", label))

    for _ in range(each):
        put(r.choice(["AKIA", "ASIA"]) + some(upper, 16), r.choice([plain(), cue(), "aws_access_key_id="]), 1)
        put(hexes(r.choice([12, 16, 18, 24, 32])), cue(), 1)
        put(hexes(r.choice([32, 40, 48, 64])), cue(), 1)
        put(some(alnum + "+/", r.choice([20, 32, 40, 43])), cue(), 1)
        put(r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "npm_", "AIza"]) + some(alnum, r.choice([20, 24, 35, 36])), r.choice([plain(), cue()]), 1)
        put("eyJ" + some(alnum, 17) + "_" + some(url, r.choice([20, 60])), r.choice(["Bearer ", cue()]), 1)
        put(f"eyJ{some(url, r.choice([20, 40]))}.{some(url, size())}.{some(url, 43)}", r.choice(["Bearer ", cue(), plain()]), 1)
        put(some(url + "%.~+/", size()), cue(), 1)
        put(some(string.ascii_letters, r.choice([20, 32, 64])), cue(), 1)
        put(block(r.choice(["", "RSA ", "EC ", "OPENSSH "]), [some(alnum + "+/", 64) for _ in range(r.choice([3, 25, 50, 200]))]), r.choice([plain(), cue()]), 1)
        put(some(alnum, r.choice([8, 12, 20])), r.choice(["postgres://admin:", "https://user:", "amqp://svc:"]), 1)
        put(block("", [r.choice(["<your key here>", "...", "your private key", "REDACTED"])]), plain(), 0, r.choice(paths + quiet))
        put(".".join(word() + word() + word() for _ in range(2)), plain(), 0)
        put("".join(w.capitalize() for w in (word(), word(), word(), word(), word())), plain(), 0)
        put(some(alnum + "!#%&", r.choice([10, 12, 16])), cue(), 1)
        put(some("45", 1) + some(string.digits, 15), plain(), 0)
        put(some(string.digits, r.choice([12, 13, 14, 18, 20])), r.choice([plain(), mark(), "phone "]), 0)
        put(hexes(r.choice([32, 40, 64])), mark(), 0, r.choice(paths + quiet))
        put(str(uuid.UUID(int=r.getrandbits(128))), r.choice([plain(), "uuid ", "guid="]), 0)
        put("-".join(word() for _ in range(3)) + str(r.randrange(100)), plain(), 0)
        put(word() + word() + word() + str(r.randrange(1000, 9999)), plain(), 0)
        put("".join(w.capitalize() for w in (r.choice(WORDS), r.choice(WORDS), r.choice(WORDS))) + str(r.randrange(10)), plain(), 0)
        put(r.choice(["changeme", "your_token_here", "example_password", "xxxxxxxxxxxx", "placeholder", "<your-token>", "test1234", "secret_key_here", "********", "dummy-value-1"]), cue(), 0, r.choice(paths + quiet))
        put("AKIA" + some(upper, 5) + "EXAMPLE" + some(upper, 4), plain(), 0, r.choice(quiet))
        put(base64.b64encode(r.randbytes(r.choice([60, 200, 600]))).decode(), r.choice(["data:image/png;base64,", "image ", "sha512-"]), 0)
        put("/".join(word() for _ in range(4)) + str(r.randrange(10)), plain(), 0)
        put(word() + r.choice([" ", "_"]).join(word() for _ in range(2)), cue(), 0)
    return rows


def train(findings: Iterable[Finding], trees: int = 40, depth: int = 10, least: int = 3, seed: int = 23, words: tuple[str, ...] = WORDS) -> Forest:
    """A forest of `trees` trees, each on a bootstrap sample of the findings. Letter pairs and coverage come from `words`."""
    findings = list(findings)
    transitions = Transitions.learn(words)
    known = Dictionary(words)
    x = np.array([features(v, path, b, a, transitions, known) for v, path, b, a, _ in findings])
    y = np.array([label for *_, label in findings], float)
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees if len(findings) else 0):
        rows = rng.integers(0, len(y), len(y))
        grown.append(_grow(x[rows], y[rows], rng, depth, least))
    return Forest(grown, transitions, words)


def fit(findings: DataFrame, limit: int = 50_000, **how: int) -> Forest:
    """Train from a table of findings: candidate, path, before, after, label (0 or 1). Rows with a null candidate or label are left
    out; of more than `limit` rows, the first by hash are taken (a documented bound)."""
    use = findings.where("candidate IS NOT NULL AND length(candidate) > 0 AND label IN (0, 1)").select("candidate", *(F.coalesce(c, F.lit("")).alias(c) for c in ("path", "before", "after")), "label")
    rows = use.orderBy(F.xxhash64("candidate", "path", "before", "after"), "candidate", "path", "before", "after", "label").limit(limit).collect()
    return train([tuple(r) for r in rows], **how)


def default_forest() -> Forest:
    """Trained from the made findings, with the words of the public piece vocabulary."""
    words = dictionary(tokenizer_path("piece_bpe_32k.model"))
    return train(labelled_findings(words=words), words=words)


def _judge(own: list[str], paths: list[str], forest: Forest) -> list[list[tuple[int, int, float]]]:
    spans = [candidates(t) for t in own]
    x = [forest.features(t[s:e], p, t[max(0, s - REACH) : s], t[e : e + REACH]) for t, p, found in zip(own, paths, spans) for s, e in found]
    scores = iter(forest.predict(np.array(x)).tolist() if x else [])
    return [[(s, e, next(scores)) for s, e in found] for found in spans]


def scan(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, with all candidates of the whole text as findings (start, end, score, secret: score >= 0.5).

    A null or empty text has no finding; a null path counts as empty. Repeated rows are scanned each; texts are scanned whole,
    however long. A score of exactly 0.5 is a secret. Other columns are left out, whatever their names.
    """
    source = docs.select(*(F.col(c) for c in keep), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("__path"), F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2]) + ", findings array<struct<start:int,end:int,score:double,secret:boolean>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("secret", pa.bool_())]))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _judge(texts(b, "__text"), b.column("__path").to_pylist(), shared.value)
            rows = [[{"start": s, "end": e, "score": p, "secret": p >= 0.5} for s, e, p in f] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(rows, kind)], names=[*b.schema.names[:-2], "findings"])

    return map_batches(source, run, schema)


def redact(docs: DataFrame, forest: Forest, text: str = "text", path: str = "source", with_: str = "[SECRET]") -> DataFrame:
    """`docs` with its own columns, the secrets of each text replaced by `with_`. A null text stays null, repeated rows stay."""
    names = docs.columns
    source = docs.withColumn("__path", F.coalesce(F.col(path).cast("string"), F.lit("")))
    shared, at = docs.sparkSession.sparkContext.broadcast(forest), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(at).to_pylist()
            out = []
            for t, found in zip(raw, _judge([t or "" for t in raw], b.column("__path").to_pylist(), shared.value)):
                for s, e, p in reversed(found):
                    if p >= 0.5:
                        t = t[:s] + with_ + t[e:]
                out.append(t)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_batches(source, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
