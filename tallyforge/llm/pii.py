"""Personal data by anchor expansion (operator 7).

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs, digits, scheme separators and identifier cues. A
deterministic parser per anchor then expands to the left and right, and validates what it has found. Texts without anchors cost
that pass and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import map_batches, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Words that announce an account or identity number.
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_QUAD = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIAL = re.compile(r"[ ().0-9-]+")
_USERINFO = re.compile(r"[A-Za-z0-9._~!$&'()*+,;=%:-]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"]*)?")
_AFTER_CUE = re.compile(r"(?:\s+(?:no|nr|number|id))?\.?\s*[:=#]?\s*")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b|[0-9](?:[ -]?[0-9]){5,29}|[A-Z]{1,2}[0-9]{6,9}\b")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for mark in ("@", "+", *"0123456789", "://"):
        a.add_word(mark, (mark if len(mark) > 1 else "0" if mark.isdigit() else mark, len(mark)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _account_valid(found: str) -> bool:
    if found[0].isdigit():
        return 6 <= sum(c.isdigit() for c in found) <= 30
    return iban_valid(found) if found[:2].isalpha() and len(found) > 10 else True


class Finder:
    """spans(text) gives (start, kind number, end) in code points, by start and kind."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        email_from = quad_from = card_from = phone_from = url_from = account_from = 0
        size = len(text)
        for last, (mark, width) in self.anchors.iter(text):
            at = last - width + 1
            if mark == "0":
                if at >= card_from:
                    if m := _GROUPED.match(text, at):
                        card_from = m.end()
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            out.append((at, 2, card_from))
                    else:
                        card_from = at + 1
                if at >= quad_from:
                    if m := _QUAD.match(text, at):
                        quad_from = m.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                            out.append((at, 1, quad_from))
                    else:  # a later start in the same digits meets the same text behind them
                        quad_from = _DIGITS.match(text, at).end()
            elif mark == "@":
                start = at
                while start > email_from and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_from = m.end()
                    out.append((start, 0, email_from))
            elif mark == "+":
                if at >= phone_from and at + 1 < size and text[at + 1] in "0123456789" and (m := _DIAL.match(text, at + 1)):
                    end = m.end()
                    while text[end - 1] not in "0123456789":
                        end -= 1
                    if end - at >= 4:
                        phone_from = end
                        if 9 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                            out.append((at, 3, end))
            elif mark == "://":
                start = at
                while start > url_from and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at and (m := _USERINFO.match(text, at + 3)):
                    url_from = m.end()
                    out.append((start, 4, url_from))
            elif at >= account_from and not (at and text[at - 1].isalnum()) and not (last + 1 < size and text[last + 1].isalpha()):
                m = _ACCOUNT.match(text, _AFTER_CUE.match(text, last + 1).end())
                if m and _account_valid(m.group()):
                    account_from = m.end()
                    out.append((m.start(), 5, account_from))
        out.sort()
        return out


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of `docs` (repeated rows too): the columns of `keep`, and pii_spans by start and kind, in code points, end exclusive.

    A null or empty text has no span. Texts are read whole. Other columns, whatever their names, are left out.
    """
    source = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + f", pii_spans {SPANS}"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in finder.spans(t)] for t in texts(b, "__text")]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=[*b.schema.names[:-1], "pii_spans"])

    return map_batches(source, scan, schema)


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the sha256 of the base spans and all spans as text."""
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    spans = F.col("pii_spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    base = of(*BASE)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(spans).alias("spans"))
