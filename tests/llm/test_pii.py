"""Anchor expansion against the plain patterns."""

import hashlib
import re

from hypothesis import given, settings, strategies as st

from tallyforge.llm.pii import BASE, Finder, find_pii, iban_valid, luhn, pii_digest

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def base(text):
    return [s for s in Finder().spans(text) if s[1] < 4]


@given(st.text(alphabet="a1@.+- ()09:/é%", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert base(text) == plain(text)


@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "x@y.zz", "@", ".", "+1 (555) 123-4567", "1.2.3.4", "256.1.1.1", " ", "-", "7", "é", "b@c", "+", "4", "://u:p@", "iban "]), max_size=14))
@settings(max_examples=1500, deadline=None)
def test_base_spans_of_joined_parts(parts):
    text = "".join(parts)
    assert base(text) == plain(text)


def test_added_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00 and ftp://ann:pw@host.org/x account no. 12345678, recount 99"
    kinds = {(k, text[s:e]) for s, k, e in Finder().spans(text)}
    assert (5, "DE89 3704 0044 0532 0130 00") in kinds and (5, "12345678") in kinds and (4, "ftp://ann:pw@host.org/x") in kinds
    assert iban_valid("GB82 WEST 1234 5698 7654 32") and not iban_valid("GB82 WEST 1234 5698 7654 33")


def test_long_digit_runs_are_linear():
    assert base("1" * 300_000) == []
    assert base("a" * 200_000 + "@") == []


def test_rows(spark):
    rows = [(1, "mail a@b.co now", "q"), (2, None, "q"), (3, "", None), (3, "", None), (None, "é 10.0.0.1", "z"), (5, "x" * 100_000 + " a@b.co", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    got = {(r.doc_id, r.spans): r for r in pii_digest(find_pii(docs)).collect()}
    assert set(got) == {(1, "email:5:11"), (2, ""), (3, ""), (None, "ip:2:10"), (5, "email:100001:100007")}
    assert got[1, "email:5:11"].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    assert got[2, ""].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2, ""].n_email == 0
    assert find_pii(docs.limit(0)).count() == 0
    assert find_pii(docs).count() == len(rows)
