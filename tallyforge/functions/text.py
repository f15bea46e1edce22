"""Name and text functions: native expressions where the engine has them, Arrow-batched functions for Unicode and fuzzy matching."""

from __future__ import annotations

import difflib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# fixed values: what is stripped from both ends of a recognised name
EDGE = " `'\"´:;.,*"
#: Letters that count as usual in names; others are reported.
ALLOWED = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .-_'!?&")


def collapse_space(c: Column) -> Column:
    """Runs of blanks become one space, ends are cut; null becomes ""."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def strip_edges(c: Column) -> Column:
    """Without the punctuation of EDGE at both ends."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(EDGE))


def visible(c: Column) -> Column:
    """The characters that are no blank."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")


def distinct_characters(c: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.split(visible(c), ""), lambda x: x != ""))).cast("long")


def lenient_int(c: Column) -> Column:
    """"7", "+7" and "7.0" are 7; otherwise the digits alone; null if there is none."""
    text = F.trim(c.cast("string"))
    whole = F.regexp_extract(text, r"^([+-]?\d+)(?:\.0+)?$", 1)
    digits = F.regexp_replace(text, r"\D", "")
    return F.coalesce(F.when(whole != "", whole.try_cast("long")), F.when(digits != "", digits.try_cast("long")))


def cell_text(c: Column) -> Column:
    """A cell for comparing: trimmed; numbers in one spelling with at most ten decimals and no trailing zeros."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    number = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), F.round(text.try_cast("decimal(38,12)"), 10).cast("string"))
    short = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(short, text)


def timecode(frame: Column, fps: Column) -> Column:
    """HH:MM:SS of a frame, rounded down; hours are not wrapped."""
    s = F.floor(frame / F.greatest(fps, F.lit(1)))
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    h = F.floor(s / 3600)
    hours = F.when(h < 100, part(h)).otherwise(h.cast("string"))
    return F.concat_ws(":", hours, part(F.floor(s / 60) % 60), part(s % 60))


def scaled_frames(base: Column, fps: Column) -> Column:
    """A number of frames at 30 a second in frames of another rate, at least 1; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(base * F.greatest(fps, F.lit(1)) / 30, 0)).cast("long")


def safe_label(c: Column, default: str = "unknown") -> Column:
    """Letters, digits and ". _-" stay, the rest becomes "_"; blanks, "." and "_" are cut at both ends."""
    s = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._ -]+", "_"), F.lit(" ._"))
    return F.when(s == "", default).otherwise(s)


def source_key(relative_path: Column) -> Column:
    """A file's path as one key: each part sanitised, parts joined by "__"; the suffix of the file is cut."""
    parts = F.split(F.regexp_replace(relative_path, r"\.[^./]*$", ""), "/")
    clean = F.transform(parts, lambda p: F.btrim(F.regexp_replace(p, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-")))
    return F.concat_ws("__", F.transform(clean, lambda p: F.when(p == "", "part").otherwise(p)))


def append_once(text: Column, note: Column, mark: str = " | ") -> Column:
    """`note` behind `text` unless it is in there already."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, note), t).when(t == "", note).otherwise(F.concat(t, F.lit(mark), note))


def shorten(text: Column, most: int) -> Column:
    """At most `most` characters, the last three dots if something was cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


# fixed values: how well two numbered features agree within a distance, and beyond
GAPS, GAP_BEYOND = ((2, 1.0), (8, 0.7), (20, 0.3)), -0.2


def feature_gap(a: Column, b: Column) -> Column:
    """How well two numbered features agree, by their distance; unknown ones say little."""
    out = F.when(a.isNull() | b.isNull(), 0.0)
    for reach, value in GAPS:
        out = out.when(F.abs(a - b) <= reach, value)
    return out.otherwise(GAP_BEYOND)


def alphabet(document: str, parts: tuple[str, ...] = ("latin_extended", "japanese", "special_symbols")) -> str:
    """The allowed characters of a JSON document that holds them as strings, once each."""
    doc = json.loads(document)
    return "".join(dict.fromkeys(c for p in parts for c in (doc.get(p) or "") if isinstance(doc, dict)))


def allowed_percent(c: Column, allowed: str) -> Column:
    """Percent of the visible characters that an alphabet has; 0 for none."""
    chars = F.filter(F.split(visible(c), ""), lambda x: x != "")
    inside = F.filter(chars, lambda x: F.lit(allowed).contains(x))
    return F.when(F.size(chars) > 0, 100 * F.size(inside) / F.size(chars)).otherwise(0.0)


def unknown_characters(c: Column, allowed: str) -> Column:
    """The visible characters that an alphabet lacks, once each, in order."""
    chars = F.filter(F.split(visible(c), ""), lambda x: (x != "") & ~F.lit(allowed).contains(x))
    return F.array_join(F.array_distinct(chars), "")


def candidate_score(name: Column, confidence: Column, allowed: str) -> Column:
    """How good a recognised name is: its confidence, and bonuses for characters of the alphabet, length, variety, characters beyond
    ASCII and letters, less those that the alphabet lacks; minus infinity if it has no visible character."""
    shown = visible(name)
    beyond = F.when(shown.rlike(r"[^\x00-\x7F]"), 10).otherwise(0)
    letters = F.length(F.regexp_replace(shown, r"\P{L}", ""))
    lacking = F.length(unknown_characters(name, allowed))
    score = confidence + 30 * allowed_percent(name, allowed) / 100 + 4 * F.least(F.length(shown), F.lit(10)) + 3 * F.least(distinct_characters(name), F.lit(8)) + beyond + 1.5 * letters - 12 * lacking
    return F.when(shown == "", F.lit(float("-inf"))).otherwise(score)


def _key(text: str | None) -> str:
    return unicodedata.normalize("NFKC", (text or "").strip(EDGE)).casefold()


def _identity(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", _key(text)) if unicodedata.category(c) != "Mn" and c.isalnum())


@pandas_udf(StringType())
def name_key(s: pd.Series) -> pd.Series:
    """Edges stripped, NFKC, case folded: the engine has no Unicode normalisation."""
    return s.map(_key)


@pandas_udf(StringType())
def identity_key(s: pd.Series) -> pd.Series:
    """The name key without accents and without anything but letters and digits."""
    return s.map(_identity)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a prefix bonus of 0.1 for up to four equal characters, given from 0.7 on."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def similarity(a: str | None, b: str | None) -> float:
    """0.3 ratio of matching blocks, 0.4 likeness of lengths, 0.3 Jaro-Winkler, on name keys."""
    x, y = _key(a), _key(b)
    length = 1 - abs(len(x) - len(y)) / max(len(x), len(y), 1)
    return 0.3 * difflib.SequenceMatcher(None, x, y).ratio() + 0.4 * length + 0.3 * jaro_winkler(x, y)


@pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)])


@pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b)])
