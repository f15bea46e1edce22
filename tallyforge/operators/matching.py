"""Matching: one-to-one pairing, assignments, fuzzy dimensions, as-of and set-shaped joins.

Order-dependent matching runs per source or race in grouped pandas functions: a race has a dozen rows, so a group is small, and
races are independent. Everything that joins on keys is left to the engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions.text import GAP_BEYOND, GAPS, _key, similarity


def greedy_pairs(scored: list[tuple]) -> list[tuple]:
    """Take candidates from the largest tuple down; the last two items are the two sides, each used once."""
    left, right, out = set(), set(), []
    for c in sorted(scored, reverse=True):
        if c[-2] not in left and c[-1] not in right:
            left.add(c[-2])
            right.add(c[-1])
            out.append(c)
    return out


def pair_rows(total: pd.DataFrame, race: pd.DataFrame, least: float = 0.72) -> list[tuple[int, int, float]]:
    """One-to-one pairs (index in total, index in race, score) of two screens' rows.

    Names weigh 0.65, confidence 0.15, character 0.2. Names that occur twice weigh 0.2, confidence 0.1, character 0.25 and the
    expected total 0.45. Pairs of too unlike names are no candidates; rows that are left over are paired in order.
    Columns: name, confidence, character; total: total; race: old_total, points.
    """
    names = [*total["name"], *race["name"]]
    twice = {n for n in names if list(total["name"]).count(n) > 1 or list(race["name"]).count(n) > 1}
    scored = []
    for i, a in enumerate(total.itertuples()):
        for j, b in enumerate(race.itertuples()):
            s = similarity(a.name, b.name)
            if s < least:
                continue
            sure = min(a.confidence, b.confidence) / 100
            same = float(a.character == b.character)
            double = a.name in twice or b.name in twice
            fits = float(a.total == b.old_total + b.points)
            score = 0.2 * s + 0.1 * sure + 0.25 * same + 0.45 * fits if double else 0.65 * s + 0.15 * sure + 0.2 * same
            scored.append((score, s, double, i, j))
    pairs = [(i, j, score) for score, _, _, i, j in greedy_pairs(scored)]
    used = {i for i, _, _ in pairs}, {j for _, j, _ in pairs}
    rest = zip((i for i in range(len(total)) if i not in used[0]), (j for j in range(len(race)) if j not in used[1]))
    return sorted(pairs + [(i, j, 0.0) for i, j in rest])


def match_screens(total: DataFrame, race: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of every race: keys, total_position, race_position, score. Both sides carry `position` and pair_rows' columns."""
    types = dict(total.dtypes)

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("position"), b.sort_values("position")
        rows = [(*key, a["position"].iloc[i], b["position"].iloc[j], s) for i, j, s in pair_rows(a, b)]
        return pd.DataFrame(rows, columns=[*keys, "total_position", "race_position", "score"])

    # both sides may come from one table: fresh columns keep them apart
    total = total.select(*[F.col(c).alias(c) for c in total.columns])
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", total_position long, race_position long, score double"
    return total.groupBy(*keys).cogroup(race.groupBy(*keys)).applyInPandas(run, schema)


def best_assignment(scores: np.ndarray) -> list[int]:
    """Columns for the rows (no more rows than columns) with the largest sum; of equal ones the lowest columns, row by row.

    Shortest augmenting paths over reduced costs: cubic in the number of columns. Scores are compared as exact fractions, and a
    column's index breaks ties in the last digits of a number system that no sum of scores can reach.
    """
    n, m = scores.shape
    if not n:
        return []
    whole = [[Fraction(float(v)) for v in row] for row in scores]
    scale = math.lcm(*(v.denominator for row in whole for v in row))
    # one integer per cell: the score first, then the column of row 0, of row 1, ... as digits in base m
    base = m**n
    cost = [[-int(whole[i][j] * scale) * base + j * m ** (n - 1 - i) for j in range(m)] for i in range(n)]
    row_price, column_price, owner = [0] * n, [0] * m, [-1] * m
    for i in range(n):
        least: list = [None] * m
        via, done = [-1] * m, [False] * m
        row, column = i, -1
        while True:
            for j in range(m):
                if not done[j]:
                    slack = cost[row][j] - row_price[row] - column_price[j]
                    if least[j] is None or slack < least[j]:
                        least[j], via[j] = slack, column
            nearest = min((j for j in range(m) if not done[j]), key=lambda j: least[j])
            step = least[nearest]
            row_price[i] += step
            for j in range(m):
                if done[j]:
                    column_price[j] -= step
                    row_price[owner[j]] += step
                else:
                    least[j] -= step
            done[nearest], column = True, nearest
            if owner[nearest] < 0:
                break
            row = owner[nearest]
        while column >= 0:
            before = via[column]
            owner[column] = owner[before] if before >= 0 else i
            column = before
    return [j for _, j in sorted((r, j) for j, r in enumerate(owner) if r >= 0)]


def nearest_name(rows: DataFrame, name: str, dimension: list[tuple[int, str]], score: Callable[[str, str], float] = similarity) -> DataFrame:
    """Adds match_id and match_score: the most similar entry of a dimension of bounded size; the first of equal ones wins."""

    def run(batches):
        known: dict[str | None, tuple[int | None, float]] = {None: (None, 0.0)}
        for pdf in batches:
            for n in pdf[name].unique():
                if n not in known:
                    best = (None, -1.0)
                    for i, entry in dimension:
                        s = score(n, entry)
                        if s > best[1]:
                            best = (i, s)
                    known[n] = best
            got = pdf[name].map(lambda n: known.get(n, (None, 0.0)))
            yield pdf.assign(match_id=pd.array([g[0] for g in got], dtype="Int64"), match_score=[g[1] for g in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", match_id long, match_score double"
    return rows.mapInPandas(run, schema)


def roster_consensus(observed: list[tuple[str, float]], roster: list[str], least: float = 0.55) -> tuple[str | None, float]:
    """The roster entry with the largest sum of similarity times weight (1 at least), and its share of all sums."""
    sums = {r: sum(s * max(1.0, w) for n, w in observed if (s := similarity(n, r)) >= least) for r in roster}
    total = sum(sums.values())
    if total <= 0:
        return None, 0.0
    best = max(roster, key=lambda r: sums[r])
    return best, sums[best] / total


def next_event(left: DataFrame, right: DataFrame, key: str, at: str, to: str) -> DataFrame:
    """Forward as-of join: adds to `left` the first `at` of `right` that is not before its own, and how many came before it (+ 1).

    Both sides are merged into one ordered stream per key: one shuffle and one sort instead of a range join.
    """
    a = left.select("*", F.lit(1).alias("__side"))
    b = right.select(key, F.col(at), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, F.desc("__side"))
    ahead = F.min(F.when(F.col("__side") == 0, F.col(at))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    number = F.sum((F.col("__side") == 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    out = both.withColumn(to, ahead).withColumn(f"{to}_number", number)
    return out.where("__side = 1").drop("__side")


def diff(base: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison of two runs: keys, state (added, removed, changed, same) and the columns that differ."""
    a = base.select(*keys, F.struct(*values).alias("__a"))
    b = new.select(*keys, F.struct(*values).alias("__b"))
    j = a.join(b, keys, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"__a.{v}").eqNullSafe(F.col(f"__b.{v}")), F.lit(v)) for v in values]))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return j.select(*keys, state.alias("state"), F.when(both, F.concat_ws(";", changed)).otherwise("").alias("columns"))


def set_diff(base: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Files of two folders by name and digest: missing, unexpected or mismatched."""
    j = base.select(key, F.col(digest).alias("__a")).join(new.select(key, F.col(digest).alias("__b")), key, "full")
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unexpected").when(F.col("__a") != F.col("__b"), "mismatched")
    return j.select(key, state.alias("state")).where("state IS NOT NULL")


def pair_identities(gone: list[tuple], came: list[tuple], least: float = 0.85) -> list[tuple]:
    """(old, new) labels that stand for one another across a reset; empty unless all can be paired.

    Items are (label, name, dominant character or None, whether its last or first race touches the reset). Pairs touch the reset on
    both sides and share their character or have names of a similarity of `least`; the best are taken first (1 for the character,
    and the similarity; then the higher labels). One item on each side is a pair by elimination.
    """
    if not gone or len(gone) != len(came):
        return []
    scored = []
    for old, old_name, old_character, ends in gone:
        for new, new_name, new_character, starts in came:
            same, alike = old_character is not None and old_character == new_character, similarity(old_name, new_name)
            if ends and starts and (same or alike >= least):
                scored.append((float(same) + alike, old, new))
    if not scored and len(gone) == 1 and gone[0][3] and came[0][3]:
        scored = [(-1.0, gone[0][0], came[0][0])]
    pairs = [(old, new) for _, old, new in greedy_pairs(scored)]
    return pairs if len(pairs) == len(came) else []


def relink_after_reset(rows: DataFrame) -> DataFrame:
    """(race_class, old, new): labels that disappear at a source's first reset, and those that appear with it in their place.

    Only sources with more labels than a race usually has rows (the smallest commonest size) are looked at.
    rows: race_class, race_id, position, label, name, character, reset (true in the races of a reset).
    """
    races = rows.groupBy("race_class", "race_id").agg(F.count("*").alias("n"), F.max("reset").alias("reset"))
    sizes = races.groupBy("race_class", "n").agg(F.count("*").alias("k"))
    usual = sizes.groupBy("race_class").agg(F.max(F.struct("k", (-F.col("n")).alias("n"))).alias("x")).select("race_class", (-F.col("x.n")).alias("usual"))
    at = races.groupBy("race_class").agg(F.min(F.when(F.col("reset"), F.col("race_id"))).alias("at")).where("at IS NOT NULL")
    before = races.join(at, "race_class").where("race_id < at").groupBy("race_class").agg(F.max("race_id").alias("before"), F.max("at").alias("at"))
    per = rows.groupBy("race_class", "label", "character").agg(F.count("*").alias("k"), F.min(F.struct("race_id", "position")).alias("seen"))
    most = F.max(F.when(F.col("character").isNotNull(), F.struct("k", (-F.col("seen.race_id")).alias("r"), (-F.col("seen.position")).alias("p"), "character")))
    spans = rows.groupBy("race_class", "label").agg(F.min("race_id").alias("first"), F.max("race_id").alias("last"), F.array_sort(F.collect_list(F.struct("race_id", "position", "name"))).alias("seen"))
    labels = spans.join(per.groupBy("race_class", "label").agg(most.alias("x")), ["race_class", "label"]).join(before, "race_class").join(usual, "race_class")
    types = dict(rows.dtypes)
    known = labels.select("race_class", "label", F.col("x.character").alias("character"), "first", "last", "before", "at", "usual", F.transform("seen", lambda x: x["name"]).alias("names"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tallyforge.operators.names import canonical_name

        out = []
        at, before = pdf["at"].iloc[0], pdf["before"].iloc[0]
        if len(pdf) > pdf["usual"].iloc[0]:
            items = [(r.label, canonical_name(list(r.names)) or str(r.label), None if pd.isna(r.character) else r.character, r.first, r.last) for r in pdf.sort_values("label").itertuples()]
            # a race between the last one before the reset and the reset itself may have no rows: then nothing touches it
            gone = [(label, name, c, last == before and last == at - 1) for label, name, c, first, last in items if last < at]
            came = [(label, name, c, first == at) for label, name, c, first, last in items if first >= at]
            out = pair_identities(gone, came)
        return pd.DataFrame([(pdf["race_class"].iloc[0], *pair) for pair in out], columns=["race_class", "old", "new"], dtype=object)

    return known.groupBy("race_class").applyInPandas(run, f"race_class {types['race_class']}, old {types['label']}, new {types['label']}")


def single_race_outliers(rows: DataFrame) -> DataFrame:
    """(race_class, label, race_index, to): labels seen once, in an inner race, on an unreliable row, where exactly one label is in both
    neighbouring races and not in this one, and whose character does not contradict that label's commonest one.

    Of several such rows in a race the first by position takes the missing label; all are judged by the labels as they came.
    rows: race_class, race_index (gapless), position, label, unreliable, character (may be null). Native.
    """
    sets = rows.groupBy("race_class", "race_index").agg(F.collect_set("label").alias("labels"))
    w = Window.partitionBy("race_class").orderBy("race_index")
    bridge = F.array_except(F.array_intersect(F.lag("labels").over(w), F.lead("labels").over(w)), "labels")
    gaps = sets.select("race_class", "race_index", bridge.alias("bridge")).where(F.size("bridge") == 1).select("race_class", "race_index", F.element_at("bridge", 1).alias("to"))
    once = rows.groupBy("race_class", "label").agg(F.count("*").alias("n"), F.min(F.struct("race_index", "position", "unreliable", "character")).alias("x"))
    lone = once.where("n = 1 AND x.unreliable").select("race_class", "label", "x.race_index", "x.position", "x.character")
    per = rows.where("character IS NOT NULL").groupBy("race_class", "label", "character").agg(F.count("*").alias("k"), F.min(F.struct("race_index", "position")).alias("seen"))
    most = F.max(F.struct("k", (-F.col("seen.race_index")).alias("r"), (-F.col("seen.position")).alias("p"), "character"))
    usual = per.groupBy("race_class", F.col("label").alias("to")).agg(most.alias("m")).select("race_class", "to", F.col("m.character").alias("usual"))
    found = lone.join(gaps, ["race_class", "race_index"]).join(usual, ["race_class", "to"], "left").where("usual IS NULL OR character IS NULL OR usual = character")
    return found.groupBy("race_class", "race_index", "to").agg(F.min(F.struct("position", "label")).alias("x")).select("race_class", "x.label", "race_index", "to")


def unreliable_names(confidence: Column, allowed: Column, flags: Column) -> Column:
    """Rows whose name says little: flagged, recognised with less than 90, or with characters outside the alphabet (below 100 percent)."""
    flagged = F.coalesce(flags, F.lit("")).rlike("(?i)low_name_confidence|unknown_chars")
    return flagged | (F.coalesce(confidence, F.lit(100.0)) < 90) | (F.coalesce(allowed, F.lit(100.0)) < 100)


def admitted(name: float, total: float, visual: float, character: float, exact: bool, unreliable: bool, case_conflict: bool) -> bool:
    """Whether a row may continue an identity. Names that differ in case only within a race keep their identities apart."""
    if case_conflict and not unreliable and not (total >= 0.95 and character >= 1):
        return False
    if name >= 0.72 or exact or (total >= 0.95 and (visual >= 0.55 or character >= 1)):
        return True
    return unreliable and ((visual >= 0.72 and name >= 0.5) or (total >= 0.7 and name >= 0.45) or (visual >= 0.68 and total >= 0.7))


def link_identities(rows: DataFrame) -> DataFrame:
    """Race by race, rows take the identities so far (0.5 name, 0.25 total, 0.2 visual, 0.05 character; greedy from the largest tuple
    down, so that ties go to the higher identity); the rest found new ones. Adds identity, numbered from 1 within the source.

    A name is compared with the cleanest spelling of the identity, a row's old total with the identity's last new total. Pictures are
    no input here, so the visual part is 0. rows: race_class, race_id, position, name, character, old_total, new_total (each may be
    null) and, if known, unreliable. The state of a source is one entry per identity; its spellings are kept as counts.
    """
    unsure = "unreliable" in rows.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tallyforge.operators.names import canonical_name

        pdf = pdf.sort_values(["race_id", "position"], kind="stable").reset_index(drop=True)
        shown = [" ".join((n or "").split()) for n in pdf["name"]]
        keys = [_key(n) for n in shown]
        protected = set()
        for _, race in pdf.groupby("race_id", sort=True):
            seen: dict[str, set[str]] = {}
            for i in race.index:
                seen.setdefault(keys[i], set()).add(shown[i])
            protected |= {k for k, v in seen.items() if len(v) > 1}
        state: dict[int, dict] = {}
        identity = np.zeros(len(pdf), np.int64)
        alike: dict[tuple[str, str], float] = {}
        nothing = lambda v: v is None or v != v or v is pd.NA
        for _, race in pdf.groupby("race_id", sort=True):
            scored = []
            for place, (i, r) in enumerate(zip(race.index, race.itertuples())):
                bad = bool(unsure and r.unreliable)
                for k, s in state.items():
                    pair = (s["name"], shown[i])
                    if pair not in alike:
                        alike[pair] = similarity(*pair)
                    name = alike[pair]
                    a, b = s["total"], r.old_total
                    total = 0.0 if nothing(a) or nothing(b) else next((v for reach, v in GAPS if abs(a - b) <= reach), GAP_BEYOND)
                    c, d = s["character"], r.character
                    character = 0.0 if nothing(c) and nothing(d) else 0.05 if nothing(c) or nothing(d) else 1.0 if c == d else -0.4
                    exact = bool(shown[i]) and s["name"] == shown[i]
                    conflict = keys[i] in protected and bool(shown[i]) and bool(s["name"]) and not exact
                    if admitted(name, total, 0.0, character, exact, bad, conflict):
                        scored.append((0.5 * name + 0.25 * total + 0.05 * character, name, 0.0, total, character, k, place))
            taken = {c[-1]: c[-2] for c in greedy_pairs(scored)}
            for place, (i, r) in enumerate(zip(race.index, race.itertuples())):
                k = taken.get(place)
                if k is None:
                    k = max(state, default=0) + 1
                    state[k] = {"names": [], "character": None}
                s = state[k]
                s["names"].append(shown[i])
                s["name"], s["total"] = canonical_name(s["names"]), r.new_total
                if not nothing(r.character):
                    s["character"] = r.character
                identity[i] = k
        return pdf.assign(identity=identity)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", identity long"
    return rows.groupBy("race_class").applyInPandas(run, schema)


def fragment_score(x: dict, y: dict) -> float | None:
    """How well two identities without a common race fit together, or None. Items: name, character, unreliable (share), rows, races."""
    if set(x["races"]) & set(y["races"]) or max(x["unreliable"], y["unreliable"]) < 0.5:
        return None
    both = x["character"] is not None and y["character"] is not None
    conflict = both and x["character"] != y["character"]
    small, large = sorted((x["rows"], y["rows"]))
    if conflict and (small > 2 or large < 4):
        return None
    alike = similarity(x["name"], y["name"])
    if alike < (0.60 if conflict else 0.68):
        return None
    return alike - 0.10 if conflict else alike + 0.15 if both else alike


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """Identities of a source that are one: (race_class, keep, drop); the earlier, then larger, then lower one stays.

    Only sources with more identities than a race usually has rows are looked at. Pairs are taken from the best score down; each side
    stands for what it was renamed to so far, once (renames are not followed further).
    fragments: race_class, identity, name, character, unreliable (share of rows), races (array), rows, usual (rows of a race).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = {r["identity"]: r for r in pdf.sort_values("identity").to_dict("records")}
        for r in items.values():
            r["character"] = None if pd.isna(r["character"]) else r["character"]
        renamed: dict = {}
        if len(items) > pdf["usual"].iloc[0]:
            ids = list(items)
            scored = [(s, a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (s := fragment_score(items[a], items[b])) is not None]
            for _, a, b in sorted(scored, reverse=True):
                one, other = renamed.get(a, a), renamed.get(b, b)
                if one != other:
                    keep, drop = sorted((one, other), key=lambda k: (min(items[k]["races"]), -items[k]["rows"], k))
                    renamed[drop] = keep
        return pd.DataFrame([(pdf["race_class"].iloc[0], keep, drop) for drop, keep in renamed.items()], columns=["race_class", "keep", "drop"], dtype=object)

    kind = dict(fragments.dtypes)
    return fragments.groupBy("race_class").applyInPandas(run, f"race_class {kind['race_class']}, keep {kind['identity']}, drop {kind['identity']}")


def beam_ranks(scores: list[dict[int, float]], width: int = 3) -> list[int]:
    """The templates of the rows, from the `width` best beginnings: each row takes its own number or the template before it.

    scores: per row (from the first) the score of each template. Of equal sums the beginning that came first stays ahead.
    """
    beam: list[tuple[float, list[int]]] = [(0.0, [])]
    for number, own in enumerate(scores, 1):
        ways = [(total + own[t], [*path, t]) for total, path in beam for t in sorted({number, path[-1] if path else number})]
        beam = sorted(ways, key=lambda w: -w[0])[:width]
    return beam[0][1]
