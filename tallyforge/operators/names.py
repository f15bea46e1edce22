"""Votes and choices among spellings of a name, and identities of low-resolution sources.

Clusters depend on the order of the observations, so these run per group in pandas; a group is the observations of one row of one race.
"""

from __future__ import annotations

import difflib
import itertools
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.functions.text import ALLOWED, _key, collapse_space, similarity
from tallyforge.operators.matching import best_assignment


def allowed_share(name: str) -> float:
    """Percent of the visible characters that belong to the usual alphabet; 0 for none."""
    shown = [c for c in name if not c.isspace()]
    return 100.0 * sum(c in ALLOWED or c.isalpha() for c in shown) / len(shown) if shown else 0.0


def clustered_vote(values: Sequence[tuple[str, float]], least: float = 0.72) -> dict:
    """Clusters of similar names, built in order; the winner is the heaviest cluster.

    A name with a weight above 0 joins the cluster whose representative's key has the highest ratio of matching blocks, if that is at
    least `least`. It takes over as representative if it is heavier; of equal weights if it is cleaner, then if it is no shorter.
    confidence is the winner's share of all weight. Flags: unknown_chars, low_name_confidence (mean weight below 50),
    low_name_stability (a share below 0.6); the last two for no name at all.
    """
    clusters: list[dict] = []
    for place, (raw, weight) in enumerate(values):
        name, key = " ".join((raw or "").split()), _key(raw)
        if weight is None or not weight > 0 or not key:
            continue
        rank = (weight, allowed_share(name), len("".join(name.split())))
        near = [(difflib.SequenceMatcher(None, key, c["key"]).ratio(), -k) for k, c in enumerate(clusters)]
        ratio, k = max(near, default=(0.0, 0))
        if ratio < least:
            clusters.append({"name": name, "key": key, "rank": rank, "place": place, "weight": weight, "shares": [rank[1]]})
            continue
        home = clusters[-k]
        home["weight"] += weight
        home["shares"].append(rank[1])
        if rank >= home["rank"] and (rank[0] > home["rank"][0] or name != home["name"]):
            home |= {"name": name, "key": key, "rank": rank, "place": place}
    if not clusters:
        return {"name": "", "confidence": 0.0, "flags": "low_name_confidence;low_name_stability"}
    win = max(clusters, key=lambda c: (c["weight"], float(np.mean(c["shares"])), c["rank"][:2], -c["place"]))
    share = win["weight"] / sum(c["weight"] for c in clusters)
    flags = [f for f, on in (("unknown_chars", win["rank"][1] < 100), ("low_name_confidence", win["weight"] / len(win["shares"]) < 50), ("low_name_stability", share < 0.6)) if on]
    return {"name": win["name"], "confidence": share, "flags": ";".join(flags)}


def canonical_name(history: Sequence[str]) -> str:
    """The cleanest spelling seen: three per occurrence, the similarity to all, a quarter per distinct character, and the allowed share."""
    names = [" ".join((n or "").split()) for n in history]
    counts = Counter(n for n in names if n)
    best, top = "", float("-inf")
    for name, n in counts.items():
        score = 3 * n + sum(similarity(name, o) * k for o, k in counts.items()) + 0.25 * len({c for c in name if not c.isspace()}) + allowed_share(name) / 100
        if score > top:
            best, top = name, score
    return best


def exact_vote(rows: DataFrame, keys: list[str], name: str, weight: Column, ordinal: str) -> DataFrame:
    """Votes of blank-collapsed spellings, each with a weight of one at least; the first seen wins a tie. Native."""
    shown = rows.withColumn("__n", collapse_space(F.col(name))).where("__n <> ''")
    sums = shown.groupBy(*keys, "__n").agg(F.sum(F.greatest(weight, F.lit(1.0))).alias("__s"), F.min(ordinal).alias("__o"))
    best = sums.groupBy(*keys).agg(F.max_by("__n", F.struct("__s", -F.col("__o"))).alias(name), F.max("__s").alias("__b"), F.sum("__s").alias("__t"))
    return best.select(*keys, name, (F.col("__b") / F.col("__t")).alias("confidence"))


def name_votes(rows: DataFrame, keys: list[str], name: str, weight: str, ordinal: str) -> DataFrame:
    """clustered_vote per group."""
    types = dict(rows.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ordinal, kind="stable")
        return pd.DataFrame([{**dict(zip(keys, key)), **clustered_vote(list(zip(pdf[name], pdf[weight])))}])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", name string, confidence double, flags string")


def canonical_names(rows: DataFrame, keys: list[str], name: str, ordinal: str) -> DataFrame:
    """canonical_name per group."""
    types = dict(rows.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(keys, key)), "name": canonical_name(list(pdf.sort_values(ordinal, kind="stable")[name]))}])

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", name string")


def unstable_groups(rows: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Per group the dominant share, mean confidence and margin, and whether it is unstable (two weak signals, or too few rows)."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.sum("confidence").alias("__c"), F.sum("margin").alias("__m"))
    out = counts.groupBy(*keys).agg(F.sum("__n").alias("n"), (F.max("__n") / F.sum("__n")).alias("dominant"), (F.sum("__c") / F.sum("__n")).alias("confidence"), (F.sum("__m") / F.sum("__n")).alias("margin"))
    weak = (F.col("dominant") < 0.6).cast("int") + (F.col("confidence") < 60).cast("int") + (F.col("margin") < 1).cast("int")
    return out.withColumn("unstable", (weak >= 2) | (F.col("n") < least))


def assign_placeholders(pdf: pd.DataFrame, keep: int = 5) -> pd.DataFrame:
    """Rows of a low-resolution source to placeholders 1..n: the race with most rows (then the lowest id) seeds them; other races are
    assigned as a whole, by 0.75 name and 0.25 character against the last references."""
    pdf = pdf.sort_values(["race_id", "position"], kind="stable").reset_index(drop=True)
    sizes = pdf.groupby("race_id").size()
    seed = min(sizes.index, key=lambda r: (-sizes[r], r))
    refs = [[(r.name, r.character)] for r in pdf[pdf["race_id"] == seed].itertuples()]
    placeholder = np.zeros(len(pdf), np.int64)
    for race, rows in sorted(pdf.groupby("race_id"), key=lambda x: (x[0] != seed, x[0])):
        own = [(r.name, r.character) for r in rows.itertuples()]
        if race == seed:
            placeholder[rows.index] = np.arange(1, len(rows) + 1)
            continue
        scores = np.array([[max(0.75 * similarity(n, m) + 0.25 * (c == d) for m, d in known) for known in refs] for n, c in own])
        for i, k in enumerate(best_assignment(scores)):
            placeholder[rows.index[i]] = k + 1
            refs[k] = [*refs[k], own[i]][-keep:]
    return pdf.assign(placeholder=placeholder)


def low_resolution_links(rows: DataFrame) -> DataFrame:
    """assign_placeholders per source. rows: race_class, race_id, position, name, character."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", placeholder long"
    return rows.groupBy("race_class").applyInPandas(lambda pdf: assign_placeholders(pdf), schema)


def chain_path(races: list[list[tuple]]) -> list[tuple[int, ...]]:
    """Per race the row of each chain. races: rows (old total, new total, character, chain so far) by position, as many in each race.

    The first race's rows are the chains in their order. The sum over all later races is the least possible of: the gaps between a
    chain's last total and the row's old total (none if either is unknown), 1000 for each row with another character than the
    chain's first, 0.01 for each row that leaves its chain so far. Of equal sums the first permutations win, race by race.
    """
    ways = list(itertools.permutations(range(len(races[0]))))
    gap = lambda a, b: 0.0 if a is None or b is None else abs(a - b)

    def own(rows: list[tuple], way: tuple[int, ...]) -> float:
        return sum(1000.0 * (rows[r][2] != races[0][k][2]) + 0.01 * (rows[r][3] != k + 1) for k, r in enumerate(way))

    # best sum from a race on, by the permutation of the race before: backwards, so that ties go to the first choice forwards
    after, choice = dict.fromkeys(ways, 0.0), []
    for before, rows in zip(races[-2::-1], races[:0:-1]):
        bias = {w: own(rows, w) + after[w] for w in ways}
        best = {p: min((sum(gap(before[i][1], rows[j][0]) for i, j in zip(p, w)) + bias[w], k) for k, w in enumerate(ways)) for p in ways}
        after = {p: total for p, (total, _) in best.items()}
        choice.append({p: ways[k] for p, (_, k) in best.items()})
    path = [ways[0]]
    for step in reversed(choice):
        path.append(step[path[-1]])
    return path


def resolve_chains(rows: DataFrame, most: int = 6) -> DataFrame:
    """Adds chain (1..n, by the rows of the first race) and ambiguous to the rows of each base label.

    A base label with two to `most` rows in each of its races, two races at least, is resolved by chain_path; others, as the rule
    demands, keep the order of their rows. Rows of the last race that share character and old total are ambiguous.
    rows: race_class, base, race_id, position, old_total, new_total; and, if known, character, and label_index (the chain so far).
    """
    more = [c for c in ("character", "label_index") if c in rows.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["race_id", "position"], kind="stable").reset_index(drop=True)
        known = lambda v: None if pd.isna(v) else v
        column = lambda c: [known(v) for v in pdf[c]] if c in more else [None] * len(pdf)
        items = list(zip([known(v) for v in pdf["old_total"]], [known(v) for v in pdf["new_total"]], column("character"), column("label_index")))
        at = [list(g.index) for _, g in pdf.groupby("race_id", sort=True)]
        chain, unsure = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        sizes = {len(g) for g in at}
        whole = len(at) > 1 and len(sizes) == 1 and 2 <= min(sizes) <= most
        path = chain_path([[items[i] for i in g] for g in at]) if whole else [tuple(range(len(g))) for g in at]
        for g, way in zip(at, path):
            for k, r in enumerate(way):
                chain[g[r]] = k + 1
        if whole:
            twice = Counter((items[i][2], items[i][0]) for i in at[-1])
            for i in at[-1]:
                unsure[i] = items[i][0] is not None and twice[items[i][2], items[i][0]] > 1
        return pdf.assign(chain=chain, ambiguous=unsure)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", chain long, ambiguous boolean"
    return rows.groupBy("race_class", "base").applyInPandas(run, schema)


def placeholder_names(evidence: Sequence[tuple[str, str, float]], least: float = 0.86) -> dict[str, str]:
    """Names for the placeholders of one source, from (placeholder, name, score) in order of sighting.

    A placeholder's names are summed, and clustered at `least` from the best down. Two passes go through the placeholders in order; a
    name is given if it has enough sightings, score and lead over the second: 3, 2.0, and 1.0 or 1.18 times; then 2, 1.2, and 0.35
    or 1.05 times. A name that was given is no candidate any more.
    """
    number = lambda p: (int("".join(c for c in p if c.isdigit()) or 0), p)
    sums: dict[str, dict[str, list[float]]] = {}
    for p, raw, score in evidence:
        if name := " ".join((raw or "").split()):
            entry = sums.setdefault(p, {}).setdefault(name, [0.0, 0])
            entry[0] += score
            entry[1] += 1
    out: dict[str, str] = {}
    # fixed values: sightings, score, lead, ratio
    for sightings, score, lead, ratio in ((3, 2.0, 1.0, 1.18), (2, 1.2, 0.35, 1.05)):
        for p in sorted(set(sums) - set(out), key=number):
            clusters: list[dict] = []
            for name, (total, n) in sorted(((k, v) for k, v in sums[p].items() if k not in out.values()), key=lambda x: (-x[1][0], x[0])):
                home = next((c for c in clusters if similarity(name, c["name"]) >= least), None)
                if home is None:
                    home = {"name": name, "names": [name], "score": 0.0, "n": 0}
                    clusters.append(home)
                home["names"].append(name)
                home["score"] += total
                home["n"] += n
                home["name"] = canonical_name(home["names"]) or name
            ranked = sorted(clusters, key=lambda c: (-c["score"], -c["n"], c["name"]))
            if not ranked:
                continue
            top, second = ranked[0], ranked[1]["score"] if len(ranked) > 1 else 0.0
            clear = top["score"] - second >= lead or top["score"] / max(second, 0.001) >= ratio
            if sum(c["n"] for c in ranked) >= sightings and top["score"] >= score and clear:
                out[p] = top["name"]
    return out


def resolve_placeholders(rows: DataFrame) -> DataFrame:
    """placeholder_names per source: race_class, placeholder, name. rows: race_class, placeholder, name, score, race_id, position."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["race_id", "position", "placeholder"], kind="stable")
        got = placeholder_names(list(zip(pdf["placeholder"], pdf["name"], pdf["score"])))
        rows = [(pdf["race_class"].iloc[0], p, n) for p, n in got.items()]
        return pd.DataFrame(rows, columns=["race_class", "placeholder", "name"], dtype=object)

    return rows.groupBy("race_class").applyInPandas(run, f"race_class {dict(rows.dtypes)['race_class']}, placeholder string, name string")


def rescue_names(candidates: DataFrame, taken: DataFrame, support: int = 3, mean: float = 140, margin: float = 35) -> DataFrame:
    """Per placeholder the best supported text that no identity has: enough races, a high mean score, a clear lead over the second.
    Without these it is still chosen (forced) if it has two races and a mean of 160, or one and 190.

    candidates: race_class, placeholder, name, race_id, score; taken: race_class, name. Native; two aggregates find the two best.
    """
    free = candidates.join(taken, ["race_class", "name"], "left_anti")
    sums = free.groupBy("race_class", "placeholder", "name").agg(F.countDistinct("race_id").alias("races"), F.sum("score").alias("total"))
    w = Window.partitionBy("race_class", "placeholder").orderBy(F.desc("races"), F.desc("total"), F.desc("name"))
    top = sums.withColumn("place", F.row_number().over(w)).where("place <= 2")  # cut to two before it is sorted
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    best = top.groupBy("race_class", "placeholder").agg(at(1, "name").alias("name"), at(1, "races").alias("races"), at(1, "total").alias("total"), at(2, "total").alias("second"))
    average = F.col("total") / F.col("races")
    ok = (F.col("races") >= support) & (average >= mean) & (F.col("total") - F.coalesce("second", F.lit(0)) >= margin)
    forced = ~ok & (((F.col("races") >= 2) & (average >= 160)) | (average >= 190))
    return best.select("race_class", "placeholder", F.when(ok | forced, F.col("name")).alias("name"), forced.alias("forced"))


def restore_missing(rows: DataFrame, size: int = 12, least: float = 0.58, margin: float = 0.10) -> DataFrame:
    """A synthetic last row for races that lack exactly one and whose best blob is good and clear enough. Native.

    rows: race_class, race_id, position, player, blob, blob_second.
    """
    last = rows.groupBy("race_class", "race_id").agg(F.count("*").alias("n"), F.max_by(F.struct("position", "player", "blob", "blob_second"), "position").alias("r"))
    made = last.where((F.col("n") == size - 1) & (F.col("r.blob") >= least) & (F.col("r.blob") - F.col("r.blob_second") >= margin))
    new = made.select("race_class", "race_id", (F.col("r.position") + 1).alias("position"), F.col("r.player").alias("player"), F.col("r.blob").alias("blob"), F.col("r.blob_second").alias("blob_second"), F.lit(True).alias("restored"))
    return rows.withColumn("restored", F.lit(False)).unionByName(new.select(*rows.columns, "restored"))
