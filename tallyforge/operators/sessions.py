"""Validation of running totals with session resets.

The decision whether a session is reset depends on the totals so far, and the totals on the decision, so a source is validated race by
race in a grouped function; sources are independent. A source is one recording (some hundred rows).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame

from tallyforge.operators.scoring import rank_in_race

ADDED = "session_index int, session_old_total long, session_new_total long, old_total long, new_total long, status string, rebased boolean, reset boolean, codes string, review boolean"


def starts_midway(rows: Sequence[dict]) -> bool:
    """The first race shows old totals, and most of them fit: totals do not begin at zero."""
    shown = [r for r in rows if r["seen_old"] is not None and r["seen_old"] > 0]
    if len(shown) < max(4, len(rows) // 2):
        return False
    fitting = sum(r["seen_total"] is not None and r["seen_total"] == r["seen_old"] + r["points"] for r in shown)
    return fitting >= max(4, int(len(shown) * 0.7))


def starts_higher(rows: Sequence[dict]) -> bool:
    """The first race's totals lie above what they should be, broadly and by a middling offset of five or more."""
    shown = [r for r in rows if r["seen_total"] is not None]
    if len(shown) < max(4, len(rows) // 2):
        return False
    offsets = sorted(r["seen_total"] - r["session_new"] for r in shown if r["seen_total"] != r["session_new"])
    if len(offsets) < max(4, int(len(shown) * 0.8)):
        return False
    middle = (offsets[(len(offsets) - 1) // 2] + offsets[len(offsets) // 2]) / 2
    return middle >= 5 and sum(o >= 4 for o in offsets) >= max(4, int(len(shown) * 0.6))


def totals_dropped(before: dict, rows: Sequence[dict]) -> bool:
    """Most totals lie clearly below what was displayed last."""
    shown = [r for r in rows if r["seen_total"] is not None]
    if not before or len(shown) < max(4, len(rows) // 2):
        return False
    drops = sum(r["player"] in before and r["seen_total"] + max(2, r["points"]) < before[r["player"]] for r in shown)
    return drops >= max(4, int(len(shown) * 0.7))


def totals_are_points(rows: Sequence[dict]) -> bool:
    """Most totals differ from the expected ones, equal the race's points and lie clearly below the expected ones."""
    shown = [r for r in rows if r["seen_total"] is not None]
    if len(shown) < max(4, len(rows) // 2):
        return False
    need = lambda share: max(4, int(len(shown) * share))
    return (
        sum(r["seen_total"] != r["session_new"] for r in shown) >= need(0.8)
        and sum(r["seen_total"] == r["points"] for r in shown) >= need(0.6)
        and sum(r["session_new"] >= r["seen_total"] + max(3, r["points"]) for r in shown) >= need(0.6)
    )


def broken_order(rows: Sequence[dict]) -> set[int]:
    """Row numbers whose totals rise from one shown position to the next."""
    shown = sorted((r for r in rows if r["shown_position"] is not None and r["seen_total"] is not None), key=lambda r: r["shown_position"])
    return {r["at"] for a, b in zip(shown, shown[1:]) if b["seen_total"] > a["seen_total"] for r in (a, b)}


def _row_result(r: dict, rebased: bool, reset: bool, broken: set[int], expected: int) -> tuple[str, list[str]]:
    codes = [c.strip() for c in str(r["codes"] or "").split(";") if c.strip()]
    status = "rebased" if rebased else "computed_only"
    if r["seen_points"] is not None:
        if not 1 <= r["seen_points"] <= 15:
            codes.append("race_points_out_of_range")
            status = "race_points_mismatch"
        elif r["seen_points"] != r["points"]:
            codes.append("race_points_mismatch")
            status = "race_points_mismatch"
        elif status == "computed_only":
            status = "race_points_match"
    total = r["seen_total"]
    if total is not None:
        if not 1 <= total <= 999:
            codes.append("total_score_out_of_range")
            status = "total_score_mismatch"
        elif total != r["session_new"]:
            codes.append("total_score_mismatch")
            status = "total_score_mismatch"
        elif status in ("computed_only", "race_points_match"):
            status = "validated"
    if r["at"] in broken and total is not None and total != r["session_new"]:
        codes.append("total_score_order_violation")
        if status in ("computed_only", "race_points_match", "validated", "rebased"):
            status = "total_score_order_violation"
    if reset:
        codes.append("connection_reset")
        status = "connection_reset"
    if not r["low_res"] and r["name_confidence"] < 45:
        codes.append("low_name_confidence")
    if not r["low_res"] and r["digit_consensus"] < 55:
        codes.append("low_digit_consensus")
    if r["row_count_confidence"] < 60:
        codes.append("unstable_row_count")
    if r["players"] != expected:
        codes.append("player_count_mismatch")
    if r["total_players"] != r["players"]:
        codes.append("race_total_player_count_mismatch")
    return status, sorted(set(codes))


def _whole(value: object) -> int | None:
    return None if value is None or value != value or value is pd.NA else int(value)


def validate_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """All races of one source in order; see ADDED for what is added."""
    pdf = pdf.sort_values(["race_id", "position"], kind="stable").reset_index(drop=True)
    sizes = Counter(Counter(pdf["race_id"]).values())
    expected = min(n for n, k in sizes.items() if k == max(sizes.values()))
    tournament: dict = {}
    session: dict = {}
    displayed: dict = {}
    index, results = 1, {}
    for number, (_, race) in enumerate(pdf.groupby("race_id", sort=True)):
        rows = []
        for r in race.to_dict("records") if len(race) else []:
            points = int(r["points"])
            old, own = tournament.get(r["player"], 0), session.get(r["player"], 0)
            rows.append(
                {k: r[k] for k in ("player", "codes", "low_res", "name_confidence", "digit_consensus", "row_count_confidence", "players", "total_players")}
                | {"points": points, "old": old, "new": old + points, "session_old": own, "session_new": own + points, "seen_points": _whole(r["seen_points"]), "seen_old": _whole(r["seen_old"]), "seen_total": _whole(r["seen_total"]), "shown_position": _whole(r["shown_position"])}
            )
        for at, r in zip(race.index, rows):
            r["at"] = at
        rebased = number == 0 and (starts_midway(rows) or starts_higher(rows))
        reset = totals_dropped(displayed, rows) or totals_are_points(rows)
        index += reset
        for r in rows:
            if rebased and (r["seen_old"] is not None or r["seen_total"] is not None):
                base = r["seen_old"] if r["seen_old"] is not None else r["seen_total"] - r["points"]
                after = max(0, base) + r["points"] if r["seen_old"] is not None else r["seen_total"]
                r["old"] = r["session_old"] = max(0, base)
                r["new"] = r["session_new"] = after
            if reset:
                r["session_old"], r["session_new"] = 0, r["points"]
        seen, wanted = [r["seen_total"] for r in rows], [r["session_new"] for r in rows]
        if None not in seen and Counter(seen) == Counter(wanted):
            for r in rows:  # the same totals on other rows: they are dealt as expected
                r["seen_total"] = r["session_new"]
        broken = broken_order(rows)
        for r in rows:
            status, codes = _row_result(r, rebased, reset, broken, expected)
            results[r["at"]] = (index, r["session_old"], r["session_new"], r["old"], r["new"], status, rebased, reset, ";".join(codes), bool(codes))
            tournament[r["player"]], session[r["player"]] = r["new"], r["session_new"]
            if r["seen_total"] is not None:
                displayed[r["player"]] = r["seen_total"]
    names = [c.split()[0] for c in ADDED.split(", ")]
    return pd.concat([pdf.drop(columns=[n for n in names if n in pdf]), pd.DataFrame([results[i] for i in pdf.index], columns=names, index=pdf.index)], axis=1)


def validate_sessions(rows: DataFrame) -> DataFrame:
    """Running totals, session numbers, status and review codes of every row, and its rank after the race.

    rows: race_class, race_id, position, player, points, seen_points, seen_old, seen_total, shown_position, codes, low_res,
    name_confidence, digit_consensus, row_count_confidence, players, total_players. An empty table stays empty.
    """
    added = {c.split()[0] for c in ADDED.split(", ")}
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in added)
    return rank_in_race(rows.groupBy("race_class").applyInPandas(validate_source, f"{kept}, {ADDED}"), "new_total", "position_after")
