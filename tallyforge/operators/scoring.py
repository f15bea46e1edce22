"""Scoring rows of ranked events: points, ranks, running totals, exclusion, standings.

Rows carry race_class (a source), race_id (an event of it), player, position and whatever else; all functions add or reduce
columns and leave the rest alone. Every window is partitioned by the source at least, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Points by number of players, from the first position on; other numbers of players use the table for twelve.
POINTS = {
    12: [15, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
    11: [13, 11, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
    10: [12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0],
    9: [11, 9, 7, 6, 5, 4, 3, 2, 1, 0],
    8: [10, 8, 6, 5, 4, 3, 2, 1, 0],
    7: [9, 7, 5, 4, 3, 2, 1, 0],
    6: [7, 5, 4, 3, 2, 1, 0],
    5: [6, 4, 3, 2, 1, 0],
    4: [4, 3, 2, 1, 0],
    3: [3, 2, 1, 0],
    2: [2, 1, 0],
}


def points(position: Column, players: Column) -> Column:
    """Points of a position among so many players; positions beyond the table give 0."""
    table = F.create_map(*[x for n, row in POINTS.items() for x in (F.lit(n), F.array(*map(F.lit, row)))])
    own = F.coalesce(F.try_element_at(table, players.cast("int")), F.array(*map(F.lit, POINTS[12])))
    return F.when(position >= 1, F.coalesce(F.get(own, position.cast("int") - 1), F.lit(0))).otherwise(0).cast("long")


def rank_in_race(rows: DataFrame, total: str, to: str = "rank") -> DataFrame:
    """Competition rank by falling total within a race; a null total has a null rank."""
    w = Window.partitionBy("race_class", "race_id").orderBy(F.desc_nulls_last(total))
    return rows.withColumn(to, F.when(F.col(total).isNotNull(), F.rank().over(w).cast("long")))


def running_totals(rows: DataFrame, value: Column, keys: tuple[str, ...] = ("race_class", "player"), order: tuple[str, ...] = ("race_id", "position"), before: str = "old_total", after: str = "new_total") -> DataFrame:
    """Totals of a key before and after each of its rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(after, F.sum(value).over(w)).withColumn(before, F.col(after) - value)


def excluded_races(rows: DataFrame, count: str = "players", session: tuple[str, ...] = ("race_class",)) -> DataFrame:
    """Adds counts: false where a later race of the session has more players (they were away for a while)."""
    w = Window.partitionBy(*session).orderBy("race_id").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("counts", F.col(count) >= F.max(count).over(w))


def seeded(rows: DataFrame, old: str, session: tuple[str, ...] = ("race_class",)) -> DataFrame:
    """Adds base: a player's shown old total if every row of the session's first race has one above zero, else 0."""
    s = Window.partitionBy(*session)
    first = F.col("race_id") == F.min("race_id").over(s)
    usable = F.min(F.when(first, F.coalesce(F.col(old) > 0, F.lit(False)).cast("int"))).over(s) == 1
    own = F.max(F.when(first, F.col(old))).over(Window.partitionBy(*session, "player"))
    return rows.withColumn("base", F.when(usable, F.coalesce(own, F.lit(0))).otherwise(0).cast("long"))


def last_rows(rows: DataFrame, keys: tuple[str, ...] = ("race_class", "player"), order: tuple[str, ...] = ("race_id", "position")) -> DataFrame:
    """The last row of each key; rows with a null key are left out. A partial aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return kept.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def standings(last: DataFrame, total: str) -> DataFrame:
    """Rank of each player by total within its source."""
    w = Window.partitionBy("race_class").orderBy(F.desc(total))
    return last.withColumn("rank", F.rank().over(w).cast("long"))


def most_used(rows: DataFrame, value: str, keys: tuple[str, ...] = ("race_class", "player")) -> DataFrame:
    """The value used most per key; ties by the later race, then by lower-case and plain spelling. Blanks are ignored."""
    used = rows.where(F.trim(F.col(value)) != "").groupBy(*keys, value).agg(F.count("*").alias("n"), F.max("race_id").alias("last"))
    best = F.min_by(value, F.struct(-F.col("n"), -F.col("last"), F.lower(value), F.col(value)))
    return used.groupBy(*keys).agg(best.alias(value))


def segment_columns(rows: DataFrame, total: str, session: str, segments: int) -> DataFrame:
    """The highest total of each session as one column per session (an explicit pivot, so that no job is needed to find its width)."""
    return rows.groupBy("race_class", "player").agg(*[F.max(F.when(F.col(session) == k, F.col(total))).alias(f"points_segment_{k}") for k in range(1, segments + 1)])


def order_violations(rows: DataFrame, total: str) -> DataFrame:
    """Adds violates: neighbours by position, nulls left out, whose totals rise."""
    shown = rows.where(F.col("position").isNotNull() & F.col(total).isNotNull())
    w = Window.partitionBy("race_class", "race_id").orderBy("position")
    up = F.coalesce(F.col(total) > F.lag(total).over(w), F.lit(False)) | F.coalesce(F.lead(total).over(w) > F.col(total), F.lit(False))
    return shown.withColumn("violates", up)


def numbered_labels(rows: DataFrame, base: str, order: tuple[str, ...], keys: tuple[str, ...] = ("race_class",)) -> DataFrame:
    """base_k for ids that share a base within a source; a lone one keeps its base."""
    all_, w = Window.partitionBy(*keys, base), Window.partitionBy(*keys, base).orderBy(*order)
    return rows.withColumn("label", F.when(F.count("*").over(all_) > 1, F.concat_ws("_", F.col(base).cast("string"), F.row_number().over(w).cast("string"))).otherwise(F.col(base).cast("string")))


def scoring_policy(rows: DataFrame) -> DataFrame:
    """Exclusion, running totals over counted races and the rank after each race, in one pass over the same partitioning."""
    marked = excluded_races(rows)
    counted = running_totals(marked, F.when(F.col("counts"), F.col("points")).otherwise(F.lit(0).cast("long")))
    return rank_in_race(counted, "new_total")


def same_multiset(rows: DataFrame, keys: list[str], seen: str, expected: str, to: str) -> DataFrame:
    """`to`: the expected values of a group whose seen values are the same multiset (none unknown), else the seen ones."""
    w = Window.partitionBy(*keys)
    group = lambda c: F.array_sort(F.collect_list(F.col(c)).over(w))
    whole = (F.count(seen).over(w) == F.count("*").over(w)) & (group(seen) == group(expected))
    return rows.withColumn("__same", whole).withColumn(to, F.when(F.col("__same"), F.col(expected)).otherwise(F.col(seen))).drop("__same")
