"""The finalisation of observed races: the operators in the order in which their results depend on one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.operators import matching as M, names as N, scoring as S
from tallyforge.operators.sessions import validate_sessions


def finalise(seen: DataFrame) -> DataFrame:
    """Standings of every source: race_class, player, label, session_index, total, rank, and the races counted.

    seen: race_class, race_id, position, points, players, name, character, seen_total, confidence. In order: identities race by race;
    chains of rows that share a name; labels of one race that adjacent races explain; sessions; display labels; the scoring policy;
    standings. Each step's rows are those of the step before, so no row is lost: a relinked label changes its player only.
    """
    null = F.lit(None).cast("double")
    unsure = M.unreliable_names(F.col("confidence"), null, F.lit(""))
    start = seen.withColumn("old_total", null).withColumn("new_total", null).withColumn("unreliable", unsure)
    linked = M.link_identities(start)
    # rows of one spelling that share a race are one base label: their chains keep them apart
    base = linked.withColumn("base", F.col("identity"))
    chained = N.resolve_chains(base.withColumn("label_index", F.lit(1).cast("long")))
    labelled = chained.withColumn("label", F.when(F.col("chain") > 1, F.col("identity") * 100 + F.col("chain")).otherwise(F.col("identity") * 100))
    index = F.dense_rank().over(Window.partitionBy("race_class").orderBy("race_id")).cast("long")
    indexed = labelled.withColumn("race_index", index)
    moves = M.single_race_outliers(indexed.select("race_class", "race_index", "position", "label", "unreliable", "character"))
    moved = indexed.join(moves, ["race_class", "label", "race_index"], "left").withColumn("player", F.coalesce("to", "label"))
    none, sure = F.lit(None).cast("long"), F.lit(90.0)
    ready = moved.select(
        "race_class", "race_id", "position", "player", "points", F.col("points").alias("seen_points"), none.alias("seen_old"), "seen_total", F.col("position").alias("shown_position"), F.lit("").alias("codes"),
        F.lit(False).alias("low_res"), F.col("confidence").alias("name_confidence"), sure.alias("digit_consensus"), sure.alias("row_count_confidence"), "players", F.col("players").alias("total_players"),
    )
    valid = validate_sessions(ready).select("race_class", "race_id", "position", "player", "points", "players", "session_index", "status")
    scored = S.scoring_policy(valid)
    ids = scored.groupBy("race_class", "player").agg(F.min("race_id").alias("first_race"), F.min("position").alias("first_position"), F.countDistinct("race_id").alias("races")).withColumn("base", F.floor(F.col("player") / 100).cast("string"))
    labels = S.numbered_labels(ids, "base", ("first_race", "first_position", "player")).select("race_class", "player", "label", "races")
    last = S.last_rows(scored).join(labels, ["race_class", "player"])
    return S.standings(last, "new_total").select("race_class", "player", "label", "session_index", "races", F.col("new_total").alias("total"), "rank")
