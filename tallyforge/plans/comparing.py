"""Queries of session validation and of the comparing and reporting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.operators.sessions import validate_sessions
from tallyforge.plans.registry import query
from tallyforge.plans.scoring import RACES, races
from tallyforge.sources.tables import table


@query()
def k1_session_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential per source; tests check its rules on literal rows."""
    rows = races(spark, sf_dir)
    null = F.lit(None).cast("long")
    seen = rows.select(
        "race_class", "race_id", "position", "player", "points", F.when(F.col("price") % 9 == 0, F.col("points") + 1).otherwise(F.col("points")).alias("seen_points"), null.alias("seen_old"),
        F.when(F.col("price") % 4 != 0, F.col("points") + F.col("price") % 3).alias("seen_total"), F.col("position").alias("shown_position"), F.lit("").alias("codes"), F.lit(False).alias("low_res"),
        (F.col("price") % 60 + 40).cast("double").alias("name_confidence"), F.lit(80.0).alias("digit_consensus"), F.lit(90.0).alias("row_count_confidence"), "players", F.col("players").alias("total_players"),
    )
    return validate_sessions(seen).select("race_class", "race_id", "position", "session_index", "session_new_total", "new_total", "status", "codes", "position_after")


@query(RACES + ", c AS (SELECT race_class, CASE WHEN players > 6 THEN 'large' WHEN players % 2 = 0 THEN 'even' ELSE 'odd' END AS class, race_id, BOOL_OR(price % 5 = 0) AS changed FROM rows_ GROUP BY ALL) SELECT class, COUNT(*) AS races, COUNT(*) FILTER (WHERE changed) AS changed FROM c GROUP BY ALL")
def a25_drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("players") > 6, "large").when(F.col("players") % 2 == 0, "even").otherwise("odd")
    per = races(spark, sf_dir).groupBy("race_class", "race_id", kind.alias("class")).agg(F.bool_or(F.col("price") % 5 == 0).alias("changed"))
    return per.groupBy("class").agg(F.count("*").alias("races"), F.count_if("changed").alias("changed"))


@query(RACES + "SELECT race_class, COUNT(*) AS rows, ROUND(100.0 * COUNT(*) FILTER (WHERE price % 16 = points) / COUNT(*), 4) AS exact_percent, COUNT(*) FILTER (WHERE price % 16 > points) AS higher FROM rows_ GROUP BY ALL")
def a26_accuracy_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.col("price") % 16
    return races(spark, sf_dir).groupBy("race_class").agg(F.count("*").alias("rows"), F.round(F.count_if(seen == F.col("points")) * 100.0 / F.count("*"), 4).alias("exact_percent"), F.count_if(seen > F.col("points")).alias("higher"))


@query(RACES + ", s AS (SELECT race_class, race_id, COUNT(*) AS n, BOOL_OR(price % 7 = 0) AS reviewed FROM rows_ GROUP BY ALL), i AS (SELECT race_class, COUNT(DISTINCT player) AS identities FROM rows_ GROUP BY ALL), m AS (SELECT race_class, n, COUNT(*) AS k FROM s GROUP BY ALL), e AS (SELECT race_class, MIN_BY(n, (-k, n)) AS mode FROM m GROUP BY ALL) SELECT s.race_class, COUNT(*) AS races, COUNT(*) FILTER (WHERE reviewed) AS reviewed, MIN(mode) AS mode, MIN(identities) > MIN(mode) AS too_many FROM s JOIN i USING (race_class) JOIN e USING (race_class) GROUP BY ALL")
def a21_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.operators.votes import smallest_mode

    rows = races(spark, sf_dir)
    per = rows.groupBy("race_class", "race_id").agg(F.count("*").alias("mode"), F.bool_or(F.col("price") % 7 == 0).alias("reviewed"))
    mode = smallest_mode(per, ["race_class"], "mode")
    ids = rows.groupBy("race_class").agg(F.countDistinct("player").alias("identities"))
    sums = per.groupBy("race_class").agg(F.count("*").alias("races"), F.count_if("reviewed").alias("reviewed"))
    return sums.join(ids, "race_class").join(mode, "race_class").select("race_class", "races", "reviewed", "mode", (F.col("identities") > F.col("mode")).alias("too_many"))


@query(RACES + "SELECT race_class, player, race_id, position, 'R' || race_id || 'P' || position AS label, CAST(SUM(points) OVER (PARTITION BY race_class, player ORDER BY race_id, position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM rows_")
def k7_cumulative_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("race_class", "player").orderBy("race_id", "position").rowsBetween(Window.unboundedPreceding, 0)
    label = F.concat(F.lit("R"), F.col("race_id"), F.lit("P"), F.col("position"))
    return races(spark, sf_dir).select("race_class", "player", "race_id", "position", label.alias("label"), F.sum("points").over(w).alias("running"))


@query("WITH s AS (SELECT event_type, COUNT(*) AS calls, ROUND(SUM(value), 2) AS seconds, ROUND(1000 * AVG(value), 2) AS avg_ms FROM events GROUP BY 1) SELECT *, CASE WHEN seconds >= 0.205 * (SELECT SUM(seconds) FROM s) THEN 'heavy' ELSE 'light' END AS class FROM s")
def k8_profiler_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, seconds and mean by label, with a label for those that take a large share; the total comes from one row per label."""
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("seconds"), F.round(1000 * F.avg("value"), 2).alias("avg_ms"))
    share = F.col("seconds") >= 0.205 * F.sum("seconds").over(Window.partitionBy())
    return s.withColumn("class", F.when(share, "heavy").otherwise("light"))


@query("SELECT user_id, event_id, MAX(CASE WHEN value > 10 THEN ROUND(value, 2) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak FROM events")
def k9_running_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.max(F.when(F.col("value") > 10, F.round("value", 2))).over(w).alias("peak"))


@query("WITH l AS (SELECT user_id, event_type, MAX_BY(ROUND(value), event_id) AS frames FROM events GROUP BY ALL) SELECT user_id, CAST(SUM(LEAST(GREATEST(frames, 5), 90)) AS BIGINT) AS done, COUNT(*) AS segments FROM l GROUP BY ALL")
def k10_progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of each segment, clamped to what it owns, summed per source."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by(F.round("value"), "event_id").alias("f"))
    return last.groupBy("user_id").agg(F.sum(F.least(F.greatest("f", F.lit(5)), F.lit(90))).cast("long").alias("done"), F.count("*").alias("segments"))


@query("WITH d AS (SELECT user_id, event_type, COUNT(*) AS events, COUNT(DISTINCT ROUND(value)) AS frames FROM events GROUP BY ALL) SELECT user_id, CAST(SUM(events) AS BIGINT) AS events, CAST(SUM(events - frames) AS BIGINT) AS duplicates FROM d GROUP BY ALL")
def k6_capture_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("events"), F.countDistinct(F.round("value")).alias("frames"))
    return d.groupBy("user_id").agg(F.sum("events").alias("events"), F.sum(F.col("events") - F.col("frames")).alias("duplicates"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, LOWER(c_name) DESC LIMIT 10")
def s5_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.sources.files import longest

    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("label"), F.col("c_acctbal").alias("length_s"))
    return longest(c, 10).select("c_custkey", F.col("label").alias("c_name"), F.col("length_s").alias("c_acctbal"))


@query("SELECT o_custkey, o_orderpriority, MAX_BY(o_orderstatus, o_orderkey) AS status, MAX(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def s12_last_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max(F.struct("o_orderkey", F.col("o_orderstatus").alias("status"))).alias("x"))
    return o.select("o_custkey", "o_orderpriority", "x.status", "x.o_orderkey")
