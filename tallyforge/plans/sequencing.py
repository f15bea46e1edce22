"""Queries of the order-dependent operators, on events as time series of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.operators import sequences as Q
from tallyforge.plans.registry import query
from tallyforge.sources.tables import table


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and second."""
    e = table(spark, sf_dir, "events")
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    rows = e.select("user_id", tick.alias("tick"), "event_type", F.round(F.col("value") * 100).cast("long").alias("score"), "event_id")
    return rows.groupBy("user_id", "tick").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max_by("score", "event_id").alias("score"))


SERIES = """
WITH RECURSIVE series AS (SELECT user_id, EPOCH_US(ts) // 1000000 AS tick, MAX_BY(event_type, event_id) AS event_type, CAST(ROUND(MAX_BY(value, event_id) * 100) AS BIGINT) AS score FROM events GROUP BY ALL),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY tick) AS i FROM series)
"""
#: Two hours: about one event in five has a neighbour that near.
GAP = 7200


@query(
    SERIES
    + f""", f AS (SELECT user_id, i, tick AS f, score AS c, CAST(NULL AS BIGINT) AS of, CAST(NULL AS BIGINT) AS oc FROM n WHERE i = 1
    UNION ALL SELECT n.user_id, n.i, CASE WHEN n.tick - f.f <= {GAP} THEN CASE WHEN n.score > f.c THEN n.tick ELSE f.f END ELSE n.tick END,
      CASE WHEN n.tick - f.f <= {GAP} THEN GREATEST(n.score, f.c) ELSE n.score END, CASE WHEN n.tick - f.f > {GAP} THEN f.f END, CASE WHEN n.tick - f.f > {GAP} THEN f.c END
      FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
    SELECT user_id, of AS tick, oc AS score FROM f WHERE of IS NOT NULL UNION ALL SELECT user_id, f, c FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""
)
def u5_proximity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.keep_strongest_nearby(series(spark, sf_dir), ["user_id"], "tick", "score", GAP)


@query(
    SERIES
    + f""", f AS (SELECT user_id, i, tick AS kept, TRUE AS is_kept FROM n WHERE i = 1
    UNION ALL SELECT n.user_id, n.i, CASE WHEN n.tick - f.kept < {GAP} THEN f.kept ELSE n.tick END, n.tick - f.kept >= {GAP} FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
    SELECT user_id, kept AS tick FROM f WHERE is_kept"""
)
def st1_skip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.suppress_after(series(spark, sf_dir), ["user_id"], "tick", GAP)


@query(
    SERIES
    + """, c AS (SELECT *, CASE WHEN event_type = LAG(event_type) OVER (PARTITION BY user_id ORDER BY tick) THEN 0 ELSE 1 END AS new FROM n),
    r AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY tick) AS run FROM c), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, run ORDER BY tick) AS m FROM r)
    SELECT user_id, MIN(tick) AS tick FROM k WHERE m = 3 GROUP BY ALL"""
)
def st5_stable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stable_at(series(spark, sf_dir), ["user_id"], ["tick"], "event_type", 3)


@query(
    SERIES
    + f""", h AS (SELECT user_id, tick, CASE WHEN tick - LAG(tick) OVER (PARTITION BY user_id ORDER BY tick) > {10 * GAP} + 1 THEN 1 ELSE 0 END AS new FROM series WHERE event_type IN ('click', 'view')),
    s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY tick) AS k FROM h), c AS (SELECT user_id, k, MIN(tick) AS tick FROM s GROUP BY ALL HAVING COUNT(*) >= 5)
    SELECT user_id, MIN(tick) AS tick FROM c GROUP BY ALL"""
)
def st4_debounced_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("hit", F.col("event_type").isin("click", "view"))
    return Q.debounced(rows, ["user_id"], "tick", "hit", 5, 10 * GAP)


@query(
    SERIES
    + f""", e AS (SELECT *, MAX(tick) OVER (PARTITION BY user_id) AS fin FROM series), h AS (SELECT user_id, tick, COALESCE(LEAD(tick) OVER (PARTITION BY user_id ORDER BY tick), fin) AS nxt FROM e WHERE event_type = 'error')
    SELECT user_id, tick FROM h WHERE nxt - tick >= {5 * GAP}"""
)
def st6_inactivity_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).withColumn("hit", F.col("event_type") == "error")
    return Q.timed_out(rows, ["user_id"], "tick", "hit", 5 * GAP)


@query(
    SERIES
    + """, c AS (SELECT user_id, tick // 86400 AS day, COUNT(*) FILTER (WHERE score > p) AS rising, COUNT(*) FILTER (WHERE event_type <> q) AS changed FROM (SELECT *, LAG(score) OVER w AS p, LAG(event_type) OVER w AS q FROM series WINDOW w AS (PARTITION BY user_id ORDER BY tick)) GROUP BY ALL)
    SELECT user_id, MIN(day) AS day FROM c WHERE rising >= 2 AND (changed >= 1 OR rising >= 3) GROUP BY ALL"""
)
def w12_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day with two rising scores and one changed type (or three rising scores)."""
    w = Window.partitionBy("user_id").orderBy("tick")
    rows = Q.changed_rows(series(spark, sf_dir), ["user_id"], ["tick"], "event_type").withColumn("rises", F.coalesce(F.col("score") > F.lag("score").over(w), F.lit(False)))
    days = rows.groupBy("user_id", F.floor(F.col("tick") / 86400).alias("day")).agg(F.count_if("rises").alias("r"), F.count_if("changed").alias("c"))
    return days.where("r >= 2 AND (c >= 1 OR r >= 3)").groupBy("user_id").agg(F.min("day").alias("day"))


@query(SERIES + f"SELECT user_id, tick // {24 * GAP} AS segment, COUNT(*) AS n FROM series GROUP BY ALL")
def st2_segment_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal segments are read with an overlap to both sides; a row is emitted by the segment that owns its half-open range."""
    size, lap = 24 * GAP, GAP
    reads = F.explode(F.sequence(F.floor((F.col("tick") - lap) / size), F.floor((F.col("tick") + lap) / size)))
    scanned = series(spark, sf_dir).withColumn("segment", reads)
    owned = scanned.where((F.col("tick") >= F.col("segment") * size) & (F.col("tick") < (F.col("segment") + 1) * size))
    return owned.groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query(
    SERIES
    + f""", s AS (SELECT user_id, event_type, tick, CASE WHEN tick - LAG(tick) OVER (PARTITION BY user_id, event_type ORDER BY tick) > {GAP} THEN 1 ELSE 0 END AS new FROM series),
    g AS (SELECT *, SUM(new) OVER (PARTITION BY user_id, event_type ORDER BY tick) AS g FROM s), m AS (SELECT user_id, event_type, g, MIN(tick) AS tick FROM g GROUP BY ALL)
    SELECT user_id, event_type, tick, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY tick, event_type) AS number FROM m"""
)
def st3_overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments' detections merged per kind (chains within the gap), then numbered per source."""
    cut = Q.cut_at_gaps(series(spark, sf_dir), ["user_id", "event_type"], "tick", GAP)
    merged = cut.groupBy("user_id", "event_type", "segment").agg(F.min("tick").alias("tick")).drop("segment")
    return merged.withColumn("number", F.row_number().over(Window.partitionBy("user_id").orderBy("tick", "event_type")).cast("long"))


@query(
    """WITH r AS (SELECT l_orderkey AS race, l_linenumber % 3 AS revision, l_partkey FROM lineitem), m AS (SELECT race, MAX(revision) AS revision FROM r GROUP BY 1)
    SELECT r.race, CAST(r.revision AS BIGINT) AS revision, COUNT(*) AS rows FROM r JOIN m ON r.race = m.race AND r.revision = m.revision GROUP BY ALL"""
)
def st7_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of results that are sent again with a higher revision, the latest."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("race"), (F.col("l_linenumber") % 3).cast("long").alias("revision"))
    counts = r.groupBy("race", "revision").agg(F.count("*").alias("rows"))
    return counts.groupBy("race").agg(F.max(F.struct("revision", "rows")).alias("x")).select("race", "x.revision", "x.rows")


@query(
    SERIES
    + """, r AS (SELECT user_id, tick // 86400 AS race, COUNT(*) AS n FROM series GROUP BY ALL) SELECT user_id, race, CAST(COALESCE(SUM(n) OVER (PARTITION BY user_id ORDER BY race RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS known FROM r"""
)
def st9_causal_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known at a race: everything from strictly earlier races of the source."""
    r = series(spark, sf_dir).groupBy("user_id", F.floor(F.col("tick") / 86400).alias("race")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("race").rangeBetween(Window.unboundedPreceding, -1)
    return r.select("user_id", "race", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("known"))
