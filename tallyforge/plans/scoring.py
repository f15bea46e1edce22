"""Queries of the scoring operators. Orders are races of a customer (the source), their line items are the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.operators import scoring as S
from tallyforge.plans.registry import query
from tallyforge.sources.tables import table

#: The same rows in SQL; every oracle below starts with it.
RACES = """
WITH races AS (
  SELECT o_custkey AS race_class, l_orderkey AS race_id, l_partkey % 12 AS player, l_suppkey AS supplier,
         CAST(ROUND(l_extendedprice) AS BIGINT) AS price, l_returnflag AS flag,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS position,
         COUNT(*) OVER (PARTITION BY l_orderkey) AS players
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
table_points(n, pts) AS (VALUES (12, [15,12,10,9,8,7,6,5,4,3,2,1,0]), (11, [13,11,9,8,7,6,5,4,3,2,1,0]), (10, [12,10,8,7,6,5,4,3,2,1,0]),
  (9, [11,9,7,6,5,4,3,2,1,0]), (8, [10,8,6,5,4,3,2,1,0]), (7, [9,7,5,4,3,2,1,0]), (6, [7,5,4,3,2,1,0]), (5, [6,4,3,2,1,0]),
  (4, [4,3,2,1,0]), (3, [3,2,1,0]), (2, [2,1,0])),
rows_ AS (SELECT r.*, CAST(COALESCE(COALESCE(t.pts, [15,12,10,9,8,7,6,5,4,3,2,1,0])[r.position], 0) AS BIGINT) AS points FROM races r LEFT JOIN table_points t ON t.n = r.players),
marked AS (SELECT *, players >= MAX(players) OVER (PARTITION BY race_class ORDER BY race_id RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS counts FROM rows_),
totals AS (SELECT *, CAST(SUM(CASE WHEN counts THEN points ELSE 0 END) OVER (PARTITION BY race_class, player ORDER BY race_id, position ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_total FROM marked)
"""


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    w = Window.partitionBy("l_orderkey")
    place = w.orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
    rows = j.select(
        F.col("o_custkey").alias("race_class"), F.col("l_orderkey").alias("race_id"), (F.col("l_partkey") % 12).alias("player"), F.col("l_suppkey").alias("supplier"),
        F.round("l_extendedprice").cast("long").alias("price"), F.col("l_returnflag").alias("flag"), F.row_number().over(place).cast("long").alias("position"), F.count("*").over(place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("players"),
    )
    return rows.withColumn("points", S.points(F.col("position"), F.col("players")))


def race_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """race_class, race_id, players: line items are counted before they meet their orders."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("race_id")).agg(F.count("*").alias("players"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("race_class"), "o_orderkey")
    return li.join(o, F.col("race_id") == F.col("o_orderkey")).select("race_class", "race_id", "players")


@query(RACES + "SELECT race_class, race_id, position, players, points FROM rows_")
def p6_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return races(spark, sf_dir).select("race_class", "race_id", "position", "players", "points")


@query(RACES + "SELECT race_class, race_id, position, CASE WHEN price % 7 <> 0 THEN RANK() OVER (PARTITION BY race_class, race_id ORDER BY CASE WHEN price % 7 <> 0 THEN points END DESC NULLS LAST) END AS rank FROM rows_")
def w1_rank_in_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = races(spark, sf_dir).withColumn("total", F.when(F.col("price") % 7 != 0, F.col("points")))
    return S.rank_in_race(rows, "total").select("race_class", "race_id", "position", "rank")


@query(RACES + ", l AS (SELECT race_class, player, MAX_BY(new_total, (race_id, position)) AS total FROM totals GROUP BY ALL) SELECT race_class, player, total, RANK() OVER (PARTITION BY race_class ORDER BY total DESC) AS rank FROM l")
def w2_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = S.last_rows(S.scoring_policy(races(spark, sf_dir)))
    return S.standings(last.select("race_class", "player", F.col("new_total").alias("total")), "total").select("race_class", "player", "total", "rank")


@query(RACES + "SELECT race_class, player, MAX(race_id) AS race_id, MAX_BY(points, (race_id, position)) AS points FROM rows_ WHERE player <> 5 GROUP BY ALL")
def w3_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = races(spark, sf_dir).withColumn("player", F.when(F.col("player") != 5, F.col("player")))
    return S.last_rows(rows).select("race_class", "player", "race_id", "points")


@query(RACES + "SELECT DISTINCT race_class, race_id, players, counts FROM marked")
def w4_suffix_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.excluded_races(race_sizes(spark, sf_dir))


@query(RACES + "SELECT race_class, race_id, position, player, new_total - CASE WHEN counts THEN points ELSE 0 END AS old_total, new_total FROM totals")
def w5_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scoring_policy(races(spark, sf_dir)).select("race_class", "race_id", "position", "player", "old_total", "new_total")


@query(
    RACES
    + """, o AS (SELECT *, (price % 5) AS shown, MIN(race_id) OVER (PARTITION BY race_class) AS first FROM rows_),
    u AS (SELECT race_class, BOOL_AND(shown > 0) AS usable FROM o WHERE race_id = first GROUP BY 1),
    b AS (SELECT race_class, player, MAX(shown) AS shown FROM o WHERE race_id = first GROUP BY ALL)
    SELECT r.race_class, r.race_id, r.position, CAST(CASE WHEN u.usable THEN COALESCE(b.shown, 0) ELSE 0 END AS BIGINT) AS base
    FROM rows_ r JOIN u USING (race_class) LEFT JOIN b USING (race_class, player)"""
)
def w6_seeded_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = races(spark, sf_dir).withColumn("shown", F.col("price") % 5)
    return S.seeded(rows, "shown").select("race_class", "race_id", "position", "base")


@query(
    RACES
    + """, v AS (SELECT race_class, race_id, position, price % 9 AS total, LAG(price % 9) OVER w AS p, LEAD(price % 9) OVER w AS n FROM rows_ WHERE price % 4 <> 0 WINDOW w AS (PARTITION BY race_class, race_id ORDER BY position))
    SELECT race_class, race_id, position, total, COALESCE(total > p, FALSE) OR COALESCE(n > total, FALSE) AS violates FROM v"""
)
def w7_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = races(spark, sf_dir).withColumn("total", F.when(F.col("price") % 4 != 0, F.col("price") % 9))
    return S.order_violations(rows, "total").select("race_class", "race_id", "position", "total", "violates")


@query(
    RACES
    + """SELECT race_class, race_id, position, LAST_VALUE(CASE WHEN price % 3 <> 0 THEN price END IGNORE NULLS) OVER (PARTITION BY race_class, player ORDER BY race_id, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM rows_"""
)
def w8_previous_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("race_class", "player").orderBy("race_id", "position").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.when(F.col("price") % 3 != 0, F.col("price"))
    return races(spark, sf_dir).select("race_class", "race_id", "position", F.last(shown, ignorenulls=True).over(w).alias("previous"))


@query(
    RACES
    + """, i AS (SELECT race_class, supplier, supplier % 10 AS base, MIN(race_id) AS first_race, MIN(position) AS first_position FROM rows_ GROUP BY ALL)
    SELECT race_class, supplier, CASE WHEN COUNT(*) OVER (PARTITION BY race_class, base) > 1 THEN base || '_' || ROW_NUMBER() OVER (PARTITION BY race_class, base ORDER BY first_race, first_position, supplier) ELSE CAST(base AS VARCHAR) END AS label FROM i"""
)
def w9_numbered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = races(spark, sf_dir).groupBy("race_class", "supplier").agg(F.min("race_id").alias("first_race"), F.min("position").alias("first_position")).withColumn("base", F.col("supplier") % 10)
    return S.numbered_labels(ids, "base", ("first_race", "first_position", "supplier")).select("race_class", "supplier", "label")


@query(
    RACES
    + """, r AS (SELECT race_class, race_id, MAX(players) AS players FROM rows_ GROUP BY ALL)
    SELECT race_class, race_id, MAX(players) OVER (PARTITION BY race_class ORDER BY race_id) AS expected FROM r"""
)
def w15_running_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = race_sizes(spark, sf_dir)
    w = Window.partitionBy("race_class").orderBy("race_id")
    return one.select("race_class", "race_id", F.max("players").over(w).alias("expected"))


@query(
    RACES
    + """, p AS (SELECT race_class, race_id, position, position = SUM(CASE WHEN points > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY race_class, race_id ORDER BY position) AS whole FROM rows_)
    SELECT race_class, race_id, COUNT(*) FILTER (WHERE whole) AS prefix_rows FROM p GROUP BY ALL"""
)
def w10_prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from the first until the first unsupported one."""
    w = Window.partitionBy("race_class", "race_id").orderBy("position")
    ok = F.sum((F.col("points") > 2).cast("long")).over(w) == F.col("position")
    return races(spark, sf_dir).withColumn("ok", ok).groupBy("race_class", "race_id").agg(F.count_if("ok").alias("prefix_rows"))


@query(RACES + "SELECT race_class, race_id, MAX(CASE WHEN price % 10 >= CASE WHEN position = 1 THEN 5 ELSE 3 END THEN position END) AS last_supported FROM rows_ GROUP BY ALL")
def w11_last_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("price") % 10 >= F.when(F.col("position") == 1, 5).otherwise(3)
    return races(spark, sf_dir).groupBy("race_class", "race_id").agg(F.max(F.when(ok, F.col("position"))).alias("last_supported"))


@query(
    RACES
    + """, n AS (SELECT race_class, player, race_id, position, ROW_NUMBER() OVER w AS i, COUNT(*) OVER (PARTITION BY race_class, player) AS n FROM rows_ WINDOW w AS (PARTITION BY race_class, player ORDER BY race_id, position))
    SELECT race_class, player, race_id, position, i <= 3 AS first_k, i > n - 3 AS last_k, i > GREATEST(n - 3, 0) // 2 AND i <= GREATEST(n - 3, 0) // 2 + 3 AS centre_k FROM n"""
)
def w13_subwindows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and central three observations of an ordered list."""
    key = Window.partitionBy("race_class", "player")
    i, n = F.row_number().over(key.orderBy("race_id", "position")), F.count("*").over(key)
    skip = F.floor(F.greatest(F.col("n") - 3, F.lit(0)) / 2)
    rows = races(spark, sf_dir).select("race_class", "player", "race_id", "position", i.alias("i"), n.alias("n"))
    return rows.select("race_class", "player", "race_id", "position", (F.col("i") <= 3).alias("first_k"), (F.col("i") > F.col("n") - 3).alias("last_k"), ((F.col("i") > skip) & (F.col("i") <= skip + 3)).alias("centre_k"))


@query(RACES + ", c AS (SELECT race_class, player, supplier % 6 AS character, COUNT(*) AS n, MAX(race_id) AS last FROM rows_ GROUP BY ALL) SELECT race_class, player, CAST(MIN_BY(character, (-n, -last, character)) AS VARCHAR) AS character FROM c GROUP BY ALL")
def a9_most_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = races(spark, sf_dir).withColumn("character", (F.col("supplier") % 6).cast("string"))
    return S.most_used(rows, "character")


@query(RACES + "SELECT race_class, player, MAX(CASE WHEN race_id % 3 = 0 THEN new_total END) AS points_segment_1, MAX(CASE WHEN race_id % 3 = 1 THEN new_total END) AS points_segment_2, MAX(CASE WHEN race_id % 3 = 2 THEN new_total END) AS points_segment_3 FROM totals GROUP BY ALL")
def a10_segment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scoring_policy(races(spark, sf_dir)).withColumn("session", F.col("race_id") % 3 + 1)
    return S.segment_columns(rows, "new_total", "session", 3)


@query(
    RACES
    + """, f AS (SELECT race_class, player, COUNT(DISTINCT race_id) AS races, MAX_BY(new_total, (race_id, position)) AS total FROM totals GROUP BY ALL)
    SELECT race_class, player, races, total, RANK() OVER (PARTITION BY race_class ORDER BY total DESC) AS rank FROM f"""
)
def k2_standings_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, exclusion, running totals and standings in one plan."""
    rows = S.scoring_policy(races(spark, sf_dir))
    last = rows.groupBy("race_class", "player").agg(F.countDistinct("race_id").alias("races"), F.max_by("new_total", F.struct("race_id", "position")).alias("total"))
    return S.standings(last, "total")


@query(
    RACES
    + """SELECT race_class, race_id, position, CASE WHEN NOT points BETWEEN 1 AND 15 THEN 'race_points_out_of_range' END AS race_code, CASE WHEN NOT new_total BETWEEN 1 AND 999 THEN 'total_score_out_of_range' END AS total_code FROM totals"""
)
def p10_range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scoring_policy(races(spark, sf_dir))
    code = lambda c, hi, name: F.when(~F.col(c).between(1, hi), F.lit(name))
    return rows.select("race_class", "race_id", "position", code("points", 15, "race_points_out_of_range").alias("race_code"), code("new_total", 999, "total_score_out_of_range").alias("total_code"))


@query(
    RACES
    + """SELECT race_class, race_id, position, CASE WHEN price % 11 = 0 THEN 'Connection Reset' WHEN points = 0 THEN 'Race Points Mismatch' WHEN new_total > 60 THEN 'Total Score Mismatch' WHEN price % 2 = 0 THEN 'Validated' ELSE 'Computed Only' END AS status FROM totals"""
)
def p11_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered override of status codes, then the readable label."""
    rows = S.scoring_policy(races(spark, sf_dir))
    code = F.when(F.col("price") % 11 == 0, "connection_reset").when(F.col("points") == 0, "race_points_mismatch").when(F.col("new_total") > 60, "total_score_mismatch").when(F.col("price") % 2 == 0, "validated").otherwise("computed_only")
    return rows.select("race_class", "race_id", "position", F.initcap(F.translate(code, "_", " ")).alias("status"))


@query(RACES + "SELECT race_class, race_id, position, player, price FROM rows_ WHERE price % 2 = 0 UNION ALL SELECT race_class, race_id, position, player + 100, -price FROM rows_ WHERE price % 2 <> 0")
def p3_split_and_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = races(spark, sf_dir).select("race_class", "race_id", "position", "player", "price")
    low = rows.where("price % 2 <> 0").select("race_class", "race_id", "position", (F.col("player") + 100).alias("player"), (-F.col("price")).alias("price"))
    return rows.where("price % 2 = 0").unionByName(low)


@query(RACES + "SELECT race_class, race_id, position, race_class IN (1, 5, 9) OR players <= 2 AS is_low FROM rows_")
def p4_conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return races(spark, sf_dir).select("race_class", "race_id", "position", (F.col("race_class").isin(1, 5, 9) | F.coalesce(F.col("players") <= 2, F.lit(False))).alias("is_low"))


@query(RACES + ", c AS (SELECT race_class, race_id, BOOL_OR(points > 0) AND COUNT(*) >= 2 AS complete FROM rows_ GROUP BY ALL) SELECT race_class, race_id FROM c WHERE complete")
def p14_complete_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return races(spark, sf_dir).groupBy("race_class", "race_id").agg((F.bool_or(F.col("points") > 0) & (F.count("*") >= 2)).alias("ok")).where("ok").select("race_class", "race_id")


@query(RACES + ", s AS (SELECT race_class, race_id, COUNT(*) AS n FROM rows_ GROUP BY ALL), c AS (SELECT race_class, n, COUNT(*) AS k FROM s GROUP BY ALL) SELECT race_class, MIN_BY(n, (-k, n)) AS expected_players FROM c GROUP BY ALL")
def a7_smallest_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.operators.votes import smallest_mode

    sizes = race_sizes(spark, sf_dir).withColumnRenamed("players", "expected_players")
    return smallest_mode(sizes, ["race_class"], "expected_players")


@query(RACES + "SELECT race_class, COUNT(DISTINCT race_id) AS races, COUNT(DISTINCT player) AS players, COUNT(DISTINCT CASE WHEN price % 5 = 0 THEN race_id END) AS reviewed_races, COUNT(*) FILTER (WHERE price % 5 = 0) AS reviewed_rows FROM rows_ GROUP BY ALL")
def a8_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.col("price") % 5 == 0
    return races(spark, sf_dir).groupBy("race_class").agg(F.countDistinct("race_id").alias("races"), F.countDistinct("player").alias("players"), F.countDistinct(F.when(review, F.col("race_id"))).alias("reviewed_races"), F.count_if(review).alias("reviewed_rows"))


@query(RACES + ", s AS (SELECT race_class, race_id, COUNT(*) AS n FROM rows_ GROUP BY ALL), c AS (SELECT race_class, n, COUNT(*) AS k FROM s GROUP BY ALL) SELECT race_class, STRING_AGG(n || ' players x ' || k, ', ' ORDER BY n DESC) AS histogram FROM c GROUP BY ALL")
def a11_histogram_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyforge.operators.votes import histogram_text

    return histogram_text(race_sizes(spark, sf_dir).withColumnRenamed("players", "n"), ["race_class"], "n", "players")


@query(RACES + ", e AS (SELECT race_class, race_id, LIST_SORT(LIST(points)) = LIST_SORT(LIST(price % 4)) AS same FROM rows_ GROUP BY ALL) SELECT race_class, race_id, position, CASE WHEN same THEN points ELSE price % 4 END AS shown FROM rows_ JOIN e USING (race_class, race_id)")
def a20_multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected totals of a race that are the expected ones in another order are replaced by them, row by row."""
    rows = races(spark, sf_dir).withColumn("seen", F.col("price") % 4)
    return S.same_multiset(rows, ["race_class", "race_id"], "seen", "points", "shown").select("race_class", "race_id", "position", "shown")


@query(RACES + ", d AS (SELECT race_class, race_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE price % 16 <> points) AS off FROM rows_ GROUP BY ALL) SELECT race_class, race_id, n, off, off >= GREATEST(4, CAST(FLOOR(n * 0.8) AS BIGINT)) AS candidate FROM d")
def a19_conditional_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, off = F.count("*"), F.count_if(F.col("price") % 16 != F.col("points"))
    out = races(spark, sf_dir).groupBy("race_class", "race_id").agg(n.alias("n"), off.alias("off"))
    return out.withColumn("candidate", F.col("off") >= F.greatest(F.lit(4), F.floor(F.col("n") * F.lit(0.8))))


@query(
    RACES
    + """, r AS (SELECT race_class, race_id, position, points, price % 18 AS implied FROM rows_), v AS (SELECT l_orderkey AS race_id, l_quantity::BIGINT % 16 AS points, COUNT(*) AS votes FROM lineitem GROUP BY ALL)
    SELECT r.race_class, r.race_id, r.position, CASE WHEN implied BETWEEN 1 AND 15 AND COALESCE(n.votes, 0) >= GREATEST(1, COALESCE(c.votes, 0)) THEN implied ELSE r.points END AS resolved
    FROM r LEFT JOIN v c ON c.race_id = r.race_id AND c.points = r.points LEFT JOIN v n ON n.race_id = r.race_id AND n.points = r.implied"""
)
def a22_total_delta_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that the totals imply, where they have as many votes as the current ones (here: quantities of the same race)."""
    from tallyforge.operators.votes import point_override

    rows = races(spark, sf_dir).select("race_class", "race_id", "position", "points", F.lit(0).cast("long").alias("old_total"), (F.col("price") % 18).alias("new_total"))
    votes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("race_id"), (F.col("l_quantity").cast("long") % 16).alias("points")).agg(F.count("*").alias("votes"))
    return point_override(rows, votes, ["race_id"]).select("race_class", "race_id", "position", "resolved")


@query(
    RACES
    + """, o AS (SELECT race_class, race_id, LIST(price % 3 ORDER BY position) AS p, LIST(price % 5 ORDER BY position) AS t, LEAST(6, COUNT(*)) AS n FROM rows_ GROUP BY ALL),
    x AS (SELECT *, LAG(p) OVER w AS pp, LAG(t) OVER w AS pt, LAG(n) OVER w AS pn, ROW_NUMBER() OVER w - 1 AS i FROM o WINDOW w AS (PARTITION BY race_class ORDER BY race_id)),
    e AS (SELECT race_class, i, LEAST(n, pn) AS k, UNNEST(RANGE(1, LEAST(n, pn) + 1)) AS r, p, t, pp, pt FROM x WHERE pn IS NOT NULL),
    c AS (SELECT race_class, i, k, COUNT(*) FILTER (WHERE t[r] <> pt[r]) AS totals, COUNT(*) FILTER (WHERE p[r] <> pp[r]) AS points, COUNT(*) FILTER (WHERE t[r] <> pt[r] OR p[r] <> pp[r]) AS changed FROM e GROUP BY ALL)
    SELECT race_class, MIN(i) AS index FROM c WHERE totals >= LEAST(2, k) AND (points >= 1 OR changed >= LEAST(3, k)) GROUP BY ALL"""
)
def w12_transition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first observation of a source whose rows begin to change; its races stand for observations."""
    from tallyforge.operators.sequences import first_transition

    of = lambda c, m: F.transform(F.array_sort(F.collect_list(F.struct("position", (F.col(c) % m).alias("v")))), lambda x: x["v"])
    seen = races(spark, sf_dir).groupBy("race_class", "race_id").agg(of("price", 3).alias("points"), of("price", 5).alias("totals"), F.count("*").alias("visible"))
    return first_transition(seen, ["race_class"], "race_id").select("race_class", "index")
