"""Queries of name votes, low-resolution links, chains, rescues and the remaining row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.operators import names as N
from tallyforge.plans.registry import query
from tallyforge.plans.scoring import RACES, races
from tallyforge.sources.tables import table


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as seen: the part's name, now and then with a letter lost or doubled."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    k = F.col("p_partkey")
    seen = F.when(k % 5 == 0, F.substring("p_name", 2, 100)).when(k % 7 == 0, F.concat("p_name", F.substring("p_name", -1, 1))).otherwise(F.col("p_name"))
    return p.select("p_brand", "p_partkey", seen.alias("name"), (F.col("p_size") * 2).cast("double").alias("weight"))


@query()
def a3_clustered_name_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spoken(spark, sf_dir).withColumn("group", F.pmod(F.col("p_partkey"), F.lit(200)))
    return N.name_votes(rows, ["p_brand", "group"], "name", "weight", "p_partkey")


@query(
    """WITH s AS (SELECT p_brand, TRIM(REGEXP_REPLACE(p_name, '\\s+', ' ', 'g')) AS name, SUM(GREATEST(1, p_size - 20)) AS w, MIN(p_partkey) AS o FROM part GROUP BY ALL)
    SELECT p_brand, MAX_BY(name, (w, -o)) AS name, ROUND(MAX(w) / SUM(w), 6) AS confidence FROM s GROUP BY ALL"""
)
def a4_exact_name_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), "p_size", "p_partkey")
    out = N.exact_vote(p, ["p_brand"], "name", (F.col("p_size") - 20).cast("double"), "p_partkey")
    return out.select("p_brand", "name", F.round("confidence", 6).alias("confidence"))


@query()
def a6_canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spoken(spark, sf_dir).withColumn("group", F.pmod(F.col("p_partkey"), F.lit(200)))
    return N.canonical_names(rows, ["p_brand", "group"], "name", "p_partkey")


@query(
    """WITH c AS (SELECT user_id, event_type, COUNT(*) AS n, SUM(CAST(ROUND(value) AS BIGINT)) AS c, SUM(event_id % 4) AS m FROM events GROUP BY ALL),
    g AS (SELECT user_id, CAST(SUM(n) AS BIGINT) AS n, MAX(n) AS b, SUM(c) AS c, SUM(m) AS m FROM c GROUP BY ALL)
    SELECT user_id, n, ((b < 0.6 * n)::INT + (c < 60 * n)::INT + (m < n)::INT) >= 2 OR n < 3 AS unstable FROM g"""
)
def a16_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.round("value").cast("long").alias("confidence"), (F.col("event_id") % 4).alias("margin"))
    return N.unstable_groups(rows, ["user_id"], "event_type").select("user_id", "n", "unstable")


@query(
    """WITH v AS (SELECT user_id, event_type AS name, COUNT(*) AS n, MIN(event_id) AS o FROM events GROUP BY ALL), p AS (SELECT user_id, CAST(ROUND(value) AS BIGINT) AS pts, COUNT(*) AS n, MIN(event_id) AS o FROM events GROUP BY ALL)
    SELECT user_id, MAX_BY(name, (v.n, -v.o)) AS name, (SELECT MAX_BY(pts, (p.n, -p.o)) FROM p WHERE p.user_id = v.user_id) AS points, ROUND(CAST(100 * MAX(v.n) AS DOUBLE) / SUM(v.n)) AS confidence FROM v GROUP BY user_id"""
)
def a24_consensus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name by votes, points by votes, and the share of the winning name, per observed row."""
    from tallyforge.operators.votes import weighted_vote

    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), F.round("value").cast("long").alias("points"), "event_id")
    names = weighted_vote(e, ["user_id"], "name", F.lit(1.0), "event_id")
    points = weighted_vote(e, ["user_id"], "points", F.lit(1.0), "event_id").drop("confidence")
    return names.join(points, "user_id").select("user_id", "name", "points", F.round(100 * F.col("confidence")).alias("confidence"))


@query()
def j8_merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as sources, names as identities: similar names without a size in common; tests hold it against a plain version."""
    from tallyforge.operators.matching import merge_fragments

    rows = _spoken(spark, sf_dir).withColumn("character", F.col("p_partkey") % 3)
    bad = F.avg((F.col("weight") < 60).cast("int"))
    ids = rows.groupBy(F.col("p_brand").alias("race_class"), "name").agg(F.min("p_partkey").alias("identity"), F.collect_set((F.col("p_partkey") % 40).cast("long")).alias("races"), F.count("*").alias("rows"), F.min("character").alias("character"), bad.alias("unreliable"))
    return merge_fragments(ids.withColumn("usual", F.lit(3).cast("long")))


NAMES = "anna bert cleo dora emil fritz gina hugo ines jana karl lena"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all races under names, as a low-resolution source shows them."""
    name = F.concat(F.lit("p"), F.element_at(F.array(*map(F.lit, NAMES.split())), F.col("player").cast("int") + 1))
    return races(spark, sf_dir).select("race_class", "race_id", "position", name.alias("name"), (F.col("supplier") % 4).alias("character"), "price", "points", "player")


@query()
def j15_low_resolution_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each race of a source is assigned to its placeholders as a whole."""
    return N.low_resolution_links(_named(spark, sf_dir).select("race_class", "race_id", "position", "name", "character")).select("race_class", "race_id", "position", "placeholder")


@query()
def j11_duplicate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of rows under one base label through all races of a source; tests hold it against all paths."""
    rows = _named(spark, sf_dir).select("race_class", F.lit(0).alias("base"), "race_id", "position", "character", (F.col("price") % 50).alias("old_total"), (F.col("price") % 50 + F.col("points")).alias("new_total"))
    return N.resolve_chains(rows).select("race_class", "base", "race_id", "position", "chain", "ambiguous")


@query()
def j16_placeholder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for placeholders from what was read beside them; tests hold it against hand-made evidence."""
    rows = _named(spark, sf_dir).select("race_class", "race_id", "position", F.concat(F.lit("Player_"), (F.col("player") + 1).cast("string")).alias("placeholder"), "name", (F.col("price") % 100 / 100).alias("score"))
    return N.resolve_placeholders(rows)


@query(
    RACES
    + """, c AS (SELECT race_class, player AS placeholder, supplier % 3 AS name, race_id, price % 300 AS score FROM rows_), f AS (SELECT race_class, placeholder, name, COUNT(DISTINCT race_id) AS races, CAST(SUM(score) AS BIGINT) AS total FROM c WHERE NOT (race_class % 3 = 0 AND name = 1) GROUP BY ALL),
    r AS (SELECT *, ROW_NUMBER() OVER w AS k, LEAD(total) OVER w AS second FROM f WINDOW w AS (PARTITION BY race_class, placeholder ORDER BY races DESC, total DESC, name DESC)),
    o AS (SELECT *, races >= 3 AND total >= 140 * races AND total - COALESCE(second, 0) >= 35 AS ok FROM r WHERE k = 1), g AS (SELECT *, NOT ok AND ((races >= 2 AND total >= 160 * races) OR total >= 190 * races) AS forced FROM o)
    SELECT race_class, placeholder, CASE WHEN ok OR forced THEN name END AS name, forced FROM g"""
)
def j17_placeholder_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = races(spark, sf_dir)
    c = rows.select("race_class", F.col("player").alias("placeholder"), (F.col("supplier") % 3).alias("name"), "race_id", (F.col("price") % 300).alias("score"))
    taken = rows.where("race_class % 3 = 0").select("race_class", F.lit(1).cast("long").alias("name")).distinct()
    return N.rescue_names(c, taken)


@query(
    RACES
    + """, b AS (SELECT race_class, race_id, position, player, price % 100 AS blob, price % 7 * 10 AS blob_second FROM rows_), l AS (SELECT race_class, race_id, COUNT(*) AS n, MAX_BY({'p': position, 'q': player, 'b': blob, 's': blob_second}, position) AS r FROM b GROUP BY ALL)
    SELECT race_class, race_id, position, player, FALSE AS restored FROM b UNION ALL SELECT race_class, race_id, r.p + 1, r.q, TRUE FROM l WHERE n = 4 AND r.b >= 58 AND r.b - r.s >= 10"""
)
def j18_restore_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races of four rows stand for those that lack one of five."""
    d = lambda c: c.cast("decimal(10,4)")
    rows = races(spark, sf_dir).select("race_class", "race_id", "position", "player", d(F.col("price") % 100 / 100).alias("blob"), d(F.col("price") % 7 / 10).alias("blob_second"))
    return N.restore_missing(rows, size=5).select("race_class", "race_id", "position", "player", "restored")


@query(
    RACES
    + """, e AS (SELECT race_class, race_id, position, price % 16 AS seen FROM rows_)
    SELECT e.race_class, e.race_id, e.position, CASE WHEN e.seen = 0 THEN 'missing' WHEN e.seen = r.points THEN 'exact' WHEN ABS(e.seen - r.points) <= 1 THEN 'near' WHEN e.seen > 15 THEN 'invalid' WHEN e.seen > r.points THEN 'high' ELSE 'low' END AS outcome
    FROM e JOIN rows_ r USING (race_class, race_id, position)"""
)
def j19_expected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = races(spark, sf_dir)
    seen = F.col("price") % 16
    outcome = F.when(seen == 0, "missing").when(seen == F.col("points"), "exact").when(F.abs(seen - F.col("points")) <= 1, "near").when(seen > 15, "invalid").when(seen > F.col("points"), "high").otherwise("low")
    return rows.select("race_class", "race_id", "position", outcome.alias("outcome"))


@query(
    """WITH m(mode) AS (VALUES (0), (1), (2)), t AS (SELECT o_custkey, mode, MAX((o_orderkey + mode * (o_orderkey % 5)) % 97) AS v FROM orders, m WHERE mode < 2 OR o_custkey % 9 <> 0 GROUP BY ALL)
    SELECT o_custkey, MAX(v) FILTER (WHERE mode = 0) AS base, MAX(v) FILTER (WHERE mode = 1) AS fast, MAX(v) FILTER (WHERE mode = 2) AS probe, COUNT(*) = 3 AND MIN(v) = MAX(v) AS agree FROM t GROUP BY ALL"""
)
def j20_three_way_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs by key side by side: one pass and one aggregate instead of two outer joins."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("mode")).where("mode < 2 OR o_custkey % 9 <> 0")
    v = o.groupBy("o_custkey", "mode").agg(F.max((k + F.col("mode") * (k % 5)) % 97).alias("v"))
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("v")))
    return v.groupBy("o_custkey").agg(of(0).alias("base"), of(1).alias("fast"), of(2).alias("probe"), ((F.count("*") == 3) & (F.min("v") == F.max("v"))).alias("agree"))


@query(RACES + "SELECT race_class, race_id, position, ROW_NUMBER() OVER (PARTITION BY race_class ORDER BY race_id, position) AS place FROM rows_")
def o1_stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable order of rows within their source, as a number: a table has no order of its own."""
    w = Window.partitionBy("race_class").orderBy("race_id", "position")
    return races(spark, sf_dir).select("race_class", "race_id", "position", F.row_number().over(w).cast("long").alias("place"))


@query(
    """WITH d AS (SELECT event_id, event_id % 128 AS mask FROM events), p(digit, need, k) AS (VALUES (8, 127, 1), (0, 119, 2), (6, 111, 3), (9, 123, 4), (2, 93, 5), (3, 91, 6), (5, 107, 7), (4, 58, 8), (7, 82, 9), (1, 18, 10))
    SELECT event_id, COALESCE(MIN_BY(digit, k), -1) AS digit FROM d LEFT JOIN p ON mask & need = need GROUP BY ALL"""
)
def f18_segment_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-segment digits: the first pattern whose segments are all lit (a bit each: top, left, right, middle, left, right, bottom)."""
    # fixed values: the order in which patterns are tried, and their segments
    patterns = ((8, 127), (0, 119), (6, 111), (9, 123), (2, 93), (3, 91), (5, 107), (4, 58), (7, 82), (1, 18))
    mask = F.col("event_id") % 128
    digit = F.coalesce(*[F.when(mask.bitwiseAND(need) == need, F.lit(d)) for d, need in patterns], F.lit(-1))
    return table(spark, sf_dir, "events").select("event_id", digit.alias("digit"))


@query(
    """WITH t AS (SELECT user_id, LIST(CAST(ROUND(value) AS BIGINT) ORDER BY event_id) AS v FROM events GROUP BY ALL), s AS (SELECT user_id, [v[1], v[3], v[6], v[LEN(v)]] AS g FROM t)
    SELECT user_id, CASE WHEN g[1] >= g[2] AND g[2] >= g[3] THEN ARRAY_TO_STRING(g, ',') END AS signature FROM s"""
)
def f17_stable_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 1, 3, 6 and the last as a signature, null unless the first three do not rise."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.round("value").cast("long").alias("v")))), lambda x: x["v"]).alias("v"))
    a, b, c = (F.get("v", F.lit(i)) for i in (0, 2, 5))
    return e.select("user_id", F.when((a >= b) & (b >= c), F.concat_ws(",", a, b, c, F.element_at("v", -1))).alias("signature"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 0.2 WHEN p_size < 30 THEN 0.4 ELSE 0.6 END::DOUBLE AS threshold FROM part")
def f22_threshold_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 10, 0.2).when(F.col("p_size") < 30, 0.4).otherwise(0.6).alias("threshold"))


@query(RACES + ", r AS (SELECT race_class, race_id, COUNT(*) AS rows, SUM(price % 100) AS strength FROM rows_ GROUP BY ALL), x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY race_class ORDER BY rows DESC, strength DESC, race_id) AS k FROM r) SELECT race_class, race_id, rows FROM x WHERE k = 1")
def w16_row_count_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame with most rows, the stronger one of equals."""
    per = races(spark, sf_dir).groupBy("race_class", "race_id").agg(F.count("*").alias("rows"), F.sum(F.col("price") % 100).alias("strength"))
    return per.groupBy("race_class").agg(F.max(F.struct("rows", "strength", (-F.col("race_id")).alias("r"))).alias("x")).select("race_class", (-F.col("x.r")).alias("race_id"), F.col("x.rows").alias("rows"))


@query(RACES + "SELECT race_class, supplier AS FixName, race_id AS Race, position AS Position, points AS Points, CASE WHEN LENGTH(flag || ' order') > 5 THEN RTRIM(SUBSTRING(flag || ' order', 1, 2)) || '...' END AS Note FROM rows_")
def p1_user_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the user's table under their display names, with notes cut to their width."""
    from tallyforge.functions.text import shorten

    note = shorten(F.concat("flag", F.lit(" order")), 5)
    return races(spark, sf_dir).select("race_class", F.col("supplier").alias("FixName"), F.col("race_id").alias("Race"), F.col("position").alias("Position"), F.col("points").alias("Points"), note.alias("Note"))


@query(RACES + "SELECT race_class, race_id, position, '' AS comment, '' AS layout, flag FROM rows_")
def p2_debug_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide projection in which absent columns are made as empty text."""
    rows = races(spark, sf_dir)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in ("race_class", "race_id", "position", "comment", "layout", "flag")])


@query("SELECT conv_id, MIN(LENGTH(text)) >= 20 AND AVG(LENGTH(text)) >= 40 AND COUNT(*) >= 2 AS is_static FROM conversations GROUP BY ALL")
def p13_static_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.length("text")).alias("lo"), F.avg(F.length("text")).alias("mid"), F.count("*").alias("n"))
    return c.select("conv_id", ((F.col("lo") >= 20) & (F.col("mid") >= 40) & (F.col("n") >= 2)).alias("is_static"))


@query("SELECT c_custkey, COALESCE(CASE WHEN c_acctbal IS NOT NULL AND c_acctbal <= 479 THEN TRUE END, FALSE) AS is_low FROM customer")
def p5_low_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.col("c_acctbal") <= 479, F.lit(False)).alias("is_low"))


@query("SELECT event_id FROM events WHERE GREATEST(value, value * (event_id % 3), event_id % 50) <= 40")
def p12_ignored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose best ignore template stays below the threshold."""
    best = F.greatest("value", F.col("value") * (F.col("event_id") % 3), F.col("event_id") % 50)
    return table(spark, sf_dir, "events").where(best <= 40).select("event_id")
