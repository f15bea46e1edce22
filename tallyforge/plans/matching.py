"""Queries of the matching operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.functions.text import jaro_winkler
from tallyforge.operators import matching as M
from tallyforge.plans.registry import query
from tallyforge.plans.scoring import RACES, races
from tallyforge.sources.tables import table


@query(
    """SELECT e.event_id, MIN(p.ts) AS next_ts, CAST((SELECT COUNT(*) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'purchase' AND b.ts < e.ts) + 1 AS BIGINT) AS number
    FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts >= e.ts WHERE e.event_type = 'error' GROUP BY e.event_id, e.user_id, e.ts"""
)
def j7_forward_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = M.next_event(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'purchase'"), "user_id", "ts", "next_ts")
    return out.select("event_id", "next_ts", F.col("next_ts_number").alias("number"))


@query(
    """WITH n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 15 = 3 THEN 'none' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0),
    b AS (SELECT * FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT COALESCE(b.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN b.o_orderstatus <> n.o_orderstatus OR b.o_orderpriority <> n.o_orderpriority THEN 'changed' ELSE 'same' END AS state,
    CASE WHEN b.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN '' ELSE CONCAT_WS(';', CASE WHEN b.o_orderstatus <> n.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN b.o_orderpriority <> n.o_orderpriority THEN 'o_orderpriority' END) END AS columns
    FROM b FULL JOIN n ON b.o_orderkey = n.o_orderkey"""
)
def j12_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    new = o.where(k % 11 != 0).withColumn("o_orderstatus", F.when(k % 10 == 3, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(k % 15 == 3, "none").otherwise(F.col("o_orderpriority")))
    return M.diff(o.where(k % 13 != 0), new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(
    """SELECT c_custkey, COALESCE(o.n, 0) AS orders, COALESCE(l.n, 0) AS lines, CASE WHEN o.n IS NULL THEN 'none' WHEN COALESCE(l.n, 0) > 50 THEN 'many' ELSE 'some' END AS class FROM customer
    LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey"""
)
def j13_left_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    # the two facts meet in one aggregate per customer, so the customers are joined once
    per = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("o"), F.sum("k").alias("l"))
    j = c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    lines = F.coalesce("l", F.lit(0))
    return j.select("c_custkey", F.coalesce("o", F.lit(0)).alias("orders"), lines.alias("lines"), F.when(F.col("o").isNull(), "none").when(lines > 50, "many").otherwise("some").alias("class"))


@query(
    """WITH a AS (SELECT p_partkey, md5(p_name || p_brand) AS d FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, md5(p_name || CASE WHEN p_partkey % 9 = 1 THEN 'z' ELSE p_brand END) AS d FROM part WHERE p_partkey % 8 <> 0)
    SELECT COALESCE(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'unexpected' ELSE 'mismatched' END AS state FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.d IS DISTINCT FROM b.d"""
)
def j14_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    k = F.col("p_partkey")
    a = p.where(k % 7 != 0).withColumn("d", F.md5(F.concat("p_name", "p_brand")))
    b = p.where(k % 8 != 0).withColumn("d", F.md5(F.concat("p_name", F.when(k % 9 == 1, "z").otherwise(F.col("p_brand")))))
    return M.set_diff(a, b, "p_partkey", "d")


@query(
    """WITH t(id, name) AS (VALUES (0, 'small ring'), (1, 'red widget'), (2, 'large gear'), (3, 'blue bolt'), (4, 'green plate'), (5, 'steel ring')),
    s AS (SELECT p_partkey, id, JARO_WINKLER_SIMILARITY(p_name, name) AS s FROM part, t)
    SELECT p_partkey, CAST(MIN_BY(id, (-s, id)) AS BIGINT) AS match_id, ROUND(MAX(s), 6) AS match_score FROM s GROUP BY ALL"""
)
def j5_nearest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["small ring", "red widget", "large gear", "blue bolt", "green plate", "steel ring"]
    out = M.nearest_name(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", list(enumerate(names)), jaro_winkler)
    return out.select("p_partkey", "match_id", F.round("match_score", 6).alias("match_score"))


@query()
def j6_roster_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand the roster name that its parts' names speak for; the block ratio has no SQL twin."""
    import pandas as pd

    roster = ["small ring", "red widget", "large gear", "blue bolt"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, share = M.roster_consensus(list(zip(pdf["p_name"], pdf["w"])), roster)
        return pd.DataFrame({"p_brand": [pdf["p_brand"].iloc[0]], "name": [name], "share": [share]})

    names = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").cast("double").alias("w"))  # names repeat: summed first
    return names.groupBy("p_brand").applyInPandas(run, "p_brand string, name string, share double")


def _screens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = races(spark, sf_dir)
    name = F.concat(F.lit("player "), F.element_at(F.array(*map(F.lit, "anna bert cleo dora emil fritz gina hugo ines jana karl lena".split())), F.col("player").cast("int") + 1))
    race = rows.select("race_class", "race_id", "position", name.alias("name"), (F.col("price") % 50 + 50).cast("double").alias("confidence"), (F.col("supplier") % 4).alias("character"), (F.col("price") % 30).alias("old_total"), "points")
    total = race.select("race_class", "race_id", (F.col("old_total") + 1 + F.col("position") * 100).alias("position"), "name", "confidence", "character", (F.col("old_total") + F.col("points")).alias("total"))
    return total, race


@query()
def j1_match_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one pairs of two screens; tests check them against an independent version."""
    total, race = _screens(spark, sf_dir)
    return M.match_screens(total, race, ["race_class", "race_id"])


@query()
def j2_link_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities race by race; tests hold the scores and the rules of admission against hand-made races."""
    _, race = _screens(spark, sf_dir)
    old = F.col("old_total").cast("double")
    rows = race.select("race_class", "race_id", "position", "name", "character", old.alias("old_total"), (old + F.col("points")).alias("new_total"), M.unreliable_names(F.col("confidence") + 20, F.lit(None).cast("double"), F.lit("")).alias("unreliable"))
    return M.link_identities(rows).select("race_class", "race_id", "position", "identity")


@query()
def j3_greedy_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of an order's lines and its days, accepted from the best down, each side once."""
    import pandas as pd

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 5).alias("a"), (F.col("l_suppkey") % 5).alias("b"), F.col("l_quantity").cast("long").alias("score")).distinct()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = M.greedy_pairs(list(zip(pdf["score"], pdf["a"], pdf["b"])))
        return pd.DataFrame([(*key, a, b, s) for s, a, b in got], columns=["l_orderkey", "a", "b", "score"])

    return rows.groupBy("l_orderkey").applyInPandas(run, "l_orderkey long, a long, b long, score long")


@query(
    RACES
    + """, x AS (SELECT race_class, DENSE_RANK() OVER (PARTITION BY race_class ORDER BY race_id) AS i, position, player AS label, price % 2 = 0 AS bad, supplier % 4 AS ch FROM rows_),
    once AS (SELECT race_class, label, MIN(i) AS i, MIN(position) AS position, BOOL_AND(bad) AS bad, MIN(ch) AS ch FROM x GROUP BY race_class, label HAVING COUNT(*) = 1), s AS (SELECT DISTINCT race_class, i, label FROM x),
    gap AS (SELECT p.race_class, p.i + 1 AS i, MIN(p.label) AS other FROM s p JOIN s n ON n.race_class = p.race_class AND n.i = p.i + 2 AND n.label = p.label
      WHERE NOT EXISTS (SELECT 1 FROM s h WHERE h.race_class = p.race_class AND h.i = p.i + 1 AND h.label = p.label) GROUP BY p.race_class, p.i HAVING COUNT(*) = 1),
    c AS (SELECT race_class, label, ch, COUNT(*) AS k, MIN(i * 100000 + position) AS f FROM x GROUP BY ALL), u AS (SELECT race_class, label AS other, MIN_BY(ch, (-k, f)) AS usual FROM c GROUP BY ALL)
    SELECT race_class, MIN_BY(label, position) AS label, i AS race_index, other AS "to" FROM once JOIN gap USING (race_class, i) JOIN u USING (race_class, other) WHERE bad AND usual = ch GROUP BY race_class, i, other"""
)
def j10_single_race_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.dense_rank().over(Window.partitionBy("race_class").orderBy("race_id")).cast("long")
    rows = races(spark, sf_dir).select("race_class", index.alias("race_index"), "position", F.col("player").alias("label"), (F.col("price") % 2 == 0).alias("unreliable"), (F.col("supplier") % 4).alias("character"))
    return M.single_race_outliers(rows)


@query(
    RACES
    + """, x AS (SELECT race_class, player AS label, DENSE_RANK() OVER (PARTITION BY race_class ORDER BY race_id) AS i FROM rows_), z AS (SELECT race_class, i, COUNT(*) AS n FROM x GROUP BY ALL), y AS (SELECT race_class, n, COUNT(*) AS k FROM z GROUP BY ALL), u AS (SELECT race_class, MIN_BY(n, (-k, n)) AS usual FROM y GROUP BY ALL),
    e AS (SELECT race_class, label, MIN(i) AS first, MAX(i) AS last FROM x GROUP BY ALL), big AS (SELECT race_class FROM e JOIN u USING (race_class) GROUP BY race_class HAVING COUNT(*) > MAX(usual)),
    gone AS (SELECT race_class, MIN(label) AS old FROM e WHERE last < 4 GROUP BY 1 HAVING COUNT(*) = 1 AND MAX(last) = 3), came AS (SELECT race_class, MIN(label) AS new FROM e WHERE first >= 4 GROUP BY 1 HAVING COUNT(*) = 1 AND MIN(first) = 4)
    SELECT race_class, old, new FROM gone JOIN came USING (race_class) JOIN big USING (race_class)"""
)
def j9_relink_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth race of each source stands for a reset. Names are unlike and characters unknown, so that elimination decides;
    tests hold pairs by names and characters against hand-made sources."""
    index = F.dense_rank().over(Window.partitionBy("race_class").orderBy("race_id")).cast("long")
    rows = races(spark, sf_dir).select("race_class", index.alias("race_id"), "position", F.col("player").alias("label"), F.md5(F.col("player").cast("string")).alias("name"), F.lit(None).cast("long").alias("character"))
    return M.relink_after_reset(rows.withColumn("reset", F.col("race_id") == 4))


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_suppkey BETWEEN p_partkey - 2 AND p_partkey + 2")
def s14_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames within a window around an anchor: both sides meet on buckets of the window's width, then the range is checked."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_suppkey") / 5).alias("bucket"))
    near = p.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("p_partkey") - 2) / 5), F.floor((F.col("p_partkey") + 2) / 5))))
    return near.join(s, "bucket").where("s_suppkey BETWEEN p_partkey - 2 AND p_partkey + 2").select("p_partkey", "s_suppkey")


@query("SELECT c_custkey, COALESCE(n_name, '') AS name, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey")
def p8_dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", F.coalesce("n_name", F.lit("")).alias("name"), F.col("r_name").alias("region"))


@query("SELECT c_custkey, CASE WHEN n_name IN ('NATION_3', 'NATION_4') THEN 99 WHEN n_name IS NULL OR n_name = '' THEN NULL ELSE n_nationkey END AS roster, COALESCE(n_name, '') AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def p7_enrich_with_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = c.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    roster = F.when(F.col("n_name").isin("NATION_3", "NATION_4"), 99).when(F.coalesce("n_name", F.lit("")) == "", None).otherwise(F.col("n_nationkey"))
    return j.select("c_custkey", roster.alias("roster"), F.coalesce("n_name", F.lit("")).alias("name"))


@query(
    """WITH files AS (SELECT page_id, url, REGEXP_EXTRACT(url, '//([^/]+)', 1) AS host, REGEXP_EXTRACT(url, '[^/]*$') AS name FROM pages),
    req(r, ask) AS (VALUES (1, '825?page=2&ref=x'), (2, '25#top'), (3, 'ththre.example.com'), (4, 'absent')),
    hit AS (SELECT r, page_id, CASE WHEN name = ask THEN 1 WHEN host = ask THEN 2 END AS p FROM files JOIN req ON name = ask OR host = ask),
    best AS (SELECT *, MIN(p) OVER (PARTITION BY r) AS b FROM hit)
    SELECT page_id, MIN(r) AS request FROM best WHERE p = b GROUP BY ALL"""
)
def s2_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request the best kind of match wins; files that several requests name are kept once, at the first."""
    from tallyforge.sources.files import select_files

    files = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), F.regexp_extract("url", "[^/]*$", 0).alias("name"))
    req = spark.createDataFrame([(1, "825?page=2&ref=x"), (2, "25#top"), (3, "ththre.example.com"), (4, "absent")], "request int, ask string")
    return select_files(files, req, ["name", "host"], "page_id")
