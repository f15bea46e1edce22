"""Queries of votes, summaries, top-k and set operations, on events, conversations, line items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.operators import votes as V
from tallyforge.plans.registry import query
from tallyforge.sources.tables import table


@query(
    """WITH s AS (SELECT user_id, event_type, SUM(GREATEST(0, ROUND(value * 100) - 500)) AS w, MIN(event_id) AS o FROM events GROUP BY ALL),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY w DESC, o) AS k, SUM(w) OVER (PARTITION BY user_id) AS t FROM s)
    SELECT user_id, event_type, ROUND(w / t, 6) AS confidence FROM r WHERE k = 1"""
)
def a1_weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.weighted_vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.round(F.col("value") * 100) - 500, "event_id")
    return out.select("user_id", "event_type", F.round("confidence", 6).alias("confidence"))


@query(
    """WITH e AS (SELECT *, event_id % 4 AS src, ROUND(value * 100) AS v FROM events),
    s AS (SELECT user_id, event_type, SUM(v) AS w, MIN(event_id) AS o FROM e GROUP BY ALL),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY w DESC, o) AS k FROM s),
    f AS (SELECT user_id, event_type, CASE src WHEN 0 THEN 'default' ELSE CAST(src AS VARCHAR) END AS source, SUM(v) AS w, MIN(event_id) AS o FROM e GROUP BY ALL),
    g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY w DESC, o) AS k FROM f)
    SELECT r.user_id, r.event_type, g.source FROM r JOIN g ON r.user_id = g.user_id AND r.event_type = g.event_type WHERE r.k = 1 AND g.k = 1"""
)
def a2_vote_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("src", F.when(F.col("event_id") % 4 == 0, "").otherwise((F.col("event_id") % 4).cast("string")))
    return V.weighted_vote(rows, ["user_id"], "event_type", F.round(F.col("value") * 100), "event_id", "src").select("user_id", "event_type", "source")


@query("SELECT event_type, ROUND(SUM(value * GREATEST(0, event_id % 7 - 2)) / NULLIF(SUM(GREATEST(0, event_id % 7 - 2)), 0), 4) AS mean FROM events GROUP BY ALL")
def a5_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(V.weighted_mean(F.col("value"), (F.col("event_id") % 7 - 2).cast("double")), 4).alias("mean"))


@query(
    """WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, MIN_BY(event_type, (-n, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_type)) AS event_type FROM c GROUP BY ALL"""
)
def a12_plurality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    return V.plurality(rows, ["user_id"], "event_type", F.col("event_type") == "view")


@query("SELECT user_id, CAST(FLOOR(MEDIAN(ROUND(value * 100))) AS BIGINT) AS median FROM events GROUP BY ALL")
def a13_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.median(F.round(F.col("value") * 100))).alias("median"))


@query(
    """WITH d AS (SELECT event_type, EPOCH_US(ts) - EPOCH_US(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events)
    SELECT event_type, COUNT(d) AS n, MIN(d) AS least, ROUND(QUANTILE_CONT(d, 0.5)) AS p50, ROUND(QUANTILE_CONT(d, 0.9)) AS p90, ROUND(QUANTILE_CONT(d, 0.95)) AS p95, ROUND(QUANTILE_CONT(d, 0.99)) AS p99, MAX(d) AS largest, ROUND(AVG(d)) AS mean FROM d WHERE d IS NOT NULL GROUP BY ALL"""
)
def a14_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    deltas = table(spark, sf_dir, "events").select("event_type", (at - F.lag(at).over(w)).alias("d")).where("d IS NOT NULL")
    out = V.percentile_summary(deltas, ["event_type"], "d")
    return out.select("event_type", "n", "least", *(F.round(c).alias(c) for c in ("p50", "p90", "p95", "p99")), "largest", F.round("mean").alias("mean"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS calls, ROUND(SUM(l_quantity), 2) AS total, ROUND(AVG(l_quantity), 4) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), (l_returnflag))")
def a15_multi_level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linestatus")], [F.col("l_returnflag")]]
    return li.groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count("*").alias("calls"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query(
    """WITH c AS (SELECT user_id, event_type, COUNT(*) AS n, SUM(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS m FROM events GROUP BY ALL)
    SELECT user_id, CAST(SUM(n) AS BIGINT) AS n, CASE WHEN SUM(n) >= 3 AND MAX(n) >= 0.25 * SUM(n) AND SUM(m) >= 0.3 * SUM(n) THEN MIN_BY(event_type, (-n, event_type)) END AS winner FROM c GROUP BY ALL"""
)
def a17_dominant_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("value") > 20).cast("int").alias("margin"))
    return V.dominant_variant(rows, ["user_id"], "event_type", "margin", share=0.25, mean_margin=0.3)


@query(
    """WITH s AS (SELECT user_id, event_type, COUNT(*) AS samples, ROUND(SUM(value), 2) AS confidence, SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS wins FROM events GROUP BY ALL)
    SELECT user_id, event_type, samples, confidence, CAST(wins AS BIGINT) AS wins FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY samples DESC, event_type) <= 8"""
)
def a18_prior_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("samples"), F.round(F.sum("value"), 2).alias("confidence"), F.count_if(F.col("value") > 50).alias("wins"))
    return V.top_k(sums, ["user_id"], "samples", "event_type", 8).drop("place")


@query("SELECT conv_id, COUNT(*) AS n, MIN(LENGTH(text)) AS least, ROUND(AVG(LENGTH(text)), 4) AS mean, MAX(LENGTH(text)) AS largest, CAST(COUNT(*) FILTER (WHERE role = 'user') AS BIGINT) AS users FROM conversations GROUP BY ALL")
def a23_similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count, least, mean and largest of a measure per group, with a conditional count."""
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.min(size).alias("least"), F.round(F.avg(size), 4).alias("mean"), F.max(size).alias("largest"), F.count_if(F.col("role") == "user").alias("users"))


@query(
    """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS query_id, e.label, ROUND(LIST_DOT_PRODUCT(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS c, e.vec_id FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS k FROM s)
    SELECT query_id, ROUND(MAX(c) FILTER (WHERE k = 1), 6) AS best, ROUND(MAX(c) FILTER (WHERE k = 1) - MAX(c) FILTER (WHERE k = 2), 6) AS margin, ROUND(MAX(c) FILTER (WHERE k = 1) - MAX(c) FILTER (WHERE k = 5), 6) AS spread, COUNT(DISTINCT label) AS families FROM r WHERE k <= 5 GROUP BY ALL"""
)
def o5_margin_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score, its lead over the second and the fifth, and the families among the top five templates.

    A stated query set meets all rows in blocks: rows are dealt to 64 blocks and every query goes to each of them."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, x: t + x)
    e = e.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int"))
    q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(63))))
    scored = q.join(e, "block").where("query_id <> vec_id").select("query_id", "vec_id", "label", F.round(dot, 9).alias("c"))
    top = V.top_k(scored, ["query_id"], "c", "vec_id", 5)
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("c")))
    return top.groupBy("query_id").agg(F.round(at(1), 6).alias("best"), F.round(at(1) - at(2), 6).alias("margin"), F.round(at(1) - at(5), 6).alias("spread"), F.countDistinct("label").alias("families"))


@query("SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events QUALIFY place <= 2")
def o2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 2)


@query(
    """WITH pre AS (SELECT user_id, event_id, value, ROUND(value) AS cheap FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ROUND(value) DESC, event_id) <= 8)
    SELECT user_id, event_id, value FROM pre QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value * (1 + event_id % 3) DESC, event_id) <= 2"""
)
def o3_prefilter_then_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap score keeps eight candidates, the exact score is computed for those only."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    cheap = V.top_k(rows.withColumn("cheap", F.round("value")), ["user_id"], "cheap", "event_id", 8).drop("place")
    exact = cheap.withColumn("exact", F.col("value") * (1 + F.col("event_id") % 3))
    return V.top_k(exact, ["user_id"], "exact", "event_id", 2).select("user_id", "event_id", "value")


@query(
    """WITH t AS (SELECT user_id, COUNT(*) AS n FROM events GROUP BY ALL), c AS (SELECT user_id, n, SUM(n) OVER (ORDER BY user_id) AS upto, SUM(n) OVER () AS total FROM t)
    SELECT user_id, n, CAST((upto - n) * 4 // total AS BIGINT) AS chunk FROM c"""
)
def o6_contiguous_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shares of nearly equal cost, from one row per group; prefix sums by range partitions, not in one task."""
    cost = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    from tallyforge.operators.prefix import prefix_sums

    summed = prefix_sums(cost, "user_id", "n")
    return summed.select("user_id", "n", F.floor((F.col("upto") - F.col("n")) * 4 / F.col("total")).alias("chunk"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'")
def u2_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def u2_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    return o.where(early).select("o_custkey").subtract(o.where(~early).select("o_custkey"))


@query("SELECT event_id, user_id FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, user_id FROM events WHERE user_id % 3 = 0")
def u1_concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return e.where("user_id % 2 = 0").unionByName(e.where("user_id % 3 = 0"))


@query("WITH t AS (SELECT conv_id, role, MIN(turn) AS o FROM conversations GROUP BY ALL) SELECT conv_id, STRING_AGG(role, ';' ORDER BY o) AS roles FROM t GROUP BY ALL")
def u3_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("o"))
    return t.groupBy("conv_id").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("o", "role"))), lambda x: x["role"])).alias("roles"))


@query(
    """WITH a AS (SELECT user_id, event_id % 100 AS c, MIN(event_id) AS o FROM events WHERE event_id % 100 NOT IN (79, 80, 81) GROUP BY ALL),
    t AS (SELECT * FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY o) <= 8)
    SELECT user_id, STRING_AGG(CAST(c AS VARCHAR), ';' ORDER BY o) AS kept FROM t GROUP BY ALL"""
)
def u4_capped_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct candidates in order, without three that are never kept (the cap is the operator)."""
    firsts = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 100).alias("c"), "event_id").where("c NOT IN (79, 80, 81)").groupBy("user_id", "c").agg((-F.min("event_id")).alias("o"))
    top = V.top_k(firsts, ["user_id"], "o", "c", 8)
    return top.groupBy("user_id").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"].cast("string"))).alias("kept"))
