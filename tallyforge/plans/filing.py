"""Queries of the source and sink operators on table analogues, and of the composite pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.functions import text as T
from tallyforge.plans.registry import query
from tallyforge.plans.scoring import RACES, races
from tallyforge.sources import files
from tallyforge.sources.tables import table


@query("SELECT UNNEST(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name, TRUE AS filled")
def s1_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the data folder as a listing shows them; nothing is read."""
    listed = files.list_files(spark, sf_dir, recursive=True, suffixes=("parquet",))
    name = F.regexp_extract("path", r"/([a-z]+)\.parquet(?:/[^/]*)?$", 1)
    return listed.groupBy(name.alias("name")).agg((F.sum("length") > 0).alias("filled")).where("name <> ''")


@query(
    """WITH s AS (SELECT o_custkey AS input_order, COUNT(*) AS n_frames, o_custkey % 3 <> 0 AS parallel FROM orders GROUP BY o_custkey)
    SELECT input_order, ROUND(n_frames / 4.0, 6) AS length_s, ROW_NUMBER() OVER (ORDER BY parallel DESC, input_order) AS number FROM s"""
)
def s4_workflow_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("input_order")).agg(F.count("*").alias("n_frames"))
    plan = files.workflow_plan(o.select("input_order", "n_frames", F.lit(4).alias("fps"), (F.col("input_order") % 3 != 0).alias("parallel")))
    return plan.select("input_order", F.round("length_s", 6).alias("length_s"), "number")


@query(
    """WITH o AS (SELECT o_orderkey, 1000 + o_orderkey % 500 * 100 AS n FROM orders),
    f AS (SELECT o_orderkey, n, UNNEST(LIST_CONCAT(LIST_CONCAT(LIST_TRANSFORM(RANGE(10), lambda i: (n // 50) * i // 9), LIST_TRANSFORM(RANGE(40), lambda i: n // 50 + (n - 2 * (n // 50)) * i // 39)), LIST_TRANSFORM(RANGE(10), lambda i: n - n // 50 + (n // 50) * i // 9))) AS frame FROM o)
    SELECT o_orderkey, COUNT(DISTINCT frame) AS probes, MIN(frame) AS first, MAX(frame) AS last FROM f GROUP BY ALL"""
)
def s6_probe_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(1000) + F.col("o_orderkey") % 500 * 100).alias("n"))
    f = o.select("o_orderkey", files.probe_frames(F.lit(0), F.col("n")).alias("f"))
    return f.select("o_orderkey", F.size("f").cast("long").alias("probes"), F.element_at("f", 1).alias("first"), F.element_at("f", -1).alias("last"))


@query("SELECT 'v' || o_custkey AS video, o_orderkey % 1000 AS race, COUNT(*) AS items FROM orders GROUP BY ALL HAVING BOOL_OR(o_orderkey % 3 = 1)")
def s9_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of artefacts by video and race; races without a score bundle go."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, files.KINDS)), (k % 3 + 1).cast("int"))
    path = F.concat(F.lit("Frames/v"), F.col("o_custkey").cast("string"), F.lit("/Race_"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("/"), kind, F.lit("/f_"), k.cast("string"), F.lit(".png"))
    return files.bundles(table(spark, sf_dir, "orders").select(path.alias("path"))).select("video", F.col("race").cast("long").alias("race"), F.size("items").cast("long").alias("items"))


@query("SELECT 'v' || c_nationkey AS video, c_custkey AS race, CASE WHEN c_custkey % 4 = 0 THEN 'lan2_split_2p' ELSE 'full' END AS layout, CAST(c_custkey * 3 AS VARCHAR) AS actual_frame FROM customer WHERE c_custkey % 7 <> 0")
def s12_frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame metadata written as text and read again: rows without a usable race go, a blank layout is the default one."""
    k = F.col("c_custkey")
    folder = files.work_folder(spark, "metadata")
    race = F.when(k % 7 == 0, "none").otherwise(k.cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("video"), race.alias("race"), F.lit("2RaceScore").alias("kind"), k.alias("requested_frame"), (k * 3).alias("actual_frame"), F.lit(30).alias("fps"), F.lit("").alias("timecode"), F.when(k % 4 == 0, "").otherwise("full").alias("layout"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit("p").alias("path"))
    files.write_metadata(rows, folder)
    return files.read_metadata(spark, folder).select("video", F.col("race").cast("long").alias("race"), "layout", "actual_frame")


@query("SELECT c_custkey, c_name, ROUND(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer")
def s17_results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table as it comes back from its export."""
    folder = files.work_folder(spark, "results")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")
    files.write_results(rows, folder, "customers")
    return spark.read.schema(rows.schema).option("header", True).csv(f"{folder}/customers")


@query("SELECT event_type AS stage, COUNT(*) * 2 AS n, CAST(SUM(user_id) * 2 AS BIGINT) AS users FROM events GROUP BY ALL")
def s19_trace_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs append their events as JSON lines; counts of what is read again."""
    folder = files.work_folder(spark, "trace")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for _ in range(2):
        files.write_trace(rows, folder)
    return spark.read.schema(rows.schema).json(folder).groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("SELECT c_custkey, c_nationkey AS race_class, CASE WHEN c_nationkey % 5 = 2 AND c_custkey % 2 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer WHERE c_nationkey % 5 <> 2 OR c_custkey % 2 = 0 OR c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0)")
def s20_scoped_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the sources of the second write are replaced."""
    folder = files.work_folder(spark, "sources")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("race_class"), "c_name")
    files.overwrite_sources(c.repartition("race_class"), folder)
    files.overwrite_sources(c.where("race_class % 5 = 2 AND c_custkey % 2 = 0").withColumn("c_name", F.concat(F.lit("new "), "c_name")).repartition("race_class"), folder)
    return spark.read.parquet(folder).select("c_custkey", F.col("race_class").cast("int").alias("race_class"), "c_name")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 7 END AS frame FROM part")
def s10_frame_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    stem = F.when(k % 3 != 0, F.concat(F.lit("race_F"), (k * 7).cast("string"), F.lit("_1p"))).otherwise(F.lit("race"))
    return table(spark, sf_dir, "part").select("p_partkey", files.frame_number(stem).alias("frame"))


@query("WITH f AS (SELECT p_partkey // 4 AS stem, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'jpeg' END AS ext, p_partkey % 3 AS r FROM part) SELECT stem, MIN_BY(p_partkey || '.' || ext, (r, p_partkey || '.' || ext)) AS path FROM f GROUP BY ALL")
def s11_preferred_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.when(k % 3 == 0, "png").when(k % 3 == 1, "jpg").otherwise("jpeg")
    f = table(spark, sf_dir, "part").select(F.floor(k / 4).alias("stem"), F.concat(k.cast("string"), F.lit("."), ext).alias("path"))
    return files.preferred_variants(f, "stem")


@query("SELECT o.o_orderkey, MIN(l.l_linenumber) AS line FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' GROUP BY ALL")
def s13_metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of a kind per race, null where there is none."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "line")


@query("SELECT s_suppkey, s_name, COALESCE(n_name, '') AS cup FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def s15_catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog document (here made of the 25 nations) read as a dimension."""
    folder = files.work_folder(spark, "catalog")
    item = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("cup_index"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(item).alias("cups"))).alias("value")).write.text(folder)
    cups = files.read_catalog(spark, folder, "cups").select(F.col("id").alias("n_nationkey"), F.col("name").alias("n_name"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return s.join(cups, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("")).alias("cup"))


@query(
    """WITH f AS (SELECT l_orderkey AS race, MIN(l_partkey) AS a, MAX(l_partkey) AS b, MAX(CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS c FROM lineitem GROUP BY 1)
    SELECT race, a, b, c, b - a AS a_to_b, c - a AS a_to_c FROM f"""
)
def s18_frame_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors per race and their differences, null where an anchor is missing."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("race")).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.max(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))).alias("c"))
    return f.select("race", "a", "b", "c", (F.col("b") - F.col("a")).alias("a_to_b"), (F.col("c") - F.col("a")).alias("a_to_c"))


@query("SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'view') AS views, COUNT(*) FILTER (WHERE event_type = 'click') AS clicks, COUNT(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL")
def s21_artefact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("view").alias("views"), of("click").alias("clicks"), of("error").alias("errors"))


@query(
    """WITH b AS (SELECT p_partkey, p_name, p_partkey % 50 || '.50' AS size FROM part), n AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN p_name || 'x' ELSE ' ' || p_name END AS p_name, p_partkey % 50 || '.5' AS size FROM part)
    SELECT p_partkey, 'p_name' AS columns FROM b JOIN n USING (p_partkey) WHERE TRIM(b.p_name) <> TRIM(n.p_name)"""
)
def t1_baseline_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ from a baseline after cells are brought into one spelling."""
    from tallyforge.operators.matching import diff

    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    base = p.select("p_partkey", T.cell_text(F.col("p_name")).alias("p_name"), T.cell_text(F.concat((k % 50).cast("string"), F.lit(".50"))).alias("size"))
    name = F.when(k % 17 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.concat(F.lit(" "), "p_name"))
    new = p.select("p_partkey", T.cell_text(name).alias("p_name"), T.cell_text(F.concat((k % 50).cast("string"), F.lit(".5"))).alias("size"))
    return diff(base, new, ["p_partkey"], ["p_name", "size"]).where("state = 'changed'").select("p_partkey", "columns")


@query(RACES + "SELECT race_class, race_id, position, CAST(STRING_AGG(CAST(price % 10 AS VARCHAR), '' ORDER BY player, supplier) OVER (PARTITION BY race_class, race_id, position) AS BIGINT) AS number, price % 10 = 0 AS fallback FROM rows_")
def f19_number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits of a row joined to a number, with a flag where it lies outside its range."""
    d = F.col("price") % 10
    return races(spark, sf_dir).groupBy("race_class", "race_id", "position").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("player", "supplier", d.cast("string").alias("d")))), lambda x: x["d"])).cast("long").alias("number"), F.max(d).alias("top")).select("race_class", "race_id", "position", "number", (F.col("top") == 0).alias("fallback"))


@query()
def k3_finalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, duplicate chains, one-race outliers, session validation, numbered labels, scoring policy and standings, over all
    sources; tests hold the invariants of a results file against it."""
    from tallyforge.operators.finalisation import finalise

    rows = races(spark, sf_dir)
    name = F.concat(F.lit("player "), F.element_at(F.array(*map(F.lit, "anna bert cleo dora emil fritz gina hugo ines jana karl lena".split())), F.col("player").cast("int") + 1))
    seen = rows.select("race_class", "race_id", "position", "points", "players", name.alias("name"), (F.col("player") % 4).alias("character"), F.when(F.col("price") % 4 != 0, F.col("points")).alias("seen_total"), (F.col("price") % 100).cast("double").alias("confidence"))
    return finalise(seen)


@query()
def j4_best_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of races to columns by the largest sum of a score matrix; tests hold it against all permutations."""
    import numpy as np
    import pandas as pd

    from tallyforge.operators.matching import best_assignment

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        n = len(pdf)
        scores = np.array([[(int(p) >> 2 * j) % 13 for j in range(n)] for p in pdf["price"]], float)
        return pd.DataFrame({"race_id": pdf["race_id"], "position": pdf["position"], "column": best_assignment(scores)})

    return races(spark, sf_dir).select("race_id", "position", "price").groupBy("race_id").applyInPandas(run, "race_id long, position long, column long")


@query()
def o4_beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a race takes its own number or the template before it; tests hold a wide beam against all paths."""
    import pandas as pd

    from tallyforge.operators.matching import beam_ranks

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        path = beam_ranks([{t: float((int(p) >> t) % 17) for t in range(1, i + 1)} for i, p in enumerate(pdf["price"], 1)])
        return pd.DataFrame({"race_id": pdf["race_id"], "position": pdf["position"], "template": path})

    return races(spark, sf_dir).select("race_id", "position", "price").groupBy("race_id").applyInPandas(run, "race_id long, position long, template long")


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, CAST(l_discount * 100 AS BIGINT) * 5 AS b, l_partkey % 50 AS c FROM lineitem),
    w AS (SELECT i, j, 10 - i - j AS k FROM RANGE(0, 11) x(i), RANGE(0, 11) y(j) WHERE i + j <= 10),
    s AS (SELECT l_orderkey, i, j, k, ARG_MAX(l_linenumber, (i * a + j * b + k * c, -l_linenumber)) AS best, MIN(l_linenumber) AS truth FROM f, w GROUP BY ALL)
    SELECT i / 10.0 AS a, j / 10.0 AS b, k / 10.0 AS c, COUNT(*) FILTER (WHERE best = truth) AS correct FROM s GROUP BY ALL"""
)
def a27_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each weighting of three features finds an order's first line; the best one is the largest count."""
    from tallyforge.operators.votes import weight_grid

    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("a"), ((F.col("l_discount") * 100).cast("decimal(9,0)").cast("long") * 5).alias("b"), (F.col("l_partkey") % 50).alias("c"))
    return weight_grid(f, ["l_orderkey"], "l_linenumber", ["a", "b", "c"], 10)


@query("SELECT event_id, event_type, value FROM events WHERE event_id IN (SELECT MIN(event_id) FROM events GROUP BY user_id, event_type)")
def st10_ordered_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first result of each independent task: one aggregate instead of a semi join."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "value")).alias("x"))
    return e.select("x.event_id", "event_type", "x.value")


@query(RACES + "SELECT race_class, race_id, COUNT(*) AS n, CAST(SUM(CASE WHEN position = points THEN 1 ELSE 0 END) AS BIGINT) AS fitting FROM rows_ GROUP BY ALL HAVING COUNT(*) >= 2")
def k12_frame_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = races(spark, sf_dir).groupBy("race_class", "race_id").agg(F.count("*").alias("n"), F.count_if(F.col("position") == F.col("points")).alias("fitting"))
    return per.where("n >= 2")


@query("SELECT o_orderkey, o_orderdate, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS covered FROM orders")
def w14_look_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows around an anchor."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-3, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.count("*").over(w).alias("covered"))
