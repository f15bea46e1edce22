"""Queries of the text functions, on pages, customers, parts, conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.functions import text as T
from tallyforge.plans.registry import query
from tallyforge.sources.tables import table


@query("SELECT conv_id, turn, TRIM(REGEXP_REPLACE(COALESCE(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS collapsed FROM conversations")
def f1_collapse_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.collapse_space(F.col("text")).alias("collapsed"))


@query("SELECT conv_id, turn, TRIM(COALESCE(text, ''), ' `''\"´:;.,*') AS stripped FROM conversations")
def f2_strip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_edges(F.col("text")).alias("stripped"))


@query()
def f3_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unicode normalisation and case folding have no SQL twin; tests hold them against the standard library."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.name_key("text").alias("key"))


@query()
def f4_identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.identity_key("text").alias("key"))


@query("SELECT p_partkey, LENGTH(REPLACE(p_name, ' ', '')) AS shown, LEN(LIST_DISTINCT(STRING_SPLIT(REPLACE(p_name, ' ', ''), ''))) AS different FROM part")
def f5_visible_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.length(T.visible(c)).cast("long").alias("shown"), T.distinct_characters(c).alias("different"))


@query("SELECT doc_id, LENGTH(REGEXP_REPLACE(COALESCE(text, ''), '[^A-Za-z0-9 .!?&''_-]', '', 'g')) AS allowed, LENGTH(COALESCE(text, '')) AS total FROM documents")
def f6_alphabet_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace(c, "[^A-Za-z0-9 .!?&'_-]", "")).cast("long").alias("allowed"), F.length(c).cast("long").alias("total"))


@query("SELECT p_partkey, ROUND(JARO_WINKLER_SIMILARITY(p_name, p_type), 6) AS likeness, LEVENSHTEIN(p_name, p_type) AS edits FROM part")
def f7_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.jaro_winkler_similarity("p_name", "p_type"), 6).alias("likeness"), F.levenshtein("p_name", "p_type").cast("long").alias("edits"))


@query()
def f7_composite_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted similarity; its block ratio has no SQL twin, tests hold it against the standard library."""
    return table(spark, sf_dir, "part").select("p_partkey", T.name_similarity("p_name", "p_type").alias("likeness"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_partkey % 7 = 0 THEN 0.0 WHEN ABS(p_size - p_partkey % 50) <= 2 THEN 1.0 WHEN ABS(p_size - p_partkey % 50) <= 8 THEN 0.7
    WHEN ABS(p_size - p_partkey % 50) <= 20 THEN 0.3 ELSE -0.2 END::DOUBLE AS gap FROM part"""
)
def f8_feature_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(F.col("p_size") % 5 != 0, F.col("p_size")), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 50)
    return table(spark, sf_dir, "part").select("p_partkey", T.feature_gap(a, b).alias("gap"))


@query(
    """SELECT c_custkey, CASE WHEN REGEXP_MATCHES(t, '^[+-]?\\d+(\\.0+)?$') THEN CAST(REGEXP_EXTRACT(t, '^([+-]?\\d+)', 1) AS BIGINT) WHEN REGEXP_REPLACE(t, '\\D', '', 'g') <> '' THEN CAST(REGEXP_REPLACE(t, '\\D', '', 'g') AS BIGINT) END AS parsed
    FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN c_custkey || '.0' WHEN 2 THEN '-' || c_custkey WHEN 3 THEN ' +' || c_custkey || ' ' WHEN 4 THEN c_mktsegment ELSE '-' || c_custkey || 'x' END AS raw FROM customer), LATERAL (SELECT TRIM(raw) AS t)"""
)
def f10_lenient_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = k.cast("string")
    raw = F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, F.concat(s, F.lit(".0"))).when(k % 6 == 2, F.concat(F.lit("-"), s)).when(k % 6 == 3, F.concat(F.lit(" +"), s, F.lit(" "))).when(k % 6 == 4, F.col("c_mktsegment")).otherwise(F.concat(F.lit("-"), s, F.lit("x")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.lenient_int(raw).alias("parsed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE p_partkey || '.5' END AS cell FROM part")
def f11_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".000"))).otherwise(F.concat(k.cast("string"), F.lit(".5000")))
    return table(spark, sf_dir, "part").select("p_partkey", T.cell_text(raw).alias("cell"))


@query("SELECT event_id, event_type || ' | order' AS note FROM events")
def f13_append_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    once = T.append_once(F.col("event_type"), F.lit("order"))
    return e.select("event_id", T.append_once(once, F.lit("order")).alias("note"))


@query("SELECT conv_id, turn, CASE WHEN LENGTH(text) > 40 THEN RTRIM(SUBSTRING(text, 1, 37)) || '...' ELSE text END AS short FROM conversations")
def f12_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.shorten(F.col("text"), 40).alias("short"))


@query("SELECT o_orderkey, LPAD(CAST((o_orderkey * 37 // 30) // 3600 AS VARCHAR), 2, '0') || ':' || LPAD(CAST((o_orderkey * 37 // 30) // 60 % 60 AS VARCHAR), 2, '0') || ':' || LPAD(CAST((o_orderkey * 37 // 30) % 60 AS VARCHAR), 2, '0') AS code FROM orders")
def f14_timecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.timecode(F.col("o_orderkey") * 37, F.lit(30)).alias("code"))


@query("SELECT p_partkey, GREATEST(1, CAST(ROUND_EVEN(p_size * GREATEST(p_partkey % 61, 1) / 30.0, 0) AS BIGINT)) AS frames FROM part")
def f15_scaled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.scaled_frames(F.col("p_size"), F.col("p_partkey") % 61).alias("frames"))


@query(
    """WITH t AS (SELECT user_id, LIST(CAST(ROUND(value) AS BIGINT) ORDER BY event_id) AS a, LIST(CAST(ROUND(value * 3) AS BIGINT) % 100 ORDER BY event_id) AS b FROM events GROUP BY ALL)
    SELECT user_id, CAST(LEN(LIST_FILTER(RANGE(1, 7), lambda i: a[i] = b[i])) AS BIGINT) AS same, LEN(LIST_FILTER(RANGE(2, LEN(a[1:6]) + 1), lambda i: a[i] > a[i - 1])) = 0 AS falling FROM t"""
)
def f16_array_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal places among the first six of two arrays, and whether the first six never rise."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.round("value").cast("long").alias("a"), (F.round(F.col("value") * 3).cast("long") % 100).alias("b")))).alias("s"))
    first = e.select("user_id", F.transform(F.slice("s", 1, 6), lambda x: x["a"]).alias("a"), F.transform(F.slice("s", 1, 6), lambda x: x["b"]).alias("b"))
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x)).cast("long")
    pairs = F.zip_with(F.slice("a", 1, 5), F.slice("a", 2, 5), lambda x, y: F.coalesce(y, F.lit(0)) <= x)
    return first.select("user_id", same.alias("same"), F.forall(pairs, lambda x: x).alias("falling"))


@query("SELECT user_id, to_json({'type': event_type, 'n': COUNT(*)})::VARCHAR AS doc FROM events GROUP BY user_id, event_type")
def f23_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.to_json(F.struct(F.col("event_type").alias("type"), "n")).alias("doc"))


@query("SELECT page_id, COALESCE(NULLIF(TRIM(REGEXP_REPLACE(url, '[^A-Za-z0-9._ -]+', '_', 'g'), ' ._'), ''), 'unknown') AS label FROM pages")
def f24_safe_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_label(F.col("url")).alias("label"))


@query(
    """WITH p AS (SELECT page_id, REGEXP_REPLACE(REGEXP_REPLACE(url, '^[a-z]+://', ''), '\\.[^./]*$', '') AS path FROM pages)
    SELECT page_id, ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT(path, '/'), lambda x: COALESCE(NULLIF(TRIM(REGEXP_REPLACE(x, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'part')), '__') AS source FROM p"""
)
def s3_source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.source_key(F.regexp_replace("url", "^[a-z]+://", "")).alias("source"))


@query("SELECT c_custkey, c_acctbal < 0 OR c_custkey % 10 < 3 OR LEN(LIST_DISTINCT(STRING_SPLIT(c_mktsegment, ''))) < 8 AS unreliable FROM customer")
def p9_unreliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.col("c_acctbal") < 0) | (F.col("c_custkey") % 10 < 3) | (T.distinct_characters(F.col("c_mktsegment")) < 8)
    return table(spark, sf_dir, "customer").select("c_custkey", low.alias("unreliable"))


@query("SELECT s_suppkey, 1.5 * (LENGTH(s_name) > 5)::INT + 1 * (s_acctbal > 0)::INT + 1 * (s_nationkey < 12)::INT + CASE WHEN s_acctbal > 5000 THEN 0.5 ELSE 0.2 END AS presence FROM supplier")
def f20_presence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda c: c.cast("int")
    score = F.lit(1.5) * on(F.length("s_name") > 5) + on(F.col("s_acctbal") > 0) + on(F.col("s_nationkey") < 12) + F.when(F.col("s_acctbal") > 5000, 0.5).otherwise(0.2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", score.alias("presence"))


@query("WITH k AS (SELECT DISTINCT p_brand, LOWER(p_name) AS name, p_type FROM part) SELECT p_brand, name FROM k GROUP BY ALL HAVING COUNT(DISTINCT p_type) > 1")
def f21_distinct_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised keys that show more than one spelling within a group."""
    p = table(spark, sf_dir, "part").select("p_brand", F.lower("p_name").alias("name"), "p_type")
    return p.groupBy("p_brand", "name").agg(F.countDistinct("p_type").alias("n")).where("n > 1").drop("n")


#: An alphabet document as the library reads it: three strings of characters.
ALPHABET = '{"latin_extended": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "japanese": "", "special_symbols": ".-_!?&"}'


@query(
    """WITH c AS (SELECT conv_id, turn, REGEXP_REPLACE(text, '\\s', '', 'g') AS v FROM conversations)
    SELECT conv_id, turn, ROUND(CASE WHEN v = '' OR v IS NULL THEN 0 ELSE 100.0 * LENGTH(REGEXP_REPLACE(v, '[^a-zA-Z0-9.\\-_!?&]', '', 'g')) / LENGTH(v) END, 6) AS allowed,
    COALESCE(ARRAY_TO_STRING(LIST_REDUCE(LIST_CONCAT([[]::VARCHAR[]], LIST_TRANSFORM(STRING_SPLIT(REGEXP_REPLACE(v, '[a-zA-Z0-9.\\-_!?&]', '', 'g'), ''), lambda c: [c])), lambda a, x: CASE WHEN x[1] = '' OR LIST_CONTAINS(a, x[1]) THEN a ELSE LIST_APPEND(a, x[1]) END), ''), '') AS unknown FROM c"""
)
def f6_alphabet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the characters of an alphabet document, and those it lacks in their order."""
    allowed = T.alphabet(ALPHABET)
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.round(T.allowed_percent(F.col("text"), allowed), 6).alias("allowed"), T.unknown_characters(F.col("text"), allowed).alias("unknown"))


@query(
    """WITH n AS (SELECT p_partkey, p_size::DOUBLE AS c, REPLACE(p_name, ' ', '') AS v FROM part)
    SELECT p_partkey, c + 30 + 4 * LEAST(LENGTH(v), 10) + 3 * LEAST(LEN(LIST_DISTINCT(STRING_SPLIT(v, ''))), 8) + 1.5 * LENGTH(v) AS score FROM n"""
)
def f9_candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = T.candidate_score(F.col("p_name"), F.col("p_size").cast("double"), T.alphabet(ALPHABET))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))
