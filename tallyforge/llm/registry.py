"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm import langid, neardup, packing, pieces, pii, secrets, shards, toxicity, vectors
from tallyforge.llm.common import held_out
from tallyforge.llm.tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(read(spark, sf_dir, "documents")))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(docs.doc_id)))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out(found.doc_id).alias("held_out"), "lang_pred", "score", "bits_per_symbol")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(labels.doc_id)))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out(found.doc_id).alias("held_out"), "score", "predicted", "offending")


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op4_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return vectors.nearest_neighbours(table, table.where("vec_id % 50 = 0"))


@query
def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return shards.write_training_order(docs, tokenizer_path(), shards.shard_folder(spark))


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document: scores, numbers of ids and their crc32, best first."""
    return pieces.segment(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), n=3, with_ids=False)


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"), secrets.default_forest())
    hits = F.filter("findings", lambda f: f["secret"])
    place = F.transform(hits, lambda f: F.concat_ws(":", f["start"].cast("string"), f["end"].cast("string")))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(hits).cast("long").alias("n_secrets"), F.concat_ws(",", place).alias("spans"))
