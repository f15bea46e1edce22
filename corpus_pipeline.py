"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs:

1. toxicity: documents whose score is at least 0.5 go.
2. language: documents without a letter go, those whose language stays in doubt (posterior below 0.5), and those that the likeliest
   language explains no better than chance (more bits a symbol than equally likely symbols take), such as texts in other scripts.
   Where no language could be learned, every document with a letter stays.
3. near_duplicates: of each group linked on shingles of five words at a similarity of 0.8, the document with the smallest id stays.
4. secrets: secrets inside texts are replaced; every document stays, and n_chars follows the new text.
5. packing: documents become pieces in sequences of at most 2048 ids.

A row with a null doc_id passes every filter it can be judged by. Rows repeated under one doc_id are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm import langid, neardup, packing, secrets, toxicity
from tallyforge.llm.common import DOCUMENT_COLUMNS, documents_only, durable, held_out
from tallyforge.llm.tokens import tokenizer_path

#: The stages cannot be said in SQL: they score texts with trained models. They are tested against brute-force versions.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~held_out(labels.doc_id)))
    found = toxicity.score(documents_only(docs), model, keep=DOCUMENT_COLUMNS)
    return documents_only(found.where("predicted = 0"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~held_out(docs.doc_id)))
    if model is None:
        return documents_only(docs.where(docs.text.rlike(r"\p{L}")))
    found = langid.identify(documents_only(docs), model, keep=DOCUMENT_COLUMNS)
    return documents_only(found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5) & (F.col("bits_per_symbol") <= langid.CHANCE)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return documents_only(docs).join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(documents_only(docs), secrets.default_forest())
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; each one's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
