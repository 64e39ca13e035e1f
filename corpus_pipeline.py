"""From raw documents to token files: the stages of the corpus, in order.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a
DataFrame; its result is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. Null, empty and repeated rows, empty tables and further columns are
treated as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotline.llm import decontamination, mixing, near_duplicates, quality_rules, token_files
from lotline.llm.common import new_folder, written
from lotline.llm.queries import tokenizer_path

ORACLE_SQL = None  # expectation-maximisation, sampling and the tokenizer are beyond SQL; see tests/llm/test_pipeline.py


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and are more likely good than bad."""
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a text that a quota ends in is cut, and n_chars with it."""
    mixed = mixing.mix(docs)
    rows = mixed.select("is_cut", "row.*")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("is_cut"), F.length("text").cast(docs.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is in them: doc_id, start, n_tokens, ids_crc32."""
    folder = new_folder(spark, "token-files")
    token_files.write_ids(docs, folder, tokenizer_path())
    return token_files.read_digests(spark, folder)


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", one_of_each_group),
    ("benchmark decontamination", clean_documents),
    ("source mixing", mixed_sources),
    ("token files", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
