"""A training corpus from the documents table: five stages, each over all that came before.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns;
the last returns the mix: a row for each document taken, with its number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm.contamination import contaminated
from wattframe.llm.language import UNKNOWN, fit, with_language
from wattframe.llm.minhash import near_duplicates
from wattframe.llm.mixing import cyclic_weights, mixed
from wattframe.llm.passages import repeated_passages, without_passages
from wattframe.llm.staging import stage

LEAST_LANGUAGE_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter and those in no learned language."""
    found = with_language(docs, fit(docs), ("_language", "_marginal"))
    kept = (F.col("_language") != UNKNOWN) & (F.col("_marginal") >= LEAST_LANGUAGE_SCORE)
    return found.where(kept).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates, and one row of equal id and text.

    Texts that share an id are judged one by one. Rows without an id or without words stay;
    an empty table stays empty.
    """
    keys = ["doc_id", "_digest"]
    found = near_duplicates(docs).where("doc_id is not null").withColumnRenamed("text_digest", "_digest")
    marks = found.groupBy(*keys).agg(F.max(~F.col("kept")).alias("_goes"), F.count("*").alias("_rows"))
    marks = stage(marks.where("_goes or _rows > 1"), "marks")
    # One join, by shuffle at every size: the marks grow with the texts.
    digest = F.xxhash64(F.col("text").cast("string"))
    rest = docs.withColumn("_digest", digest).join(marks.hint("merge"), keys, "left").where("not coalesce(_goes, false)")
    again = F.coalesce(F.col("_rows"), F.lit(1)) > 1
    rows = rest.where(~again).unionByName(rest.where(again).dropDuplicates(keys))
    return rows.select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of all texts but the first."""
    return without_passages(docs, repeated_passages(docs))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a passage of the benchmark."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(stage(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies."""
    return mixed(docs, cyclic_weights(docs)).where("copies > 0")


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmarks),
    ("source_mixing", mixed_sources),
]

#: SQL can't express the first stage, a trained model; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
