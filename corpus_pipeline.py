"""Cleaning of a corpus in stages; each stage works on what the one before kept.

Every stage but the last returns the columns of its input. Rows with null or empty texts
fail the quality rules and go in the first stage. Repeated rows are near-duplicates of each
other, so one of them stays. An empty table passes through.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import mixing, phrases, repetition, simhash, winnow
from creditloom.staging import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occur earlier are cut; texts left empty go."""
    found = phrases.remove_repeats(docs, width=20).where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    kept = {
        "doc_id": F.col("id"),
        "text": F.col("kept_text"),
        "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        if "n_chars" in docs.columns
        else None,
    }
    columns = [
        kept[c].alias(c) if c in kept else F.col("row").getField(c).alias(c) for c in docs.columns
    ]
    return found.select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return winnow.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in training order, by the weights of their sources."""
    return mixing.training_order(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
]

#: The stages hash words and cut texts in ways that SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
