"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept;
all but the last return the columns of documents. run() writes each stage's result to
the folder the cluster shares and reads it again, so a lost executor never costs more
than the stage in hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, mixing, packing, quality_rules, suffix_dedup
from tidemark.llm.common import n_words, stored, words


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.ledger(docs).filter(~quality_rules.fails("v1")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document
    of the smallest doc_id stays; of rows that repeat doc_id and text, one. Rows that
    repeat a doc_id with other text are judged by their own text."""
    if not minhash.repeats_ids(docs):
        found = minhash.near_duplicates(spark, docs, width=5, percent=80)
        gone = found.filter(~F.col("kept")).select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    found = minhash.row_verdicts(spark, docs, width=5, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id", F.col("tie").alias("_tie"))
    left = docs.withColumn("_tie", minhash.text_tie(F.col("text"))).join(gone, ["doc_id", "_tie"], "left_anti")
    named = left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "_tie"])
    return left.filter("doc_id IS NULL").unionByName(named).select(*docs.columns)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier are cut out of the texts; every document
    stays, with n_chars as its text is now."""
    out = suffix_dedup.remove_repeats(spark, docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the mix: by the first
    slot of each copy, whole, and where the mix stops inside a document its first words.
    Rows that agree in doc_id, source and size share what they are given evenly."""
    taken = mixing.passes(spark, docs).groupBy("doc_id", "source", "size", "pass").agg(F.floor(F.avg("taken")).cast("long").alias("_taken"), F.min("first_slot").alias("_slot"))
    taken = taken.filter("_taken > 0").select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size", "pass")), "_taken", "_slot")
    sized = docs.withColumn("_n", n_words(F.col("text")))
    each = sized.join(taken, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")))
    part = F.col("_taken") < F.col("_size")
    each = each.withColumn("text", F.when(part, F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("_taken").cast("int")), " ")).otherwise(F.col("text")))
    each = each.withColumn("n_chars", F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return each.repartitionByRange("_slot", "_doc_id", "_pass").sortWithinPartitions("_slot", "_doc_id", "_pass").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality_rules", rule_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeat_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Tokenizing and packing cannot be stated in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
