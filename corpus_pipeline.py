"""Pipeline from raw documents to packed training sequences, as named stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of ``documents``. ``run`` writes each result as Parquet to the shared folder
and reads it again for the next stage, so a lost executor repeats a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.llm import jaccard, mixing, packing, store, subwords, substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels outside its held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~subwords.fold(4, 2))
    model = subwords.quality(docs, labels)
    return subwords.score(docs, model, 0.7, keep=tuple(docs.columns)).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates; rows that share an id are one document."""
    classes = jaccard.classes(docs)
    gone = classes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays")).where("not stays")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that stand in an earlier one."""
    cut = substrings.dedupe(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask; one that is taken twice is two rows."""
    sized = docs.withColumn("_size", mixing.word_count(F.col("text")))
    return mixing.emitted(mixing.mix(sized, size="_size")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, ids=False)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("mixing sources", mixture),
    ("packing", sequences),
]

#: The stages learn, hash and tokenise, which SQL cannot express; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), store.new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}")
    return docs
