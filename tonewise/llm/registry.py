"""Registered queries of the operators in this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.llm import ann, extract, jaccard, lines, lm, mixing, packing, rules, spelling, substrings, subwords, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", lm.held_out().alias("held_out"))
    model = lm.train(docs.where(~F.col("held_out")))
    return lm.score(docs, model, keep=("doc_id", "held_out"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substrings.dedupe(docs).select("doc_id", "n_words", "n_removed", substrings.kept_digest(F.col("text")).alias("kept_sha256"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", subwords.fold(5, 0).alias("held_out"))
    model = subwords.toxicity(docs, table(spark, sf, "labels").where(~subwords.fold(5, 0)))
    return subwords.score(docs, model, 0.5, keep=("doc_id", "held_out"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", subwords.fold(4, 2).alias("held_out"))
    model = subwords.quality(docs, table(spark, sf, "labels").where(~subwords.fold(4, 2)))
    return subwords.score(docs, model, 0.7, keep=("doc_id", "held_out"))


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.links(table(spark, sf, "documents"))


@query("op1_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), ids=False)


@query("op5_mixing", mixing.ORACLE)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(table(spark, sf, "documents"))


@query("op9_nearest_neighbours")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op4_html_extraction")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = extract.extract(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op11_line_dedup", lines.ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.dedupe(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf, "documents"))
    return spelling.forms(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = turns.repair_digests(turns.damaged(table(spark, sf, "conversations")))
    return found.select(F.col("conv").alias("conv_id"), *turns.COUNTS, "audit", "repaired_sha256")
