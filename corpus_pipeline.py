"""A training corpus from documents: five stages, each an operator of tidemark.llm over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chaining import remove_shared_passages
from tidemark.llm.jaccard import jaccard_join
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack
from tidemark.llm.staging import cut, release, table, written
from tidemark.llm.toxicity import toxicity


def _with_row(docs: DataFrame) -> DataFrame:
    """docs as doc, with the operators' key of a row."""
    return docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that toxicity predicts as toxic; rows that share a doc_id are judged by their own texts."""
    # cut, so that the driver doesn't hold the model's examples while the next stages run
    rejected = cut(toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("row").distinct())
    release(spark)
    return _with_row(docs).join(rejected, "row", "left_anti").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each class of near duplicates, that of the least doc_id; of repeated rows one stays."""
    found = jaccard_join(docs).groupBy("row").agg(F.count("*").alias("n"), F.first("class_row").alias("class_row"))
    # cut, as both branches read it: the driver plans the whole join once
    kept = cut(found.where("row = class_row").select("row", "n"))
    release(spark)
    firsts = _with_row(docs).join(kept, "row")
    again = firsts.where("n > 1").dropDuplicates(["row"])
    return firsts.where("n = 1").unionByName(again).select("doc.*")


def drop_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the passages that an earlier document has; every document stays, and n_chars follows its text."""
    return remove_shared_passages(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as their source's target weight takes them."""
    mixed = mix_sources(docs)
    release(spark)
    return mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of docs in sequences of 1024 tokens at most."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("shared_passages", drop_shared_passages),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the index's votes; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents, each one's result written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
