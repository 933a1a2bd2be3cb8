"""A corpus pipeline of five stages, each one operator's decisions put into effect.

language   rows whose text is null or has no letter go
quality    rows that the classifier scores under its threshold go
duplicates one row of each near-duplicate group stays, that with the smallest id
benchmark  rows in which a benchmark item is found go
packing    the rest is packed into sequences of 2048 tokens

A stage takes (spark, docs, sf_dir); all but the last return the columns that
they were given.  Null texts leave at the first stage; an empty table passes
through all of them.  A row is known by its id and two hashes of its text, so
rows without id, and rows that share an id and differ in text, are judged each
for itself; rows that repeat id and text are copies, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import language_id, quality
from sightline.llm.common import Workspace
from sightline.llm.decontaminate import contaminated
from sightline.llm.near_duplicates import near_duplicates
from sightline.llm.packing import pack
from sightline.llm.tokens import tokenizer_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxed(docs: DataFrame) -> DataFrame:
    """Whole rows in one column beside what a classifier reads, so that no name clashes with its results."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language_id.train(docs)
    out = language_id.predict(_boxed(docs), profiles, carry=["row"])
    return out.where(F.col("lang_pred") != language_id.UNDETERMINED).select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.score(_boxed(docs), model, carry=["row"])
    return out.where(F.col("score") >= quality.THRESHOLD).select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, beside a key that is never null and orders rows by id."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    return docs.select(F.struct("*").alias("row"), key.alias("key"), "text")


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    gone = near_duplicates(rows, id_col="key").where("not kept").select(F.col("doc_id").alias("key")).distinct()
    # copies meet before the join, which is on the same key
    one = rows.groupBy("key").agg(F.first("row").alias("row"))
    return one.join(gone, "key", "left_anti").select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _keyed(docs)
    found = contaminated(rows, _table(spark, sf_dir, "benchmark"), id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(found, "key", "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file("word_bpe_49k.json"), 0)


STAGES = [("language", language), ("quality", quality_filter), ("duplicates", duplicates), ("benchmark", benchmark), ("packing", packing)]

#: Classifiers and token packing have no SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
