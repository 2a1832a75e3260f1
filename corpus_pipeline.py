"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps; the last returns what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.llm import decontam, minhash, mixing, tokens, toxicity
from courtflow.llm.common import saved, scratch
from courtflow.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject, each judged by its own text, whether its doc_id is null, repeated or neither."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five words, similarity 0.8).

    Rows that repeat a doc_id are one document: all stay or all go. Rows of null doc_id stay.
    """
    copies = minhash.near_duplicates(docs.where("doc_id is not null")).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(copies.hint("merge"), "doc_id", "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Of rows that repeat a doc_id all go if one holds an item; rows of null doc_id stay."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(found.hint("merge"), "doc_id", "left_anti")


def placed(docs: DataFrame) -> DataFrame:
    """All documents with ``slot``, their place in the mixture. A repeated doc_id stands at its first slot, a null one has none."""
    slots = mixing.mix(docs, mixing.tempered(docs)).where("doc_id is not null").groupBy("doc_id").agg(F.min("slot").alias("slot"))
    return docs.select(*COLUMNS).join(slots.hint("merge"), "doc_id", "left")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return placed(docs).repartitionByRange("slot").sortWithinPartitions("slot", "doc_id").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in the order of the mixture, read back: a row a document.

    A table does not keep its order when it is read, so the slots are worked out again: the same documents get the same ones.
    """
    path = scratch(spark)
    tokens.write_tokens(placed(docs), path, tokenizer_path(), order=("slot", "doc_id"))
    return tokens.token_digest(spark, path)


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_copies), ("decontamination", without_benchmark), ("mixing", mixed), ("token_ids", packed)]

#: Models, tilings and schedules are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
