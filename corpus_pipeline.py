"""Corpus pipeline: documents to packed sequences, a stage for each of five training-data operators.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.llm import linededup, minhash, packing, pii, toxicity
from selvage.llm.common import discard, if_small, materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with at least this score are rejected.
TOXIC_FROM = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; labels of the held-out fold aren't used.

    Null and empty texts get the score of no words, so they stay unless most
    documents are toxic.  Rows are judged one by one: repeated rows share their
    fate.  Other columns than those of ``documents`` are left out, here and in
    every stage; an empty table stays empty.
    """
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.train(docs, labels))
    return scored.where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut from the texts; every row stays.

    Null texts stay null, a text of nothing but recurring lines becomes empty,
    repeated rows are cut alike; an empty table stays empty.
    """
    return _counted(linededup.drop_recurring_lines(docs.select(*COLUMNS)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: five words, a similarity of 0.8.

    Texts that are null, empty or without words are near nothing and stay, as do
    rows without id.  Rows that repeat both id and text leave one.  Different
    texts under one id are different documents: all stay unless they are near
    something; in a group those but the first such text count as the smallest.
    An empty table stays empty.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    several = rows.groupBy("doc_id").agg(F.min("_text").alias("lo"), F.max("_text").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("_of"), "lo")
    rows = rows.join(if_small(materialize(several, "repeated-ids")), F.col("doc_id") == F.col("_of"), "left")
    # texts of a repeated id behind its first get a negative id of their own
    own = F.when(F.col("lo").isNull() | (F.col("_text") == F.col("lo")), F.col("doc_id")).otherwise(-1 - F.xxhash64("doc_id", "_text").bitwiseAND(F.lit(2**63 - 1)))
    rows = rows.withColumn("_id", F.when(F.col("doc_id").isNotNull(), own)).select(*COLUMNS, "_id")
    kept = minhash.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), n=5, percent=80).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    return rows.join(kept, "_id", "left_semi").dropDuplicates(["_id"]).select(*COLUMNS).union(docs.select(*COLUMNS).where("doc_id IS NULL"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; every row stays.

    Null texts stay null, empty ones empty; rows are treated one by one, so
    repeated rows stay alike; an empty table stays empty.
    """
    return _counted(pii.redact(docs.select(*COLUMNS), pii.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, a row for each piece of a document.

    A null or empty text is its end token alone; very long texts are cut into
    pieces; repeated rows are packed repeatedly; an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("minhash near-dedup", near), ("pii", private), ("best-fit packing", packed)]

#: The learnt stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = materialize(stage(spark, before, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    return docs
