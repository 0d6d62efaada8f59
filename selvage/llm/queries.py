"""Registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, compression, covertree, licences, linededup, minhash, nndescent, packing, pii, sql, toxicity, urlfilter
from .common import if_small, materialize, read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))

    def written(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.linked_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.search_own(read_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), n=4, percent=80)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{CONTROL}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{CONTROL}'")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    made = chat.format_turns(chat.canonical(chat.mixed_records(rows)))
    read = made.select("conv_id", "formatted", chat.read_back().alias("turns"), chat.loss_text().alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)([|01])', '<\\\1\2', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


TOXIC_FROM = 0.3


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_limbgemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    books = compression.train_books(vectors, parts=16, entries=64, rounds=2, scale=256)
    written = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")
    coded = materialize(compression.encode(vectors, books, scale=256).select("vec_id", "label", written, "error"), "codes")
    by_label = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return coded.join(if_small(by_label), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(compression.books_digest(books)).alias("codebooks_sha256"))


def op13_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    found = centroids.train(vectors, k=8, rounds=10, width=64, scale=1024, seed="3:")
    near = materialize(centroids.assign(vectors, found, width=64, scale=1024), "assigned")
    of = near.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))  # a row for each centroid
    total = near.agg(F.try_sum("distance").alias("inertia"))
    digest = F.element_at(F.array(*[F.lit(centroids.digest(c)) for c in found]), F.col("cluster") + 1) if len(found) else F.lit(None).cast("string")
    return near.join(F.broadcast(of), "cluster").join(F.broadcast(total)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_covertree": op2_covertree,
    "op3_bpe": op3_bpe,
    "op4_linededup": op4_linededup,
    "op5_nndescent": op5_nndescent,
    "op6_minhash": op6_minhash,
    "op7_licences": op7_licences,
    "op8_packing": op8_packing,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_urls": op11_urls,
    "op12_limbgemm": op12_limbgemm,
    "op13_threshold": op13_threshold,
}

#: Only for operators whose whole result SQL can express.
ORACLE_SQL: dict[str, str] = {"op9_chat": OP9_SQL, "op11_urls": sql.urls(urlfilter.REJECT_WORDS, URL_RULES), "op12_limbgemm": sql.codes(), "op13_threshold": sql.clusters()}
