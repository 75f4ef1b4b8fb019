"""Registered queries of the operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, chat, embeddings, hnsw, license, minhash, mixing, oracles, periodic, pii, quality, suffix, warc, zonemaps
from tidepanel.llm.common import id_bucket, table

QUERIES: dict = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
ORACLES["op5_license"] = oracles.license_sql(license.PHRASES, license.TEMPLATES, license.SHARE, license.WINDOW, license.STEP)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


@query
def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, tools = chat.from_conversations(table(spark, sf_dir, "conversations"))
    return chat.linked(calls, results, tools)


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.tokenize(table(spark, sf_dir, "documents"), path, tokens=False)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return (docs.select("doc_id", (id_bucket(F.col("doc_id"), quality.FOLDS) == 0).alias("held_out"),
                        quality.score(F.col("text"), model).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= quality.REJECT_BELOW, 1).otherwise(0).cast("int")))


@query
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.summary(pii.find(docs, pii.fit(docs)))


@query
def op12_zonemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.cluster(table(spark, sf_dir, "embeddings"))


@query
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic.summary(periodic.scan(periodic.looped(docs), texts=False))
