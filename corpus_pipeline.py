"""A corpus from raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import chunk_dedup, jaccard_join, line_crf, mixing, packing
from keyloom.llm.stage import dropped, written

#: Output shards of the mix, and bytes of text that a part of a shard should hold.
SHARDS = 64
PART_BYTES = 64_000_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's threshold.

    Null ids are scored as others; null and empty texts are one empty line each. No rows give no rows.
    """
    field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score(docs, field).filter(F.col("score") >= line_crf.GOOD).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies one document: of those with the least id, the one with the least hash of its text.

    Repeated rows are one; of rows with one id and text that differ in other columns the least stays. Null ids and
    null or empty texts take part as in jaccard_join.similar. No rows give no rows.
    """
    heads = jaccard_join.similar(docs).filter(F.col("key") == F.col("class_id"))
    heads = heads.groupBy("key").agg(F.min("hash").alias("hash"))
    keyed = docs.select(F.struct("*").alias("row"), chunk_dedup.document_key().alias("key"), F.xxhash64("text").alias("hash"))
    # least first: rows that are repeated very often become one before they are shuffled
    one = keyed.groupBy("key", "hash").agg(F.min("row").alias("row"))
    return one.join(heads, ["key", "hash"], "left_semi").select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds. Every row stays, with its null or a text that became empty."""
    done = chunk_dedup.dedup(docs).drop("dedup")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, cut to the words taken, shuffled within its shard.

    A cut text keeps its white space up to its last word taken. Null and empty texts are in no copy. No rows give no rows.
    """
    volume = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(1, math.ceil(2 * volume / (SHARDS * PART_BYTES)))
    rows = mixing.emit(mixing.mix(docs, shards=SHARDS, carry=("text", "lang", "source", "n_chars")), parts)
    spaced = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{mixing.WORD}"), F.lit(0))
    first = F.array_join(F.slice(spaced, 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048 ids. A null or empty text is one piece of one id; no rows give no pieces."""
    import public_tokenizers

    return packing.packed_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_class),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Quality scores, sampled paths and rolling hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)  # only tables of this run, never the input
    return STAGES[-1][1](spark, docs, sf_dir)
