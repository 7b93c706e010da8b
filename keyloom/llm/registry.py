"""The registered queries of the thirteen operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import (
    ann_search,
    chunk_dedup,
    clustering,
    exact_search,
    jaccard_join,
    line_crf,
    mixing,
    oracles,
    packing,
    sharding,
    suffix_dedup,
    suffix_tree,
    term_pipeline,
    url_filter,
)
from keyloom.llm.url_filter import Rule

RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard and shard_again: the shards that get the words of the first and the second pass; null if none does."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    first, again = F.get("copies", F.lit(0)), F.get("copies", F.lit(1))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        first["shard"].alias("shard"),
        again["shard"].alias("shard_again"),
        F.coalesce(again["words"], F.lit(0)).cast("long").alias("taken_again"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chunk_dedup.dedup(_table(spark, sf_dir, "documents"))
    size = F.aggregate("dedup.removed", F.lit(0), lambda n, span: n + span["end"] - span["start"])
    return done.select(
        "doc_id",
        "text",
        F.col("dedup.n_chunks").alias("n_chunks"),
        F.size("dedup.removed").alias("n_spans"),
        size.alias("n_removed"),
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed_digests(_table(spark, sf_dir, "documents"), path, added=True)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return done.select("doc_id", "n_bytes", "n_removed", n_spans, "kept_sha256")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the quality label of the document of the same number."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), outcomes, RULES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = line_crf.train(docs, _table(spark, sf_dir, "labels"))
    return line_crf.score(docs, field).select(
        "doc_id",
        line_crf.held_out().alias("held_out"),
        "score",
        (F.col("score") >= line_crf.GOOD).cast("int").alias("predicted"),
    )


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whole: whether all texts equal to the row's are in its shard; groups are cut only where no shard has room."""
    put = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 16)
    return put.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "whole",
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=10)


def op12_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_neighbours": op3_neighbours,
    "op4_pack": op4_pack,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_jaccard": op6_jaccard,
    "op7_url_filter": op7_url_filter,
    "op8_topk": op8_topk,
    "op9_quality": op9_quality,
    "op10_shard": op10_shard,
    "op11_lexical": op11_lexical,
    "op12_cluster": op12_cluster,
    "op13_lm_score": op13_lm_score,
}
ORACLES: dict[str, str] = {
    "op1_mix": oracles.MIX,
    "op3_neighbours": oracles.NEIGHBOURS,
    "op5_suffix_dedup": oracles.SUFFIX,
    "op6_jaccard": oracles.JACCARD,
    "op7_url_filter": oracles.url_filter(RULES),
    "op8_topk": oracles.TOPK,
    "op11_lexical": oracles.LEXICAL,
    "op12_cluster": oracles.clusters(),
}
