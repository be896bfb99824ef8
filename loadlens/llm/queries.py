"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.llm import (
    caps, extract, hard_negatives, licenses, link_rank, mixing, packing, prefix_trie, quality,
    radix, simhash, topk, warc,
)
from loadlens.session import snapshot
from loadlens.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {
    "op5_mixing": mixing.TAKEN_SQL,
    "op11_hard_negatives": hard_negatives.MINED_SQL,
    "op12_prefix_trie": prefix_trie.TRIE_SQL,
    "op13_exact_dedup": radix.EXACT_SQL,
}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def tokenizer_path() -> str:
    """The public vocabulary that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_link_rank(spark: SparkSession, folder: str) -> DataFrame:
    return link_rank.filter_urls(read_table(spark, folder, "pages"))


@query
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read_table(spark, folder, "pages"))


@query
def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = topk.quantised(read_table(spark, folder, "embeddings"))
    found = topk.top_k(rows, rows.where(F.col("id") % 50 == 0), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read_table(spark, folder, "documents")).drop("spans")


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(read_table(spark, folder, "documents"))


@query
def op6_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(read_table(spark, folder, "pages"))


@query
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"), tokenizer_path())


@query
def op9_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_duplicates(read_table(spark, folder, "embeddings"))


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(
        read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    )


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.labelled(vectors.withColumn("label", label))
    return hard_negatives.mine(rows, rows.where(F.col("id") % 100 == 0))


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = snapshot(prefix_trie.numbered(read_table(spark, folder, "conversations")), "numbered")
    rebuilt = prefix_trie.reopened(
        turns, F.col("conv") - F.col("conv") % 100,
        F.crc32(F.col("conv").cast("string")) % 6, longest=5,
    )
    return prefix_trie.trie(rebuilt, turns.select("conv").distinct()).drop("key", "parent")


@query
def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return radix.exact_groups(
        read_table(spark, folder, "documents"), carry={"text_sha256": lambda t: F.sha2(t, 256)}
    )
