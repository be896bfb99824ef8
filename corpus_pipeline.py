"""From raw documents to packed training sequences, one stored table per stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns a frame that is written and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadlens.llm import mixing, packing, quality, simhash
from loadlens.llm.queries import tokenizer_path
from loadlens.session import snapshot
from loadlens.sources.tables import read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these, does not reject.

    Repeated rows are scored each; null and empty texts have a score like any other.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    name = "_quality"
    while name in docs.columns:
        name += "_"
    scored = quality.score(docs, model, name)
    return scored.where(F.col(name) >= quality.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates; see ``keep_one``.

    Empty and null texts are one group; a null id comes last.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a row per draw of a document, shards shuffled.

    Null is a source of its own; texts without words are not drawn. Only names that begin
    with ``_mix`` are reserved.
    """
    return mixing.shuffled(mixing.mixed(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens.

    A null or empty text is a document of the closing id alone; repeated rows are packed
    each. Returns the columns of ``packing.pack_documents``.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

# Classifier and tokenizer have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = snapshot(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
