"""A corpus pipeline of four stages; it counts as part of the subpackage sparkome.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, with the rows that stay. Empty tables pass
every stage as empty tables; columns of any other name pass through the first three unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkome.llm import langid, near_copies, packing, quality_rules
from sparkome.llm.common import new_path, remove
from sparkome.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned decision list keep.

    Null and empty texts go. Repeated rows stay or go together. Labels that are null, or of ids that aren't there, teach nothing.
    """
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; null texts and texts without a letter go. Repeated rows stay or go together; where no row has a language, all stay."""
    return langid.keep(docs, langid.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more: that with the smallest id, null ids last.

    Operator 5 proposes candidates, MinHash bands those beyond its reach, and exact sets decide. It goes by rows, not ids: texts that share an id are told apart, and rows equal in id and shingles count once.
    """
    return near_copies.keep_first(docs, shingle=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 2048 tokens. A null text is its end token alone; repeated rows are documents of their own."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("simhash_near_dedup", deduplicate), ("packing", pack)]

#: Learned models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
