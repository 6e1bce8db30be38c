"""From raw documents to training shards: five stages, each by one operator of lodestone.llm over all that is left.

Every stage takes the documents that the one before has kept and returns their own columns, whatever they are called;
the last gives each document's shard and place. An empty table passes through every stage as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, mixing, neardup, sharding
from lodestone.llm.common import scratch, table


#: The column in which a stage's operator puts what it found, taken away again by the stage.
ADDED = "_lodestone_found"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, learned from those labelled in `lang`; where nothing is labelled, those with a letter.

    Null, empty and letterless texts go. A null doc_id or lang, a repeated row and a very long text stay as any other.
    """
    held = langid.identify(spark, docs, into=ADDED)
    return held.filter((F.col(ADDED)["lang_pred"] != "und") | langid.has_letter()).drop(ADDED)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (shingles of five words, similarity 0.8).

    Of rows that repeat an id and a text one stays; a text without an id goes where its group has one with an id.
    """
    return neardup.deduplicate(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in windows of the benchmark.

    A null text has no words and stays; an empty benchmark takes nothing away.
    """
    held = decontam.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"), into=ADDED)
    return held.filter(~decontam.contaminated(ADDED)).drop(ADDED)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, none more than three times; a null source is one of its own."""
    return mixing.repeated(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, in eight shards of near equal bytes; equal texts together."""
    return sharding.shard_documents(spark, docs, shards=8)


STAGES = [("language id", language_id), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: The classifier's kernel regression has no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(docs, "stage")
    return docs
