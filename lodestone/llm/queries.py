"""One query for each operator, over its whole tables, with the digest columns that the contracts ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licenses, media, mixing, oracles, sharding, tokens
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(spark, table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "decon.n_words", "decon.n_hit", F.size("decon.item_ids").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations")).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_same").cast("long").alias("n_same"), "rendered")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = ~F.coalesce(langid.held_out(), F.lit(False))
    out = langid.identify(spark, docs, learn)
    return out.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence.*")
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels", "spans")}
    return out.withColumns(joined)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.measure(media.sniff(media.as_media(table(spark, sf_dir, "documents"))))
    return out.select("doc_id", "n_bytes", "measured.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(spark, table(spark, sf_dir, "documents"))
    out = out.withColumn("taken", F.col("copies") * F.col("size")).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    out = neardup.near_duplicates(spark, table(spark, sf_dir, "documents"), k=2, threshold=0.8)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import lm

    return lm.score(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# The part of some operators' results that SQL can express, each through its operator.


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1's rows keep: near equal sizes, gapless slots, equal texts together."""
    docs = op1_sharding(spark, sf_dir)
    by = docs.groupBy("shard").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), (F.max("slot") + 1).alias("top"), F.countDistinct("slot").alias("k"))
    shards = by.agg(F.count(F.lit(1)).alias("n_shards"), F.sum("n").alias("n_rows"), F.sum("s").alias("total_size"), (F.max("s") - F.min("s")).alias("gap"), F.bool_and((F.col("n") == F.col("top")) & (F.col("n") == F.col("k"))).alias("gapless"))
    # The copies of a text stay together, so that shards may differ by as much as the largest group of copies.
    texts = docs.groupBy("text_crc32", "size").agg(F.sum("size").alias("g"), (F.min("shard") == F.max("shard")).alias("one"))
    both = shards.unionByName(texts.agg(F.max("g").alias("g"), F.bool_and("one").alias("together")), allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select("n_shards", "n_rows", "total_size", (F.col("gap") <= F.col("g")).alias("near_equal"), "gapless", "together")


def language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("no_letter"))


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_media_columns(spark, sf_dir).drop("feature")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mixing(spark, sf_dir).select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"))


def scoring_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 without its model."""
    import public_tokenizers

    from . import lm

    out = lm.score(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), attention=False)
    return out.withColumn("base_score", F.round("base_score", 4)).drop("score")


_OPERATORS = (op1_sharding, op2_decontamination, op3_chat_format, op4_language_id, op5_license_scan, op6_media_columns, op7_mixing, op8_token_ids, op9_near_duplicates, op10_lm_scoring)
_PARTS = (shard_laws, language_split, licence_base, media_payload, mixing_targets, scoring_base)
QUERIES = {f.__name__: f for f in (*_OPERATORS, *_PARTS)}
ORACLES = {
    "op2_decontamination": oracles.DECONTAMINATION, "op3_chat_format": oracles.CHAT, "op9_near_duplicates": oracles.NEAR_DUPLICATES, "shard_laws": oracles.SHARD_LAWS, "language_split": oracles.LANGUAGE_SPLIT,
    "licence_base": oracles.LICENCE_BASE, "media_payload": oracles.MEDIA_PAYLOAD, "mixing_targets": oracles.MIXING_TARGETS, "scoring_base": oracles.SCORING_BASE,
}
