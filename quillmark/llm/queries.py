"""The numbered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversation_repair, line_quality, lm_score, media, merkle, mixing, quality, secret_scan, simhash, substring_dedup, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), VOCABULARY)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words_each=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.token_table(_table(spark, sf_dir, "documents")), most_repeats=2.0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = merkle.compare_with_next(_table(spark, sf_dir, "documents"))
    own, edited = F.col("fingerprint"), F.col("edited_fingerprint")
    both = both.withColumn("edit", merkle.edits(own, edited))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        merkle.likeness(own, edited).alias("near_edited"),
        merkle.likeness(own, F.col("next_fingerprint")).alias("near_next"),
        F.size("edit").alias("n_edited"),
        F.get(F.col("edit"), 0)["leaf"].alias("first_edited"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.store_media(_table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws("|", "n_frames", F.size("first"), F.array_join("start_ms", ",")).alias("feature"),
        F.array_join(F.zip_with("start_ms", "end_ms", lambda a, b: F.concat_ws("-", a, b)), ",").alias("clips"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations"))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.clean_lines(_table(spark, sf_dir, "documents"))
    failed = [F.col("n_failed")[i].alias(f"n_{r}") for i, r in enumerate(line_quality.RULES)]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", *failed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_mixing, op4_token_counts, op5_quality, op6_substring_dedup, op7_merkle, op8_media, op9_secret_scan, op10_lm_score, op11_conversation_repair, op12_collocations, op13_line_quality)}
#: The others are beyond SQL and are tested against brute force.
ORACLES = {"op3_mixing": mixing.oracle(), "op13_line_quality": line_quality.oracle()}
