"""A corpus pipeline: quality, near duplicates, secrets, mixture and encoding, each by one operator of quillmark.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. Extra columns of any name are carried along. Empty tables pass through as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, mixing, quality, secret_scan, simhash
from quillmark.llm.common import lasting, scratch, settled
from quillmark.llm.queries import VOCABULARY

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def _mark(docs: DataFrame) -> str:
    """A prefix that no column of docs begins with, for columns of our own beside them."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids in gone. A null id can't be named there and stays."""
    own = _mark(docs) + "id"
    return docs.join(gone.select(F.col("doc_id").alias(own)), F.col("doc_id") == F.col(own), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, with all rows of their id.

    Null and empty texts are judged as texts without words. Rows with a null id stay. Repeated rows stay or go together; a score
    on the threshold stays.
    """
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 0").select("doc_id").distinct())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of equal texts, and of texts whose 5-word shingles are 0.8 alike or more.

    Repeated rows of one id and text become one, the first by all columns as JSON. Null texts count as empty, and so as copies of each
    other. Rows with a null id all stay. Of equal texts the smallest id stays.
    """
    gone = settled(spark, lambda: simhash.near_copies(docs, words_each=5, least=0.8).select("doc_id"), "gone")
    kept = _without(docs, simhash.sent(gone))
    named = F.col("doc_id").isNotNull()
    if docs.where(named).groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").isEmpty():
        return kept
    row, own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), _mark(docs) + "row"
    once = kept.where(named).groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias(own)).select(f"{own}.*")
    return once.union(kept.where(~named))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, linked weak candidates among them, are masked; n_chars follows the text. No document goes.

    Null texts, null ids and repeated rows stay as they are, repeated rows with equal masks.
    """
    mark = _mark(docs)
    own_id, own_hash, own_spans = mark + "id", mark + "hash", mark + "spans"
    spans = secret_scan.scan(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    spans = spans.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("spans").alias(own_spans))
    met = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_hash)), "left")
    text = F.when(F.col(own_spans).isNull(), F.col("text")).otherwise(secret_scan.redacted(F.col("text"), F.col(own_spans)))
    masked = met.withColumn("text", text)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col(own_spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return masked.drop(own_id, own_hash, own_spans)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed so that none is repeated more than twice, over as many tokens as there are; a document is a row for each
    epoch in which its block is used.

    A null source is a source of its own. Null and empty texts have no tokens. Each row with a null id, or with a repeated id, is
    used in every epoch in which any of that id is used. Tied blocks and documents go by their numbers and ids.
    """
    mark = _mark(docs)
    own_id, rows, row = mark + "id", mark + "rows", mark + "row"
    plan = mixing.mix(mixing.token_table(docs), most_repeats=2.0).select(F.col("doc_id").alias(own_id), "epoch").dropDuplicates()
    plan = plan.groupBy(own_id).agg(F.count("*").alias(rows))
    met = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(own_id)))
    return met.withColumn(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col(rows)))).drop(own_id, rows, row)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row.

    Null and empty texts have no ids, null ids stay null, repeated rows give equal rows.
    """
    return bpe.bpe_encode(docs, VOCABULARY).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written to the shared folder and read by the next.

    What a stage leaves there is removed when its result is written, and each result when the next one is.
    """
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, now_done = lasting(stage(spark, docs, sf_dir), f"stage-{name}")
        if done:
            done()
        done = now_done
    return STAGES[-1][1](spark, docs, sf_dir)
