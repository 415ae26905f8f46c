"""E: continuous questions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index, qa
from ..sources.commits import committed, is_whole

ANSWERS = "question_id string, answer string, rank int, source_id long, passage_no int, char_start int, char_len int, quote string, score double"


def answer_batch(questions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Citations of a batch of questions against the retrieval tables (passages, blocks, stats, corpus). Only the slots of the
    batch's terms are read."""
    wanted = qa.question_terms(questions, tables["stats"], tables["corpus"])
    hits = index.top_by_blocks(wanted, tables["blocks"], tables["corpus"])
    return qa.citations(hits, tables["passages"], qa.best_sentence(hits, tables["passages"], wanted))


def answer_stream(questions: DataFrame, tables: dict[str, DataFrame], sink: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Answers a stream of questions (question_id, question, asked_at timestamp) into Parquet folders of sink, one for each batch.

    A question repeated within the delay is answered once; a repeat that comes later is answered again. A batch that is run again
    after a failure overwrites its own folder, unless that was written to its end: so no answer doubles, and none that a reader has
    seen goes. Readers use read_answers(), which leaves out what is being written.
    """
    fresh = questions.withWatermark("asked_at", delay).dropDuplicatesWithinWatermark(["question_id"])

    def store(batch: DataFrame, number: int) -> None:
        if is_whole(batch.sparkSession, f"{sink}/batch={number}"):
            # the stream's state still has to see the rows
            batch.write.format("noop").mode("overwrite").save()
        else:
            answer_batch(batch.select("question_id", "question"), tables).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return fresh.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_answers(spark: SparkSession, sink: str) -> DataFrame:
    """The citations of all batches that were written to their end."""
    folders = [f"{sink}/batch={number}" for number in committed(spark, sink, "batch")]
    return spark.read.schema(ANSWERS).parquet(*folders) if folders else spark.createDataFrame([], ANSWERS)


def stamped(questions: DataFrame, column: str) -> DataFrame:
    """questions with asked_at from a column without a time zone, which watermarks do not take."""
    return questions.withColumn("asked_at", F.col(column).cast("timestamp"))
