"""The index in segments against one built anew, and what readers see of a writer that dies."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import prepare, qa, retrieval, segments
from quillmark.plans.queries import tables, with_blocks
from quillmark.sources.commits import committed, is_whole
from quillmark.sources.tables import table
from quillmark.streaming import answers

SMALL = "/root/testdata/sf0.001"
DDL = "source_id long, text string, lang string"


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def rebuilt(spark, held):
    passages = prepare.split_passages(prepare.collapse_duplicates(spark.createDataFrame([(s, *v) for s, v in held.items()], DDL)))
    postings, corpus = retrieval.build_postings(passages), retrieval.corpus_stats(passages)
    return {"passages": passages, "postings": postings, "corpus": corpus, "stats": retrieval.term_stats(postings, corpus)}


def assert_equal(spark, folder, held):
    live, want = segments.live_tables(segments.open_index(spark, folder)), rebuilt(spark, held)
    for name in want:
        assert rows(live[name].select(*want[name].columns)) == rows(want[name]), name


def test_batches_equal_a_rebuild(spark, tmp_path):
    """New, changed, removed and returning sources, copies whose first one changes, null and empty texts, ties in a batch."""
    r, folder, held = random.Random(3), str(tmp_path), {}
    texts = [None, "", "one", "one two three", "two two four", "long words " * 60, "ÉTÉ one", "  \n"]
    for _ in range(4):
        batch = [(r.randrange(12), r.choice(texts), r.choice(["en", "fr", None])) for _ in range(6)]
        batch = list({s: (s, t, lang) for s, t, lang in batch}.values())
        gone = r.sample(range(14), 3)
        segments.apply_batch(spark, folder, spark.createDataFrame([*batch, (None, "no id", "en")], DDL), spark.createDataFrame([(g,) for g in [*gone, gone[0], None]], "source_id long"))
        for g in gone:
            held.pop(g, None)
        held |= {s: (t, lang) for s, t, lang in batch}
        assert_equal(spark, folder, held)
    version = segments.merge_segments(spark, folder)
    assert version == 5 and len(segments._paths(spark, folder)) == 1
    assert_equal(spark, folder, held)
    segments.apply_batch(spark, folder, spark.createDataFrame([(0, "after the merge", "en")], DDL))
    held[0] = ("after the merge", "en")
    assert_equal(spark, folder, held)


def test_first_copy_goes_and_its_passages_are_copied(spark, tmp_path):
    folder = str(tmp_path)
    segments.apply_batch(spark, folder, spark.createDataFrame([(1, "same text", "en"), (2, "same text", "fr"), (3, "other", "en")], DDL))
    segments.apply_batch(spark, folder, spark.createDataFrame([], DDL), spark.createDataFrame([(1,)], "source_id long"))
    index = segments.open_index(spark, folder)
    assert [tuple(r) for r in segments.live_tables(index)["passages"].where("source_id = 2").select("lang", "quote").collect()] == [("fr", "same text")]
    assert [tuple(r) for r in index["dead"].collect()] == [(1, 2)] and index["terms"].where("seg = 2").isEmpty()
    # the first version is still there
    assert {r.source_id for r in segments.live_tables(segments.open_index(spark, folder, 1))["passages"].collect()} == {1, 3}


def test_repeated_ids_of_a_batch_and_empty_batches(spark, tmp_path):
    folder = str(tmp_path)
    assert segments.live_tables(segments.open_index(spark, folder))["corpus"].first().n_passages == 0
    segments.apply_batch(spark, folder, spark.createDataFrame([], DDL))
    assert segments.open_index(spark, folder)["passages"].isEmpty()
    twice = spark.createDataFrame([(1, "b", "en"), (1, "a", "en"), (1, "a", "de"), (1, "a", "en")], DDL)
    segments.apply_batch(spark, folder, twice)
    least = twice.orderBy(F.sha2("text", 256), "lang").first()
    assert [tuple(r) for r in segments.live_tables(segments.open_index(spark, folder))["passages"].select("source_id", "quote", "lang").collect()] == [(1, least.text, least.lang)]
    with pytest.raises(ValueError):
        segments.open_index(spark, folder, 9)


def test_half_written_versions_are_not_seen(spark, tmp_path, monkeypatch):
    """A writer that dies before its version is committed leaves the version before; the batch can be applied again."""
    folder, held = str(tmp_path), {1: ("one", "en"), 2: ("two", "en")}
    segments.apply_batch(spark, folder, spark.createDataFrame([(s, *v) for s, v in held.items()], DDL))
    batch = spark.createDataFrame([(2, "changed", "en")], DDL)

    def dies(spark, folder, number, paths):
        (tmp_path / "versions" / f"version={number}").mkdir()
        raise OSError("died")

    with monkeypatch.context() as m:
        m.setattr(segments, "_commit", dies)
        with pytest.raises(OSError):
            segments.apply_batch(spark, folder, batch)
    assert committed(spark, f"{folder}/versions", "version") == [1]
    assert_equal(spark, folder, held)
    assert segments.apply_batch(spark, folder, batch) == 2
    assert_equal(spark, folder, held | {2: ("changed", "en")})


def test_questions_are_answered_from_a_live_index(spark, tmp_path):
    sources = table(spark, SMALL, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    for part in (0, 1):
        segments.apply_batch(spark, str(tmp_path), sources.where(f"source_id % 2 = {part}"))
    live = with_blocks(segments.live_tables(segments.open_index(spark, str(tmp_path))), str(tmp_path / "blocks"))
    questions = qa.question_set(table(spark, SMALL, "benchmark"), "benchmark")
    got, want = answers.answer_batch(questions, live), answers.answer_batch(questions, tables(spark, SMALL))
    assert rows(got) == rows(want) and not want.isEmpty()


def test_stream_dies_in_a_batch_and_starts_again(spark, tmp_path, monkeypatch):
    """Readers see no half of a batch, a batch that was written stays as it is when it runs again, and all is equal to the batch job."""
    t = {k: v.cache() for k, v in tables(spark, SMALL).items()}
    questions = qa.question_set(table(spark, SMALL, "benchmark"), "benchmark").limit(8).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).cache()
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    questions.write.parquet(source)
    plain = answers.answer_batch
    want = rows(plain(questions.select("question_id", "question"), t))

    def start():
        stream = spark.readStream.schema(questions.schema).parquet(source)
        answers.answer_stream(answers.stamped(stream, "at"), t, sink, checkpoint).awaitTermination()

    def dies(batch, tables):
        plain(batch, tables).limit(1).write.parquet(f"{sink}/batch=0")
        (tmp_path / "out" / "batch=0" / "_SUCCESS").unlink()
        raise OSError("died")

    with monkeypatch.context() as m:
        m.setattr(answers, "answer_batch", dies)
        with pytest.raises(Exception, match="died"):
            start()
    assert list((tmp_path / "out" / "batch=0").glob("*.parquet")) and not is_whole(spark, f"{sink}/batch=0")
    assert answers.read_answers(spark, sink).isEmpty()
    start()
    assert rows(answers.read_answers(spark, sink)) == want and want
    # the batch was written, but the stream's own note of it is lost
    files = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "out" / "batch=0").iterdir())
    for note in (tmp_path / "checkpoint" / "commits").iterdir():
        note.unlink()
    start()
    assert files == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "out" / "batch=0").iterdir())
    assert rows(answers.read_answers(spark, sink)) == want


def test_segments_leave_texts_and_terms_where_they_are(spark, tmp_path, monkeypatch):
    """F1 (b5_live_postings): before, segments held all quotes and a row for each posting, and readers moved both to leave out what was given up."""
    first = [(1, "a b a", "en"), (1, "a b a", None), (1, "c", "en"), (2, "same text", "en"), (2, "same text", "en"), (3, "same text", "fr"), (4, "d " * 90, "en"), (5, None, "en")]
    least = spark.createDataFrame(first, DDL).where("source_id = 1").orderBy(F.sha2("text", 256), "lang").first()
    held = {1: (least.text, least.lang), 3: ("same text", "fr"), 4: ("e", "en"), 5: (None, "en")}
    live = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (segments.HELD, 0):  # by broadcast, and by the shuffle that more ids take
            folder = str(tmp_path / str(most))
            monkeypatch.setattr(segments, "HELD", most)
            segments.apply_batch(spark, folder, spark.createDataFrame(first, DDL))
            segments.apply_batch(spark, folder, spark.createDataFrame([(4, "e", "en")], DDL), spark.createDataFrame([(2,)], "source_id long"))
            live[most] = segments.live_tables(segments.open_index(spark, folder))
            assert_equal(spark, folder, held)
        assert not [p for p in tmp_path.glob("*/segments/*/*.parquet") if "quote" in spark.read.parquet(str(p)).columns]
        moved = ["SortMergeJoin" in t[name]._jdf.queryExecution().executedPlan().toString() for t in live.values() for name in ("postings", "passages")]
        assert moved == [False, False, True, True]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_batch_that_changes_while_it_is_read_is_refused(spark, tmp_path, monkeypatch):
    texts = segments._texts
    monkeypatch.setattr(segments, "_texts", lambda *a: texts(*a).where("source_id != 1"))
    with pytest.raises(ValueError, match="changed"):
        segments.apply_batch(spark, str(tmp_path), spark.createDataFrame([(1, "one", "en"), (2, "two", "en")], DDL))
    assert not segments._paths(spark, str(tmp_path))
