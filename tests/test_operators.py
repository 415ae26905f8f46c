import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark.operators import prepare, qa, report, retrieval
from quillmark.plans.queries import ORACLES, QUERIES, tables
from quillmark.sources.tables import read_sources, table
from quillmark.streaming import answers

SMALL = "/root/testdata/sf0.001"
EDGE = [(1, "", "en", "a"), (2, "word", "en", "a"), (3, "!? ...", "en", "a"), (4, "ÉTÉ Ünder  ß\n\n" + "long words here. " * 60, "fr", "b"), (5, "same text twice", "en", "b"), (6, "same text twice", "en", "a"), (7, "😀 one two three four five six seven eight nine ten eleven", "en", None)]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(EDGE, "source_id long, text string, lang string, origin string").repartition(3)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want))


def test_passages_are_verbatim(sources, spark):
    for frame in (sources, read_sources(spark, SMALL)):
        passages = prepare.split_passages(frame).join(frame.select("source_id", "text"), "source_id")
        assert passages.where(F.substr("text", F.col("char_start") + 1, F.col("char_len")) != F.col("quote")).isEmpty()
    assert {r.source_id for r in prepare.split_passages(sources).collect()} == {2, 3, 4, 5, 6, 7}
    assert {r.passage_no for r in prepare.split_passages(sources).where("source_id = 4").collect()} == {0, 1, 2, 3, 4}


def test_duplicates(sources):
    assert {(r.source_id, r.canonical_id) for r in prepare.duplicate_map(sources).where("source_id > 4").collect()} == {(5, 5), (6, 5), (7, 7)}
    assert {r.source_id for r in prepare.collapse_duplicates(sources).collect()} == {1, 2, 3, 4, 5, 7}


def test_quotes(spark, sources):
    quotes = spark.createDataFrame([("q", "one two three four five six seven eight nine ten"), ("cut", "ne two three four five six seven eight nine te"), ("short", "same text twice")], "quote_id string, quote string")
    assert {tuple(r) for r in qa.find_quote(quotes, sources).collect()} == {("q", 7, 3), ("cut", 7, 4)}
    assert [r.quote_id for r in qa.short_quotes(quotes).collect()] == ["short"]


def test_verdicts(spark, sources):
    cited = spark.createDataFrame([("a", 1, 5, 0, 4, "same"), ("b", 1, 5, 1, 4, "same"), ("c", 1, 5, 0, 4, "none"), ("d", 1, 99, 0, 4, "same")], "question_id string, rank int, source_id long, char_start int, char_len int, quote string")
    assert {r.question_id: r.verdict for r in qa.check_citations(cited, sources).collect()} == {"a": "exact", "b": "moved", "c": "missing", "d": "missing"}


def test_ties_and_unanswered(spark):
    scored = spark.createDataFrame([("q", s, p, 1.0) for s in (3, 1, 2) for p in (1, 0)], "question_id string, source_id long, passage_no int, score double")
    assert [(r.source_id, r.passage_no, r.rank) for r in qa.top_passages(scored, k=2).orderBy("rank").collect()] == [(1, 0, 1), (2, 0, 2)]
    questions = spark.createDataFrame([("q", "x"), ("r", "y")], "question_id string, question string")
    assert [r.question_id for r in qa.unanswered(questions, qa.top_passages(scored)).collect()] == ["r"]


def test_empty_tables(spark, sources):
    none = sources.limit(0)
    passages = prepare.split_passages(none)
    postings = retrieval.build_postings(passages)
    assert passages.isEmpty() and postings.isEmpty() and retrieval.corpus_stats(passages).first().n_passages == 0
    assert retrieval.term_stats(postings, retrieval.corpus_stats(passages)).isEmpty()
    assert report.cited_summary(passages, none, retrieval.term_stats(postings, retrieval.corpus_stats(passages))).isEmpty()


def test_no_python_and_no_cartesian_product_in_plans(spark):
    for name in QUERIES:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_stream_equals_batch(spark, tmp_path):
    t = {k: v.cache() for k, v in tables(spark, SMALL).items()}
    questions = qa.question_set(table(spark, SMALL, "benchmark"), "benchmark").limit(12).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).cache()
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    questions.write.parquet(source)
    questions.limit(5).write.mode("append").parquet(source)
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(questions.schema).parquet(source)
        answers.answer_stream(answers.stamped(stream, "at"), t, sink, checkpoint).awaitTermination()
        got = spark.read.parquet(sink).drop("batch")
        want = answers.answer_batch(questions.select("question_id", "question"), t)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_long_texts(spark):
    """Positions over several groups of blocks, at a time that grows with the text."""
    text = "".join(f" w{i}\n" if i % 7 else f"  é{i}" for i in range(32 * 64 * 3 + 5))
    frame = spark.createDataFrame([(1, text, "en", "a")], "source_id long, text string, lang string, origin string")
    passages = prepare.split_passages(frame).collect()
    assert len(passages) == 192 and all(text[r.char_start : r.char_start + r.char_len] == r.quote for r in passages)
    assert [r.passage_no for r in passages] == list(range(192))


def test_unanswered_query_with_rows(spark, tmp_path):
    """C7 where some questions have no known term."""
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    read("documents").write.parquet(str(tmp_path / "documents.parquet"))
    read("benchmark").union(spark.createDataFrame([(10**6, "xyzzyq plughq"), (10**6 + 1, "")], read("benchmark").schema)).write.parquet(str(tmp_path / "benchmark.parquet"))
    read("conversations").limit(20).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"select question_id, question from ({ORACLES['c7_unanswered']})").fetchall()
    got = [tuple(r) for r in QUERIES["c7_unanswered"](spark, str(tmp_path)).select("question_id", "question").collect()]
    assert sorted(got) == sorted(want) and len(got) >= 2


def test_tables_are_built_once(spark):
    assert tables(spark, SMALL)["postings"] is tables(spark, SMALL)["postings"]
    plan = QUERIES["c6_cited_answers"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan
