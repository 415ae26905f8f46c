"""The index in blocks, top passages through bounds, and short quotes through positions, against the plain joins and plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmark.operators import index, prepare, qa, retrieval
from quillmark.plans.queries import build_tables, tables, word_index
from quillmark.sources.tables import read_sources, table, write_table

SMALL = "/root/testdata/sf0.001"


def metric(df, name):
    """The sum of a metric of the scans of df's plan, after it has run."""
    df.write.format("noop").mode("overwrite").save()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    df.collect()
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan parquet") and node.metrics().contains(name):
            found += node.metrics().apply(name).value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.fixture(scope="module")
def made(spark):
    """Postings with ties, one term in every passage, sources of very many passages."""
    r = random.Random(7)
    passages = [(s, p) for s in range(60) for p in range(r.choice([1, 2, 3, 40]))]
    terms = {f"t{i}": share for i, share in enumerate([1.0, 0.5, 0.5, 0.2, 0.2, 0.05, 0.05, 0.01, 0.002])}
    rows = [(t, s, p, r.choice([1, 1, 1, 2, 5]), r.choice([8, 8, 20])) for s, p in passages for t, share in terms.items() if r.random() < share]
    postings = spark.createDataFrame(rows, "term string, source_id long, passage_no int, tf long, n_terms int").cache()
    corpus = spark.createDataFrame([(len(passages), 11.0)], "n_passages long, mean_terms double")
    stats = retrieval.term_stats(postings, corpus).cache()
    questions = spark.createDataFrame([(f"q{i}", " ".join(r.sample([*terms, "unknown"], r.randint(1, 6)))) for i in range(25)], "question_id string, question string")
    return postings, corpus, stats, questions


@pytest.mark.parametrize("size, split, k, per_source", [(4, 50, 5, 1), (16, 10**6, 3, 2), (10**6, 7, 1, 1), (2, 3, 1000, 3)])
def test_top_by_blocks_equals_all_scores(made, size, split, k, per_source):
    postings, corpus, stats, questions = made
    layout = index.term_layout(stats, 5, split)
    blocks = index.build_blocks(postings, layout, corpus, size)
    wanted = qa.question_terms(questions, layout, corpus, max_df_share=1.0)
    plain = qa.score_passages(wanted.select("question_id", "term", "idf"), postings, corpus)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.score_blocks(wanted, blocks, corpus)) == rows(plain)
    assert rows(index.top_by_blocks(wanted, blocks, corpus, k, per_source)) == rows(qa.top_passages(plain, k, per_source))


def test_blocks_hold_every_posting_once_and_hot_terms_are_split(made):
    postings, corpus, stats, _ = made
    blocks = index.build_blocks(postings, index.term_layout(stats, 5, 40), corpus, 8)
    opened = blocks.select("term", F.explode("postings").alias("p")).select("term", "p.*")
    assert sorted(map(tuple, opened.collect())) == sorted(map(tuple, postings.collect()))
    bounds = blocks.select("max_tf", "min_terms", F.array_max(F.transform("postings", lambda p: p["tf"])).alias("a"), F.array_min(F.transform("postings", lambda p: p["n_terms"])).alias("b"))
    assert bounds.where("max_tf != a or min_terms != b").isEmpty()
    pieces = blocks.where("term = 't0'").groupBy("piece").agg(F.sum(F.size("postings")).alias("n")).collect()
    df = stats.where("term = 't0'").first().df
    assert len(pieces) == -(-df // 40) and max(p.n for p in pieces) < 4 * 40


def test_fewer_terms_read_fewer_files(spark, tmp_path):
    """Folders of slots that a batch doesn't ask for are not read, as the metrics of the scan say."""
    sources = read_sources(spark, "/root/testdata/sf0.01")
    t = build_tables(sources, str(tmp_path))
    slots = t["blocks"].select("slot").distinct().count()
    questions = qa.question_set(table(spark, "/root/testdata/sf0.01", "benchmark"), "benchmark").orderBy("question_id")
    read, asked = [], []
    for n in (1, 3, 40):
        wanted = write_table(qa.question_terms(questions.limit(n), t["stats"], t["corpus"], max_terms=2), str(tmp_path), f"wanted{n}")
        own = index.in_slots(t["blocks"], wanted)
        asked.append(wanted.select("slot").distinct().count())
        read.append((metric(own, "numPartitions"), metric(own, "numOutputRows")))
    assert [p for p, _ in read] == asked and asked[0] < asked[2] <= slots and read[0][1] < read[2][1]


def test_bounds_leave_out_postings(spark):
    """Fewer postings are joined than for all scores, and no question loses one of its top passages."""
    t = tables(spark, "/root/testdata/sf0.01")
    questions = qa.question_set(table(spark, "/root/testdata/sf0.01", "benchmark"), "benchmark")
    wanted = qa.question_terms(questions, t["stats"], t["corpus"])
    # ranges of 1,024 passages are too coarse for a corpus of this size; smaller ones show the effect
    blocks = index.build_blocks(t["postings"], t["stats"], t["corpus"], 16).cache()
    ranges = index.promising(wanted, blocks, t["corpus"], k=1)
    opened = index.postings_in(ranges, wanted, blocks).agg(F.sum(F.size("postings"))).first()[0]
    every = t["postings"].join(wanted, "term").count()
    assert 0 < 3 * opened < every
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.top_by_blocks(wanted, blocks, t["corpus"], k=1)) == rows(qa.top_passages(qa.score_passages(wanted, t["postings"], t["corpus"]), k=1))


def test_empty_index(spark, made):
    postings, corpus, stats, questions = made
    layout = index.term_layout(stats, 5)
    none = index.build_blocks(postings.limit(0), layout, corpus)
    wanted = qa.question_terms(questions, layout, corpus)
    assert none.isEmpty() and index.top_by_blocks(wanted, none, corpus).isEmpty()
    assert index.top_by_blocks(wanted.limit(0), index.build_blocks(postings, layout, corpus), corpus).isEmpty()
    assert index.slot_count(0) == 1 and index.slot_count(10**12) == 4096


TEXTS = [(1, "the cat sat on the mat and the cat slept", "en", "a"), (2, "a  cat\tsat on", "en", "a"), (3, "cats at on them", "en", "b"), (4, "été en été, été", "fr", "b"), (5, None, "en", "b"), (6, "", "en", None), (7, "the the the the", "en", "a"), (8, "x" * 50 + " 😀 y", "en", "a"), (9, "the cat sat on the mat and the cat slept", "en", "b")]
QUOTES = ["cat", "c", "the", "t s", "cat sat", "the cat sat on", "he cat sat on the m", "cat sat on", "cat  sat", "at on", "s a", "the the", "the the the", "he the the t", "té en été, é", "été", " cat", "cat ", "zzz", "zzz cat", "cat zzz on", "😀", "x 😀 y", "xx", "", " ", None, "mat and the cat slept", "the mat the cat"]


def test_short_quotes_equal_plain_search(spark):
    sources = spark.createDataFrame(TEXTS, "source_id long, text string, lang string, origin string").repartition(3)
    quotes = spark.createDataFrame([(f"q{i}", q, 1) for i, q in enumerate(QUOTES)], "quote_id string, quote string, n int").select("quote_id", "quote")
    positions = index.build_positions(sources).cache()
    got = sorted(map(tuple, index.find_short_quotes(quotes, sources, positions, index.build_grams(positions)).collect()))
    want = sorted((f"q{i}", s, text.index(q) + 1) for i, q in enumerate(QUOTES) if q and re.search(r"[^\x20\x09-\x0D]", q) for s, text, *_ in TEXTS if text and q in text)
    assert got == want and len(got) > 40


def test_positions_are_those_of_words(spark):
    positions, grams = word_index(spark, SMALL)
    sources = {r.source_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in read_sources(spark, SMALL).collect()}
    rows = positions.collect()
    assert sum(len(r.places) for r in rows) == sum(map(len, sources.values()))
    assert all(sources[r.source_id][p] == r.word for r in rows[:2000] for p in r.places)
    assert grams.where(~F.contains("word", F.col("gram"))).isEmpty()
    none = index.build_positions(read_sources(spark, SMALL).limit(0))
    assert none.isEmpty() and index.build_grams(none).isEmpty()


def test_sources_without_text_are_kept(spark):
    sources = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", "a"), (3, None, "en", "b")], "source_id long, text string, lang string, origin string")
    assert sorted(map(tuple, prepare.duplicate_map(sources).collect())) == [(1, 1), (2, 2), (3, 1)]
    assert {r.source_id for r in prepare.collapse_duplicates(sources).collect()} == {1, 2}
