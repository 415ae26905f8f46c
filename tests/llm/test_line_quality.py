import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.llm import line_quality

WORD = re.compile(line_quality.WORD)
PROSE = "The river keeps its level through the summer, and the mill beside it turns all day long.\n"


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(runs)
    covered = {j for i, run in enumerate(runs) if seen[run] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(docs, rows):
    got = {r.doc_id: r for r in line_quality.clean_lines(docs).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        r, want = got[doc], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def judged(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return [tuple(r) for r in line_quality.clean_lines(frame).orderBy("doc_id").select("kept", "n_failed", "cleaned").collect()]


def test_lines_that_fail_go_and_documents_that_lose_too_much(spark):
    menu, loud, page = "home | news | sport | weather | about | contact | more news | videos |", "BUY NOW!! ONLY TODAY!! DON'T WAIT!!", "Read our privacy policy before you go on with the rest of this page."
    other = "A second bank of the same river is steep, and nobody has built there for a hundred years."
    good = PROSE + other
    got = judged(spark, good, good + f"\n{menu}\n{page}", f"{menu}\n{menu} {menu}\n{PROSE}", "\n".join([loud] * 3 + [loud + " " + loud]) + "\n" + PROSE)
    assert got[0] == (True, [0, 0, 0], good) and got[1] == (True, [0, 1, 1], good)
    assert not got[2][0] and got[2][1][1] == 2 and not got[3][0] and got[3][1][0] == 4


def test_rules_one_by_one(spark):
    lines = ["Home", "a line that goes on without an end for more than twelve words in all", "He said so.”", "x > y > z > all things", "lorem ipsum dolor sit amet, as they say.", "ALL THESE WORDS ARE CAPITALS.", "no no no no yes yes yes so so so so so so.", "", "  "]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    first = F.element_at(line_quality.judged_lines(F.col("text")), 1)["failed"]
    assert [r[0] for r in frame.orderBy("doc_id").select(first).collect()] == ["punctuation", None, None, "punctuation", "boilerplate", "boilerplate", "boilerplate", None, None]
    menu = spark.createDataFrame([("one | two | three | four | five | six | seven | eight",)], "text string")
    assert menu.select(F.element_at(line_quality.judged_lines(F.col("text")), 1)["failed"]).first()[0] == "navigation"


def test_limits_ties_and_long_texts(spark):
    words = " ".join(f"w{i}" for i in range(19))
    got = judged(spark, words + ".", words + " end.", " ".join(f"w{i}" for i in range(14)) + " " + " ".join(f"v{i}" for i in range(8)) + " " + " ".join(f"v{i}" for i in range(8)) + " x.")
    assert [g[0] for g in got] == [False, True, False]
    long = PROSE * 4000
    r = line_quality.clean_lines(spark.createDataFrame([(1, long)], "doc_id bigint, text string")).first()
    assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.base_failed, r.kept) == (68000, 68000, 3999, True, False)


def test_nulls_repeats_empties_and_clashing_names(spark, odd, empty):
    got = line_quality.clean_lines(odd).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 1
    assert line_quality.clean_lines(empty).isEmpty()
    frame = spark.createDataFrame([(1, None, "w", 5), (None, "", "w", 5)], "doc_id bigint, text string, lines string, n_words int")
    assert [(r.n_words, r.n_dup_lines, r.cleaned, r.kept, r.n_lines) for r in line_quality.clean_lines(frame).collect()] == [(0, 0, "", False, 0)] * 2


def test_no_python_in_the_plan(docs):
    assert "Python" not in (plan := line_quality.clean_lines(docs)._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan


def test_query_keeps_the_good_and_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from quillmark.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got = queries.op13_line_quality(spark, folder)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.ORACLES['op13_line_quality']})").fetchall()
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(want)
    labelled = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert labelled.where("quality = 1 and not base_failed and not kept").isEmpty()
    assert 10 * labelled.where("quality = 0 and kept").count() <= labelled.where("quality = 0").count()


def test_characters_of_words_are_counted_once_a_line(spark):
    text = spark.createDataFrame([("ab  cd\n\né\U0001f600 x",)], "text string")
    assert [r.chars for r in text.select(line_quality.judged_lines(F.col("text")).alias("lines")).first().lines] == [4, 0, 3]
