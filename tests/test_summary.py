"""D3 by bounds of sentences."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmark.operators import prepare, report, retrieval
from quillmark.plans.queries import QUERIES
from quillmark.sources.tables import read_sources, shared_folder

SMALL = "/root/testdata/sf0.001"


def test_summary_moves_likely_sentences_alone(spark, tmp_path):
    """F8: before, all passages, postings and blocks were written, and each sentence moved with its terms."""
    for t in ("documents", "benchmark", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    left = lambda: set(Path(shared_folder(spark)).glob("quillmark-*/*.parquet"))
    before = left()
    QUERIES["d3_cited_summary"](spark, str(tmp_path)).collect()
    new = {p.stem: str(p) for p in left() - before}
    assert set(new) == {"odd", "terms", "likely"}
    every = report.said_sentences(read_sources(spark, SMALL)).count()
    assert spark.read.parquet(new["likely"]).count() < every / 4


@pytest.mark.parametrize("most", [0, 20, 1000])
def test_bounds_of_known_terms_lose_no_sentence(spark, most):
    """Whatever terms are known, the sentences left give the summary of all, with ties and copies among them."""
    pick = random.Random(3)
    text = lambda: " ".join(pick.choice("abcdefgh") * pick.choice((1, 1, 1, 2, 3, 4)) + pick.choice((".", "", "", "", "")) for _ in range(pick.randrange(150)))
    rows = [(i, text() if i % 3 else "aa bb cc dd eee. " * 9, "en", pick.choice(("x", "y", None))) for i in range(120)]
    sources = spark.createDataFrame(rows, "source_id long, text string, lang string, origin string").repartition(3).cache()
    passages = prepare.split_passages(sources)
    stats = retrieval.term_stats(retrieval.build_postings(passages), retrieval.corpus_stats(passages)).cache()
    want = sorted(map(repr, report.cited_summary(passages, sources, stats).collect()))
    likely = report.likely_sentences(report.said_sentences(sources, ("origin",)), stats, most=most).cache()
    assert sorted(map(repr, report.likely_summary(likely, stats).collect())) == want and len(want) == 15
    table, lo, hi = report.known_terms(stats, most)
    assert len(table) <= most and lo <= stats.agg(F.max("idf")).first()[0]
