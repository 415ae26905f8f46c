import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmark.llm import collocations as co
from quillmark.llm import queries


def plain(table, least=10, most=3, share=50, top=2000):
    """Counts of all phrases in dictionaries, whole numbers of Python throughout."""
    counts, n = defaultdict(Counter), Counter()
    for text, lang in table:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(a, longer.get(p[i : i + k], 0))
        rows = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top]):
            out.add((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def test_query_equals_plain_counts(spark):
    got = queries.op12_collocations(spark, "/root/testdata/sf0.01")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    table = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").collect()]
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == plain(table) and len(rows) == len(set(rows)) > 1000


@pytest.mark.parametrize("chunk, each", [(8_000_000, 8_000_000), (300, 200)])
def test_small_chunks_and_many_partitions(spark, docs, rows, chunk, each):
    got = co.collocations(docs, least=3, most=4, top=50, chunk=chunk, each=each)
    assert {tuple(r) for r in got.collect()} == plain([(r[1], r[2]) for r in rows], least=3, most=4, top=50)


def test_pieces_case_ties_nulls_and_controls(spark):
    texts = ["New York, new york. NEW YORK", "É a\tb\x1fc  d\x0bé a", "x y x y x y;x y", "b a:b a!a b?a b", None, "", "\n ", "one\ntwo one\rtwo"] * 3 + ["q r s"] * 10 + ["q r"] * 10
    table = [(t, lang) for t in texts for lang in ("en", None, "und")]
    frame = spark.createDataFrame([(*x, 1, "w") for x in table], "text string, lang string, f int, phrase string").repartition(3)
    for most in (2, 3):
        assert {tuple(r) for r in co.collocations(frame, least=4, most=most).collect()} == plain(table, least=4, most=most)
    assert co.collocations(frame.limit(0)).isEmpty()
    assert {tuple(r) for r in co.collocations(frame, top=1).collect()} == plain(table, top=1)


def test_long_text_is_cut_where_pieces_end(spark):
    r = random.Random(1)
    text = " ".join(r.choice(["aa", "bb", "cc", "dd."]) for _ in range(20_000)) + " " + "ee ff " * 3000
    frame = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert co.chunks(frame, 1000).count() > 20
    assert {tuple(x) for x in co.collocations(frame, chunk=1000, each=5000).collect()} == plain([(text, "en")])


def test_products_beyond_64_bits(spark):
    frame = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_000_000)], "a long, l long, r long")
    assert frame.select(co.pair_score(frame.a, frame.l, frame.r)).first()[0] == 1000000 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_000_000)


def test_every_frequent_key_survives():
    """Summaries with as few counters as the guarantee allows."""
    r = np.random.default_rng(4)
    for threshold in (2, 10, 50):
        keys = r.zipf(1.3, 20_000).astype(np.uint32) % 5000
        summary = co.Summary(len(keys), threshold)
        for part in np.array_split(keys, 37):
            own, counts = np.unique(part, return_counts=True)
            summary.add(own, counts)
        kept = set(summary.survivors().tolist())
        assert {k for k, n in Counter(keys.tolist()).items() if n >= threshold} <= kept and len(kept) <= len(keys) // threshold + 1
        assert summary.lost < threshold
