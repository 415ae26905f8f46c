import hashlib

import corpus_pipeline as cp
from pyspark.sql import functions as F

from quillmark.llm import common, quality, secret_scan, simhash

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rejected = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("predicted = 0").collect()}
    good = cp.quality_stage(spark, docs, SMALL)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - rejected and rejected
    kept = cp.near_duplicate_stage(spark, good, SMALL).collect()
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text.encode(), 5).tolist()) for r in good.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    leaders = {r.doc_id: r.leader for r in simhash.near_copies(good).collect()}
    ids = [r.doc_id for r in kept]
    assert not any(alike(a, b) for a in ids for b in ids if a < b)
    assert all(alike(d, k) and any(alike(d, x) for x in ids) for d, k in leaders.items()) and leaders.keys() == sets.keys() - set(ids) and leaders
    frame = spark.createDataFrame(kept, docs.schema)
    clean = cp.secret_stage(spark, frame, SMALL)
    before = {r.doc_id: r.text for r in kept}
    spans = {r.doc_id: r.spans for r in secret_scan.scan(frame).collect()}
    for r in clean.collect():
        want, at = [], 0
        for s in spans[r.doc_id]:
            if s.start > at or not want:
                want += [before[r.doc_id][at : s.start], "[secret]"]
            at = max(at, s.end)
        assert r.text == "".join(want) + before[r.doc_id][at:] and r.n_chars == len(r.text)
    mixed = cp.mixing_stage(spark, clean, SMALL)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(ids)
    assert mixed.groupBy("doc_id").count().where("count > 2").isEmpty()
    encoded = cp.encoding_stage(spark, mixed, SMALL)
    assert encoded.count() == mixed.count() and encoded.where(F.octet_length("ids") != 4 * F.col("n_tokens")).isEmpty()


def test_near_duplicates_leave_no_tables_but_who_goes(spark, docs):
    with common.scratch(spark):
        count = cp.near_duplicate_stage(spark, docs, SMALL).count()
        assert count > 0 and [path.rpartition("/")[2].partition("-")[0] for path in common._SCRATCH[-1]] == ["gone"]


def test_run_and_odd_tables(spark, docs, rows):
    digest = lambda df: hashlib.sha256(str(sorted(map(tuple, df.select("doc_id", "n_tokens").collect()))).encode()).hexdigest()
    assert digest(cp.run(spark, SMALL)) == digest(cp.run(spark, SMALL))
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SMALL).collect() == []
        out = stage(spark, docs, SMALL)
        assert out.count() > 0
    twice = docs.union(docs)
    assert cp.near_duplicate_stage(spark, twice, SMALL).count() == cp.near_duplicate_stage(spark, docs, SMALL).count()


CLASHING = ["gone_id", "span_id", "span_hash", "span_list", "plan_id", "plan_rows", "plan_row", "leader", "predicted", "epoch", "_id", "__rows", "h"]


def test_clashing_columns_and_null_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.select("*", *(F.lit(f"{c} of ").alias(c) for c in CLASHING))
    for c in CLASHING:
        more = more.withColumn(c, F.concat(c, F.col("doc_id").cast("string")))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, more, SMALL)
        assert sorted(out.columns) == sorted(more.columns)
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING)
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs, SMALL).collect())


def test_null_ids_and_texts_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    nothing = spark.createDataFrame([(None, "some words without an id", None, None, None), (None, None, "en", "s", 0), (10**9, None, None, None, None)], docs.schema)
    docs.union(nothing).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in rows) >= 1 and len(rows) > 50


def test_rows_without_an_id_stay(spark):
    rows = [(None, "a text of its own that stays", "en", "one"), (None, "a text of its own that stays", "en", "two"), (7, "a text of its own that stays", "en", "b"), (7, "a text of its own that stays", "en", "a"), (8, None, "en", "c"), (9, "", "en", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sorted(map(tuple, cp.near_duplicate_stage(spark, docs, SMALL).collect()), key=repr)
    assert got == sorted([*rows[:2], rows[3], rows[4]], key=repr)
