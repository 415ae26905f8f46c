"""B1 to B3 kept up to date: immutable segments of new, changed and removed sources, and a manifest that names the ones that count.

A batch writes one segment: a log of its sources, the texts that came in and the terms of their passages, the sources whose passages no longer
count, and what df and lengths change by. Quotes aren't stored, as they hold each text twice: they are cut when passages are read. Postings
are a passage's terms, counted when they are read. Texts and terms aren't moved; ids go to where they are read. No earlier file is touched.
A version is a folder with the list of its segments, written last, so readers see the version before a batch or the one after it. One
writer at a time.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import committed, remove
from . import prepare, retrieval
from .prepare import SENT

#: The tables of a segment; seg is the number of the segment.
TABLES = {
    "log": "source_id long, digest string, lang string, seg long",
    "texts": "source_id long, lang string, text string, seg long",
    "passages": "source_id long, passage_no int, n_terms int, terms array<string>, seg long",
    "dead": "source_id long, seg long",
    "terms": "term string, df long, seg long",
    "sizes": "n_passages long, n_terms long, seg long",
}
#: Bytes of ids, with a fact each, that are broadcast at most; more are joined by a shuffle. Ids in one row of them.
HELD, TOGETHER = 1 << 26, 64
#: How texts and terms are stored: neighbouring passages share half of their terms, and a file has few distinct ones.
STORED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def _paths(spark: SparkSession, folder: str, version: int | None = None) -> list[str]:
    """The folders of a version's segments; only their names reach the driver."""
    known = committed(spark, f"{folder}/versions", "version")
    if version is not None and version not in known:
        raise ValueError(f"version {version} is not among {known}")
    return [r.path for r in spark.read.parquet(f"{folder}/versions/version={version or known[-1]}").collect()] if known else []


def open_index(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of all segments of a version, the newest if none is named. An index without versions has empty tables."""
    paths = _paths(spark, folder, version)
    return {name: spark.read.schema(ddl).parquet(*(f"{p}/{name}.parquet" for p in paths)) if paths else spark.createDataFrame([], ddl) for name, ddl in TABLES.items()}


def _next(spark: SparkSession, folder: str) -> tuple[int, str]:
    known = committed(spark, f"{folder}/versions", "version")
    number = known[-1] + 1 if known else 1
    return number, f"{folder}/segments/{number}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, path: str, name: str) -> None:
    """df as rows of a table of the segment, or of a step to one."""
    df.write.mode("append").options(**STORED).parquet(f"{path}/{name}.parquet")


def _written(df: DataFrame, path: str, name: str) -> DataFrame:
    """_stored(), and the rows that are there by then."""
    _stored(df, path, name)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}.parquet")


def _commit(spark: SparkSession, folder: str, number: int, paths: list[str]) -> int:
    spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/version={number}")
    return number


def _told(rows: DataFrame, facts: DataFrame, size: int = 16) -> DataFrame:
    """rows with the fact of their source_id, null if there is none. facts: source_id (once each) and fact, of size bytes together.

    Up to HELD bytes of facts are sent to where rows are read, packed by a hash of their id, as a row for each takes several times the memory.
    """
    n = facts.count()
    if n * size > HELD:
        return rows.join(facts, "source_id", "left")
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(n // TOGETHER + 1))
    packed = facts.groupBy(bucket.alias("bucket")).agg(F.map_from_entries(F.collect_list(F.struct("source_id", "fact"))).alias("told"))
    met = rows.withColumn("bucket", bucket).join(F.broadcast(packed), "bucket", "left")
    return met.select(*rows.columns, F.col("told")[F.col("source_id")].alias("fact"))


def _live(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """rows but those of segments before the one in which their source was given up."""
    since = dead.groupBy("source_id").agg(F.max("seg").alias("fact"))
    return _told(rows, since).where("fact is null or seg >= fact").select(*rows.columns)


def _latest(log: DataFrame) -> DataFrame:
    return log.groupBy("source_id").agg(F.max_by(F.struct("digest", "lang"), "seg").alias("last")).select("source_id", "last.digest", "last.lang")


def _first(held: DataFrame) -> DataFrame:
    """digest, source_id and lang of the source that stands for a text (A3)."""
    return held.where("digest is not null").groupBy("digest").agg(F.min(F.struct("source_id", "lang")).alias("one")).select("digest", "one.source_id", "one.lang")


def _same(x: str, y: str) -> Column:
    return (F.col(f"{x}.digest") == F.col(f"{y}.digest")) & (F.col(f"{x}.source_id") == F.col(f"{y}.source_id")) & F.col(f"{x}.lang").eqNullSafe(F.col(f"{y}.lang"))


def _sizes(passages: DataFrame) -> DataFrame:
    return passages.agg(F.count("*").alias("n_passages"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms"))


def _texts(rows: DataFrame, entries: DataFrame, new: DataFrame, steps: str) -> DataFrame:
    """source_id, lang and text of the new sources of a batch. rows: source_id, text, lang, digest; entries: what counts of each id, and its
    number of rows. Only the texts of ids that repeat are moved."""
    odd = entries.join(new.withColumn("new", F.lit(1)), "source_id", "left").where("n > 1 or new is null")
    odd = _written(odd.select("source_id", F.coalesce("new", F.lit(0)).cast("long").alias("fact")), steps, "odd")
    each = _told(rows.select("source_id", "lang", "text"), odd).where("fact is null").select("source_id", "lang", "text")
    if odd.where("fact = 1").isEmpty():
        return each
    again = entries.join(odd.where("fact = 1"), "source_id").select(F.col("source_id").alias("id"), F.col("digest").alias("of"), F.col("lang").alias("said"))
    own = (F.col("source_id") == F.col("id")) & (F.col("digest") == F.col("of")) & F.col("lang").eqNullSafe(F.col("said"))
    return each.union(rows.join(F.broadcast(again) if again.count() <= SENT else again, own).select("source_id", "lang", "text").dropDuplicates(["source_id"]))


def apply_batch(spark: SparkSession, folder: str, sources: DataFrame, removed: DataFrame | None = None) -> int:
    """Adds a batch of sources (source_id, text, lang) and takes those of removed (source_id) out; the number of the new version.

    A source that is known is changed. Of rows that repeat an id in a batch, the one with the least digest, then lang, counts. An id in both is
    added. Null texts are copies of each other and not of empty ones, as in A3; rows with a null id are left out, unknown removed
    ids do nothing. Only texts that no live source has are cut up: where another source comes to stand for a known text, its text and
    terms are copied, and nothing is counted. Of the log only rows of the batch's sources and texts are moved; terms are read for what goes.

    sources are read twice, first for their digests and then for the texts that are new, and must stay as they are meanwhile; a batch whose new
    ids aren't as many the second time is refused.
    """
    old, (seg, path), steps = open_index(spark, folder), _next(spark, folder), f"{folder}/steps/{uuid.uuid4().hex}"
    numbered = lambda df: df.withColumn("seg", F.lit(seg).cast("long"))
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    rows = sources.where("source_id is not null").select(F.col("source_id").cast("long"), "text", "lang", digest.alias("digest"))
    batch = _written(rows.groupBy("source_id").agg(F.min(F.struct("digest", "lang")).alias("one"), F.count("*").alias("n")).select("source_id", "one.*", "n"), steps, "batch")
    entries = batch.select("source_id", "digest", "lang")
    if removed is not None:
        out = removed.where("source_id is not null").select(F.col("source_id").cast("long")).distinct().join(entries, "source_id", "left_anti")
        entries = entries.union(out.select("source_id", F.lit(None).cast("string"), F.lit(None).cast("string")))
    log = _written(numbered(entries), path, "log").drop("seg")

    # the texts that the batch touches, and who had them
    past = _latest(old["log"].join(log.select("source_id"), "source_id", "left_semi"))
    touched = _written(log.select("digest").union(past.select("digest")).where("digest is not null").distinct(), steps, "touched")
    ids = old["log"].join(touched, "digest", "left_semi").select("source_id").distinct()
    held = _written(_latest(old["log"].join(ids, "source_id", "left_semi")).join(touched, "digest", "left_semi").select("source_id", "digest", "lang"), steps, "held")
    before = _written(_first(held), steps, "before")
    after = _written(_first(held.join(log.select("source_id"), "source_id", "left_anti").union(log.select("source_id", "digest", "lang"))), steps, "after")
    fresh = _written(after.alias("x").join(before.alias("y"), _same("x", "y"), "left_anti"), steps, "fresh")
    dead = numbered(before.alias("x").join(after.alias("y"), _same("x", "y"), "left_anti").select("source_id"))
    _stored(dead, path, "dead")

    new = _written(fresh.join(before.select("digest"), "digest", "left_anti").select("source_id"), steps, "new")
    texts = _written(numbered(_texts(rows, batch, new, steps)), path, "texts")
    if texts.count() != new.count():
        raise ValueError("the batch's sources changed while they were read")
    passages = _written(numbered(prepare.passage_terms(texts)), path, "passages")

    lost = _written(before.join(after.select("digest"), "digest", "left_anti").select("source_id", F.lit(1).alias("fact")), steps, "lost")
    off = _told(_live(old["passages"], old["dead"]), lost).where("fact is not null")
    of = lambda df, n: df.select(F.explode(F.array_distinct("terms")).alias("term"), F.lit(n).alias("df"))
    _stored(numbered(of(passages, 1).union(of(off, -1)).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")), path, "terms")
    sizes = _sizes(passages).union(_sizes(off).select(-F.col("n_passages"), -F.col("n_terms")))
    _stored(numbered(sizes.agg(F.sum("n_passages").alias("n_passages"), F.sum("n_terms").alias("n_terms"))), path, "sizes")

    # texts that another source stands for
    now = F.struct(F.col("x.source_id").alias("now"), F.col("x.lang").alias("said"))
    moved = _written(fresh.alias("x").join(before.alias("y"), "digest").select(F.col("y.source_id").alias("source_id"), now.alias("fact")), steps, "moved")
    if not moved.isEmpty():
        for name, size in (("texts", 48), ("passages", 16)):
            facts = moved if name == "texts" else moved.select("source_id", F.col("fact.now").alias("fact"))
            own = {"source_id": "fact.now", "lang": "fact.said"} if name == "texts" else {"source_id": "fact"}
            copied = _told(_live(old[name], old["dead"]), facts, size).where("fact is not null")
            _stored(numbered(copied.select(*(F.col(own.get(c, c)).alias(c) for c in old[name].columns if c != "seg"))), path, name)
    remove(spark, steps)
    return _commit(spark, folder, seg, [*_paths(spark, folder), path])


def live_tables(index: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """passages, postings, corpus and stats (B1 to B3) of the sources that count, equal to those built anew from them.

    corpus and stats are sums of the segments' changes; no terms are read for them. Passages are cut from their texts when they are read,
    postings are counted from the terms of their passages.
    """
    sums = index["sizes"].agg(F.coalesce(F.sum("n_passages"), F.lit(0)).alias("n_passages"), F.sum("n_terms").alias("n_terms"))
    corpus = sums.select("n_passages", F.when(F.col("n_passages") > 0, F.col("n_terms") / F.col("n_passages")).alias("mean_terms"))
    counted = index["terms"].groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    passages, postings = prepare.split_passages(_live(index["texts"], index["dead"])), retrieval.passage_postings(_live(index["passages"], index["dead"]))
    return {"passages": passages, "postings": postings, "corpus": corpus, "stats": retrieval.with_idf(counted, corpus)}


def merge_segments(spark: SparkSession, folder: str) -> int:
    """A new version of one segment with the rows that count, and no others. Readers of earlier versions aren't disturbed."""
    old, (seg, path) = open_index(spark, folder), _next(spark, folder)
    numbered = lambda df: df.withColumn("seg", F.lit(seg).cast("long"))
    _stored(numbered(_latest(old["log"]).where("digest is not null")), path, "log")
    for name in ("texts", "passages"):
        _stored(numbered(_live(old[name], old["dead"])), path, name)
    _stored(old["dead"].where("false"), path, "dead")
    _stored(numbered(live_tables(old)["stats"].select("term", "df")), path, "terms")
    sums = old["sizes"].agg(F.coalesce(F.sum("n_passages"), F.lit(0)).alias("n_passages"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms"))
    _stored(numbered(sums), path, "sizes")
    return _commit(spark, folder, seg, [path])
