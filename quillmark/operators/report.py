"""D: reports over the sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.text import pieces, sentences, terms
from .prepare import SENT


def source_report(sources: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents, distinct texts, characters and passages by origin and language, with subtotals (level: grouping_id).

    Distinct texts are counted from one row a text and group, so no task holds a group's texts at once.
    """
    counted = passages.groupBy("source_id").agg(F.count("*").alias("n"))
    each = sources.join(counted, "source_id", "left").select("origin", "lang", F.length("text").alias("chars"), F.coalesce("n", F.lit(0)).alias("n"), F.sha2("text", 256).alias("digest"))
    return each.rollup("origin", "lang").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("documents"), F.countDistinct("digest").alias("texts"), F.sum("chars").alias("chars"), F.sum("n").alias("passages"))


def key_terms(terms: DataFrame, stats: DataFrame, n: int = params.KEY_TERMS) -> DataFrame:
    """Origin, term, weight, rank: the terms of the largest tf-idf of each origin.

    terms: origin, term and n, how often it is there; they are added up where they are read, before they move.
    """
    by_origin = terms.groupBy("origin", "term").agg(F.sum("n").alias("tf"))
    weighed = by_origin.join(stats, "term").select("origin", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("weight"))
    order = Window.partitionBy("origin").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cited_summary(passages: DataFrame, sources: DataFrame, stats: DataFrame, n: int = params.SUMMARY) -> DataFrame:
    """D3: origin, rank, sentence, source_id, passage_no, weight: the sentences of the largest mean idf of each origin, of 5 terms or
    more; a sentence that several passages hold counts once, for the first of them."""
    said = passages.select("source_id", "passage_no", F.explode(sentences(F.col("quote"))).alias("sentence")).withColumn("sentence", F.trim("sentence"))
    said = said.where(F.size(terms(F.col("sentence"))) >= params.LEAST_TERMS)
    return summary_of(said.join(sources.select("source_id", "origin"), "source_id"), stats, n)


def summary_of(said: DataFrame, stats: DataFrame, n: int = params.SUMMARY) -> DataFrame:
    """cited_summary() of sentences: origin, source_id, passage_no, sentence."""
    first = said.groupBy("origin", "sentence").agg(F.min(F.struct("source_id", "passage_no")).alias("at"))
    each = first.select("origin", "sentence", "at", F.explode(terms(F.col("sentence"))).alias("term")).join(stats, "term")
    weighed = each.groupBy("origin", "sentence", "at").agg(F.round(F.avg("idf"), 6).alias("weight"))
    order = Window.partitionBy("origin").orderBy(F.desc("weight"), "at", "sentence")
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("origin", "rank", "sentence", "at.source_id", "at.passage_no", "weight")


def said_sentences(sources: DataFrame, keep: tuple[str, ...] = (), size: int = params.SIZE, stride: int = params.STRIDE) -> DataFrame:
    """source_id, the columns keep, passage_no, sentence and keys (hashes of its terms): the distinct sentences of LEAST_TERMS terms or
    more in the passages of prepare.split_passages(), without those that the passage before has, too."""
    keys = lambda x: F.transform(terms(x), lambda t: F.xxhash64(t))

    def of(p):
        n = F.greatest(F.lit(1), F.ceil((F.size(p) - size) / F.lit(stride)) + 1).cast("int")
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(sentences(F.array_join(F.slice(p, i * stride + 1, size), "")), lambda x: F.trim(x)))
        new = lambda s: F.transform(s, lambda x, i: F.array_except(x, F.coalesce(F.get(s, i - 1), F.array().cast("array<string>"))))
        return F.flatten(F.transform(F.array(each), new))

    # one-element transforms name a value, so that the text is cut up once
    each = sources.select("source_id", *keep, F.posexplode(F.flatten(F.transform(F.array(pieces(F.col("text"))), of))).alias("passage_no", "s"))
    rows = each.select("source_id", *keep, "passage_no", F.explode(F.transform("s", lambda x: F.struct(x.alias("sentence"), keys(x).alias("keys")))).alias("s"))
    return rows.select("source_id", *keep, "passage_no", "s.sentence", "s.keys").where(F.size("keys") >= params.LEAST_TERMS)


def known_terms(stats: DataFrame, most: int = params.KNOWN) -> tuple[np.ndarray, float, float]:
    """The most frequent terms, at most most of them, as sorted rows of key (hash), least and largest idf; and the least and largest idf of
    all other terms. Terms of one hash count together, so no bound is wrong for them. Its fixed size is what reaches the driver."""
    by_key = stats.groupBy(F.xxhash64("term").alias("key")).agg(F.max("df").alias("df"), F.min("idf").alias("lo"), F.max("idf").alias("hi"))
    level = F.floor(F.log2("df")).cast("int")
    counts = sorted(map(tuple, by_key.groupBy(level.alias("level")).agg(F.count("*"), F.min("lo"), F.max("hi")).collect()), reverse=True)
    cut, n = 64, 0
    for at, more, *_ in counts:
        if n + more > most:
            break
        cut, n = at, n + more
    others = [(lo, hi) for at, _, lo, hi in counts if at < cut]
    found = by_key.where(level >= cut).select("key", "lo", "hi").toArrow() if n else None
    table = np.empty(n, [("key", "<i8"), ("lo", "<f8"), ("hi", "<f8")])
    for name in table.dtype.names if n else ():
        table[name] = found.column(name).to_numpy()
    return np.sort(table, order="key"), min((lo for lo, _ in others), default=0.0), max((hi for _, hi in others), default=0.0)


def likely_sentences(said: DataFrame, stats: DataFrame, n: int = params.SUMMARY, most: int = params.KNOWN) -> DataFrame:
    """Of sentences (origin, source_id, passage_no, sentence, keys) all that may be among the n of the largest mean idf of their origin.

    The known terms give each sentence a lower and an upper bound. A task leaves out what is below the n-th largest lower bound of the
    different sentences that it has seen of the origin; so sentences are judged where they are read, and few move.
    """
    known = said.sparkSession.sparkContext.broadcast(known_terms(stats, most))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lo, hi = known.value
        best: dict[str | None, dict[str, float]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(4)
            keys, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            starts = starts - starts[0]
            at = np.minimum(np.searchsorted(table["key"], keys), max(len(table) - 1, 0))
            met = table["key"][at] == keys if len(table) else np.zeros(len(keys), bool)
            size = np.diff(starts)
            low, high = (np.add.reduceat(np.where(met, table[name][at] if len(table) else 0.0, other), starts[:-1]) / size for name, other in (("lo", lo), ("hi", hi)))
            named = batch.column(0).dictionary_encode(null_encoding="encode")
            origins, own = named.dictionary.to_pylist(), named.indices.to_numpy()
            # weights are rounded to six digits
            least = lambda o: min(best[o].values()) - 1e-5 if len(best.get(o, ())) >= n else -np.inf
            bars, kept = np.array([least(o) for o in origins]), []
            for i in np.flatnonzero(high >= bars[own]).tolist():
                if high[i] < bars[own[i]]:
                    continue
                kept.append(i)
                origin, sentence = origins[own[i]], batch.column(3)[i].as_py()
                top = best.setdefault(origin, {})
                if sentence not in top:
                    top[sentence] = float(low[i])
                    if len(top) > n:
                        del top[min(top, key=top.get)]
                    bars[own[i]] = least(origin)
            if kept:
                yield batch.take(pa.array(kept)).select([0, 1, 2, 3])

    rows = said.select("origin", "source_id", "passage_no", "sentence", "keys")
    return rows.mapInArrow(step, rows.drop("keys").schema)


def likely_summary(said: DataFrame, stats: DataFrame, n: int = params.SUMMARY) -> DataFrame:
    """summary_of() the sentences that likely_sentences() has left (said, written); their terms are broadcast, up to SENT of them."""
    asked = said.select(F.explode(terms(F.col("sentence"))).alias("term")).distinct()
    few = asked.count() <= SENT
    return summary_of(said, F.broadcast(stats.join(F.broadcast(asked), "term", "left_semi")) if few else stats, n)


def citation_coverage(questions: DataFrame, hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Origin, citations, questions, and share of all questions that cite it; the row without an origin counts answered ones."""
    cited = hits.select("question_id", "source_id").join(sources.select("source_id", "origin"), "source_id")
    each = cited.groupBy("origin", "question_id").agg(F.count("*").alias("n")).groupBy("origin").agg(F.sum("n").alias("citations"), F.count("*").alias("questions"))
    total = hits.groupBy("question_id").agg(F.count("*").alias("n")).agg(F.lit(None).cast("string").alias("origin"), F.coalesce(F.sum("n"), F.lit(0)).alias("citations"), F.count("*").alias("questions"))
    everyone = questions.agg(F.count("*").alias("asked"))
    return each.union(total).crossJoin(F.broadcast(everyone)).select("origin", "citations", "questions", F.round(F.col("questions") / F.col("asked"), 6).alias("share"))
