"""B and C over an index: postings in blocks clustered by term, top passages through bounds of blocks, short quotes through positions.

A block holds the postings of one term within one range of passages, with the largest tf and the smallest passage among them. Blocks lie in
folders by slot (a hash of the term), sorted by term, so a batch of questions reads only the slots of its terms. The blocks of a term
with many postings are split into pieces, so no task of a join gets all of them.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.text import words
from .prepare import SENT
from .qa import top_passages


def slot_count(n_postings: int) -> int:
    """Slots for so many postings: one for POSTINGS_PER_SLOT of them, MOST_SLOTS at most."""
    return min(params.MOST_SLOTS, max(1, math.ceil(n_postings / params.POSTINGS_PER_SLOT)))


def term_layout(stats: DataFrame, n_slots: int, split: int = params.SPLIT) -> DataFrame:
    """B2 with the slot of each term and the pieces that its blocks are split into."""
    return stats.withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(n_slots)).cast("int")).withColumn("pieces", F.ceil(F.col("df") / F.lit(split)).cast("int"))


def range_of(n_passages: Column, size: int) -> Column:
    """The range of a posting: size passages, about; a very long source is spread over several."""
    return F.pmod(F.xxhash64("source_id", F.floor(F.col("passage_no") / size)), F.ceil(n_passages / size))


def build_blocks(postings: DataFrame, layout: DataFrame, corpus: DataFrame, size: int = params.RANGE) -> DataFrame:
    """B1 in blocks: slot, term, piece, range, max_tf, min_terms, postings (array of source_id, passage_no, tf, n_terms).

    A block has at most the passages of its range. Blocks are grouped by term and range, never by term alone.
    """
    ranged = postings.crossJoin(F.broadcast(corpus.select("n_passages"))).withColumn("range", range_of(F.col("n_passages"), size)).drop("n_passages")
    one = F.struct("source_id", "passage_no", "tf", "n_terms")
    blocks = ranged.groupBy("term", "range").agg(F.max("tf").alias("max_tf"), F.min("n_terms").alias("min_terms"), F.sort_array(F.collect_list(one)).alias("postings"))
    placed = blocks.join(layout.select("term", "slot", "pieces"), "term")
    return placed.select("term", F.pmod("range", F.col("pieces")).cast("int").alias("piece"), "range", "max_tf", "min_terms", "postings", "slot")


def batch_blocks(each: DataFrame, wanted: DataFrame, corpus: DataFrame, size: int = params.RANGE) -> DataFrame:
    """The blocks of build_blocks() for the terms of a batch (wanted: term, slot, pieces), from prepare.block_terms(), dealt and sorted by slot.

    Postings of other terms are left out where passages are read; those that stay move once.
    """
    layout = wanted.select("term", "slot", "pieces").distinct()
    few = layout.count() <= SENT
    met = each.select("source_id", "covers", F.explode("terms").alias("term")).join(F.broadcast(layout) if few else layout, "term")
    rows = met.select("source_id", "term", "slot", "pieces", F.explode("covers").alias("c")).select("source_id", "c.passage_no", "c.n_terms", "term", "slot", "pieces")
    ranged = rows.crossJoin(F.broadcast(corpus.select("n_passages"))).withColumn("range", range_of(F.col("n_passages"), size))
    dealt = ranged.withColumn("piece", F.pmod("range", F.col("pieces")).cast("int")).drop("pieces", "n_passages").repartition("slot", "piece")
    counted = dealt.groupBy("slot", "piece", "term", "range", "source_id", "passage_no", "n_terms").agg(F.count("*").alias("tf"))
    one = F.struct("source_id", "passage_no", "tf", "n_terms")
    blocks = counted.groupBy("slot", "piece", "term", "range").agg(F.max("tf").alias("max_tf"), F.min("n_terms").alias("min_terms"), F.sort_array(F.collect_list(one)).alias("postings"))
    return blocks.select("term", "piece", "range", "max_tf", "min_terms", "postings", "slot").sortWithinPartitions("slot", "term", "range")


def in_slots(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The blocks in the slots of the wanted terms; the driver sees the slots' numbers, of which there are MOST_SLOTS at most."""
    return blocks.where(F.col("slot").isin([r.slot for r in wanted.select("slot").distinct().collect()]))


def _part(idf: Column, tf: Column, n_terms: Column, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_terms / F.col("mean_terms")))


def _opened(met: DataFrame, corpus: DataFrame) -> DataFrame:
    return met.select("question_id", "idf", F.explode("postings").alias("p")).select("question_id", "idf", "p.*").crossJoin(F.broadcast(corpus.select("mean_terms")))


def _summed(opened: DataFrame, k1: float, b: float) -> DataFrame:
    part = _part(F.col("idf"), F.col("tf"), F.col("n_terms"), k1, b)
    return opened.groupBy("question_id", "source_id", "passage_no").agg(F.round(F.sum(part), 6).alias("score"))


def by_pieces(wanted: DataFrame) -> DataFrame:
    """wanted with a row for each piece of its terms' blocks."""
    return wanted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))


def score_blocks(wanted: DataFrame, blocks: DataFrame, corpus: DataFrame, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """C3 from blocks: BM25 of each question and passage that share a term. wanted: question_id, term, idf, slot, pieces."""
    met = in_slots(blocks, wanted).join(by_pieces(wanted), ["term", "piece"])
    return _summed(_opened(met, corpus), k1, b)


def range_bounds(wanted: DataFrame, blocks: DataFrame, corpus: DataFrame, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """question_id, range, bound: no passage of the range has a higher score. Reads the blocks' heads and not their postings."""
    heads = blocks.select("term", "piece", "range", "max_tf", "min_terms").join(by_pieces(wanted), ["term", "piece"]).crossJoin(F.broadcast(corpus.select("mean_terms")))
    return heads.groupBy("question_id", "range").agg(F.sum(_part(F.col("idf"), F.col("max_tf"), F.col("min_terms"), k1, b)).alias("bound"))


def postings_in(ranges: DataFrame, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks of each question's terms within its ranges (question_id, range), opened by _opened()."""
    asked = ranges.select("question_id", "range").join(wanted.select("question_id", "term", "idf"), "question_id")
    return blocks.select("term", "range", "postings").join(asked, ["term", "range"])


def promising(wanted: DataFrame, blocks: DataFrame, corpus: DataFrame, k: int = params.TOP_K, per_source: int = params.PER_SOURCE, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """question_id and range of all ranges that may hold one of the question's top k passages.

    The k ranges of the highest bounds are scored in full. The k-th best passage found there, under the limit of each source, is a
    threshold that the top k can't fall below; ranges with a bound under it are left out. A question that finds fewer than k keeps all.
    """
    bounds = range_bounds(wanted, blocks, corpus, k1, b)
    order = Window.partitionBy("question_id").orderBy(F.desc("bound"), "range")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    found = top_passages(_summed(_opened(postings_in(first, wanted, blocks), corpus), k1, b), k, per_source)
    least = found.where(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
    # scores are rounded to six digits
    return bounds.join(least, "question_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).select("question_id", "range")


def top_by_blocks(wanted: DataFrame, blocks: DataFrame, corpus: DataFrame, k: int = params.TOP_K, per_source: int = params.PER_SOURCE, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """C4, the same rows as of all scores, from the blocks that may hold them."""
    own = in_slots(blocks, wanted)
    ranges = promising(wanted, own, corpus, k, per_source, k1, b)
    return top_passages(_summed(_opened(postings_in(ranges, wanted, own), corpus), k1, b), k, per_source)


def build_positions(sources: DataFrame) -> DataFrame:
    """word, source_id, places: where each word of a source's text stands, from 0. Null texts have no words; a repeated source_id with
    equal text repeats places."""
    each = sources.select("source_id", F.posexplode(words(F.col("text"))).alias("place", "word"))
    return each.groupBy("word", "source_id").agg(F.sort_array(F.collect_list("place")).alias("places"))


def build_grams(positions: DataFrame) -> DataFrame:
    """gram, word: the runs of up to GRAM characters within each distinct word, for words of which a quote shows only a part."""
    known = positions.groupBy("word").agg(F.count("*").alias("n_sources")).select("word", "n_sources")
    length = F.length("word")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(params.GRAM), length)), lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda at: F.substring("word", at, n))))
    return known.select("word", "n_sources", F.explode(F.array_distinct(runs)).alias("gram"))


def _part_words(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """asked (quote_id, word, side) with the distinct known words that hold the shown part: at their end (side "first"), at their start
    ("last") or anywhere ("only"). They are found by the rarest of the part's runs of characters."""
    length = F.least(F.lit(params.GRAM), F.length("word"))
    runs = F.transform(F.sequence(F.lit(1), F.length("word") - length + 1), lambda at: F.substring("word", at, length))
    each = asked.select("quote_id", "word", "side", F.explode(F.array_distinct(runs)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("quote_id", "side").orderBy("n", "gram")
    # a run that no known word holds: nor does any hold the part
    rarest = each.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("place", F.row_number().over(order)).where("place = 1")
    met = rarest.select("quote_id", "side", F.col("word").alias("shown"), "gram").join(grams.select("gram", "word"), "gram")
    fits = F.when(F.col("side") == "first", F.endswith("word", F.col("shown"))).when(F.col("side") == "last", F.startswith("word", F.col("shown"))).otherwise(F.contains("word", F.col("shown")))
    return met.where(fits).select("quote_id", "side", "word")


def find_short_quotes(quotes: DataFrame, sources: DataFrame, positions: DataFrame, grams: DataFrame) -> DataFrame:
    """C9 for quotes of any number of words but none: quote_id, source_id, position (from 1) of every source that holds it verbatim.

    quotes: quote_id, quote. The first and last word of a quote may be parts of words. The words between are looked up as they are: the
    rarest of them gives places, and every other one must stand at its distance from there. Quotes of two words or one are looked up
    by the known words that hold their rarer part. Texts are met only by the sources found, to compare the white space and the parts.
    Null quotes and quotes without words have no rows.
    """
    cut = quotes.select("quote_id", words(F.col("quote")).alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    # three words and more: those between
    inner = cut.where("n > 2").select("quote_id", F.posexplode(F.slice("w", F.lit(2), F.col("n") - 2)).alias("at", "word"), (F.col("n") - 2).alias("n"))
    held = positions.select("word", "source_id", "places")
    counts = inner.select("word").distinct().join(held.select("word"), "word").groupBy("word").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("quote_id").orderBy("df", "at")
    known = inner.join(counts, "word", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("place", F.row_number().over(rare))
    start = known.where("place = 1").join(held, "word").select("quote_id", "n", "source_id", F.explode("places").alias("p"), "at").select("quote_id", "n", "source_id", (F.col("p") - F.col("at")).alias("start")).where("start > 0")
    others = start.join(known.where("place > 1").select("quote_id", "at", "word"), "quote_id").join(held, ["word", "source_id"]).where(F.array_contains("places", F.col("start") + F.col("at")))
    all_there = others.groupBy("quote_id", "source_id", "start", "n").agg(F.count("*").alias("met")).where("met = n - 1").select("quote_id", "source_id")
    of_three = start.where("n = 1").select("quote_id", "source_id").union(all_there)
    # one or two words: the parts that are shown
    only = cut.where("n = 1").select("quote_id", F.col("w")[0].alias("word"), F.lit("only").alias("side"))
    both = cut.where("n = 2").select("quote_id", F.posexplode("w").alias("at", "word")).select("quote_id", "word", F.when(F.col("at") == 0, "first").otherwise("last").alias("side"))
    parts = _part_words(only.union(both), grams)
    weights = parts.join(grams.select("word", "n_sources").distinct(), "word").groupBy("quote_id", "side").agg(F.sum("n_sources").alias("n"))
    # a quote of two words of which one is part of no known word is nowhere
    sides = Window.partitionBy("quote_id")
    rarer = weights.withColumn("sides", F.count("*").over(sides)).withColumn("place", F.row_number().over(sides.orderBy("n", "side"))).where("place = 1 and (side = 'only' or sides = 2)")
    of_parts = parts.join(rarer.select("quote_id", "side"), ["quote_id", "side"]).join(held, "word").select("quote_id", "source_id")
    met = of_three.union(of_parts).distinct().join(sources.select("source_id", "text"), "source_id").join(quotes, "quote_id")
    return met.select("quote_id", "source_id", F.instr("text", F.col("quote")).alias("position")).where("position > 0")
