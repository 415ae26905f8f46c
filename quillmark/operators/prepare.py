"""A: preparing sources."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions.text import pieces, terms
from ..sources.tables import write_table


def select_language(sources: DataFrame, content_language: str = params.CONTENT_LANGUAGE) -> DataFrame:
    """A1: sources in the wanted language of the answers, which are extracts; the filter reaches the scan."""
    return sources.where(F.col("lang") == content_language)


def split_passages(sources: DataFrame, size: int = params.SIZE, stride: int = params.STRIDE) -> DataFrame:
    """A2: overlapping word windows with verbatim character spans.

    A text without words has no passage. Positions add up over blocks of stride words, and over groups of blocks, so that the time
    grows with the text and not faster.
    """
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda s, x: s + x)

    def places(p):
        """Where each block of stride words begins."""
        blocks = F.greatest(F.lit(1), F.ceil((F.size(p) - size) / F.lit(stride)) + 1).cast("int")
        lengths = F.transform(F.sequence(F.lit(0), blocks - 1), lambda n: F.length(F.array_join(F.slice(p, n * stride + 1, stride), "")))
        return F.flatten(F.transform(F.array(lengths), in_groups))

    def in_groups(lengths):
        of = lambda i: F.floor(i / params.BLOCKS).cast("int")
        sums = F.transform(F.sequence(F.lit(0), of(F.size(lengths) - 1)), lambda g: total(F.slice(lengths, g * params.BLOCKS + 1, params.BLOCKS)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        add = lambda state, x: F.struct((state["at"] + x).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))
        begins = F.aggregate(sums, start, add, lambda state: state["starts"])
        each = lambda starts: F.transform(lengths, lambda _, i: F.get(starts, of(i)) + total(F.slice(lengths, of(i) * params.BLOCKS + 1, i % params.BLOCKS)))
        return F.flatten(F.transform(F.array(begins), each))

    def cut(p):
        one = lambda at, i: F.struct(at.alias("char_start"), F.array_join(F.slice(p, i * stride + 1, size), "").alias("quote"))
        return F.flatten(F.transform(F.array(places(p)), lambda starts: F.transform(starts, one)))

    # one-element transforms name a value, so that the text is cut up once and not once a passage; the array is exploded where it is made,
    # as Spark filters a named one by its size first, and so would cut up the text twice
    each = sources.select("source_id", "lang", F.posexplode(F.flatten(F.transform(F.array(pieces(F.col("text"))), cut))).alias("passage_no", "p"))
    rows = each.select("source_id", "passage_no", "lang", "p.char_start", "p.quote").where("quote != ''")
    return rows.select("source_id", "passage_no", "lang", "char_start", F.length("quote").alias("char_len"), F.size(terms(F.col("quote"))).alias("n_terms"), "quote")


def passage_terms(sources: DataFrame, size: int = params.SIZE, stride: int = params.STRIDE) -> DataFrame:
    """source_id, passage_no, n_terms and terms (in order, repeats included) of the passages of split_passages(),
    without their quotes. Terms end where words do, so those of each block of words are read once for all passages that have the block.
    """
    m, r = size // math.gcd(size, stride), stride // math.gcd(size, stride)
    cut = lambda b, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.flatten(_span(b, i * r, m)))
    # exploded where it is made, as in split_passages()
    each = sources.select("source_id", F.posexplode(_of_blocks(F.col("text"), size, stride, cut)).alias("passage_no", "terms"))
    return each.select("source_id", "passage_no", F.size("terms").alias("n_terms"), "terms")


def block_terms(sources: DataFrame, size: int = params.SIZE, stride: int = params.STRIDE, keep: tuple[str, ...] = ()) -> DataFrame:
    """source_id, the columns keep, terms of each block of words, and covers: passage_no and n_terms of the passages that have the block.

    For what needs a part of the terms, or sums over passages: it has each term once and not once a passage.
    """
    m, r = size // math.gcd(size, stride), stride // math.gcd(size, stride)

    def cut(b, n):
        total = lambda i: F.aggregate(F.transform(_span(b, i * r, m), F.size), F.lit(0), lambda x, y: x + y)
        of = lambda j: F.filter(F.array(*(F.floor(j / r).cast("int") - d for d in range((m - 1) // r + 1))), lambda i: (i >= 0) & (i < n) & (i * r + m > j))
        covers = lambda j: F.transform(of(j), lambda i: F.struct(i.alias("passage_no"), total(i).alias("n_terms")))
        return F.transform(b, lambda x, j: F.struct(covers(j).alias("covers"), x.alias("terms")))

    each = sources.select("source_id", *keep, F.explode(_of_blocks(F.col("text"), size, stride, cut)).alias("b"))
    return each.select("source_id", *keep, "b.covers", "b.terms")


def _span(x, at, n: int):
    return F.slice(x, (at + 1).cast("int"), n)


def _of_blocks(text, size: int, stride: int, cut):
    """cut(terms of each block of words, number of passages) of a text with words, else an empty array."""
    step = math.gcd(size, stride)

    def of(p):
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / F.lit(step)).cast("int") - 1), lambda j: terms(F.array_join(_span(p, j * step, step), "")))
        n = F.greatest(F.lit(1), F.ceil((F.size(p) - size) / F.lit(stride)) + 1).cast("int")
        return F.flatten(F.transform(F.array(blocks), lambda b: cut(b, n)))

    # a filter and one-element transforms name a value, so that the text is cut up once
    return F.flatten(F.transform(F.filter(F.array(pieces(text)), lambda p: F.size(p) > 0), of))


def duplicate_map(sources: DataFrame) -> DataFrame:
    """A3: source_id and canonical_id, the lowest id with the same text. Membership stays in rows, so a text with very many copies is
    never one value. Sources without a text (null) are copies of each other, and not of those with an empty one."""
    marked = sources.select("source_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"))
    return marked.join(marked.groupBy("digest").agg(F.min("source_id").alias("canonical_id")), "digest").select("source_id", "canonical_id")


def collapse_duplicates(sources: DataFrame) -> DataFrame:
    """A3: the canonical source of each text."""
    return sources.join(duplicate_map(sources).where("source_id = canonical_id").select("source_id"), "source_id", "left_semi")


#: Ids that are broadcast at most (16 MB); more are joined by a shuffle.
SENT = 1 << 20


def first_sources(sources: DataFrame, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """A3 as collapse_duplicates(), in rows whose source_id is there once and rows of ids that repeat (None: there are no such).

    Only ids and digests move. The ids that are no first source or repeat are written to folder and, up to SENT of them, broadcast, so
    that texts stay where they are read.
    """
    is_first = F.max(F.col("source_id") == F.col("canonical_id"))
    told = duplicate_map(sources).groupBy("source_id").agg((F.count("*") > 1).alias("repeated"), is_first.alias("first")).where("repeated or not first")
    odd = write_table(told, folder, "odd")
    few = odd.count() <= SENT
    met = sources.where("source_id is not null").join(F.broadcast(odd) if few else odd, "source_id", "left")
    again = None if odd.where("repeated and first").isEmpty() else met.where("repeated and first").select(*sources.columns)
    return met.where("repeated is null").select(*sources.columns), again
