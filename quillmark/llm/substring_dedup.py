"""Substring dedup on a compacted De Bruijn graph of words.

Windows of 13 words are the edges of the graph. Consecutive windows that share a minimizer (the least hash of the 4-word runs they
contain) are a nonbranching path inside one document, and equal windows have equal minimizers, so the graph
can be built in pieces by minimizer:

1. Minimizers that two different texts contain are found; a bit set of fixed size made from them only spares work later.
2. Paths with such a minimizer become rows with a digest of their words and their source coordinates. Equal paths are compacted
   to one, whose first source is the smallest document; a Spark join brings it back to every source.
3. A path met again in a later document repeats as a whole. Where a minimizer has paths of different content, the graph
   branches; the paths' first sources are opened into single windows there, and these are matched in the same way.

A minimizer's 64-bit hash and a 64-bit digest of the words at the source coordinates must both agree; the words themselves are not
compared again. Degrees are judged for a minimizer's whole bucket and not for each 12-word node: a bucket with one content has no
branching node. Hot paths are pre-aggregated before the shuffle and their join is left to Spark's skew handling; a document's own
spans are bounded by its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_until, map_rows, release, written

#: Words of a window, words of a minimizer, longest path in windows.
WINDOW, MINI, PATH = 13, 4, 64
#: Bits of the set of repeated minimizers, as a power of two (2^27 bits: 16 MB), and bits of one of its rows. A full set spares
#: nothing but loses nothing.
SET_BITS, ROW_BITS = 27, 19
#: Of _first_last(): whether one document comes after another one.
SEVERAL = "first < last or (first is not null and unnamed)"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def minimizers(words: list[bytes]) -> np.ndarray:
    """For each window its minimizer: the least hash of its 4-word runs."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    runs = n - MINI + 1
    mixed = np.zeros(runs, np.uint64)
    for j in range(MINI):
        mixed = (mixed ^ hashes[j : j + runs]) * _FACTORS[j]
        mixed ^= mixed >> np.uint64(29)
    best = mixed
    span, need = 1, WINDOW - MINI + 1
    while span < need:
        step = min(span, need - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return best


def paths(best: np.ndarray) -> np.ndarray:
    """Bounds of the paths: where the minimizer changes, and after PATH windows."""
    if not len(best):
        return np.zeros(1, np.int64)
    edges = np.concatenate([[0], np.flatnonzero(best[1:] != best[:-1]) + 1, [len(best)]])
    if (np.diff(edges) > PATH).any():
        edges = np.array([x for a, b in zip(edges, edges[1:], strict=False) for x in range(a, b, PATH)] + [len(best)])
    return edges


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _bit_set(repeated: DataFrame, bits: int) -> np.ndarray:
    """The minimizers' low bits as a set; rows of fixed size come to the driver, 2^bits bits in all at most."""
    low = F.col("mini").bitwiseAND(F.lit((1 << bits) - 1))
    row_bits = min(bits, ROW_BITS)
    placed = repeated.select(F.shiftright(low, row_bits).alias("row"), low.bitwiseAND(F.lit((1 << row_bits) - 1)).alias("bit")).repartition("row").sortWithinPartitions("row")

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, group in groupby(rows, itemgetter(0)):
            flags = np.zeros(1 << row_bits, np.uint8)
            for _, bit in group:
                flags[bit] = 1
            yield row, np.packbits(flags, bitorder="little").tobytes()

    whole = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << row_bits - 3
    for row, data in map_rows(placed, "row long, data binary", step).collect():
        whole[row * size : (row + 1) * size] = np.frombuffer(data, np.uint8)
    return whole


def _later() -> Column:
    """Whether doc_id is larger than first, the smallest id that is not null; a null id is larger than any other."""
    return F.coalesce(F.col("doc_id") > F.col("first"), F.col("first").isNotNull())


def _first_last() -> list[Column]:
    """The smallest and the largest id and whether one is null."""
    return [F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("unnamed")]


def repeated_spans(docs: DataFrame, set_bits: int = SET_BITS) -> DataFrame:
    """doc_id, h, start, n: n consecutive windows from word start on, each of which also starts in a document with a smaller id.

    docs: doc_id, h (64-bit text hash), data (UTF-8). Documents are told apart by doc_id and h. Spans may touch or repeat.
    """
    spark = docs.sparkSession

    def seen(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, h, data in rows:
            for mini in np.unique(minimizers(data.split())).view(np.int64).tolist():
                yield mini, h

    held = map_rows(docs, "mini long, h long", seen)
    repeated = held.groupBy("mini").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("mini")
    flags = spark.sparkContext.broadcast(_bit_set(repeated, set_bits))
    del held, repeated
    release(spark)

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        kept, digest = flags.value, xxhash.xxh3_64_intdigest
        for doc, h, data in rows:
            words = data.split()
            best = minimizers(words)
            low = best & np.uint64((1 << set_bits) - 1)
            bounds = paths(best)
            first = low[bounds[:-1]].astype(np.int64)
            chosen = np.flatnonzero(kept[first >> 3] >> (first & 7).astype(np.uint8) & 1)
            if not len(chosen):
                continue
            text = b" ".join(words)
            begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()
            for i in chosen.tolist():
                a, b = int(bounds[i]), int(bounds[i + 1])
                each = np.array([digest(text[begins[j] : begins[j + WINDOW] - 1]) for j in range(a, b)], np.uint64)
                yield _signed(int(best[a])), _signed(digest(text[begins[a] : begins[b + WINDOW - 1] - 1])), doc, h, a, b - a, each.tobytes()

    cuts, done_with_cuts = kept_until(map_rows(docs, "mini long, path long, doc_id long, h long, start int, n int, windows binary", cut), "paths")
    contents = cuts.groupBy("mini", "path").agg(F.min("doc_id").alias("first"))
    branches = contents.groupBy("mini").agg((F.count("*") > 1).alias("branches"))
    compact = contents.join(branches, "mini")
    again = _later()
    met = cuts.join(compact, ["mini", "path"]).where(again | F.col("branches"))
    met = written(met.select("mini", "doc_id", "h", "start", "n", F.when(~again, F.col("windows")).alias("windows")), "met")
    del cuts, contents, branches, compact
    done_with_cuts()
    release(spark)

    def opened(rows: Iterator[tuple]) -> Iterator[tuple]:
        for mini, doc, h, start, windows in rows:
            for j, one in enumerate(np.frombuffer(windows, np.int64).tolist()):
                yield mini, one, doc, h, start + j

    single = map_rows(met.where("windows is not null").select("mini", "doc_id", "h", "start", "windows"), "mini long, one long, doc_id long, h long, start int", opened)
    single, done_with_single = kept_until(single, "windows")
    least = single.groupBy("mini", "one").agg(*_first_last()).where(SEVERAL).select("mini", "one", "first")
    branched = single.join(least, ["mini", "one"]).where(_later()).select("doc_id", "h", "start", F.lit(1).alias("n"))
    spans = written(met.where("windows is null").select("doc_id", "h", "start", "n").union(branched), "spans")
    del single, least, branched, met
    done_with_single()
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, set_bits: int = SET_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) of every whole text.

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id. Words are what ASCII white space
    divides; null texts have none, and texts under 13 words lose none. Null ids count as larger than any other, none of them as
    smaller than another, and stay null. doc_id and text are the key: repeated rows give equal rows, and rows that share an id, or
    have none, keep their own spans. An empty table gives none; other columns are not carried on.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    # copies of a text with a smaller id repeat as a whole; their paths need no rows of their own
    copies = rows.select("doc_id", "h", F.md5("data").alias("m"))
    firsts = copies.groupBy("h", "m").agg(*_first_last()).where(SEVERAL).select("h", "m", "first")
    copied = copies.join(firsts, ["h", "m"]).where(_later()).select("doc_id", "h", F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("n")).distinct()
    spans = repeated_spans(rows, set_bits).union(copied)
    place = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    spans = spans.select("doc_id", "h", place.alias("place")).groupBy("doc_id", "h").agg(F.collect_set("place").alias("places"))

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, data, places in rows:
            words = data.split()
            gone = np.zeros(len(words) + 1, np.int64)
            if len(words) >= WINDOW:
                for x in places or ():
                    start, n = x >> 32, x & (1 << 32) - 1
                    gone[start] += 1
                    gone[min(start + n + WINDOW - 1, len(words))] -= 1
            covered = np.cumsum(gone[:-1]) > 0
            kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c] if covered.any() else words
            yield doc, len(words), len(words) - len(kept), b" ".join(kept).decode()

    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("h").alias("span_h"), "places")
    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("h") == F.col("span_h")), "left").select("doc_id", "data", "places")
    return map_rows(both, "doc_id long, n_words long, n_removed long, kept string", step)


