"""LM scoring by online logistic context mixing over the bits of word codes.

The most frequent words of the training documents are symbols of their own; every other word belongs to one of many buckets by its
hash, and each bucket is a symbol too. Symbols have Huffman codes and are coded bit by bit. Each bit has several predictors: counts
under hashed contexts (the place in the code alone, with the symbol before, with two symbols before, with the symbol before last),
gathered from all training documents. Their stretched probabilities are combined with weights from a gate that looks at how much
each predictor has seen. A document starts from the first weights, refines them after every block of words and keeps them to its
end. Within its bucket a word has its share of the bucket's counts, add one, and unseen words share one more count; so the model is
normalised over the same words as the base score.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, repeat
from math import log, log2, log10
from operator import itemgetter
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_planes, map_rows, planes, written

#: Words with a symbol of their own, buckets of the others.
OWN, BUCKETS = 1024, 1024
#: Known words are those whose counts travel with the model, the counts of the others stay in Spark: training words for each known
#: one, and bounds of their number.
WORDS_A_KNOWN, FEWEST_KNOWN, MOST_KNOWN = 256, 1 << 12, 1 << 18
#: Predictors, training words for each slot of a predictor's table, and bounds of the slots as powers of two.
ORDERS, WORDS_A_SLOT, FEWEST, MOST = 4, 64, 14, 21
#: Words after which the weights are refined, step of the refinement, gates (three levels for each predictor with a history).
BLOCK, RATE, GATES = 16, 0.02, 3 ** (ORDERS - 1)
#: Words of a document that are worked on at once (whole blocks), words of several documents together when scored and when
#: gathered, and bytes cut into words at once.
SEGMENT, GROUP, GATHERED, CUT = 1 << 15, 1 << 17, 1 << 18, 1 << 20
#: Distinct words a task counts before it hands them on, cells of a table that travel together.
COUNTED, CELLS = 200_000, 1 << 16
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def learned(doc_id: Column) -> Column:
    """Documents that are learned from; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, in lists of bounded size (a longer word is its own list); the last one ends with the end."""
    at = 0
    while len(data) - at > CUT:
        cut = at + CUT
        while cut > at and not data[cut - 1 : cut].isspace():
            cut -= 1
        if cut == at:
            cut = at + CUT
            while cut < len(data) and not data[cut : cut + 1].isspace():
                cut += 1
        yield data[at:cut].lower().split()
        at = cut
    yield [*data[at:].lower().split(), b""]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; empty: the end) and c, its count in docs (data: UTF-8). Tasks count first, then Spark adds up."""

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts: Counter[bytes] = Counter()
        for (data,) in rows:
            for words in word_lists(data):
                counts.update(words)
                if len(counts) > COUNTED:
                    yield from counts.items()
                    counts.clear()
        yield from counts.items()

    return map_rows(docs.select("data"), "word binary, c long", step).groupBy("word").agg(F.sum("c").alias("c"))


class Code:
    """Huffman codes of symbols with the given counts, as nodes and bits in flat arrays."""

    def __init__(self, counts: list[int]):
        heap = [(c, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}
        fresh = first = len(counts)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[x], above[y] = (fresh, 0), (fresh, 1)
            heapq.heappush(heap, (a + b, fresh, fresh))
            fresh += 1
        nodes, bits, lengths, starts = [], [], [], []
        for s in range(first):
            at, own = s, []
            while at in above:
                at, bit = above[at]
                own.append((at - first, bit))
            starts.append(len(nodes))
            lengths.append(len(own))
            nodes += [n for n, _ in reversed(own)]
            bits += [b for _, b in reversed(own)]
        self.lengths, self.starts = np.array(lengths, np.int64), np.array(starts, np.int64)
        self.nodes, self.bits = np.array(nodes, np.uint32), np.array(bits, np.int64)
        #: what stands for no word before
        self.none = first

    def places(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in nodes and bits of all bits of the symbols, and how many bits each symbol has."""
        lengths = self.lengths[symbols]
        ends = np.cumsum(lengths)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[symbols] - (ends - lengths), lengths), lengths


class Words:
    """What travels with the model: symbols and shares of the known words, and the buckets of all others.

    words and counts: the known words, most frequent first; the first own ones have a symbol of their own. totals: for each
    bucket the sum of counts and the number of distinct words, of all training words.
    """

    def __init__(self, words: list[bytes], counts: list[int], totals: list[tuple[int, int]], own: int):
        self.place = {w: i for i, w in enumerate(words)}
        self.own, self.buckets = min(own, len(words)), len(totals)
        bucket = np.array([crc32(w) % self.buckets for w in words], np.int64)
        c = np.array(counts, np.int64)
        sums = np.array(totals, np.int64).reshape(-1, 2)
        np.subtract.at(sums[:, 0], bucket[: self.own], c[: self.own])
        np.subtract.at(sums[:, 1], bucket[: self.own], 1)
        self.code = Code([*c[: self.own].tolist(), *(sums[:, 0] + 1).tolist()])
        self.symbols = np.where(np.arange(len(words)) < self.own, np.arange(len(words)), self.own + bucket)
        #: log10 of a bucket's counts with one for each word and one for the unseen; a word's own count goes on top
        self.below = np.log10(sums[:, 0] + sums[:, 1] + 1)
        self.plain = np.log10(c + 1)
        self.inner = np.where(np.arange(len(words)) < self.own, 0.0, self.plain - self.below[bucket])

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words, and their places among the known words (-1: another word)."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        symbols = self.symbols[place] if len(self.symbols) else np.zeros(len(words), np.int64)
        others = np.flatnonzero(place < 0)
        symbols[others] = [self.own + crc32(words[i]) % self.buckets for i in others.tolist()]
        return symbols, place


class Segment:
    """Consecutive words of one document: the first at a block's begin, and no others of it in the same group."""

    __slots__ = ("key", "words", "symbols", "place", "one", "two", "first", "last")

    def __init__(self, key: tuple, words: list[bytes], own: Words, before: Segment | None, last: bool):
        self.key, self.words, self.first, self.last = key, words, before is None, last
        self.symbols, self.place = own.look(words)
        none = own.code.none
        past = np.concatenate([[none, none] if before is None else [before.two[-1] if len(before.symbols) < 2 else before.symbols[-2], before.symbols[-1]], self.symbols])
        self.one, self.two = past[1:-1], past[:-2]


def segments(rows: Iterable[tuple], own: Words) -> Iterator[Segment]:
    """The documents (key..., data) in segments of SEGMENT words; the last one of a document has the rest."""
    for *key, data in rows:
        held: list[bytes] = []
        before = None
        for words in word_lists(data):
            held += words
            while len(held) > SEGMENT:
                before = Segment((*key, len(data)), held[:SEGMENT], own, before, False)
                yield before
                held = held[SEGMENT:]
        yield Segment((*key, len(data)), held, own, before, True)


def groups(parts: Iterable[Segment], most: int) -> Iterator[list[Segment]]:
    """Segments in groups of about most words; one that isn't its document's last ends a group."""
    held: list[Segment] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part.symbols)
        if size >= most or not part.last:
            yield held
            held, size = [], 0
    if held:
        yield held


def context_slots(code: Code, place: np.ndarray, lengths: np.ndarray, one: np.ndarray, two: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """For each predictor the slot of every bit in a table of slots (a power of two). one, two: the symbols before each symbol."""
    node = code.nodes[place]
    yield node & np.uint32(slots - 1)
    mark = (node + np.uint32(1)) * _ODD[0]
    one, two = one.astype(np.uint32) + np.uint32(1), two.astype(np.uint32) + np.uint32(1)
    shift = np.uint32(32 - (slots.bit_length() - 1))
    for context in (one * _ODD[1], one * _ODD[1] + two * _ODD[2] + np.uint32(1), two * _ODD[3]):
        mixed = np.repeat(context ^ context >> np.uint32(15), lengths)
        mixed += mark
        mixed ^= mixed >> np.uint32(16)
        mixed *= _ODD[2]
        yield mixed >> shift


def entries(counts: np.ndarray) -> np.ndarray:
    """Table entries for counts of 0 and 1 (n x 2): the stretched probability in 1/1024ths times 4, plus the level: 0 never seen,
    1 less than 30 times, 2 more often."""
    seen = counts.sum(1)
    stretch = np.rint(np.log((counts[:, 1] + 0.4) / (counts[:, 0] + 0.4)) * 1024).astype(np.int64)
    return (stretch * 4 + (seen > 0) + (seen >= 30)).astype("<i4")


def tables(docs: DataFrame, own: Words, slots: int) -> np.ndarray:
    """The predictors' entries (ORDERS x slots) from all of docs: 4 bytes a slot reach the driver, counts are added up in tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def gather(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = shared.value
        table = np.zeros((ORDERS, slots * 2), np.int32)
        for group in groups(segments(rows, words), GATHERED):
            symbols, one, two = (np.concatenate([getattr(s, x) for s in group]) for x in ("symbols", "one", "two"))
            place, lengths = words.code.places(symbols)
            bits = words.code.bits[place]
            for k, slot in enumerate(context_slots(words.code, place, lengths, one, two, slots)):
                np.add(table[k], np.bincount(slot * np.int64(2) + bits, minlength=slots * 2), out=table[k], casting="unsafe")
        flat = table.ravel()
        for at in range(0, len(flat), CELLS):
            if (part := flat[at : at + CELLS]).any():
                yield at, planes(part)

    def total(rows: Iterator[tuple]) -> Iterator[tuple]:
        for at, group in groupby(rows, itemgetter(0)):
            yield at, entries(sum(from_planes(data) for _, data in group).reshape(-1, 2)).tobytes()

    parts = map_rows(docs.select("data"), "at long, data binary", gather)
    summed = map_rows(parts.repartition("at").sortWithinPartitions("at"), "at long, data binary", total)
    out = np.zeros(ORDERS * slots, np.int32)
    for at, data in summed.collect():
        own_part = np.frombuffer(data, "<i4")
        out[at // 2 : at // 2 + len(own_part)] = own_part
    return out.reshape(ORDERS, slots)


def first_weights() -> np.ndarray:
    """GATES x ORDERS: predictors that have seen more are trusted more, the place in the code alone less then."""
    levels = np.stack(np.meshgrid(*[np.arange(3)] * (ORDERS - 1), indexing="ij"), -1).reshape(-1, ORDERS - 1)
    trust = np.array([0.0, 0.15, 0.5])[levels] * np.array([1.0, 0.5, 0.4])
    return np.concatenate([np.maximum(0.15, 1 - trust.sum(1, keepdims=True)), trust], 1).astype(np.float32)


class Mixer:
    """Mixes the predictors of the groups' bits. Weights of an unfinished document are kept for its next segment."""

    def __init__(self, code: Code, table: np.ndarray):
        self.code, self.table, self.first = code, table, first_weights()
        self.kept = self.first

    def scores(self, group: list[Segment]) -> np.ndarray:
        """Natural logarithm of the probability of each segment's symbols. Segments of a group go side by side, block by block."""
        sizes = np.array([len(s.symbols) for s in group])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        n = len(group)
        symbols, one, two = (np.concatenate([getattr(group[i], x) for i in order.tolist()]) for x in ("symbols", "one", "two"))
        # words in order of block, then segment: so the bits of a step lie together
        owner = np.repeat(np.arange(n), sizes)
        block = (np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // BLOCK
        by_block = np.argsort(block, kind="stable")
        symbols, one, two, owner, block = (x[by_block] for x in (symbols, one, two, owner, block))
        place, lengths = self.code.places(symbols)
        slots = self.table.shape[1]
        inputs = np.empty((ORDERS, len(place)), np.float32)
        gate = np.zeros(len(place), np.int32)
        for k, slot in enumerate(context_slots(self.code, place, lengths, one, two, slots)):
            entry = self.table[k].take(slot, mode="clip")
            inputs[k] = entry >> 2
            if k:
                gate *= 3
                gate += entry & 3
        # with the sign of the bit, the weighted sum is the stretched probability of the bit that is there
        inputs *= ((2 * self.code.bits[place] - 1) / 1024).astype(np.float32)
        gate += np.repeat(owner.astype(np.int32) * GATES, lengths)
        ends = np.cumsum(lengths)
        steps = np.flatnonzero(np.append(block[1:] != block[:-1], True))
        edges = [0, *ends[steps].tolist()]
        active = owner[steps] + 1
        weights = np.empty((ORDERS, n * GATES), np.float32)
        for k in range(ORDERS):
            weights[k] = np.tile(self.first[:, k], n)
        for i, at in enumerate(order.tolist()):
            if not group[at].first:
                weights[:, i * GATES : (i + 1) * GATES] = self.kept.T
        chances = np.empty(len(place), np.float32)
        for a, b, m in zip(edges, edges[1:], active.tolist(), strict=False):
            own = gate[a:b]
            x = inputs[:, a:b]
            z = weights[0].take(own, mode="clip")
            z *= x[0]
            for k in range(1, ORDERS):
                term = weights[k].take(own, mode="clip")
                term *= x[k]
                z += term
            np.clip(z, -12, 12, out=z)
            p = np.exp(np.negative(z, out=z), out=z)
            p += 1
            chances[a:b] = np.reciprocal(p, out=p)
            error = (1 - p) * np.float32(RATE)
            for k in range(ORDERS):
                weights[k][: m * GATES] += np.bincount(own, error * x[k], m * GATES)
        for i, at in enumerate(order.tolist()):
            if not group[at].last:
                self.kept = weights[:, i * GATES : (i + 1) * GATES].T.copy()
        sums = np.concatenate([[0.0], np.cumsum(np.log(chances), dtype=np.float64)])
        each = sums[ends] - sums[ends - lengths]
        out = np.empty(n)
        out[order] = np.bincount(owner, each, n)
        return out


def known_words(counts: DataFrame, known: int | None, buckets: int) -> tuple[list, list, int, int]:
    """The most frequent words (word, c), at most known of them; sums and distinct words of each bucket; all counts, all words.

    Words come by a least count, the smallest that leaves no more than known. What reaches the driver has a bound: known rows, a
    row for each bucket, and one for each eighth of a power of two.
    """
    levels = counts.groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).collect()
    total, distinct = sum(r.c for r in levels), sum(r.n for r in levels)
    known = min(MOST_KNOWN, max(FEWEST_KNOWN, total // WORDS_A_KNOWN)) if known is None else known
    least, size = None, 0
    for r in sorted(levels, key=lambda r: -r.level):
        size += r.n
        if size > known:
            break
        least = r.least
    top = [] if least is None else [(bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()]
    totals = [(0, 0)] * buckets
    for r in counts.groupBy((F.crc32("word") % buckets).alias("bucket")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        totals[r.bucket] = (r.c, r.n)
    return sorted(top, key=lambda x: (-x[1], x[0])), totals, total, distinct


def slots_for(words: int) -> int:
    """Slots of a predictor's table for so many training words: they grow with the words up to 2^MOST, then contexts share slots."""
    return 1 << max(FEWEST, min(MOST, int(log2(max(1, words / WORDS_A_SLOT)))))


def score(docs: DataFrame, own: int = OWN, buckets: int = BUCKETS, known: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every whole text.

    base_score: log10 of the add-one unigram probability. score: log10 of the mixing model's. bits_per_byte: the score in bits over
    the bytes of the text (null where it has none). Documents that are not held out are learned from: those whose crc32 of the id
    as text, modulo 7, is not 2; a null id is learned from. Null texts count as empty, which still have their end. Repeated rows
    are learned from as often and give equal rows; an empty table gives none. Other columns are not carried on.

    Of the words, only the known ones travel with the model (as many as the corpus asks for where known is None); a join brings the counts of the others to the words of each document.
    Those are rare, so no key is hot. A document is worked on in segments, so its length has no bearing on memory, and its weights
    go on from segment to segment.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("data"))
    train = rows.where(learned(F.col("doc_id")))
    counts = written(word_counts(train), "counts")
    top, totals, total, distinct = known_words(counts, known, buckets)
    words = Words([w for w, _ in top], [c for _, c in top], totals, own)
    model = docs.sparkSession.sparkContext.broadcast((words, tables(train, words, slots_for(total))))

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        own, table = model.value
        mixer = Mixer(own.code, table)
        for group in groups(segments(rows, own), GROUP):
            for s, logs in zip(group, mixer.scores(group).tolist(), strict=True):
                doc, h, n_bytes = s.key
                met = s.place[s.place >= 0]
                others = np.flatnonzero(s.place < 0)
                inner = own.inner[met].sum() - own.below[s.symbols[others] - own.own].sum()
                tally = Counter([s.words[i] for i in others.tolist()])
                # first a key no word has: words hold no space
                yield doc, h, [f" {doc} {h}".encode(), *tally], [0, *tally.values()], int(s.last), len(s.words), len(met), float(own.plain[met].sum()), logs / log(10) + float(inner), n_bytes if s.last else 0

    parts = map_rows(rows, "doc_id long, h long, words array<binary>, tfs array<long>, whole int, n_tokens long, n_known long, plain double, model double, n_bytes long", step)
    # a row for each word; the segment's own sums stay with the first
    own_sums = F.struct("whole", "n_tokens", "n_known", "plain", "model", "n_bytes")
    parts = parts.select("doc_id", "h", own_sums.alias("own"), F.posexplode(F.arrays_zip("words", "tfs")).alias("pos", "at"))
    parts = parts.select("doc_id", "h", F.col("at.words").alias("word"), F.col("at.tfs").alias("tf"), F.when(F.col("pos") == 0, F.col("own")).alias("own"))
    joined = parts.join(counts, "word", "left")
    rest = F.sum(F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1))
    summed = joined.groupBy("doc_id", "h").agg(
        F.sum("own.whole").alias("rows"),
        F.sum("own.n_tokens").alias("n_tokens"),
        (F.sum("own.n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum("own.plain") + rest - F.sum("own.n_tokens") * F.lit(log10(total + distinct + 1))).alias("base_score"),
        (F.sum("own.model") + rest).alias("score"),
        F.sum("own.n_bytes").alias("n_bytes"),
    )
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    one = lambda c: (F.col(c) / F.col("rows")).alias(c)
    return each.select(
        "doc_id",
        (~learned(F.col("doc_id"))).alias("held_out"),
        one("n_tokens").cast("long").alias("n_tokens"),
        one("n_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        one("base_score"),
        one("score"),
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(log(10) / log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
