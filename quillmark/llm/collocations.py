"""Phrase collocations through Misra-Gries summaries.

Texts are written as chunks of one language. First pass: each chunk sends the distinct hashes of its phrases, with counts, to hash
partitions, whose number grows with the corpus. A partition keeps a Misra-Gries summary with more counters than its mass divided by
the threshold, so every phrase that is frequent survives, and tells each chunk which of its hashes did. Second pass: each chunk counts
the phrases with a surviving hash exactly, by their words, and Spark sums them. Nothing of the corpus is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import from_planes, map_rows, planes, release, written

#: A-Z to lower case, marks and line ends that divide pieces to \n, tabs to spaces.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(BREAKS) + b" ")
#: Most words of a phrase, fewest occurrences of a candidate, and the share of a hundred at which a longer one takes its place.
MOST_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Bytes of a chunk, about, and bytes of all chunks for one hash partition (some four million phrases).
CHUNK, EACH = 4_000_000, 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Summary:
    """Misra-Gries over 32-bit keys: with capacity + 1 above mass / threshold, every key of threshold occurrences or more survives.

    Keys are held back until there are capacity of them, then merged with the counters; what all counters lose together is at most
    mass / (capacity + 1).
    """

    def __init__(self, mass: int, threshold: int) -> None:
        self.threshold, self.capacity, self.lost = threshold, mass // threshold + 1, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.n_held += len(keys)
        if self.n_held > self.capacity:
            self._squeeze()

    def _squeeze(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.held)])
        counts = np.concatenate([self.counts, *(c for _, c in self.held)])
        self.held, self.n_held = [], 0
        self.keys, counts = summed(keys, counts)
        if len(counts) > self.capacity:
            least = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            self.lost += int(least)
            kept = counts > least
            self.keys, counts = self.keys[kept], counts[kept] - least
        self.counts = counts

    def survivors(self) -> np.ndarray:
        """Sorted keys that may have threshold occurrences; all that have are among them."""
        self._squeeze()
        return self.keys[self.counts + self.lost >= self.threshold]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


def chunks(docs: DataFrame, size: int = CHUNK, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """chunk, lang, size, data: whole texts, folded, with line ends between them, compressed; a text beyond size is cut where pieces end."""

    def cut(data: bytes) -> Iterator[bytes]:
        at = 0
        while len(data) - at > 2 * size:
            end = data.rfind(b"\n", at, at + size)
            end = data.find(b"\n", at + size) if end < at else end
            if end < 0:
                break
            yield data[at : end + 1]
            at = end + 1
        yield data[at:] if at else data

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        number, held, sizes = TaskContext.get().partitionId() << 32, {}, {}
        for lang, text in rows:
            for data in cut(text.translate(FOLD)):
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] >= size:
                    yield number, lang, *packed(b"\n".join(held.pop(lang)))
                    number, sizes[lang] = number + 1, 0
        for lang, own in held.items():
            yield number, lang, *packed(b"\n".join(own))
            number += 1

    def packed(data: bytes) -> tuple[int, bytes]:
        return len(data), pa.compress(data, "zstd", asbytes=True)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return written(map_rows(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text")), "chunk long, lang string, size long, data binary", step), "chunks")


class Words:
    """The words of a chunk as numbers, and which of them stand in one piece."""

    def __init__(self, lang: str, size: int, data: bytes) -> None:
        letters = np.frombuffer(pa.decompress(data, size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
        breaks = letters == 10
        solid = ~(breaks | (letters == 32))
        edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        table = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[solid])]).dictionary_encode()
        self.ids, self.known = table.indices.to_numpy(), table.dictionary
        self.piece = np.searchsorted(np.flatnonzero(breaks), starts).astype(np.int32)
        seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.known.to_pylist()], np.uint64)

    def whole(self, n: int) -> np.ndarray:
        """Whether n words from each place on are in one piece."""
        return self.piece[: len(self.ids) - n + 1] == self.piece[n - 1 :] if len(self.ids) >= n else np.zeros(0, bool)

    def phrase_hashes(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hash of the n words there) for n up to most."""
        words = self.hashes[self.ids]
        state = words
        for n in range(1, most + 1):
            if n > 1:
                state = state[:-1] * _MIX
                state = (state ^ (state >> np.uint64(31))) + words[n - 1 :]
            places = np.flatnonzero(self.whole(n))
            mixed = state[places] * _MIX
            mixed ^= mixed >> np.uint64(29)
            yield n, places, mixed

    def exact(self, n: int, places: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        """The phrases of n words at places, told apart by their words: for each of their hash partitions how many, the phrases and how
        often each is there."""
        state = self.ids[places].astype(np.int64)
        for k in range(1, n):
            _, state = np.unique(state, return_inverse=True)
            state = state * len(self.known) + self.ids[places + k]
        _, first, counts = np.unique(state, return_index=True, return_counts=True)
        words = [self.known.take(pa.array(self.ids[places[first] + k])) for k in range(n)]
        phrases = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if n > 1 else words[0]
        order = pc.sort_indices(pa.table({"part": parts[first], "phrase": phrases}), sort_keys=[("part", "ascending"), ("phrase", "ascending")]).to_numpy()
        parts, phrases, counts = parts[first][order], phrases.take(pa.array(order)), counts[order]
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(parts)], strict=True):
            yield int(parts[lo]), int(hi - lo), _small(b"\n".join(phrases[lo:hi].to_pylist())), _small(planes(counts[lo:hi]))


#: Bits of a key within its hash partition; keys that meet by chance only let more survive.
KEY = 28


def _placed(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition above the key within it."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (hashes & np.uint64((1 << KEY) - 1))


def _small(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _large(data: bytes) -> bytes:
    return pa.decompress(data[4:], size, "zstd", asbytes=True) if (size := int.from_bytes(data[:4], "little")) else b""


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next."""
    return _small(planes(np.diff(keys, prepend=np.uint32(0))))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(_large(data))).astype(np.uint32)


def survivors(table: DataFrame, parts: int, least: int = LEAST, most: int = MOST_WORDS) -> DataFrame:
    """chunk, part, keys: of the hashes of each chunk's phrases, those that Misra-Gries summaries of their hash partitions let survive."""

    def send(rows: Iterator[tuple]) -> Iterator[tuple]:
        for chunk, *text in rows:
            found = Words(*text)
            every = np.concatenate([h for _, _, h in found.phrase_hashes(most)])
            both, counts = np.unique(_placed(every, parts), return_counts=True)
            bounds = np.searchsorted(both, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            for p, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if lo < hi:
                    keys, n = both[lo:hi].astype(np.uint32), counts[lo:hi]
                    some = np.flatnonzero(n > 1)
                    yield p, 0, chunk, int(n.sum()), None, None, None
                    # places of counts above one, among the keys, and these counts
                    yield p, 1, chunk, None, _packed(keys), _packed(some.astype(np.uint32)), _small(planes(n[some]))

    def gather(rows: Iterator[tuple]) -> Iterator[tuple]:
        for p, group in groupby(rows, itemgetter(0)):
            mass, summary, blocks = 0, None, []
            for _, kind, chunk, n, keys, some, counts in group:
                if not kind:
                    mass += n
                    continue
                summary = summary or Summary(mass, least)
                own = _unpacked(keys)
                every = np.ones(len(own), np.int64)
                every[_unpacked(some)] = from_planes(_large(counts))
                summary.add(own, every)
                blocks.append((chunk, keys))
            kept = summary.survivors()
            for chunk, keys in blocks:
                own = _unpacked(keys)
                at = np.minimum(np.searchsorted(kept, own), max(len(kept) - 1, 0))
                own = own[kept[at] == own] if len(kept) else own[:0]
                if len(own):
                    yield chunk, p, _packed(own)

    sent = map_rows(table, "part int, kind int, chunk long, mass long, keys binary, some binary, counts binary", send, rows=1)
    return map_rows(sent.repartition("part").sortWithinPartitions("part", "kind", "chunk"), "chunk long, part int, keys binary", gather)


def frequent(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, chunk: int = CHUNK, each: int = EACH, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, phrase, n_words, f of all phrases of up to most words that occur least times or more in a language, exactly; and with a
    null phrase, the count of all words of each language."""
    table = chunks(docs, chunk, lang_col, text_col)
    size = table.agg(F.sum("size")).first()[0] or 0
    parts = size // each + 1
    kept = survivors(table, parts, least, most)
    one = kept.select("chunk", F.lit(0).alias("kind"), "part", "keys", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("data"))
    two = table.select("chunk", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("keys"), "lang", "size", "data")

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, itemgetter(0)):
            held = []
            for _, kind, part, keys, lang, size, data in group:
                if not kind:
                    held.append((np.uint64(part) << np.uint64(32)) | _unpacked(keys).astype(np.uint64))
                    continue
                words, known = Words(lang, size, data), np.concatenate(held) if held else np.zeros(0, np.uint64)
                yield lang, -1, 0, len(words.ids), None, None
                for n, places, hashes in words.phrase_hashes(most):
                    own = _placed(hashes, parts)
                    at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                    met = known[at] == own if len(known) else np.zeros(len(own), bool)
                    if met.any():
                        yield from ((lang, part, n, *block) for part, *block in words.exact(n, places[met], (own[met] >> np.uint64(32)).astype(np.int64)))

    def add_up(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (lang, part, n), group in groupby(rows, itemgetter(0, 1, 2)):
            if part < 0:
                yield lang, None, 0, sum(row[3] for row in group)
                continue
            phrases, counts = [], []
            for *_, block, each_count in group:
                phrases.append(pa.array(_large(block).split(b"\n"), pa.binary()))
                counts.append(from_planes(_large(each_count)))
            both = pa.table({"phrase": pa.chunked_array(phrases), "f": np.concatenate(counts)}).group_by("phrase").aggregate([("f", "sum")])
            both = both.filter(pc.greater_equal(both["f_sum"], least))
            for phrase, f in zip(both["phrase"].to_pylist(), both["f_sum"].to_pylist(), strict=True):
                yield lang, phrase.decode(), n, f

    dealt = one.union(two).repartition("chunk").sortWithinPartitions("chunk", "kind", "part")
    counted = map_rows(dealt, "lang string, part int, n_words int, n long, phrases binary, counts binary", count, rows=1)
    place = ["lang", "part", "n_words"]
    summed = map_rows(counted.repartition(*place).sortWithinPartitions(*place), "lang string, phrase string, n_words int, f long", add_up)
    out = written(summed, "phrases")
    release(docs.sparkSession)
    return out


def pair_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in exact decimals; a is at most left and right."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS, share: int = SHARE, top: int = TOP, chunk: int = CHUNK, each: int = EACH, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each language by score, then a, then phrase.

    a, l and r count a phrase and its two parts at the cut of the lowest score (ties: the first such cut), n all words. Phrases of two to
    most words with a at least least are candidates; one that lies inside a longer candidate with at least share of a hundred of its
    occurrences is dropped. Null languages are und, null texts are empty; equal documents count each; ids are not looked at. An empty
    table gives no rows.
    """
    counts = frequent(docs, least, most, chunk, each, lang_col, text_col)
    phrases = counts.where("phrase is not null")
    candidates = phrases.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda w, at, n: F.array_join(F.slice(w, at, n), " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda at: joined(F.col("w"), at, n))))
    within = candidates.where("n_words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = candidates.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    # each part of each cut is looked up once, in one join
    cuts = alone.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), lambda k: F.struct(k.alias("k"), joined(F.col("w"), F.lit(1), k).alias("one"), joined(F.col("w"), k + 1, F.col("n_words")).alias("two")))).alias("c")).select("lang", "phrase", "a", "c.*")
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("part")), F.struct(F.lit(1).alias("side"), F.col("two").alias("part")))).alias("s")).select("lang", "phrase", "a", "k", "s.*")
    looked = sides.join(phrases.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    f_of = lambda n: F.max(F.when(F.col("side") == n, F.col("f")))
    scored = looked.groupBy("lang", "phrase", "a", "k").agg(f_of(0).alias("l"), f_of(1).alias("r")).withColumn("score", pair_score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
