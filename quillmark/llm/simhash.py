"""SimHash near-duplicates through BK-trees.

Fingerprints within a radius r agree on at least one of r + 1 blocks of their bits, so each distinct fingerprint goes to r + 1
buckets, one for each block's value. A bucket's fingerprints form shard trees of bounded size: BK-trees whose children are
keyed by the Hamming distance to their parent, and a search follows only the edges within the radius. Each tree is built once, by
the task that holds its shard, and its members are linked there. Where a bucket has several shards, their trees are broadcast as
flat arrays to the other shards' fingerprints, which search the arrays as they are, as long as all of them together are small; else
each travels by a shuffle to them.

Links are reported as a spanning forest of each bucket, never as all pairs within a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_planes, map_rows, planes, release, written

#: Most fingerprints in one shard tree, about; a larger bucket gets more trees, each visited by its other shards' fingerprints.
TREE_SIZE = 20_000
#: Bytes of trees that are broadcast at most.
SENT = 32_000_000
#: Fingerprints that visit a flat tree at once, and those taken to be sorted by bucket.
ASKED, HELD = 512, 16_384
#: Shingles whose bits are counted at once.
BLOCK = 65_536
_STEP = np.dtype([("value", "<u8"), ("above", "<u4"), ("edge", "u1")])


def fingerprint(data: bytes, words_each: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lower-cased, words divided by ASCII white space, shingles with repeats."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [s - 1 for s in starts[words_each:]] + [len(text)]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), len(ends)
    pairs = zip(starts, ends, strict=False)
    while part := [digest(text[a:b], seed) for a, b in islice(pairs, BLOCK)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint as a signed long of every whole text; null and empty texts have 0."""

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, data in rows:
            bits = fingerprint(data or b"", words_each)
            yield key, bits - (bits >> 63 << 64)

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")), "doc_id long, fp long", step)


class BKTree:
    """Nodes are (value, children by distance)."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def insert(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while edge := (node[0] ^ value).bit_count():
            if (child := node[1].get(edge)) is None:
                node[1][edge] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The tree's values at most radius away; a subtree is entered only if its edge can hold one."""
        todo = [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            distance = (own ^ value).bit_count()
            if distance <= radius:
                yield own
            for edge in range(max(1, distance - radius), distance + radius + 1):
                if (child := children.get(edge)) is not None:
                    todo.append(child)

    def packed(self) -> bytes:
        """The tree as a flat array of values, places of their parents and edges: level by level, children in order of their edges, so
        that the array is sorted by parent and edge."""
        steps, nodes = [(self.root[0], 0, 0)], [self.root]
        for place, (_, children) in enumerate(nodes):
            for edge in sorted(children):
                steps.append((children[edge][0], place, edge))
                nodes.append(children[edge])
        return np.array(steps, _STEP).tobytes()


class FlatTree:
    """A packed BKTree, searched where it lies: 16 bytes a node beside the packed 13, no objects."""

    def __init__(self, data: bytes) -> None:
        steps = np.frombuffer(data, _STEP)
        self.values = np.ascontiguousarray(steps["value"])
        self.keys = steps["above"].astype(np.int64) * 128 + steps["edge"]

    def within(self, asked: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
        """(asked value, tree's value) of all pairs at most radius apart, for unsigned 64-bit values, ASKED of them at a time, a
        level of the tree after the other. Only edges within the radius are followed."""
        for at in range(0, len(asked), ASKED):
            value = asked[at : at + ASKED]
            node = np.zeros(len(value), np.int64)
            while len(node):
                distance = np.bitwise_count(value ^ self.values[node]).astype(np.int64)
                near = distance <= radius
                yield from zip(value[near].tolist(), self.values[node[near]].tolist(), strict=True)
                first = np.searchsorted(self.keys, node * 128 + np.maximum(distance - radius, 1))
                n = np.searchsorted(self.keys, node * 128 + distance + radius, "right") - first
                value, node = np.repeat(value, n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Forest:
    """Union-find over the linked values only; edges() join just what the links join."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> Iterator[tuple[int, int]]:
        for value in list(self.up):
            if (top := self.top(value)) != value:
                yield value, top


MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def block_keys(fp: Column, radius: int) -> list[Column]:
    """One key for each of radius + 1 blocks of a 64-bit fingerprint: the block's bits above its number."""
    bounds = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * F.lit(radius + 1) + F.lit(i) for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))]


def links(nodes: DataFrame, radius: int = 2, tree_size: int = TREE_SIZE, sent: int = SENT) -> DataFrame:
    """Edges (a, b) between fingerprints (nodes: fp long, each once, not null): a spanning forest of the links that each bucket finds.

    Fingerprints at most radius bits apart end up connected. An empty table gives no edges.
    """
    spread = nodes.select("fp", F.explode(F.array(*block_keys(F.col("fp"), radius))).alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / F.lit(tree_size)).cast("int")
    kept = spread.join(sizes, "bucket").select("bucket", "fp", shards.alias("shards")).withColumn("shard", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    dealt = kept.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard", "fp")

    def grow(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (bucket, shard), group in groupby(rows, itemgetter(0, 1)):
            tree, linked, shards = BKTree(), Forest(), 1
            for *_, fp, shards in group:  # noqa: B007
                value = fp & MASK
                for other in tree.within(value, radius):
                    linked.link(value, other)
                tree.insert(value)
            yield from ((_signed(a), _signed(b), None, None, None) for a, b in linked.edges())
            if shards > 1:
                yield None, None, bucket, shard, tree.packed()

    grown = written(map_rows(dealt.select("bucket", "shard", "fp", "shards"), "a long, b long, bucket long, shard int, tree binary", grow), "trees")
    edges, trees = grown.where("tree is null").select("a", "b"), grown.where("tree is not null").select("bucket", "shard", "tree")
    size = trees.agg(F.sum(F.octet_length("tree"))).first()[0]
    if not size:
        return edges
    # between shards: a fingerprint visits the trees of its bucket's shards before its own
    asking = kept.where("shard > 0").select("bucket", F.col("shard").alias("chunk"), "fp")

    def visit(data: bytes, fps: list[int], linked: Forest) -> None:
        for value, other in FlatTree(data).within(np.array(fps, np.int64).view(np.uint64), radius):
            linked.link(value, other)

    if size <= sent:
        held = nodes.sparkSession.sparkContext.broadcast([tuple(r) for r in trees.collect()])

        def search(rows: Iterator[tuple]) -> Iterator[tuple]:
            near: dict[int, list] = {}
            for bucket, shard, tree in held.value:
                near.setdefault(bucket, []).append((shard, tree))
            linked = Forest()
            while part := sorted(islice(rows, HELD)):
                for bucket, group in groupby(part, itemgetter(0)):
                    own = list(group)
                    for shard, tree in near.get(bucket, ()):
                        visit(tree, [fp for _, chunk, fp in own if shard < chunk], linked)
            yield from ((_signed(a), _signed(b)) for a, b in linked.edges())

        return edges.union(map_rows(asking, "a long, b long", search))
    most = kept.where("shards > 1").select("bucket", "shards").distinct()
    sent_trees = trees.join(most, "bucket").where(F.col("shard") < F.col("shards") - 1)
    sent_trees = sent_trees.select("bucket", "shard", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)).alias("chunk"), "tree", F.lit(None).cast("long").alias("fp"))
    asked = asking.select("bucket", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("shard"), "chunk", F.lit(None).cast("binary").alias("tree"), "fp")
    met = sent_trees.union(asked).repartition("bucket", "shard", "chunk").sortWithinPartitions("bucket", "shard", "chunk", F.col("fp").asc_nulls_first())

    def search_one(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(rows, itemgetter(0, 1, 2)):
            tree, linked = next(group)[3], Forest()
            while fps := [fp for *_, fp in islice(group, HELD)]:
                visit(tree, fps, linked)
            yield from ((_signed(a), _signed(b)) for a, b in linked.edges())

    return edges.union(map_rows(met, "a long, b long", search_one))


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, by large-star and small-star rounds until nothing changes.

    Each round's edges are written to the shared folder; the driver sees one count a round. Edges with a null end, or from a node to
    itself, are none; repeated edges count once; no edges give no rows.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
        after = written(small.where("a != b").distinct(), "edges")
        sums = [e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first() for e in (edges, after)]
        edges = after
        if sums[0] == sums[1]:
            return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def near_duplicates(docs: DataFrame, words_each: int = 3, radius: int = 2, tree_size: int = TREE_SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id, the smallest doc_id reachable over links of at most radius differing bits.

    Equal fingerprints are one node, so copies add no links. Null and empty texts have fingerprint 0 and link like any other;
    null ids stay null and are no component's name unless it has no other (then null). Repeated rows give equal rows; an empty
    table gives none. Other columns are not carried on.
    """
    marked = written(fingerprints(docs, words_each, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    return marked.join(_named(distinct, radius, tree_size), "fp").select("doc_id", "fp", "component_id")


def _named(distinct: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """fp and component_id of distinct fingerprints (fp, first: their smallest doc_id)."""
    joined = components(links(distinct.select("fp"), radius, tree_size))
    # fp -> component root (itself where unlinked) -> smallest doc_id below that root
    rooted = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.select("fp", "root").join(linked, "root").select("fp", "component_id")


#: Slots in which shingles are counted to put the common ones last (a fixed size), and counts that travel together.
SEEN, ROWS = 1 << 20, 1 << 15
#: Of n shingles, a text shows n / SHARED more than it must, and two texts are compared if they share 1 more than that of what they show.
SHARED = 40
#: Pairs of texts that are compared at once, for each shingle of a text.
GROUP = 8


def shingle_hashes(data: bytes, words_each: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased words; of fewer words, of the whole sequence."""
    words = data.lower().split()
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]] if words else [0]
    n = max(1, len(words) - words_each + 1)
    last = [*ends[words_each - 1 :], len(text) + 1][:n]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(text[a : b - 1]) for a, b in zip(starts, last, strict=False)], np.uint64))


def print_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of distinct shingle hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _seen(texts: DataFrame, words_each: int) -> np.ndarray:
    """How many texts hold the shingles of each slot.

    Its fixed size is what reaches the driver (4 MB). What a shingle adds to its slot grows with the corpus, and the spread of all slots with
    its root only, so shingles that a given share of texts hold stand out the more, the larger it is.
    """

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        table = np.zeros(SEEN, np.int64)
        for (data,) in rows:
            np.add.at(table, (shingle_hashes(data, words_each) % np.uint64(SEEN)).astype(np.int64), 1)
        for at in range(0, SEEN, ROWS):
            if table[at : at + ROWS].any():
                yield at, planes(table[at : at + ROWS])

    def total(rows: Iterator[tuple]) -> Iterator[tuple]:
        for at, group in groupby(rows, itemgetter(0)):
            yield at, sum(from_planes(data) for _, data in group).astype("<u4").tobytes()

    parts = map_rows(texts.select("data"), "at long, data binary", count)
    out = np.zeros(SEEN, np.uint32)
    for at, data in map_rows(parts.repartition("at").sortWithinPartitions("at"), "at long, data binary", total).collect():
        out[at : at + ROWS] = np.frombuffer(data, "<u4")
    return out


def _shared(index: DataFrame) -> DataFrame:
    """The rows of the index whose shingle another row has, too. Sorted rows pass by; no group is held."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            keep = np.zeros(len(own), bool)
            keep[1:] = own[1:] == own[:-1]
            keep[:-1] |= keep[1:]
            if last is not None and last.column(0)[0].as_py() == own[0]:
                keep[0] = True
                if not given:
                    yield last
            yield batch.filter(pa.array(keep))
            last, given = batch.slice(len(own) - 1), bool(keep[-1])

    ordered = index.select("shingle", *(c for c in index.columns if c != "shingle"))
    return ordered.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(step, ordered.schema)


def _merged(index: DataFrame) -> DataFrame:
    """The index with one shingle for all that the same texts hold, such as those of a passage, and in w how many these are. It is the one
    that comes first in the order of shingles, and so in each of these texts."""
    sums = [F.expr(f"bit_xor(xxhash64(doc_id, {seed}))").alias(f"x{seed}") for seed in range(2)]
    alike = index.groupBy("shingle").agg(*sums, F.count("*").alias("texts"), F.sum("doc_id").alias("ids"), F.min("p").alias("p"))
    return index.drop("w").join(alike.groupBy("x0", "x1", "texts", "ids").agg(F.min_by("shingle", "p").alias("shingle"), F.count("*").alias("w")).select("shingle", "w"), "shingle")


#: Ids that are broadcast at most, 16 MB; more are joined by a shuffle.
FEW = 1 << 20


def sent(ids: DataFrame) -> DataFrame:
    """ids, a table that was written: broadcast if they are few, so that what they are joined to isn't moved."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _sets_of(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the ids in the one column of ids."""
    return sets.join(sent(written(ids.toDF("doc_id").distinct(), "ids")), "doc_id", "left_semi")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets of shingles have a Jaccard similarity of at least least."""

    def compare(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, one, two in rows:
            one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            shared = len(np.intersect1d(one, two, assume_unique=True))
            if shared >= least * (len(one) + len(two) - shared) - 1e-9:
                yield a, b

    pairs = written(pairs, "pairs")
    side = lambda name, own: _sets_of(pairs.select(name), sets).select(F.col("doc_id").alias(name), F.col("shingles").alias(own))
    return map_rows(pairs.join(side("a", "one"), "a").join(side("b", "two"), "b").select("a", "b", "one", "two"), "a long, b long", compare)


def _crowded(index: DataFrame, group: int) -> bool:
    """Whether the index makes more than group pairs of texts for each of its rows."""
    light, heavy = F.count_if(~F.col("heavy")).cast("double"), F.count_if("heavy").cast("double")
    each = index.groupBy("shingle").agg(light.alias("l"), heavy.alias("h")).agg(F.sum(F.col("l") * (F.col("l") - 1) / 2 + F.col("l") * F.col("h")), F.sum(F.col("l") + F.col("h"))).first()
    return (each[0] or 0) > group * (each[1] or 0)


#: Texts that share a shingle before their own ones are counted (any number gives the same result).
CROWD = 64


def _heavy(index: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """doc_id of texts of which no two are alike, among those that meet in crowded shingles.

    Of s shingles that others of these texts have, and u that none of them has, two texts share at most the lesser s, and together have at least
    the greater s and both u. So they are alike only if both u together are at most (1 - least) / least of the lesser s, which isn't so
    if each u is above half of that share of its s. Texts that fill in one template, or quote one passage, are such.
    """
    crowded = index.groupBy("shingle").agg(F.count("*").alias("texts")).where(F.col("texts") >= CROWD).select("shingle")
    some = written(index.join(crowded, "shingle").select("doc_id").distinct(), "ids")

    def opened(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, data in rows:
            every = np.frombuffer(data, np.int64)
            for x in every.tolist():
                yield x, doc, len(every)

    every = map_rows(sets.join(sent(some), "doc_id", "left_semi").select("doc_id", "shingles"), "shingle long, doc_id long, n int", opened)
    shared = _shared(every).groupBy("doc_id", "n").agg(F.count("*").alias("s"))
    return shared.where((F.col("n") - F.col("s")) * F.lit(2 * least) > F.col("s") * F.lit(1 - least) + F.lit(1e-6)).select("doc_id")


def _settled(edges: DataFrame) -> Iterator[DataFrame]:
    """(a, b): of texts joined by edges (a alike to the earlier b), in order of id, each that is alike to one that stays."""
    while not edges.isEmpty():
        # what has no earlier text alike to it that may stay, stays
        kept = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_anti")
        like = written(edges.join(kept, "b").groupBy("a").agg(F.min("b").alias("b")), "alike")
        yield like
        out = like.select("a")
        edges = written(edges.join(out, "a", "left_anti").join(out.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"), "edges")


def near_copies(docs: DataFrame, words_each: int = 5, least: float = 0.8, radius: int = 3, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, leader) of the documents that repeat an earlier one, so that one document of each group stays.

    Documents of equal text repeat the one with the smallest id. Other texts are alike if the exact Jaccard similarity of their
    shingle sets is at least least. They go in two steps, by the same rules at every size:

    1. SimHash: texts whose fingerprints (of shingle sets) are linked over at most radius bits form a group; a text that is alike
       to its group's first goes.
    2. Of the texts left, in order of id, one that is alike to a kept one goes, any other is kept. No pair is missed here: put in one
       order, sets of n shingles that are alike share k of the first (1 - least) * n + k, so a join on these finds all pairs; k is
       1 + n / SHARED of the smaller set. The order is by how full a shingle's slot is (_seen()), so what many texts hold comes late. A shingle counts for a pair of
       texts only if it stands so far in front in both that all they must share can follow it. Shingles that the same texts show count together.

    3. A text that went in step 1 for one that goes in step 2 is compared with that one's own leader; if it isn't alike to it, it is
       decided anew: in order of id it goes if it is alike to a text that stays, else it stays.

    So no two kept texts are alike, and each text that goes is alike to one that stays. Pairs of texts that have too many shingles of
    their own are never made (see _heavy()).

    While texts and their shingles make more than group pairs for each of them, rounds decide the texts that have no earlier candidate
    left and compare only them with the others, as long as that decides a fiftieth of the texts or more. These rounds save pairs and
    change no result.

    Null texts count as empty. Null ids are neither dropped nor leaders. Rows that repeat an id and text are one document; of
    different texts under one id, that with the least hash counts. An empty table gives no rows.
    """
    key, data = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.where(key.isNotNull()).select(key.alias("doc_id"), F.xxhash64(data).alias("h"), F.md5(data).alias("m"), data.alias("data"))
    spark = docs.sparkSession
    marked = rows.groupBy("doc_id", "h", "m").agg(F.count("*").alias("rows"))
    copies = written(marked.join(marked.groupBy("h", "m").agg(F.min("doc_id").alias("leader")), ["h", "m"]), "copies")
    own = copies.where("doc_id = leader").groupBy("doc_id").agg(F.min(F.struct("h", "m")).alias("one")).select("doc_id", "one.h", "one.m")
    # ids that are no first of their text, or that repeat: most ids are there once, and their texts stay where they are read
    told = copies.groupBy("doc_id").agg((F.sum("rows") > 1).alias("repeated"), F.max(F.col("doc_id") == F.col("leader")).alias("first"))
    odd = written(told.where("repeated or not first"), "odd")
    again = odd.where("repeated and first").select("doc_id")
    unique = again.isEmpty()

    def firsts(every: DataFrame) -> DataFrame:
        """Of rows with doc_id, h and m those of the first of each text, one for each id."""
        once = every.join(sent(odd.select("doc_id")), "doc_id", "left_anti")
        return once if unique else once.unionByName(every.join(again, "doc_id", "left_semi").join(own, ["doc_id", "h", "m"]).dropDuplicates(["doc_id"]))

    shared = spark.sparkContext.broadcast(_seen(rows, words_each))

    def sketch(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, h, m, data in rows:
            every = shingle_hashes(data, words_each)
            n = len(every)
            order = np.lexsort((every, shared.value[(every % np.uint64(SEEN)).astype(np.int64)]))
            yield doc, h, m, n, _signed(print_of(every)), every[order[: int((1 - least) * n + 1e-9) + 1 + n // SHARED]].tobytes()

    def opened(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, shown in rows:
            for p, x in enumerate(np.frombuffer(shown, np.int64).tolist()):
                yield x, doc, p

    def hashes(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc, data in rows:
            yield doc, shingle_hashes(data, words_each).tobytes()

    sketched = map_rows(rows.select("doc_id", "h", "m", "data"), "doc_id long, h long, m string, n int, fp long, shown binary", sketch)
    heads = written(firsts(sketched).select("doc_id", "n", "fp", "shown"), "heads")
    release(spark)
    index = written(_shared(map_rows(heads.select("doc_id", "shown"), "shingle long, doc_id long, p int", opened)), "index")
    release(spark)
    # a text that shares less than its smallest possible partner asks for takes no part
    counted = index.groupBy("doc_id").count().join(heads.select("doc_id", "n"), "doc_id")
    enough = written(counted.where(F.col("count") >= 1 + F.floor(F.col("n") * F.lit(least) / SHARED - F.lit(1e-9))).select("doc_id", "n"), "enough")
    index = written(_merged(_shared(index.join(sent(enough), "doc_id"))), "index")
    release(spark)
    some = rows.join(sent(written(index.select("doc_id").distinct(), "ids")), "doc_id", "left_semi")
    sets = written(map_rows(firsts(some).select("doc_id", "data"), "doc_id long, shingles binary", hashes), "shingles")
    heavy = _heavy(index, sets, least).withColumn("heavy", F.lit(True))
    index = whole = written(index.join(heavy, "doc_id", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))), "index")
    release(spark)
    distinct = written(heads.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    near = heads.select("doc_id", "fp").join(_named(distinct, radius), "fp").where("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    first = written(_alike(near, sets, least), "alike")
    index = written(_shared(index.join(first.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")), "index")
    release(spark)
    second: list[DataFrame] = []
    sized = F.least("n", "m") >= F.greatest("n", "m") * F.lit(least) - F.lit(1e-9)
    k = 1 + F.floor(F.least("n", "m") / SHARED)
    # the first k that they share have all others that they must share behind them, in both
    both = F.ceil((F.col("n") + F.col("m")) * F.lit(least / (1 + least)) - F.lit(1e-6))
    placed = (F.col("p") < F.col("n") - both + k) & (F.col("q") < F.col("m") - both + k)
    asked = F.col("shared") >= k

    def compared(pairs: DataFrame) -> DataFrame:
        return _alike(pairs.where(sized & placed).groupBy("a", "b", "n", "m").agg(F.sum("w").alias("shared")).where(asked).select("a", "b"), sets, least)

    while _crowded(index, group):
        met = index.join(index.groupBy("shingle").agg(F.min("doc_id").alias("b"), F.min_by("p", "doc_id").alias("q")), "shingle")
        # the texts that come first for all their shingles have no earlier candidate left: they stay
        kept = written(met.groupBy("doc_id").agg(F.min("b").alias("b"), F.first("n").alias("m"), F.first("heavy").alias("too")).where("b = doc_id").select("b", "m", "too"), "kept")
        like = written(compared(met.join(kept, "b").where("doc_id > b and not (heavy and too)").withColumnRenamed("doc_id", "a")).groupBy("a").agg(F.min("b").alias("b")), "alike")
        second.append(like)
        decided = kept.select(F.col("b").alias("doc_id")).union(like.select(F.col("a").alias("doc_id")))
        few = 50 * decided.count() < met.select("doc_id").distinct().count()
        index = written(_shared(index.join(decided, "doc_id", "left_anti")), "index")
        if few:
            break
    second += _settled(written(compared(_pairs(index, index)), "alike"))
    # who went for a text that went itself
    went = reduce(DataFrame.union, second) if second else first.limit(0)
    lost = written(first.join(went.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "lost")
    decided = [first.join(lost.select("a"), "a", "left_anti"), *second]
    if not lost.isEmpty():
        decided.append(written(_alike(lost, sets, least), "alike"))
        anew = written(lost.join(decided[-1].select("a"), "a", "left_anti").select(F.col("a").alias("doc_id")), "anew")
        if not anew.isEmpty():
            gone = reduce(DataFrame.union, decided).select(F.col("a").alias("doc_id"))
            left = written(_shared(whole.join(gone, "doc_id", "left_anti")), "index")
            fresh = anew.withColumn("fresh", F.lit(True))
            edges = written(compared(_pairs(left.join(anew, "doc_id"), left)), "alike")
            marked = edges.join(fresh.withColumnRenamed("doc_id", "a").withColumnRenamed("fresh", "a_fresh"), "a", "left").join(fresh.withColumnRenamed("doc_id", "b").withColumnRenamed("fresh", "b_fresh"), "b", "left")
            # beside one that stays, whatever its id
            beside = marked.where("a_fresh is null or b_fresh is null").select(F.when(F.col("a_fresh"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("a_fresh"), F.col("b")).otherwise(F.col("a")).alias("b"))
            decided.append(written(beside.groupBy("a").agg(F.min("b").alias("b")), "alike"))
            out = decided[-1].select("a")
            both = marked.where("a_fresh and b_fresh").select("a", "b").join(out, "a", "left_anti").join(out.withColumnRenamed("a", "b"), "b", "left_anti")
            decided += _settled(written(both, "edges"))
    same = copies.where("doc_id != leader").select("doc_id", "leader")
    return same.union(reduce(DataFrame.union, decided).select(F.col("a").alias("doc_id"), F.col("b").alias("leader")))


def _pairs(some: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b, n, m, p, q, w) for each shingle of texts a > b, one of them of some (rows of the index), at most one of them heavy."""
    one = some.select("shingle", F.col("doc_id").alias("x"), "n", "p", "w", F.col("heavy").alias("h"))
    two = index.select("shingle", F.col("doc_id").alias("y"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("heavy").alias("too"))
    a, b = F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")
    size = [F.when(F.col("x") > F.col("y"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("n", "m"), ("m", "n"), ("p", "q"), ("q", "p"))]
    if some is index:
        # light texts with all others; of two light ones, once
        return one.join(two.where("not too"), "shingle").where("x != y and (h or x > y)").select(a, b, *size, "w")
    met = one.join(two, "shingle").where("x != y and not (h and too)").select("shingle", a, b, *size, "w")
    return met.dropDuplicates(["shingle", "a", "b"]).drop("shingle")
