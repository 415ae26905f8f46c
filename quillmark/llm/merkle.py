"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

A paragraph is a line; a section is a run of paragraphs that ends at a blank line, or where a paragraph's own digest says so. A
paragraph's leaves end where its words say so. All borders follow from the content near them, so an edit moves none further on.
Leaves hash their text, paragraphs their leaves, sections their paragraphs, the root its sections. Equal roots mean equal texts;
where roots differ, only branches whose digests the other tree lacks are entered, down to the leaves that were edited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, written

#: Code points of a leaf at most, and of one that ends at a border (a vowel or a stop before a space) at least.
LEAF, LEAST = 64, 17
LEAVES = rf"[^\n]{{{LEAST - 2},{LEAF - 2}}}?[aeiou.,;:!?]\x20|[^\n]{{1,{LEAF}}}\n?|\n"
#: Signs of base 64 kept of a leaf's digest in a fingerprint (48 bits), and hex digits of the others but the root's.
SIGNS, ABOVE = 8, 16
#: First hex digits of a paragraph's digest with which it ends a section, and the digest of a blank line's paragraph.
ENDING, BLANK = ("0", "1"), hashlib.md5(hashlib.md5(b"\n").hexdigest().encode()).hexdigest()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _ends(items: Column, ending: Callable[[Column], Column]) -> Column:
    """Places (from 0) of the items that end a run; the last one does."""
    return F.filter(F.transform(items, lambda x, i: F.when(ending(x) | (i == F.size(items) - 1), i).otherwise(F.lit(-1))), lambda i: i >= 0)


def _lengths(ends: Column) -> Column:
    return F.transform(ends, lambda e, k: e - F.when(k == 0, F.lit(-1)).otherwise(F.get(ends, k - 1)))


def _above(digests: Column, ends: Column) -> Column:
    """Digests of the runs."""

    def run(e: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(-1)).otherwise(F.get(ends, k - 1))
        return F.md5(F.array_join(F.slice(digests, before + 2, e - before), ""))

    return F.transform(ends, run)


def leaves(text: Column) -> Column:
    """The text's leaves in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(LEAVES), F.lit(0))


def fingerprint(text: Column) -> Column:
    """root|sections|paragraphs|leaves: the root's 128 bits; the first digits of the section and paragraph digests, each with the
    number of its parts; the first 48 bits of each leaf's digest in base 64 without anything between. An empty text has a root only; null
    stays null."""
    named = lambda digests, ends: F.array_join(F.zip_with(digests, _lengths(ends), lambda d, n: F.concat_ws(":", F.substring(d, 1, ABOVE), n)), ",")

    def first(parts: Column) -> Column:
        return _let(F.struct(F.transform(parts, F.md5).alias("leaves"), _ends(parts, lambda x: x.endswith("\n")).alias("ends")), second)

    def second(t: Column) -> Column:
        return _let(F.struct(t["leaves"], t["ends"], _above(t["leaves"], t["ends"]).alias("paragraphs")), third)

    def third(t: Column) -> Column:
        ending = lambda d: F.substring(d, 1, 1).isin(*ENDING) | (d == BLANK)
        return _let(F.struct(t["leaves"], t["ends"], t["paragraphs"], _ends(t["paragraphs"], ending).alias("section_ends")), fourth)

    def fourth(t: Column) -> Column:
        return _let(F.struct(t["leaves"], t["ends"], t["paragraphs"], t["section_ends"], _above(t["paragraphs"], t["section_ends"]).alias("sections")), last)

    def last(t: Column) -> Column:
        # some sessions break base 64 into lines
        short = F.translate(F.base64(F.unhex(F.array_join(F.transform(t["leaves"], lambda d: F.substring(d, 1, SIGNS * 3 // 2)), ""))), "\r\n", "")
        return F.concat_ws("|", F.md5(F.array_join(t["sections"], "")), named(t["sections"], t["section_ends"]), named(t["paragraphs"], t["ends"]), short)

    return F.when(text.isNotNull(), _let(leaves(text), first))


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 32)


def _level(print_: Column, level: int) -> Column:
    """Sections (2) or paragraphs (3) of a fingerprint, digest:parts."""
    return F.filter(F.split(F.element_at(F.split(print_, "[|]"), level), ","), lambda x: x != "")


def _leaves_of(print_: Column) -> Column:
    return F.regexp_extract_all(F.element_at(F.split(print_, "[|]"), 4), F.lit(f".{{{SIGNS}}}"), F.lit(0))


def _numbered(items: Column) -> Column:
    """The items in order; an item that repeats carries how many equal ones come before it."""

    def numbers(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["v"] != x["v"]), i)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.transform(F.sort_array(F.flatten(F.transform(at, lambda b, k: run(s, at, b, k)))), lambda x: x["v"]))

    def run(s: Column, at: Column, b: Column, k: Column) -> Column:
        equal = F.slice(s, b + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - b)
        return F.transform(equal, lambda x, j: F.struct(x["i"].alias("i"), F.when(j == 0, x["v"]).otherwise(F.concat_ws("#", x["v"], j)).alias("v")))

    ordered = F.sort_array(F.transform(items, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(items)) == F.size(items), items).otherwise(_let(ordered, numbers))


def _lacking(x: Column, y: Column) -> Column:
    """Places (from 0) in x, ascending, of the items that y lacks; of equal items y's number is spared, the first ones."""
    side = lambda items, own: F.transform(_numbered(items), lambda v, i: F.struct(v.alias("v"), F.lit(own).alias("own"), i.alias("i")))
    only = lambda s: F.filter(s, lambda e, j: (e["own"] == 1) & ((j == 0) | (F.get(s, j - 1)["v"] != e["v"])))
    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(_let(F.sort_array(F.concat(side(x, 1), side(y, 0))), lambda s: F.sort_array(F.transform(only(s), lambda e: e["i"]))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal leaves, repeats included, over the leaves of the longer text; 1 for equal roots; null if either is null."""

    def share(x: Column, y: Column) -> Column:
        most = F.greatest(F.size(x), F.size(y))
        return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(_numbered(x), _numbered(y))) / most)

    other = _let(F.struct(_leaves_of(a).alias("x"), _leaves_of(b).alias("y")), lambda t: share(t["x"], t["y"]))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(root(a) == root(b), F.lit(1.0)).otherwise(other)


EDITS = "array<struct<section:int,paragraph:int,leaf:int>>"


def edits(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph, leaf>> (places in a, from 0) of the leaves of a that b lacks, in order.

    Sections that both trees have are left out, then paragraphs that both have among the parts of the other sections, then
    leaves among the parts of the other paragraphs. Of parts that repeat, as many are left out as b has, the first ones. A branch that
    only moved is no edit. Equal roots give an empty array, null fingerprints null. Time grows with the sizes of the two trees,
    but for a sort at each level.
    """
    digest = lambda x: F.substring(x, 1, ABOVE)
    zero, plus = F.lit(0), lambda s, n: s + n

    def branches(level: Column) -> Column:
        """i, digest, place of the first part and number of parts of each branch."""
        counts = F.transform(level, lambda x: F.substring_index(x, ":", -1).cast("int"))
        branch = lambda x, i, at: F.struct(i.alias("i"), digest(x).alias("d"), F.get(at, i).alias("at"), F.substring_index(x, ":", -1).cast("int").alias("n"))
        return F.when(F.size(level) > 0, _let(running(counts, zero, plus), lambda at: F.transform(level, lambda x, i: branch(x, i, at)))).otherwise(F.array().cast("array<struct<i:int,d:string,at:int,n:int>>"))

    def differing(own: Column, other: Column) -> Column:
        of = lambda t: F.transform(t, lambda x: x["d"])
        return F.transform(_lacking(of(own), of(other)), lambda i: F.get(own, i))

    def parts(of: Column, level: Column) -> Column:
        """The branches of the next level inside each branch, with its place."""
        return F.flatten(F.transform(of, lambda s: F.transform(F.slice(level, s["at"] + 1, s["n"]), lambda p: F.struct(s["i"].alias("above"), p["i"].alias("i"), p["d"].alias("d"), p["at"].alias("at"), p["n"].alias("n")))))

    def leaves_in(of: Column, level: Column) -> Column:
        return F.flatten(F.transform(of, lambda p: F.transform(F.slice(level, p["at"] + 1, p["n"]), lambda d, j: F.struct(p["above"].alias("section"), p["i"].alias("paragraph"), (p["at"] + j).alias("leaf"), d.alias("d")))))

    def sections(t: Column) -> Column:
        return _let(F.struct(*rest(t), differing(t["sa"], t["sb"]).alias("sa"), differing(t["sb"], t["sa"]).alias("sb")), paragraphs)

    def rest(t: Column) -> list[Column]:
        return [t[n].alias(n) for n in ("pa", "pb", "la", "lb")]

    def paragraphs(t: Column) -> Column:
        inside = F.struct(parts(t["sa"], t["pa"]).alias("pa"), parts(t["sb"], t["pb"]).alias("pb"), t["la"], t["lb"])
        return _let(inside, lambda p: _let(F.struct(differing(p["pa"], p["pb"]).alias("pa"), differing(p["pb"], p["pa"]).alias("pb"), p["la"], p["lb"]), last))

    def last(t: Column) -> Column:
        inside = F.struct(leaves_in(t["pa"], t["la"]).alias("x"), leaves_in(t["pb"], t["lb"]).alias("y"))
        return F.transform(_let(inside, lambda p: differing(p["x"], p["y"])), lambda x: F.struct(x["section"], x["paragraph"], x["leaf"]))

    trees = F.struct(*(branches(_level(x, n)).alias(name) for x, n, name in ((a, 2, "sa"), (b, 2, "sb"), (a, 3, "pa"), (b, 3, "pb"))), _leaves_of(a).alias("la"), _leaves_of(b).alias("lb"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast(EDITS)).when(root(a) == root(b), F.array().cast(EDITS)).otherwise(_let(trees, sections).cast(EDITS))


def with_before(keys: DataFrame) -> DataFrame:
    """keys (doc_id, h, n_chars; each pair once) with the row before in order of (doc_id, h), nulls first; before the first: the last.

    Rows are range-partitioned and written, so each partition finds its own neighbours; only the partitions' ends, one row for
    each partition, come together in one task.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    dealt = written(keys.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "ordered")
    row = F.struct("doc_id", "h", "n_chars")
    ends = dealt.groupBy("pid").agg(F.max(row).alias("last"))
    everything = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("pid", F.coalesce(F.lag("last").over(Window.orderBy("pid")), F.last("last").over(everything)).alias("end_before"))
    own = dealt.select("*", F.lag(row).over(Window.partitionBy("pid").orderBy(*order)).alias("own_before"))
    return own.join(F.broadcast(ends), "pid").select("doc_id", "h", "n_chars", F.coalesce("own_before", "end_before").alias("before"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in which the start of the next document replaces the last quarter.

    doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, next_fingerprint. The next document is the one that follows by
    (doc_id, text hash), null ids first; after the last comes the first, and a single document is its own next. Null texts count
    as empty. Repeated rows count as one document and give equal rows. Other columns are not carried on.

    The text is shuffled once, by document; both uses of it share that exchange.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    counted = written(rows.groupBy("doc_id", "h").agg(F.first(F.length("text")).alias("n_chars"), F.count("*").alias("copies")), "keys")
    repeats = not counted.where("copies > 1").isEmpty()
    before = with_before(counted.select("doc_id", "h", "n_chars")).select(F.col("doc_id").alias("k1"), F.col("h").alias("k2"), "before")
    here = rows.join(before, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("h") == F.col("k2")))
    quarter = F.floor(F.col("before.n_chars") / 4).cast("int")
    sent = here.select(F.col("before.doc_id").alias("k1"), F.col("before.h").alias("k2"), F.substr("text", F.lit(1), quarter).alias("start"), fingerprint(F.col("text")).alias("next_fingerprint"))
    sent = sent.dropDuplicates(["k1", "k2"]) if repeats else sent
    met = rows.join(sent, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("h") == F.col("k2")))
    length = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), length - F.floor(length / 4).cast("int")), F.col("start"))
    both = met.select("doc_id", length.cast("long").alias("n_chars"), edited.alias("edited_text"), fingerprint(F.col("text")).alias("fingerprint"), "next_fingerprint")
    return both.select("doc_id", "n_chars", "edited_text", "fingerprint", fingerprint(F.col("edited_text")).alias("edited_fingerprint"), "next_fingerprint")
