"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong parts (assignments, access identifiers, long hexadecimal runs) are always reported. Weak candidates (other access
identifiers, bare 40-character secrets, endpoints) are reported only when a complementary part lies within their scope, which an
interval join over the parts of each document decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, written

#: Fixed values of the base patterns: (kind, pattern, least length of its last group, quick test that every hit passes).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)|\z)"""
ASSIGN_TEST = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
#: A run shorter than the least length holds no longer one, so these ask for that length at once.
BASE = [("assign", ASSIGN, ASSIGN_TEST), ("access", r"(AKIA[A-Z0-9]{16,}|\z)", r"AKIA[A-Z0-9]{16}"), ("hex", r"([0-9a-f]{24,}|\z)", r"[0-9a-f]{24}")]
WEAK = [
    ("weak_access", r"((?<![A-Z0-9])(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{16}(?![A-Z0-9])|\z)", r"(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{16}"),
    ("weak_secret", r"((?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])|\z)", r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"),
    ("endpoint", r"""(https?://[^\x20\x09-\x0D"'<>]+|\z)""", r"https?://"),
]
KINDS = [k for k, *_ in (*BASE, *WEAK)]
#: The part that a kind is, and for weak kinds the parts of which one must be near.
ROLE = {"access": "id", "weak_access": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}
NEEDS = {"weak_access": ("secret",), "weak_secret": ("id",), "endpoint": ("id", "secret")}
#: A scope reaches this many characters beyond a candidate on either side.
SCOPE = 200


def found(text: Column, kind: str, pattern: str, test: str) -> Column:
    """array<struct<kind, start, end>> of a pattern's matches, leftmost and not overlapping, in code points.

    The pattern with what precedes it tiles the text, so lengths add up to positions; \\z takes the rest of the text.
    """
    tiled = F.lit(r"(?s).*?" + pattern)
    whole, hit = F.regexp_extract_all(text, tiled, F.lit(0)), F.regexp_extract_all(text, tiled, F.lit(1))
    value = F.regexp_extract_all(text, tiled, F.lit(2)) if kind == "assign" else hit
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    least = 6 if kind == "assign" else 1

    def placed(tiles: Column) -> Column:
        before = running(F.transform(tiles, lambda x: F.length(x["whole"])), F.lit(0), lambda a, b: a + b)
        ends = F.zip_with(tiles, before, lambda x, at: F.struct(F.length(x["value"]).alias("n"), F.length(x["hit"]).alias("hit"), (at + F.length(x["whole"])).alias("end")))
        long = F.filter(ends, lambda x: x["n"] >= least)
        return F.transform(long, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (x["end"] - x["hit"]).alias("start"), x["end"].alias("end")))

    tiles = F.arrays_zip(whole.alias("whole"), hit.alias("hit"), value.alias("value"))
    return F.when(text.rlike(test), F.transform(F.array(tiles), placed)[0]).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three strong kinds, by kind and start."""
    return F.concat(*(found(text, *x) for x in BASE))


def weak_spans(text: Column) -> Column:
    return F.concat(*(found(text, *x) for x in WEAK))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    flipped = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(flipped, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def linked(parts: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """Weak candidates with a complementary part in scope: key columns and their spans as an array.

    parts: key columns and spans. An interval [start, end] is joined with those of the other role that begin by end + scope and
    end at start - scope or later. Both sides are swept in order of position, keeping the furthest end of each role so far, so
    a document with many parts takes time in proportion to them and no pairs are made.
    """
    rows = parts.select(*key, F.explode("spans").alias("s")).select(*key, "s.*")
    kind_of = F.element_at(F.array(*(F.lit(ROLE[k]) for k in KINDS)), F.col("kind") + 1)
    begins = rows.select(*key, kind_of.alias("role"), F.col("start").alias("at"), F.lit(0).alias("asks"), "kind", "start", "end")
    asks = rows.where(F.col("kind") >= len(BASE)).select(*key, F.lit(None).cast("string").alias("role"), (F.col("end") + scope).alias("at"), F.lit(1).alias("asks"), "kind", "start", "end")
    sweep = Window.partitionBy(*key).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    furthest = {r: F.max(F.when(F.col("role") == r, F.col("end"))).over(sweep) for r in ("id", "secret")}
    swept = begins.union(asks).select("*", *(v.alias(f"far_{r}") for r, v in furthest.items())).where("asks = 1")
    near = lambda r: F.coalesce(F.col(f"far_{r}") >= F.col("start") - scope, F.lit(False))
    wanted = F.lit(False)
    for kind, roles in NEEDS.items():
        some = F.lit(False)
        for r in roles:
            some = some | near(r)
        wanted = wanted | ((F.col("kind") == KINDS.index(kind)) & some)
    return swept.where(wanted).groupBy(*key).agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, base and spans (arrays of kind number, start, end in code points, end exclusive) of every whole text.

    base holds the strong parts, spans also the linked weak ones, both by start, then kind. Null and empty texts have none.
    Repeated rows give equal rows, null ids stay null. Other columns are not carried on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), in_order(base_spans(text)).alias("base"), weak_spans(text).alias("weak"))
    light = written(light, "spans")
    # weak candidates only matter where another part is
    some = light.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)).dropDuplicates(["doc_id", "text_hash"])
    more = linked(some.select("doc_id", "text_hash", F.concat("base", "weak").alias("spans")), ["doc_id", "text_hash"], scope)
    more = more.select(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"), "more")
    both = light.join(more, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("k2")), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return both.select("doc_id", "text_hash", "base", in_order(F.concat("base", F.coalesce("more", none))).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with the union of its spans (sorted by start) masked; each stretch becomes one mask. Null stays null."""

    def masked(own: Column) -> Column:
        # what spans before a span have covered, up to which place
        upto = running(F.transform(own, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        both = F.zip_with(own, upto, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end")))
        gap = lambda x: F.substr(text, x["at"] + 1, x["start"] - x["at"])
        piece = lambda x, i: F.when(x["start"] > x["at"], F.concat(gap(x), F.lit(mask))).when(i == 0, F.lit(mask)).otherwise("")
        end = F.array_max(F.transform(own, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(both, piece), ""), F.substr(text, end + 1, F.length(text) + 1))

    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(spans), masked)[0])
