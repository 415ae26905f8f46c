"""Repair of the structure of conversations by bidirectional Dijkstra over an edit lattice.

A node of the lattice is a count of rows dealt with and the state of the wanted order of roles, (s?(ua)+)?; its edges are the edits:
keep, give another role, delete, insert. A forward heap from the start and a reverse heap from the end meet; all crossings of the
least cost are finished, and of these the least audit (the edits' initials) is taken.

Conversations are cut into segments of bounded size, dealt out by range of conversation and turn, so that none has to fit into one
task. A whole conversation in one segment is repaired where it lies. For a part of a longer one, the least audit between each pair of states
is found, and a fold over the parts, in order, picks among them. Two edit sequences over the same rows, of the same cost and
between the same states, are never prefixes of one another (the longer one would hold a further insertion), so the least
audits of parts make up the least audit of the whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

#: What edits cost. A truncated row that is not deleted costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State after a role's initial, by state before: 0 nothing yet, 1 system, 2 user, 3 assistant. 0 and 3 may be the end.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GIVEN = {"u": "user", "a": "assistant"}
STATES, ENDS = range(4), (0, 3)
#: Rows and characters of a segment, about; a single row may have more.
ROWS, CHARS = 256, 1_000_000

_SOLID = re.compile(r"[^\x20\x09-\x0D]")
_ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of every row, damaged by crc32 of conv_id:turn modulo 20; nulls of role and text, and in the
    key, are one space.

    copies is 0 for a row that is dropped (kept here, so that its conversation is not lost) and 2 for one that is repeated.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").when(kind == 0, "").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


class Lattice:
    """The edits of rows [(initial or None, truncated, n)]: None stands for n rows that must go."""

    def __init__(self, rows: list[tuple[str | None, bool, int]]) -> None:
        self.rows = rows

    def _edits(self, i: int) -> Iterator[tuple[int, str, dict[int, int] | None]]:
        """(cost, audit, state after by state before) of the edits that deal with row i; no map: the state stays."""
        initial, truncated, n = self.rows[i]
        if initial is None:
            yield DELETE * n, "D" * n, None
            return
        more = TRUNCATED * truncated
        yield DELETE, "D", None
        if initial in NEXT:
            yield KEEP + more, "K", NEXT[initial]
        for x in GIVEN:
            yield REROLE + more, "R", NEXT[x]

    def ahead(self, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
        for x in GIVEN:
            if q in NEXT[x]:
                yield INSERT, "I", i, NEXT[x][q]
        if i < len(self.rows):
            for cost, audit, to in self._edits(i):
                if to is None or q in to:
                    yield cost, audit, i + 1, q if to is None else to[q]

    def back(self, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
        for x in GIVEN:
            for before, after in NEXT[x].items():
                if after == q:
                    yield INSERT, "I", i, before
        if i:
            for cost, audit, to in self._edits(i - 1):
                for before, after in ((q, q),) if to is None else to.items():
                    if after == q:
                        yield cost, audit, i - 1, before

    def cheapest(self, start: int, ends: Iterable[int]) -> tuple[int, str] | None:
        """Cost and audit of the cheapest edits from a state before the rows to one of the states after them, the audit ASCII-least."""
        n = len(self.rows)
        # heaps of (cost, rows dealt with on this side, audit, state): edits that cost nothing always deal with a row, so a node's labels
        # of its least cost are all there when its first is taken
        heaps = ([(0, 0, "", start)], [(0, 0, "", q) for q in ends])
        done: tuple[dict, dict] = ({}, {})
        least: float = float("inf")
        while heaps[0] or heaps[1]:
            tops = [h[0][0] if h else float("inf") for h in heaps]
            if sum(tops) > least:
                break  # every path of the least cost has a crossing between settled nodes
            side = int(tops[1] < tops[0])
            cost, dealt, audit, q = heapq.heappop(heaps[side])
            node = (n - dealt if side else dealt, q)
            if node in done[side]:
                continue
            done[side][node] = cost, audit
            if node in done[1 - side]:
                least = min(least, cost + done[1 - side][node][0])
            for more, edit, i, to in (self.back if side else self.ahead)(*node):
                if (i, to) not in done[side]:
                    heapq.heappush(heaps[side], (cost + more, n - i if side else i, edit + audit if side else audit + edit, to))
                if (i, to) in done[1 - side]:
                    least = min(least, cost + more + done[1 - side][i, to][0])
        found = [(least, audit + done[1][node][1]) for node, (cost, audit) in done[0].items() if node in done[1] and cost + done[1][node][0] == least]
        for node, (cost, audit) in done[0].items():
            for more, edit, i, to in self.ahead(*node):
                if (i, to) in done[1] and cost + more + done[1][i, to][0] == least:
                    found.append((least, audit + edit + done[1][i, to][1]))
        return min(found, default=None)


def applied(rows: list[tuple[str, str]], audit: str, q: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) for each initial of an audit over rows (role, text), begun in state q; deleted rows stay, with their edit."""
    at = iter(rows)
    for edit in audit:
        if edit == "D":
            role, text = next(at)
        elif edit == "K":
            role, text = next(at)
            q = NEXT[role[0]][q]
        else:
            text = "" if edit == "I" else next(at)[1]
            x = "a" if q == 2 else "u"
            role, q = GIVEN[x], NEXT[x][q]
        yield edit, role, text


SEGMENT = "conv_id long, part long, alone boolean, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, roles array<string>, texts array<string>, copies array<long>, froms array<int>, tos array<int>, costs array<long>, audits array<string>"
_FACTS = ["first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last"]


def _segment(conv: int | None, part: int, alone: bool, rows: list[tuple]) -> tuple:
    """A segment's row from its rows (turn, role, text, copies, again); again: the same role and text are at an earlier turn."""
    lattice, initials, turns = [], [], []
    blank = duplicate = truncated = 0
    for turn, role, text, copies, again in rows:
        if not copies:
            continue
        turns += [turn] if turn is not None else []
        initials += [role[:1]] * min(copies, 2)
        if not _SOLID.search(text):
            blank += copies
            lattice.append((None, False, copies))
            continue
        gone = copies if again else copies - 1
        duplicate += gone
        if not again:
            cut = not _ENDED.search(text)
            truncated += cut
            lattice.append((role[:1] or "-", cut, 1))
        if gone:
            lattice.append((None, False, gone))
    # of more than two copies, all further pairs are alike, too
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)) + sum(max(r[3] - 2, 0) for r in rows)
    edits, paths = Lattice(lattice), []
    if alone:
        paths.append((0, 0, *edits.cheapest(0, ENDS)))
    else:
        paths += [(a, b, *best) for a in STATES for b in STATES if (best := edits.cheapest(a, [b]))]
    kept = [r for r in rows if r[3]]
    return (
        conv, part, alone, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), blank, duplicate, truncated, illegal, initials[0] if initials else None, initials[-1] if initials else None,
        [r[1] for r in kept], [r[2] for r in kept], [r[3] for r in kept], *map(list, zip(*paths, strict=True)),
    )


def segments(rows: DataFrame, rows_each: int = ROWS, chars_each: int = CHARS) -> DataFrame:
    """Segments of conversations (rows: conv_id, turn, role, text, copies; no nulls but in conv_id and turn), written to the shared folder.

    Equal rows are counted together before they are dealt out, so that no task gets all copies of one. Parts of one conversation
    ascend in order of turn (nulls first), role and text. A conversation that lies within one task and segment is marked alone.
    """
    counted = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.md5("text")), "turns")
    placed = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(placed).alias("at"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "at")
    met = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("at").isNotNull() & (placed > F.col("at"))
    marked = met.select("conv_id", "turn", "role", "text", "copies", again.alias("again"))
    order = ["conv_id", "turn", "role"]
    dealt = marked.repartitionByRange(*order, F.substring("text", 1, 40)).sortWithinPartitions(*order, "text")

    def cut(table: Iterator[tuple]) -> Iterator[tuple[int | None, list[tuple]]]:
        for conv, group in groupby(table, itemgetter(0)):
            held, chars = [], 0
            for _, *row in group:
                if held and (len(held) >= rows_each or chars + len(row[2]) > chars_each):
                    yield conv, held
                    held, chars = [], 0
                held.append(tuple(row))
                chars += len(row[2])
            yield conv, held

    def step(table: Iterator[tuple]) -> Iterator[tuple]:
        part, before, now = TaskContext.get().partitionId() << 40, None, None
        for after in _then_none(cut(table)):
            if now:
                # the first and last conversation of a task may go on in another
                alone = bool(before and after) and before[0] != now[0] != after[0]
                yield _segment(now[0], part, alone, now[1])
                part += 1
            before, now = now, after

    return written(map_rows(dealt, SEGMENT, step), "segments")


def _then_none(items: Iterable) -> Iterator:
    yield from items
    yield None


class Trail:
    """The parts of the cheapest edits so far, the last of them here."""

    def __init__(self, before: Trail | None, part: int, q: int, cost: int, audit: str) -> None:
        self.before, self.part, self.q, self.cost, self.audit = before, part, q, cost, audit

    def less(self, other: Trail) -> bool:
        """Whether this trail, over the same parts and as cheap, has the lesser audit."""
        a, b, one, two = self, other, [], []
        while a is not b:
            one.append(a.audit)
            two.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(one)) < "".join(reversed(two))


def _chosen(parts: Iterable[tuple]) -> list[Trail]:
    """The trail of a conversation through its parts (part, froms, tos, costs, audits), in order."""
    best: dict[int, Trail | None] = {0: None}
    for part, *paths in parts:
        after: dict[int, Trail] = {}
        for a, b, cost, audit in zip(*paths, strict=True):
            if a in best:
                trail = Trail(best[a], part, a, cost + (best[a].cost if best[a] else 0), audit)
                if b not in after or trail.cost < after[b].cost or (trail.cost == after[b].cost and trail.less(after[b])):
                    after[b] = trail
        best = after
    ends = [best[q] for q in ENDS if q in best]
    top = ends[0]
    for trail in ends[1:]:
        if trail.cost < top.cost or (trail.cost == top.cost and trail.less(top)):
            top = trail
    out = []
    while top:
        out.append(top)
        top = top.before
    return out[::-1]


def repair(rows: DataFrame, rows_each: int = ROWS, chars_each: int = CHARS) -> DataFrame:
    """Repaired conversations, in parts: conv_id, part (ascending within a conversation), the facts of the part's rows (first_turn,
    last_turn, turns, blank, duplicate, truncated, illegal, first, last), cost, audit, and of each edit: edits, roles, texts.

    rows: conv_id, turn, role, text, copies (see damaged()). A conversation's rows go by turn, nulls first; rows of one turn by role,
    then text. Rows without words are blank; rows whose role and text are met earlier are duplicates; other rows that don't end as a sentence are
    truncated. A role begins with what its first character says; an empty role can't be kept. A null conv_id is one conversation.
    Rows of copies 0 only name their conversation, whose repair is then empty. An empty table gives no rows.
    """
    cut = segments(rows, rows_each, chars_each)
    sides = ["part", "froms", "tos", "costs", "audits"]
    long = cut.where("not alone").select("conv_id", *sides).repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def fold(table: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(table, itemgetter(0)):
            before = 0
            for trail in _chosen(row[1:] for row in group):
                yield trail.part, trail.q, trail.cost - before, trail.audit
                before = trail.cost

    picked = map_rows(long, "part long, q int, cost long, audit string", fold)
    own = ["conv_id", *_FACTS, "roles", "texts", "copies"]
    whole = cut.where("alone").select("part", *own, F.lit(0).alias("q"), F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    both = whole.unionByName(cut.where("not alone").select("part", *own).join(picked, "part"))

    def apply(table: Iterator[tuple]) -> Iterator[tuple]:
        for part, conv, *facts, roles, texts, copies, q, cost, audit in table:
            every = [(r, t) for r, t, n in zip(roles, texts, copies, strict=True) for _ in range(n)]
            done = list(applied(every, audit, q))
            yield (conv, part, *facts, cost, audit, *(map(list, zip(*done, strict=True)) if done else ([], [], [])))

    kinds = dict(x.split() for x in SEGMENT.split(", "))
    schema = ", ".join(["conv_id long", "part long", *(f"{x} {kinds[x]}" for x in _FACTS), "cost long", "audit string", "edits array<string>", "roles array<string>", "texts array<string>"])
    return map_rows(both, schema, apply)


def digests(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of repair()'s parts: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Parts pass by in order and only sums, the audit and the running hash of a conversation are held, not its texts.
    """

    def step(table: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(table, itemgetter(0)):
            first = last = initial = None
            turns = blank = duplicate = truncated = illegal = cost = 0
            audit, digest, some = [], sha256(), False
            for _, _, first_turn, last_turn, n, b, d, t, i, begins, ends, c, edits, kinds, roles, texts in group:
                turns += n - (last is not None and first_turn == last)
                first, last = first_turn if first is None else first, last if last_turn is None else last_turn
                illegal += i + (initial is not None and begins is not None and initial + begins not in ("su", "ua", "au"))
                initial = initial if ends is None else ends
                blank, duplicate, truncated, cost = blank + b, duplicate + d, truncated + t, cost + c
                audit.append(edits)
                for kind, role, text in zip(kinds, roles, texts, strict=True):
                    if kind != "D":
                        digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                        some = True
            yield conv, 0 if first is None else last - first + 1 - turns, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()

    own = ["conv_id", "part", *_FACTS, "cost", "audit", "edits", "roles", "texts"]
    dealt = repaired.select(*own).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return map_rows(dealt, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", step)
