import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import product

import pytest

from quillmark.llm import conversation_repair as repair
from quillmark.llm import queries

TURNS = "conv_id bigint, turn bigint, role string, text string"


def damaged_rows(table):
    """What the contract says, row by row; conversations without rows stay as empty lists."""
    out = defaultdict(list)
    for conv, turn, role, text in table:
        own = out[conv]
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, marks):
    """Labels relaxed over rows and states until nothing changes: no heap, no meeting in the middle."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, 0): (0, "", ())}

    def offer(node, label):
        if node not in best or label[:2] < best[node][:2]:
            best[node] = label
            return True
        return False

    for i in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for q, x in product(range(4), "ua"):
                if (i, q) in best and (q, x) in step:
                    c, a, made = best[i, q]
                    changed |= offer((i, step[q, x]), (c + 5, a + "I", (*made, ("user" if x == "u" else "assistant", ""))))
        if i == len(rows):
            break
        _, role, text = rows[i]
        for q in range(4):
            if (i, q) not in best:
                continue
            c, a, made = best[i, q]
            offer((i + 1, q), (c + 2, a + "D", made))
            if marks[i] in ("", "truncated"):
                more = 5 * (marks[i] == "truncated")
                if (q, role[:1]) in step:
                    offer((i + 1, step[q, role[:1]]), (c + more, a + "K", (*made, (role, text))))
                for x, given in (("u", "user"), ("a", "assistant")):
                    if (q, x) in step:
                        offer((i + 1, step[q, x]), (c + 1 + more, a + "R", (*made, (given, text))))
    return min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)


def plain(table):
    out = {}
    for conv, rows in damaged_rows(table).items():
        marks = faults(rows)
        turns = {r[0] for r in rows if r[0] is not None}
        initials = [r[1][:1] for r in rows]
        cost, audit, made = plain_repair(rows, marks)
        digest = sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def results(rows, **sizes):
    return {r.conv_id: tuple(r)[1:] for r in repair.digests(repair.repair(rows, **sizes)).collect()}


def test_query_equals_plain_repair(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = queries.op11_conversation_repair(spark, folder)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == plain(table)


def odd_table(seed, convs=40, most=14):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle"]
    texts = ["Yes.", "No!", "so it goes", "Why? ", "", " \t", None, "Yes.", "é 😀.", "\n\x0b"]
    out = [(c if c else None, r.choice([None, *range(8)]), r.choice(roles[: r.choice([2, 9])]), r.choice(texts)) for c in range(convs) for _ in range(r.randint(1, most))]
    return out + out[:7]


@pytest.mark.parametrize("rows_each", [1, 3, 256])
def test_nulls_ties_repeats_and_parts(spark, rows_each):
    table = odd_table(rows_each)
    frame = spark.createDataFrame([(*x, "clash", 1) for x in table], TURNS + ", audit string, part int").repartition(3)
    assert results(repair.damaged(frame), rows_each=rows_each) == plain(table)


def test_one_conversation_over_many_tasks(spark):
    """A third of all rows and more in one conversation, one row very often."""
    r = random.Random(3)
    table = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["Well.", f"No {t}.", "and so on", f"{t}!"])) for t in range(900)] + [(1, 5, "user", "Again.")] * 300
    table += [(c, t, "user", "Hm.") for c in range(2, 30) for t in range(3)]
    frame = spark.createDataFrame(table, TURNS).repartition(4)
    assert results(repair.damaged(frame), rows_each=40) == plain(table)


def test_meeting_searches_equal_relaxation():
    r = random.Random(9)
    for _ in range(400):
        rows = [(0, r.choice(["user", "assistant", "system", "x"]), f"t{r.randint(0, 3)}" + r.choice([".", ""])) for _ in range(r.randint(0, 9))]
        marks = faults(rows)
        lattice = repair.Lattice([(None, False, 1) if m in ("blank", "duplicate") else (role[:1], m == "truncated", 1) for (_, role, _), m in zip(rows, marks, strict=True)])
        cost, audit, made = plain_repair(rows, marks)
        assert lattice.cheapest(0, (0, 3)) == (cost, audit)
        assert [(role, text) for edit, role, text in repair.applied([x[1:] for x in rows], audit, 0) if edit != "D"] == list(made)


def test_empty_long_and_dropped(spark):
    assert repair.digests(repair.repair(repair.damaged(spark.createDataFrame([], TURNS)))).isEmpty()
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = results(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hello.")], TURNS)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
    kept = next(i for i in range(1000) if min(zlib.crc32(f"{i}:{t}".encode()) % 20 for t in (0, 1)) > 4)
    text = "very long " * 300_000 + "."
    table = [(kept, 0, "user", text), (kept, 1, "assistant", text)]
    assert results(repair.damaged(spark.createDataFrame(table, TURNS)))[kept] == plain(table)[kept]
