"""BPE, token counts, SimHash, substring dedup and media against brute force and exact round trips."""

import hashlib
import json
import math
import random
import struct
import zlib
from array import array

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import bpe, media, queries, simhash, substring_dedup, token_counts

VOCABULARY = queries.VOCABULARY


def ids_of(data):
    out = array("I")
    out.frombytes(data)
    return out.tolist()


def test_bpe_equals_the_library(docs, rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(docs, VOCABULARY), VOCABULARY).collect()}
    for doc, text, *_ in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids_of(got[doc].ids) == want
        assert got[doc].decoded == tokenizer.decode(want, skip_special_tokens=False) == (text or "")


def test_bpe_random_strings():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    encoder = bpe.encoder(bpe.vocabulary_text(VOCABULARY))
    r = random.Random(1)
    signs = ["a", "B", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'ll", "é", "中", "👨‍👩‍👧", "٣", "²", "!", "<|endoftext|>", "\x00", "the"]
    for _ in range(500):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 30)))
        assert ids_of(encoder.packed(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_forgets_without_changing_results(monkeypatch):
    text = " ".join(f"word{i} thing{i % 7}" for i in range(300))
    own = bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_text(VOCABULARY)))
    want = own.packed(text)
    for name in ("KEPT_WORDS", "KEPT_PAIRS", "KEPT_LENGTH"):
        monkeypatch.setattr(bpe, name, 5)
    small = bpe.Encoder(own.v)
    assert small.packed(text) == want and small.packed(text[:100]) == own.packed(text[:100])


def greedy(word, initial, continuing):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (continuing if at else initial)), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_token_counts(docs, rows):
    initial, continuing = token_counts.word_pieces(bpe.Vocabulary(bpe.vocabulary_text(VOCABULARY)))
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, VOCABULARY).collect()}
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        assert (got[doc].n_words, got[doc].n_tokens) == (len(words), sum(greedy(w, initial, continuing) for w in words))


def test_longest_match_with_unknown_words():
    r = random.Random(2)
    for _ in range(200):
        initial = {bytes(r.choices(b"abc", k=r.randint(1, 4))) for _ in range(6)}
        continuing = {bytes(r.choices(b"abc", k=r.randint(1, 4))) for _ in range(6)}
        machine = token_counts.LongestMatch(initial, continuing)
        for _ in range(50):
            word = bytes(r.choices(b"abc", k=r.randint(0, 9)))
            assert machine.count(word) == greedy(word, initial, continuing)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """prints: by id."""
    ids, root = sorted(prints), {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= radius and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash(docs, rows):
    want = {doc: plain_fingerprint(text) for doc, text, *_ in rows}
    root = plain_components(want, 2)
    for size in (20_000, 2):
        got = simhash.near_duplicates(docs, tree_size=size).collect()
        assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == want
        assert {r.doc_id: r.component_id for r in got} == root


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_near_copies(texts, radius=3, least=0.8):
    """Who goes, and for whom, by the rule in the docstring of near_copies()."""
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in texts.items()}
    leaders: dict[str, int] = {}
    gone = {d: leaders[t] for d, t in sorted(texts.items()) if leaders.setdefault(t, d) != d}
    prints = {d: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in sets[d]) > len(sets[d])) for d in leaders.values()}
    near = {d: root for d, root in plain_components(prints, radius).items() if d != root and jaccard(sets[d], sets[root]) >= least}
    kept: list[int] = []
    went: dict[int, int] = {}

    def decide(d, out):
        if like := [k for k in sorted(kept) if jaccard(sets[d], sets[k]) >= least]:
            out[d] = like[0]
        else:
            kept.append(d)

    for d in sorted(set(texts) - set(gone) - set(near)):
        decide(d, went)
    lost = {d: went[root] for d, root in near.items() if root in went}
    near = {d: root for d, root in near.items() if d not in lost}
    near |= {d: k for d, k in lost.items() if jaccard(sets[d], sets[k]) >= least}
    fixed = list(kept)
    anew = sorted(set(lost) - set(near))
    for d in anew:
        if like := [k for k in fixed if jaccard(sets[d], sets[k]) >= least]:
            near[d] = min(like)
    for d in sorted(set(anew) - set(near)):
        decide(d, near)
    return gone | near | went


def holds(gone, sets, least=0.8):
    """No two kept texts are alike, and each text that goes is alike to one that stays."""
    kept = set(sets) - set(gone)
    assert not [(a, b) for a in kept for b in kept if a < b and jaccard(sets[a], sets[b]) >= least]
    assert not [d for d in gone if max(jaccard(sets[d], sets[k]) for k in kept) < least]


@pytest.mark.parametrize("group", [8192, 3])
def test_near_copies(spark, group):
    r = random.Random(3)
    texts, base = {}, []
    for i in range(12):
        words = [f"w{r.randint(0, 3000)}" for _ in range(200)]
        base.append(i * 10)
        texts[i * 10] = " ".join(words)
        for j in range(1, 6):
            own = list(words)
            for _ in range(r.randint(0, 3) if j < 5 else 60):
                own[r.randrange(200)] = f"e{r.randint(0, 9999)}"
            texts[i * 10 + j] = " ".join(own)
    texts |= {900: "", 901: " ", 902: "tiny text", 903: "Tiny TEXT", 904: "other"}
    frame = spark.createDataFrame([*texts.items(), (None, texts[0]), (0, texts[0]), (905, None)], "doc_id long, text string")
    gone = {x.doc_id: x.leader for x in simhash.near_copies(frame, group=group).collect()}
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in texts.items()} | {905: sets_of_nothing()}
    kept = set(sets) - set(gone)
    for d, leader in gone.items():
        assert leader != d and jaccard(sets[d], sets[leader]) >= 0.8 and gone.get(leader, leader) in kept
    assert gone.keys() == plain_near_copies({d: t or "" for d, t in texts.items()} | {905: ""}).keys()
    pairs = [(a, b) for a in kept for b in kept if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert pairs == [] and set(base) <= kept and {5 + 10 * i for i in range(12)} <= kept
    assert {900, 902, 904} <= kept and not {901, 903, 905} & kept


@pytest.mark.parametrize("group", [8192, 2])
def test_near_copies_with_passages(spark, group):
    """Passages appended or replaced, and chains of near copies: by one rule whatever the group."""
    r = random.Random(4)
    fresh = lambda n: [f"v{r.randint(0, 10**9)}" for _ in range(n)]
    texts = {}
    for i in range(30):
        base = fresh(r.choice([100, 200, 400]))
        n = len(base)
        own = [base, base + fresh(n * r.choice([10, 15, 20, 24]) // 100), base[: n - n // 11] + fresh(n // 11)]
        own += [base[n // 12 :] + fresh(n // 12), base[n // 6 :] + fresh(n // 6), base[n // 4 :] + fresh(n // 4)]
        texts |= {d: " ".join(w) for d, w in zip(r.sample(range(i * 10, i * 10 + 10), len(own)), own, strict=True)}
    gone = {x.doc_id: x.leader for x in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), group=group).collect()}
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in texts.items()}
    want = plain_near_copies(texts)
    assert gone.keys() == want.keys() and len(want) > 30
    assert all(k != d and jaccard(sets[d], sets[k]) >= 0.8 for d, k in gone.items())
    holds(gone, sets)


@pytest.mark.parametrize("group", [8192, 2])
def test_every_dropped_text_has_a_kept_copy(spark, group):
    """Chains in which the first of a SimHash group goes for a text that others of the group are not alike to."""
    r = random.Random(11)
    texts, at = {}, 0
    for _ in range(60):
        base = [f"c{r.randint(0, 10**9)}" for _ in range(300)]
        first, second, third = list(base), list(base), list(base)
        first[:24] = [f"p{r.randint(0, 10**9)}" for _ in range(24)]  # alike to base
        third[-26:] = [f"s{r.randint(0, 10**9)}" for _ in range(26)]  # alike to base, not to first
        second[150] = "x"
        fourth = list(third)
        fourth[100] = "y"
        for own in (first, second, third, fourth):
            texts[at] = " ".join(own)
            at += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = simhash.near_copies(frame, group=group, radius=12)
    gone = {x.doc_id: x.leader for x in found.collect()}
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in texts.items()}
    holds(gone, sets)
    assert gone.keys() == plain_near_copies(texts, radius=12).keys() and len(gone) > 60


def test_templates_make_no_pairs_of_their_texts(spark, monkeypatch):
    """Texts that fill in one template, just below the threshold, are compared with few others, not all."""
    r = random.Random(12)
    template = [f"t{i}" for i in range(88)]
    compared = []
    alike = simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *rest: (compared.append(pairs.count()), alike(pairs, *rest))[1])
    for n in (100, 200):
        texts = {i: " ".join([*template, *(f"o{r.randint(0, 10**9)}" for _ in range(12))]) for i in range(n)}
        texts |= {n + 1: " ".join(template + template[:5])}
        compared.clear()
        gone = {x.doc_id for x in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        assert gone == plain_near_copies(texts).keys() and sum(compared) <= 3 * n


def test_what_several_texts_hold_is_shown_late(spark, monkeypatch):
    """Fifteen texts that quote one passage beside three times as many words of their own aren't paired by it."""
    met = []
    pairs = simhash._pairs
    monkeypatch.setattr(simhash, "_pairs", lambda some, index: (met.append(pairs(some, index)), met[-1])[1])
    passage = [f"p{i}" for i in range(30)]
    texts = {d: " ".join([*(f"o{d}x{i}" for i in range(50)), *passage, *(f"o{d}y{i}" for i in range(50))]) for d in range(15)}
    assert simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).isEmpty()
    assert met and sum(frame.count() for frame in met) == 0


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_near_copies_where_ids_repeat(spark, monkeypatch, few):
    """Ids that come with several texts or rows, copies and null ids; by broadcast and by shuffle."""
    monkeypatch.setattr(simhash, "FEW", few)
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two), (4, two + " end"), (None, one), (5, one + " end"), (6, None)]
    gone = {r.doc_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {4, 5} <= gone and not gone & {1, 6, None}


@pytest.mark.parametrize("few", [0, 3, 100])
def test_comparisons_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    """The same pairs, whether ids are few or not; no pairs, and ids without a set, give none."""
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(5)
    held = {d: np.unique(np.array([r.randrange(30) for _ in range(r.randint(1, 40))], np.uint64)) for d in range(20)}
    sets = spark.createDataFrame([(d, x.tobytes()) for d, x in held.items()], "doc_id long, shingles binary")
    pairs = [(a, b) for a in range(22) for b in range(a)]
    alike = lambda a, b: len(set(held[a]) & set(held[b])) >= 0.6 * len(set(held[a]) | set(held[b]))
    want = sorted((a, b) for a, b in pairs if a in held and b in held and alike(a, b))
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(map(tuple, simhash._alike(frame, sets, 0.6).collect())) == want and want
    assert simhash._alike(frame.where("a < 0"), sets, 0.6).isEmpty()


@pytest.mark.parametrize("seen", [1 << 20, 1 << 5])
def test_near_copies_of_a_table(spark, monkeypatch, seen):
    """Every pair at 0.8 or more has lost a member, and the rest is as the plain rule has it, with crowded slots, too."""
    monkeypatch.setattr(simhash, "SEEN", seen)
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in frame.collect()}
    gone = {r.doc_id: r.leader for r in simhash.near_copies(frame).collect()}
    assert gone.keys() == plain_near_copies(texts).keys() and len(gone) > 50


def sets_of_nothing():
    return set(simhash.shingle_hashes(b"", 5).tolist())


@pytest.mark.parametrize("radius", [0, 2, 3, 20])
def test_flat_tree(radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(30)]
    values = sorted({v ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) & (1 << 64) - 1 for v in base * 40})
    asked = r.sample(values, 600) + [r.getrandbits(64) for _ in range(100)]
    tree = simhash.BKTree()
    for v in values + values[:10]:
        tree.insert(v)
    flat = simhash.FlatTree(tree.packed())
    got = list(flat.within(np.array(asked, np.uint64), radius))
    want = [(a, v) for a in asked for v in values if (a ^ v).bit_count() <= radius]
    assert sorted(got) == sorted(want)
    assert sorted((a, v) for a in asked for v in tree.within(a, radius)) == sorted(want)


def test_simhash_chains(spark):
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(40)]
    for _ in range(120):
        v = r.choice(values)
        for _ in range(r.randint(1, 3)):
            v ^= 1 << r.randrange(64)
        values.append(v)
    values = sorted(set(values))
    want = plain_components(dict(enumerate(values)), 2)
    signed = [v - (v >> 63 << 64) for v in values]
    place = {v: i for i, v in enumerate(signed)}
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    for size, sent in ((20_000, 0), (7, 1 << 20), (7, 0)):  # one tree a bucket, trees broadcast, trees sent by a shuffle
        edges = simhash.components(simhash.links(nodes, 2, tree_size=size, sent=sent)).collect()
        group = {i: {i} for i in place.values()}
        for node, root in edges:
            a, b = group[place[node]], group[place[root]]
            a |= b
            for i in a:
                group[i] = a
        assert {i: min(g) for i, g in group.items()} == want


def plain_removal(texts):
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out[d] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


@pytest.mark.parametrize("bits", [27, 5])
def test_substring_dedup(docs, rows, bits):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, set_bits=bits).collect()}
    assert got == plain_removal({r[0]: r[1] for r in rows})


def test_substring_dedup_on_few_words(spark):
    r = random.Random(8)
    texts = {i: " ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for i in range(60)}
    texts |= {100 + i: "x y " * r.randint(1, 90) for i in range(6)}
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got.collect()} == plain_removal(texts)


def test_substring_dedup_without_ids(spark):
    text = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    one, two, shared = text("a", 30), text("b", 40), text("s", 20)
    top = (1 << 63) - 1
    rows = [(1, one), (None, one), (None, two), (None, shared + " " + text("c", 9)), (None, shared + " " + text("d", 9)), (5, text("e", 25)), (5, text("f", 9) + " " + one), (top, two)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # unnamed copies of 1 and of the largest id go, others with no id or the same id keep what is only theirs
    want = [(1, one), (None, ""), (None, ""), *rows[3:6], (5, text("f", 9)), (top, two)]
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(d), t) for d, t in want)


def test_media_round_trip(docs, rows):
    stored = media.store_media(docs)
    read = {r.doc_id: r for r in media.read_media(stored).collect()}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        payload = bytes(read[doc].payload)
        assert payload.startswith(data) and not payload[len(data) :].strip(b" ") and len(payload) % 192 == 0 and 0 < len(payload) - len(data) + (len(data) > 0) <= 192 + 1
        assert read[doc].n_frames == len(payload) // 192 and read[doc].start_ms[0] == 0 and read[doc].end_ms[-1] == 40 * read[doc].n_frames
    assert media.clips(media.read_media(stored)).where("start_ms >= end_ms").isEmpty()


def test_media_any_bytes_and_damage(monkeypatch):
    payload = bytes(range(256)) * 3
    whole = media.write_avi(payload)
    assert media.read_avi(whole)[1] == payload
    monkeypatch.setattr(media, "TOGETHER", 3)
    long = b"abc" * 640
    assert media.read_avi(media.write_avi(long))[1] == long
    plain = media.write_avi(b"a" * 384)
    for bad in (b"", plain[:50], plain.replace(b"\xff\xd8", b"\xff\xd7", 1), plain[:-20], plain.replace(b"\0a\0a", b"\1a\0a", 1)):
        with pytest.raises((ValueError, StopIteration, IndexError)):
            media.read_avi(bad)


def test_media_shots_find_a_cut():
    r = random.Random(1)
    calm = lambda base: bytes(base + r.randint(0, 3) for _ in range(192 * 40))
    assert 40 in media.shots(media.read_avi(media.write_avi(calm(60) + calm(180)))[2])
    # a change in the last component alone is a cut, too
    one = lambda base: b"".join(calm(60)[:128] + bytes(base + r.randint(0, 3) for _ in range(64)) for _ in range(40))
    assert 40 in media.shots(media.read_avi(media.write_avi(one(60) + one(180)))[2])


def plain_samples(block, steps):
    """Samples (8 x 8) of one block by the sums in the definition of the inverse DCT."""
    zigzag = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    scale = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    out = []
    for x in range(8):
        for y in range(8):
            total = sum(c * q * scale(u) * scale(v) / 4 * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for c, q, (u, v) in zip(block, steps, zigzag, strict=True) if c)
            out.append(min(255.0, max(0.0, total + 128)))
    return out


def test_media_histograms_equal_a_plain_loop():
    r = random.Random(6)
    payload = bytes(r.choice(b"etaoin shrdlu,.") for _ in range(192 * 6))
    want = []
    for f in range(6):
        hist = []
        for c in range(3):
            own = payload[f * 192 + c * 64 : f * 192 + c * 64 + 64]
            samples = plain_samples([b - 255 if b < 128 else b for b in own], [1] * 64)
            hist += [sum(int(s // 16) == k for s in samples) for k in range(16)]
        want.append(hist)
    got = media.read_avi(media.write_avi(payload))[2]
    assert got.shape == (6, 48) and abs(got - want).sum() <= 12  # the kernel has whole 1/4096ths, so of 1,152 samples a few may cross a bin's bound


def other_writer(blocks, steps, width, height, sampling, restart=0):
    """A baseline frame by canonical Huffman codes of many lengths. blocks: by component, in order of the scan."""
    used = [{0} | {i for i in range(12)}, {0, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)}]
    codes, segments = [], b""
    for kind, symbols in enumerate(used):
        order, counts, code, table, length = sorted(symbols), [0] * 16, 0, {}, 2
        while order:  # one code of each short length, then all others
            take = order if (1 << length) - code > len(order) else order[:1]  # all ones are no code
            for s in take:
                table[s] = f"{code:0{length}b}"
                code += 1
            counts[length - 1], order = len(take), order[len(take) :]
            code, length = code << 1, length + 1
        codes.append(table)
        segments += media._segment(0xC4, bytes([kind << 4]) + bytes(counts) + bytes(table))
    bits, out, scan = "", b"", b""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        data = int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""
        bits = ""
        return data.replace(b"\xff", b"\xff\0")

    def put(value, size):
        return f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""

    n = len(blocks[0]) // (sampling[0][0] * sampling[0][1])
    before, at = [0] * len(blocks), [0] * len(blocks)
    for unit in range(n):
        if restart and unit and unit % restart == 0:
            out += flush() + bytes([255, 0xD0 + (unit // restart - 1) % 8])
            before = [0] * len(blocks)
        for c, (a, d) in enumerate(sampling):
            for _ in range(a * d):
                block = blocks[c][at[c]]
                at[c] += 1
                diff, before[c] = block[0] - before[c], block[0]
                bits += codes[0][abs(diff).bit_length()] + put(diff, abs(diff).bit_length())
                last = max((k for k in range(1, 64) if block[k]), default=0)
                run = 0
                for k in range(1, last + 1):
                    if not block[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits += codes[1][0xF0]
                        run -= 16
                    size = abs(block[k]).bit_length()
                    bits += codes[1][run << 4 | size] + put(block[k], size)
                    run = 0
                if last < 63:
                    bits += codes[1][0]
    scan = out + flush()
    head = b"\xff\xd8" + b"".join(media._segment(0xDB, bytes([i]) + bytes(q)) for i, q in enumerate(steps))
    head += media._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(blocks)) + b"".join(bytes([i + 1, a << 4 | d, i % len(steps)]) for i, (a, d) in enumerate(sampling)))
    head += segments + (media._segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    head += media._segment(0xDA, bytes([len(blocks)]) + b"".join(bytes([i + 1, 0]) for i in range(len(blocks))) + b"\0\x3f\0")
    return head + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_media_reads_another_writers_frames(restart):
    r = random.Random(9)
    block = lambda: [r.randint(-200, 200), *(r.randint(-60, 60) if r.random() < 0.2 else 0 for _ in range(63))]
    sampling = [(2, 2), (1, 1), (1, 1)]
    blocks = [[block() for _ in range(6 * a * d)] for a, d in sampling]  # 48 x 32 samples: six units of 16 x 16
    steps = [[1 + k // 4 for k in range(64)], [3 + k // 2 for k in range(64)]]
    frame = other_writer(blocks, steps, 48, 32, sampling, restart)
    got = media.decode_frame(frame)
    assert [x.tolist() for x in got] == blocks
    own = media.layout(frame)
    assert not own.plain() and own.steps().tolist() == [steps[0], steps[1], steps[0]]
    hist = media.histograms([x[None] for x in got], own.steps())
    for c in range(3):
        samples = [s for b in blocks[c] for s in plain_samples(b, steps[c % 2])]
        assert abs(hist[0, c * 16 : c * 16 + 16] - [sum(int(s // 16) == k for s in samples) for k in range(16)]).sum() <= 8
    for bad in (frame[:-40] + b"\xff\xd9", frame.replace(b"\xff\xc0", b"\xff\xc2", 1), frame[:60]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.decode_frame(bad)


def test_media_of_nothing(spark):
    read = media.read_media(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary"))
    assert [tuple(r) for r in read.collect()] == [(1, 0, None, None, None, 0, [], [], [])] and media.clips(read).isEmpty()


def test_queries_have_the_contract_columns(spark):
    got = queries.op8_media(spark, "/root/testdata/sf0.001").limit(3).collect()
    for r in got:
        assert r.payload_bytes % 192 == 0 and len(r.payload_sha256) == 64
    r = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == got[0].doc_id).first()
    payload = media.padded(r.text.encode())
    assert (got[0].payload_sha256, got[0].tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert json.dumps(got[0].asDict())


def test_odd_tables(odd, empty):
    for f in (lambda d: bpe.bpe_encode(d, VOCABULARY), lambda d: token_counts.count_tokens(d, VOCABULARY), simhash.near_duplicates, substring_dedup.remove_repeats, media.store_media):
        assert f(empty).collect() == []
        got = f(odd).collect()
        assert len(got) == 4 and sum(r.doc_id is None for r in got) == 1
        twice = [r for r in got if r.doc_id == 18]
        assert len(twice) == 2 and twice[0] == twice[1]
