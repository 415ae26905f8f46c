"""BPE encoding and decoding by prefix-sharing trie traversal.

A task inserts its distinct words into a trie and goes through it depth first. A node's state is the last token of the encoding of
the bytes on its path; it follows from the states above it, so the encoding of a prefix that words share is computed once. Which
tokens may end at a node an automaton over the vocabulary tells, the longest first; the first that fits the encoding before it is
the state. Words in byte order are the trie's leaves in depth-first order, so only the path to the current leaf is held.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: What the byte-level pre-tokenizer splits by (fixed value). White space is the Unicode property.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: The same for ASCII text, for a faster engine.
ASCII_WORDS = r""" ?[A-Za-z]++| ?[0-9]++|'(?:[stmd]|re|ve|ll)| ?[^\x20\x09-\x0DA-Za-z0-9]++|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+"""
#: Bounds of what a Python worker keeps: words with their ids, longest such word, judged token pairs. Beyond them it starts
#: anew, which changes no result.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 300_000, 64, 250_000
#: Characters of the texts whose words are learned together.
BATCH = 2_000_000


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by its rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """Each id's bytes, of a vocabulary in the JSON form of the tokenizers library."""
    of = byte_chars()
    special = {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return {i: bytes(of[c] for c in s) for s, i in spec["model"]["vocab"].items() if i not in special} | special


class Vocabulary:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = token_bytes(spec)
        self.ids = {self.bytes[i]: i for i in ids.values()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        size = max(self.bytes) + 1
        #: the rank of the merge that makes a token (-1: a byte), and the two halves that it merges
        self.rank, self.halves = array("i", [-1]) * size, [(-1, -1)] * size
        for rank, (a, b) in enumerate(pairs):
            self.rank[ids[a + b]], self.halves[ids[a + b]] = rank, (ids[a], ids[b])
        self.sizes = array("i", [len(self.bytes.get(i, b"")) for i in range(size)])
        self.splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._automaton()

    def _automaton(self) -> None:
        """Trie of the tokens that bytes or merges make, with failure links; longest is the longest token that ends at a node, and
        shorter the longest token that is a proper ending of a token (-1: none)."""
        child: dict[int, int] = {}
        fail, longest, above = array("i", [0]), array("i", [-1]), [(0, 0)]
        self.shorter = array("i", [-1]) * len(self.rank)
        for data, token in self.ids.items():
            if len(data) > 1 and self.rank[token] < 0:
                continue
            node = 0
            for byte in data:
                below = child.get(node << 8 | byte)
                if below is None:
                    below = child[node << 8 | byte] = len(above)
                    above.append((node, byte))
                    longest.append(-1)
                node = below
            longest[node] = token
        fail = array("i", [0]) * len(above)
        depth = array("i", [0]) * len(above)
        for node in range(1, len(above)):
            depth[node] = depth[above[node][0]] + 1
        for node in sorted(range(1, len(above)), key=depth.__getitem__):
            parent, byte = above[node]
            at = parent
            while at:
                at = fail[at]
                if (found := child.get(at << 8 | byte)) is not None:
                    fail[node] = found
                    break
            if longest[node] >= 0:
                self.shorter[longest[node]] = longest[fail[node]]
            else:
                longest[node] = longest[fail[node]]
        if any(b not in child for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.child, self.fail, self.longest = child, fail, longest

    def fits(self, left: int, right: int) -> bool:
        """Whether bytes that encode as left and bytes that encode as right encode as just those two when put together.

        Merges are undone from the last one back. Between two of them, the pieces that meet at the border must have no merge of
        their own that would have come first: one of lower rank, or of equal rank further left.
        """
        merges, rank, halves = self.merges, self.rank, self.halves
        limit = 1 << 40
        while True:
            if merges.get(left << 20 | right, limit) < limit:
                return False
            if rank[left] > rank[right]:
                limit = rank[left]
                left = halves[left][1]
            elif rank[right] >= 0:
                limit = rank[right] + 1
                right = halves[right][0]
            else:
                return True


class PrefixTrie:
    """The trie of words, of which only the path to the current word is held: each node's last token and place in the automaton."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}

    def encode_all(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each word; words in byte order share the most."""
        v, known = self.v, self.pairs
        child, fail, longest, shorter, sizes = v.child, v.fail, v.longest, v.shorter, v.sizes
        last, places, before = [-1], [0], b""
        for word in words:
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], places[shared + 1 :]
            before, at, end = word, places[-1], shared
            for byte in word[shared:]:
                while (below := child.get(at << 8 | byte)) is None:
                    at = fail[at]
                at, end = below, end + 1
                token = longest[at]
                while (left := last[end - sizes[token]]) >= 0:
                    if (fits := known.get(left << 20 | token)) is None:
                        if len(known) >= KEPT_PAIRS:
                            known.clear()
                        fits = known[left << 20 | token] = v.fits(left, token)
                    if fits:
                        break
                    token = shorter[token]
                last.append(token)
                places.append(at)
            out = []
            while end:
                token = last[end]
                out.append(token)
                end -= sizes[token]
            out.reverse()
            yield out


class Encoder:
    """Whole texts to packed ids. Ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.trie = vocabulary, PrefixTrie(vocabulary)
        self.known: dict[str, bytes] = {}
        self.words, self.ascii_words = regex.compile(WORDS).findall, re.compile(ASCII_WORDS).findall

    def cut(self, text: str) -> list[str | bytes]:
        """The words of a text; a special token's string is its packed id."""
        words = self.ascii_words if text.isascii() else self.words
        out, at = [], 0
        for m in self.v.splitter.finditer(text):
            out += words(text[at : m.start()])
            out.append(self.v.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return out + words(text[at:]) if at else words(text)

    def learn(self, words: set[str | bytes]) -> list[str]:
        """Brings all of words into known; returns the long ones, which are not to stay. Sorted, new words visit the trie depth first."""
        known = self.known
        if len(known) + len(new := words.difference(known)) > KEPT_WORDS:
            known.clear()
            new = words
        ready = {w for w in new if isinstance(w, bytes)}
        known.update(zip(ready, ready, strict=True))
        order = sorted(new - ready)
        for word, ids in zip(order, self.trie.encode_all([w.encode() for w in order]), strict=True):
            known[word] = array("I", ids).tobytes()
        return [w for w in new if len(w) > KEPT_LENGTH]

    def packed(self, text: str) -> bytes:
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The new words of all texts are learned together."""
        cut = [self.cut(text) for text in texts]
        long = self.learn(set().union(*cut))
        out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for word in long:
            del self.known[word]
        return out


@lru_cache(maxsize=2)
def encoder(text: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    return Encoder(Vocabulary(text))


@lru_cache(maxsize=2)
def decoder(text: str) -> list[bytes | None]:
    """Each id's bytes, once for each Python worker; decoding needs no more of the vocabulary."""
    known = token_bytes(json.loads(text))
    return [known.get(i) for i in range(max(known) + 1)]


def vocabulary_text(path: str) -> str:
    """The vocabulary file, read on the driver; its size (1.6 MB) does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, decode: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def batches(rows: Iterator[tuple]) -> Iterator[tuple[list, list[str]]]:
        keys, texts, size = [], [], 0
        for key, text in rows:
            keys.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BATCH:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        packed = encoder(shared.value).packed_all
        token = decoder(shared.value).__getitem__ if decode else None
        for keys, texts in batches(rows):
            for key, ids in zip(keys, packed(texts), strict=True):
                yield (key, ids, decoded(ids, token)) if decode else (key, ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, "doc_id long, ids binary" + ", decoded string" * decode, step)


def decoded(ids: bytes | None, token: Callable[[int], bytes]) -> str:
    """The text of packed ids; ill-formed bytes become U+FFFD."""
    numbers = array("I")
    numbers.frombytes(ids or b"")
    return b"".join(map(token, numbers)).decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every whole text, in one pass without a shuffle.

    Null texts count as empty; an empty text has no ids. Repeated rows give equal rows, null ids stay null, other columns
    are not carried on.
    """
    return _coded(docs, path, id_col, text_col, decode=False)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_encode() and decoded, the text of those ids, in the same pass, so that ids need no second trip through Python."""
    return _coded(docs, path, id_col, text_col, decode=True)


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Every row of encoded, ids unchanged, and the decoded text; ill-formed bytes become U+FFFD, null ids an empty text.

    An id outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        token = decoder(shared.value).__getitem__
        for key, ids in rows:
            yield key, ids, decoded(ids, token)

    return map_rows(encoded.select("doc_id", F.col(ids_col).alias("ids")), "doc_id long, ids binary, decoded string", step)
