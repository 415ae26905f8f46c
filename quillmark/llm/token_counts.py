"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links. Each node also holds how many pieces are popped when its link is
followed, so one pass over a word's bytes gives the number of greedy word pieces without building them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, vocabulary_text
from .common import map_rows

#: Bounds of a worker's memory of counted words, and the longest word kept.
KEPT_WORDS, KEPT_LENGTH = 200_000, 64


def word_pieces(vocabulary: Vocabulary) -> tuple[set[bytes], set[bytes]]:
    """Word-initial and continuing pieces of a byte-level vocabulary: tokens that begin with a space open a word, the
    others continue one; single bytes do both, so every word can be cut."""
    tokens = [t for t in vocabulary.ids if t.strip()]
    single = {bytes([b]) for b in range(256)}
    return {t[1:] for t in tokens if t[:1] == b" "} - {b""} | single, {t for t in tokens if t[:1] != b" "} | single


class LongestMatch:
    """Trie over initial pieces from node 0 and continuing pieces from node 1; fail[v] is -1 where no link exists."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        self.child: dict[int, int] = {}
        ends = {self.insert(root, piece) for root, pieces in enumerate((initial, continuing)) for piece in pieces}
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        self.fail, self.popped = [-1] * self.size, [0] * self.size
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for byte, node in below.get(parent, ()):
                queue.append(node)
                if node in ends:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and (at << 8 | byte) not in self.child:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.child[at << 8 | byte], count

    size = 2

    def insert(self, node: int, piece: bytes) -> int:
        for byte in piece:
            key = node << 8 | byte
            if key not in self.child:
                self.child[key] = self.size
                self.size += 1
            node = self.child[key]
        return node

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 (the unknown token) where it can't be cut greedily, 0 for an empty word."""
        node, total, child, fail, popped = 0, 0, self.child, self.fail, self.popped
        for byte in word:
            while (found := child.get(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = found
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total if node >= 0 else 1


@lru_cache(maxsize=2)
def automaton(text: str) -> LongestMatch:
    """One for each Python worker and vocabulary."""
    return LongestMatch(*word_pieces(Vocabulary(text)))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_words and n_tokens (greedy word pieces) of every whole text, without a shuffle.

    Words are what ASCII white space divides. Null and empty texts have zeros, repeated rows give equal rows, other columns
    are not carried on. Words of any length are counted in time linear in their length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        machine = automaton(shared.value)
        known: dict[bytes, int] = {}
        for key, data in rows:
            words = (data or b"").split()
            if len(known) > KEPT_WORDS:
                known.clear()
            long = 0
            for word in set(words).difference(known):
                if len(word) <= KEPT_LENGTH:
                    known[word] = machine.count(word)
                else:
                    long = 1
            total = sum(known[w] if w in known else machine.count(w) for w in words) if long else sum(map(known.__getitem__, words))
            yield key, len(data or b""), len(words), total

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")), "doc_id long, n_bytes long, n_words long, n_tokens long", step)
