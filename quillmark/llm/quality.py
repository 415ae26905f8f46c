"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

A word and its shape are hashed to units. Each unit has a sparse random index vector; its word vector is the sum of the index
vectors around all its occurrences in the corpus. Tasks add up whole numbers in tables of fixed size, so the vectors cover all
documents and do not depend on how these are dealt out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

#: Units for words and for shapes, dimensions, nonzero places of an index vector (fixed sizes: the tables never grow).
WORDS, SHAPES, DIM, PLACES = 8192, 1024, 32, 2
#: Rows of the table that travel together, words whose units a worker remembers.
ROWS, KEPT_WORDS = 512, 200_000
#: Rows that the network scores at once.
SCORED = 1024
#: Labelled rows the network is fitted on at most, those with the smallest hashes of their ids.
SAMPLE = 20_000
_RUNS = [(re.compile(rb"[a-z]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"[\x80-\xff]+"), b"x"), (re.compile(rb"(?:ax|xa)[ax]*"), b"a")]


def units(word: bytes) -> int:
    """Unit of a word, and above it that of its shape: runs of letters and digits become one sign each, other signs stay."""
    shape = word
    for run, sign in _RUNS:
        shape = run.sub(sign, shape)
    return crc32(word) % WORDS | (crc32(shape) % SHAPES) << 16


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors of all units, from a fixed seed."""
    random = np.random.default_rng(7)
    n = WORDS + SHAPES
    return random.integers(0, DIM, (n, PLACES)), random.choice([-1, 1], (n, PLACES))


#: The units of words that this Python worker has met; its tasks share them.
_UNITS: dict[bytes, int] = {}


def _streams(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, word units, shape units) of each document."""
    known = _UNITS
    for key, data in rows:
        words = (data or b"").split()
        if len(known) > KEPT_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = units(word)
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        yield key, both & 0xFFFF, (both >> 16) + WORDS


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors (units x DIM) from all texts; a unit that never occurs has zeros. 1.2 MB reach the driver, at any size."""

    def gather(rows: Iterator[tuple]) -> Iterator[tuple]:
        places, signs = index_vectors()
        table = np.zeros((WORDS + SHAPES) * DIM, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal size
            own, other = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            for j in range(PLACES):
                at = own * DIM + places[other, j]
                positive = signs[other, j] > 0
                np.add(table, np.bincount(at[positive], minlength=len(table)), out=table)
                np.subtract(table, np.bincount(at[~positive], minlength=len(table)), out=table)
            held.clear()
            size = 0

        for _, word, shape in _streams((None, data) for (data,) in rows):
            for own in (word, shape):
                for near in (word, shape):
                    held += [np.stack([own[1:], near[:-1]]), np.stack([own[:-1], near[1:]])]
            size += 8 * len(word)
            if size > 2_000_000:
                add()
        add()
        whole = table.reshape(-1, DIM)
        for at in range(0, len(whole), ROWS):
            part = whole[at : at + ROWS]
            if part.any():
                yield at, part.astype("<i8").tobytes()

    def total(rows: Iterator[tuple]) -> Iterator[tuple]:
        for at, group in groupby(rows, itemgetter(0)):
            yield at, sum(np.frombuffer(data, "<i8") for _, data in group).tobytes()

    parts = map_rows(docs.select(F.col(text_col).cast("binary").alias("data")), "at long, data binary", gather)
    summed = map_rows(parts.repartition("at").sortWithinPartitions("at"), "at long, data binary", total)
    out = np.zeros((WORDS + SHAPES, DIM))
    for at, data in summed.collect():
        part = np.frombuffer(data, "<i8").reshape(-1, DIM)
        out[at : at + len(part)] = part
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features (binary: 32-bit floats) of every whole text: the means of its word and of its shape vectors, their
    lengths, the share of different units, and the logarithm of its words."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        table = shared.value
        for key, word, shape in _streams(rows):
            n = max(1, len(word))
            counts = [np.unique(x, return_counts=True) for x in (word, shape)]
            means = [(table[u].T @ c.astype(np.float32)) / n for u, c in counts]
            more = [*(np.linalg.norm(m) for m in means), *(np.sqrt((c.astype(np.float64) ** 2).sum()) / n for _, c in counts), len(counts[0][0]) / n, np.log1p(len(word))]
            yield key, np.concatenate([*means, more]).astype("<f4").tobytes()

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")), "doc_id long, features binary", step)


class Network:
    """Two layers: tanh units, then one logit, divided by a temperature that is fitted on rows the weights have not seen."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, seed: int = 3):
        random = np.random.default_rng(seed)
        self.middle, self.width = x.mean(0), x.std(0) + 1e-6
        x = (x - self.middle) / self.width
        order = random.permutation(len(x))
        fit, rest = order[len(x) // 5 :], order[: len(x) // 5]
        p = self.weights = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
        self.temperature = 1.0
        for t in range(1, rounds + 1):
            inner = np.tanh(x[fit] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-(inner @ p[2] + p[3]))) - y[fit]) / len(fit)
            back = np.outer(error, p[2]) * (1 - inner**2)
            for i, g in enumerate((x[fit].T @ back + 1e-4 * p[0], back.sum(0), inner.T @ error + 1e-4 * p[2], error.sum(keepdims=True))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        z, target = self.logits(x[rest]), y[rest]
        loss = lambda t: np.logaddexp(0, np.where(target > 0.5, -z, z) / t).mean()
        self.temperature = min(np.geomspace(0.25, 8, 101), key=loss) if len(rest) else 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.logits((features - self.middle) / self.width) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (higher: quality 1 likelier) and predicted (1 from the threshold on) of every whole text.

    labels: doc_id and quality (0 or 1; null: no label). The network is fitted on the driver on at most sample rows that are not
    held out; word vectors cover all texts. Without any label, or with one kind only, every score is the share of ones, 0.5 where
    there are none. Null and empty texts get the score of no words. Null ids are scored, counted as not held out and never
    learned from. Repeated rows give equal rows; other columns are not carried on.
    """
    features = written(pooled(docs, word_vectors(docs, text_col), id_col, text_col), "features")
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # a share by hash first, so that what tasks send to the driver does not grow with their number
    share = min(1.0, 1.2 * sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    rows = features.join(chosen, "doc_id").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id", "quality").limit(sample).select("features", "quality").collect()
    y = np.array([r.quality for r in rows], float)
    model: Network | float = float(y.mean()) if len(y) else 0.5
    if 0 < y.sum() < len(y):
        model = Network(np.array([np.frombuffer(r.features, "<f4") for r in rows], float), y)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        net = shared.value
        while part := list(islice(rows, SCORED)):
            keys, data = zip(*part, strict=True)
            scores = [net] * len(keys) if isinstance(net, float) else net.score(np.frombuffer(b"".join(data), "<f4").reshape(len(keys), -1).astype(float)).tolist()
            yield from zip(keys, scores, strict=True)

    scored = map_rows(features, "doc_id long, score double", step)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
