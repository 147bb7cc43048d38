"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashed buckets of its words, of their stems
(STEM bytes, so that rare compounds share what they begin with), of its adjacent
pairs and of its pairs with one word between. Words are runs of letters, with
A-Z lower-cased. FTRL-proximal keeps, for each bucket, a sum of adjusted
gradients z and of squared gradients n: per-coordinate learning rates, and a
weight of exactly zero while |z| is at most the L1 strength. The labelled sample
is walked ROUNDS times, and once more without the L1 shrinkage over the buckets
it has left. Those are a small sparse vector, sent with the scoring function.
The walk is in sequence, as the algorithm is; with `parts` over 1, that many
walks go side by side and their (z, n) are averaged after every round.

Edge cases: null and empty texts have no features and the score of the
intercept; repeated documents are rows of their own; of several labels of one
document the highest counts and null labels don't; without labels the score is
0.5, with labels of one kind it tends to that kind; an empty table gives no
rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.columns import fresh
from graphloom.llm.words import Words, hashes_of, slices, with_columns
from graphloom.runtime import materialize

#: At most so many labelled texts, in expectation, are learned from: a sample by hash where there are more.
MAX_TRAIN = 19_000
PARTS, ROUNDS = 1, 4
BITS, STEM = 19, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0

#: ASCII to what words are split by: letters stay (lower-cased), all else becomes a space.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_SKIP, _NEXT, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def buckets(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed buckets of the features of all texts, one text after another, by kind; and where each kind's buckets of each text end. They may repeat."""
    read = Words(column, lower=False, table=LETTERS)
    distinct = read.distinct.cast(pa.binary())
    stems = pc.binary_join_element_wise(pa.scalar(b"^"), pc.binary_slice(distinct, 0, STEM), pa.scalar(b""))
    h, of = hashes_of(distinct)[read.at], read.of
    near, far = np.flatnonzero(of[1:] == of[:-1]), np.flatnonzero(of[2:] == of[:-2])
    kinds = (h * _SKIP, hashes_of(stems)[read.at] * _SKIP, (h[near] * _PAIR + h[near + 1]) * _NEXT, (h[far] * _NEXT + h[far + 2]) * _PAIR)
    ends = [np.cumsum(np.maximum(read.sizes - less, 0)) for less in (0, 0, 1, 2)]
    return [(k >> np.uint64(64 - BITS)).astype(np.int32) for k in kinds], ends


def distinct_buckets(column: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text, sorted."""
    kinds, ends = buckets(column)
    split = [np.split(k, e[:-1]) for k, e in zip(kinds, ends)] if len(column) else []
    return [np.unique(np.concatenate(parts)) for parts in zip(*split)]


class Ftrl:
    """State of FTRL-proximal; the last coordinate is the intercept, without penalty."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.l1, self.support = L1, None

    def start(self, at: np.ndarray, z: np.ndarray, n: np.ndarray, relaxed: bool = False) -> None:
        """Goes on from that state; relaxed: with the same weights, but only those that aren't zero, and no L1 from here."""
        if relaxed:
            left = (np.abs(z) > L1) | (at == 1 << BITS)
            at, n = at[left], n[left]
            z = np.where(at == 1 << BITS, z[left], z[left] - np.sign(z[left]) * L1)
            self.l1, self.support = 0.0, np.zeros(len(self.z), bool)
            self.support[at] = True
        self.z[at], self.n[at] = z, n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = np.where(np.abs(z) > self.l1, np.sign(z) * self.l1 - z, 0.0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        if len(at) and at[-1] == 1 << BITS:
            w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
        return w

    def learn(self, at: np.ndarray, y: float) -> None:
        if self.support is not None:
            at = at[self.support[at]]
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


class Toxicity:
    """A fitted model: sparse weights and an intercept."""

    def __init__(self, state: Ftrl | None):
        self.at, self.values, self.intercept = np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
        if state is not None:
            w = state.weights(np.arange((1 << BITS) + 1))
            self.intercept = float(w[-1])
            self.at = np.flatnonzero(w[:-1])
            self.values = w[self.at].astype(np.float32)

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.at] = self.values
        return w

    def score(self, texts: pa.Array, dense: np.ndarray) -> np.ndarray:
        found = []
        for at, ends in zip(*buckets(texts)):
            some = np.flatnonzero(dense[at])
            found.append(np.searchsorted(ends, some, "right") << BITS | at[some])
        both = np.unique(np.concatenate(found))
        total = np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], minlength=len(texts))
        return np.round(1 / (1 + np.exp(-np.clip(total + self.intercept, -30, 30))), 9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, parts: int = PARTS, seed: int = 10) -> Toxicity:
    """docs: (doc_id, text) of documents to learn from. labels: (doc_id, label)."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)))
    total = known.count()
    if not total:
        return Toxicity(None)
    # the sample is bounded, so it may be broadcast
    sample = F.broadcast(known.where(F.col("h") < int(1e6 * max_train / total)) if total > max_train else known)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = distinct_buckets(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("h"), lists], ["y", "h", "at"])

    found = docs.join(sample, "doc_id").select("text", "y", "h").mapInArrow(features, "y int, h long, at array<int>")
    texts = materialize(found.repartition(parts, "h").sortWithinPartitions("h", "y", "at"), "toxicity-sample")
    state = None
    for k in range(ROUNDS + 1):
        state = _round(texts, state, k == ROUNDS, parts)
        if state is None:
            return Toxicity(None)
    full = Ftrl()
    full.start(*state)
    full.l1 = 0.0
    return Toxicity(full)


def _round(texts: DataFrame, start: tuple | None, relaxed: bool, parts: int) -> tuple | None:
    """One walk over the sample: buckets with their z and n."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ftrl, seen = Ftrl(), 0
        if start is not None:
            ftrl.start(*start, relaxed)
        for b in batches:
            for at, y in zip(b.column("at"), b.column("y").to_pylist()):
                ftrl.learn(np.append(at.values.to_numpy(zero_copy_only=False), 1 << BITS), y)
                seen += 1
        if seen:
            at = np.flatnonzero(ftrl.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen]), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([ftrl.z[at].astype(np.float32).tobytes()], pa.binary()), pa.array([ftrl.n[at].astype(np.float32).tobytes()], pa.binary())],
                ["seen", "at", "z", "n"],
            )

    z, n, seen = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), 0
    for r in sorted(texts.coalesce(parts).mapInArrow(walk, "seen long, at binary, z binary, n binary").collect(), key=lambda r: (r["seen"], r["at"])):
        at = np.frombuffer(r["at"], np.int32)
        z[at] += r["seen"] * np.frombuffer(r["z"], np.float32)
        n[at] += r["seen"] * np.frombuffer(r["n"], np.float32)
        seen += r["seen"]
    if not seen:
        return None
    at = np.flatnonzero(n)
    return at.astype(np.int32), (z[at] / seen).astype(np.float32), (n[at] / seen).astype(np.float32)


def score_documents(docs: DataFrame, model: Toxicity, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs, or the columns to keep, with a column of scores, and that column's name."""
    keep = docs.columns if keep is None else keep
    name = fresh(docs, "toxicity_score")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for b in slices(batches):
            yield with_columns(b.select(keep), {name: pa.array(model.score(b.column("text"), dense), pa.float64())})

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema), name
