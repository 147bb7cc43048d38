"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a whole text (lengths, shares of character classes, repetition)
are standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel. Every partition sums its part of the normal
equations, apart for each of FOLDS folds; the driver adds at most PARTS such
sums, of a fixed size, and solves. Each fold is scored by the solution of the
others, and those scores, counted in bins, give the isotonic calibration.

Edge cases: null and empty texts have all-zero counts and are scored like any
other text; repeated documents are rows of their own; of several labels of one
document the lowest counts and null labels don't; without labels of both kinds
the score is their share (1 without any labels), for every text; an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.columns import fresh
from graphloom.llm.words import text_bytes, with_columns
from graphloom.runtime import materialize

#: At most so many labelled rows, in expectation, are fitted: a sample by hash where there are more.
MAX_TRAIN = 200_000
FEATURES, FOLDS, PARTS = 256, 3, 16
RIDGE, WIDTH = 1e-1, 2.5
BINS = 400

#: Character classes; what no entry names is class 0.
CLASSES = {1: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: b"abcdefghijklmnopqrstuvwxyz", 3: b"0123456789", 4: b" \t\r\x0b\x0c", 5: b"\n", 6: b"!?", 7: b"|", 8: b"#$%&*@^~`=+<>\\_/{}[]", 9: b".,;:'\"()-", 10: bytes(range(128, 256))}
STATS = ("chars", "words", "word_length", *(f"class_{k}" for k in range(11)), "distinct_words", "distinct_pairs", "same_as_last", "distinct_lines", "symbol_endings", "capitalised")
CHUNK = 1_000_000


def text_stats(texts: list[bytes]) -> np.ndarray:
    """A row of STATS for each text."""
    out = np.zeros((len(texts), len(STATS)))
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        out[start:end] = _chunk_stats(texts[start:end])
        start = end
    return out


def _chunk_stats(texts: list[bytes]) -> np.ndarray:
    table = np.zeros(256, np.int64)
    for k, chars in CLASSES.items():
        table[list(chars)] = k
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    counts = np.bincount(table[data] + np.repeat(np.arange(n) * 11, sizes), minlength=11 * n).reshape(n, 11).astype(float)
    more = np.zeros((n, 7))
    for i, t in enumerate(texts):
        words = t.split()
        if not words:
            continue
        k = len(words)
        lines = [x for x in t.split(b"\n") if x]
        more[i] = (
            k,
            len(set(words)) / k,
            len(set(zip(words, words[1:]))) / max(k - 1, 1),
            sum(map(bytes.__eq__, words, words[1:])) / k,
            len(set(lines)) / max(len(lines), 1),
            0,
            0,
        )
    if len(data):
        kinds = table[data]
        blank = (kinds == 4) | (kinds == 5)
        text_of = np.repeat(np.arange(n), sizes)
        last = ~blank & np.r_[blank[1:] | (text_of[1:] != text_of[:-1]), True]
        first = ~blank & np.r_[True, blank[:-1] | (text_of[1:] != text_of[:-1])]
        words = np.maximum(more[:, 0], 1)
        more[:, 5] = np.bincount(text_of[last & np.isin(kinds, (6, 7, 8))], minlength=n) / words
        more[:, 6] = np.bincount(text_of[first & (kinds == 1)], minlength=n) / words
    total = np.maximum(sizes, 1)
    word_length = (sizes - counts[:, 4] - counts[:, 5]) / np.maximum(more[:, 0], 1)
    shares = np.sqrt(counts / total[:, None])
    return np.column_stack([np.log1p(sizes), np.log1p(more[:, 0]), np.log1p(word_length), shares, more[:, 1:]])


def stats_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and stats (array of doubles), of every row."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = text_stats(text_bytes(b.column("text")))
            yield with_columns(b.select(keep), {"stats": rows_of(stats)})

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def rows_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


class Quality:
    """A fitted model: plain arrays of fixed size."""

    def __init__(self, prior: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.prior, self.weights = prior, None
        self.directions = rng.normal(size=(len(STATS), FEATURES)) / WIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.mean, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))
        self.raw, self.calibrated = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        phi = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.column_stack([phi, np.ones(len(z))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores. A thousandth of the raw score is left in, so that equal calibrated values keep their order."""
        if self.weights is None:
            return np.full(len(stats), self.prior)
        raw = self.features(stats) @ self.weights
        flat = np.interp(raw, self.raw, self.calibrated)
        return np.round(0.999 * flat + 0.001 * np.clip((raw + 1) / 3, 0, 1), 9)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit of y, by pooling adjacent violators; x is sorted."""
    pools: list[list[float]] = []
    for value, weight in zip(y, n):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, seed: int = 1) -> Quality:
    """stats: (doc_id, stats), one materialized row for each document to learn from. labels: (doc_id, label)."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    rows = stats.join(known, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    total = rows.agg(F.count("*").alias("n"), F.avg("y").alias("p")).first()
    model = Quality(1.0 if not total["n"] else float(total["p"]), seed)
    if not total["n"] or total["p"] in (0.0, 1.0):
        return model
    if total["n"] > max_train:
        rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(1e6 * max_train / total["n"]))
    rows = materialize(rows.select("stats", "y", "fold"), "quality-labelled")
    wide = rows.agg(*[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model.mean = np.array([wide[f"m{i}"] for i in range(len(STATS))])
    model.scale = np.maximum([wide[f"s{i}"] for i in range(len(STATS))], 0.02)
    width, dim = len(STATS), FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, seen = np.zeros((FOLDS, dim, dim)), np.zeros((FOLDS, dim)), 0
        for batch in batches:
            seen += batch.num_rows
            x, y, fold = model.features(matrix(batch.column("stats"), width)), np.asarray(batch.column("y")), np.asarray(batch.column("fold"))
            for k in range(FOLDS):
                part = x[fold == k]
                a[k] += part.T @ part
                b[k] += part.T @ y[fold == k]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b.ravel()]).tobytes()], pa.binary())], ["sums"])

    added = 0
    for r in rows.coalesce(PARTS).mapInArrow(sums, "sums binary").toLocalIterator():
        added = added + np.frombuffer(r["sums"])
    a, b = added[: FOLDS * dim * dim].reshape(FOLDS, dim, dim), added[FOLDS * dim * dim :].reshape(FOLDS, dim)
    solve = lambda k: np.linalg.solve(np.delete(a, k, 0).sum(0) + RIDGE * np.eye(dim), np.delete(b, k, 0).sum(0))
    by_fold = np.array([solve(k) for k in range(FOLDS)])
    model.weights = np.linalg.solve(a.sum(0) + RIDGE * np.eye(dim), b.sum(0))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(3 * BINS), np.zeros(3 * BINS)
        for batch in batches:
            x, y, fold = model.features(matrix(batch.column("stats"), width)), np.asarray(batch.column("y")), np.asarray(batch.column("fold"))
            at = np.clip(((x * by_fold[fold]).sum(1) + 1) * BINS, 0, 3 * BINS - 1).astype(int)
            n += np.bincount(at, minlength=3 * BINS)
            ones += np.bincount(at, y, minlength=3 * BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(ones[at])], ["bin", "n", "ones"])

    counted = rows.coalesce(PARTS).mapInArrow(bins, "bin int, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").collect()
    n, ones = np.array([r["n"] for r in counted]), np.array([r["ones"] for r in counted])
    model.raw = (np.array([r["bin"] for r in counted]) + 0.5) / BINS - 1
    model.calibrated = isotonic(model.raw, ones / n, n)
    return model


def score_stats(stats: DataFrame, model: Quality) -> DataFrame:
    """stats with a column score, without the column stats."""
    keep = [c for c in stats.columns if c != "stats"]
    schema = T.StructType([stats.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield with_columns(b.select(keep), {"score": pa.array(model.score(matrix(b.column("stats"), len(STATS))), pa.float64())})

    return stats.mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: Quality) -> tuple[DataFrame, str]:
    """docs with a column of scores, and that column's name."""
    name = fresh(docs, "quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield with_columns(b, {name: pa.array(model.score(text_stats(text_bytes(b.column("text")))), pa.float64())})

    return docs.mapInArrow(run, schema), name
