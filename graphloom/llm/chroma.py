"""Chroma audio fingerprints: integral-image filters over pitch-class frames, and alignment by offset histograms.

A recording's power spectrum is folded into 12 pitch classes per frame. Sixteen
filters compare the sums of neighbouring rectangles of that image (time by
pitch class), read from its integral image; each log ratio is quantised to two
bits in Gray code, and the 32 bits are one code per frame. Recordings with equal
code sequences are one class. The index has, for every place of every class and
each of BANDS bands of the code's bits, the band's bits at POINTS places GAP
apart. Where a query class and another class have an entry in common, their
offset gets a vote; at every offset with a vote the bit error rate over the
overlap is measured, and two classes are aligned by the offset of the least rate,
if that is MOST_ERRORS at most over LEAST_OVERLAP codes or more.

The index covers every recording, and no offset with a vote is left out.
Alignments of which no entry survived aren't found: against brute force over all
offsets, under the same rule, tests find at least 0.9 of them for noise, echo,
exchanged notes and shifts off the frames' grid, on recordings of the tables.

Edge cases: null, empty or too short recordings have no codes, are a class of
their own (null class id) and match nothing; null values of a recording are 0;
silence has the codes of silence; repeated rows are copies, and an id that stands
at several recordings belongs to each of their classes; of several offsets of one
rate the longest overlap decides, then the least offset; an empty
table gives no rows; other columns, whatever their names, are ignored. Ids are
integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialize

RATE, FRAME, HOP, NOTE = 2048, 256, 64, 128
LOWEST, HIGHEST = 80.0, 900.0
#: Filters by rule: kind, first pitch class, pitch classes, frames.
FILTERS = tuple((k % 6, (5 * k) % 9, 3 + k % 4 if (5 * k) % 9 + 3 + k % 4 <= 12 else 3, (2, 4, 6, 8)[k % 4]) for k in range(16))
LONGEST = max(f[3] for f in FILTERS)
CUTS = (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Bit error rate up to which two recordings are aligned, over so many codes (two seconds of frames) at least.
MOST_ERRORS, LEAST_OVERLAP = 0.2, 64
#: Index entries: bands of a code's bits, at so many places, so far apart.
BANDS, POINTS, GAP = 4, 4, 4
#: Index entries and codes of queries that are broadcast, at most; beyond, a shuffled join by so many salts.
ASKED, ASKED_CODES, SALTS = 1_000_000, 4_000_000, 8


def tones(values: np.ndarray) -> np.ndarray:
    """A recording made from a vector: one note for each value. Stands in for audio where a table has none."""
    notes = np.floor(np.abs(values) * 96).astype(int) % 24
    t = np.arange(NOTE) / RATE
    waves = np.sin(2 * np.pi * (110 * 2 ** (np.arange(24) / 12))[:, None] * t)
    return waves[notes].ravel()


_FREQUENCIES = np.fft.rfftfreq(1024, 1 / RATE)
_USED = np.flatnonzero((_FREQUENCIES >= LOWEST) & (_FREQUENCIES <= HIGHEST))
_CLASS = np.rint(12 * np.log2(_FREQUENCIES[_USED] / 440)).astype(int) % 12
_FOLD = np.zeros((len(_USED), 12))
_FOLD[np.arange(len(_USED)), _CLASS] = 1


def pitch_classes(samples: np.ndarray) -> np.ndarray:
    """Frames by 12: shares of the power in each pitch class."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, 1024, axis=1)[:, _USED]) ** 2 @ _FOLD
    return power / np.maximum(power.sum(1, keepdims=True), 1e-9)


def codes(samples: np.ndarray) -> np.ndarray:
    """One 32-bit code for every frame that has LONGEST frames from it on."""
    image = pitch_classes(samples)
    n = len(image) - LONGEST + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t: int, p: int, frames: int, classes: int) -> np.ndarray:
        a = whole[t : t + n, :]
        b = whole[t + frames : t + frames + n, :]
        return b[:, p + classes] - b[:, p] - a[:, p + classes] + a[:, p]

    out = np.zeros(n, np.uint32)
    for kind, p, c, w in FILTERS:
        half_w, half_c = w // 2, max(c // 2, 1)
        total = area(0, p, w, c)
        if kind == 0:  # what the rectangle has against its later half
            low, high = area(0, p, half_w, c), area(half_w, p, w - half_w, c)
        elif kind == 1:  # lower pitch classes against higher ones
            low, high = area(0, p, w, half_c), area(0, p + half_c, w, c - half_c)
        elif kind == 2:  # two corners against the others
            low = area(0, p, half_w, half_c) + area(half_w, p + half_c, w - half_w, c - half_c)
            high = total - low
        elif kind == 3:  # the middle pitch classes against those around them
            low = area(0, p + c // 3, w, max(c // 3, 1))
            high = total - low
        elif kind == 4:  # the middle frames against those around them
            low = area(w // 4, p, max(w // 2, 1), c)
            high = total - low
        else:  # the rectangle against all other pitch classes
            low, high = total, area(0, 0, w, 12) - total
        ratio = np.log((1 + low) / (1 + high))
        out = (out << np.uint32(2)) | GRAY[np.digitize(ratio, CUTS)]
    return out


def fingerprints(vectors: DataFrame, key: str, values: str, recording=tones) -> DataFrame:
    """(id, class_key, codes) of every row; `recording` turns a row's values into samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, keys = [], []
            for v in b.column(values).to_pylist():
                c = codes(recording(np.array([x or 0.0 for x in v]))) if v else np.zeros(0, np.uint32)
                found.append(c.view(np.int32))
                keys.append(int.from_bytes(blake2b(c.tobytes(), digest_size=8).digest(), "little") >> 1 if len(c) else None)
            ends = np.cumsum([0] + [len(c) for c in found])
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "class_key", "codes"])

    return vectors.select(key, values).mapInArrow(run, "id long, class_key long, codes array<int>")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and overlapping codes when a's code i meets b's code i + offset."""
    low, high = max(0, -offset), min(len(a), len(b) - offset)
    if high <= low:
        return 0, 0
    return int(np.bitwise_count(a[low:high] ^ b[low + offset : high + offset]).sum()), high - low


def entries(codes: np.ndarray) -> np.ndarray:
    """Index entries by band (row) and place (column)."""
    width, reach = 32 // BANDS, (POINTS - 1) * GAP
    n = max(len(codes) - reach, 0)
    out = np.zeros((BANDS, n), np.uint64)
    for band in range(BANDS):
        bits = (codes.view(np.uint32) >> np.uint32(band * width) & np.uint32((1 << width) - 1)).astype(np.uint64)
        for k in range(POINTS):
            out[band] = out[band] << np.uint64(width) | bits[k * GAP : k * GAP + n]
        out[band] |= np.uint64(band << 48)
    return out


def index(prints: DataFrame) -> DataFrame:
    """(class_key, place, entry) of all classes (class_key, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("codes")
            found = [entries(x.values.to_numpy(zero_copy_only=False)) for x in lists]
            sizes = [x.size for x in found]
            if not sum(sizes):
                continue
            keys = b.column("class_key").take(pa.array(np.repeat(np.arange(len(found)), sizes)))
            place = np.concatenate([np.tile(np.arange(x.shape[1], dtype=np.int32), BANDS) for x in found])
            yield pa.RecordBatch.from_arrays([keys, pa.array(place), pa.array(np.concatenate([x.ravel() for x in found]).view(np.int64))], ["class_key", "place", "entry"])

    return prints.select("class_key", "codes").mapInArrow(run, "class_key long, place int, entry long")


def align(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, class_key, offset, votes, overlap, error_rate) of the query classes and the other classes aligned with them.

    prints: (class_key, codes), one row for each class; queries: (class_key) of
    the query classes. Both should be tables. Queries' entries are broadcast up
    to ASKED of them; otherwise the entries meet by salted keys.
    """
    wanted = materialize(prints.join(queries, "class_key", "left_semi").select(F.col("class_key").alias("query"), F.col("codes").alias("query_codes")), "chroma-queries")
    asked = materialize(index(wanted.select(F.col("query").alias("class_key"), F.col("query_codes").alias("codes"))).select(F.col("class_key").alias("query"), F.col("place").alias("query_place"), "entry"), "chroma-asked")
    if asked.limit(ASKED + 1).count() <= ASKED:
        met = index(prints).join(F.broadcast(asked), "entry")
    else:
        salted = asked.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = index(prints).withColumn("salt", F.pmod(F.xxhash64("class_key"), F.lit(SALTS)).cast("int")).join(salted, ["entry", "salt"])
    votes = met.where("query <> class_key").groupBy("query", "class_key", (F.col("place") - F.col("query_place")).alias("offset")).agg(F.count("*").alias("votes"))
    few = (wanted.agg(F.sum(F.size("query_codes")).alias("n")).first()["n"] or 0) <= ASKED_CODES
    both = votes.join(prints.select("class_key", "codes"), "class_key").join(F.broadcast(wanted) if few else wanted, "query")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("query_codes"), b.column("codes")
            rows = [bit_errors(x[i].values.to_numpy(zero_copy_only=False), y[i].values.to_numpy(zero_copy_only=False), o) for i, o in enumerate(b.column("offset").to_pylist())]
            overlap = np.array([r[1] for r in rows], np.int64)
            rate = np.array([r[0] for r in rows]) / np.maximum(32 * overlap, 1)
            kept = pa.array((overlap >= LEAST_OVERLAP) & (rate <= MOST_ERRORS))
            own = b.select(["query", "class_key", "offset", "votes"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(overlap), pa.array(rate)], [*own.schema.names, "overlap", "error_rate"]).filter(kept)

    measured = both.select("query", "class_key", "offset", "votes", "query_codes", "codes").mapInArrow(compare, "query long, class_key long, offset int, votes long, overlap long, error_rate double")
    best = measured.groupBy("query", "class_key").agg(F.min(F.struct("error_rate", (-F.col("overlap")).alias("less"), "offset", "votes", "overlap")).alias("best"))
    return best.select("query", "class_key", "best.offset", "best.votes", "best.overlap", "best.error_rate")


def search(vectors: DataFrame, key: str, values: str, is_query) -> tuple[DataFrame, DataFrame]:
    """Every row with its class: (id, is_query, class_id, n_codes, codes_sha256); and the alignments of the classes with a query:
    (class_id, match_class, offset, votes, overlap, error_rate). A class's id is the smallest of its rows'."""
    prints = materialize(fingerprints(vectors, key, values).withColumn("is_query", F.coalesce(is_query(F.col("id")), F.lit(False))), "chroma-codes")
    asked = prints.where("is_query AND class_key IS NOT NULL").select("class_key").distinct()
    # equal keys have equal codes, so any row's codes do; the id says which row names the class
    classes = materialize(prints.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min("id").alias("class_id"), F.first("codes").alias("codes")), "chroma-classes")
    names = classes.select("class_key", "class_id")
    found = align(classes.select("class_key", "codes"), asked).join(names.select("class_key", F.col("class_id").alias("match_class")), "class_key").drop("class_key")
    found = materialize(found.join(names, F.col("query") == F.col("class_key")).select("class_id", "match_class", "offset", "votes", "overlap", "error_rate"), "chroma-alignments")
    rows = prints.select("id", "is_query", "class_key", F.size("codes").alias("n_codes"), F.sha2(F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))), 256).alias("codes_sha256"))
    return rows.join(names, "class_key", "left").drop("class_key"), found
