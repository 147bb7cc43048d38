"""Benchmark decontamination by template canonicalisation.

Words lose punctuation around them and A-Z is lower-cased. Numbers, names
(capitalised words that don't open a sentence) and units (after a number) become
typed placeholders, so a question keeps its template when its figures or names
are exchanged. Windows of WINDOW template words of every benchmark item, and the
windows of its plain words, are hashed into a table. Documents' windows are read
in three ways: by templates, by plain words (so copies match in lower case, too)
and, where a window's first word is capitalised, with the other reading of it
(what stands before a copy decides if it opens a sentence). A hash join of the two
names the diagonals (document, item, place in the document less place in the item)
to be measured. Along a diagonal a word of the item matches when its template or
the word itself is met; runs of WINDOW or more matching words (or of the whole
item, if it is shorter) are covered, those with few words that aren't
placeholders included. Every placeholder must stand for one value in what a
diagonal covers; diagonals where it doesn't are discarded. A document is
contaminated by an item when the others cover MATCHED words of it, or all of it,
and LITERAL of those (or all) are the item's own words, not exchanged ones.

Documents are read once, however many items there are. The scan carries a Bloom
filter of the items' windows, of at most FILTER_BITS bits; only documents that
pass it (or err through it) leave the scan, one row for each different text of a
task, and everything after is joins of those. Texts are told apart by their MD5.

Edge cases: null and empty texts match nothing; items without words match
nothing; items shorter than a window are one window; windows by templates with
fewer than LITERAL words that aren't placeholders name no diagonal, unless the
item has no others (they do count on diagonals that other windows name); equal
items and equal documents are rows of their own; very long texts are read
whole; empty tables give no rows (and remove none); other columns pass through.
Ids may be of any type.
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
from graphloom.llm.words import PLACES, Words, hash64, hashes_of, mixed, runs, slices
from graphloom.runtime import materialize, small

WINDOW, LITERAL, MATCHED = 8, 4, 13
#: The filter has 128 bits for each window of the benchmark, and so many at most.
FILTER_BITS = 1 << 27
UNITS = (
    "mm cm m km in inch inches ft feet foot yard yards mile miles g kg mg gram grams kilogram kilograms lb lbs pound pounds oz "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros usd eur percent degree degrees meter meters metre metres "
    "kilometer kilometers centimeter centimeters mph kmh w kw watt watts v volt volts hz khz mhz ghz byte bytes kb mb gb tb"
).split()
NUMBER, UNIT, NAME = (np.uint64(hash64(x)) for x in (b"<number>", b"<unit>", b"<name>"))
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Reading:
    """Words of a column of texts, one text after another: own (hash), code (template's hash), other (code by the other reading), slot (is a placeholder), sizes."""

    def __init__(self, column: pa.Array):
        read = Words(column, lower=False)
        words, at = read.distinct, read.at
        self.sizes, self.starts, self.text = read.sizes, read.starts, read.text
        core = pc.utf8_trim(words, characters=_EDGES)
        low = pc.ascii_lower(core)
        flag = lambda x: x.to_numpy(zero_copy_only=False)[at]
        number = flag(pc.match_substring_regex(core, r"\A[+-]?[$]?[0-9][0-9.,:/%]*\z"))
        capital = flag(pc.match_substring_regex(core, r"\A[A-Z][^A-Z]*\z"))
        ends = flag(pc.match_substring_regex(words, r"""[.!?:|]["')\]}]*\z"""))
        self.own = hashes_of(low.cast(pa.binary()))[at]
        first = np.zeros(len(at), bool)
        first[self.starts[self.sizes > 0]] = True
        before = lambda x: np.r_[False, x[:-1]] & ~first
        unit = flag(pc.is_in(low, value_set=pa.array(UNITS))) & before(number) & ~number
        opens = first | before(ends)
        name = capital & ~opens & ~number & ~unit
        self.slot = number | unit | name
        self.code = np.select([number, unit, name], [NUMBER, UNIT, NAME], self.own)
        self.other = np.where(name, self.own, np.where(capital & opens & ~number & ~unit, NAME, self.code))

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, hash) of the windows of that size inside a text: by templates, those with a placeholder by plain words, those with another reading of the first word by it."""
        n = len(self.own)
        if n < size:
            return
        inside = np.zeros(n + 1, np.int64)
        np.add.at(inside, self.starts[self.sizes >= size], 1)
        np.add.at(inside, (self.starts + self.sizes - size + 1)[self.sizes >= size], -1)
        place = np.flatnonzero(np.cumsum(inside[:n]))
        held = np.r_[0, np.cumsum(self.slot)]

        def hashed(at: np.ndarray, rest: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total = np.uint64(size) + first[at] * PLACES[0]
            for k in range(1, size):
                total += rest[at + k] * PLACES[k]
            return at, mixed(total)

        yield hashed(place, self.code, self.code)
        yield hashed(place[held[place + size] > held[place]], self.own, self.own)
        yield hashed(place[self.other[place] != self.code[place]], self.code, self.other)


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    again = mixed(h ^ PLACES[7])
    return [(x >> np.uint64(s) & np.uint64(bits - 1)).astype(np.int64) for x in (h, again) for s in (0, 32)]


class Filter:
    """A Bloom filter as packed bits."""

    def __init__(self, bits: int):
        self.bits, self.packed = bits, np.zeros(bits // 8, np.uint8)

    def add(self, h: np.ndarray) -> None:
        for p in _probes(h, self.bits):
            np.bitwise_or.at(self.packed, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def _set(self, p: np.ndarray) -> np.ndarray:
        return (self.packed[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Places of those of h that were added, and of very few others."""
        left = np.flatnonzero(self._set((h & np.uint64(self.bits - 1)).astype(np.int64)))
        if len(left):
            left = left[np.logical_and.reduce([self._set(p) for p in _probes(h[left], self.bits)])]
        return left


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_key, size, own, code, slot, h, place) of every different text with a word: its words, and hashes and places of the windows to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            r = Reading(b.column("text"))
            some = np.flatnonzero(r.sizes)
            sizes, found = np.minimum(r.sizes[some], WINDOW), []
            for i, size in zip(some, sizes):
                at = r.text(i)
                h, plain = runs(r.code[at], size), runs(r.own[at], size)
                literal = np.convolve(~r.slot[at], np.ones(size, int), "valid")
                useful = literal >= min(LITERAL, literal.max())
                again = np.flatnonzero((plain != h) | ~useful)
                found.append((np.concatenate([h[useful], plain[again]]), np.concatenate([np.flatnonzero(useful), again])))
            words = [r.text(i) for i in some]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("item_key").take(pa.array(some)),
                    pa.array(sizes, pa.int32()),
                    _lists([r.own[at] for at in words], pa.int64()),
                    _lists([r.code[at] for at in words], pa.int64()),
                    _lists([r.slot[at] for at in words], pa.bool_()),
                    _lists([f[0] for f in found], pa.int64()),
                    _lists([f[1] for f in found], pa.int32()),
                ],
                ["item_key", "size", "own", "code", "slot", "h", "place"],
            )

    texts = benchmark.where("text IS NOT NULL").select(F.md5("text").alias("item_key"), "text").dropDuplicates(["item_key"])
    kind = "item_key string, size int, own array<long>, code array<long>, slot array<boolean>, h array<long>, place array<int>"
    return materialize(texts.mapInArrow(run, kind), "benchmark-items")


def window_filter(windows: DataFrame) -> Filter | None:
    """The filter of (h), built by partitions; None without windows."""
    n = windows.count()
    if not n:
        return None
    bits = min(FILTER_BITS, max(1 << 16, 1 << (128 * n - 1).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Filter(bits)
        for b in batches:
            part.add(np.asarray(b.column("h")).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([part.packed.tobytes()], pa.binary())], ["packed"])

    whole = Filter(bits)
    for r in windows.select("h").coalesce(8).mapInArrow(build, "packed binary").toLocalIterator():
        whole.packed |= np.frombuffer(r["packed"], np.uint8)
    return whole


def passing_texts(docs: DataFrame, sizes: list[int], known: Filter) -> DataFrame:
    """(doc_id, key, h, place, own, code, other) of the rows of docs with a window that passes the filter. A task gives a text's arrays once."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("key", T.StringType())]
        + [T.StructField(c, T.ArrayType(T.IntegerType() if c == "place" else T.LongType())) for c in ("h", "place", "own", "code", "other")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in slices(batches):
            r = Reading(b.column("text"))
            hits = [(place[left], h[left]) for size in sizes for place, h in r.windows(size) for left in [known.passing(h)] if len(left)]
            if not hits:
                continue
            place, h = (np.concatenate(x) for x in zip(*hits))
            of = np.searchsorted(r.starts, place, "right") - 1
            order = np.argsort(of, kind="stable")
            place, h, of = place[order], h[order], of[order]
            rows, first = np.unique(of, return_index=True)
            ends = np.r_[first[1:], len(of)]
            keys, new = b.column("key").take(pa.array(rows)), []
            for k in keys.to_pylist():
                new.append(k not in seen)
                seen.add(k)
            if len(seen) > 500_000:
                seen.clear()
            arrays = [
                [h[i:j] for i, j in zip(first, ends)],
                [place[i:j] - r.starts[row] for i, j, row in zip(first, ends, rows)],
                *([x[r.text(row)] for row in rows] for x in (r.own, r.code, r.other)),
            ]
            lists = [_lists([x if n else x[:0] for x, n in zip(a, new)], pa.int32() if k == 1 else pa.int64()) for k, a in enumerate(arrays)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), keys, *lists], schema.fieldNames())

    read = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text")
    return materialize(read.mapInArrow(run, schema), "passing-texts")


def measured(shifts: list[int], item: dict[str, np.ndarray], text: dict[str, np.ndarray]) -> tuple | None:
    """(windows, words covered, words of the item, slots, slots with another value) if the diagonals at those shifts contaminate the text."""
    n = len(item["own"])
    size = min(WINDOW, n)
    covered, same = np.zeros(n, bool), np.zeros(n, bool)
    windows = slots = changed = 0
    for shift in sorted(shifts):
        low, high = max(0, -shift), min(n, len(text["own"]) - shift)
        there = slice(low + shift, high + shift)
        own, code = item["own"][low:high], item["code"][low:high]
        equal = own == text["own"][there]
        match = equal | (code == text["code"][there]) | (code == text["other"][there])
        edges = np.flatnonzero(np.diff(np.r_[0, match.astype(np.int8), 0]))
        parts = [(i, j) for i, j in zip(edges[::2], edges[1::2]) if j - i >= size]
        words = np.concatenate([np.arange(i, j) for i, j in parts]) if parts else np.zeros(0, np.int64)
        at = words[item["slot"][low:high][words]]
        means: dict[int, int] = {}
        if all(means.setdefault(x, y) == y for x, y in zip(own[at].tolist(), text["own"][there][at].tolist())):
            covered[low + words] = True
            same[low + words] |= equal[words]
            windows += sum(j - i - size + 1 for i, j in parts)
            slots += len(at)
            changed += int((~equal[at]).sum())
    if covered.sum() < min(MATCHED, n) or same.sum() < min(LITERAL, n):
        return None
    return windows, int(covered.sum()), n, slots, changed


def _found(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The rows of docs that passed the filter, and (key, item_key, measures) of the texts and items that contaminate them."""
    items = items_of(benchmark)
    windows = items.select("item_key", F.explode(F.arrays_zip("h", "place")).alias("w")).select("item_key", F.col("w.h").alias("h"), F.col("w.place").alias("item_place"))
    known = window_filter(windows)
    if known is None:
        return None
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW of them
    rows = passing_texts(docs, sizes, known)
    hits = rows.select("key", F.explode(F.arrays_zip("h", "place")).alias("w")).select("key", F.col("w.h").alias("h"), F.col("w.place").alias("place"))
    diagonals = hits.join(small(windows), "h").groupBy("key", "item_key").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts"))
    parts = ("own", "code", "other")
    texts = rows.where(F.size("own") > 0).select("key", *[F.col(c).alias(f"text_{c}") for c in parts]).dropDuplicates(["key"])
    pairs = diagonals.join(items.select("item_key", "own", "code", "slot"), "item_key").join(texts, "key")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
            return b.column(name)[i].values.to_numpy(zero_copy_only=False)

        for b in batches:
            kept, out = [], []
            for i, shifts in enumerate(b.column("shifts").to_pylist()):
                m = measured(shifts, {c: arrays(b, c, i) for c in ("own", "code", "slot")}, {c: arrays(b, f"text_{c}", i) for c in parts})
                if m is not None:
                    kept.append(i)
                    out.append(m)
            columns = list(zip(*out)) or [[]] * 5
            own = b.select(["key", "item_key"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, pa.int64()) for c in columns)], ["key", "item_key", *MEASURES])

    kind = "key string, item_key string, " + ", ".join(f"{c} long" for c in MEASURES)
    return rows.select("doc_id", "key"), materialize(pairs.mapInArrow(measure, kind), "contaminated-texts")


MEASURES = ("windows", "matched_words", "item_words", "slots", "changed_slots")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, matched_words, item_words, slots, changed_slots) of every contaminated document and item."""
    found = _found(docs, benchmark)
    if found is None:
        kinds = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)]
        return docs.sparkSession.createDataFrame([], T.StructType(kinds + [T.StructField(c, T.LongType()) for c in MEASURES]))
    rows, pairs = found
    ids = benchmark.where("text IS NOT NULL").select("item_id", F.md5("text").alias("item_key"))
    return rows.join(small(pairs), "key").join(ids, "item_key").select("doc_id", "item_id", *MEASURES)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates."""
    found = _found(docs, benchmark)
    if found is None:
        return docs
    key = fresh(docs, "text_key")
    gone = small(found[1].select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))).join(gone, key, "left_anti").select(*docs.columns)
