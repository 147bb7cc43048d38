"""Words of Arrow text columns as 64-bit hashes, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Odd multipliers that tell places in a shingle apart.
PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8; nulls are empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def hash64(word: bytes) -> int:
    return xxh3_64_intdigest(word)


def hashes_of(words: pa.Array) -> np.ndarray:
    """hash64 of each of an array of binary words."""
    return np.fromiter(map(hash64, words.to_pylist()), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads sums of products over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of text, or one row, so that what is computed for all words of one stays small."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(lengths, dtype=np.int64), 0
        while low < len(ends):
            high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")), low + 1)
            yield b.slice(low, high - low)
            low = high
            # a worker that waits keeps what Arrow holds in reserve
            pa.default_memory_pool().release_unused()


class Words:
    """Words of a column of texts, one text after another: `distinct` (an array of them), `at` (a row of distinct for each word), `sizes` and `starts` (words of each text, and before it).

    Words are what stands between ASCII white space; nulls have none. With
    lower, A-Z are lower-cased; with `table`, bytes are first mapped by it (of
    256 bytes, which must leave those beyond ASCII as they are).
    """

    def __init__(self, column: pa.Array, lower: bool = True, table: np.ndarray | None = None):
        texts = pc.fill_null(column.cast(pa.string()), "")
        if table is not None and len(texts):
            texts = texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts
            _, ends, data = texts.buffers()
            data = pa.py_buffer(table[np.frombuffer(data, np.uint8)].tobytes()) if data is not None else data
            texts = pa.StringArray.from_buffers(len(texts), ends, data)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        coded = lists.flatten().dictionary_encode()
        self.distinct, self.at = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        self.of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        # white space at a text's edges leaves empty pieces
        empty = pc.index(self.distinct, "").as_py()
        if empty >= 0:
            there = self.at != empty
            self.at, self.of = self.at[there], self.of[there]
        self.sizes = np.bincount(self.of, minlength=len(lists))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def hashes(self) -> np.ndarray:
        """hash64 of every word."""
        return hashes_of(self.distinct.cast(pa.binary()))[self.at]

    def text(self, i: int) -> slice:
        return slice(self.starts[i], self.starts[i] + self.sizes[i])


def runs(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` codes."""
    total = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        total += codes[k : k + len(total)] * PLACES[k]
    return mixed(total)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of `size` words, sorted; of all words as one run if they are fewer; none of none."""
    if not len(h):
        return h
    return np.unique(runs(h, min(size, len(h))))


def with_columns(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])
