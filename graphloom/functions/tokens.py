"""Token counts, exact truncation, and compression to a budget, with a named tokenizer file."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A file of the tokenizers library; a parameter wherever it is used.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


#: Characters that are encoded together: an encoding takes some fifty times the memory of its text.
ENCODED_TOGETHER = 1 << 18


@lru_cache(maxsize=2)
def _loaded(path: str, changed: int):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _load(path: str):
    """The tokenizer of a file; a process loads it once, and again if the file changes."""
    return _loaded(path, os.stat(path).st_mtime_ns)


def slices(texts: list[str], size: int = ENCODED_TOGETHER) -> Iterator[list[str]]:
    """The texts in runs of at most so many characters, or one text."""
    low = used = 0
    for i, t in enumerate(texts):
        if i > low and used + len(t) > size:
            yield texts[low:i]
            low, used = i, 0
        used += len(t)
    if texts:
        yield texts[low:]


def sizes(texts: list[str], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text, a slice of texts at a time."""
    known = _load(path)
    return [len(x) for part in slices(texts) for x in known.encode_batch_fast(part, add_special_tokens=False)]


def cut(text: str, limit: int, path: str = TOKENIZER) -> tuple[str, int]:
    """The text of the first `limit` tokens, cut where the last of them ends, and how many tokens the whole text has."""
    found = _load(path).encode(text, add_special_tokens=False)
    n = len(found)
    return (text if n <= limit else text[: found.token_to_chars(limit - 1)[1]] if limit > 0 else ""), n


def counter(path: str = TOKENIZER) -> Callable[[str], int]:
    """A function that counts a string's tokens."""
    known = _load(path)
    return lambda text: len(known.encode(text, add_special_tokens=False))


def count_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens; 0 for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series(sizes(parts.fillna("").tolist(), path), dtype="int64")

    return count(text)


def truncate(text: Column, limit: int, path: str = TOKENIZER) -> Column:
    """The text of the first `limit` tokens, cut where the last of them ends."""

    @F.pandas_udf("string")
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series([cut(t, limit, path)[0] for t in parts.fillna("")], dtype="object")

    return short(text)


#: A model keeps this share of a context's tokens at least.
LEAST_RATE = 0.1


def device(wanted: str = "auto", cuda: bool = False, mps: bool = False) -> str:
    """Where a model runs: what is asked for, else the best of what the caller says there is."""
    return wanted if wanted != "auto" else "cuda" if cuda else "mps" if mps else "cpu"


def model_name(on: str, names: dict[str, str], wanted: str | None = None) -> str | None:
    """A model for a device: what is asked for, else the device's own, else the default of names."""
    return wanted or names.get(on) or names.get("default")


def compress(context: Column, target: int = 500, path: str = TOKENIZER, model: Callable[[list[str], list[float]], list[str]] | None = None, rate: float | None = None) -> Column:
    """(compressed, original_tokens, compressed_tokens, ratio) of contexts.

    Those that fit pass through. Others go to the model, a function of texts and
    rates (target over tokens, between LEAST_RATE and 1, unless given) that runs
    in the tasks; what it returns is cut at target tokens, and without a model,
    or where it fails, so is the context itself.
    """

    def modelled(texts: list[str]) -> list[str]:
        before = sizes(texts, path)
        long = [i for i, n in enumerate(before) if n > target]
        try:
            made = model([texts[i] for i in long], [min(max(rate if rate is not None else target / before[i], LEAST_RATE), 1.0) for i in long]) if long else []
        except Exception:  # the model is the caller's: any failure of it falls back to truncation
            made = [texts[i] for i in long]
        out = list(texts)
        for i, t in zip(long, made):
            out[i] = t
        return out

    @F.pandas_udf("compressed string, original_tokens long, compressed_tokens long, ratio double")
    def compressed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for parts in batches:
            rows = []
            for texts in slices(parts.fillna("").tolist()):
                if model is None:
                    cuts = [cut(t, target, path) for t in texts]
                    short, before = [t for t, _ in cuts], [n for _, n in cuts]
                else:
                    short, before = [cut(t, target, path)[0] for t in modelled(texts)], sizes(texts, path)
                # what was cut may be encoded otherwise than as a part of the whole
                after = [n if s == t else None for s, t, n in zip(short, texts, before)]
                again = iter(sizes([s for s, n in zip(short, after) if n is None], path))
                after = [next(again) if n is None else n for n in after]
                rows += [(s, b, a, a / b if b else 0.0) for s, b, a in zip(short, before, after)]
            yield pd.DataFrame(rows, columns=["compressed", "original_tokens", "compressed_tokens", "ratio"])

    return compressed(context)
