"""Array expressions, as SQL and as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_sums(values: str, block: int = 256, kind: str = "int") -> str:
    """SQL: for each entry of an array of numbers of a kind, the sum of those before it.

    In two levels, inside blocks and over the blocks' totals, so that the cost of
    copying what a fold has gathered stays near the array's length.
    """
    empty = f"named_struct('at', cast(0 AS {kind}), 'all', cast(array() AS array<{kind}>))"
    inside = f"""transform(sequence(0, (size(addends) - 1) div {block}), b -> aggregate(slice(addends, b * {block} + 1, {block}), {empty},
        (s, x) -> named_struct('at', s.at + x, 'all', concat(s.all, array(s.at)))))"""
    before = f"aggregate(parts, {empty}, (s, x) -> named_struct('at', s.at + x.at, 'all', concat(s.all, array(s.at))), s -> s.all)"
    return f"""flatten(flatten(flatten(transform(array({values}), addends -> flatten(transform(array({inside}), parts ->
        transform(array({before}), offsets -> transform(parts, (x, k) -> transform(x.all, a -> a + offsets[k])))))))))"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The array that body makes of a value, which is computed once."""
    return F.flatten(F.transform(F.array(value), body))


def sums_before(values: Column, block: int = 256) -> Column:
    """prefix_sums of a column."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))

    def inside(addends: Column) -> Column:
        last = ((F.size(addends) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(addends, b * block + 1, F.lit(block)), empty, step))

    def over(parts: Column) -> Column:
        offsets = F.aggregate(parts, empty, lambda s, x: step(s, x["at"]), lambda s: s["all"])
        return let(offsets, lambda o: F.flatten(F.transform(parts, lambda x, k: F.transform(x["all"], lambda a: a + F.get(o, k)))))

    return let(values, lambda addends: let(inside(addends), over))
