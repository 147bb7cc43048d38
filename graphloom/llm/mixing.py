"""Mixing sources to target weights, in DataFrame expressions only.

Sizes are summed per source, each source gets a target, and a document is
emitted floor(rate) times plus once more with probability rate - floor(rate),
decided by a seeded hash of its id and size, where rate is the source's target
over its size.

Edge cases: a null text has size 0; a null source is a source, last in order;
a source without words has target 0 and rate 0; repeated rows are rows of
their own (equal rows get equal decisions); an empty table gives no rows; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.columns import fresh, word_count
from graphloom.operators.ordered import running
from graphloom.runtime import materialize, small

#: Weights that the sources take in order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target is at most this many times its size.
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target, rate). Weights and max_repeats are whole numbers; sizes should be a table.

    Targets share the total of all sizes by weight; what a source has above its
    cap is shared again by weight among the others. With sources ordered by cap
    over weight, the capped ones come first, so one pass of running sums finds
    the level at which all others stand. The sums go over range partitions: there
    may be any number of sources.
    """
    by_name = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    caps = running(sizes, [], [by_name]).withColumn("weight", weight).drop("place")
    caps = caps.withColumn("cap", F.col("source_size") * F.lit(max_repeats)).withColumn("cap_by_weight", F.col("cap") / F.col("weight"))
    rising = ["cap_by_weight", by_name]
    summed = materialize(running(materialize(caps, "mix-caps"), [], rising, ["cap", "weight"]).drop("place"), "mix-caps")
    whole = summed.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    # the level at which this source and all after it would stand, if those before are capped
    own = (F.col("all_sizes") - (F.col("used_cap") - F.col("cap"))) / (F.col("all_weights") - (F.col("used_weight") - F.col("weight")))
    leveled = summed.crossJoin(F.broadcast(whole)).withColumn("own_level", own)
    level = leveled.agg(F.max(F.when(F.col("own_level") <= F.col("cap_by_weight"), F.col("own_level"))).alias("level"))
    return (
        summed.crossJoin(F.broadcast(level))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", "rate")
    )


def mix_plan(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, str]:
    """docs with a struct column (size, source_size, target, rate, copies), and that column's name."""
    name, key = fresh(docs, "mix"), fresh(docs, "mix_source")
    sizes = materialize(docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, max_repeats), "mix-targets")
    targets = small(targets.select(F.struct("source", "source_size", "target", "rate").alias(key)), 10_000)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"), word_count(F.col("text"))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    rate = F.col(f"{key}.rate")
    plan = F.struct(
        word_count(F.col("text")).alias("size"),
        F.col(f"{key}.source_size").alias("source_size"),
        F.col(f"{key}.target").alias("target"),
        rate.alias("rate"),
        (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).alias("copies"),
    )
    return docs.join(targets, docs["source"].eqNullSafe(F.col(f"{key}.source"))).withColumn(name, plan).drop(key), name


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: rows of docs, each as often as the plan says."""
    planned, name = mix_plan(docs, seed, weights, max_repeats)
    copy = fresh(planned, "mix_copy")
    return planned.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(f"{name}.copies").cast("int")))).select(*docs.columns)
