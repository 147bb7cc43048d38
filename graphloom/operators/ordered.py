"""Places and running sums over groups of any size, without a window over a whole group.

Rows are range-partitioned by group and order, so a hot group takes many
partitions. Each partition counts on its own; what came before it in the group
that it begins with is one row for each partition, so that side may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import materialize

_ROW_BITS = 33  # of monotonically_increasing_id


def running(rows: DataFrame, group: list[str], order: list[str | Column], weight: str | list[str] | None = None) -> DataFrame:
    """rows with `place` (long, from 1) by order in each group and, of a long column, the sum `used` up to and with each row.

    Of several columns, the sums are `used_` and each one's name. The order must
    tell a group's rows apart. Null groups are groups; null weights add nothing.
    rows is computed twice, so it should be a table.
    """
    weights = {"used": weight} if isinstance(weight, str) else {f"used_{c}": c for c in weight or []}
    keys = [F.col(c) for c in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    zero = F.lit(0).cast("long")
    weighed = rows
    for k, c in enumerate(weights.values()):
        weighed = weighed.withColumn(f"_weight{k}", F.coalesce(F.col(c).cast("long"), zero))
    # without a number of partitions, so that small ones may be read together
    laid = weighed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    laid = materialize(laid.withColumn("_part", F.shiftright("_at", _ROW_BITS)), "ordered")
    here = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = laid.withColumn("_place", F.row_number().over(Window.partitionBy("_part", *group).orderBy("_at")))
    for k in range(len(weights)):
        inside = inside.withColumn(f"_used{k}", F.sum(f"_weight{k}").over(here))
    # a partition has one group at most that began before it, so `earlier` has one row for each partition at most
    sums = laid.groupBy("_part", *group).agg(F.count("*").alias("_n"), *[F.sum(f"_weight{k}").alias(f"_w{k}") for k in range(len(weights))])
    past = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.sum("_n").over(past).alias("_n0"), *[F.sum(f"_w{k}").over(past).alias(f"_before{k}") for k in range(len(weights))]]
    earlier = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], *before).where("_n0 IS NOT NULL")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = inside.join(F.broadcast(earlier), same, "left")
    added = [(F.col("_place") + F.coalesce("_n0", zero)).alias("place")]
    added += [(F.col(f"_used{k}") + F.coalesce(f"_before{k}", zero)).alias(name) for k, name in enumerate(weights)]
    return out.select(*rows.columns, *added)
