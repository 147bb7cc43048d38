"""Selection under budgets. Folds whose steps depend on one another run on ids, scores and token counts only."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ordered import running
from graphloom.runtime import materialize


def prefix_budget(rows: DataFrame, group: list[str], order: list, tokens: str, budget: int) -> DataFrame:
    """Rows of each group before the first one at which the running sum of tokens exceeds the budget. Tokens are 0 or more."""
    return running(rows, group, order, tokens).drop("place").where(F.col("used") <= budget)


def knapsack(rows: DataFrame, group: list[str], order: list[str], tokens: str, budget: int, key: str = "id") -> DataFrame:
    """(group, key, position): greedy choice in order; a row that doesn't fit is skipped, later smaller ones may fit.

    Once a row of some size was skipped, no later row of that size fits, so only
    the first budget / size rows of each size can be kept: a group's fold sees
    budget * (1 + ln budget) rows at most, whatever the group's length. Rows
    without tokens always fit and aren't folded; null and negative counts never do.
    """
    size = F.col(tokens).cast("long")
    sized = rows.select(*dict.fromkeys([*group, *order, key]), size.alias("_size")).where((F.col("_size") >= 0) & (F.col("_size") <= budget))
    sized = materialize(sized, "knapsack")
    first = running(sized.where("_size > 0"), [*group, "_size"], order).where(F.col("place") <= F.floor(F.lit(budget) / F.col("_size")))
    listed = first.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, F.col("_size"), F.col(key).alias("_key")))).alias("rows"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() AS array<int>)").alias("kept"))
    fold = F.aggregate(
        F.transform("rows", lambda _, i: i),
        empty,
        lambda a, i: F.when(
            a["used"] + F.get(F.col("rows"), i)["_size"] <= budget,
            F.struct((a["used"] + F.get(F.col("rows"), i)["_size"]).alias("used"), F.concat(a["kept"], F.array(i)).alias("kept")),
        ).otherwise(a),
        lambda a: a["kept"],
    )
    chosen = listed.select(*group, F.explode(F.transform(fold, lambda i: F.get(F.col("rows"), i))).alias("row"))
    names = list(dict.fromkeys([*group, *order, key]))
    chosen = chosen.select(*[F.col(c) if c in group else F.col("row._key").alias(c) if c == key else F.col(f"row.{c}") for c in names])
    kept = materialize(chosen.unionByName(sized.where("_size = 0").select(*names)), "knapsack")
    return running(kept, group, order).select(*group, (F.col("place") - 1).alias("position"), key)


#: In a round-robin choice a directory gives so many rows at most, and a row takes that share of the budget at most.
PER_DIRECTORY, SHARE = 3, 0.6


def chosen_in_turns(offers: pd.DataFrame, budget: int) -> list:
    """Ids in order of choice. offers: one row for each turn of each directory (turn, directory, best, id, score, tokens).

    Turn k of a directory is its k-th best row, taken or passed over for good. A
    turn's rows come by score, equal ones by their directories' best rows; one is
    chosen if its directory still may give, it is within its share and what is
    left of the budget holds it. A turn without a choice is the last.
    """
    offers = offers.assign(order=-offers["score"]).sort_values(["turn", "order", "best"], kind="stable")
    fits = offers[offers["tokens"] <= int(SHARE * budget)]
    given, chosen, left, turn = Counter(), [], budget, 0
    for row in fits.itertuples(index=False):
        if row.turn > turn:
            # turns in between offered nothing that fits, so they would have ended the choice
            if left <= 0 or row.turn > turn + 1 or turn and not chose:
                break
            turn, chose = row.turn, False
        if row.tokens <= left and given[row.directory] < PER_DIRECTORY:
            chosen.append(row.id)
            given[row.directory] += 1
            left -= row.tokens
            chose = True
    return chosen


def select_round_robin(scored: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """(id, directory, score, tokens) -> (id, position), for each group if one is named.

    Every turn but the last keeps a row, and a directory keeps three at most, so
    there are 3 * directories + 1 turns at most. Each takes one row of a
    directory: no row beyond that place is ever looked at, and the fold sees the
    square of the number of directories, not of rows.
    """
    by = scored.withColumn("fold", F.lit(0) if group is None else F.col(group)).select("fold", "id", "directory", "score", "tokens")
    by = materialize(by, "round-robin")
    per = by.groupBy("fold").agg((F.countDistinct("directory") * PER_DIRECTORY + 1).alias("turns"))
    by = running(by, ["fold", "directory"], [F.desc("score"), "id"]).withColumnRenamed("place", "turn").join(per.withColumnRenamed("fold", "of"), F.col("fold").eqNullSafe(F.col("of"))).where("turn <= turns")
    first = by.where("turn = 1").select(F.col("fold").alias("of_fold"), F.col("directory").alias("of_directory"), F.struct((-F.col("score")).alias("s"), "id").alias("best"))
    offers = by.join(first, F.col("fold").eqNullSafe(F.col("of_fold")) & F.col("directory").eqNullSafe(F.col("of_directory")))
    kind, id_kind = by.schema["fold"].dataType.simpleString(), scored.schema["id"].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        ranks = {key: k for k, key in enumerate(sorted({(s, i) for s, i in zip(rows["s"], rows["best_id"])}))}
        rows = rows.assign(best=[ranks[key] for key in zip(rows["s"], rows["best_id"])])
        kept = chosen_in_turns(rows, budget)
        return pd.DataFrame({"fold": rows["fold"].iloc[0], "id": kept, "position": range(len(kept))})

    offers = offers.select("fold", "id", "directory", "score", "tokens", "turn", F.col("best.s").alias("s"), F.col("best.id").alias("best_id"))
    out = offers.groupBy("fold").applyInPandas(fold, f"fold {kind}, id {id_kind}, position long")
    return out.drop("fold") if group is None else out.withColumnRenamed("fold", group)


def codebase_map(nodes: DataFrame, header: int, budget: int = 500, per_file: int = 3) -> DataFrame:
    """(file, id, place, used): up to three nodes of each file by line, files in order, until a running budget is exceeded."""
    top = nodes.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("line_start", "id"))).where(F.col("nth") <= per_file)
    top = running(materialize(top, "map"), [], ["file", "nth"], "tokens").withColumn("used", F.lit(header) + F.col("used"))
    return top.where(F.col("used") <= budget).select("file", "id", F.col("nth").alias("place"), "used")


def recent(rows: DataFrame, key: str, item: str, order: str, limit: int = 250) -> DataFrame:
    """The last items of each key by first appearance."""
    first = rows.groupBy(key, item).agg(F.min(order).alias(order))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), item))).where(F.col("place") <= limit)
