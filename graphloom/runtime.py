"""Where intermediate tables live, and how small a table must be to be broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it has been counted and found to be at most this long.
BROADCAST_ROWS = 200_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    spark.checkpoint.dir as the cluster names it. Where it is unset, a local
    session gets a temporary folder and any other session a folder in its
    warehouse, which all executors reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.startswith("local["):
            named = tempfile.mkdtemp(prefix="graphloom-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is materialized inside is deleted at the end, but for paths that are taken off the list. Nothing lazy that reads it may be left."""
    from graphloom.sources.files import Files

    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.remove(made)
        for path in made:
            Files(spark, path).delete()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder once and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows are dealt out so that a task gets so many at least, and so many at most.
LEAST_DEALT, MOST_DEALT = 500, 20_000


def dealt(df: DataFrame, key: str | Column) -> DataFrame:
    """df with its rows dealt out by key if one partition holds more than its share, as the only row group of a file does; else df.

    Costs a count of each partition's rows, so df must be cheap to count, and a
    shuffle only where most cores would wait for few. The key should tell rows apart.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    n, most = held["n"] or 0, held["most"] or 0
    wanted = max(min(2 * cores, n // LEAST_DEALT), -(-n // MOST_DEALT))
    return df.repartition(wanted, key) if wanted > 1 and most > max(1.5 * n / cores, 2 * LEAST_DEALT) else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows; otherwise df, for a shuffled join.

    df must be cheap to count, so pass a materialized table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
