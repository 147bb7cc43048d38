"""File changes found by comparing listings: creations, edits, renames and deletions.

A listing is a table of (file, size, changed) in the shared folder, and changes
are an outer join of the last two, so no list of files passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.code import LANGUAGES
from graphloom.sources.files import Files, checked_folder
from graphloom.streaming.changes import LiveGraph

#: So many roots are watched at once; the one watched longest gives way.
WATCHED = 8


class Watch:
    """One root's listing and the graph kept from it.

    A tick that fails leaves the last listing, so the next one repeats its
    changes. A driver that starts again goes on from the listing of the last
    tick whose changes the graph holds.
    """

    def __init__(self, spark: SparkSession, root: str, live: LiveGraph, folder: str):
        self.spark, self.root, self.live, self.folder = spark, checked_folder(spark, root), live, folder.rstrip("/")
        applied = live.state()["batch"]
        self.version = applied if applied > 0 and Files(spark, folder).exists(f"listing-{applied}", "_SUCCESS") else 0
        # without its listing, ticks still have to count on from what was applied
        self.number = max(applied, 0)

    def _listing(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,js,jsx,ts,tsx,java,go,rs}").load(self.root)
        base = F.lit(self.root + "/")
        return files.select("path", base.alias("base"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("changed")).select(F.expr("substring(path, instr(path, base) + length(base))").alias("file"), "size", "changed")

    def _last(self) -> DataFrame:
        schema = "file string, size long, changed double"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/listing-{self.version}") if self.version else self.spark.createDataFrame([], schema)

    def tick(self) -> int:
        """Applies what changed since the last tick; returns the number of files."""
        number = self.number + 1
        path = f"{self.folder}/listing-{number}"
        self._listing().write.mode("overwrite").parquet(path)
        now = self.spark.read.schema("file string, size long, changed double").parquet(path)
        before = self._last().select("file", F.struct("size", "changed").alias("before"))
        both = now.select("file", F.struct("size", "changed").alias("now")).join(before, "file", "full_outer")
        moved = both.where(~F.col("now").eqNullSafe(F.col("before"))).select("file", F.col("now").isNull().alias("deleted"))
        found = moved.count()
        if found:
            texts = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root).withColumn("base", F.lit(self.root + "/"))
            texts = texts.select(F.expr("substring(path, instr(path, base) + length(base))").alias("file"), F.expr("make_valid_utf8(cast(content AS string))").alias("text"))
            lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.regexp_extract("file", r"(\.[^./]+)$", 1)]
            # a file that went away since it was listed counts as deleted, and is found so again by the next tick
            changes = moved.join(texts, "file", "left").select("file", lang.alias("lang"), "text", (F.col("deleted") | F.col("text").isNull()).alias("deleted"), F.lit(number).alias("at"))
            if not self.live.apply(changes, number):
                return 0  # a reset came in between; the next tick compares again
            Files(self.spark, self.folder).delete(f"listing-{self.version}")
        self.version = self.number = number
        return found

    def follow(self, checkpoint: str, every: str = "2 seconds"):
        """Ticks as a stream: each trigger is one comparison. Returns its query."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(lambda _, __: self.tick() and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Watchers:
    """Running watches by root."""

    def __init__(self, limit: int = WATCHED):
        self.limit, self.running = limit, {}

    def start(self, watch: Watch, checkpoint: str):
        """Starting a root again changes nothing."""
        if watch.root not in self.running:
            while len(self.running) >= self.limit:
                self.stop(next(iter(self.running)))
            self.running[watch.root] = watch.follow(checkpoint)
        return self.running[watch.root]

    def stop(self, root: str) -> bool:
        query = self.running.pop(root.rstrip("/"), None)
        if query is not None:
            query.stop()
        return query is not None

    def stats(self) -> dict:
        return {"watched": sorted(self.running), "active": sum(q.isActive for q in self.running.values())}
