"""A graph kept current from a stream of file changes.

Each micro-batch of (file, lang, text, deleted, at) replaces what the snapshot
holds of those files. Snapshots of parsed rows are versions in the shared folder;
a small file names the current one, its generation and the last batch in it, and
is replaced at once when a version is whole. So a driver that starts again goes
on from the last version, the stream's checkpoint replays a batch that failed, and
a batch counts once. A reset opens a new generation: a batch that began before it
writes a version that is never made current.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.code import SCHEMA, graph_of, parse
from graphloom.sources.files import Files

#: Versions that stay: the current one, and one that a reader may still hold.
KEPT = 2
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class LiveGraph:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files, self._lock = spark, folder.rstrip("/"), Files(spark, folder), threading.Lock()

    def state(self) -> dict:
        """version (None: nothing yet), generation and batch (the last one applied; -1: none) of the current version."""
        if not self.files.exists("CURRENT"):
            return {"version": None, "generation": 0, "batch": -1}
        return json.loads(self.files.read("CURRENT"))

    @property
    def version(self) -> str | None:
        return self.state()["version"]

    def parsed(self) -> DataFrame:
        """Parsed rows of the current version."""
        version = self.version
        if version is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{version}")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """References are kept unresolved, so a resolved graph always equals that of a full parse."""
        return graph_of(self.parsed())

    def _publish(self, rows: DataFrame, generation: int, batch: int, new_generation: bool = False) -> bool:
        """Writes a version and makes it current, unless another generation has begun."""
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*COLUMNS).write.parquet(f"{self.folder}/{version}")
        with self._lock:
            now = self.state()
            if now["generation"] != generation:
                self.files.delete(version)
                return False
            history = [*now.get("history", []), version]
            self.files.write(json.dumps({"version": version, "generation": generation + new_generation, "batch": batch, "history": history[-KEPT:]}), "CURRENT")
            for old in history[:-KEPT]:
                self.files.delete(old)
        return True

    def reset(self, files: DataFrame) -> None:
        """Starts over from (file, lang, text). Batches under way don't change what it leaves."""
        while True:
            now = self.state()
            if self._publish(parse(files), now["generation"], now["batch"], new_generation=True):
                return

    def apply(self, changes: DataFrame, batch_id: int) -> bool:
        """One micro-batch; of several changes to a file the one with the greatest `at` counts. False: it was applied before, or a reset came in between."""
        now = self.state()
        if batch_id <= now["batch"]:
            return False
        last = changes.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at")))).where("place = 1")
        kept = self.parsed().join(last.select("file"), "file", "left_anti").select(*COLUMNS)
        return self._publish(kept.union(parse(last.where("NOT deleted").select("file", "lang", "text"))), now["generation"], batch_id)

    def follow(self, changes: DataFrame, checkpoint: str, every: str = "2 seconds"):
        """Starts the stream; returns its query."""
        return changes.writeStream.foreachBatch(lambda rows, batch: self.apply(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
