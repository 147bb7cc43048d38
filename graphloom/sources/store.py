"""Tables kept by key in the shared folder, for a time, and graphs read from and written to files."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.files import Files

#: Seconds that a table of each kind is kept.
KEPT = {"graph": 86_400, "query": 3_600, "compress": 3_600, "embedding": 30 * 86_400}
GRAPH = "nodes array<struct<id:string,type:string,name:string,file:string,line_start:int,line_end:int,content:string,token_count:int>>, edges array<struct<source:string,target:string,type:string>>, metadata struct<root:string,total_nodes:int,total_edges:int,generated_at:string>"


#: Bytes that a store holds at most, unless told otherwise.
BOUND = 500 << 20


class Store:
    """Written tables by kind and key. An entry counts once its write has ended; its age runs from then. Beyond the bound the oldest entries go."""

    def __init__(self, spark: SparkSession, folder: str, kept: dict[str, int] | None = None, bound: int = BOUND):
        self.spark, self.folder, self.kept, self.bound, self.hits, self.misses = spark, folder.rstrip("/"), dict(KEPT, **(kept or {})), bound, 0, 0
        self.files = Files(spark, folder)

    @staticmethod
    def key(*parts) -> str:
        """All that an entry depends on: a graph's fingerprint and scrub policy, a model and a text, a question and its budget."""
        return hashlib.sha256("\x00".join(map(str, parts)).encode()).hexdigest()[:32]

    def put(self, kind: str, key: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{key}")
        self.shrink(keep=(kind, key))
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{kind}/{key}")

    def get(self, kind: str, key: str) -> DataFrame | None:
        done = (kind, key, "_SUCCESS")
        if self.files.exists(*done) and time.time() - self.files.changed(*done) < self.kept[kind]:
            self.hits += 1
            return self.spark.read.parquet(f"{self.folder}/{kind}/{key}")
        self.misses += 1
        return None

    def get_or(self, kind: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(kind, key)
        return self.put(kind, key, make()) if found is None else found

    def put_text(self, kind: str, key: str, text: str) -> str:
        self.put(kind, key, self.spark.createDataFrame([(text,)], "text string"))
        return text

    def text_or(self, kind: str, key: str, make: Callable[[], str]) -> str:
        found = self.get(kind, key)
        return self.put_text(kind, key, make()) if found is None else found.first()["text"]

    def entries(self) -> list[tuple[float, int, str, str]]:
        """(changed, bytes, kind, key) of all entries, oldest first."""
        return sorted((self.files.changed(kind, key), self.files.size(kind, key), kind, key) for kind in self.kept for key in self.files.names(kind))

    def shrink(self, keep: tuple[str, str] | None = None) -> int:
        """Removes the oldest entries until the bound holds; returns how many."""
        found = self.entries()
        held, gone = sum(e[1] for e in found), 0
        for _, size, kind, key in found:
            if held <= self.bound:
                break
            if (kind, key) != keep:
                self.files.delete(kind, key)
                held, gone = held - size, gone + 1
        return gone

    def clear(self, scope: str = "all") -> int:
        """Removes the entries of a kind, or of all; returns how many. Unknown kinds have none."""
        gone = 0
        for kind in self.kept if scope == "all" else [scope] if scope in self.kept else []:
            gone += len(self.files.names(kind))
            self.files.delete(kind)
        return gone

    def stats(self) -> dict:
        found = self.entries()
        return {"hits": self.hits, "misses": self.misses, "entries": len(found), "bytes": sum(e[1] for e in found), "bound": self.bound}


def vectors(store: Store, rows: DataFrame, model: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(id, text) -> (id, vector): only texts that the model hasn't encoded before are encoded, each once."""
    hashed = rows.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    key = store.key(model)
    known = store.get("embedding", key)
    new = hashed.groupBy("hash").agg(F.min("text").alias("text"))
    new = new if known is None else new.join(known, "hash", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"hash": part["hash"], "vector": encode(part["text"].tolist())})

    if not new.isEmpty():
        new.mapInPandas(run, "hash string, vector array<double>").write.mode("append").parquet(f"{store.folder}/embedding/{key}")
        known = store.spark.read.schema("hash string, vector array<double>").parquet(f"{store.folder}/embedding/{key}")
    if known is None:
        return hashed.select("id", F.lit(None).cast("array<double>").alias("vector"))
    return hashed.select("id", "hash").join(known.dropDuplicates(["hash"]), "hash").select("id", "vector")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph files, each one JSON object; seq is the place in its list."""
    whole = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = whole.select(F.posexplode("nodes").alias("seq", "n")).select("n.*", "seq")
    return nodes, whole.select(F.posexplode("edges").alias("seq", "e")).select("e.*", "seq")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph as two Parquet tables, of any size."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def export_name(root: str) -> str:
    """Where a root's graph goes in a folder of graphs: its name and a hash of its path."""
    name = root.rstrip("/").rsplit("/", 1)[-1] or "root"
    return f"graphs/{name}-{hashlib.sha256(root.encode()).hexdigest()[:16]}.json"


def export_graph(nodes: DataFrame, edges: DataFrame, root: str, folder: str, generated_at: str = "") -> str:
    """The graph as one JSON file that read_graph reads, and its path. Rows pass through the driver one partition at a time; the file is one whatever its size."""
    spark, path = nodes.sparkSession, f"{folder.rstrip('/')}/{export_name(root)}"
    files = Files(spark, path)
    stream = files.api.create(files.at(), True)
    counts = {}

    def put(text: str) -> None:
        stream.write(bytearray(text.encode()))

    try:
        put("{")
        for name, rows, columns in (("nodes", nodes.orderBy("seq"), ["id", "type", "name", "file", "line_start", "line_end", "content", "token_count"]), ("edges", edges.orderBy("source", "target", "type"), ["source", "target", "type"])):
            put(f'"{name}": [')
            n = 0
            for (text,) in rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).toLocalIterator():
                put(("," if n else "") + "\n" + text)
                n += 1
            put("],\n")
            counts[f"total_{name}"] = n
        put('"metadata": ' + json.dumps({"root": root, **counts, "generated_at": generated_at}) + "}\n")
    finally:
        stream.close()
    return path
