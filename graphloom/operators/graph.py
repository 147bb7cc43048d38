"""Property graphs: nodes (id, type, name, file, content, seq) and edges (source, target, type, seq)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import short_name
from graphloom.operators.ordered import running
from graphloom.runtime import materialize


def restrict_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst), undirected and without repeats."""
    return edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).union(edges.select("target", "source")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends at each node, parallel edges counted."""
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).groupBy("id").agg(F.count("*").alias("degree"))


#: Steps of PageRank whose ranks are written, and compared, together.
TOGETHER = 8
#: A graph of so many links at most, as a code base has, is walked by one task, which needs no job for a step.
ONE_TASK = 200_000


def _ranks_in_one_task(damping: float, max_iter: int, tol: float) -> Callable[[pa.Table], pa.Table]:
    """The steps of pagerank over a table of all links."""

    def run(links: pa.Table) -> pa.Table:
        t = links.combine_chunks()
        own = t.filter(pc.is_null(t["degree"]))  # every node has one link to itself
        ids, times = own["src"], own["times"].to_numpy()
        real = t.filter(pc.is_valid(t["degree"]))
        src, dst = (pc.index_in(real[c], value_set=ids).to_numpy() for c in ("src", "dst"))
        share, n = real["times"].to_numpy() / real["degree"].to_numpy(), times.sum()
        rank = np.full(len(ids), 1 / n)
        for _ in range(max_iter):
            new = (1 - damping) / n + damping * np.bincount(dst, rank[src] * share, minlength=len(ids))
            new /= (new * times).sum()
            moved, rank = (np.abs(new - rank) * times).sum(), new
            if moved < tol:
                break
        return pa.table({"id": ids, "rank": rank})

    return run


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """(id, rank) on the undirected simple graph of the nodes, brought to sum 1 after every step.

    Nodes whose only neighbour is the same hub hold the same rank at every step,
    and so do isolated ones: each such class is one node that counts as many times
    as it has members, whose rank all of them get at the end. A graph of files
    and what they contain has few other nodes.
    """
    ids = materialize(nodes.select("id").distinct(), "pagerank-nodes")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    pairs = materialize(adjacency(restrict_edges(edges, ids)), "pagerank-pairs")
    degree = pairs.groupBy("src").agg(F.count("*").alias("degree"))
    ends = pairs.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("other")), "dst")
    ends = materialize(ends.select("src", "dst", "degree", "other"), "pagerank-ends")
    leaves = ends.where("degree = 1 AND other > 1")
    classes = materialize(leaves.groupBy("dst").agg(F.min("src").alias("member"), F.count("*").alias("times"), F.max("other").alias("degree")), "pagerank-classes")
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")
    core = ends.where("NOT (degree = 1 AND other > 1) AND NOT (degree > 1 AND other = 1)").select("src", "dst", "degree", one.alias("times"))
    isolated = ids.join(degree, ids["id"] == degree["src"], "left_anti")
    first, alone = isolated.agg(F.min("id"), F.count("*")).first()
    single = core.select(F.col("src").alias("id")).union(classes.select("dst")).distinct()
    lone = ids.where(F.col("id").eqNullSafe(F.lit(first).cast(ids.schema["id"].dataType))).select("id", F.lit(alone).cast("long").alias("times")).limit(1 if alone else 0)
    own = single.select("id", one.alias("times")).union(classes.select("member", "times")).union(lone)
    links = core.union(classes.select("member", "dst", one, "times")).union(classes.select("dst", "member", "degree", one))
    links = materialize(links.union(own.select("id", F.col("id").alias("dst"), none, "times")), "pagerank-edges")
    ranks = _ranks(links, n, alone, damping, max_iter, tol, ids.schema["id"].dataType)
    ranks = materialize(ranks, "pagerank-ranks")
    of_class = classes.join(ranks, F.col("member") == F.col("id")).select("dst", "rank")
    members = leaves.select(F.col("src").alias("id"), "dst").join(of_class, "dst").select("id", "rank")
    apart = isolated.crossJoin(F.broadcast(ranks.where(F.col("id").eqNullSafe(F.lit(first).cast(ids.schema["id"].dataType))).select("rank").limit(1 if alone else 0)))
    return ranks.join(single, "id").select("id", "rank").union(members).union(apart.select("id", "rank"))


def _ranks(links: DataFrame, n: int, alone: int, damping: float, max_iter: int, tol: float, id_type: T.DataType) -> DataFrame:
    """(id, rank) of nodes, some of which stand for several.

    Links (src, dst, degree, times) carry the rank of src over its degree so many
    times. The sum of a step is known without a look at the rows: what connected
    nodes hold is given on whole, and isolated ones all hold the same. Every node
    also has a link to itself, without a degree, that carries the ranks it had, so
    a step is one join and one aggregate of the last one, and a plan of several
    steps stays as long as they are; its times are the node's. TOGETHER steps are
    written as one table, of which one aggregate says after which step the ranks
    moved less than tol. Up to ONE_TASK links take the same steps in one task.
    """
    if links.limit(ONE_TASK + 1).count() <= ONE_TASK:
        kind = T.StructType([T.StructField("id", id_type), T.StructField("rank", T.DoubleType())])
        return links.groupBy(F.lit(0).alias("whole")).applyInArrow(_ranks_in_one_task(damping, max_iter, tol), kind)
    share = (1 - damping) / n
    now = links.where("degree IS NULL").select(F.col("src").alias("id"), F.array(F.lit(1.0 / n)).alias("ranks"))
    isolated, done = 1.0 / n, 0
    while done < max_iter:
        steps = min(TOGETHER, max_iter - done)
        for _ in range(steps):
            whole = 1 - damping + damping * (1 - alone * isolated)
            isolated = share / whole
            met = links.join(now.select("id", "ranks"), F.col("src") == F.col("id"))
            given = F.sum(F.when(F.col("degree").isNotNull(), F.element_at("ranks", -1) * F.col("times") / F.col("degree")).otherwise(0.0))
            held = F.max(F.when(F.col("degree").isNull(), F.struct("ranks", "times")))
            now = met.groupBy("dst").agg(given.alias("given"), held.alias("held"))
            now = now.select(F.col("dst").alias("id"), F.col("held.times").alias("times"), F.concat("held.ranks", F.array((F.lit(share) + F.lit(damping) * F.col("given")) / F.lit(whole))).alias("ranks"))
        now = materialize(now, "pagerank")
        moved = now.agg(*[F.sum(F.col("times") * F.abs(F.get("ranks", F.lit(k)) - F.get("ranks", F.lit(k - 1)))).alias(f"m{k}") for k in range(1, steps + 1)]).first()
        still = next((k for k in range(1, steps + 1) if moved[f"m{k}"] < tol), None)
        now, done = now.select("id", F.array(F.get("ranks", F.lit(still or steps))).alias("ranks")), done + steps
        if still:
            break
    return now.select("id", F.get("ranks", F.lit(0)).alias("rank"))


def resolve_names(refs: DataFrame, nodes: DataFrame, first: int = 3) -> DataFrame:
    """References (source, callee, type, seq) -> edges to the first nodes of that name; the rest are dropped."""
    ranked = nodes.select(F.col("id").alias("target"), "name", F.row_number().over(Window.partitionBy("name").orderBy("seq")).alias("place")).where(F.col("place") <= first)
    return refs.join(ranked, F.col("callee") == F.col("name")).select("source", "target", "type", "seq", "place")


#: What may follow a dotted import's path, and a name as it stands.
IMPORT_ENDS = (".py", ".js", ".ts", "/index.js", "/index.ts", "/__init__.py")
BARE_ENDS = (".py", ".js")


def import_candidates(name) -> list:
    """Paths that an import may mean."""
    path = F.replace(name, F.lit("."), F.lit("/"))
    return [F.concat(path, F.lit(end)) for end in IMPORT_ENDS] + [F.concat(name, F.lit(end)) for end in BARE_ENDS]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, import_name) -> (source, import_name, target): the first file, by seq, whose path is or ends with a candidate.

    Every suffix of a file's path is a key, so this is an equi-join. A name is looked up once, however many sources import it.
    """
    parts = F.split("file", "/", -1)
    suffixes = files.select("id", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    asked = imports.select("import_name").distinct().select("import_name", F.explode(F.array_distinct(F.array(*import_candidates(F.col("import_name"))))).alias("suffix"))
    found = asked.join(suffixes, "suffix").groupBy("import_name").agg(F.min_by("id", "seq").alias("target"))
    return imports.select("source", "import_name").distinct().join(found, "import_name").select("source", "import_name", "target")


def resolve_import_prefixes(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, import_name) -> (source, import_name, target): the first file, by seq, whose name begins with the import's last part.

    The prefixes that are asked for are few and the files many, so each prefix's
    first file is found before the join: every prefix of a file's name is a key,
    as long as some import's last part, and combines before the shuffle.
    """
    asked = imports.select("source", "import_name", F.element_at(F.split("import_name", r"\.", -1), -1).alias("prefix"))
    prefixes = asked.select("prefix").distinct()
    long = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    ends = F.transform(F.filter("lengths", lambda i: i <= F.length("name")), lambda i: F.substring("name", F.lit(1), i))
    first = files.crossJoin(F.broadcast(long)).select("id", "seq", F.explode(ends).alias("prefix")).join(prefixes, "prefix", "left_semi")
    first = first.groupBy("prefix").agg(F.min_by("id", "seq").alias("target"))
    return asked.join(first, "prefix").select("source", "import_name", "target")


#: Links in one row of an edge index.
LINKS = 10_000


def edge_index(edges: DataFrame, own: str = "source", other: str = "target") -> DataFrame:
    """(id, part, links): the other ends of each node's edges in edge order, repeats kept, LINKS of them a row: a hub has many rows, none of them long."""
    placed = running(materialize(edges.select(F.col(own).alias("id"), F.col(other).alias("other"), "seq"), "edges"), ["id"], ["seq", "other"])
    listed = F.sort_array(F.collect_list(F.struct("place", "other")))
    return placed.groupBy("id", F.floor((F.col("place") - 1) / LINKS).alias("part")).agg(F.transform(listed, lambda x: x["other"]).alias("links"))


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """Edges that touch a node."""
    return edges.where((F.col("source") == node) | (F.col("target") == node))


def summaries(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """(id, summary): name, file, type and the short names of up to five callers and callees, by edge order."""

    def side(own: str, other: str, word: str) -> DataFrame:
        ranked = edges.select(F.col(own).alias("id"), F.col(other).alias("other"), "seq", F.row_number().over(Window.partitionBy(own).orderBy("seq")).alias("place")).where(F.col("place") <= limit)
        names = F.transform(F.sort_array(F.collect_list(F.struct("seq", "other"))), lambda x: short_name(x["other"]))
        return ranked.groupBy("id").agg(F.concat(F.lit(f" [{word}:"), F.array_join(names, ","), F.lit("]")).alias(word))

    out = nodes.join(side("target", "source", "callers"), "id", "left").join(side("source", "target", "calls"), "id", "left")
    return out.select("id", F.concat(F.concat_ws(" ", "name", "file", "type"), F.coalesce("callers", F.lit("")), F.coalesce("calls", F.lit(""))).alias("summary"))


def diff_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, change): added, removed or modified (content), in one outer join on hashes."""
    x = a.select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("x"))
    y = b.select("id", F.sha2(F.coalesce("content", F.lit("")), 256).alias("y"))
    kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified")
    return x.join(y, "id", "full_outer").select("id", kind.alias("change")).where("change IS NOT NULL")


def diff_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(source, target, type, change) of edges in one graph only."""
    key = ["source", "target", "type"]
    gone = a.select(key).distinct().join(b, key, "left_anti").withColumn("change", F.lit("removed"))
    return b.select(key).distinct().join(a, key, "left_anti").withColumn("change", F.lit("added")).union(gone)


# The parts of a difference's summary.
CHANGED_NODES, CHANGED_EDGES, UNCHANGED = "{n} nodes {change} across {files} file(s)", "{n} edges {change}", "No changes detected"


@dataclass
class Difference:
    """Two graphs compared: nodes (change, id, name, type, file, line_start, line_end; as the later graph has them, removed ones as the earlier) and edges (change, source, target, type), written tables."""

    nodes: DataFrame
    edges: DataFrame
    sizes: dict

    def listed(self, change: str) -> DataFrame:
        """Nodes of one kind of change, in order of their ids."""
        return self.nodes.where(F.col("change") == change).drop("change").orderBy("id")

    def linked(self, change: str) -> DataFrame:
        """Edges of one kind of change, in order of their ends and types."""
        return self.edges.where(F.col("change") == change).drop("change").orderBy("source", "target", "type")

    def counts(self) -> DataFrame:
        """(what, change, n, files): how many nodes and edges changed, and in how many files nodes did."""
        of_nodes = self.nodes.groupBy("change").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).select(F.lit("nodes").alias("what"), "change", "n", "files")
        of_edges = self.edges.groupBy("change").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "change", "n", F.lit(None).cast("long").alias("files"))
        return of_nodes.union(of_edges)

    def summary(self) -> str:
        """One line of counts; at most five rows come to the driver."""
        found = {(r["what"], r["change"]): r for r in self.counts().collect()}
        order = [(CHANGED_NODES, ("nodes", c)) for c in ("added", "removed", "modified")] + [(CHANGED_EDGES, ("edges", c)) for c in ("added", "removed")]
        return "; ".join(told.format(**found[key].asDict()) for told, key in order if key in found) or UNCHANGED


def diff(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> Difference:
    """What became of graph a = (nodes, edges) in graph b."""
    shown = ["id", "name", "type", "file", "line_start", "line_end"]
    changes = materialize(diff_nodes(a[0], b[0]), "changes")
    later = changes.where("change <> 'removed'").join(b[0].select(*shown), "id")
    earlier = changes.where("change = 'removed'").join(a[0].select(*shown), "id")
    nodes = materialize(later.unionByName(earlier).select("change", *shown), "changed-nodes")
    edges = materialize(diff_edges(a[1], b[1]).select("change", "source", "target", "type"), "changed-edges")
    sizes = {k: {"nodes": g[0].count(), "edges": g[1].count()} for k, g in (("graph_a", a), ("graph_b", b))}
    return Difference(nodes, edges, sizes)


def update(nodes: DataFrame, refs: DataFrame, changed: DataFrame, parsed_nodes: DataFrame, parsed_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and unresolved references after files changed: theirs are dropped and what was parsed anew is added."""
    kept = nodes.join(changed.select("file").distinct(), "file", "left_anti")
    gone = nodes.join(changed.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("source"))
    return kept.unionByName(parsed_nodes), refs.join(gone, "source", "left_anti").unionByName(parsed_refs)


def reach(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(entry, id, depth): nodes reached from each entry (id) in at most `depth` steps, at their least depth. What was reached before isn't walked again."""
    found = front = start.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        new = front.join(edges.select("source", "target"), F.col("id") == F.col("source")).select("entry", F.col("target").alias("id")).distinct()
        front = materialize(new.join(found, ["entry", "id"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        found = found.union(front)
    return found
