"""Markdown of ranked nodes as columns and ordered pieces, kept within token budgets by prefix sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import number_lines, purpose, signature
from graphloom.functions.tokens import TOKENIZER, count_tokens, counter
from graphloom.operators.ordered import running
from graphloom.runtime import materialize

# Headings, and the language that a suffix names.
CODE, MAP, FLOW, DEPENDENCIES = "## Relevant code\n", "## Codebase map (functions + purpose)\n", "## Flow — the complete call chain for this query\n", "\n\n## Referenced dependencies\n"
FENCES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust"}

#: A trace shows at most so many entries, callees of a node, and levels below an entry.
ENTRIES, CALLEES, DEPTH = 3, 4, 3


def fence(file: Column) -> Column:
    """The language of a code fence; empty for other files."""
    names = F.create_map(*[F.lit(x) for kv in FENCES.items() for x in kv])
    return F.coalesce(names[F.regexp_extract(file, r"(\.[^./]+)$", 1)], F.lit(""))


def node_markdown(full: bool = True) -> Column:
    """A node (type, name, file, line_start, line_end, content) as a heading and a fenced body with line numbers."""
    start, content = F.col("line_start").cast("string"), F.coalesce("content", F.lit(""))
    shown = F.when(F.col("type").isin("function", "method"), F.concat("name", F.lit("()"))).when(F.col("type") == "class", F.concat(F.lit("class "), "name")).otherwise(F.col("name"))
    head = F.concat(F.lit("### "), shown, F.lit(" ("), "file", F.lit(":"), start, F.lit("-"), F.col("line_end").cast("string"), F.lit(")\n\n"))
    body = number_lines(content, F.col("line_start")) if full else F.concat(start, F.lit(": "), signature(content), F.lit("  // …"))
    fenced = F.concat(F.lit("```"), fence(F.col("file")), F.lit("\n"), body, F.lit("\n```"))
    return F.concat(head, F.when(content == "", F.concat(F.lit("*("), "type", F.lit(" — no content stored)*"))).otherwise(fenced))


def code_pieces(selected: DataFrame, budget: int = 0, path: str = TOKENIZER) -> DataFrame:
    """(place, piece) of nodes with a rank: a heading for each file, in order of its best node, then that file's nodes.

    With a budget the pieces end before the first that exceeds it; the first
    heading and node always stand.
    """
    best = selected.groupBy("file").agg(F.min("rank").alias("first"))
    nodes = selected.join(best, "file").select("first", "file", F.col("rank").cast("long").alias("rank"), F.concat(node_markdown(), F.lit("\n")).alias("piece"))
    heads = best.select("first", "file", F.lit(-1).cast("long").alias("rank"), F.concat(F.lit("\n#### "), "file", F.lit("\n")).alias("piece"))
    rows = materialize(nodes.unionByName(heads).withColumn("tokens", count_tokens(F.col("piece"), path)), "pieces")
    placed = running(rows, [], ["first", "file", "rank"], "tokens")
    if budget > 0:
        title = selected.sparkSession.range(1, numPartitions=1).select(count_tokens(F.lit(CODE), path)).first()[0]
        placed = placed.where((F.col("place") <= 2) | (F.col("used") + title <= budget))
    return placed.select("place", "piece")


def map_lines(nodes: DataFrame, budget: int = 500, per_file: int = 3, path: str = TOKENIZER, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """(place, line) of the map: up to three definitions of each file by line, with what they are for, files in order. tokens: another measure of the budget."""
    size = tokens or (lambda text: count_tokens(text, path))
    top = nodes.where("type NOT IN ('file', 'module') AND name <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("line_start", "id"))).where(F.col("nth") <= per_file)
    said = purpose(F.col("content"))
    line = F.concat(F.lit("- `"), "name", F.lit("` ("), "file", F.lit(":L"), F.col("line_start").cast("string"), F.lit(")"), F.when(said != "", F.concat(F.lit(" — "), said)).otherwise(""))
    rows = materialize(top.select("file", "nth", line.alias("line")).withColumn("tokens", size(F.col("line"))), "map")
    title = nodes.sparkSession.range(1, numPartitions=1).select(size(F.lit(MAP))).first()[0]
    return running(rows, [], ["file", "nth"], "tokens").where(F.col("used") + title <= budget).select("place", "line")


def flow_trace(selected: DataFrame, edges: DataFrame, budget: int = 300, path: str = TOKENIZER) -> str:
    """The call paths among ranked nodes, from those that no other calls; empty where none calls another.

    Three entries, four callees each and three levels are 255 nodes at most:
    those are found by joins, and only they come to the driver for the walk.
    """
    ids = selected.select("id")
    inner = edges.where("type = 'calls'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    inner = materialize(inner.select("source", "target", "seq"), "flow")
    part = inner.select(F.col("source").alias("id")).union(inner.select("target")).distinct()
    in_flow = selected.join(part, "id", "left_semi")
    if part.limit(2).count() < 2:
        return ""
    free = in_flow.join(inner.select(F.col("target").alias("id")), "id", "left_anti")
    entries = [r["id"] for r in (in_flow if free.isEmpty() else free).orderBy("rank").limit(ENTRIES).select("id").collect()]
    near = inner.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("seq", "target"))).where(F.col("nth") <= CALLEES)
    near = materialize(near, "flow")
    calls, front, known = {}, set(entries), set(entries)
    for _ in range(DEPTH):
        for r in near.where(F.col("source").isin(sorted(front))).orderBy("source", "nth").collect():
            calls.setdefault(r["source"], []).append(r["target"])
        front = {t for s in front for t in calls.get(s, [])} - known
        known |= front
    named = {r["id"]: f"`{r['name']}()` ({r['file']}:L{r['line_start']})" for r in selected.where(F.col("id").isin(sorted(known))).select("id", "name", "file", "line_start").collect()}
    tokens = counter(path)
    lines, seen, left = [FLOW], set(), budget - tokens(FLOW)
    todo = [(e, 0) for e in reversed(entries)]
    while todo:
        node, depth = todo.pop()
        if node in seen or depth > DEPTH:
            continue
        line = "  " * depth + "- " + named[node]
        left -= tokens(line + "\n")
        if left < 0:
            break
        lines.append(line)
        seen.add(node)
        todo += [(t, depth + 1) for t in reversed(calls.get(node, []))]
    return "\n".join(lines) if len(lines) > 1 else ""


def visual(nodes: DataFrame, edges: DataFrame, highlighted: DataFrame) -> DataFrame:
    """(id, degree, size, label, highlighted) for drawing: hubs are larger, isolated nodes small, highlighted ones never small."""
    ends = materialize(edges.select(F.col("source").alias("id")).union(edges.select("target")).groupBy("id").agg(F.count("*").alias("degree")), "degrees")
    top = ends.agg(F.coalesce(F.max("degree"), F.lit(1)).alias("top"))
    lit = highlighted.select("id").distinct().withColumn("highlighted", F.lit(True))
    rows = nodes.select("id", "name", "file").join(ends, "id", "left").join(lit, "id", "left").crossJoin(F.broadcast(top))
    rows = rows.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).withColumn("highlighted", F.coalesce("highlighted", F.lit(False)))
    size = F.when(F.col("degree") > 0, 9 + 16 * (F.col("degree") / F.col("top"))).otherwise(7.0)
    name = F.when(F.length("name") < 22, F.col("name")).otherwise(F.concat(F.substring("name", 1, 19), F.lit("…")))
    label = F.concat(name, F.lit("\n"), F.element_at(F.split("file", "/", -1), -1))
    return rows.select("id", "degree", F.when(F.col("highlighted"), F.greatest(size, F.lit(28.0))).otherwise(size).alias("size"), label.alias("label"), "highlighted")
