"""A question over a graph: signals, fusion, eligibility, selection, referenced definitions, and sessions of questions.

Nodes are (id, type, name, file, line_start, line_end, content, seq), edges
(source, target, type, and seq where it is known).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import asks_for_tests, has_content, is_test_path, question_words, signature
from graphloom.functions.tokens import TOKENIZER, count_tokens
from graphloom.operators import graph, render, scoring
from graphloom.operators.ordered import running
from graphloom.operators.select import knapsack, select_round_robin
from graphloom.runtime import materialize, small

#: A dependency section takes at most so many tokens and that share of the budget, leaves some free, and has a least size.
DEPENDENCY_TOKENS, DEPENDENCY_SHARE, HEADROOM, DEPENDENCY_LEAST = 300, 0.3, 64, 150
#: So many ids of earlier answers are remembered.
REMEMBERED = 250
UNLIMITED = 1 << 30


def unless_empty(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """kept, or rows where nothing is kept."""
    return rows if kept.isEmpty() else kept


def without(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose id wasn't seen; all rows if that leaves none."""
    return unless_empty(rows.join(seen.select("id"), "id", "left_anti"), rows)


def without_tests(rows: DataFrame, question: str) -> DataFrame:
    """Rows outside test files, unless the question is about tests or nothing else is left."""
    return rows if asks_for_tests(question) else unless_empty(rows.where(~is_test_path(F.col("file"))), rows)


def highlighted(scores: DataFrame, least: int = 10, share: int = 20) -> DataFrame:
    """(id, score) -> the top twentieth of them by score, ten at least, with rank."""
    placed = running(scores, [], [F.desc("score"), "id"])
    return placed.where(F.col("place") <= max(least, scores.count() // share)).withColumnRenamed("place", "rank")


def node_scores(nodes: DataFrame, edges: DataFrame, question: str, vectors: DataFrame | None = None, asked: list[float] | None = None) -> DataFrame:
    """(id, blended) over definitions: rank and word overlap, and closeness of vectors where there are some."""
    defined = materialize(nodes.where("type NOT IN ('file', 'import')"), "definitions")
    wide = defined.select("id").join(graph.pagerank(defined, edges).select("id", F.col("rank").alias("pr")), "id", "left")
    wide = wide.join(scoring.tfidf(defined.select("id", F.col("content").alias("text")), question).select("id", F.col("score").alias("tf")), "id", "left")
    weights = {"pr": 0.15, "tf": 0.25}
    if vectors is not None:
        near = vectors.select("id", scoring.dot(F.col("vector"), F.array(*map(F.lit, asked))).alias("sem"))
        wide, weights = wide.join(near, "id", "left"), {"sem": 0.55, "tf": 0.15, "pr": 0.30}
    return scoring.blend(materialize(wide.na.fill(0.0), "blend"), weights)


def references(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, file, line_start, content, n): definitions by how often the selected contents name them; the first of a name counts."""
    words = selected.select(F.explode(question_words(F.col("content"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    parts = ["id", "file", "line_start", "content"]
    first = nodes.where("type NOT IN ('file', 'import')").groupBy("name").agg(F.min_by(F.struct(*parts), "seq").alias("d"))
    return first.join(words, "name").select("name", "n", *[f"d.{p}" for p in parts])


def dependencies(selected: DataFrame, nodes: DataFrame, cap: int, seen: DataFrame | None = None, path: str = TOKENIZER) -> DataFrame:
    """(id, position, line): definitions that the selected ones name and that aren't among them, most named first, within cap tokens."""
    known = selected.select("id") if seen is None else selected.select("id").union(seen.select("id"))
    line = F.concat(F.lit("- `"), signature(F.col("content")), F.lit("` ("), "file", F.lit(":"), F.col("line_start").cast("string"), F.lit(")"))
    found = references(selected, nodes).join(known, "id", "left_anti").select("id", "name", (-F.col("n")).alias("often"), line.alias("line"))
    found = materialize(found.withColumn("tokens", count_tokens(F.col("line"), path) + 1), "dependencies")
    if cap >= UNLIMITED:
        kept = running(found, [], ["often", "name"]).select("id", (F.col("place") - 1).alias("position"))
    else:
        title = found.sparkSession.range(1, numPartitions=1).select(count_tokens(F.lit(render.DEPENDENCIES), path)).first()[0]
        kept = knapsack(found, [], ["often", "name"], "tokens", max(cap - title, 0))
    return kept.join(found.select("id", "line"), "id")


@dataclass
class Answer:
    """What a question found. DataFrames are written tables; text() is for budgets or answers known to be small."""

    scores: DataFrame
    selected: DataFrame
    pieces: DataFrame
    dependencies: DataFrame
    confidence: float
    label: str
    method: str
    budget: int = 0
    extra: list[str] = field(default_factory=list)

    def top(self, n: int = 10) -> list[dict]:
        return [{"id": r["id"], "score": round(r["score"], 4)} for r in self.scores.orderBy(F.desc("score"), "id").limit(n).collect()]

    def files(self) -> DataFrame:
        return self.selected.select("file").distinct().orderBy("file")

    def supporting(self, n: int = 20) -> DataFrame:
        """The best selected nodes with a positive score and the beginning of their content."""
        return self.selected.where("score > 0").orderBy("rank").limit(n).select("id", "name", "file", "line_start", "line_end", F.round("score", 4).alias("score"), F.substring("content", 1, 200).alias("snippet"))

    def text(self) -> str:
        parts = [r["piece"] for r in self.pieces.orderBy("place").toLocalIterator()]
        if not parts:
            return "## No relevant nodes found\nTry broadening your query."
        lines = [r["line"] for r in self.dependencies.orderBy("position").toLocalIterator()]
        note = f"> Note: the best match was weak ({self.confidence:.2f} by {self.method}).\n\n" if self.label == "low" else ""
        return note + "\n".join([render.CODE, *parts]) + (render.DEPENDENCIES + "\n".join(lines) if lines else "")


def answer(nodes: DataFrame, edges: DataFrame, question: str, budget: int = 0, seen: DataFrame | None = None, vectors: DataFrame | None = None, asked: list[float] | None = None, path: str = TOKENIZER) -> Answer:
    """The nodes that a question is about. budget 0: all of them; otherwise a selection by turns within it.

    vectors: (id, vector) of unit length, asked: the question's. Without them the
    signals are two BM25s and PageRank, and tf-idf measures confidence.
    """
    rows = unless_empty(nodes.where(has_content(F.col("type"), F.col("content"))), nodes)
    rows = materialize(rows if seen is None else without(rows, seen), "population")
    if "seq" not in edges.columns:
        edges = edges.withColumn("seq", F.struct("source", "target", "type"))
    edges = materialize(edges, "edges")
    docs = rows.select("id", F.concat_ws(" ", "name", "file", "content").alias("text"))
    batch = nodes.sparkSession.range(1, numPartitions=1).select(F.lit(0).alias("query_id"), F.lit(question).alias("text"))
    bm25 = rows.select("id").join(scoring.bm25(docs, batch), "id", "left")
    lines = graph.summaries(rows, edges).withColumnRenamed("summary", "text")
    summary = rows.select("id").join(scoring.bm25(lines, batch), "id", "left")
    signals = [("bm25", bm25), ("summary", summary), ("pagerank", graph.pagerank(rows, edges).withColumnRenamed("rank", "score"))]
    if vectors is not None:
        signals.append(("semantic", rows.select("id").join(vectors.select("id", scoring.dot(F.col("vector"), F.array(*map(F.lit, asked))).alias("score")), "id", "left")))
    long = [s.select(F.lit(n).alias("signal"), "id", F.coalesce("score", F.lit(0.0)).alias("score")) for n, s in signals]
    every = long[0]
    for s in long[1:]:
        every = every.union(s)
    every = materialize(every, "signals")
    best = every.where("signal = 'semantic'") if vectors is not None else scoring.tfidf(rows.select("id", F.col("content").alias("text")), question)
    confidence = best.agg(F.max("score")).first()[0] or 0.0
    label = "low" if confidence < (0.05 if vectors is None else 0.15) else "high" if confidence >= 0.5 else "medium"
    fused = scoring.fuse(every).withColumnRenamed("fused", "score").join(rows, "id")
    if not asks_for_tests(question):
        fused = fused.withColumn("score", scoring.penalised(F.col("score"), F.col("file")))
    fused = materialize(fused, "fused")
    chosen = without_tests(fused.join(scoring.eligible(every.where("signal <> 'pagerank'")), "id", "left_semi"), question)
    if budget > 0:
        sized = chosen.withColumn("tokens", count_tokens(F.coalesce("content", F.lit("")), path)).withColumn("directory", F.when(F.col("file").contains("/"), F.regexp_extract("file", "^(.*)/[^/]*$", 1)).otherwise(F.col("file")))
        taken = select_round_robin(sized, budget)
        chosen = chosen.join(taken, "id").withColumn("rank", F.col("position") + 1).drop("position")
    else:
        chosen = running(materialize(chosen, "chosen"), [], [F.desc("score"), "id"]).withColumnRenamed("place", "rank")
    chosen = materialize(chosen, "selected")
    pieces = materialize(render.code_pieces(chosen, budget, path), "answer")
    cap = UNLIMITED
    if budget > 0:
        spent = pieces.select(F.sum(count_tokens(F.col("piece"), path))).first()[0] or 0
        cap = max(DEPENDENCY_LEAST, min(DEPENDENCY_TOKENS, budget - spent - HEADROOM, int(budget * DEPENDENCY_SHARE)))
    needed = materialize(dependencies(chosen, nodes, cap, seen, path), "needed")
    method = "hybrid+map (RRF)" if vectors is not None else "bm25+map+pagerank (RRF)"
    return Answer(fused.select("id", "score"), chosen, pieces, needed, float(confidence), label, method, budget)


class Session:
    """Questions whose answers don't repeat what earlier ones returned. It remembers the last REMEMBERED ids."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, path: str = TOKENIZER):
        self.nodes, self.edges, self.path, self.returned = nodes, edges, path, []

    def ask(self, question: str, budget: int = 0, **vectors) -> Answer:
        spark, seen = self.nodes.sparkSession, None
        if self.returned:
            seen = small(spark.createDataFrame([(i,) for i in self.returned], "id string"))
        found = answer(self.nodes, self.edges, question, budget, seen, path=self.path, **vectors)
        # only the last of them can be remembered, so no more than that leave the cluster
        last = [r["id"] for r in found.selected.orderBy(F.desc("rank")).limit(REMEMBERED).collect()][::-1]
        last += [r["id"] for r in found.dependencies.orderBy(F.desc("position")).limit(REMEMBERED).collect()][::-1]
        self.returned = list(dict.fromkeys([*self.returned, *last]))[-REMEMBERED:]
        return found

    def ask_all(self, questions: list[str], budget: int = 0) -> list[Answer]:
        """In order: each answer leaves out what those before it returned."""
        return [self.ask(q, budget) for q in questions]

    def reset(self) -> None:
        self.returned = []
