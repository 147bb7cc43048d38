"""Front doors: a code base as a graph that is found or made once, questions about it, and what becomes of it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scrub
from graphloom.functions.text import has_content
from graphloom.functions.tokens import TOKENIZER, compress, count_tokens, counter
from graphloom.operators import graph, picture, render, retrieval
from graphloom.operators import savings as saved
from graphloom.runtime import materialize
from graphloom.sources import code
from graphloom.sources.files import Files, checked_folder, is_code_folder
from graphloom.sources.store import Store, export_graph, vectors
from graphloom.streaming.changes import LiveGraph

#: Stands above an answer.
NOTE = "> Complete source for the question, every line with its number: cite `file:line` from here; nothing has to be read again.\n\n"
Encoder = Callable[[list[str]], list[list[float]]]


class Workspace:
    """A code base, its graph, and a session of questions.

    The graph is that of `live` if one is kept, else the stored one of the
    tree's present state, else it is parsed and stored. With a registry of
    patterns, stored content is scrubbed; results depend on the registry's key.
    With an encoder (a function of texts, of unit vectors) questions also use
    closeness of vectors, each text encoded once.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, live: LiveGraph | None = None, registry: scrub.Registry | None = None, encoder: Encoder | None = None, model: str = "encoder", path: str = TOKENIZER, store: Store | None = None):
        self.spark, self.root, self.live, self.registry, self.encoder, self.model, self.path = spark, checked_folder(spark, root), live, registry, encoder, model, path
        self.folder = folder.rstrip("/")
        self.store = store or Store(spark, f"{self.folder}/store")
        self._session: retrieval.Session | None = None
        self._key: str | None = None

    # ---- the graph ----

    def key(self) -> str:
        """What the graph depends on: the tree's paths and times of change, and what is scrubbed."""
        state = f"live:{self.live.version}" if self.live and self.live.version else code.fingerprint(self.spark, self.root)
        return Store.key(self.root, state, self.registry.key() if self.registry else "")

    def _scrubbed(self, nodes: DataFrame) -> DataFrame:
        return scrub.scrub_content(nodes, self.registry) if self.registry else nodes

    def _keep(self, key: str, found: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
        return self.store.put("graph", key + "-nodes", self._scrubbed(found[0])), self.store.put("graph", key + "-edges", found[1])

    def graph(self) -> tuple[DataFrame, DataFrame, str]:
        """Nodes, edges, and where they are from: live, stored or parsed."""
        key = self.key()
        nodes, edges = self.store.get("graph", key + "-nodes"), self.store.get("graph", key + "-edges")
        if nodes is not None and edges is not None:
            return nodes, edges, "live" if self.live and self.live.version else "stored"
        if self.live and self.live.version:
            return *self._keep(key, self.live.graph()), "live"
        return *self._keep(key, code.graph_of(materialize(code.parse(code.scan(self.spark, self.root), self.path), "parsed"))), "parsed"

    def reset(self) -> dict:
        """Parses the whole tree again, and lets a live graph start over from it."""
        files = materialize(code.scan(self.spark, self.root), "scanned")
        if self.live:
            self.live.reset(files)
        self.store.clear("graph")
        nodes, edges = self._keep(self.key(), code.graph_of(materialize(code.parse(files, self.path), "parsed")))
        self._session = None
        return {"reset": True, "total_nodes": nodes.count(), "total_edges": edges.count(), "graph_path": self.export(nodes, edges)}

    def export(self, nodes: DataFrame, edges: DataFrame) -> str:
        """The graph as one JSON file in the workspace's folder, never in the tree."""
        return export_graph(nodes, edges, self.root, self.folder, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))

    def stats(self) -> dict:
        nodes, edges, source = self.graph()
        count = lambda rows: {r["type"]: r["count"] for r in rows.groupBy("type").count().orderBy("type").collect()}
        of_nodes, of_edges = count(nodes), count(edges)
        return {"root": self.root, "source": source, "code": is_code_folder(self.spark, self.root), "total_nodes": sum(of_nodes.values()), "total_edges": sum(of_edges.values()), "node_types": of_nodes, "edge_types": of_edges}

    def index(self) -> dict:
        """Makes what questions need: the graph and, with an encoder, all vectors."""
        began = time.time()
        nodes, edges, _ = self.graph()
        out = {"root": self.root, "nodes": nodes.count(), "edges": edges.count(), "parse_s": round(time.time() - began, 1)}
        began = time.time()
        embedded = self._vectors(nodes).count() if self.encoder else 0
        return {**out, "embedded": embedded, "embed_s": round(time.time() - began, 1)}

    def _vectors(self, nodes: DataFrame) -> DataFrame:
        rows = nodes.where(has_content(F.col("type"), F.col("content"))).select("id", F.concat_ws("\n", "name", F.coalesce("content", F.lit(""))).alias("text"))
        return materialize(vectors(self.store, rows, self.model, self.encoder), "vectors")

    # ---- questions ----

    def session(self) -> retrieval.Session:
        """Of the present graph; ids that were returned stay known when it changes."""
        key = self.key()
        if self._session is None or key != self._key:
            nodes, edges, _ = self.graph()
            known = self._session.returned if self._session else []
            self._session, self._key = retrieval.Session(nodes, edges, self.path), self.key()
            self._session.returned = known
        return self._session

    def ask(self, question: str, budget: int = 0) -> dict:
        """The answer as text, with its measures and what it saves."""
        session = self.session()
        extra = {"vectors": self._vectors(session.nodes), "asked": self.encoder([question])[0]} if self.encoder else {}
        found = session.ask(question, budget, **extra)
        text = answer_text(found, session.nodes, session.edges, self.path)
        count = counter(self.path)
        sent = count(text)
        whole = self._saved(found, sent)
        stats = {"selected_nodes": found.selected.count(), "neighbor_nodes": found.dependencies.count(), "tokens_sent": sent, "budget": budget, "budget_mode": "explicit" if budget else "unlimited", "method": found.method, "confidence": round(found.confidence, 4), "confidence_label": found.label}
        return {"question": question, "optimized_context": text + whole.pop("footer"), "stats": stats, "savings": whole, "answer": found}

    def _saved(self, found: retrieval.Answer, sent: int) -> dict:
        """Against the whole files of the selected nodes, as they stand in the tree."""
        files = found.selected.select("file").distinct()
        texts = code.scan(self.spark, self.root).join(files, "file", "left_semi")
        counts = materialize(texts.select("file", count_tokens(F.col("text"), self.path).alias("tokens")), "file-tokens")
        one = self.spark.range(1, numPartitions=1).select(F.lit(sent).cast("long").alias("sent"))
        row = saved.savings(files, counts, one).select("*", saved.summary(F.col("baseline"), F.col("sent"), F.col("files_counted"), F.col("reduction_pct")).alias("summary"), saved.footer(F.col("baseline"), F.col("sent"), F.col("reduction_pct")).alias("footer")).first()
        return {"tokens_sent": sent, "baseline_full_files_tokens": row["baseline"], "files_counted": row["files_counted"], "tokens_saved": row["saved"], "reduction_pct": row["reduction_pct"], "potential": True, "summary": row["summary"], "footer": row["footer"]}

    def ask_kept(self, question: str, budget: int = 0) -> str:
        """The answer's text without a session's memory; kept by graph, question and budget."""
        nodes, edges, _ = self.graph()
        return self.store.text_or("query", Store.key(self.key(), question, budget), lambda: answer_text(retrieval.answer(nodes, edges, question, budget, path=self.path), nodes, edges, self.path))

    def ask_all(self, questions: list[str], budget: int = 0) -> dict:
        """One graph, many questions, in order: none repeats what another returned. A question that fails costs its own answer."""
        if not questions:
            raise ValueError("no questions")
        results = []
        for q in questions:
            try:
                a = self.ask(q, budget)
                results.append({"question": q, "optimized_context": a["optimized_context"], **{k: a["stats"][k] for k in ("tokens_sent", "selected_nodes", "confidence")}})
            except Exception as e:  # one question's failure is reported with it
                results.append({"question": q, "error": str(e)})
        return {"graph_stats": {k: v for k, v in self.stats().items() if k.startswith("total_")}, "results": results}

    def structured(self, question: str, budget: int = 0, output: str = "json", supporting: int = 20) -> dict:
        """The answer with the nodes that score best, or as text alone (output: markdown)."""
        a = self.ask(question, budget)
        session = self.session()
        sizes = {"total_nodes": session.nodes.count(), "total_edges": session.edges.count()}
        if output != "json":
            return {"optimized_context": a["optimized_context"], "graph_stats": sizes, "stats": a["stats"]}
        extra = (self._vectors(session.nodes), self.encoder([question])[0]) if self.encoder else (None, None)
        scores = retrieval.node_scores(session.nodes, session.edges, question, *extra)
        best = scores.where("blended > 0").join(session.nodes, "id").orderBy(F.desc("blended"), "id").limit(supporting)
        lines = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
        rows = best.select("id", "name", "type", "file", lines.alias("lines"), F.round("blended", 4).alias("relevance_score"), F.substring(F.coalesce("content", F.lit("")), 1, 200).alias("content_snippet"))
        return {"question": question, "answer": a["optimized_context"], "supporting_nodes": [r.asDict() for r in rows.collect()], "graph_stats": sizes, "stats": a["stats"]}

    def stream(self, question: str, budget: int = 0, batch: int = 50) -> Iterator[dict]:
        """Events of a question: parsing, batch by batch where the graph isn't known, then the selection."""
        yield {"stage": "parsing", "status": "started"}
        key = self.key()
        if self.store.get("graph", key + "-nodes") is None and not (self.live and self.live.version):
            for event in code.parse_in_batches(code.scan(self.spark, self.root), batch, self.path):
                found = event.pop("graph", None)
                if found is not None:
                    self._keep(key, found)
                yield event
        nodes, edges, source = self.graph()
        yield {"stage": "parsing", "status": "done", "source": source, "total_nodes": nodes.count(), "total_edges": edges.count()}
        yield {"stage": "select", "status": "started"}
        try:
            a = self.ask(question, budget)
        except Exception as e:  # the stream tells of a failure as its last event
            yield {"stage": "select", "status": "error", "error": str(e)}
            return
        yield {"stage": "select", "status": "done", "optimized_context": a["optimized_context"], **{k: a["stats"][k] for k in ("tokens_sent", "selected_nodes", "confidence")}}

    def compressed(self, context: str, target: int = 500, rate: float | None = None, model: Callable | None = None, name: str = "") -> dict:
        """A context brought to a budget; kept by the context, the target, the rate and the model's name."""

        def make() -> DataFrame:
            return self.spark.createDataFrame([(context,)], "text string").select(compress(F.col("text"), target, self.path, model, rate).alias("c")).select("c.*")

        return self.store.get_or("compress", Store.key(context, target, rate, name), make).first().asDict()

    def ask_model(self, question: str, model: Callable[[str], str], budget: int = 0) -> dict:
        """A language model's answer from the code; the model is the caller's function of a prompt."""
        a = self.ask(question, budget)
        return {**a, "reply": model(f"Answer from this code only, and cite file:line.\n\n{a['optimized_context']}\n\nQuestion: {question}\n")}

    # ---- pictures and differences ----

    def highlighted(self, question: str) -> DataFrame:
        nodes, edges, _ = self.graph()
        return retrieval.highlighted(materialize(retrieval.node_scores(nodes, edges, question).select("id", F.col("blended").alias("score")), "highlight"))

    def show(self, question: str = "") -> dict:
        """Writes the graph as a page, with the nodes that a question is about highlighted."""
        nodes, edges, source = self.graph()
        lit = self.highlighted(question).select("id") if question else nodes.select("id").limit(0)
        path = picture.write_page(nodes, edges, lit, f"{self.folder}/graph.html", self.root)
        return {"graph_html_path": path, "source": source, "highlighted_nodes": lit.count()}


def answer_text(found: retrieval.Answer, nodes: DataFrame, edges: DataFrame, path: str = TOKENIZER) -> str:
    """Note, map, call chains of what was selected and named by it, then the code with its dependencies."""
    lines = [r["line"] for r in render.map_lines(nodes, path=path).orderBy("place").toLocalIterator()]
    needed = found.dependencies.select("id", (F.lit(1 << 40) + F.col("position")).alias("rank")).join(nodes, "id").select("id", "name", "file", "line_start", "rank")
    shown = found.selected.select("id", "name", "file", "line_start", F.col("rank").cast("long").alias("rank")).unionByName(needed)
    ordered = edges if "seq" in edges.columns else edges.withColumn("seq", F.struct("source", "target", "type"))
    flow = render.flow_trace(materialize(shown, "shown"), ordered, path=path)
    map_text = render.MAP + "\n".join(lines) + "\n" if lines else ""
    return NOTE + map_text + ("\n" + flow if flow else "") + "\n\n---\n\n" + found.text()


def compare(spark: SparkSession, a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], most: int = 1_000) -> dict:
    """Two graphs' differences as lists of at most `most` rows each, their sizes, and one line on all of them."""
    d = graph.diff(a, b)
    out = {f"nodes_{c}": [r.asDict() for r in d.listed(c).limit(most).collect()] for c in ("added", "removed", "modified")}
    out |= {f"edges_{c}": [r.asDict() for r in d.linked(c).limit(most).collect()] for c in ("added", "removed")}
    return {**out, "stats": d.sizes, "summary": d.summary()}


def scrub_file(spark: SparkSession, path: str, out: str, registry: scrub.Registry | None = None) -> dict:
    """A file scrubbed into another place, and what was found in it."""
    if out.rstrip("/") == path.rstrip("/"):
        raise ValueError("the scrubbed text goes to another place")
    folder, name = path.rsplit("/", 1)
    rows = spark.createDataFrame([(Files(spark, folder).read(name),)], "text string")
    row = rows.select(scrub.scrubbed(F.col("text"), registry).alias("scrubbed"), scrub.findings(F.col("text"), registry).alias("found")).first()
    to, as_ = out.rsplit("/", 1)
    Files(spark, to).write(row["scrubbed"], as_)
    return {"path": out, "count": len(row["found"]), "findings": [f.asDict() for f in row["found"]]}
