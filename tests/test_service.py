import json

import pytest
from pyspark.sql import functions as F

from graphloom import service
from graphloom.functions import scrub, tokens
from graphloom.operators import savings
from graphloom.sources import code, files, store
from graphloom.streaming import watch
from graphloom.streaming.changes import LiveGraph

AUTH = 'LIMIT = 3\n\n\ndef login(user):\n    """Lets a user in."""\n    token = authenticate(user, LIMIT)\n    return create_session(token)\n\n\ndef authenticate(user, kind):\n    return user.check(kind)\n\n\ndef create_session(token):\n    return Session(token)\n\n\nclass Session:\n    def __init__(self, token):\n        self.token = token\n'
PAINT = "def stroke(colour):\n    return colour\n\n\ndef fill(colour):\n    return colour\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "auth.py").write_text(AUTH)
    (root / "paint.py").write_text(PAINT)
    (root / "go.mod").write_text("")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("function no() {}")
    return root


def test_questions(spark, tree, tmp_path):
    w = service.Workspace(spark, str(tree), str(tmp_path))
    first = w.ask("how does login authenticate a user")
    text = first["optimized_context"]
    assert text.startswith(service.NOTE) and "## Codebase map" in text and "`login()`" in text and "4: def login(user):" in text
    assert "- `login` (auth.py:L4) — Lets a user in." in text and text.index("---") < text.index("## Relevant code")
    assert first["stats"]["confidence_label"] in ("low", "medium", "high") and first["savings"]["files_counted"] >= 1
    count = tokens.counter()
    assert first["savings"]["baseline_full_files_tokens"] >= count(AUTH) and "tokens" in first["savings"]["summary"]
    again = w.ask("how does login authenticate a user")
    a, b = ({r["id"] for r in x["answer"].selected.collect()} for x in (first, again))
    assert a and not a & b
    both = w.ask_all(["stroke colour", "fill colour"], 400)
    assert [r["question"] for r in both["results"]] == ["stroke colour", "fill colour"] and both["graph_stats"]["total_nodes"] == w.stats()["total_nodes"]
    with pytest.raises(ValueError):
        w.ask_all([])
    kept = w.ask_kept("login user")
    hits = w.store.hits
    assert w.ask_kept("login user") == kept and w.store.hits > hits


def test_structured_stream_and_index(spark, tree, tmp_path):
    w = service.Workspace(spark, str(tree), str(tmp_path), encoder=lambda ts: [[1.0, 0.0] if "login" in t else [0.0, 1.0] for t in ts])
    events = list(w.stream("login user", batch=1))
    assert [e["stage"] for e in events] == ["parsing", "parsing", "parsing", "done", "parsing", "select", "select"]
    assert [e["nodes_so_far"] for e in events if "nodes_so_far" in e] == [7, 10, 10] and events[2]["progress"] == 1.0 and events[-1]["status"] == "done"
    out = w.structured("login user")
    assert out["supporting_nodes"][0]["name"] == "login" and out["supporting_nodes"][0]["lines"] == "4-7" and out["graph_stats"]["total_nodes"] == 10
    assert set(w.structured("login user", output="markdown")) == {"optimized_context", "graph_stats", "stats"}
    made = w.index()
    assert made["nodes"] == 10 and made["embedded"] == 8
    stats = w.stats()
    assert stats["source"] == "stored" and stats["code"] and stats["node_types"] == {"class": 1, "constant": 1, "file": 2, "function": 6}
    assert w.ask_model("login", lambda prompt: f"{len(prompt) > 100}")["reply"] == "True"


def test_reset_export_show_and_scrub(spark, tree, tmp_path):
    registry = scrub.Registry()
    registry.add("colour", "colour")
    w = service.Workspace(spark, str(tree), str(tmp_path / "w"), registry=registry)
    assert "colour" not in "".join(r["content"] for r in w.graph()[0].collect()) and w.graph()[2] == "stored"
    done = w.reset()
    nodes, edges = store.read_graph(spark, done["graph_path"])
    assert nodes.count() == done["total_nodes"] == 10 and edges.count() == done["total_edges"]
    assert json.loads(open(done["graph_path"]).read())["metadata"]["total_nodes"] == 10 and not list(tree.glob("*.json"))
    page = open(w.show("login user")["graph_html_path"]).read()
    assert "login" in page and '"highlighted": true' in page
    (tmp_path / "a.txt").write_text("mail a@b.co now")
    out = service.scrub_file(spark, str(tmp_path / "a.txt"), str(tmp_path / "out" / "b.txt"))
    assert out["count"] == 1 and (tmp_path / "out" / "b.txt").read_text() == "mail [REDACTED_EMAIL] now"
    with pytest.raises(ValueError):
        service.scrub_file(spark, str(tmp_path / "a.txt"), str(tmp_path / "a.txt"))
    with pytest.raises(ValueError, match="not a directory"):
        service.Workspace(spark, str(tmp_path / "none"), str(tmp_path))
    assert files.is_code_folder(spark, str(tree)) and not files.is_code_folder(spark, str(tmp_path))


def test_compare(spark):
    schema = "id string, name string, type string, file string, line_start int, line_end int, content string"
    one = spark.createDataFrame([("a", "a", "function", "x", 1, 2, "1")], schema)
    edges = spark.createDataFrame([("a", "a", "calls")], "source string, target string, type string")
    out = service.compare(spark, (one, edges), (one.withColumn("content", F.lit("2")), edges.limit(0)))
    assert out["nodes_modified"] == [{"id": "a", "name": "a", "type": "function", "file": "x", "line_start": 1, "line_end": 2}]
    assert out["summary"] == "1 nodes modified across 1 file(s); 1 edges removed" and out["stats"]["graph_b"] == {"nodes": 1, "edges": 0}


def test_savings(spark):
    selected = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "gone"), (2, "gone")], "q int, file string")
    whole = spark.createDataFrame([("a", 700), ("b", 300), ("c", 5)], "file string, tokens long")
    sent = spark.createDataFrame([(1, 123), (2, 9), (3, 1)], "q int, sent long")
    out = savings.savings(selected, whole, sent, ["q"])
    got = {r["q"]: (r["baseline"], r["files_counted"], r["saved"], r["reduction_pct"]) for r in out.collect()}
    assert got == {1: (1000, 2, 877, 87.7), 2: (0, 0, 0, 0.0), 3: (0, 0, 0, 0.0)}
    told = {r["q"]: (r["s"], r["f"]) for r in out.select("q", savings.summary(F.col("baseline"), F.col("sent"), F.col("files_counted"), F.col("reduction_pct")).alias("s"), savings.footer(F.col("baseline"), F.col("sent"), F.col("reduction_pct")).alias("f")).collect()}
    assert "87.7%" in told[1][0] and "~1000 → 123" in told[1][1] and told[2] == ("No files to compare with.", "")


def test_compression_with_a_model(spark, tree, tmp_path):
    rates = []

    def halved(texts, asked):
        assert all(0.1 <= r <= 1 for r in asked)
        return [" ".join(t.split()[::2]) for t in texts]

    df = spark.createDataFrame([("word " * 60,), ("short one",), ("",), (None,)], "t string")
    rows = df.select(tokens.compress(F.col("t"), 40, model=halved).alias("c")).collect()
    assert rows[0]["c"]["compressed"].startswith("word word") and rows[0]["c"]["compressed_tokens"] <= 40 and rows[0]["c"]["original_tokens"] > 55
    assert rows[1]["c"]["compressed"] == "short one" and rows[2]["c"]["ratio"] == rows[3]["c"]["ratio"] == 0.0

    def broken(texts, asked):
        raise RuntimeError("no model")

    assert df.select(tokens.compress(F.col("t"), 10, model=broken).alias("c")).collect()[0]["c"]["compressed_tokens"] <= 10
    assert tokens.device() == "cpu" and tokens.device(cuda=True) == "cuda" and tokens.device(mps=True) == "mps" and tokens.device("cpu", cuda=True) == "cpu"
    assert tokens.model_name("cuda", {"cuda": "big", "default": "small"}) == "big" and tokens.model_name("cpu", {"default": "small"}) == "small" and tokens.model_name("cpu", {}, "own") == "own"
    w = service.Workspace(spark, str(tree), str(tmp_path))
    first = w.compressed("word " * 60, 10)
    assert w.compressed("word " * 60, 10) == first and first["compressed_tokens"] <= 10 and not rates


def test_live_graph_goes_on_after_a_restart_and_guards_resets(spark, tmp_path):
    schema = "file string, lang string, text string, deleted boolean, at int"
    change = lambda name, text, at: spark.createDataFrame([(name, "python", text, text is None, at)], schema)
    live = LiveGraph(spark, str(tmp_path))
    assert live.apply(change("a.py", "def f(): return g()", 1), 0) and live.apply(change("b.py", "def g(): return 1", 1), 1)
    again = LiveGraph(spark, str(tmp_path))  # a driver that starts again
    assert not again.apply(change("b.py", "def lost(): pass", 1), 1)  # replayed by the stream
    assert again.apply(change("c.py", "def h(): return f()", 2), 2)
    names = lambda g: {r["name"] for r in g.graph()[0].where("type = 'function'").collect()}
    assert names(again) == {"f", "g", "h"} == names(live) and again.graph()[1].where("type = 'calls'").count() == 2
    before = again.state()["generation"]
    tree = spark.createDataFrame([("z.py", "python", "def z(): pass")], "file string, lang string, text string")
    stale = again.parsed()
    again.reset(tree)
    assert not live._publish(stale, before, 3)  # began before the reset
    assert names(live) == {"z"} and live.state()["generation"] == before + 1
    assert len([n for n in live.files.names() if n.startswith("v-")]) <= 2


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("def f(): pass\n")
    live = LiveGraph(spark, str(tmp_path / "graph"))
    assert watch.Watch(spark, str(root), live, str(tmp_path / "list")).tick() == 1
    w = watch.Watch(spark, str(root), LiveGraph(spark, str(tmp_path / "graph")), str(tmp_path / "list"))
    assert w.tick() == 0
    (root / "b.py").write_text("def g(): f()\n")
    assert w.tick() == 1 and w.live.graph()[1].where("type = 'calls'").count() == 1


def test_store_bound(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), bound=1)
    rows = spark.range(10)
    s.put("query", "a", rows)
    assert s.get("query", "a") is not None  # the entry just written stays
    s.put("query", "b", rows)
    assert s.get("query", "a") is None and s.get("query", "b") is not None and s.stats()["entries"] == 1


def test_progress(spark):
    parsed = code.parse(spark.createDataFrame([("%03d.py" % i, "python", "def f(): pass\n" * (i % 3)) for i in range(7)], "file string, lang string, text string"))
    got = [(r["batch"], r["files_parsed"], r["nodes_so_far"], round(r["progress"], 3)) for r in code.progress(parsed, 3).orderBy("batch").collect()]
    assert got == [(0, 3, 6, 0.429), (1, 6, 12, 0.857), (2, 7, 13, 1.0)]
