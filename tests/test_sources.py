from pyspark.sql import functions as F

from graphloom.functions import tokens
from graphloom.sources import code, store
from graphloom.streaming import watch
from graphloom.streaming.changes import LiveGraph

PYTHON = "import utils\nLIMIT = 3\n_PRIVATE = 1\n\n\nclass App:\n    def start(self):\n        return run()\n\n\ndef run():\n    return helper(LIMIT)\n"
UTILS = "def helper(x):\n    return x\n"
SCRIPT = "const NAME = 'x';\nconst Button = (p) => {\n  return handler(p);\n};\nfunction handler(a) {\n  return a;\n}\nclass Server {\n  start() {\n    return handler(1);\n  }\n}\n"


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_scan_parse_resolve(spark, tmp_path):
    write(tmp_path, main_dot_py=PYTHON, utils_dot_py=UTILS, index_dot_js=SCRIPT, node_modules__lib_dot_js="function no() {}", app_dot_min_dot_js="x", README_dot_md="#", bad_dot_py="def (")
    files = code.scan(spark, str(tmp_path))
    assert {r["file"] for r in files.collect()} == {"main.py", "utils.py", "index.js", "bad.py"}
    nodes, edges = code.graph_of(code.parse(files))
    got = {(r["type"], r["name"]) for r in nodes.collect()}
    assert {("function", "run"), ("function", "helper"), ("class", "App"), ("constant", "LIMIT"), ("function", "handler"), ("function", "Button"), ("class", "Server"), ("method", "start"), ("constant", "NAME")} <= got
    assert ("constant", "_PRIVATE") not in got and ("constant", "Button") not in got
    links = {(r["source"].split(":")[-2], r["target"].split(":")[-2], r["type"]) for r in edges.collect() if r["type"] == "calls"}
    assert {("run", "helper", "calls"), ("start", "run", "calls"), ("Button", "handler", "calls"), ("start", "handler", "calls")} <= links
    assert {(r["source"], r["target"]) for r in edges.where("type = 'imports'").collect()} == {("file:main.py", "file:utils.py")}
    assert len(code.fingerprint(spark, str(tmp_path))) == 16


def test_updates_equal_a_full_parse(spark, tmp_path):
    live = LiveGraph(spark, str(tmp_path))
    first = spark.createDataFrame([("a.py", "python", "def f():\n    return g()\n"), ("b.py", "python", "def g():\n    return 1\n")], "file string, lang string, text string")
    live.reset(first)
    change = spark.createDataFrame([("b.py", "python", "def g():\n    return 2\n\n\ndef h():\n    return g()\n", False, 2), ("b.py", "python", "old", False, 1), ("c.py", "python", None, True, 1)], "file string, lang string, text string, deleted boolean, at int")
    live.apply(change, 0)
    full = code.graph_of(code.parse(first.where("file = 'a.py'").union(change.where("at = 2").select("file", "lang", "text"))))
    for mine, whole in zip(live.graph(), full):
        assert sorted(map(str, mine.collect())) == sorted(map(str, whole.collect()))


def test_tokens(spark):
    df = spark.createDataFrame([("word " * 50,), ("",), (None,), ("Hello world",)], "t string")
    rows = df.select(tokens.compress(F.col("t"), 10).alias("c")).collect()
    assert rows[0]["c"]["compressed_tokens"] <= 10 and 0 < rows[0]["c"]["ratio"] < 1
    assert rows[1]["c"]["ratio"] == 0.0 and rows[3]["c"]["ratio"] == 1.0


def test_watch_sees_edits_and_deletions(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, a_dot_py="def f():\n    return g()\n", b_dot_py="def g():\n    return 1\n")
    live = LiveGraph(spark, str(tmp_path / "graph"))
    w = watch.Watch(spark, str(root), live, str(tmp_path / "list"))
    assert w.tick() == 2 and w.tick() == 0
    (root / "b.py").unlink()
    write(root, a_dot_py="def f():\n    return 22\n", sub__c_dot_py="def h():\n    return f()\n")
    assert w.tick() == 3
    nodes, edges = live.graph()
    assert {r["name"] for r in nodes.where("type = 'function'").collect()} == {"f", "h"}
    assert {(r["source"], r["target"]) for r in edges.where("type = 'calls'").collect()} == {("function:sub/c.py:h:0", "function:a.py:f:0")}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", None)], "id string, text string")
    key = s.key("root", "policy")
    assert s.get("query", key) is None
    assert s.get_or("query", key, lambda: rows).count() == 3 and s.get("query", key).count() == 3
    assert store.Store(spark, str(tmp_path), {"query": 0}).get("query", key) is None
    for _ in range(2):
        got = {r["id"]: r["vector"] for r in store.vectors(s, rows, "size", lambda ts: [[float(len(t))] for t in ts]).collect()}
        assert got == {"1": [1.0], "2": [1.0], "3": [0.0]}
    assert s.stats()["entries"] == 2 and s.stats()["bytes"] > 0
    assert s.clear("unknown") == 0 and s.clear() == 2 and s.stats()["entries"] == 0


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "b", "type": "file", "name": "b"}, {"id": "a", "type": "file", "name": "a"}],\n "edges": [{"source": "a", "target": "b", "type": "calls"}], "metadata": {"root": "/x"}}')
    nodes, edges = store.read_graph(spark, str(tmp_path / "g.json"))
    assert [(r["id"], r["seq"]) for r in nodes.orderBy("seq").collect()] == [("b", 0), ("a", 1)] and edges.count() == 1
    store.write_graph(nodes, edges, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "nodes")).count() == 2
