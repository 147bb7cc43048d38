import pytest

from graphloom.operators import graph, render, retrieval

NODE = "id string, type string, name string, file string, line_start int, line_end int, content string, seq long"
ROWS = [
    ("file:auth.py", "file", "auth.py", "auth.py", 1, 60, "", 0),
    ("f:auth.py:login:1", "function", "login", "auth.py", 1, 10, "def login(user):\n    token = authenticate(user, MODEL_NAME)\n    return create_session(token)", 1),
    ("f:auth.py:authenticate:12", "function", "authenticate", "auth.py", 12, 20, "def authenticate(user, kind):\n    return user.check(kind)", 2),
    ("f:auth.py:create_session:22", "function", "create_session", "auth.py", 22, 30, "def create_session(token):\n    return Session(token)", 3),
    ("c:conf.py:MODEL_NAME:1", "constant", "MODEL_NAME", "conf.py", 1, 1, "MODEL_NAME = 'small'", 4),
    ("f:tests/test_auth.py:test_login:1", "function", "test_login", "tests/test_auth.py", 1, 3, "def test_login():\n    assert login('user')", 5),
    ("f:paint.py:stroke:1", "function", "stroke", "paint.py", 1, 2, "def stroke(colour):\n    return colour", 6),
    ("f:paint.py:fill:4", "function", "fill", "paint.py", 4, 5, "def fill(colour):\n    return colour", 7),
    ("f:paint.py:blur:7", "function", "blur", "paint.py", 7, 8, "def blur(radius):\n    return radius", 8),
]
EDGES = [("f:auth.py:login:1", "f:auth.py:authenticate:12", "calls", 0), ("f:auth.py:login:1", "f:auth.py:create_session:22", "calls", 1), ("f:tests/test_auth.py:test_login:1", "f:auth.py:login:1", "calls", 2)]


@pytest.fixture(scope="module")
def world(spark):
    return spark.createDataFrame(ROWS, NODE), spark.createDataFrame(EDGES, "source string, target string, type string, seq long")


def test_answer(world):
    found = retrieval.answer(*world, "how does login authenticate a user")
    ids = [r["id"] for r in found.selected.orderBy("rank").collect()]
    assert ids[0] == "f:auth.py:login:1" and not any("tests/" in i or "paint" in i for i in ids)
    assert "c:conf.py:MODEL_NAME:1" in {r["id"] for r in found.dependencies.collect()}
    text = found.text()
    assert "1: def login(user):" in text and "- `MODEL_NAME = 'small'` (conf.py:1)" in text
    assert found.label in ("low", "medium", "high") and len(found.top()) <= 10


def test_session_returns_the_next_nodes(world):
    s = retrieval.Session(*world)
    first, second = s.ask_all(["login user", "login user"], 400)
    a, b = ({r["id"] for r in x.selected.collect()} for x in (first, second))
    assert a and not a & b
    assert len(s.returned) == len(set(s.returned))


def test_guards(world):
    nodes, _ = world
    assert retrieval.without(nodes, nodes).count() == len(ROWS)
    assert retrieval.without_tests(nodes, "where is login").count() == len(ROWS) - 1
    assert retrieval.without_tests(nodes, "where is the test").count() == len(ROWS)


def test_flow_and_map(world):
    nodes, edges = world
    ranked = nodes.where("type = 'function'").withColumn("rank", nodes["seq"])
    lines = render.flow_trace(ranked, edges).split("\n")[2:]
    assert [x.split("`")[1] for x in lines] == ["test_login()", "login()", "authenticate()", "create_session()"]
    assert lines[2].startswith("    - ")
    assert render.flow_trace(ranked.limit(1), edges) == ""
    assert len(render.map_lines(nodes).collect()) == 8
    assert render.map_lines(nodes, 5).count() == 0


def test_pieces_stop_at_the_budget(world):
    ranked = world[0].where("type = 'function'").withColumn("rank", world[0]["seq"])
    every = [r["piece"] for r in render.code_pieces(ranked).orderBy("place").collect()]
    some = [r["piece"] for r in render.code_pieces(ranked, 60).orderBy("place").collect()]
    assert len(every) == 10 and every[: len(some)] == some and 2 <= len(some) < 10
    assert len(render.code_pieces(ranked, 1).collect()) == 2


def test_import_prefixes(spark):
    files = spark.createDataFrame([("a", "utils.py", 2), ("b", "utility.py", 1), ("c", "x.py", 3)], "id string, name string, seq int")
    asked = spark.createDataFrame([("s", "pkg.util"), ("s", "gone"), ("s", "end.")], "source string, import_name string")
    assert {(r["import_name"], r["target"]) for r in graph.resolve_import_prefixes(asked, files).collect()} == {("pkg.util", "b"), ("end.", "b")}


def test_visual(world):
    nodes, edges = world
    got = {r["id"]: r for r in render.visual(nodes, edges, nodes.limit(1)).collect()}
    assert got["f:auth.py:login:1"]["size"] == 25.0 and got["f:paint.py:fill:4"]["size"] == 7.0 and got["file:auth.py"]["size"] == 28.0
