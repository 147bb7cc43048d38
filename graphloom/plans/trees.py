"""Queries over source trees made from tables: every customer, supplier, nation and region is a file in one of the languages, and SQL knows what a parse must find."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.runtime import materialize, table
from graphloom.sources import code


@dataclass
class Kind:
    """Files of one kind: where from, their path and text by {k} (own key) and {n} (nation), and the nodes in it.

    nodes: (type, name, content); content is a piece of the text, from whose place the lines follow.
    calls: (node's name, callee) as far as the callee is defined somewhere.
    """

    table: str
    key: str
    nation: str
    where: str
    lang: str
    file: str
    text: str
    nodes: list[tuple[str, str, str]]
    calls: list[tuple[str, str]]


_METHOD = "def total(self):\n        return amount_{k}(self.a) + rate_{n}()"
_AMOUNT = "def amount_{k}(x):\n    return helper(x, LIMIT_{k})"
_CUSTOMER = "class Customer{k}(Base):\n    " + _METHOD
_PAY, _SELL, _RING = "(a) => {\n  return rate_{n}(a);\n}", "sell(a: number): number { return rate_{n}(a); }", "int ring(int a) {\n    return rate_{n}(a);\n  }"
_OPEN = "fn open(&self) -> i32 {\n    rate_{n}(1)\n  }"
_IMPL, _SHIP = "impl Box{k} {\n  " + _OPEN + "\n}", "func Ship{k}(a int) int {\n  return rate_{n}(a)\n}"
KINDS = [
    Kind(
        "customer", "c_custkey", "c_nationkey", "TRUE", "python", "nation_{n}/customer_{k}.py",
        "from nation_{n}.rates import rate_{n}\nimport unknown_{k}\n\nLIMIT_{k} = {k}\n_HIDDEN = 1\n\n\n" + _CUSTOMER + "\n\n\n" + _AMOUNT + "\n",
        [("function", "total", _METHOD), ("function", "amount_{k}", _AMOUNT), ("class", "Customer{k}", _CUSTOMER), ("constant", "LIMIT_{k}", "LIMIT_{k} = {k}")],
        [("total", "amount_{k}"), ("total", "rate_{n}"), ("Customer{k}", "amount_{k}"), ("Customer{k}", "rate_{n}")],
    ),
    Kind("nation", "n_nationkey", "n_nationkey", "TRUE", "python", "nation_{n}/rates.py", "def rate_{n}():\n    return {n}\n", [("function", "rate_{n}", "def rate_{n}():\n    return {n}")], []),
    Kind("region", "r_regionkey", "r_regionkey", "TRUE", "python", "conf/region_{k}.py", "# region {k}\nprint({k})\n", [], []),
    Kind(
        "supplier", "s_suppkey", "s_nationkey", "s_suppkey % 5 = 0", "javascript", "shop/s{k}.js",
        "import x from './lib';\nconst RATE{k} = \"it's (\";\nconst pay{k} = " + _PAY + ";\nitems.map(i => i.id);\n",
        [("function", "pay{k}", _PAY), ("constant", "RATE{k}", "RATE{k} = \"it's (\"")], [("pay{k}", "rate_{n}")],
    ),
    Kind(
        "supplier", "s_suppkey", "s_nationkey", "s_suppkey % 5 = 1", "typescript", "shop/s{k}.ts",
        "export class Shop{k} {\n  price: Map<string, number> = new Map();\n  " + _SELL + "\n}\ntype F = (a: string) => void;\n",
        [("class", "Shop{k}", "class Shop{k} {\n  price: Map<string, number> = new Map();\n  " + _SELL + "\n}"), ("method", "sell", _SELL), ("method", "price", "price: Map<string, number> = new Map()")],
        [("Shop{k}", "rate_{n}"), ("sell", "rate_{n}")],
    ),
    Kind(
        "supplier", "s_suppkey", "s_nationkey", "s_suppkey % 5 = 2", "java", "shop/S{k}.java",
        "import java.util.List;\n\npublic class Till{k} {\n  /* { */\n  " + _RING + "\n}\n",
        [("function", "ring", _RING), ("class", "Till{k}", "public class Till{k} {\n  /* { */\n  " + _RING + "\n}")], [("ring", "rate_{n}"), ("Till{k}", "rate_{n}")],
    ),
    Kind(
        "supplier", "s_suppkey", "s_nationkey", "s_suppkey % 5 = 3", "go", "shop/s{k}.go",
        "package main\n\n" + _SHIP + "\n\ntype Crate{k} struct {\n  a int\n}\n",
        [("function", "Ship{k}", _SHIP), ("class", "type Crate{k} struct {", "type Crate{k} struct {\n  a int\n}")], [("Ship{k}", "rate_{n}")],
    ),
    Kind(
        "supplier", "s_suppkey", "s_nationkey", "s_suppkey % 5 = 4", "rust", "shop/s{k}.rs",
        "pub struct Box{k} {\n  a: i32,\n}\n\n" + _IMPL + "\n",
        [("function", "open", _OPEN), ("function", "Box{k}", _IMPL), ("class", "Box{k}", "pub struct Box{k} {\n  a: i32,\n}")], [("open", "rate_{n}"), ("Box{k}", "rate_{n}")],
    ),
]


def tree(spark: SparkSession, d: str, key: Callable[[Column], Column] = lambda k: k.cast("string")) -> DataFrame:
    """(file, lang, text) of all kinds; key says what stands for {k} in the texts of customers."""
    out = None
    for kind in KINDS:
        rows = table(spark, d, kind.table).where(kind.where)
        k, n = F.col(kind.key).cast("string"), F.col(kind.nation).cast("string")

        def filled(template: str, k: Column = k, n: Column = n) -> Column:
            return F.replace(F.replace(F.lit(template), F.lit("{k}"), k), F.lit("{n}"), n)

        part = rows.select(filled(kind.file).alias("file"), F.lit(kind.lang).alias("lang"), filled(kind.text, key(F.col(kind.key)) if kind.table == "customer" else k).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def _filled(template: str, key: str = "k") -> str:
    """SQL of a template."""
    quoted = template.replace("'", "''")
    return f"replace(replace('{quoted}', '{{k}}', {key}::VARCHAR), '{{n}}', n::VARCHAR)"


def _rows(kind: Kind) -> str:
    return f"(SELECT {kind.key} AS k, {kind.nation} AS n FROM {kind.table} WHERE {kind.where})"


def _nodes_sql(key: str = "k", where: str = "TRUE") -> str:
    """SQL of all definitions (id, type, name, file, line_start, line_end, content); key and where apply to customers."""
    parts = []
    for kind in KINDS:
        own, only = (key, where) if kind.table == "customer" else ("k", "TRUE")
        for type_, name, content in kind.nodes:
            before = kind.text[: kind.text.index(content)].count("\n")
            parts.append(
                f"SELECT '{type_}:' || {_filled(kind.file)} || ':' || {_filled(name, own)} || ':{before}' AS id, '{type_}' AS type, {_filled(name, own)} AS name, {_filled(kind.file)} AS file, "
                f"{before + 1} AS line_start, {before + 1 + content.count(chr(10))} AS line_end, {_filled(content, own)} AS content FROM {_rows(kind)} WHERE {only}"
            )
    return " UNION ALL ".join(parts)


def _files_sql() -> str:
    return " UNION ALL ".join(f"SELECT {_filled(k.file)} AS file, {k.text.count(chr(10)) + 1} AS line_end, {_filled(k.text) if not k.nodes else chr(39) * 2} AS content, {len(k.nodes) + 1} AS nodes FROM {_rows(k)}" for k in KINDS)


def _calls_sql() -> str:
    parts = [f"SELECT {_filled(kind.file)} AS file, {_filled(name)} AS name, {_filled(callee)} AS callee FROM {_rows(kind)}" for kind in KINDS for name, callee in kind.calls]
    return " UNION ALL ".join(parts)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph_of_rows(code.parse(tree(spark, d)))


def graph_of_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return code.graph_of(materialize(rows, "tree"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query(f"SELECT id, type, name, file, line_start, line_end, md5(content) AS content_md5 FROM ({_nodes_sql()})")
def parsed_definitions(spark, d):
    """Every definition and constant of every file, in all languages."""
    nodes = code.parse(tree(spark, d)).where("kind = 'node' AND type <> 'file'")
    return nodes.select("id", "type", "name", "file", "line_start", "line_end", F.md5("content").alias("content_md5"))


@query(f"SELECT 'file:' || file AS id, string_split(file, '/')[-1] AS name, file, line_end, md5(content) AS content_md5, content = '' AS no_tokens FROM ({_files_sql()})")
def parsed_files(spark, d):
    """File nodes; those without definitions hold their text."""
    nodes = code.parse(tree(spark, d)).where("kind = 'node' AND type = 'file'")
    return nodes.select("id", "name", "file", "line_end", F.md5("content").alias("content_md5"), (F.col("token_count") == 0).alias("no_tokens"))


@query(f"SELECT file, nodes - 1 AS held FROM ({_files_sql()}) WHERE nodes > 1")
def contained_nodes(spark, d):
    """How many definitions and constants each file contains."""
    edges = _graph(spark, d)[1].where("type = 'contains'")
    return edges.groupBy(F.substring("source", 6, 1000).alias("file")).agg(F.count("*").cast("int").alias("held"))


@query(f"WITH n AS ({_nodes_sql()}), c AS ({_calls_sql()}) SELECT s.id AS source, t.id AS target FROM c JOIN n s ON s.file = c.file AND s.name = c.name AND s.type <> 'constant' AND contains(s.content, c.callee) JOIN n t ON t.name = c.callee")
def resolved_calls(spark, d):
    """Calls met with the definitions they name."""
    return _graph(spark, d)[1].where("type = 'calls'").select("source", "target").distinct()


@query(
    "SELECT 'file:nation_' || c_nationkey || '/customer_' || c_custkey || '.py' AS source, 'file:nation_' || c_nationkey || '/rates.py' AS target FROM customer "
    "UNION ALL SELECT 'file:nation_' || c_nationkey || '/customer_' || c_custkey || '.py', 'function:nation_' || c_nationkey || '/rates.py:rate_' || c_nationkey || ':0' FROM customer"
)
def resolved_imports(spark, d):
    """Imports met with files by their paths, else with nodes by their names; the others are dropped."""
    return _graph(spark, d)[1].where("type = 'imports'").select("source", "target")


@query(
    f"WITH f AS (SELECT file, nodes, row_number() OVER (ORDER BY file) AS place FROM ({_files_sql()})), b AS (SELECT (place - 1) // 50 AS batch, max(place) AS files_parsed, sum(nodes) AS nodes FROM f GROUP BY 1) "
    "SELECT batch, files_parsed, (sum(nodes) OVER (ORDER BY batch))::BIGINT AS nodes_so_far, round(files_parsed / (SELECT count(*) FROM f), 6) AS progress FROM b"
)
def parse_progress(spark, d):
    """What had been parsed after each batch of fifty files."""
    out = code.progress(materialize(code.parse(tree(spark, d)), "tree"))
    return out.select("batch", "files_parsed", "nodes_so_far", F.round("progress", 6).alias("progress"))


_NEW_KEY = "CASE WHEN k % 7 = 0 THEN '9' || k ELSE k::VARCHAR END"


@query(f"SELECT id, name, file, md5(content) AS content_md5 FROM ({_nodes_sql(_NEW_KEY, 'k % 11 <> 0')}) WHERE type <> 'file'")
def updated_definitions(spark, d):
    """Definitions after every seventh customer's file was edited and every eleventh's deleted: only those files are parsed again."""
    before = materialize(code.parse(tree(spark, d)), "tree")
    number = F.regexp_extract("file", r"customer_(\d+)\.py$", 1).try_cast("long")
    after = tree(spark, d, lambda k: F.when(k % 7 == 0, F.concat(F.lit("9"), k.cast("string"))).otherwise(k.cast("string")))
    changed = after.select("file", number.alias("number")).where("number % 7 = 0 OR number % 11 = 0")
    again = code.parse(after.join(changed.where("number % 11 <> 0"), "file", "left_semi"))
    nodes, refs = before.where("kind = 'node'"), before.where("kind <> 'node'").withColumn("source", F.col("id"))
    kept, _ = graph.update(nodes, refs.drop("id"), changed, again.where("kind = 'node'"), again.where("kind <> 'node'").withColumn("source", F.col("id")).drop("id"))
    return kept.where("type <> 'file'").select("id", "name", "file", F.md5("content").alias("content_md5"))


@query(
    f"WITH a AS ({_nodes_sql()}), b AS ({_nodes_sql('k', 'k % 11 <> 0')}) SELECT 'nodes' AS what, 'removed' AS change, count(*) AS n, count(DISTINCT file) AS files FROM a WHERE id NOT IN (SELECT id FROM b) HAVING count(*) > 0 "
    "UNION ALL SELECT 'edges', 'removed', count(*), NULL FROM a WHERE id NOT IN (SELECT id FROM b) HAVING count(*) > 0"
)
def difference_counts(spark, d):
    """What went with the definitions of every eleventh customer: nodes, and the edges that contain them."""
    nodes, edges = _graph(spark, d)
    number = F.regexp_extract("file", r"customer_(\d+)\.py$", 1)
    nodes = materialize(nodes.where("type <> 'file'").drop("seq"), "definitions")
    left = nodes.where((number == "") | (number.try_cast("long") % 11 != 0))
    inside = edges.where("type = 'contains'")
    return graph.diff((nodes, inside), (left, inside.join(left.select(F.col("id").alias("target")), "target", "left_semi"))).counts()
