"""What grows with the tables: one test for each step that did more than its share."""

import glob
import inspect
import os

import duckdb
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.functions import tokens
from graphloom.operators import graph, scoring
from graphloom.runtime import materialize
from graphloom.sources import code


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contexts_are_compressed_in_one_pass(spark):
    """One Python evaluation makes all four columns, so a batch is held once."""
    df = spark.createDataFrame([("word " * 60,), ("short",), ("",), (None,), ("<|endoftext|> é " * 30,)], "t string")
    out = df.select(tokens.compress(F.col("t"), 10).alias("c")).select("c.*")
    assert plan_of(out).count("ArrowEvalPython") == 1
    rows = out.collect()
    known = tokens._load(tokens.TOKENIZER)
    for r, (t,) in zip(rows, df.collect()):
        whole = known.encode(t or "", add_special_tokens=False)
        short = t or "" if len(whole.ids) <= 10 else t[: whole.offsets[9][1]]
        again = len(known.encode(short, add_special_tokens=False).ids)
        assert tuple(r) == (short, len(whole.ids), again, again / len(whole.ids) if whole.ids else 0.0)


def test_tokens_are_counted_a_slice_at_a_time(monkeypatch):
    """No more than a slice's characters are encoded together, however large the batch; a longer text stands alone."""
    assert "encode_batch(" not in inspect.getsource(tokens)
    texts = ["abc def " * k for k in range(200)] + ["", "x " * 3000]
    expected, seen, known = tokens.sizes(texts), [], tokens._load(tokens.TOKENIZER)
    assert expected == [len(known.encode(t, add_special_tokens=False).ids) for t in texts]

    class Watched:
        def encode_batch_fast(self, part, **how):
            seen.append(part)
            return known.encode_batch_fast(part, **how)

    monkeypatch.setattr(tokens, "_load", lambda path: Watched())
    monkeypatch.setattr(tokens.slices, "__defaults__", (1000,))
    assert tokens.sizes(texts) == expected and len(seen) > 100
    assert all(len(p) == 1 or sum(map(len, p)) <= 1000 for p in seen) and tokens.sizes([]) == []


def of_sql(name, folder, tables):
    """Rows of a query's SQL over the folder's tables."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def written(df, folder, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts-{name}")
    (part,) = glob.glob(f"{folder}/parts-{name}/*.parquet")
    os.replace(part, f"{folder}/{name}.parquet")


ODD_LINES = ["a\n\n", "a\n\n\n", "", None, "\n", "\r\n", "a\r\nb\r\n", "a\rb", "\rb", "\x0b\x0bx \x0b\n", "  x  ", "x\x85", "x   \ny", " x ", "\t\n \f\r\n y\t\r\n", "a\r", "é" * 200, "a\x1cb", "a\n\r\n", "a\n\r", "z\n "]


def test_lines_are_those_of_the_sql(spark, tmp_path):
    """Texts that end in several line feeds, hold lone carriage returns or other separators, are empty or null."""
    docs = [(k, t, "en", "src1", len(t or "")) for k, t in enumerate(ODD_LINES)]
    written(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path, "documents")
    for name in ("number_lines", "node_markdown"):
        got = {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
        expected = set(of_sql(name, tmp_path, ["documents"]))
        assert got == expected and len(got) == len(docs)


def spread(df):
    """Partitions that hold rows, and the largest one's rows."""
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    return sum(n > 0 for n in sizes), max(sizes)


def test_files_of_one_partition_are_parsed_by_all_cores(spark):
    """A table in one row group is read by one task, which parsed it alone."""
    k = F.col("id").cast("string")
    text = F.concat(F.lit("from nation.rates import rate\n\n\ndef f"), k, F.lit("(x):\n    return g(x)\n"))
    files = spark.range(6000, numPartitions=1).select(F.concat(F.lit("a/f"), k, F.lit(".py")).alias("file"), F.lit("python").alias("lang"), text.alias("text"))
    parsed = code.parse(files)
    parts, most = spread(parsed)
    assert parts >= spark.sparkContext.defaultParallelism and most < 6 * 6000 // 3
    assert parsed.where("kind = 'node'").count() == 12_000 and parsed.where("kind = 'import'").count() == 12_000
    few = code.parse(files.limit(40))
    assert spread(few)[0] == 1, "a few files stay where they are"
    row = {r["kind"] + r["type"]: r for r in few.where("file = 'a/f7.py'").collect()}
    known = tokens.counter()
    assert row["nodefunction"]["token_count"] == known("def f7(x):\n    return g(x)") and row["nodefile"]["token_count"] == 0
    assert (row["nodefunction"]["ordinal"], row["callcalls"]["ordinal"], row["callcalls"]["callee"]) == (1, 2, "g")


def test_imported_names_are_looked_up_once(spark):
    """Names are made distinct before they become candidates; repeated and many sources get what their names mean."""
    imports = spark.range(3000).selectExpr("concat('s', id % 1500) AS source", "concat('pkg.m', id % 3) AS import_name")
    files = spark.createDataFrame([("f0", 2, "x/pkg/m0.py", "m0.py"), ("f1", 1, "y/pkg/m0.py", "m0.py"), ("f2", 3, "pkg/m1/index.js", "index.js"), ("f3", 4, "m2_and.py", "m2_and.py")], "id string, seq int, file string, name string")
    found = graph.resolve_imports(imports, files)
    assert {(r["source"], r["import_name"], r["target"]) for r in found.collect()} == {(f"s{i}", f"pkg.m{i % 3}", ["f1", "f2"][i % 3]) for i in range(1500) if i % 3 < 2}
    assert found.count() == 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    asked = next(part for part in plan.split("Generate explode")[1:] if "array_distinct" in part.splitlines()[0])
    assert asked.splitlines()[1].lstrip(" +-:|").startswith(("Aggregate", "Filter")) and "Aggregate [import_name" in asked
    left = imports.where("import_name = 'pkg.m2'").limit(1)
    assert [r["target"] for r in graph.resolve_import_prefixes(left, files).collect()] == ["f3"]


def texts_of(spark, n, words=40):
    return spark.range(n, numPartitions=1).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), F.pow(F.rand(k) * 3, 4).cast("int").cast("string")) for k in range(words)]).alias("text"))


def test_the_first_documents_are_found_where_they_stand(spark, monkeypatch):
    """The first ten of all scores, with ties, are those that the tasks hand on; queries too many to be sent are joined."""
    docs = materialize(texts_of(spark, 900).union(texts_of(spark, 300).withColumn("id", F.col("id") + 5000)).union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "none")], "id long, text string")), "docs")
    asked = spark.createDataFrame([(1, "w0 w1 w7 w7"), (2, "w80"), (None, "w3 w5"), (4, "unknown"), (5, None)], "query_id int, text string")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 7)), "id")
    every = scoring.bm25(docs, asked).withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    key = lambda rows: {(r["query_id"], r["id"], r["rank"], round(r["score"], 9)) for r in rows}
    expected = key(every.collect())
    top = scoring.bm25_top(docs, asked, 10)
    assert key(top.collect()) == expected and len(expected) == 30
    monkeypatch.setattr(scoring, "SCORED_TOGETHER", 64)
    monkeypatch.setattr(scoring, "COUNTED_TOGETHER", 100)
    monkeypatch.setattr(scoring, "HELD_TERMS", 5)
    assert key(scoring.bm25_top(docs, asked, 10).collect()) == expected
    monkeypatch.setattr(scoring, "BAG_ROWS", 2)
    assert key(scoring.bm25_top(docs, asked, 10).collect()) == expected


def test_terms_of_documents_are_not_shuffled(spark, monkeypatch):
    """What scans write grows with distinct terms, not with documents times terms, and documents of one row group are dealt out."""
    wrote, write = {}, scoring.materialize

    def watched(df, label):
        out = write(df, label)
        wrote[label] = out.count()
        return out

    monkeypatch.setattr(scoring, "materialize", watched)
    docs = materialize(texts_of(spark, 4000).coalesce(1), "docs")
    assert docs.rdd.getNumPartitions() == 1
    scores = scoring.tfidf(docs, "w1 w2", stop_words=())
    distinct = docs.select(F.explode(F.split("text", " ")).alias("t")).distinct().count()
    assert wrote["term-counts"] <= 8 * (distinct + 1) < 4000
    assert scores.count() == 4000 and spread(scores)[0] > 1
    assert {r["id"] for r in scoring.bm25(docs, spark.createDataFrame([(0, "w77")], "query_id int, text string")).collect()} == {r["id"] for r in docs.where("text RLIKE '\\\\bw77\\\\b'").collect()}
    assert wrote["postings"] <= 8 * (distinct + 1) + docs.where("text RLIKE '\\\\bw77\\\\b'").count()


def test_leaves_of_a_hub_are_ranked_as_one(spark, monkeypatch):
    """Stars, pairs, loops and isolated nodes hold the ranks of a plain power iteration, in one task and by joins, and stars leave few links."""
    wrote, write = {}, graph.materialize

    def watched(df, label):
        out = write(df, label)
        wrote[label] = out.count()
        return out

    monkeypatch.setattr(graph, "materialize", watched)
    pairs = [(0, k) for k in range(10, 400)] + [(1, k) for k in range(400, 900)] + [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6), (7, 7), (8, 8), (8, 9), (10, 0)]
    n = 1000
    a = np.zeros((n, n))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    nodes, edges = spark.range(n), spark.createDataFrame(pairs, "source long, target long")
    rank = np.full(n, 1 / n)
    for _ in range(11):
        rank = 0.15 / n + 0.85 * (a / np.maximum(a.sum(1, keepdims=True), 1)).T @ rank
        rank /= rank.sum()
    for limit in (200_000, 0):
        monkeypatch.setattr(graph, "ONE_TASK", limit)
        got = graph.pagerank(nodes, edges, max_iter=11, tol=0.0).collect()
        assert len(got) == n and np.allclose([r["rank"] for r in sorted(got, key=lambda r: r["id"])], rank, atol=1e-13, rtol=1e-9)
        assert wrote["pagerank-edges"] < 50
