"""Queries of the engine's own operators, with their DuckDB SQL.

Views: documents are nodes (file = path made from id and source), customers,
nations and regions are a containment graph, orders and line items link
customers with parts, events are a change feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scrub, text, tokens
from graphloom.operators import graph, render, retrieval, scoring, select
from graphloom.operators import savings as saved
from graphloom.plans import trees
from graphloom.runtime import materialize, table

QUERY = "attion of_the ThandbleReading with heed"
PATH_SQL = "CASE WHEN doc_id % 5 = 0 THEN 'tests/' ELSE 'lib/' END || source || '/' || doc_id || '.py'"
IDENT = r"flatten(list_transform(regexp_extract_all({t}, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: string_split(lower(regexp_replace(w, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_')))"

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _path() -> F.Column:
    return F.concat(F.when(F.col("doc_id") % 5 == 0, "tests/").otherwise("lib/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))


def _asked(spark: SparkSession, q: str = QUERY) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.lit(0).alias("query_id"), F.lit(q).alias("text"))


def _containment(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (source, target, type, seq) of customers and suppliers in nations in regions."""
    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    label = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = (
        c.select(label("n", "c_nationkey").alias("source"), label("c", "c_custkey").alias("target"))
        .union(s.select(label("n", "s_nationkey"), label("s", "s_suppkey")))
        .union(n.select(label("r", "n_regionkey"), label("n", "n_nationkey")))
    )
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return nodes, edges.withColumn("type", F.lit("contains"))


EDGES_SQL = "SELECT 'n' || c_nationkey AS source, 'c' || c_custkey AS target FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation"


@query("SELECT lang AS type, count(*) AS n FROM documents GROUP BY lang")
def node_type_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("type")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def edge_type_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id FROM documents WHERE lang <> 'en' OR regexp_matches(text, '\S')")
def content_filter(spark, d):
    kind = F.when(F.col("lang") == "en", "file").otherwise("function")
    return table(spark, d, "documents").where(text.has_content(kind, F.col("text"))).select("doc_id")


@query(f"SELECT doc_id, len(ts) AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM (SELECT doc_id, {IDENT.format(t='text')} AS ts FROM documents)")
def ident_tokens(spark, d):
    ts = text.ident_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(ts).cast("long").alias("n_tokens"), F.md5(F.array_join(ts, " ")).alias("tokens_md5"))


STATS_CTE = f"""d AS MATERIALIZED (SELECT doc_id AS id, {IDENT.format(t='text')} AS ts FROM documents),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM d) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM d) - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM df),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


@query(f"WITH {STATS_CTE} SELECT term, df, round(idf, 6) AS idf FROM idf")
def corpus_stats(spark, d):
    return scoring.corpus_stats(_docs(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25_sql(asked: str) -> str:
    return f"""{STATS_CTE},
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({IDENT.format(t='text')}) AS term FROM ({asked})) GROUP BY ALL),
p AS (SELECT id, len(ts) AS dl, t.term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM d) t JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY id, dl, t.term),
bm25 AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / (SELECT avg(len(ts)) FROM d)))) AS score
  FROM p JOIN q USING (term) JOIN idf USING (term) GROUP BY query_id, id)"""


ONE = f"SELECT 0 AS query_id, '{QUERY}' AS text"


@query(f"WITH {_bm25_sql(ONE)} SELECT d.id AS doc_id, round(coalesce(score, 0), 5) AS score FROM d LEFT JOIN bm25 USING (id)")
def bm25_content(spark, d):
    docs = _docs(spark, d)
    return docs.select("id").join(scoring.bm25(docs, _asked(spark)), "id", "left").select(F.col("id").alias("doc_id"), F.round(F.coalesce("score", F.lit(0.0)), 5).alias("score"))


@query(
    f"WITH {_bm25_sql('SELECT item_id AS query_id, text FROM benchmark')} SELECT query_id AS item_id, id AS doc_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, id) AS rank FROM bm25) WHERE rank <= 10"
)
def batch_topk(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    top = scoring.bm25_top(_docs(spark, d), asked, 10)
    return top.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


STOP = "(" + ", ".join(f"'{w}'" for w in scoring.STOP_WORDS) + ")"
TFIDF_CTE = rf"""e AS (SELECT doc_id AS id, text, false AS is_query FROM documents UNION ALL SELECT NULL, '{QUERY}', true),
tf AS MATERIALIZED (SELECT id, is_query, term, count(*) AS tf FROM (SELECT id, is_query, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS term FROM e) WHERE term NOT IN {STOP} GROUP BY ALL),
voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000),
w AS (SELECT id, is_query, term, tf * (ln((2 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term)),
qw AS (SELECT term, w AS qw FROM w WHERE is_query),
tfidf AS (SELECT id, coalesce(sum(w * coalesce(qw, 0)) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(qw * qw)) FROM qw)), 0) AS score FROM w LEFT JOIN qw USING (term) WHERE NOT is_query GROUP BY id)"""


@query(f"WITH {TFIDF_CTE} SELECT d.doc_id, round(coalesce(score, 0), 6) AS score FROM documents d LEFT JOIN tfidf ON tfidf.id = d.doc_id")
def tfidf_cosine(spark, d):
    return scoring.tfidf(_docs(spark, d), QUERY, stop_words=scoring.STOP_WORDS).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT e::DOUBLE[] FROM q)) AS s FROM embeddings) SELECT vec_id, round(s, 6) AS score FROM s ORDER BY round(s, 9) DESC, vec_id LIMIT 20"
)
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = e.crossJoin(F.broadcast(q)).select("vec_id", scoring.cosine(F.col("embedding"), F.col("q")).alias("s"))
    return scored.orderBy(F.desc(F.round("s", 9)), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("score"))


def _signals(spark, d) -> DataFrame:
    docs = _docs(spark, d)
    bm25 = docs.select("id").join(scoring.bm25(docs, _asked(spark)), "id", "left").select(F.lit("bm25").alias("signal"), "id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    tfidf = scoring.tfidf(docs, QUERY, stop_words=scoring.STOP_WORDS).select(F.lit("tfidf").alias("signal"), "id", F.round("score", 6).alias("score"))
    degree = graph.degrees(table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target"))).select("id", F.col("degree").cast("double").alias("score"))
    degree = docs.select("id").join(degree, "id", "left").select(F.lit("degree").alias("signal"), "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return materialize(bm25.union(tfidf).union(degree), "signals")


SIGNALS_CTE = f"""{_bm25_sql(ONE)}, {TFIDF_CTE},
sig AS (SELECT 'bm25' AS signal, d.id, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN bm25 USING (id)
  UNION ALL SELECT 'tfidf', d.id, round(coalesce(score, 0), 6) FROM d LEFT JOIN tfidf USING (id)
  UNION ALL SELECT 'degree', d.id, (2 * count(o_custkey))::DOUBLE FROM d LEFT JOIN orders ON o_custkey = d.id GROUP BY d.id),
ranked AS (SELECT signal, id, score, row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS rank FROM sig WHERE signal IN (SELECT signal FROM sig GROUP BY signal HAVING max(score) > 0))"""


@query(f"WITH {SIGNALS_CTE} SELECT signal, id, score, rank FROM ranked")
def rank_signal(spark, d):
    return scoring.rank_signals(_signals(spark, d)).select("signal", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SIGNALS_CTE} SELECT id, round(sum(1e0 / (60 + rank)), 9) AS fused FROM ranked GROUP BY id")
def rrf_fusion(spark, d):
    return scoring.fuse(_signals(spark, d)).select("id", F.round("fused", 9).alias("fused"))


ELIGIBLE = "el AS (SELECT DISTINCT id FROM sig JOIN (SELECT signal, max(score) AS top FROM sig GROUP BY signal) USING (signal) WHERE score >= greatest(0.6e0 * top, 0.13e0))"


@query(f"WITH {SIGNALS_CTE}, {ELIGIBLE} SELECT id FROM el")
def relevance_cliff(spark, d):
    return scoring.eligible(_signals(spark, d))


@query(
    f"WITH {SIGNALS_CTE}, {ELIGIBLE}, f AS (SELECT id, sum(1e0 / (60 + rank)) AS fused FROM ranked GROUP BY id) SELECT id AS doc_id, path, round(CASE WHEN path LIKE 'tests/%' THEN fused * 0.5e0 ELSE fused END, 9) AS score FROM f JOIN el USING (id) JOIN (SELECT doc_id AS id, {PATH_SQL} AS path FROM documents) USING (id) ORDER BY score DESC, doc_id LIMIT 20"
)
def ranked_retrieval(spark, d):
    """The flagship: signals, fusion, test penalty, cliff, top of the ranking."""
    signals = _signals(spark, d)
    fused = scoring.fuse(signals).join(scoring.eligible(signals), "id", "left_semi")
    paths = table(spark, d, "documents").select(F.col("doc_id").alias("id"), _path().alias("path"))
    out = fused.join(paths, "id").select(F.col("id").alias("doc_id"), "path", F.round(scoring.penalised(F.col("fused"), F.col("path")), 9).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(20)


@query(
    f"WITH {SIGNALS_CTE}, wide AS (SELECT id, max(score) FILTER (signal = 'tfidf') AS t, max(score) FILTER (signal = 'degree') AS g FROM sig GROUP BY id), b AS (SELECT min(t) AS lt, max(t) AS ht, min(g) AS lg, max(g) AS hg FROM wide) SELECT id, round(0.6e0 * (t - lt) / CASE WHEN ht > lt THEN ht - lt ELSE 1 END + 0.4e0 * (g - lg) / CASE WHEN hg > lg THEN hg - lg ELSE 1 END, 6) AS blended FROM wide, b"
)
def minmax_blend(spark, d):
    wide = _signals(spark, d).groupBy("id").agg(*[F.max(F.when(F.col("signal") == s, F.col("score"))).alias(s) for s in ("tfidf", "degree")])
    return scoring.blend(wide, {"tfidf": 0.6, "degree": 0.4}).select("id", F.round("blended", 6).alias("blended"))


@query(f"SELECT doc_id, path, path LIKE 'tests/%' AS is_test, n_chars * CASE WHEN path LIKE 'tests/%' THEN 0.5e0 ELSE 1e0 END AS score FROM (SELECT *, {PATH_SQL} AS path FROM documents)")
def test_penalty(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _path().alias("path"), F.col("n_chars").cast("double").alias("n"))
    return docs.select("doc_id", "path", text.is_test_path(F.col("path")).alias("is_test"), scoring.penalised(F.col("n"), F.col("path")).alias("score"))


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_extract(url, '^(.*)/[^/]*$', 1) ELSE url END AS directory FROM pages")
def dir_projection(spark, d):
    return table(spark, d, "pages").select("page_id", text.directory(F.col("url")).alias("directory"))


@query(f"WITH e AS ({EDGES_SQL}) SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id")
def degree(spark, d):
    return graph.degrees(_containment(spark, d)[1])


@query(f"WITH e AS ({EDGES_SQL}) SELECT source AS src, target AS dst FROM e UNION SELECT target, source FROM e")
def adjacency(spark, d):
    return graph.adjacency(_containment(spark, d)[1])


@query(f"WITH e AS ({EDGES_SQL}) SELECT source, target FROM e WHERE hash_of(source) AND hash_of(target)".replace("hash_of(source)", "length(source) <= 3").replace("hash_of(target)", "length(target) <= 3"))
def edge_semi(spark, d):
    nodes, edges = _containment(spark, d)
    return graph.restrict_edges(edges, nodes.where(F.length("id") <= 3)).select("source", "target")


def _pagerank_sql(most: int = 100, tol: float = 1e-6) -> str:
    steps = "".join(
        f""",
r{k} AS (SELECT n.id, 0.15e0 / (SELECT count(*) FROM n) + 0.85e0 * coalesce(g.got, 0) AS raw FROM n LEFT JOIN (SELECT dst, sum(rank / degree) AS got FROM a JOIN deg USING (src) JOIN s{k - 1} ON s{k - 1}.id = a.src GROUP BY dst) g ON g.dst = n.id),
s{k} AS MATERIALIZED (SELECT id, raw / (SELECT sum(raw) FROM r{k}) AS rank FROM r{k})"""
        for k in range(1, most + 1)
    )
    moved = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(x.rank - y.rank)) AS moved FROM s{k} x JOIN s{k - 1} y USING (id)" for k in range(1, most + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, id, rank FROM s{k}" for k in range(1, most + 1))
    return f"""WITH e AS ({EDGES_SQL}), a AS MATERIALIZED (SELECT source AS src, target AS dst FROM e UNION SELECT target, source FROM e), n AS MATERIALIZED (SELECT DISTINCT src AS id FROM a),
deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM a GROUP BY src), s0 AS (SELECT id, 1e0 / (SELECT count(*) FROM n) AS rank FROM n){steps},
stop AS (SELECT coalesce(min(k) FILTER (moved < {tol}), {most}) AS k FROM ({moved})) SELECT id, round(rank, 9) AS rank FROM ({every}) JOIN stop USING (k)"""


@query(_pagerank_sql())
def pagerank(spark, d):
    """With the operator's defaults: until the ranks move less than 1e-6 in a step, or a hundred steps."""
    nodes, edges = _containment(spark, d)
    return graph.pagerank(nodes, edges).select("id", F.round("rank", 9).alias("rank"))


@query(
    "WITH refs AS (SELECT l_orderkey, l_linenumber, p_name AS callee FROM lineitem JOIN part ON l_partkey = p_partkey), t AS (SELECT p_partkey AS target, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS place FROM part) SELECT target, place, count(*) AS n FROM refs JOIN t ON callee = p_name AND place <= 3 GROUP BY ALL"
)
def name_resolve_top3(spark, d):
    part = table(spark, d, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    refs = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("source"), F.col("p_name").alias("callee"), F.lit("calls").alias("type"), F.col("l_linenumber").alias("seq"))
    return graph.resolve_names(refs, nodes).groupBy("target", F.col("place").cast("long").alias("place")).agg(F.count("*").alias("n"))


FILE = "replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '_') || '/' || replace(p_name, ' ', '_') || '.py'"


@query(f"WITH f AS (SELECT p_partkey AS id, {FILE} AS file FROM part), i AS (SELECT DISTINCT p_type || '.' || replace(p_name, ' ', '_') AS import_name FROM part) SELECT import_name, min(id) AS target FROM i JOIN f ON file = replace(import_name, '.', '/') || '.py' OR suffix(file, '/' || replace(import_name, '.', '/') || '.py') GROUP BY import_name")
def suffix_resolve(spark, d):
    part = table(spark, d, "part")
    clean = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    files = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), clean("p_type"), F.lit("/"), clean("p_name"), F.lit(".py")).alias("file"))
    imports = part.select(F.lit("any").alias("source"), F.concat("p_type", F.lit("."), clean("p_name")).alias("import_name")).distinct()
    return graph.resolve_imports(imports, files).select("import_name", "target")


@query(
    r"WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS name FROM documents), names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS name FROM benchmark) SELECT name, count(*) AS n FROM w JOIN names USING (name) WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]+') GROUP BY name"
)
def identifier_refs(spark, d):
    names = table(spark, d, "benchmark").select(F.explode(text.question_words(F.col("text"))).alias("name")).distinct()
    found = table(spark, d, "documents").select(F.explode(text.question_words(F.col("text"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return found.join(names, "name", "left_semi")


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    changed = F.when(F.col("id") % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return docs.where("id % 7 <> 0"), docs.where("id % 5 <> 0").withColumn("content", changed)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'modified' END AS change FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 5 = 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 = 0)")
def graph_diff_nodes(spark, d):
    return graph.diff_nodes(*_versions(spark, d))


@query(f"WITH e AS ({EDGES_SQL}), a AS (SELECT DISTINCT * FROM e WHERE length(target) <> 3), b AS (SELECT DISTINCT * FROM e WHERE length(target) <> 4) SELECT *, 'contains' AS type, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'contains', 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def graph_diff_edges(spark, d):
    edges = _containment(spark, d)[1]
    return graph.diff_edges(edges.where(F.length("target") != 3), edges.where(F.length("target") != 4))


def _scrub_sql() -> str:
    out = "coalesce(text, '')"
    for name, pattern in scrub.PATTERNS.items():
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '[REDACTED_{name.upper()}]', 'g')"
    return out


@query(f"SELECT doc_id, md5({_scrub_sql()}) AS scrubbed_md5 FROM documents")
def scrub_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(scrub.scrubbed(F.coalesce("text", F.lit("")))).alias("scrubbed_md5"))


@query(
    "SELECT doc_id, type, sum(len(hit)) AS n_chars, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS type, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS hit FROM documents" for n, p in scrub.PATTERNS.items())
    + ") GROUP BY ALL"
)
def pii_findings(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(scrub.findings(F.col("text"))).alias("f"))
    return found.groupBy("doc_id", F.col("f.type").alias("type")).agg(F.sum(F.col("f.end") - F.col("f.start")).alias("n_chars"), F.count("*").alias("n"))


@query(
    "WITH t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM documents QUALIFY place <= 3), u AS (SELECT source AS file, doc_id AS id, place, (20 + sum(n_chars // 100) OVER (ORDER BY source, place))::BIGINT AS used FROM t) SELECT * FROM u WHERE used <= 500"
)
def codebase_map(spark, d):
    nodes = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("id"), F.col("n_chars").alias("line_start"), F.floor(F.col("n_chars") / 100).alias("tokens"))
    return select.codebase_map(nodes, 20).withColumn("place", F.col("place").cast("long"))


@query("SELECT source, doc_id, used FROM (SELECT source, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS used FROM documents) WHERE used <= 20000")
def prefix_budget(spark, d):
    return select.prefix_budget(table(spark, d, "documents"), ["source"], ["doc_id"], "n_chars", 20_000).select("source", "doc_id", "used")


@query(
    "WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents), r AS (SELECT DISTINCT source, 0::BIGINT AS p, 0::BIGINT AS used, NULL::BIGINT AS doc_id FROM documents UNION ALL "
    "SELECT d.source, d.p, CASE WHEN used + n_chars <= 20000 THEN used + n_chars ELSE used END, CASE WHEN used + n_chars <= 20000 THEN d.doc_id END FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.p = r.p + 1) "
    "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, doc_id FROM r WHERE doc_id IS NOT NULL"
)
def knapsack_select(spark, d):
    return select.knapsack(table(spark, d, "documents"), ["source"], ["doc_id"], "n_chars", 20_000, "doc_id")


@query(
    f"""WITH RECURSIVE {SIGNALS_CTE}, {ELIGIBLE},
f AS MATERIALIZED (SELECT id, round(sum(1e0 / (60 + rank)), 9) AS score, regexp_extract(any_value(path), '^(.*)/[^/]*$', 1) AS directory, any_value(n_chars) AS tokens FROM ranked JOIN el USING (id) JOIN (SELECT doc_id AS id, n_chars, {PATH_SQL} AS path FROM documents) USING (id) GROUP BY id),
t AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY score DESC, id) AS turn, first_value(id) OVER (PARTITION BY directory ORDER BY score DESC, id) AS best, first_value(score) OVER (PARTITION BY directory ORDER BY score DESC, id) AS top FROM f),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY turn, score DESC, top DESC, best) AS place FROM t),
r AS (SELECT 0::BIGINT AS place, 0::BIGINT AS turn, 20000::BIGINT AS budget, []::VARCHAR[] AS given, true AS chose, NULL::BIGINT AS id
  UNION ALL SELECT place, turn, CASE WHEN ok THEN budget - tokens ELSE budget END, CASE WHEN ok THEN list_append(given, directory) ELSE given END, ok OR (turn = before AND chose), CASE WHEN ok THEN id END
  FROM (SELECT o.place, o.turn, r.turn AS before, budget, given, chose, tokens, directory, o.id, tokens <= 12000 AND tokens <= budget AND len(list_filter(given, lambda x: x = directory)) < 3 AS ok
    FROM r JOIN o ON o.place = r.place + 1 WHERE o.turn = r.turn OR (chose AND budget > 0)))
SELECT id, row_number() OVER (ORDER BY place) - 1 AS position FROM r WHERE id IS NOT NULL"""
)
def round_robin_select(spark, d):
    signals = _signals(spark, d)
    fused = scoring.fuse(signals).join(scoring.eligible(signals), "id", "left_semi").select("id", F.round("fused", 9).alias("score"))
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.directory(_path()).alias("directory"), F.col("n_chars").alias("tokens"))
    return select.select_round_robin(fused.join(nodes, "id"), 20_000)


@query(
    "WITH RECURSIVE e AS (SELECT conv_id * 100 + turn AS source, conv_id * 100 + turn + 1 AS target FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1)), r AS (SELECT conv_id * 100 + turn AS entry, conv_id * 100 + turn AS id, 0 AS depth FROM conversations WHERE turn = 0 UNION SELECT entry, target, depth + 1 FROM r JOIN e ON id = source WHERE depth < 3) SELECT entry, id, min(depth)::INT AS depth FROM r GROUP BY ALL"
)
def flow_reach(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn")
    edges = turns.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")).join(turns.select(F.col("id").alias("target")), "target", "left_semi")
    return graph.reach(edges, turns.where("turn = 0"))


@query("SELECT source, sum(least(n_chars, 500))::BIGINT AS sent, sum(n_chars)::BIGINT AS baseline, count(*) AS files_counted, greatest(sum(n_chars) - sum(least(n_chars, 500)), 0)::BIGINT AS saved, round(100e0 * greatest(sum(n_chars) - sum(least(n_chars, 500)), 0) / sum(n_chars), 1) AS reduction_pct FROM documents GROUP BY source")
def savings(spark, d):
    """Answers of one source each, of 500 characters of every document at most, against the whole documents."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("file"), F.col("n_chars").alias("tokens"))
    sent = docs.groupBy("source").agg(F.sum(F.least(F.col("tokens"), F.lit(500))).alias("sent"))
    return saved.savings(docs, docs, sent, ["source"])


_PHRASES = " OR ".join("contains(p, '" + w.replace("'", "''") + "')" for w in text.QUESTION_PHRASES)


@query(rf"SELECT conv_id, turn, length(p) >= 12 AND ({_PHRASES}) AS is_question FROM (SELECT *, lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS p FROM conversations WHERE role = 'user')")
def prompt_gate(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.is_code_question(F.col("text")).alias("is_question"))


@query(
    r"WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r?\n$', ''), chr(10)) AS ls FROM documents) SELECT doc_id, md5(array_to_string(list_transform(ls, lambda x, i: (doc_id + i - 1) || ': ' || x), chr(10))) AS numbered_md5, substr(coalesce(list_filter(list_transform(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], ''), 1, 160) AS signature FROM l"
)
def number_lines(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.number_lines(F.col("text"), F.col("doc_id"))).alias("numbered_md5"), text.signature(F.col("text")).alias("signature"))


@query(
    "SELECT user_id, event_type, first_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_id DESC, event_type) AS place FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)) WHERE place <= 3"
)
def recent_fifo(spark, d):
    events = table(spark, d, "events").withColumnRenamed("event_id", "first_id")
    return select.recent(events, "user_id", "event_type", "first_id", 3).withColumn("place", F.col("place").cast("long"))


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS hash, substr(text, 1, 50000) = text AS whole FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.coalesce("text", F.lit(""))).alias("hash"), (text.capped(F.col("text")) == F.col("text")).alias("whole"))


def _coded(spark, d) -> DataFrame:
    """Documents as definitions: name from the language, file from id and source."""
    kind = F.when(F.col("doc_id") % 4 == 0, "class").when(F.col("doc_id") % 4 == 1, "constant").otherwise("function")
    start = (F.col("doc_id") % 90 + 1).cast("int")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), kind.alias("type"), F.concat("lang", F.lit("_"), "source").alias("name"), _path().alias("file"), start.alias("line_start"), (start + 5).alias("line_end"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))


CODED = f"SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'class' WHEN doc_id % 4 = 1 THEN 'constant' ELSE 'function' END AS type, lang || '_' || source AS name, {PATH_SQL} AS file, doc_id % 90 + 1 AS line_start, text AS content FROM documents"


def _supplies(spark, d) -> DataFrame:
    """Edges between documents: an order links the document of its customer's id with that of its own."""
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"), F.lit("calls").alias("type"), F.col("o_orderkey").alias("seq"))
    return graph.restrict_edges(edges, ids).select("source", "target", "type", "seq")


SUPPLIES = "SELECT o_custkey AS source, o_orderkey AS target FROM orders WHERE o_custkey IN (SELECT doc_id FROM documents) AND o_orderkey IN (SELECT doc_id FROM documents)"
SUMMARY = f"""c AS ({CODED}), e AS ({SUPPLIES}),
callers AS (SELECT target AS id, ' [callers:' || string_agg(source::VARCHAR, ',' ORDER BY target) || ']' AS s FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY target) AS place FROM e) WHERE place <= 5 GROUP BY target),
calls AS (SELECT source AS id, ' [calls:' || string_agg(target::VARCHAR, ',' ORDER BY target) || ']' AS s FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS place FROM e) WHERE place <= 5 GROUP BY source),
lines AS (SELECT c.id, name || ' ' || file || ' ' || type || coalesce(callers.s, '') || coalesce(calls.s, '') AS summary FROM c LEFT JOIN callers ON callers.id = c.id LEFT JOIN calls ON calls.id = c.id)"""


@query(f"WITH {SUMMARY} SELECT id AS doc_id, summary FROM lines")
def node_summaries(spark, d):
    nodes = _coded(spark, d)
    return graph.summaries(nodes.withColumn("id", F.col("id").cast("string")), _supplies(spark, d).withColumn("source", F.col("source").cast("string")).withColumn("target", F.col("target").cast("string"))).select(F.col("id").cast("long").alias("doc_id"), "summary")


ABOUT = "function lib src3 class"


@query(f"WITH {SUMMARY}, " + _bm25_sql(f"SELECT 0 AS query_id, '{ABOUT}' AS text").replace("SELECT doc_id AS id, " + IDENT.format(t="text") + " AS ts FROM documents", "SELECT id, " + IDENT.format(t="summary") + " AS ts FROM lines") + " SELECT d.id AS doc_id, round(coalesce(score, 0), 5) AS score FROM d LEFT JOIN bm25 USING (id)")
def bm25_summary(spark, d):
    lines = materialize(node_summaries(spark, d).select(F.col("doc_id").alias("id"), F.col("summary").alias("text")), "summaries")
    return lines.select("id").join(scoring.bm25(lines, _asked(spark, ABOUT)), "id", "left").select(F.col("id").alias("doc_id"), F.round(F.coalesce("score", F.lit(0.0)), 5).alias("score"))


@query(f"WITH c AS ({CODED}) SELECT id, file FROM c WHERE file NOT LIKE 'tests/%'")
def test_filter(spark, d):
    return retrieval.without_tests(_coded(spark, d), QUERY).select("id", "file")


@query("WITH k AS (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT id FROM k UNION ALL SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM k)")
def exclude_returned(spark, d):
    return retrieval.without(_coded(spark, d), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))).select("id")


@query(f"WITH {SIGNALS_CTE}, {ELIGIBLE} SELECT CASE WHEN top < 0.05e0 THEN 'low' WHEN top >= 0.5e0 THEN 'high' ELSE 'medium' END AS label, round(top, 6) AS confidence FROM (SELECT max(score) AS top FROM tfidf)")
def confidence_label(spark, d):
    top = scoring.tfidf(_docs(spark, d), QUERY, stop_words=scoring.STOP_WORDS).agg(F.max("score").alias("top"))
    return top.select(scoring.confidence(F.col("top")).alias("label"), F.round("top", 6).alias("confidence"))


@query("WITH r AS (SELECT doc_id AS id, n_chars::DOUBLE AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT * FROM r WHERE rank <= greatest(10, (SELECT count(*) FROM documents) // 20)")
def highlight_top(spark, d):
    return retrieval.highlighted(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")))


@query(
    f"WITH e AS ({EDGES_SQL}), g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id) SELECT id, degree, round(CASE WHEN id LIKE 'r%' THEN greatest(9 + 16 * (degree / (SELECT max(degree) FROM g)), 28) ELSE 9 + 16 * (degree / (SELECT max(degree) FROM g)) END, 6) AS size, id || chr(10) || id AS label, id LIKE 'r%' AS highlighted FROM g"
)
def visual_attributes(spark, d):
    nodes, edges = _containment(spark, d)
    nodes = nodes.withColumn("name", F.col("id")).withColumn("file", F.concat(F.lit("graph/"), "id"))
    return render.visual(nodes, edges, nodes.where("id LIKE 'r%'")).withColumn("size", F.round("size", 6))


@query(f"WITH e AS ({EDGES_SQL}) SELECT * FROM e WHERE source = 'n3' OR target = 'n3'")
def neighbourhood(spark, d):
    return graph.neighbourhood(_containment(spark, d)[1], "n3").select("source", "target")


@query(f"WITH e AS ({EDGES_SQL}), p AS (SELECT source AS id, target, (row_number() OVER (PARTITION BY source ORDER BY target) - 1) // {graph.LINKS} AS part FROM e) SELECT id, part, string_agg(target, ',' ORDER BY target) AS links FROM p GROUP BY ALL")
def edge_index(spark, d):
    edges = _containment(spark, d)[1].withColumn("seq", F.col("target"))
    return graph.edge_index(edges).select("id", "part", F.array_join("links", ",").alias("links"))


@query("WITH i AS (SELECT DISTINCT p_type || '.' || substr(p_name, 1, 3) AS import_name, substr(p_name, 1, 3) AS prefix FROM part) SELECT import_name, min(p_partkey) AS target FROM i JOIN part ON starts_with(p_name, prefix) GROUP BY import_name")
def import_prefixes(spark, d):
    part = table(spark, d, "part")
    files = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    imports = part.select(F.lit("any").alias("source"), F.concat("p_type", F.lit("."), F.substring("p_name", 1, 3)).alias("import_name")).distinct()
    return graph.resolve_import_prefixes(imports, files).select("import_name", "target")


@query(
    r"WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')) AS name FROM documents), b AS (SELECT item_id, list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]+'))[1] AS name FROM benchmark), f AS (SELECT name, min(item_id) AS id FROM b WHERE name IS NOT NULL GROUP BY name) SELECT id, name, count(*) AS n FROM w JOIN f USING (name) GROUP BY ALL"
)
def reference_counts(spark, d):
    """Items named by their first word, as the texts of all documents refer to them."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.get(text.question_words(F.col("text")), F.lit(0)).alias("name"), F.col("text").alias("content"))
    nodes = b.where("name IS NOT NULL").select("*", F.lit("function").alias("type"), F.lit("b.py").alias("file"), F.lit(1).alias("line_start"), F.col("id").alias("seq"))
    return retrieval.references(table(spark, d, "documents").select(F.col("text").alias("content")), nodes).select("id", "name", "n")


@query(
    rf"WITH c AS ({CODED}) SELECT id, md5('### ' || CASE type WHEN 'function' THEN name || '()' WHEN 'class' THEN 'class ' || name ELSE name END || ' (' || file || ':' || line_start || '-' || (line_start + 5) || ')' || chr(10) || chr(10) || CASE WHEN coalesce(content, '') = '' THEN '*(' || type || ' — no content stored)*' ELSE '```python' || chr(10) || array_to_string(list_transform(string_split(regexp_replace(content, '\r?\n$', ''), chr(10)), lambda x, i: (line_start + i - 1) || ': ' || x), chr(10)) || chr(10) || '```' END) AS markdown_md5 FROM c"
)
def node_markdown(spark, d):
    return _coded(spark, d).select("id", F.md5(render.node_markdown()).alias("markdown_md5"))


_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SAID = [_STRIP.format(x=r"string_split(" + _STRIP.format(x=r"regexp_replace(regexp_extract(content, '(?s)/\*\*\s*(.+?)\*/', 1), '(?m)^\s*\*\s?', '', 'g')") + ", '.')[1]"), _STRIP.format(x="string_split(" + _STRIP.format(x="regexp_extract(content, '(?s)\"\"\"(.+?)\"\"\"', 1)") + ", chr(10))[1]")]
PURPOSE_SQL = "substr(CASE " + " ".join(f"WHEN length({x}) > 5 THEN {x}" for x in _SAID) + " ELSE " + _STRIP.format(x=r"regexp_extract(content, '^\s*//\s*(.+)', 1)") + " END, 1, 150)"


@query(
    f"WITH c AS ({CODED}), t AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, id) AS nth FROM (SELECT id, name, 'src/' || name || '.py' AS file, line_start, coalesce(content, '') AS content FROM c) QUALIFY nth <= 3), l AS (SELECT file, nth, '- `' || name || '` (' || file || ':L' || line_start || ')' || CASE WHEN p <> '' THEN ' — ' || p ELSE '' END AS line FROM (SELECT *, {PURPOSE_SQL} AS p FROM t)) "
    f"SELECT place, line FROM (SELECT line, row_number() OVER (ORDER BY file, nth) AS place, sum(length(line)) OVER (ORDER BY file, nth) AS used FROM l) WHERE used + {len(render.MAP)} <= 5000"
)
def map_lines(spark, d):
    """The map of documents as definitions in one file for each name, its budget in characters."""
    nodes = _coded(spark, d).withColumn("file", F.concat(F.lit("src/"), "name", F.lit(".py")))
    return render.map_lines(nodes, 5_000, tokens=F.length)


@query(f"SELECT doc_id AS id, md5({_scrub_sql()}) AS content_md5, n_chars AS token_count FROM documents")
def scrubbed_nodes(spark, d):
    """Scrubbed contents of nodes; their token counts stay."""
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.col("n_chars").alias("token_count"))
    return scrub.scrub_content(nodes).select("id", F.md5("content").alias("content_md5"), "token_count")


@query("SELECT id, score, rank FROM (SELECT doc_id AS id, round(n_chars / 7.0e0, 4) AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20 AND score > 0")
def supporting_nodes(spark, d):
    """The best twenty with a positive score, rounded."""
    rows = scoring.rank_signals(table(spark, d, "documents").select(F.lit("size").alias("signal"), F.col("doc_id").alias("id"), (F.col("n_chars") / 7.0).alias("score")))
    return rows.where("rank <= 20 AND score > 0").select("id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.count_tokens(F.col("text")).alias("n_tokens"))


@query()
def compress_contexts(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.compress(F.col("text"), 200).alias("c")).select("doc_id", "c.*")


def queries() -> dict:
    return {**_QUERIES, **trees.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **trees.SQL}
