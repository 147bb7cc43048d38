"""Secret scans: candidate strings judged by a random forest, in DataFrame expressions only.

A candidate is a maximal run of 16 or more of A-Z a-z 0-9 _ + / = - that holds
a digit. Its features are length, share of changes between character classes,
distinct characters, shares of digits, upper case and hex digits, dictionary
coverage, how path-like it is, what the words before and after it say, quotes
and assignment around it, and whether the document's path is one of tests or
examples. The forest is grown from labelled findings; by default these are
LABELLED_ROWS generated ones (true credentials, and the digests, ids, paths,
identifiers, numbers and placeholders that scanners mistake for them). Trees are
compiled to CASE expressions, so scoring stays in the plan.

Edge cases: null and empty texts have no findings; a null path is an empty one;
equal candidates in a text are findings of their own; repeated rows are rows of
their own; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.arrays import prefix_sums
from graphloom.llm.columns import fresh
from graphloom.runtime import materialize

CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
PLACEHOLDER = "[SECRET]"

#: Number of labelled findings generated where the caller gives none; also the bound on those given.
LABELLED_ROWS = 4_000
TREES, DEPTH = 24, 7
#: Characters before and after a candidate that its features see.
AROUND = 48

#: Words that names in code are made of.
DICTIONARY = (
    "account admin alpha api array backup base beta block branch buffer build cache call card check class client code "
    "commit common config copy core count create data date default delete demo draft edit enable error event example "
    "factory field file filter find first format frame function group handler hash head help home host image index info "
    "input invoice item java json key last level lib limit line link list load local lock login main make manager map mask "
    "member message method model module month name net next node null number object option order output page param parse "
    "path phone place point port print process product query queue random range read record release remote report request "
    "reset resource result return role root route rule run sample scale schema scope score script search second section "
    "select sequence server service session set shared size source stack start state static status store stream string "
    "style system table tag target task temp test text thread time title token total trace tree type unit update upload url "
    "user util value vector version view width window word work write year your"
).split()

FEATURES = (
    "length", "transitions", "distinct", "digits", "upper", "hex_only", "coverage", "segments", "underscores",
    "says_secret", "says_benign", "assigned", "quoted", "test_path", "known_prefix", "repeats", "placeholder", "after_benign",
)


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_sql(c: str, before: str, after: str, path: str) -> str:
    """SQL: array of doubles, in the order of FEATURES, of candidate c with what stands before and after it."""
    n = f"length({c})"

    def share(pattern: str) -> str:
        return f"({n} - length(regexp_replace({c}, {_sql(pattern)}, ''))) / {n}"

    def says(where: str, pattern: str) -> str:
        return f"CASE WHEN {where} rlike {_sql(pattern)} THEN 1 ELSE 0 END"

    folded = f"regexp_replace(regexp_replace(regexp_replace({c}, '[a-z]+', 'a'), '[A-Z]+', 'A'), '[0-9]+', '0')"
    dictionary = "(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))) + ")"
    values = (
        n,
        f"(length({folded}) - 1) / {n}",
        f"size(array_distinct(split({c}, ''))) / {n}",
        share("[0-9]"),
        share("[A-Z]"),
        says(c, "^[0-9a-fA-F]+$"),
        f"({n} - length(regexp_replace(lower({c}), {_sql(dictionary)}, ''))) / {n}",
        f"{n} - length(replace({c}, '/', ''))",
        f"{n} - length(regexp_replace({c}, '[_-]', ''))",
        says(before, r"(?i)(token|secret|passw|pwd|api.?key|access.?key|credential|auth|bearer|private)\W*\w{0,6}\W*$"),
        says(before, r"(?i)(commit|revision|sha\d*|md5|checksum|digest|hash|uuid|guid|build|version|card|order|invoice|phone|number|id|file|path|import|see)\W*$"),
        says(before, "[:=]\\s*[\"']?$"),
        says(f"concat(right({before}, 1), left({after}, 1))", "^(\"\"|'')$"),
        says(path, "(?i)(test|example|sample|mock|fixture|demo|doc)s?[/_.]"),
        says(c, "^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abp]-|sk_|sk-|eyJ)"),
        f"length(regexp_replace({c}, '(.)\\\\1\\\\1+', '')) / {n}",
        says(c, "(?i)(your|example|placeholder|changeme|dummy|xxxx|0000|1234|insert|sample)"),
        says(after, "(?i)^\\W*(is|file|page|line|commit|test|example)\\b"),
    )
    return "array(" + ", ".join(f"cast({v} AS double)" for v in values) + ")"


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """Generated findings (before, candidate, after, path, label), a fixed function of the row number."""
    words = "array(" + ", ".join(_sql(w) for w in DICTIONARY) + ")"

    def word(k: int) -> str:
        return f"element_at({words}, cast(pmod(xxhash64(id, {k}), {len(DICTIONARY)}) AS int) + 1)"

    def pick(k: int, *options: str) -> str:
        return f"element_at(array({', '.join(map(_sql, options))}), cast(pmod(xxhash64(id, {k}), {len(options)}) AS int) + 1)"

    h, b64 = "sha2(concat('finding ', id), 256)", "base64(unhex(sha2(concat('finding ', id), 256)))"
    keys = ('token = "', "token: ", "secret: ", "api_key = '", "password=", "Authorization: Bearer ", "access key ", 'private_key: "', 'auth_token="')
    closing = f"CASE WHEN right(before, 1) IN ('\"', '\\'') THEN concat(right(before, 1), ' ', {word(9)}) ELSE concat(' ', {word(9)}) END"
    kinds = [  # (before, candidate, path, label)
        (pick(1, *keys), f"substr({h}, 1, 40)", "'src'", 1),
        (pick(1, *keys), f"substr({h}, 1, 40)", "'src'", 1),
        (pick(1, *keys), f"substr({h}, 1, 32)", "'src'", 1),
        (pick(1, *keys), h, "'src'", 1),
        (pick(1, *keys), f"substr({b64}, 1, 40)", "'src'", 1),
        (f"concat({word(2)}, ' ')", f"concat('AKIA', upper(substr({h}, 1, 16)))", "'src'", 1),
        (f"concat({word(2)}, ' ')", f"concat('ghp_', substr(translate({b64}, '+/=', 'abc'), 1, 36))", "'src'", 1),
        (f"concat({word(2)}, ' ')", f"substr(translate({b64}, '+/=', 'abc'), 1, 32)", "'src'", 1),
        (pick(1, "commit ", "revision ", "see commit ", "build "), f"substr({h}, 1, 40)", "'src'", 0),
        (pick(1, "sha256: ", "checksum ", "digest = ", "hash: "), h, "'src'", 0),
        (pick(1, "md5 ", "checksum: ", "uuid "), f"substr({h}, 1, 32)", "'src'", 0),
        (pick(1, "id=", "uuid: ", "order ", "session id "), f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))", "'src'", 0),
        (pick(1, "file ", "see ", "import ", "in "), f"concat_ws('/', {word(2)}, {word(3)}, concat({word(4)}, '_', {word(5)}, id % 97))", "'src'", 0),
        (f"concat({word(6)}, ' ')", f"concat({word(2)}, '_', {word(3)}, '_', {word(4)}, id % 97)", "'src'", 0),
        (f"concat({word(6)}, ' = ')", f"concat({word(2)}, initcap({word(3)}), initcap({word(4)}), initcap({word(5)}), id % 10)", "'src'", 0),
        (pick(1, *keys), pick(2, "your_api_key_here_123", "xxxxxxxxxxxxxxxxxxxx1", "EXAMPLEKEY1234567890", "changeme12345678", "0000000000000000000", "insert-token-here-1"), "'src'", 0),
        (pick(1, "card ", "phone ", "number ", "the ", "of ", "and "), f"rpad(conv(substr({h}, 1, 13), 16, 10), 16, '7')", "'src'", 0),
        (f"concat({word(2)}, ' ')", f"concat(rpad(conv(substr({h}, 1, 13), 16, 10), 16, '3'), substr(conv(substr({h}, 20, 6), 16, 10), 1, id % 5))", "'src'", 0),
        (pick(1, *keys), f"concat({word(3)}, '-', {word(4)}, '-', {word(5)}, '-example', id % 10)", "'tests/fixtures/'", 0),
        (pick(1, *keys), f"substr({h}, 1, 40)", "'examples/'", 0),
        (f"concat({word(6)}, '. ')", f"concat({word(2)}, {word(3)}, {word(4)}, 1900 + id % 130)", "'src'", 0),
    ]

    def by_kind(column: int) -> str:
        return "CASE id % " + str(len(kinds)) + " " + " ".join(f"WHEN {i} THEN {k[column]}" for i, k in enumerate(kinds)) + " END"

    made = spark.range(rows, numPartitions=1).selectExpr("id", f"{by_kind(0)} AS before", f"{by_kind(1)} AS candidate", f"{by_kind(2)} AS path", f"{by_kind(3)} AS label")
    return made.selectExpr("concat(" + word(7) + ", ' ', before) AS before", "candidate", f"{closing} AS after", "path", "label")


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> str:
    """A tree as SQL over the array x: the best Gini split among a random choice of features, down to depth."""
    positive = y.mean()
    if depth == 0 or len(y) < 8 or positive in (0.0, 1.0):
        return f"{(y.sum() + 0.5) / (len(y) + 1):.6f}D"
    best = None
    for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))) + 1, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        left = cuts + 1.0
        right = len(y) - left
        p, q = ones[cuts] / left, (ones[-1] - ones[cuts]) / right
        impurity = left * p * (1 - p) + right * q * (1 - q)
        k = int(np.argmin(impurity))
        if best is None or impurity[k] < best[0]:
            best = (impurity[k], f, (v[cuts[k]] + v[cuts[k] + 1]) / 2)
    if best is None:
        return f"{(y.sum() + 0.5) / (len(y) + 1):.6f}D"
    _, f, cut = best
    low = x[:, f] <= cut
    return f"CASE WHEN x[{f}] <= {cut:.6f}D THEN {_grow(x[low], y[low], rng, depth - 1)} ELSE {_grow(x[~low], y[~low], rng, depth - 1)} END"


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5, max_rows: int = LABELLED_ROWS) -> list[str]:
    """Trees, as SQL over an array x of features, from labelled findings.

    Where there are more than max_rows (a bound), each label gives its share of
    them: the rows of its least hashes.
    """
    h = F.xxhash64("candidate", "before", "after", "path", F.lit(seed))
    every = materialize(findings.where("label IS NOT NULL").select("candidate", "before", "after", "path", "label", h.alias("h")), "findings")
    counts = {r["label"]: r["count"] for r in every.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        raise ValueError("no labelled findings")
    parts = [every.where(F.col("label") == label).orderBy("h", "candidate", "before", "after", "path").limit(max(1, round(n * min(1.0, max_rows / total)))) for label, n in sorted(counts.items())]
    chosen = reduce(DataFrame.unionByName, parts)
    rows = sorted(chosen.selectExpr(feature_sql("candidate", "before", "after", "path") + " AS x", "label").collect(), key=lambda r: (r["label"], r["x"]))
    x, y = np.array([r["x"] for r in rows]).round(6), np.array([r["label"] for r in rows], dtype=float)
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        bag = rng.integers(0, len(y), len(y))
        grown.append(_grow(x[bag], y[bag], rng, depth))
    return grown


def forest_sql(trees: list[str], x: str = "x") -> str:
    """SQL: the mean of the trees' votes on the array named x."""
    votes = " + ".join(f"({t})" for t in trees)
    return f"({votes}) / {len(trees)}.0D".replace("x[", f"{x}[")


def _scanned(docs: DataFrame, trees: list[str] | None, threshold: float, path: str) -> tuple[DataFrame, str, str]:
    """docs with the gaps between candidates (null: no candidate) and the findings, and those columns' names."""
    trees = trees or train_forest(labelled_findings(docs.sparkSession))
    name, found, gaps = fresh(docs, "findings"), fresh(docs, "secret_candidates"), fresh(docs, "secret_gaps")
    none = "cast(array() AS array<struct<ordinal:int,start:int,candidate:string,before:string,after:string,score:double,is_secret:boolean>>)"
    around_it = f"""transform({found}, (c, i) -> named_struct('ordinal', i, 'start', starts[i], 'candidate', c,
        'before', right({gaps}[i], {AROUND}), 'after', left({gaps}[i + 1], {AROUND})))"""
    with_x = f"transform({around_it}, f -> named_struct('f', f, 'x', {feature_sql('f.candidate', 'f.before', 'f.after', f'coalesce(`{path}`, "")')}))"
    scored = f"transform({with_x}, g -> named_struct('f', g.f, 'score', {forest_sql(trees, 'g.x')}))"
    steps = f"zip_with({found}, slice({gaps}, 1, size({found})), (c, g) -> length(g) + length(c))"
    starts = f"zip_with({prefix_sums(steps)}, slice({gaps}, 1, size({found})), (a, g) -> a + length(g))"
    out = f"""CASE WHEN size({found}) > 0 THEN flatten(transform(array({starts}), starts -> transform({scored}, g -> named_struct(
        'ordinal', g.f.ordinal, 'start', g.f.start, 'candidate', g.f.candidate, 'before', g.f.before, 'after', g.f.after,
        'score', round(g.score, 6), 'is_secret', g.score >= {threshold}D)))) ELSE {none} END"""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.withColumn(found, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
        .withColumn(gaps, F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)))
        .withColumn(name, F.expr(out))
        .drop(found),
        gaps,
        name,
    )


def find_secrets(docs: DataFrame, trees: list[str] | None = None, threshold: float = 0.5, path: str = "source") -> tuple[DataFrame, str]:
    """docs with an array column of findings, and that column's name.

    A finding has ordinal, start (characters before it), candidate, before,
    after, score (share of the forest's vote) and is_secret (score >= threshold).
    """
    scanned, gaps, name = _scanned(docs, trees, threshold, path)
    return scanned.drop(gaps), name


def redact(docs: DataFrame, trees: list[str] | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """docs with every secret in text replaced by PLACEHOLDER; n_chars, where there is one, follows the text."""
    scanned, gaps, name = _scanned(docs, trees, threshold, path)
    kept = f"transform({name}, (f, i) -> concat({gaps}[i], CASE WHEN f.is_secret THEN {_sql(PLACEHOLDER)} ELSE f.candidate END))"
    cut = f"concat(array_join({kept}, ''), {gaps}[size({name})])"
    hit = fresh(scanned, "has_secret")
    out = scanned.withColumn(hit, F.expr(f"exists({name}, f -> f.is_secret)")).withColumn("text", F.expr(f"CASE WHEN {hit} THEN {cut} ELSE text END"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hit), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
