"""Source trees as graphs: scan, parse (by graphloom.sources.grammar), resolve."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import CUT, MOST_CHARS, capped
from graphloom.functions.tokens import TOKENIZER, counter, sizes, slices
from graphloom.operators.graph import resolve_import_prefixes, resolve_imports, resolve_names
from graphloom.operators.ordered import running
from graphloom.runtime import dealt, materialize, work_dir
from graphloom.sources import grammar
from graphloom.sources.files import checked_folder

#: Directories that hold no hand-written source.
SKIPPED = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", "env",
    "dist", "build", ".tox", ".mypy_cache", ".pytest_cache",
    ".next", ".nuxt", "target", "vendor", ".gradle",
    "coverage", "htmlcov", ".nyc_output", "coverage-report",
    "out", ".cache", ".turbo", ".parcel-cache", "storybook-static",
    "bower_components", "site-packages", "__snapshots__",
)
#: Suffixes of source files and of generated ones.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust"}
GENERATED = (".min.js", ".min.ts", ".bundle.js", ".chunk.js", ".min.jsx", ".min.tsx")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """Binary files under root with `file`, their path in it, and `lang`: those of known languages outside skipped directories that aren't generated."""
    root = checked_folder(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,js,jsx,ts,tsx,java,go,rs}").load(root)
    base = F.lit(root + "/")
    rel = F.expr("substring(path, instr(path, base) + length(base))")
    out = files.withColumn("base", base).withColumn("file", rel).withColumn("name", F.lower(F.element_at(F.split("file", "/"), -1)))
    inside = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)
    generated = F.col("name").contains(".min.") | F.col("name").endswith(".d.ts")
    for s in GENERATED:
        generated = generated | F.col("name").endswith(s)
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.regexp_extract("file", r"(\.[^./]+)$", 1)]
    return out.where(~F.arrays_overlap(inside, F.array(*map(F.lit, SKIPPED))) & ~generated).withColumn("lang", lang).where("lang IS NOT NULL")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(file, lang, text) of the source files under root, without skipped directories and generated files. Bytes that aren't UTF-8 are replaced."""
    return _listed(spark, root).select("file", "lang", F.expr("make_valid_utf8(cast(content AS string))").alias("text"))


def fingerprint(spark: SparkSession, root: str) -> str:
    """A short hash of the scanned files' paths and times of change: sums that don't depend on their order, so no list of files meets in one task."""
    each = F.xxhash64("file", F.col("modificationTime").cast("double"))
    row = _listed(spark, root).agg(F.count("*").alias("n"), F.bit_xor(each).alias("x"), F.sum(each.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{row['n']}:{row['x']}:{row['s']}".encode()).hexdigest()[:16]


SCHEMA = "file string, kind string, id string, type string, name string, line_start int, line_end int, content string, callee string, token_count int, ordinal int"


def parse(files: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(file, lang, text) -> rows of kind node, call and import; one bad file costs its definitions, not the task.

    ordinal is a row's place in its file: the file, definitions by the kinds of
    their language and the text, constants; calls and imports in the text's order.
    token_count is of the content that is kept, by the tokenizer file at path. A
    file without definitions and constants is a node with its text as content.
    """

    def rows_of(file: str, lang: str, text: str, count: Callable[[str], int], kept: list[str], nodes: list[int], before: int) -> list[tuple]:
        """Rows of a file without token counts. What is to be counted goes to kept and its row, of those that `before` rows stand before, to nodes."""
        try:
            found = grammar.parse_text(lang, text, count)
        except (ValueError, RecursionError, IndexError, KeyError):
            found = grammar.Parsed([], [], [])
        lines, inner = grammar.Lines(text), found.definitions + found.constants
        rows = [(file, "node", f"file:{file}", "file", file.rsplit("/", 1)[-1], 1, text.count("\n") + 1, "" if inner else text, None, 0)]
        counted = [] if inner else [0]
        for d in inner:
            row, content = lines.row(d.start), text[d.start : d.end]
            own = f"{d.kind}:{file}:{d.name}:{row}"
            counted.append(len(rows))
            rows.append((file, "node", own, d.kind, d.name, row + 1, lines.row(max(d.end - 1, d.start)) + 1, content, None, len(rows)))
            rows += [(file, "call", own, "calls", None, 0, 0, None, c, len(rows) + k) for k, c in enumerate(d.calls)]
        nodes += [before + k for k in counted]
        kept += [rows[k][7] if len(rows[k][7]) <= MOST_CHARS else rows[k][7][:MOST_CHARS] + CUT for k in counted]
        return rows + [(file, "import", f"file:{file}", "imports", None, 0, 0, None, name, len(rows) + k) for k, name in enumerate(found.imports)]

    kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in SCHEMA.split(", ")]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in parts:
            files, langs, texts = (part.column(c).to_pylist() for c in ("file", "lang", "text"))
            low = 0
            for piece in slices([t or "" for t in texts]):
                rows, kept, nodes = [], [], []
                for file, lang, text in zip(files[low:], langs[low:], piece):
                    rows += rows_of(file, lang, text, count, kept, nodes, len(rows))
                low, totals = low + len(piece), [0] * len(rows)
                for k, n in zip(nodes, sizes(kept, path)):
                    totals[k] = n
                *columns, ordinal = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((*columns, totals, ordinal), kinds)], names=names)

    return dealt(files.select("file", "lang", "text"), "file").mapInArrow(run, SCHEMA)


def graph_of(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, file, line_start, line_end, content, token_count, seq) and edges (source, target, type) of parsed files.

    seq follows path and place in the file, so the first-three and first-one
    rules depend on neither the file system's order nor the partitioning.
    """
    nodes = parsed.where("kind = 'node'").withColumn("content", capped(F.col("content"), MOST_CHARS))
    nodes = nodes.withColumn("seq", F.struct("file", "ordinal")).select("id", "type", "name", "file", "line_start", "line_end", "content", "token_count", "seq")
    contains = nodes.where("type <> 'file'").select(F.concat(F.lit("file:"), "file").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"))
    calls = parsed.where("kind = 'call'").select(F.col("id").alias("source"), "callee", "type", F.lit(0).alias("seq"))
    called = resolve_names(calls, nodes, 3).select("source", "target", "type")
    imports = parsed.where("kind = 'import'").select(F.col("id").alias("source"), F.col("callee").alias("import_name")).distinct()
    in_files = nodes.where("type = 'file'")
    # a name means the same wherever it is imported, so names are looked up, not imports
    names = imports.select(F.col("import_name").alias("source"), "import_name").distinct()
    by_path = resolve_imports(names, in_files)
    by_path = by_path.union(resolve_import_prefixes(names.join(by_path, "import_name", "left_anti"), in_files))
    left = names.join(by_path, "import_name", "left_anti").select("source", F.col("import_name").alias("callee"), F.lit("imports").alias("type"), F.lit(0).alias("seq"))
    meant = by_path.select(F.col("source").alias("import_name"), "target").union(resolve_names(left, nodes, 1).select("source", "target"))
    imported = imports.join(meant, "import_name").select("source", "target", F.lit("imports").alias("type"))
    return nodes, contains.union(called).union(imported)


def progress(parsed: DataFrame, batch: int = 50) -> DataFrame:
    """(batch, files_parsed, nodes_so_far, progress): running counts over batches of files, in path order, of parsed rows."""
    per_file = materialize(parsed.where("kind = 'node'").groupBy("file").agg(F.count("*").alias("nodes")), "files")
    placed = running(per_file, [], ["file"], "nodes")
    per = placed.groupBy(F.floor((F.col("place") - 1) / batch).alias("batch")).agg(F.max("place").alias("files_parsed"), F.max("used").alias("nodes_so_far"))
    total = per.agg(F.max("files_parsed").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("batch", "files_parsed", "nodes_so_far", (F.col("files_parsed") / F.col("total")).alias("progress"))


def parse_in_batches(files: DataFrame, batch: int = 50, path: str = TOKENIZER) -> Iterator[dict]:
    """Events of a parse, one after each batch of files in path order, and at last one with the graph. A batch is one job, so its size should grow with the tree's."""
    spark = files.sparkSession
    numbered = materialize(running(materialize(files.select("file", "lang", "text"), "files"), [], ["file"]), "numbered")
    total = numbered.count()
    folder, nodes = f"{work_dir(spark)}/batches-{uuid.uuid4().hex}", 0
    for low in range(0, total, batch):
        parse(numbered.where((F.col("place") > low) & (F.col("place") <= low + batch)), path).write.mode("append").parquet(folder)
        done = min(low + batch, total)
        nodes += spark.read.schema(SCHEMA).parquet(folder).where("kind = 'node'").count() - nodes
        yield {"stage": "parsing", "progress": done / total, "files_parsed": done, "total_files": total, "nodes_so_far": nodes}
    parsed = spark.read.schema(SCHEMA).parquet(folder) if total else spark.createDataFrame([], SCHEMA)
    found = graph_of(parsed)
    yield {"stage": "done", "progress": 1.0, "files_parsed": total, "total_files": total, "nodes_so_far": nodes, "graph": found}
