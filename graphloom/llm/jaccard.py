"""N-gram Jaccard join: blocked sparse matrix products over candidate groups.

The incidence matrix has a row for each distinct set of word shingles and a
column for each shingle. Two sets of sizes a <= b at similarity t or more share
at least t * b shingles, so (in any one order of all shingles) they share one
among the first b - ceil(t * b) + 1 of each: only those columns can propose a
pair, and only between rows whose sizes differ by no more than t allows. The
order puts shingles that many texts hold last. A proposed pair must also pass a bound
by blocks of columns: no overlap exceeds the sum, over the blocks, of the lesser
of the two rows' sizes in it. Rows that the pairs left connect form a candidate
group; groups of more than one block are first cut by all pairs' bounds into
smaller ones. A group's rows are cut, by size, into blocks of bounded shingle counts, and every pair of blocks whose sizes allow a link is one sparse
product: overlap counts are accumulated column by column, pairs below the bound
are discarded and the rest are links, exactly. Components of the links follow.

Exact copies are one row of the matrix, found by the hash of their set. A
product task emits a spanning forest and a link count for each row, never its
pairs. Sets and shingles are 64-bit hashes: for a million distinct texts the
chance that any two of them are confused is under 1e-7.

Edge cases: null and empty texts have empty sets and are linked with nothing;
texts of fewer words than a shingle are one shingle; repeated rows are copies;
very long texts are whole rows; ids are integers; an id that stands at several
texts belongs to each one's class; rows with a null id take part, and their
component is the smallest id among what they are linked to, or null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.columns import fresh
from graphloom.llm.words import Words, shingles, slices, with_columns
from graphloom.operators.components import connected_components
from graphloom.operators.ordered import running
from graphloom.runtime import materialize, small

#: Shingles counted at a time when common ones are looked for, and how many common ones are broadcast at most.
CHUNK, COMMON = 2_000_000, 500_000
#: Rows of a common shingle that one task looks at, about.
RUN = 2_000
#: Rows up to which all pairs of a run are considered one by one.
SHORT = 64
#: Shingles in a block of a group, and the least that a row counts for: no block has over BLOCK / LEAST rows, so a
#: product's table of overlaps is bounded where texts are short, too.
BLOCK, LEAST = 1 << 19, 1 << 10


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    read = Words(column)
    h = read.hashes()
    return [shingles(h[read.text(i)], size) for i in range(len(read.sizes))]


def _key(s: np.ndarray) -> int:
    """Identity of a set: a 63-bit hash of its shingles; -1 for the empty set."""
    if not len(s):
        return -1
    from hashlib import blake2b

    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


def column_counts(s: np.ndarray) -> bytes | None:
    """How many of the set's shingles are in each block of columns, of which there are about a third as many as shingles; None where a count is over 255."""
    bits = max(4, (len(s) // 4).bit_length())
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def folded(sketch: np.ndarray, blocks: int) -> np.ndarray:
    """A sketch over fewer, wider blocks."""
    return sketch.reshape(blocks, -1).sum(1, dtype=np.int32) if len(sketch) > blocks else sketch.astype(np.int32)


def set_sizes(docs: DataFrame, size: int) -> DataFrame:
    """For every row: doc_id, key of its set, and n, its size; sketch: column_counts of the set, where a task first meets it.

    Also, with null n, how often a chunk of rows holds a shingle that it holds twice or more (key: the shingle, seen: the count).
    """
    names = ["doc_id", "key", "n", "seen", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            values, counts = values[counts > 1].view(np.int64), counts[counts > 1]
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(values), none, pa.array(counts), pa.nulls(len(values), pa.binary())], names)

        known: set[int] = set()
        for b in slices(batches):
            sets = _sets(b.column("text"), size)
            keys = [_key(s) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            sketches = []
            for k, s in zip(keys, sets):
                sketches.append(None)
                if k not in known and k >= 0:
                    known.add(k)
                    held.append(s)
                    total += len(s)
                    sketches[-1] = column_counts(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(keys, pa.int64()), n, pa.nulls(len(n), pa.int64()), pa.array(sketches, pa.binary())], names)
            if total > CHUNK:
                yield counted()
                held, total = [], 0
            if len(known) > 500_000:
                known.clear()
        if total:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, n long, seen long, sketch binary")


def with_set_keys(docs: DataFrame, shingle_size: int = 4) -> tuple[DataFrame, str]:
    """docs with a column of set keys (-1: no words), and that column's name."""
    name = fresh(docs, "set_key")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield with_columns(b, {name: pa.array([_key(s) for s in _sets(b.column("text"), shingle_size)], pa.int64())})

    return docs.mapInArrow(run, schema), name


def common_shingles(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the most texts hold, at most COMMON of them, sorted, and their counts.

    They only order the columns, so which ones they are changes no result. The
    least count that keeps the list short is read from the counts' histogram.
    """
    counts = seen.groupBy("key").agg(F.sum("seen").alias("seen")).where("seen >= 4")
    counts = materialize(counts, "shingle-counts")
    left, least = 0, 1 << 62
    # a line of the histogram has a shingle at least, so no more than these lines are read; an iterator would take a job for each partition
    for r in counts.groupBy("seen").count().orderBy(F.desc("seen")).limit(COMMON + 1).collect():
        left += r["count"]
        if left > COMMON:
            break
        least = r["seen"]
    rows = counts.where(F.col("seen") >= least).toPandas() if left else None
    if rows is None or not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, n = rows["key"].to_numpy(np.int64).view(np.uint64), rows["seen"].to_numpy(np.int64)
    order = np.argsort(values)
    return values[order], n[order]


def ordered(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """s in the order of all shingles (rare ones first), and the known counts."""
    seen = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        seen = np.where(common[at] == s, counts[at], 0)
    order = np.lexsort((s, seen))
    return s[order], seen[order]


def proposals(docs: DataFrame, size: int, percent: int, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(g, salt, n, key) of every set's prefix shingles; a task names a set once.

    Common shingles are salted, from 1 on, by how common they are; others have
    salt 0. For the common ones, salt -1 has, of what a task saw, the least and the largest row of each salt and size step:
    what chains one shingle's salts together. A step is narrower than what a link
    allows, so its ends stand for it.
    """
    width = -np.log(percent / 100) / 2

    def batch(g: list, salt: list, n: list, key: list) -> pa.RecordBatch:
        columns = [np.concatenate(g).view(np.int64), np.concatenate(salt).astype(np.int32), np.concatenate(n).astype(np.int32), np.concatenate(key)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "salt", "n", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        ends: dict[tuple, tuple] = {}

        def across() -> pa.RecordBatch:
            rows = [(g, *end) for (g, _, _), both in ends.items() for end in set(both)]
            g, n, key = zip(*rows)
            return batch([np.array(g, np.uint64)], [np.full(len(g), -1)], [np.array(n)], [np.array(key, np.int64)])

        for b in slices(batches):
            g, salt, n, key = [], [], [], []
            for s in _sets(b.column("text"), size):
                k = _key(s)
                if k < 0 or k in known:
                    continue
                known.add(k)
                first, seen = ordered(s, common, counts)
                m = len(s) - (percent * len(s) + 99) // 100 + 1
                salts = np.where(seen[:m] >= RUN, k % (seen[:m] // RUN + 1) + 1, 0)
                g.append(first[:m])
                salt.append(salts)
                n.append(np.full(m, len(s)))
                key.append(np.full(m, k))
                step = int(np.log(len(s)) / width)
                for x in np.flatnonzero(seen[:m] >= RUN):
                    at, row = (int(first[x]), int(salts[x]), step), (len(s), k)
                    low, high = ends.get(at, (row, row))
                    ends[at] = (min(low, row), max(high, row))
            if len(known) > 500_000:
                known.clear()
            if len(ends) > 100_000:
                yield across()
                ends.clear()
            if g:
                yield batch(g, salt, n, key)
        if ends:
            yield across()

    return docs.select("text").mapInArrow(run, "g long, salt int, n int, key long")


def _runs(percent: int):
    """Rows sorted by (g, salt, n, key) -> edges (a, b, sure) within runs of one (g, salt), between rows whose sizes allow a link.

    Short runs of unsalted shingles give all such pairs, to be bounded further. In
    longer ones, and in all of salted shingles, whose ends stand for rows of other
    salts, neighbours are chained: if the sizes of two rows allow a link, so do those of
    all between them, so neighbours connect them.
    """

    def edges(g: np.ndarray, salt: np.ndarray, n: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        run = np.cumsum(np.r_[0, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])])
        long = (np.bincount(run) > SHORT)[run] | (salt != 0)
        found = [(np.zeros((0, 2), np.int64), True)]
        for lag in range(1, SHORT):
            same = run[lag:] == run[:-lag]
            if not same.any():
                break
            same &= (key[lag:] != key[:-lag]) & (100 * n[:-lag] >= percent * n[lag:])
            for kind in (False, True) if lag == 1 else (False,):
                some = same & (long[lag:] == kind)
                pairs = np.stack([key[:-lag][some], key[lag:][some]], 1)
                found.append((np.unique(np.sort(pairs, 1), axis=0), kind))
        pairs = np.concatenate([p for p, _ in found])
        sure = np.concatenate([np.full(len(p), kind) for p, kind in found])
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(sure)], ["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            rows = [np.asarray(b.column(c)).astype(np.int64) for c in ("g", "salt", "n", "key")]
            if left is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(left, rows)]
            if not len(rows[0]):
                continue
            # the last run may go on in the next batch
            cut = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0])
            left = [x[cut:] for x in rows]
            if cut:
                yield edges(*(x[:cut] for x in rows))
        if left is not None:
            yield edges(*left)

    return run


def _bounded(percent: int):
    """Keeps pairs that their sizes in each block of columns allow to link: no overlap exceeds the sum of the lesser sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                if x is None or y is None:
                    keep.append(True)
                    continue
                blocks = min(len(x), len(y))
                x, y = folded(np.frombuffer(x, np.uint8), blocks), folded(np.frombuffer(y, np.uint8), blocks)
                most = int(np.minimum(x, y).sum())
                keep.append(100 * most >= percent * (int(x.sum()) + int(y.sum()) - most))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def candidate_edges(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all sets that share a prefix shingle and whose sizes, whole and by blocks of columns, allow a link."""
    dealt = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "n", "key")
    pairs = materialize(dealt.mapInArrow(_runs(percent), "a long, b long, sure boolean").distinct(), "pairs")
    doubtful = pairs.where("NOT sure").select("a", "b")
    ends = doubtful.select(F.col("a").alias("key")).union(doubtful.select("b")).distinct()
    known = materialize(sketches.join(ends, "key", "left_semi").groupBy("key").agg(F.first("sketch").alias("sketch")), "sketches")
    both = doubtful.join(known.select(F.col("key").alias("a"), F.col("sketch").alias("x")), "a", "left").join(known.select(F.col("key").alias("b"), F.col("sketch").alias("y")), "b", "left")
    return pairs.where("sure").select("a", "b").union(both.mapInArrow(_bounded(percent), "a long, b long"))


def overlaps(column: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The product of a 0/1 matrix with its transpose, above the diagonal: shared columns of each pair of rows.

    Columns with few rows add their pairs at each distance in the column; the
    others are multiplied densely, some at a time.
    """
    order = np.lexsort((row, column))
    column, row = column[order], row[order]
    starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(column)])
    of = np.repeat(np.arange(len(counts)), counts)
    total = np.zeros(rows * rows, np.int32)
    sparse = 24
    low = (counts[of] > 1) & (counts[of] <= sparse)
    c, r = of[low], row[low]
    for lag in range(1, sparse):
        same = c[lag:] == c[:-lag]
        if not same.any():
            break
        at, times = np.unique(r[:-lag][same] * rows + r[lag:][same], return_counts=True)
        total[at] += times.astype(np.int32)
    total = total.reshape(rows, rows)
    dense = np.flatnonzero(counts > sparse)
    for k in range(0, len(dense), 512):
        part = dense[k : k + 512]
        place = np.full(len(counts), -1)
        place[part] = np.arange(len(part))
        mine = place[of] >= 0
        a = np.zeros((rows, len(part)), np.float32)
        a[row[mine], place[of[mine]]] = 1
        total += np.rint(a @ a.T).astype(np.int32)
    return np.triu(total, 1)


def spanning(neighbours, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest: neighbours(row, others) says which of the others are linked with the row. Rows that are in a tree aren't looked at again."""
    left, a, b = np.arange(rows), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            v = front.pop()
            hit = neighbours(v, left)
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), v))
            b.append(found)
            front += found.tolist()
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))


def _product(percent: int):
    """One pair of blocks of one group -> links' forest (a, b), and links of each row (a, null b, links)."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        keys, block = np.asarray(t["key"]), np.asarray(t["block"])
        _, first = np.unique(keys, return_index=True)
        t, keys, block = t.take(pa.array(first)), keys[first], block[first]
        lists = t["shingles"].combine_chunks()
        n = np.diff(np.asarray(lists.offsets)).astype(np.int32)
        linked = overlaps(np.asarray(lists.flatten()), np.repeat(np.arange(len(keys)), n), len(keys))
        linked = np.stack([100 * shared.astype(np.int64) >= percent * (n[i] + n - shared.astype(np.int64)) for i, shared in enumerate(linked)]) & (linked > 0)
        linked |= linked.T
        if len(table) and table["i"][0].as_py() != table["j"][0].as_py():
            linked &= block[:, None] != block
        a, b = spanning(lambda v, others: linked[v, others], len(keys))
        links = linked.sum(1)
        some = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array(np.concatenate([keys[a], keys[some]]), pa.int64()),
                "b": pa.array(np.concatenate([keys[b], np.zeros(len(some), np.int64)]), pa.int64(), mask=np.r_[np.zeros(len(a), bool), np.ones(len(some), bool)]),
                "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]]), pa.int64()),
            }
        )

    return run


def _refinement(percent: int):
    """One pair of blocks of one group, as sketches -> edges (a, b) that connect all rows whose sizes, whole and by blocks of columns, allow a link."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        keys = np.asarray(t["key"])
        _, first = np.unique(keys, return_index=True)
        keys, n, sketches = keys[first], np.asarray(t["n"])[first], [t["sketch"][int(i)].as_py() for i in first]
        known = [np.frombuffer(x, np.uint8) for x in sketches if x is not None]
        blocks = min(map(len, known), default=16)
        matrix = np.zeros((len(keys), blocks), np.int32)
        blind = np.array([x is None for x in sketches])
        matrix[~blind] = [folded(x, blocks) for x in known] if known else 0

        def may_link(v: int, others: np.ndarray) -> np.ndarray:
            fits = (100 * np.minimum(n[v], n[others]) >= percent * np.maximum(n[v], n[others]))
            if not blind[v]:
                for k in range(0, len(others), 256):
                    part = others[k : k + 256]
                    most = np.minimum(matrix[v], matrix[part]).sum(1)
                    fits[k : k + 256] &= blind[part] | (100 * most >= percent * (n[v] + n[part] - most))
            return fits

        a, b = spanning(may_link, len(keys))
        return pa.table({"a": pa.array(keys[a], pa.int64()), "b": pa.array(keys[b], pa.int64())})

    return run


def _blocks(sets: DataFrame, weight: str, size: int, percent: int, label: str) -> tuple[DataFrame, DataFrame]:
    """sets (component, key, n, ...) with `block`, by size and a bounded sum of weights in each, and (component, block, i, j): the pairs of blocks (i, j) that a block is in, as far as sizes allow a link."""
    columns = sets.columns
    sets = running(sets, ["component"], ["n", "key"], weight)
    sets = materialize(sets.withColumn("block", F.floor((F.col("used") - F.col(weight)) / size).cast("int")).select(*columns, "block"), label)
    block = sets.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    i, j = block.alias("i"), block.alias("j")
    pairs = i.join(j, (F.col("i.component") == F.col("j.component")) & (F.col("i.block") <= F.col("j.block")) & (100 * F.col("i.high") >= percent * F.col("j.low")))
    pairs = pairs.select(F.col("i.component").alias("component"), F.col("i.block").alias("i"), F.col("j.block").alias("j"))
    return sets, materialize(pairs.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), f"{label}-pairs")


def refined(sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """sets (component, key, n, doc_id, counted) with groups of several blocks cut into smaller ones, or none, by the sketches of their sets.

    Long runs of common shingles chain what shares hardly more than those, so a
    large group may hold few sets that can link. Sketches are a fraction of the
    sets, and here they meet before the sets do.
    """
    large = materialize(sets.groupBy("component").agg(F.sum("counted").alias("whole")).where(F.col("whole") > BLOCK).select("component"), "large-groups")
    if large.isEmpty():
        return sets
    sketch = sketches.groupBy("key").agg(F.first("sketch").alias("sketch"))
    inside = materialize(sets.join(small(large), "component", "left_semi").join(sketch, "key", "left").withColumn("weight", F.greatest(F.coalesce(F.length("sketch"), F.lit(0)), F.lit(LEAST)).cast("long")), "large-sets")
    inside, tasks = _blocks(inside, "weight", BLOCK, percent, "sketched-sets")
    meeting = inside.select("component", "block", "key", "n", "sketch").join(small(tasks), ["component", "block"])
    edges = materialize(meeting.groupBy("component", "i", "j").applyInArrow(_refinement(percent), "a long, b long"), "refined-edges")
    groups = connected_components(edges)
    groups = groups.union(groups.select(F.col("component").alias("node"), "component").distinct())
    cut = inside.select("key", "n", "doc_id", "counted").join(groups, F.col("key") == F.col("node")).select("component", "key", "n", "doc_id", "counted")
    return materialize(sets.join(small(large), "component", "left_anti").select("component", "key", "n", "doc_id", "counted").unionByName(cut), "refined-sets")


def similar_documents(docs: DataFrame, shingle_size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, set_key, class_key) of every row of docs.

    Sets link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id reachable by links, n_links how many distinct other sets the
    row's set is linked with; set_key identifies the row's set (-1: empty) and
    class_key its class (null: empty).
    """
    sized = materialize(set_sizes(docs, shingle_size), "shingle-sets")
    rows = sized.where("n IS NOT NULL").select("doc_id", "key", "n")
    common, counts = common_shingles(sized.where("n IS NULL").select("key", "seen"))
    edges = materialize(candidate_edges(proposals(docs, shingle_size, percent, common, counts), sized.where("sketch IS NOT NULL").select("key", "sketch"), percent), "candidates")
    groups = connected_components(edges)
    groups = groups.union(groups.select(F.col("component").alias("node"), "component").distinct())

    # blocks: a group's sets by size, a bounded number of shingles and of rows in each
    sets = rows.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id")).join(groups, F.col("key") == F.col("node")).drop("node")
    sets = materialize(sets.select("component", "key", "n", "doc_id", F.greatest("n", F.lit(LEAST)).alias("counted")), "candidate-sizes")
    sets, tasks = _blocks(refined(sets, sized.where("sketch IS NOT NULL").select("key", "sketch"), percent), "counted", BLOCK, percent, "candidate-sets")

    wanted = small(sets.select(F.col("doc_id").alias("wanted_id"), F.col("key").alias("wanted_key"), "component", "block"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("wanted_id"))).select("text", "wanted_key", "component", "block")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = _sets(b.column("text"), shingle_size)
            rows = [r for r, (s, k) in enumerate(zip(found, b.column("wanted_key").to_pylist())) if _key(s) == k]
            if not rows:
                continue
            part = b.select(["component", "block", "wanted_key"]).take(pa.array(rows))
            ends = np.cumsum([0] + [len(found[r]) for r in rows])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([found[r] for r in rows]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], ["component", "block", "key", "shingles"])

    # a set goes to the products of its block: as often as its group has blocks of sizes that allow a link
    matrix = texts.mapInArrow(expand, "component long, block int, key long, shingles array<long>").join(small(tasks), ["component", "block"])
    matrix = matrix.select("component", "block", "key", "i", "j", "shingles")
    products = materialize(matrix.groupBy("component", "i", "j").applyInArrow(_product(percent), "a long, b long, links long"), "links")
    classes = connected_components(products.where("b IS NOT NULL"))
    classes = classes.union(classes.select(F.col("component").alias("node"), "component").distinct())
    links = products.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("n_links"))

    per_key = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    per_key = per_key.join(classes, F.col("key") == F.col("node"), "left").join(links, F.col("key") == F.col("a"), "left")
    per_key = per_key.select("key", F.coalesce("component", "key").alias("component"), "least", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    per_key = materialize(per_key, "set-classes")
    least = per_key.groupBy("component").agg(F.min("least").alias("component_id"))
    known = per_key.join(least, "component").select(F.col("key").alias("of_key"), "component_id", "n_links", F.col("component").alias("class_key"))
    out = rows.join(small(materialize(known, "classes")), F.col("key") == F.col("of_key"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("key").alias("set_key"), "class_key")
