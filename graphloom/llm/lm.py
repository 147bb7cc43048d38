"""Language-model scoring with a gated recurrent network, trained by truncated backpropagation in numpy.

Words are counted over the whole training corpus. The HEAD most frequent words
form CLASSES classes of equal size, by rank; every other word belongs to one of
TAILS classes by its last bytes. The output softmax is factored: the network
gives the class from its state, and for head words the word in its class from
its state; within a tail class, words follow their smoothed counts (count + 0.5,
with one more such share for what was never seen: a class's seen words and the
event of any other word in it sum to one, and each unseen word is given that
event's probability). Biases start at the counted frequencies, so training starts
from the unigram model.

Every training document is walked once. Replicas, as many as the documents need,
walk their parts window by window, carrying the state from one window to the
next; gradients stop at the window's edge. Their parameters are averaged, by how
many steps each took, in partial sums first. Scoring
runs all documents of a batch side by side, longest first, and carries every
document's state through to its end.

The counts of the LISTED most frequent words (a bound) travel with the scoring
function; what documents have beyond those meets the full table of counts in
a join.

Edge cases: null and empty texts are one end token; very long texts are walked
to their end; repeated rows are rows of their own (and train as often as they
stand there); without any training text counts are zero, base_score follows its
formula and the network stays as initialised; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.words import Words, slices
from graphloom.runtime import materialize

HEAD, CLASSES, TAILS = 2048, 32, 32
EMBED, STATE, WINDOW = 16, 16, 32
#: Words whose counts are sent with the scoring function, at most.
LISTED = 200_000
LEARNING_RATE, LANES = 6e-3, 192
#: Training documents to a replica, about, words that it walks at a time, and partial sums of replicas that the driver adds.
REPLICA, WALKED, SUMS = 4_000, 2_000_000, 16
#: Words of a batch that is scored side by side, about.
SIDE_BY_SIDE = 1_500_000
END = b"\n"  # no word has this byte
#: Bytes of text whose tokens a task holds at a time, about.
SLICE = 12 << 20
#: Rows of logits that are worked on at a time, so that they stay in a core's cache.
CACHED = 2_048


def tail_classes(words: pa.Array) -> np.ndarray:
    """Tail class of each of an array of binary words, by their last two bytes and lengths; any of an empty one."""
    if not len(words) or words.buffers()[2] is None:
        return np.zeros(len(words), np.int32)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8).astype(np.int64)
    last, before = data[ends[1:] - 1], data[np.maximum(ends[1:] - 2, ends[:-1])]
    return ((last * 7 + before * 31 + (ends[1:] - ends[:-1]) // 6) % TAILS).astype(np.int32)


class Tokens:
    """Tokens of a column of texts: `words` (distinct, the end token last), `at` (a row of words for each token), `sizes` and `ends` (tokens of each text, its end included, and up to it)."""

    def __init__(self, column: pa.Array):
        read = Words(column)
        self.words = pa.concat_arrays([read.distinct.cast(pa.binary()), pa.array([END], pa.binary())])
        self.sizes = read.sizes + 1
        self.ends = np.cumsum(self.sizes)
        self.at = np.full(len(read.at) + len(read.sizes), len(self.words) - 1)
        self.at[np.arange(len(read.at)) + read.of] = read.at

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of one value for each token, in each text."""
        return np.add.reduceat(values, self.ends - self.sizes) if len(self.sizes) else np.zeros(0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=SLICE):
            t = Tokens(b.column("text"))
            counts = np.bincount(t.at, minlength=len(t.words))
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([t.words.take(pa.array(held)), pa.array(counts[held], pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Listed words with counts, ids of head words, and totals. Of bounded size."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
        self.v, self.n = total["v"], total["n"] or 0
        left, least = 0, 1 << 62
        for r in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
            left += r["count"]
            if left > LISTED:
                break
            least = r["c"]
        rows = [(-r["c"], bytes(r["word"])) for r in counts.where(F.col("c") >= least).toLocalIterator()] if least < 1 << 62 else []
        rows.sort()
        #: by rank
        self.listed, self.counts = pa.array([w for _, w in rows], pa.binary()), np.array([-c for c, _ in rows], float)
        self.head = self.listed.slice(0, HEAD)
        self.head_counts = np.concatenate([self.counts[:HEAD], np.zeros(HEAD - len(self.head))])
        head = self.head

        def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mass = np.zeros(TAILS)
            for b in batches:
                tail = pc.invert(pc.is_in(b.column("word"), value_set=head))
                words, c = b.column("word").filter(tail), np.asarray(b.column("c").filter(tail))
                mass += np.bincount(tail_classes(words), c + 0.5, minlength=TAILS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS), pa.int32()), pa.array(mass)], ["tail", "mass"])

        found = {r["tail"]: r["mass"] for r in counts.select("word", "c").mapInArrow(masses, "tail int, mass double").groupBy("tail").agg(F.sum("mass").alias("mass")).collect()}
        self.tail_mass = np.array([found.get(k, 0.0) + 0.5 for k in range(TAILS)])

    def encode(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tokens, and logarithms of listed counts (nan: not listed)."""
        rank = pc.fill_null(pc.index_in(t.words, value_set=self.listed), -1).to_numpy(zero_copy_only=False)
        head = (rank >= 0) & (rank < HEAD)
        ids = np.where(head, rank, HEAD + tail_classes(t.words)).astype(np.int32)
        logs = np.full(len(rank), np.nan)
        logs[rank >= 0] = np.log10(self.counts[rank[rank >= 0]] + 0.5)
        return ids[t.at], logs[t.at]

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))


class Gru:
    """Parameters as a dict of float32 arrays; ids: head words 0..HEAD-1, tail classes after, a start symbol last."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 6):
        rng = np.random.default_rng(seed)
        n_in, per = HEAD + TAILS + 1, HEAD // CLASSES
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[-1])).astype(np.float32)
        counts = vocabulary.head_counts + 0.5
        by_class = np.concatenate([counts.reshape(CLASSES, per).sum(1), vocabulary.tail_mass])
        self.p = {
            "E": normal(n_in, EMBED) * 0.5,
            "W": normal(EMBED, 3 * STATE),
            "U": normal(STATE, 3 * STATE),
            "b": np.zeros(3 * STATE, np.float32),
            "C": np.zeros((STATE, CLASSES + TAILS), np.float32),
            "c": np.log(by_class / by_class.sum()).astype(np.float32),
            "D": np.zeros((CLASSES, STATE, per), np.float32),
            "d": np.log(counts / counts.sum()).reshape(CLASSES, per).astype(np.float32),
        }

    def run(self, x: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each of x (steps, lanes), from h; with keep, what the way back needs."""
        p = self.p
        table = p["E"] @ p["W"] + p["b"]
        u, s = p["U"], STATE
        states, kept = np.empty((len(x), len(h), s), np.float32), []
        for t, ids in enumerate(x):
            a, r_in = table[ids], h @ u
            gates = 1 / (1 + np.exp(-(a[:, : 2 * s] + r_in[:, : 2 * s])))
            z, r = gates[:, :s], gates[:, s:]
            new = np.tanh(a[:, 2 * s :] + r * r_in[:, 2 * s :])
            before, h = h, new + z * (h - new)
            states[t] = h
            if keep:
                kept.append((before, z, r, new, r_in[:, 2 * s :]))
        return states, h, kept

    def _bounded(self, weights: np.ndarray, biases: np.ndarray) -> bool:
        """No logit of a state (whose entries are within -1 and 1) is too large for exp."""
        return bool((np.abs(weights).sum(0) + np.abs(biases)).max() < 60)

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of ids y after states h; a tail word's is that of its class."""
        p, per = self.p, HEAD // CLASSES
        at = np.where(y < HEAD, y // per, y - HEAD + CLASSES)
        out = np.empty(len(y))

        def chosen(logits: np.ndarray, own: np.ndarray, bounded: bool) -> np.ndarray:
            if not bounded:
                logits -= logits.max(1)[:, None]
            picked = logits[np.arange(len(logits)), own]
            np.exp(logits, out=logits)
            return picked - np.log(logits @ np.ones(logits.shape[1], logits.dtype))

        bounded = self._bounded(p["C"], p["c"])
        for k in range(0, len(y), CACHED):
            out[k : k + CACHED] = chosen(h[k : k + CACHED] @ p["C"] + p["c"], at[k : k + CACHED], bounded)
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            rows = order[ends[k] : ends[k + 1]]
            bounded = self._bounded(p["D"][k], p["d"][k])
            for j in range(0, len(rows), CACHED):
                part = rows[j : j + CACHED]
                out[part] += chosen(h[part] @ p["D"][k] + p["d"][k], y[part] - k * per, bounded)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, h0: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the mean negative log probability of the valid steps of one window; and the states at its end."""
        p, per, s = self.p, HEAD // CLASSES, STATE
        states, h_end, kept = self.run(x, h0, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        n = max(int(valid.sum()), 1)
        h, ids = states[valid], y[valid]
        dh = np.zeros_like(h)
        at = np.where(ids < HEAD, ids // per, ids - HEAD + CLASSES)

        def errors(logits: np.ndarray, own: np.ndarray, bounded: bool) -> np.ndarray:
            """Probabilities, less 1 at the words that came, by the number of steps."""
            if not bounded:
                logits -= logits.max(1, keepdims=True)
            q = np.exp(logits, out=logits)
            q /= (q @ np.full(q.shape[1], n, q.dtype))[:, None]
            q[np.arange(len(own)), own] -= 1 / n
            return q

        q = errors(h @ p["C"] + p["c"], at, self._bounded(p["C"], p["c"]))
        g["C"], g["c"] = h.T @ q, q.sum(0)
        dh += q @ p["C"].T
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            rows = order[ends[k] : ends[k + 1]]
            if len(rows):
                q = errors(h[rows] @ p["D"][k] + p["d"][k], ids[rows] - k * per, self._bounded(p["D"][k], p["d"][k]))
                g["D"][k], g["d"][k] = h[rows].T @ q, q.sum(0)
                dh[rows] += q @ p["D"][k].T
        at_states = np.zeros_like(states)
        at_states[valid] = dh
        lanes = len(h0)
        back = np.zeros_like(h0)
        da, inward = np.empty((len(x), lanes, 3 * s), np.float32), np.empty((len(x), lanes, 3 * s), np.float32)
        before = np.empty_like(states)
        to_h = np.ascontiguousarray(p["U"].T)
        for t in range(len(x) - 1, -1, -1):
            before[t], z, r, new, inner = kept[t]
            back += at_states[t]
            rest = back * (1 - z)
            dnew = rest * (1 - new * new)
            da[t, :, :s] = (before[t] - new) * rest * z
            da[t, :, s : 2 * s] = dnew * inner * r * (1 - r)
            da[t, :, 2 * s :] = dnew
            inward[t, :, : 2 * s] = da[t, :, : 2 * s]
            np.multiply(dnew, r, out=inward[t, :, 2 * s :])
            back *= z
            back += inward[t] @ to_h
        g["U"] = before.reshape(-1, s).T @ inward.reshape(-1, 3 * s)
        # inputs of one word share a row of the table E W + b
        flat, ids = da.reshape(-1, 3 * s), x.ravel()
        order = np.argsort(ids, kind="stable")
        own = ids[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rows = np.add.reduceat(flat[order], first, axis=0)
        g["b"], g["W"] = rows.sum(0), p["E"][own[first]].T @ rows
        g["E"][own[first]] = rows @ p["W"].T
        return g, h_end

    def pack(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.p.values()]).tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size


def _train(model: Gru, documents: list[np.ndarray], rate: float) -> int:
    """One walk over the documents in LANES lanes, each a run of documents one after another; Adam steps by windows. Returns steps."""
    lanes = min(LANES, len(documents))
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    free, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in order:
        load, k = free[0]
        dealt[k].append(documents[i])
        heapq.heapreplace(free, (load + len(documents[i]), k))
    loads = {k: load for load, k in free}
    # longest lanes first: those that ended take no part in later windows
    by_load = sorted(range(lanes), key=lambda k: -loads[k])
    loads, dealt = np.array([loads[k] for k in by_load]), [dealt[k] for k in by_load]
    steps = int(loads[0])
    start = HEAD + TAILS
    x, y, fresh = np.full((steps, lanes), start, np.int32), np.zeros((steps, lanes), np.int32), np.zeros((steps, lanes), bool)
    valid = np.zeros((steps, lanes), bool)
    for k, ds in enumerate(dealt):
        at = 0
        for d in ds:
            x[at + 1 : at + len(d), k], y[at : at + len(d), k] = d[:-1], d
            fresh[at, k], valid[at : at + len(d), k] = True, True
            at += len(d)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    h, done = np.zeros((lanes, STATE), np.float32), 0
    for t in range(0, steps, WINDOW):
        # a document's first word comes from the start symbol; its lane forgets the one before at the window's edge
        n = int(np.searchsorted(-loads, -t, "left"))
        h = h[:n] * ~fresh[t, :n, None]
        g, h = model.gradients(x[t : t + WINDOW, :n], y[t : t + WINDOW, :n], valid[t : t + WINDOW, :n], h)
        done += 1
        for k, v in model.p.items():
            m, s = moments[k]
            m *= 0.9
            s *= 0.99
            s += 0.01 * g[k] * g[k]
            g[k] *= 0.1
            m += g[k]
            step = np.sqrt(s)
            step += 1e-6
            np.divide(m, step, out=step)
            step *= rate * np.sqrt(1 - 0.99**done) / (1 - 0.9**done)
            v -= step
    return done


def train(docs: DataFrame, vocabulary: Vocabulary, seed: int = 6) -> Gru:
    """docs: (doc_id, text) of the training documents, each of which is walked once."""
    model = Gru(vocabulary, seed)
    total = docs.count()
    if not total:
        return model
    replicas = -(-total // REPLICA)
    lane = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(replicas)).cast("int")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=SLICE):
            t = Tokens(b.column("text"))
            ids = vocabulary.encode(t)[0].astype(np.uint16)
            ends = np.concatenate([[0], t.ends]) * 2
            own = pa.Array.from_buffers(pa.binary(), len(t.sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("replica"), b.column("doc_id"), own], ["replica", "doc_id", "ids"])

    kind = T.StructType([T.StructField("replica", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())])
    coded = docs.select(lane.alias("replica"), "doc_id", "text").mapInArrow(encode, kind)
    dealt = coded.repartitionById(replicas, "replica").sortWithinPartitions("doc_id", "ids").select("ids")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, weight = Gru(vocabulary, seed), [], 0, 0
        for b in batches:
            for ids in b.column("ids").to_pylist():
                held.append(np.frombuffer(ids, np.uint16).astype(np.int32))
                size += len(held[-1])
                if size > WALKED:
                    weight += _train(own, held, LEARNING_RATE)
                    held, size = [], 0
        if held:
            weight += _train(own, held, LEARNING_RATE)
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([own.pack()], pa.binary())], ["weight", "p"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, weight = 0, 0
        for b in batches:
            for w, p in zip(b.column("weight").to_pylist(), b.column("p").to_pylist()):
                added = added + w * np.frombuffer(p, np.float32).astype(np.float64)
                weight += w
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([added.tobytes()], pa.binary())], ["weight", "p"])

    walked = materialize(dealt.mapInArrow(walk, "weight long, p binary"), "lm-replicas")
    added, weight = 0, 0
    for r in walked.coalesce(SUMS).mapInArrow(add, "weight long, p binary").collect():  # at most SUMS rows
        added = added + np.frombuffer(r["p"], np.float64)
        weight += r["weight"]
    if weight:
        model.unpack(added / weight)
    return model


def _score_side_by_side(model: Gru, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each document (tail words: of their class), states carried from window to window. flat: ids of one after another."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    h = np.zeros((len(sizes), STATE), np.float32)
    last = np.full(len(sizes), HEAD + TAILS, np.int32)
    total = np.zeros(len(sizes))
    for t in range(0, int(sizes.max(initial=0)), WINDOW):
        n = int(np.searchsorted(-sizes, -t, "left"))  # documents longer than t come first
        steps = min(WINDOW, int(sizes[0]) - t)
        at = starts[:n, None] + t + np.arange(steps)
        valid = t + np.arange(steps) < sizes[:n, None]
        y = np.where(valid, flat[np.minimum(at, len(flat) - 1)], 0)
        x = np.concatenate([last[:n, None], y[:, :-1]], 1)
        states, h_end, _ = model.run(np.ascontiguousarray(x.T), h[:n])
        h[:n], last[:n] = h_end, y[:, -1]
        found = model.log_probs(states.transpose(1, 0, 2)[valid], y[valid])
        total[:n] += np.bincount(np.nonzero(valid)[0], found, minlength=n)
    out = np.empty(len(sizes))
    out[order] = total / np.log(10)
    return out


def score_documents(docs: DataFrame, vocabulary: Vocabulary, model: Gru) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, unlisted): what listed words give, and the other words as often as each stands there."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
        + [T.StructField("unlisted", T.ArrayType(T.BinaryType()))]
    )
    log_mass = np.concatenate([np.zeros(HEAD), np.log10(vocabulary.tail_mass)])
    whole = np.log10(vocabulary.n + 0.5 * (vocabulary.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=SLICE):
            t = Tokens(b.column("text"))
            ids, logs = vocabulary.encode(t)
            listed = ~np.isnan(logs)
            logs = np.where(listed, logs, 0.0)
            n_known, known = t.sums(listed.astype(np.int64)), t.sums(logs)
            in_class = t.sums(np.where(ids >= HEAD, logs, 0.0) - log_mass[ids])
            score = np.empty(len(t.sizes))
            low = 0
            while low < len(t.sizes):  # some documents at a time, of SIDE_BY_SIDE words or one
                before = t.ends[low] - t.sizes[low]
                high = max(int(np.searchsorted(t.ends, before + SIDE_BY_SIDE, "right")), low + 1)
                score[low:high] = _score_side_by_side(model, ids[before : t.ends[high - 1]], t.sizes[low:high])
                low = high
            rest = t.words.take(pa.array(t.at[~listed]))
            ends = np.concatenate([[0], np.cumsum(t.sizes - n_known)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(t.sizes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(known - t.sizes * whole), pa.array(score + in_class), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)],
                schema.fieldNames(),
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_rare_words(scored: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """scored with the counts of unlisted words joined in. A document's list is exploded, met with the counts and summed again."""
    row = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = row.select("row", F.explode("unlisted").alias("word"))
    met = rare.join(counts, "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    added = met.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("more"), F.sum((F.col("c") > 0).cast("long")).alias("known"))
    out = row.drop("unlisted").join(added, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
