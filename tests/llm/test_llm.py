"""Every operator of the subpackage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against plainer versions."""

import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, chroma, decontamination, jaccard, licenses, lm, mixing, quality, secrets, toxicity
from graphloom.llm.words import hash64

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", size long, score double, mix long, findings string, stats string, license_scan int, set_key long, word string"


def docs_of(spark, texts, clash=False):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in texts]
    if clash:
        return spark.createDataFrame([(*r, 1, 0.5, 2, "f", "s", 3, 4, "w") for r in rows], SCHEMA + CLASH)
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, short and very long texts, repeated rows, shared ids."""
    rng = np.random.default_rng(0)
    long = words(rng, 60_000)
    body = words(rng, 200)
    rows = [(1, body, "a"), (2, body, "a"), (2, body, "a"), (3, body + " tail", None), (4, None, "b"), (5, "", "b"), (6, " \n\t", "b"), (7, "one two", "c"), (8, "one two", "c"), (9, long, "c"), (None, "no id here at all", "c"), (2, words(rng, 50), "a"), (10, "x" * 100_000, "d")]
    return rows, docs_of(spark, rows, clash=True).repartition(3)


def test_jaccard_against_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    base = [words(rng, n).split() for n in (40, 60, 90)]
    rows = []
    for k, b in enumerate(base):
        for j in range(25):
            w = list(b)
            for at in rng.integers(0, len(w), j % 4):
                w[at] = "edit%d" % rng.integers(1000)
            rows.append((1000 * k + j, " ".join(w), "s"))
    rows = [r for r in odd[0] if r[0] is not None and r[1] != odd[0][-2][1]] + rows
    got = jaccard.similar_documents(docs_of(spark, rows, clash=True).repartition(4)).collect()

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            parent[root(b)] = root(a)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 60), r[0])
    want = sorted((r[0], len(s), least[root(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert jaccard.similar_documents(docs_of(spark, [])).count() == 0


def test_jaccard_blocks_agree_with_one_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    body = words(rng, 80).split()
    rows = [(i, " ".join(w if rng.random() > 0.01 else "e%d" % rng.integers(99) for w in body), "s") for i in range(120)]
    one = sorted(tuple(r)[:4] for r in jaccard.similar_documents(docs_of(spark, rows)).collect())
    monkeypatch.setattr(jaccard, "BLOCK", 1000)
    monkeypatch.setattr(jaccard, "SHORT", 8)
    monkeypatch.setattr(jaccard, "RUN", 16)
    assert sorted(tuple(r)[:4] for r in jaccard.similar_documents(docs_of(spark, rows)).collect()) == one


def test_jaccard_blocks_of_few_short_rows_agree_with_one_block(spark, monkeypatch):
    # 16 words, 13 shingles; another last word leaves 12 of 14 in common, another first and last 11 of 15
    body = "a b c d e f g h i j k l m n o".split()
    rows = [(i, " ".join([*body, "z%d" % i] if i % 3 else ["y%d" % i, *body[1:], "z"]), "s") for i in range(30)]
    one = sorted(tuple(r)[:4] for r in jaccard.similar_documents(docs_of(spark, rows)).collect())
    assert {r[3] for r in one} == {9, 19} and {r[2] for r in one} == {0, 1}
    monkeypatch.setattr(jaccard, "BLOCK", 8 * jaccard.LEAST)
    assert sorted(tuple(r)[:4] for r in jaccard.similar_documents(docs_of(spark, rows)).collect()) == one


def test_jaccard_links_across_salts_whose_ends_are_dissimilar(spark, monkeypatch):
    # one edited word of 63 leaves 56 of 64 shingles in common with the body, and at most 55 of 65 with another's
    body = ["b%d" % i for i in range(63)]
    rows = [(0, " ".join(body), "s")] + [(i, " ".join([*body[: 9 + i], "e%d" % i, *body[10 + i :]]), "s") for i in range(1, 41)]
    monkeypatch.setattr(jaccard, "RUN", 16)
    got = jaccard.similar_documents(docs_of(spark, rows).repartition(1)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == [(0, 0, 40)] + [(i, 0, 1) for i in range(1, 41)]


def test_jaccard_cuts_large_groups_and_keeps_links(spark, monkeypatch):
    # 40 texts share a passage that chains them and most of nothing else; two pairs of them are near copies
    rng = np.random.default_rng(18)
    passage = words(rng, 30)
    rows = [(i, passage + " " + " ".join("w%d_%d" % (i, k) for k in range(20)), "s") for i in range(40)]
    rows += [(50, rows[3][1] + " more", "s"), (51, "first " + rows[7][1], "s"), (52, rows[3][1] + " other end", "s")]
    calls = []
    kept = jaccard._refinement
    # in an order that doesn't know which shingles are common, the passage proposes pairs
    monkeypatch.setattr(jaccard, "common_shingles", lambda seen: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(jaccard, "_refinement", lambda percent: calls.append(percent) or kept(percent))
    for name, value in (("BLOCK", 200), ("LEAST", 8), ("SHORT", 4)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.similar_documents(docs_of(spark, rows), 4, 85).collect()}
    assert calls and got[50] == (3, 2) and got[52] == (3, 2) and got[51] == (7, 1) and got[3] == (3, 2) and got[7] == (7, 1)
    assert all(got[i] == (i, 0) for i in range(40) if i not in (3, 7))


def test_jaccard_sketches_bound_overlaps():
    rng = np.random.default_rng(19)
    for _ in range(50):
        pool = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 700)))) for _ in range(2))
        x, y = (np.frombuffer(jaccard.column_counts(s), np.uint8) for s in (a, b))
        blocks = min(len(x), len(y))
        assert np.minimum(jaccard.folded(x, blocks), jaccard.folded(y, blocks)).sum() >= len(np.intersect1d(a, b))


def test_jaccard_null_and_shared_ids(spark):
    body, other = words(np.random.default_rng(20), 60), words(np.random.default_rng(21), 60)
    rows = [(None, body, "s"), (9, body + " x", "s"), (None, other, "s"), (4, other, "s"), (4, body, "s"), (5, None, "s"), (None, "", "s"), (7, "a b", "s"), (7, "c d", "s")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["n_links"]) for r in jaccard.similar_documents(docs_of(spark, rows, clash=True)).collect())
    # the smallest id that isn't null names a class; an id at several texts belongs to each one's class
    assert got == sorted([("None", 57, "4", 1), ("9", 58, "4", 1), ("None", 57, "4", 0), ("4", 57, "4", 0), ("4", 57, "4", 1), ("5", 0, "5", 0), ("None", 0, "None", 0), ("7", 1, "7", 0), ("7", 1, "7", 0)])


def test_overlaps_is_the_matrix_product():
    rng = np.random.default_rng(5)
    a = rng.random((40, 90)) < 0.5
    a[:, :30] &= rng.random((40, 30)) < 0.1
    row, column = np.nonzero(a)
    assert (jaccard.overlaps(column, row, 40) == np.triu(a.astype(int) @ a.T.astype(int), 1)).all()


def test_chat_round_trip(spark, odd):
    said = ["\\### Assistant: </turn> ok", "<+>", "\\", "\\\\l<", "<turn user>\n", "", None, "a\\l<b\\\\<", "é\\g>\U0001f600"]
    roles = ("user", "assistant", "assistant", None, "a<b\\", "x>\ny", "x>", "\\g\ufffd>\n", ">\n")
    rows = [(k, t, roles[(t * k) % len(roles)], said[(t + k) % len(said)]) for k in range(12) for t in range(9)]
    rows += [(3, 2, "user", "same turn"), (3, 2, "user", "same turn"), (None, 0, "user", "x")]
    rows += [(13, t, "assistant", "é%d" % t) for t in range(700)]
    df = spark.createDataFrame([(*r, "f", 1, "p") for r in rows], "conv_id long, turn long, role string, text string, formatted string, at int, parts string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for k in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == k)
        assert [(t["role"], t["text"]) for t in got[k]["turns"]] == [(r, x) for _, r, x in turns]
        assert got[k]["loss_texts"] == [x for _, r, x in turns if r == "assistant"]
        cut = [got[k]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[k]["loss_spans"]]
        assert cut == [x.replace("\\", "\\\\").replace("<", "\\l") for _, r, x in turns if r == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_mixing(spark, odd):
    rows, df = odd
    planned, name = mixing.mix_plan(df)
    got = planned.select("doc_id", "source", F.col(name)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for r in got:
        assert abs(r[name]["target"] - target[r["source"]]) < 1e-6 and 0 <= r[name]["copies"] <= 3
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix(df).count() == sum(r[name]["copies"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_licenses(spark, odd):
    rows = [(1, "see MIT License mit license", "a"), (2, "x\nReleased under the MIT License.\ny", "a"), (3, "Licensed under CC BY-NC 4.0.", "a"), (4, "a general public-license note", "a"), (5, "nothing here", "a")]
    out, name = licenses.scan(docs_of(spark, rows, clash=True))
    got = {r["doc_id"]: r[name] for r in out.collect()}
    assert [(p["label"], p["count"], p["first"], p["last"]) for p in got[1]["places"]] == [("mit", 2, 1, 3)]
    assert {t["label"] for t in got[2]["templates"]} == {"mit"} and got[2]["n_words"] == 7
    assert {t["label"] for t in got[3]["templates"]} == {"cc-by-nc"} and not got[3]["places"]
    assert [(p["label"], p["first"]) for p in got[4]["places"]] == [("gpl", 1)]
    assert not got[5]["places"] and not got[5]["templates"]
    out, name = licenses.scan(odd[1])
    assert out.count() == len(odd[0]) and out.where(F.size(f"{name}.places") > 0).count() == 0
    assert licenses.scan(docs_of(spark, []))[0].count() == 0


def test_license_filters_drop_nothing(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _, t in licenses.TEMPLATES:
        for share in (0.6, 0.75, 0.8, 0.85, 1.0):
            tokens = [w for w in re.split(licenses.SEPARATORS, t) if w]
            texts.append(" ".join(["lead"] * int(rng.integers(40)) + [w for w in tokens if rng.random() < share] + ["extra"] * int(rng.integers(70))))
    out, name = licenses.scan(docs_of(spark, [(i, x, "a") for i, x in enumerate(texts)]))
    for r in out.collect():
        ws, want = licenses.template_words(r["text"]), []
        for label, t in licenses.TEMPLATES:
            c, tokens = licenses.block_class(t), set(licenses.template_tokens(t))
            want += [label for k in range(0, max(len(ws), 1), c) if len(set(ws[k : k + 2 * c]) & tokens) >= 0.8 * len(tokens) - 1e-9]
        assert sorted(t["label"] for t in r[name]["templates"]) == sorted(want)


def test_licenses_however_lines_are_broken(spark):
    fill = words(np.random.default_rng(7), 3_000)
    rows, want = [], {}
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        wrapped = "".join(" * " + " ".join(t.split()[i : i + 4]) + "\n" for i in range(0, len(t.split()), 4))
        for j, text in enumerate((wrapped, fill + "\n" + wrapped + fill, (fill + " " + t + " " + fill).replace("\n", " "), t + " " + t)):
            rows.append((4 * k + j, text, "a"))
            want[4 * k + j] = label
    out, name = licenses.scan(docs_of(spark, rows))
    for r in out.collect():
        assert want[r["doc_id"]] in {t["label"] for t in r[name]["templates"]}, r["doc_id"]


def test_secrets(spark, odd):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [(1, f'a token = "{key}" b token = "{key}" c', "s"), (2, f"see commit {key} for more", "s"), (3, "the 2669109448945250 on src/main/config_loader_2", "s")]
    df = docs_of(spark, rows, clash=True)
    trees = secrets.train_forest(secrets.labelled_findings(spark))
    out, name = secrets.find_secrets(df, trees)
    got = {r["doc_id"]: r[name] for r in out.collect()}
    assert [(f["start"], f["is_secret"]) for f in got[1]] == [(11, True), (64, True)]
    assert not any(f["is_secret"] for f in got[2] + got[3]) and got[2] and got[3]
    clean = {r["doc_id"]: r for r in secrets.redact(df, trees).collect()}
    assert clean[1]["text"] == 'a token = "[SECRET]" b token = "[SECRET]" c' and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2]["text"] == rows[1][1]
    again = secrets.redact(odd[1], trees)
    assert again.columns == odd[1].columns
    assert sorted(map(str, again.select("doc_id", "text").collect())) == sorted(map(str, odd[1].select("doc_id", "text").collect()))
    assert secrets.find_secrets(docs_of(spark, []), trees)[0].count() == 0


def test_forest_samples_labels_alike(spark):
    made = secrets.labelled_findings(spark, 6000)
    positive = made.where("label = 1").count() / 6000
    kept = []
    grow, secrets_grow = secrets._grow, lambda x, y, rng, depth: kept.append((len(y), y.mean())) or "0.5D"
    try:
        secrets._grow = secrets_grow
        secrets.train_forest(made.repartition(5), trees=40, max_rows=2000)
    finally:
        secrets._grow = grow
    assert all(abs(n - 2000) <= 1 for n, _ in kept) and abs(np.mean([p for _, p in kept]) - positive) < 0.01
    assert secrets.train_forest(made.repartition(5), trees=2) == secrets.train_forest(made.coalesce(1), trees=2)
    with pytest.raises(ValueError):
        secrets.train_forest(made.limit(0))


def test_secrets_offsets_of_many_candidates_and_accuracy(spark):
    rng = np.random.default_rng(12)
    hexes = ["%040x" % int.from_bytes(rng.bytes(20), "big") for _ in range(300)]
    kinds = [('é token = "%s" x', 1), ("password: %s y", 1), ("see commit %s z", 0), ("sha1 checksum %s w", 0)]
    chosen = [kinds[int(i)] for i in rng.integers(0, 4, 900)]
    text = "\n".join(k[0] % hexes[int(i)] for k, i in zip(chosen, rng.integers(0, 300, 900)))
    out, name = secrets.find_secrets(docs_of(spark, [(1, text, "s")]))
    found = out.first()[name]
    assert len(found) == 900 and all(text[f["start"] : f["start"] + 40] == f["candidate"] for f in found)
    said, true = np.array([f["is_secret"] for f in found]), np.array([k[1] for k in chosen], bool)
    assert (said & true).sum() / true.sum() > 0.95 and (said & true).sum() / max(said.sum(), 1) > 0.95
    cut = secrets.redact(docs_of(spark, [(1, text, "s")])).first()["text"]
    assert cut.count(secrets.PLACEHOLDER) == said.sum()


def test_decontamination(spark, odd):
    rng = np.random.default_rng(7)
    item = "A train leaves the big station at 12 miles before Anna counts 30 apples and 12 pears in total for the road"
    moved = item.replace("12", "47").replace("30", "5").replace("Anna", "Peter")
    broken = item.replace("12", "47", 1).replace("Anna", "Peter")
    bench = spark.createDataFrame([(1, item), (2, words(rng, 25)), (3, None), (4, ""), (5, "tiny item here")], "item_id long, text string")
    fill = words(rng, 40)
    rows = [(1, fill + ". " + item + " " + fill, "s"), (2, fill + ". " + moved, "s"), (3, fill + ". " + broken + " so", "s"), (4, fill, "s"), (5, "what a tiny item here is", "s"), (6, None, "s"), (7, " ".join(item.split()[:9]), "s")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs_of(spark, rows, clash=True), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 5)}
    assert got[1, 1]["changed_slots"] == 0 and got[2, 1]["changed_slots"] == 4
    left = decontamination.decontaminate(docs_of(spark, rows, clash=True), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 6, 7]
    assert decontamination.decontaminate(odd[1], bench).count() == len(odd[0])
    assert decontamination.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontamination.contaminated(odd[1], bench.limit(0)).count() == 0


def found_items(spark, items, texts):
    """Items that contaminate each text."""
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    out = [[] for _ in texts]
    for r in decontamination.contaminated(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), bench).collect():
        out[r["doc_id"]].append(r["item_id"])
    return [sorted(x) for x in out]


def test_decontamination_of_copies_in_other_places(spark):
    items = ["What is the capital of France?", "Which of the old towns did Anna Miller leave in spring", "Anna has 3 apples and 4 pears"]
    texts, want = [], []
    for k, item in enumerate(items):
        for text in (item, "Question 3\n" + item, "they asked " + item + " and left", item.lower(), "so " + item.lower() + " so"):
            texts.append(text)
            want.append([k])
    texts += ["Question 3\nWhat is the capital of Peru?", "Question 3\nWhat is the river of France?", "Question 3\nwhich of the old towns did anna leave in spring"]
    assert found_items(spark, items, texts) == want + [[0], [], []]


def test_decontamination_of_numbers_and_names(spark):
    # hardly a word of these items is literal
    tables = "Totals 12 14 18 21 33 47 58 61 72 85 93 104 117"
    sums = "Add 12 kg 14 kg 18 kg and 21 kg then 33 kg less 47 kg"
    texts = [tables, "so " + tables + " so", tables.replace("12", "13").replace("93", "94"), "Totals " + " ".join(str(i) for i in range(200, 213)), sums.replace("12", "5").replace("18", "7"), "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", ""]
    assert found_items(spark, [tables, sums], texts) == [[0], [0], [0], [], [1], [], []]
    assert found_items(spark, [sums, sums, "", None], [sums, sums]) == [[0, 1], [0, 1]]


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(15)
    bag = "the of a train town leaves house river old red".split() + ["Anna", "Peter", "Rome", "7", "12", "30", "kg", "km", "so.", "(end)"]
    some = lambda n: " ".join(rng.choice(bag, n))
    items = [some(n) for n in (3, 6, 8, 9, 13, 14, 20, 30, 40)]
    swap = {"Anna": "Peter", "7": "19", "12": "44", "Rome": "Oslo"}
    texts = []
    for _ in range(150):
        words_, item = some(int(rng.integers(0, 40))).split(), items[int(rng.integers(len(items)))].split()
        kind, at = int(rng.integers(5)), int(rng.integers(0, len(words_) + 1))
        if kind == 1:
            item = [swap.get(w, w) for w in item]
        elif kind == 2:
            item = item[int(rng.integers(len(item))) :]
        elif kind == 3:
            item[int(rng.integers(len(item)))] = "other"
        texts.append(" ".join(words_ if kind == 4 else words_[:at] + item + words_[at:]))

    def read(text):
        words_ = text.split()
        own, code, other = [], [], []
        for i, w in enumerate(words_):
            core = w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
            number = lambda x: re.fullmatch(r"[+-]?[$]?[0-9][0-9.,:/%]*", x.strip("().")) is not None
            opens = i == 0 or words_[i - 1].rstrip("\"')]}")[-1:] in set(".!?:|") - {""}
            capital = re.fullmatch("[A-Z][^A-Z]*", core) is not None
            kind = "N" if number(core) else "U" if core.lower() in decontamination.UNITS and i and number(words_[i - 1]) else "A" if capital and not opens else None
            own.append(core.lower())
            code.append(("slot", kind) if kind else core.lower())
            other.append(core.lower() if kind == "A" else ("slot", "A") if capital and opens and not kind else code[-1])
        return own, code, other

    want = []
    for text in texts:
        own, code, other = read(text)
        hit = []
        for k, item in enumerate(items):
            i_own, i_code, _ = read(item)
            n, slot = len(i_own), [isinstance(c, tuple) for c in i_code]
            size = min(8, n)
            rich = max(sum(not x for x in slot[p : p + size]) for p in range(n - size + 1))
            shifts = set()
            for p in range(n - size + 1):
                looked = {tuple(i_own[p : p + size])}
                if sum(not x for x in slot[p : p + size]) >= min(4, rich):
                    looked.add(tuple(i_code[p : p + size]))
                for q in range(len(own) - size + 1):
                    read_as = {tuple(code[q : q + size]), tuple(own[q : q + size]), (other[q], *code[q + 1 : q + size])}
                    if looked & read_as:
                        shifts.add(q - p)
            covered, same = set(), set()
            for s in shifts:
                match = [0 <= p + s < len(own) and (i_own[p] == own[p + s] or i_code[p] in (code[p + s], other[p + s])) for p in range(n)]
                here = sorted({x for p in range(n - size + 1) if all(match[p : p + size]) for x in range(p, p + size)})
                if all(len({own[x + s] for x in here if slot[x] and i_own[x] == v}) < 2 for v in i_own):
                    covered |= set(here)
                    same |= {x for x in here if own[x + s] == i_own[x]}
            if len(covered) >= min(13, n) and len(same) >= min(4, n):
                hit.append(k)
        want.append(hit)
    assert sum(map(len, want)) > 40
    assert found_items(spark, items, texts) == want


def test_quality(spark, odd):
    rng = np.random.default_rng(8)
    rows = [(i, words(rng, 80) if i % 4 else words(rng, 3).upper() * 9 + "!! ### " * 20, "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(0, None), (999, 1)], "doc_id long, quality int")
    stats = quality.stats_of(docs_of(spark, rows), ["doc_id"])
    model = quality.fit(stats, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_stats(stats, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 > 0) for i in got)
    scored, name = quality.score_documents(odd[1], model)
    assert [c for c in scored.columns if c != name] == odd[1].columns
    assert all(0 <= r[name] <= 1 for r in scored.collect()) and scored.count() == len(odd[0])
    assert quality.fit(stats, labels.limit(0)).score(np.zeros((2, len(quality.STATS)))).tolist() == [1.0, 1.0]
    assert quality.score_documents(docs_of(spark, []), model)[0].count() == 0


def test_quality_fit_does_not_depend_on_partitions(spark):
    # one document of label 1: the partitions without it count as much as the one with it
    rng = np.random.default_rng(13)
    rows = [(i, words(rng, int(rng.integers(5, 90))), "s") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i == 7)) for i in range(200)], "doc_id long, quality int")
    stats = quality.stats_of(docs_of(spark, rows), ["doc_id"]).cache()
    one, many = quality.fit(stats.coalesce(1), labels), quality.fit(stats.repartition(7), labels)
    assert np.allclose(one.weights, many.weights, atol=1e-9)
    x, y = one.features(quality.text_stats([t.encode() for _, t, _ in rows])), np.arange(200) == 7
    plain = np.linalg.solve(x.T @ x + quality.RIDGE * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(one.weights, plain, atol=1e-6)


def test_isotonic():
    y = quality.isotonic(np.arange(5), np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.array([1, 1, 1, 2, 1.0]))
    assert np.allclose(y, [0.1, 0.35, 0.35, 0.35, 0.9])


def test_toxicity(spark, odd):
    rng = np.random.default_rng(9)
    rows = [(i, words(rng, 60) + (" vilename " if i % 3 == 0 else " ") + words(rng, 60), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, rows), labels)
    assert 0 < len(model.at) < 3000
    scored, name = toxicity.score_documents(docs_of(spark, rows), model)
    got = {r["doc_id"]: r[name] for r in scored.collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(150, 300)]) > 0.97
    scored, name = toxicity.score_documents(odd[1], model)
    assert all(0 <= r[name] <= 1 for r in scored.collect()) and scored.count() == len(odd[0])
    assert toxicity.fit(docs_of(spark, rows), labels.limit(0)).score(pa.array(["", "x", None]), np.zeros(1 << toxicity.BITS, np.float32)).tolist() == [0.5, 0.5, 0.5]
    assert toxicity.score_documents(docs_of(spark, []), model)[0].count() == 0 and len(toxicity.fit(docs_of(spark, []), labels).at) == 0


def test_toxicity_against_plain_ftrl(spark):
    rng = np.random.default_rng(17)
    rows = [(i, " ".join(rng.choice(["Good", "fine", "vile", "b\u00e9", "day", "x-y", "word%d" % (i % 9)], int(rng.integers(0, 12)))), "s") for i in range(60)]
    labels = [(i, int("vile" in t)) for i, t, _ in rows]
    model = toxicity.fit(docs_of(spark, rows).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def features(text):
        w = "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in (text or "")).translate({c: c + 32 for c in range(65, 91)}).split()
        m, code = (1 << 64) - 1, [hash64(x.encode()) for x in w]
        skip, near, pair = int(toxicity._SKIP), int(toxicity._NEXT), int(toxicity._PAIR)
        out = [h * skip for h in code] + [hash64(b"^" + x.encode()[: toxicity.STEM]) * skip for x in w]
        out += [((a * pair & m) + b) * near for a, b in zip(code, code[1:])] + [((a * near & m) + b) * pair for a, b in zip(code, code[2:])]
        return sorted({(x & m) >> (64 - toxicity.BITS) for x in out})

    order = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long").select("doc_id", F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1_000_000)).alias("h")).collect()}
    walk = [(features(t), y) for (i, t, _), (_, y) in sorted(zip(rows, labels), key=lambda r: order[r[0][0]])]
    z, n = {}, {}
    last, l1, support = 1 << toxicity.BITS, toxicity.L1, None

    def weight(k):
        if k == last:
            return -z.get(k, 0.0) / ((toxicity.BETA + n.get(k, 0.0) ** 0.5) / toxicity.ALPHA)
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= l1 else (np.sign(v) * l1 - v) / ((toxicity.BETA + n.get(k, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for k in range(toxicity.ROUNDS + 1):
        if k == toxicity.ROUNDS:
            support = {b for b, v in z.items() if abs(v) > l1 or b == last}
            z = {b: z[b] if b == last else z[b] - np.sign(z[b]) * l1 for b in support}
            n = {b: n[b] for b in support}
            l1 = 0.0
        for f, y in walk:
            at = [b for b in [*f, last] if support is None or b in support]
            w = {b: weight(b) for b in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for b in at:
                before = n.get(b, 0.0)
                z[b] = z.get(b, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / toxicity.ALPHA * w[b]
                n[b] = before + g * g
        z, n = {b: float(np.float32(v)) for b, v in z.items()}, {b: float(np.float32(v)) for b, v in n.items()}
    assert set(model.at) == {b for b in z if b != last and z[b] != 0} and len(model.at) > 3
    assert np.allclose([model.values[list(model.at).index(b)] for b in model.at], [weight(b) for b in model.at], rtol=1e-4)
    scored, name = toxicity.score_documents(docs_of(spark, rows), model)
    got = {r["doc_id"]: r[name] for r in scored.collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-sum(weight(b) for b in [*features(t), last])))) < 1e-5 for i, t, _ in rows)


def test_gradients_match_differences():
    class V:
        head_counts, tail_mass = np.arange(lm.HEAD, 0, -1.0), np.ones(lm.TAILS)

    model = lm.Gru(V())
    rng = np.random.default_rng(10)
    for k in model.p:
        model.p[k] = (model.p[k] + rng.normal(size=model.p[k].shape) * 0.1).astype(np.float64)
    x, y = rng.integers(0, 40, (6, 3)), rng.integers(0, 40, (6, 3))
    y[2, 1] = lm.HEAD + 3
    valid, h0 = np.ones((6, 3), bool), np.zeros((3, lm.STATE))

    def loss():
        states, _, _ = model.run(x, h0)
        return -model.log_probs(states[valid].astype(float), y[valid]).mean()

    g, _ = model.gradients(x, y, valid, h0)
    for k, at in (("U", (3, 5)), ("W", (2, 30)), ("b", (7,)), ("C", (1, 0)), ("D", (0, 4, 9)), ("E", (int(x[1, 1]), 3))):
        old = model.p[k][at]
        model.p[k][at] = old + 1e-3
        up = loss()
        model.p[k][at] = old - 1e-3
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-4 + 0.02 * abs(g[k][at])


def plain_tokens(text):
    """Words between ASCII white space, A-Z lower-cased, and an end."""
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))] + [lm.END]


def test_lm_tokens():
    texts = ["", " a  B\tÀ\x0bb ", None, "x\u2003y\x1cz", "\n", "İI K"]
    t = lm.Tokens(pa.array(texts, pa.string()))
    words = t.words.to_pylist()
    got = [[words[i] for i in t.at[e - n : e]] for e, n in zip(t.ends, t.sizes)]
    assert got == [plain_tokens(x) for x in texts]
    assert len(lm.Tokens(pa.array([], pa.string())).sizes) == 0
    every = [w for w in words if w not in (lm.END, b"")]
    assert lm.tail_classes(pa.array(every, pa.binary())).tolist() == [(w[-1] * 7 + w[-2:][0] * 31 + len(w) // 6) % lm.TAILS for w in every]


def plain_score(model, v, counts, text):
    """log10 probability of a text, word by word, from the definition."""
    head, sigmoid = {w: i for i, w in enumerate(v.head.to_pylist())}, lambda x: 1 / (1 + np.exp(-x))
    p, s, per = {k: x.astype(float) for k, x in model.p.items()}, lm.STATE, lm.HEAD // lm.CLASSES
    h, last, total = np.zeros(s), lm.HEAD + lm.TAILS, 0.0
    for w in plain_tokens(text):
        a, r = p["E"][last] @ p["W"] + p["b"], h @ p["U"]
        z, reset = sigmoid(a[:s] + r[:s]), sigmoid(a[s : 2 * s] + r[s : 2 * s])
        h = z * h + (1 - z) * np.tanh(a[2 * s :] + reset * r[2 * s :])
        last = head.get(w, lm.HEAD + (w[-1] * 7 + w[-2:][0] * 31 + len(w) // 6) % lm.TAILS)
        k = last // per if last < lm.HEAD else last - lm.HEAD + lm.CLASSES
        logits = h @ p["C"] + p["c"]
        total += logits[k] - np.log(np.exp(logits).sum())
        if last < lm.HEAD:
            logits = h @ p["D"][k] + p["d"][k]
            total += logits[last % per] - np.log(np.exp(logits).sum())
        else:
            total += np.log((counts.get(w, 0) + 0.5) / v.tail_mass[last - lm.HEAD])
    return total / np.log(10)


def test_lm_base_windows_and_scores(spark, odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(lm, "LISTED", 2_500)  # some words of the table are beyond the list
    learned = df.where("doc_id % 2 = 0").select("doc_id", "text")
    counts = lm.word_counts(learned)
    v = lm.Vocabulary(counts)
    model = lm.train(learned, v)
    got = lm.with_rare_words(lm.score_documents(df.select("doc_id", "text"), v, model), counts, v).collect()
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    n = sum(c.values())
    want = sorted((i or -1, len(plain_tokens(t)), sum(np.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (len(c) + 1))) for w in plain_tokens(t)), sum(w in c for w in plain_tokens(t))) for i, t, _ in rows)
    have = sorted((r["doc_id"] or -1, r["n_tokens"], r["base_score"], r["n_known"]) for r in got)
    assert [x[:2] for x in want] == [x[:2] for x in have] and [x[3] for x in want] == [x[3] for x in have] and np.allclose([x[2] for x in want], [x[2] for x in have])
    plain = sorted((r[0] or -1, plain_score(model, v, c, r[1])) for r in rows if len(r[1] or "") < 5_000)
    short = {(r[0] or -1) for r in rows if len(r[1] or "") < 5_000}
    near = sorted((r["doc_id"] or -1, r["score"]) for r in got if (r["doc_id"] or -1) in short)
    assert len(plain) == len(near) and np.allclose([x[1] for x in plain], [x[1] for x in near], rtol=1e-4, atol=1e-3)
    assert lm.score_documents(docs_of(spark, []), v, model).count() == 0


def test_lm_without_training_text(spark, odd):
    none = odd[1].select("doc_id", "text").limit(0)
    counts = lm.word_counts(none)
    v = lm.Vocabulary(counts)
    got = lm.with_rare_words(lm.score_documents(odd[1].select("doc_id", "text"), v, lm.train(none, v)), counts, v).collect()
    assert len(got) == len(odd[0]) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-6 and r["score"] < 0 for r in got)


def test_lm_walks_every_training_document(spark):
    # each word opens six of 9,000 documents; a word's embedding moves only where a document that holds it is walked
    docs = docs_of(spark, [(i, "w%d x" % (i % 1500), "s") for i in range(9000)]).select("doc_id", "text")
    v = lm.Vocabulary(lm.word_counts(docs))
    moved = (lm.train(docs, v).p["E"] != lm.Gru(v).p["E"]).any(1)
    head = v.head.to_pylist()
    assert len(head) == 1502 and all(moved[i] for i, w in enumerate(head) if w.startswith(b"w"))


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    rng = np.random.default_rng(14)
    docs = docs_of(spark, [(i, words(rng, 30), "s") for i in range(300)]).select("doc_id", "text")
    monkeypatch.setattr(lm, "REPLICA", 60)
    v = lm.Vocabulary(lm.word_counts(docs))
    one, many = lm.train(docs.coalesce(1), v), lm.train(docs.repartition(7), v)
    assert all(np.allclose(one.p[k], many.p[k], atol=1e-6) for k in one.p)


def distorted(rng, samples, values):
    """The ways in which a recording comes back."""
    yield samples + rng.normal(size=len(samples)) * 0.4
    yield np.r_[rng.normal(size=37 * chroma.HOP) * 0.3, samples[: -37 * chroma.HOP]] + rng.normal(size=len(samples)) * 0.2
    yield samples[29:]
    yield 0.5 * samples + 0.3 * np.r_[np.zeros(150), samples[:-150]]
    other = np.where(rng.random(len(values)) < 0.15, rng.normal(size=len(values)) * 0.125, values)
    yield chroma.tones(other)


def test_chroma_alignments_and_recall_against_brute_force(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    rng = np.random.default_rng(11)
    base = [np.array(r["embedding"]) for r in spark.read.parquet(path).orderBy("vec_id").limit(40).collect()] if os.path.exists(path) else list(rng.normal(size=(40, 64)) * 0.125)
    recordings = [chroma.tones(v) for v in base]
    recordings += [x for v in base for x in distorted(rng, chroma.tones(v), v)]
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(recordings)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, place int").repartition(6)
    prints = chroma.fingerprints(df, "vec_id", "embedding", recording=lambda v: v).cache()
    keys = {r["id"]: r["class_key"] for r in prints.collect()}
    links = chroma.align(prints.select("class_key", "codes").dropDuplicates(["class_key"]), prints.where("id < 40").select("class_key").distinct())
    links = {(r["query"], r["class_key"]): (r["error_rate"], r["overlap"], r["offset"]) for r in links.collect()}
    codes = [chroma.codes(r).view(np.int32) for r in recordings]
    found = total = 0
    for a in range(40):
        for b in range(len(recordings)):
            if keys[a] == keys[b]:
                continue
            best = None
            for off in range(-len(codes[a]), len(codes[b])):
                e, o = chroma.bit_errors(codes[a], codes[b], off)
                if o >= chroma.LEAST_OVERLAP and e <= chroma.MOST_ERRORS * 32 * o:
                    best = min(best or (2, 0, 0), (e / (32 * o), -o, off))
            got = links.get((keys[a], keys[b]))
            assert not got or best
            if best:
                total += 1
                found += got is not None and abs(got[0] - best[0]) < 1e-12
    assert total >= 120 and found >= 0.9 * total, (found, total)


def test_chroma_edge_cases_and_salted_join(spark, monkeypatch):
    rng = np.random.default_rng(16)
    base = rng.normal(size=(30, 64)) * 0.125
    near = base + (rng.random(base.shape) < 0.04) * rng.normal(size=base.shape) * 0.05
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate([*base, *near, base[0], base[0]])] + [(500, None), (501, []), (502, [0.1] * 2), (503, [0.0] * 64), (504, [None] * 64), (None, [0.0] * 64), (3, [float(x) for x in base[5]])]
    df = spark.createDataFrame([(*v, "x", 1, 2) for v in vectors], "vec_id long, embedding array<double>, codes string, class_key int, entry int").repartition(3)
    rows, links = chroma.search(df, "vec_id", "embedding", lambda i: i < 30)
    got = rows.collect()
    assert len(got) == len(vectors) and {r["class_id"] for r in got if r["id"] in (0, 60, 61)} == {0} and {r["class_id"] for r in got if r["id"] in (500, 501, 502)} == {None}
    assert {r["class_id"] for r in got if r["id"] in (503, 504, None)} == {503} and {r["class_id"] for r in got if r["id"] == 3} == {3}
    plain = sorted(links.collect())
    of = {r["id"]: r["class_id"] for r in got}
    assert {(r["class_id"], r["match_class"]) for r in plain} >= {(i, 30 + i) for i in range(30) if i not in (3, 5) and of[30 + i] == 30 + i}
    monkeypatch.setattr(chroma, "ASKED", 10)
    monkeypatch.setattr(chroma, "ASKED_CODES", 10)
    assert sorted(chroma.search(df, "vec_id", "embedding", lambda i: i < 30)[1].collect()) == plain
    rows, links = chroma.search(df.limit(0), "vec_id", "embedding", lambda i: i < 5)
    assert rows.count() == links.count() == 0


def test_pipeline_against_plain_version(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        rows.append((i, words(rng, 3).upper() * 12 + " ### !!" * 30 if bad else words(rng, 70), "s%d" % (i % 3)))
        if zlib.crc32(str(i).encode()) % 5 and i < 200:
            labels.append((i, int(not bad), 0))
    item = words(rng, 20)
    rows += [(300, rows[1][1], "s1"), (301, rows[1][1] + " more", "s1"), (302, item + " " + words(rng, 60), "s2"), (303, words(rng, 60) + ' token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "s2"), (1, rows[1][1], "s1"), (7, words(rng, 50), "s1")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = []
    seen = set()
    for i, t, s in sorted(rows):
        if "###" in t or item in t or t.removesuffix(" more") in seen:
            continue
        seen.add(t)
        kept.append((i, re.sub(r"[0-9a-f]{40}", "[SECRET]", t), s))
    texts = {(i, t) for i, t, _ in kept}
    assert {(r["doc_id"], r["text"]) for r in got} <= texts
    plan, name = mixing.mix_plan(docs_of(spark, kept))
    want = sorted((r["doc_id"], r["text"]) for r in plan.collect() for _ in range(r[name]["copies"]))
    assert sorted((r["doc_id"], r["text"]) for r in got) == want


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, df = odd
    df = df.withColumn("quality_score", F.lit("q")).withColumn("text_key", F.lit(1)).withColumn("gone_id", F.lit(2)).withColumn("has_secret", F.lit("h")).withColumn("mix_copy", F.lit(0))
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "a template of four words that is not there 12 34"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda d: sorted((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in d.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert set(texts(out)) <= set(texts(df)), name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
        if name in ("benchmark_decontamination", "secret_scan"):
            assert texts(out) == texts(df)
        if name == "ngram_jaccard_join":
            kept = texts(out)
            # one of the copies of the body, one of the pair of two words, every text without words, and what is like nothing else
            assert sum(t == rows[0][1] or t == rows[0][1] + " tail" for _, t, _ in kept) == 1 and sum(t == "one two" for _, t, _ in kept) == 1
            assert sum(not t.strip() or t == "None" for _, t, _ in kept) == 3 and len(kept) == 9


def test_mixing_of_many_sources(spark):
    # more sources than a window's task should hold is nothing a test can show; that all of them are weighed in order is
    rows = [(i, "w " * (i % 7), "s%03d" % (i % 50), None, None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, a int, mix_source int")
    planned, name = mixing.mix_plan(df)
    got = {r["source"]: (r[name]["target"], r[name]["source_size"]) for r in planned.collect()}
    total, sizes = sum(i % 7 for i in range(400)), {s: v[1] for s, v in got.items()}
    free, left, target = set(sizes), float(total), {}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes))}
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}
        if not over:
            break
        target.update({s: 3.0 * sizes[s] for s in over})
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    target.update({s: left * weight[s] / sum(weight[x] for x in free) for s in free})
    assert all(abs(got[s][0] - target[s]) < 1e-9 for s in sizes)
