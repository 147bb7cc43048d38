"""License scans: phrase places and an exact set-similarity join against notice templates.

Templates are fixed notices. Tokens of a template are ordered by how many
documents of the whole corpus hold them, rarest first. Text blocks are
overlapping runs of words, however lines are broken: for templates of up to c
words (c: 8, 16, 32 ...), every c words a block of 2c words begins, so any run of
c words lies whole in a block. A block contains a template when at least
`threshold` of the template's distinct tokens are in it. A block that does must
share a token with the template's prefix, its first |T| - ceil(threshold |T|) +
1 tokens in that order; the prefix tokens are a hash index, and the length filter
(tokens the block has of the templates' vocabulary) and the positional filter
(tokens left after the first shared one on either side) discard pairs before
overlaps are counted. The filters are exact: they drop no pair that meets the
threshold.

Only DataFrame expressions are used. The template list is fixed, so its index is
a literal in the plan and nothing is shuffled but the template tokens' counts.

Edge cases: null and empty texts have no words, no places and no labels, score
0; a text of fewer words than a block is one block, a very long one, with or
without line breaks, as many as its words ask for; tokens that equally many
documents hold are ordered by themselves; repeated rows are rows of their own; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.columns import fresh

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
)

#: What separates words: ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case words of text. lower() also maps letters beyond A-Z; no count or phrase depends on those."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def template_tokens(text: str) -> list[str]:
    return sorted(set(template_words(text)))


def block_class(text: str) -> int:
    """The power of two, 8 at least, that is no shorter than a notice in words."""
    return max(8, 1 << (len(template_words(text)) - 1).bit_length())


def token_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each token of the vocabulary, over all documents."""
    held = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def index(counts: dict[str, int], templates=TEMPLATES, threshold: float = 0.8) -> tuple[dict[str, int], list[dict]]:
    """Rank of each token in the global order, and the templates: label, ordered tokens, required overlap, prefix length, class."""
    parsed = [(label, template_tokens(text), block_class(text)) for label, text in templates]
    rank = {t: i for i, t in enumerate(sorted({t for _, ts, _ in parsed for t in ts}, key=lambda t: (counts.get(t, 0), t)))}
    made = []
    for label, tokens, words_at_most in parsed:
        need = ceil(threshold * len(tokens) - 1e-9)
        made.append({"label": label, "tokens": sorted(tokens, key=rank.get), "need": need, "prefix": len(tokens) - need + 1, "class": words_at_most})
    return rank, made


def _strings(values) -> str:
    return "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def template_hits(block: str, rank: dict[str, int], templates: list[dict]) -> str:
    """SQL: array of (label, containment) of the templates that the block with those words contains.

    Block tokens in the vocabulary become their ranks, sorted: the block in
    global order. The index maps the rank of a prefix token to its postings
    (template, place of the token in it).
    """
    own = {x for t in templates for x in t["tokens"]}
    order = sorted(own, key=rank.get)
    rank = {t: i for i, t in enumerate(order)}
    postings: dict[int, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        for place, token in enumerate(template["tokens"][: template["prefix"]]):
            postings.setdefault(rank[token], []).append((t, place))
    ranks_of = f"array_sort(transform(array_intersect({block}, {_strings(order)}), w -> array_position({_strings(order)}, w) - 1))"
    index_sql = "map(" + ", ".join(f"{r}L, array({', '.join(f'named_struct("t", {t}, "place", {p})' for t, p in ps)})" for r, ps in sorted(postings.items())) + ")"
    lists = "array(" + ", ".join("array(" + ", ".join(f"{rank[x]}L" for x in t["tokens"]) + ")" for t in templates) + ")"
    needs = "array(" + ", ".join(str(t["need"]) for t in templates) + ")"
    labels = _strings(t["label"] for t in templates)
    # candidates: template, place in the template and in the block of each shared prefix token, within length and positional bounds
    candidates = f"""flatten(transform(bv, (r, q) -> transform(filter(coalesce(element_at({index_sql}, r), array()),
        h -> size(bv) >= {needs}[h.t] AND least(size({lists}[h.t]) - h.place, size(bv) - q) >= {needs}[h.t]), h -> h.t)))"""
    return f"""flatten(transform(array({ranks_of}), bv -> transform(filter(array_distinct({candidates}),
        t -> size(array_intersect(bv, {lists}[t])) >= {needs}[t]),
        t -> named_struct('label', {labels}[t], 'containment', size(array_intersect(bv, {lists}[t])) / cast(size({lists}[t]) AS double)))))"""


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> tuple[DataFrame, str]:
    """docs with a struct column, and that column's name.

    The struct has n_words, places (array of phrase, label, count, first, last),
    and templates (array of label, containment; one for each block and template).
    """
    vocabulary = sorted({t for _, text in templates for t in template_tokens(text)})
    rank, made = index(token_counts(docs, vocabulary), templates, threshold)
    name, ws = fresh(docs, "license_scan"), fresh(docs, "license_words")
    probe = sorted({x for t in made for x in t["tokens"][: t["prefix"]]})
    joined = f"concat(' ', concat_ws('  ', {ws}), ' ')"

    def n_words(part: str) -> str:
        return f"cast((length({part}) - length(replace({part}, ' ', ''))) / 2 AS bigint)"

    def place(phrase: str, label: str) -> str:
        marked = "' " + "  ".join(phrase.split()) + " '"
        return f"""named_struct('phrase', '{phrase}', 'label', '{label}',
            'count', cast((length(j) - length(replace(j, {marked}, ''))) / length({marked}) AS bigint),
            'first', {n_words(f"substring_index(j, {marked}, 1)")},
            'last', size({ws}) - {n_words(f"substring_index(j, {marked}, -1)")} - {len(phrase.split())})"""

    last_words = sorted({p.split()[-1] for p in phrases})
    places = f"""CASE WHEN arrays_overlap({ws}, {_strings(last_words)}) THEN
        filter(flatten(transform(array({joined}), j -> array({", ".join(place(p, x) for p, x in phrases.items())}))), p -> p.count > 0) END"""
    size = f"size({ws})"

    def class_hits(c: int) -> str:
        own = [t for t in made if t["class"] == c]
        first = _strings(sorted({x for t in own for x in t["tokens"][: t["prefix"]]}))
        blocks = f"transform(sequence(0, greatest({size} - 1, 0) div {c}), k -> slice({ws}, k * {c} + 1, {2 * c}))"
        return f"flatten(transform(filter({blocks}, block -> arrays_overlap(block, {first})), block -> {template_hits('block', rank, own)}))"

    hits = f"CASE WHEN arrays_overlap({ws}, {_strings(probe)}) THEN concat({', '.join(class_hits(c) for c in sorted({t['class'] for t in made}))}) END"
    none_placed = "cast(array() AS array<struct<phrase:string,label:string,count:bigint,first:bigint,last:bigint>>)"
    none_hit = "cast(array() AS array<struct<label:string,containment:double>>)"
    out = F.expr(f"named_struct('n_words', cast(size({ws}) AS bigint), 'places', coalesce({places}, {none_placed}), 'templates', coalesce({hits}, {none_hit}))")
    return docs.withColumn(ws, words(F.col("text"))).withColumn(name, out).drop(ws), name
