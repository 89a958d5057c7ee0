"""License scans: phrases found word by word, and an exact set-similarity join of text blocks with license templates.

A block (a line by default, or a paragraph, or a run of lines) matches a template when it holds at least ``threshold`` of the template's
distinct words. The join is exact and finds its pairs by filters only: every template's words are put in one global
order, rarest first by their count over all documents, so that

* prefix filter: a block that holds ``need`` of a template's ``k`` words holds one of its first ``k - need + 1``;
* length filter: it has at least ``need`` distinct template words;
* positional filter: after a match at place i of the template and j of the block (both in the global order), the words
  left on either side still have to reach ``need``.

The counts come from one pass over all documents, summed by word before they are sent on; their number is bounded by
the templates' words. Blocks are never compared with each other.

Runs are for notices that are wrapped: a line that matches is a block of its own; lines that don't match alone and follow
each other are blocks of as many lines as hold the longest template, whatever line of them it begins in. The match is
then narrowed to the fewest lines that hold as much, and no line is in two matching runs. Lines without words don't count.

All matching blocks and templates are listed; a block's label is that of the template it holds most of (all on a tie).

Defined results: a null or empty text has no words, labels or hits and score 0; repeated rows and template names are
kept as they are; a template without words never matches; very long texts are scanned whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship
from . import words as W

#: Phrases whose words, standing consecutively, give the label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices in the words in which they are usually given: label, text.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
#: Share of a template's distinct words that a matching block holds.
THRESHOLD = 0.85

_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_OUT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("blocks", pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("containment", pa.float64())])))]
_OUT_DDL = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:array<string>,labels:array<string>,score:double,blocks:array<struct<label:string,line:long,containment:double>>>"


def _hashes(text: str) -> np.ndarray:
    return W.words_of(text, W.ALNUM).hashes


def block_ids(c: W.Chunk, w: W.Words, block: str) -> tuple[np.ndarray, np.ndarray]:
    """For each word the block it is in (numbered over the chunk), and for each block its first line within its text.

    A line ends at a line end or where its text ends; a paragraph ends at a blank line.
    """
    n = len(c.data)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(~_LINE[c.data], out=total[1:])
    ends = total[w.starts]  # line ends before the word, in the chunk
    if block == "paragraph" and n:
        solid = np.zeros(n + 1, np.int64)
        np.cumsum(W.SOLID[c.data], out=solid[1:])
        at = np.flatnonzero(~_LINE[c.data])
        blank = np.zeros(len(at) + 1, np.int64)  # of the lines that these line ends close, those without a word, so far
        begin = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
        np.cumsum(solid[at] == solid[begin], out=blank[1:])
        key = blank[ends]
    else:
        key = ends
    new = np.ones(len(ends), bool)
    new[1:] = (key[1:] != key[:-1]) | (w.doc[1:] != w.doc[:-1])
    ids = np.cumsum(new) - 1
    return ids, (ends - total[c.offsets[:-1]][w.doc])[new]


class Templates:
    """Templates over a global word order: ``count`` gives each word's number over the corpus."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float, count: dict[int, int] | None = None):
        count = count or {}
        sets = [(label, set(_hashes(text).tolist())) for label, text in templates]
        self.order = sorted({h for _, s in sets for h in s}, key=lambda h: (count.get(h, 0), h))
        self.place = {h: i for i, h in enumerate(self.order)}
        self.labels = [label for label, s in sets if s]
        self.words = [sorted(self.place[h] for h in s) for _, s in sets if s]
        self.need = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in self.words]
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (words, need) in enumerate(zip(self.words, self.need, strict=True)):
            for i, p in enumerate(words[: len(words) - need + 1]):
                self.prefix[p].append((t, i))
        self.least = min(self.need, default=1)
        self.longest = max((len(_hashes(text)) for _, text in templates), default=0)
        self.first = np.zeros(len(self.order), bool)  # words of any prefix
        self.first[list(self.prefix)] = True
        self.set = W.HashSet(np.array(self.order, np.uint64))
        self.to_place = np.array([self.place[int(h)] for h in self.set.keys], np.int64)

    def match(self, block: list[int]) -> list[tuple[int, float]]:
        """Templates that a block holds, given its distinct template words in the global order, and how much of each."""
        seen: dict[int, int] = {}
        size = len(block)
        for j, p in enumerate(block):
            for t, i in self.prefix.get(p, ()):
                if size < self.need[t] or seen.get(t, 0) < 0:
                    continue
                so_far = seen.get(t, 0) + 1
                left = min(len(self.words[t]) - i - 1, size - j - 1)
                seen[t] = so_far if so_far + left >= self.need[t] else -1
        out = []
        for t, so_far in seen.items():
            if so_far > 0:
                overlap = len(set(block).intersection(self.words[t]))
                if overlap >= self.need[t]:
                    out.append((t, overlap / len(self.words[t])))
        return out


def runs(t: Templates, ids: np.ndarray, doc: np.ndarray, at: np.ndarray, place: np.ndarray, alone: set[int]) -> Iterator[tuple[int, list[tuple[int, float]]]]:
    """First line and matches of each run of lines that holds a template.

    ``ids`` and ``doc`` give each word's line and text, ``at`` and ``place`` the template words and their places in the
    global order, ``alone`` the lines that match by themselves.
    """
    held = ids[at]
    n = int(ids[-1]) + 1
    begin = np.searchsorted(ids, np.arange(n + 1))
    edge = np.zeros(n + 1, bool)  # a run ends before these lines: other texts and lines that match
    edge[n] = True
    edge[1:n] = doc[begin[1:n]] != doc[begin[1:n] - 1]
    single = np.zeros(n + 1, bool)
    single[list(alone)] = True
    stop = np.minimum.accumulate(np.where(edge | single, np.arange(n + 1), n)[::-1])[::-1]
    end = np.minimum(np.searchsorted(begin, begin[1:] + t.longest), stop[1:])
    rare = np.append(0, np.cumsum(np.bincount(held[t.first[place]], minlength=n)))
    every = np.append(0, np.cumsum(np.bincount(held, minlength=n)))
    line = np.arange(n)
    may = ~single[:n] & (end > line + 1) & (rare[end] > rare[:n]) & (every[end] - every[:n] >= t.least)

    def match(i: int, j: int) -> list[tuple[int, float]]:
        block = np.unique(place[every[i] : every[j]]).tolist()
        return t.match(block) if len(block) >= t.least else []

    best = lambda found: max((share for _, share in found), default=0.0)
    taken = n
    for i in np.flatnonzero(may)[::-1].tolist():
        if i >= taken:
            continue
        j = min(int(end[i]), taken)
        found = match(i, j)
        if not found:
            continue
        while i and not edge[i] and not single[i - 1] and best(wider := match(i - 1, j)) > best(found):
            i, found = i - 1, wider
        while j > i + 1 and best(less := match(i, j - 1)) >= best(found):
            j, found = j - 1, less
        taken = i
        yield i, found


def count_words(docs: DataFrame, keys: np.ndarray, text_col: str = "text") -> dict[int, int]:
    """How often each of some word hashes occurs over all texts; summed on the way, so that their number is sent."""
    found = W.HashSet(keys)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(found.keys), np.int64)
        for b in batches:
            for c in W.chunks(b.column(0)):
                _, k = found.find(W.split(c, W.ALNUM).hashes)
                total += np.bincount(k, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys[at].view(np.int64)), pa.array(total[at])], ["h", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["h"]).view(np.uint64)): r["n"] for r in rows}


def scanner(templates: Templates, phrases: dict[str, str], block: str):
    """The scan of one Arrow column."""
    parts = [(_hashes(p), label) for p, label in phrases.items()]
    parts = [(len(h), W.window_hash(h), W.words_of(p, W.ALNUM).joined(0, len(h)), label) for (h, label), p in zip(parts, phrases, strict=True) if len(h)]

    def scan(text: pa.Array) -> pa.Array:
        rows = []
        for c in W.chunks(text):
            w = W.split(c, W.ALNUM)
            begin = w.first_of()
            got = [{"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base_labels": set(), "labels": set(), "score": 0.0, "blocks": []} for n in np.diff(begin)]
            for size, want, words, label in parts:
                hashes, at = W.windows(w.hashes, w.doc, size)
                for i in at[hashes == np.uint64(want)].tolist():
                    if w.joined(i, size) == words:
                        r, place = got[w.doc[i]], i - int(begin[w.doc[i]])
                        r["n_base"] += 1
                        r["first_word"] = place if r["first_word"] is None else min(place, r["first_word"])
                        r["last_word"] = place if r["last_word"] is None else max(place, r["last_word"])
                        r["base_labels"].add(label)
            at, k = templates.set.find(w.hashes)
            if len(at):
                ids, line = block_ids(c, w, block)
                alone = {}
                pairs = np.unique(ids[at] * len(templates.order) + templates.to_place[k])
                blocks, places = np.divmod(pairs, len(templates.order))
                cut = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
                first_word = np.searchsorted(ids, blocks[cut])
                for a, b, word in zip(cut, np.append(cut[1:], len(blocks)), first_word, strict=True):
                    if b - a >= templates.least:
                        r = got[w.doc[word]]
                        alone[int(blocks[a])] = r, templates.match(places[a:b].tolist())
                alone = {b: v for b, v in alone.items() if v[1]}
                if block == "run":
                    alone |= {b: (got[w.doc[np.searchsorted(ids, b)]], m) for b, m in runs(templates, ids, w.doc, at, templates.to_place[k], set(alone))}
                for b, (r, matches) in sorted(alone.items(), key=lambda x: x[0]):
                    best = max(share for _, share in matches)
                    r["score"] = max(r["score"], best)
                    for t, share in matches:
                        if share == best:  # a version 3 notice also holds most words of the version 2 one
                            r["labels"].add(templates.labels[t])
                        r["blocks"].append({"label": templates.labels[t], "line": int(line[b]), "containment": share})
            for r in got:
                r["labels"] = sorted(r["labels"] | r["base_labels"])
                r["base_labels"] = sorted(r["base_labels"])
            rows += got
        return pa.array(rows, pa.struct(_OUT))

    return scan


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, block: str = "line", text_col: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` with a column ``out``: phrase places, labels of both kinds, the best containment, and matching blocks."""
    ship(docs.sparkSession)
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_hashes(t) for _, t in templates)]))
    order = Templates(templates, threshold, count_words(docs, keys, text_col))
    return docs.withColumn(out, arrow_udf(W.bounded(scanner(order, phrases, block)), returnType=_OUT_DDL).asNondeterministic()(F.col(text_col)))


def op3_license_scans(spark, sf_dir: str) -> DataFrame:
    """Every document with its license places and labels; OP3_SQL compares single lines only, so it has no wrapped notices."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = F.col("licenses")
    joined = lambda f: F.array_join(r[f], ",").alias(f)
    return scan_licenses(docs, block="run").select("doc_id", *[r[f].alias(f) for f in ("n_words", "n_base", "first_word", "last_word")], joined("base_labels"), joined("labels"), r["score"].alias("score"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CLASS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    phrases = ", ".join(f"({quote(label)}, string_split({quote(p)}, ' '))" for p, label in PHRASES.items())
    templates = ", ".join(f"({i}, {quote(label)}, {quote(text)})" for i, (label, text) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOW} AS low FROM documents),
w AS (SELECT rid, doc_id, low, regexp_extract_all(low, {_CLASS}) AS w FROM d),
hit AS (SELECT rid, label, i - 1 AS place FROM (SELECT rid, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM w, (VALUES {phrases}) AS q(label, p) WHERE len(w) >= len(p)) t WHERE w[i : i + len(p) - 1] = p),
base AS (SELECT rid, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY rid),
t AS (SELECT label, list_distinct(regexp_extract_all({_LOW.replace("text", "tx")}, {_CLASS})) AS words FROM (VALUES {templates}) AS q(i, label, tx)),
line AS (SELECT rid, i, list_distinct(regexp_extract_all(string_split(low, chr(10))[i], {_CLASS})) AS words FROM (SELECT rid, low, unnest(range(1, len(string_split(low, chr(10))) + 1)) AS i FROM d)),
near AS (SELECT rid, i, label, len(list_intersect(line.words, t.words)) / len(t.words) AS share FROM line, t WHERE len(list_intersect(line.words, t.words)) >= ceil({THRESHOLD} * len(t.words) - 1e-9)),
best AS (SELECT rid, label, share FROM (SELECT *, max(share) OVER (PARTITION BY rid, i) AS top FROM near) n WHERE share = top),
lab AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM best UNION SELECT rid, label FROM hit) l GROUP BY rid),
sc AS (SELECT rid, max(share) AS score FROM best GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN lab USING (rid) LEFT JOIN sc USING (rid)
"""


OP3_SQL = _sql()
