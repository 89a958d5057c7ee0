"""Quality rules with a suffix-array measure of repetition.

Each text becomes a string of word ids. A suffix array over those (prefix doubling, re-sorting only suffixes that are
still tied) and its longest-common-prefix values give every maximal repeated word string; the union of their spans is
what a text repeats of itself. A text fails on too large a covered share, too long a repeat, or the plainer ratios.
The suffix array is built over a run of whole texts at once, keyed by text, so that it is vector work; a match never
crosses from one text to another.

Defined results: a null or empty text has no words, all counts 0, and is not kept; repeated rows each get their own
result; very long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship
from . import words as W

#: [#*$%&|<>]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


@dataclass(frozen=True)
class Rules:
    """Limits of the method's verdict; shares are of a text's words."""

    min_words: int = 50
    #: Share of words in 3-word windows that occur twice or more.
    max_repeat_share: float = 0.5
    #: Repeats of at least this many words count as copied passages ...
    passage_words: int = 10
    #: ... which may cover this share of the words at most ...
    max_passage_share: float = 0.45
    #: ... and of which none may be longer than this share of the words.
    max_longest_share: float = 0.3
    max_symbols_per_word: float = 0.1
    min_word_chars: float = 2.0
    max_word_chars: float = 20.0


def suffix_array(keys: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``keys`` where the suffix at i ends before stop[i], and the ranks of each doubling step.

    Ranks are the first place of a suffix's group in the array, so a step only touches groups of two or more.
    """
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[sa[1:]] != keys[sa[:-1]]
    slot = np.arange(n)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    levels = [rank]
    tied = ~(new & np.append(new[1:], True)) if n else np.zeros(0, bool)
    active, slots, k = sa[tied], slot[tied], 1
    while len(active):
        after = active + k
        inside = after < stop[active]
        second = np.where(inside, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        both = rank[active].astype(np.int64) * (n + 1) + second
        o = np.argsort(both, kind="stable")
        active, both = active[o], both[o]
        sa[slots] = active
        new = np.ones(len(active), bool)
        new[1:] = both[1:] != both[:-1]
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append(rank)
        tied = ~(new & np.append(new[1:], True))
        active, slots, k = active[tied], slots[tied], 2 * k
    return sa, levels


def lcp_array(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in ``sa``."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    i, j, length = sa[at - 1].copy(), sa[at].copy(), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        ok = (i < n) & (j < n)
        same = ok & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        step = same.astype(np.int64) << k
        i, j, length = i + step, j + step, length + step
    out[at] = length
    return out


def longest_repeats(w: W.Words) -> np.ndarray:
    """For each word, the length of the longest word string from there that occurs elsewhere in its text."""
    begin = w.first_of()
    keys = W.mix(w.hashes + w.doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    sa, levels = suffix_array(keys, begin[1:][w.doc])
    lcp = lcp_array(sa, levels)
    out = np.zeros(len(keys), np.int64)
    out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Words inside the union of all repeats of at least ``least`` words."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    steps = np.zeros(n + 1, np.int64)
    steps += np.bincount(at, minlength=n + 1)
    steps -= np.bincount(at + longest[at], minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def maximal_repeats(text: str | None, least: int = 3) -> list[tuple[str, int]]:
    """Maximal repeated word strings of a text, with their number of places: one per lcp interval."""
    w = W.words_of(text, W.SOLID, W.SAME)
    sa, levels = suffix_array(w.hashes, np.full(len(w.starts), len(w.starts)))
    lcp = lcp_array(sa, levels)
    out, stack = [], []
    for t in range(1, len(sa) + 1):
        depth, left = int(lcp[t]) if t < len(sa) else 0, t - 1
        while stack and stack[-1][0] > depth:
            length, left = stack.pop()
            before = {int(w.hashes[p - 1]) if p else -1 for p in sa[left:t]}
            if length >= least and len(before) > 1:
                out.append((w.joined(int(sa[left]), length).decode("utf-8", "replace"), t - left))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return sorted(out)


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_passage_words", "longest_repeat")
_KIND = "struct<" + ",".join(f"{f}:long" for f in _FIELDS) + ">"


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure_chunk(c: W.Chunk, passage_words: int) -> np.ndarray:
    """The measures of each text of a chunk, one column per field."""
    w = W.split(c, W.SOLID, W.SAME)
    begin, n = w.first_of(), len(c)
    solid = W.SOLID[c.data]
    chars = _per_text(solid & ((c.data & 0xC0) != 0x80), c.offsets)
    symbols = _per_text(SYMBOLS[c.data], c.offsets)
    lines = W.split(c, NOT_NEWLINE, W.SAME)
    total = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(solid, out=total[1:])
    full = total[lines.ends] > total[lines.starts]
    doc, hashes = lines.doc[full], lines.hashes[full]
    o = np.lexsort((hashes, doc))
    again = (doc[o][1:] == doc[o][:-1]) & (hashes[o][1:] == hashes[o][:-1])
    dup = np.bincount(doc[o][1:][again], minlength=n)
    longest = longest_repeats(w)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, w.doc, longest)
    repeat, passage = _per_text(covered(longest, 3), begin), _per_text(covered(longest, passage_words), begin)
    return np.stack([np.diff(begin), chars, symbols, dup, repeat, passage, top])


def _measurer(passage_words: int):
    def measure(text: pa.Array) -> pa.Array:
        parts = [measure_chunk(c, passage_words) for c in W.chunks(text)]
        cols = np.concatenate(parts, axis=1) if parts else np.zeros((len(_FIELDS), 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in cols], list(_FIELDS))

    return arrow_udf(W.bounded(measure), returnType=_KIND).asNondeterministic()


def assess(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", out: str = "quality") -> DataFrame:  # noqa: B008
    """``docs`` with a column ``out`` (one of that name is replaced): the measures, base_failed, reasons (what failed) and kept."""
    ship(docs.sparkSession)
    tmp, r = W.fresh(docs, "measures"), rules
    m = F.col(tmp)
    n = m["n_words"].cast("double")
    base = (m["n_words"] < r.min_words) | (m["n_repeat_words"] > r.max_repeat_share * n)
    failed = {
        "few_words": m["n_words"] < r.min_words,
        "repeated_windows": m["n_repeat_words"] > r.max_repeat_share * n,
        "copied_passages": m["n_passage_words"] > r.max_passage_share * n,
        "long_repeat": (m["longest_repeat"] >= r.passage_words) & (m["longest_repeat"] > r.max_longest_share * n),
        "symbols": m["n_symbols"] > r.max_symbols_per_word * n,
        "word_length": (m["word_chars"] < r.min_word_chars * n) | (m["word_chars"] > r.max_word_chars * n),
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in failed.items()]), lambda x: x.isNotNull())
    fields = [m[f].alias(f) for f in _FIELDS]
    return docs.withColumn(tmp, _measurer(r.passage_words)(F.col(text_col))).withColumn(out, F.struct(*fields, base.alias("base_failed"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("kept"))).drop(tmp)


def filter_quality(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that pass, with their own columns, whatever their names."""
    out = W.fresh(docs, "quality")
    return assess(docs, rules, text_col, out).where(F.col(out)["kept"]).drop(out)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its measures and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    cols = [*_FIELDS[:5], "base_failed", "kept", *_FIELDS[5:]]
    return assess(docs).select("doc_id", *[q[c].alias(c) for c in cols])
