"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over every training text.

Each benchmark item gives its windows of ``n`` consecutive words (an item of fewer words is one window). Their hashes
form a set that goes to the executors; a document's windows are probed against it with vector operations, and every hit
is verified on the words themselves, so a hash collision cannot mark a clean document. The set has a size bound:
a benchmark of up to ``block_bytes`` of text takes one scan, a larger one is dealt into blocks of about that size and the
documents are scanned once per block, with the spans of all blocks merged at the end. Nothing is shuffled.

Defined results: a null or empty text has no words and no hits; an item without words is ignored; an item whose id is
null marks words but is not listed; repeated items count once; repeated documents each get their own row; an empty
benchmark or table gives no hits or no rows. Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import cut, ship
from . import words as W

#: Words in a window.
WINDOW = 10
#: Benchmark text, in bytes, that one scan holds in memory (its windows take some 12 times as much in each worker).
BLOCK_BYTES = 16 << 20
_HIT = "struct<n_words:long,spans:array<struct<first:int,last:int>>,items:array<long>>"


class WindowIndex:
    """The windows of some items: for each window length a hash set, where a window's words stand, and its items.

    All of it is in flat arrays, some 70 bytes a word.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], n: int):
        offsets, data = W.buffers(pa.array([t for _, t in items], pa.string()))
        c = W.Chunk(0, len(items), data[offsets[0] : offsets[-1]], offsets - offsets[0])
        w = W.split(c, W.ALNUM)
        begin = w.first_of()
        ids = np.array([0 if i is None else i for i, _ in items], np.int64)
        named = np.array([i is not None for i, _ in items], bool)
        total = np.diff(begin)
        self.words = W.Words(w.data, w.starts.astype(np.int64), w.ends.astype(np.int64), np.zeros(0, np.int64), 0, np.zeros(0, np.uint64))
        self.sets: dict[int, W.HashSet] = {}
        self.at: dict[int, np.ndarray] = {}  # per key, the first word of a window
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per key, where its item ids begin, and they
        self.others: dict[tuple[int, int], list[tuple[bytes, list[int]]]] = {}  # windows whose hash another one has
        for size in sorted({min(n, x) for x in total.tolist()} - {0}):
            h, at = W.windows(w.hashes, w.doc, size)
            own = np.minimum(n, total)[w.doc[at]] == size
            self._add(size, h[own], at[own], w.doc[at[own]], ids, named)

    def _add(self, size: int, h: np.ndarray, at: np.ndarray, item: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        keys = self.sets[size] = W.HashSet(h)
        k = np.searchsorted(keys.keys, h)
        first = np.full(len(keys.keys), len(self.words.starts), np.int64)
        np.minimum.at(first, k, at)
        again = np.flatnonzero(first[k] != at)  # where a window comes again, its words have to be the same
        odd = np.zeros(len(h), bool)
        odd[again] = [self.words.joined(x, size) != self.words.joined(y, size) for x, y in zip(at[again].tolist(), first[k[again]].tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():
            found = self.others.setdefault((size, int(k[i])), [])
            words = self.words.joined(int(at[i]), size)
            same = next((x for t, x in found if t == words), None)
            if same is None:
                found.append((words, same := []))
            same += [int(ids[item[i]])] * bool(named[item[i]] and int(ids[item[i]]) not in same)
        listed = ~odd & named[item]
        pairs = np.unique(np.stack([k[listed], ids[item[listed]]], 1), axis=0) if listed.any() else np.zeros((0, 2), np.int64)
        self.at[size] = first
        self.items[size] = (np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1].copy())

    def hits(self, w: W.Words) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Verified (text, first word, window length) and (text, item) of a chunk's words."""
        spans, items, seen = [], set(), set()
        for size, keys in self.sets.items():
            hashes, at = W.windows(w.hashes, w.doc, size)
            begin, ids = self.items[size]
            for i, k in zip(*(x.tolist() for x in keys.find(hashes)), strict=True):
                first = int(at[i])
                words, d = w.joined(first, size), int(w.doc[first])
                if words == self.words.joined(int(self.at[size][k]), size):
                    spans.append((d, first, size))
                    if (size, d, k) not in seen:
                        seen.add((size, d, k))
                        items.update((d, x) for x in ids[begin[k] : begin[k + 1]].tolist())
                for text, more in self.others.get((size, k), ()):
                    if words == text:
                        spans.append((d, first, size))
                        items.update((d, x) for x in more)
        return spans, sorted(items)


def _scanner(get: Callable[[], WindowIndex]):
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.int64()))])

    def scan(text: pa.Array) -> pa.Array:
        index = get()
        n_words, n_spans, n_items = [], [], []
        firsts, lasts, ids = [], [], []
        for c in W.chunks(text):
            w = W.split(c, W.ALNUM)
            begin = w.first_of()
            hit = np.zeros(len(w.starts) + 1, bool)
            spans, items = index.hits(w)
            for _, i, size in spans:
                hit[i : i + size] = True
            n_words.append(np.diff(begin))
            counts = np.zeros(len(c), np.int64)
            if spans:
                new = np.ones(len(hit), bool)  # a span also ends where the text ends
                new[1:] = ~hit[:-1]
                new[begin[:-1]] = True
                a = np.flatnonzero(hit & new)
                end = np.ones(len(hit), bool)
                end[:-1] = ~hit[1:] | new[1:]
                b = np.flatnonzero(hit & end)
                d = w.doc[a]
                counts = np.bincount(d, minlength=len(c))
                firsts.append(a - begin[d])
                lasts.append(b - begin[d])
            n_spans.append(counts)
            n_items.append(np.bincount(np.array([d for d, _ in items], np.int64), minlength=len(c)))
            ids.append(np.array([x for _, x in items], np.int64))
        cat = lambda xs, t=np.int64: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        pairs = pa.StructArray.from_arrays([pa.array(cat(firsts, np.int32)), pa.array(cat(lasts, np.int32))], ["first", "last"])
        off = np.zeros(len(text) + 1, np.int32)
        np.cumsum(cat(n_spans), out=off[1:])
        return pa.StructArray.from_arrays(
            [pa.array(cat(n_words)), pa.ListArray.from_arrays(pa.array(off), pairs), W.lists(cat(ids), cat(n_items), pa.int64())], fields=list(kind)
        )

    return arrow_udf(W.bounded(scan), returnType=_HIT).asNondeterministic()


def _merge(a: Column, b: Column) -> Column:
    """Spans of two blocks as sorted spans that don't overlap."""
    one = F.array_sort(F.concat(a, b))
    empty = F.slice(a, 1, 0)
    return F.aggregate(
        one,
        empty,
        lambda acc, x: F.when((F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["last"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(x["last"], F.try_element_at(acc, F.lit(-1))["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(x))),
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", out: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``out`` (it replaces one of that name): n_words, spans (first and last hit word, merged), items (ids with a window in it)."""
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        held = docs.sparkSession.sparkContext.broadcast(WindowIndex([(r[0], r[1]) for r in part.collect()], n))
        scan = _scanner(lambda held=held: held.value)(F.col(text_col))
        if b == 0:
            docs = docs.withColumn(out, scan)
        else:
            more = W.fresh(docs, out)
            docs = docs.withColumn(more, scan)
            docs = docs.withColumn(out, F.struct(F.col(out)["n_words"].alias("n_words"), _merge(F.col(out)["spans"], F.col(more)["spans"]).alias("spans"), F.array_distinct(F.concat(F.col(out)["items"], F.col(more)["items"])).alias("items"))).drop(more)
        if blocks > 1:
            docs = cut(docs)
    return docs


def n_hit(hits: Column) -> Column:
    """Words inside the spans of a ``find_hits`` column."""
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda acc, s: acc + (s["last"] - s["first"] + 1).cast("long"))


def _remover():
    def remove(text: pa.Array, spans: pa.Array) -> pa.Array:
        out, rows = [], spans.to_pylist()
        for c in W.chunks(text):
            w = W.split(c, W.ALNUM, hashed=False)
            begin = w.first_of()
            for i in range(len(c)):
                raw, at, keep = c.data[c.offsets[i] : c.offsets[i + 1]].tobytes(), 0, []
                for s in rows[c.first + i] or []:
                    a, b = w.starts[begin[i] + s["first"]] - c.offsets[i], w.ends[begin[i] + s["last"]] - c.offsets[i]
                    keep.append(raw[at:a])
                    at = b
                out.append((b"\n".join([*keep, raw[at:]])).decode("utf-8", "replace") if keep else raw.decode("utf-8", "replace"))
        return pa.array([None if not ok else x for x, ok in zip(out, text.is_valid().to_pylist(), strict=True)], pa.string())

    return arrow_udf(W.bounded(remove), returnType="string").asNondeterministic()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove what the benchmark holds: whole hit documents, or (mode "spans") only the hit words, a line end in their place.

    The columns of ``docs`` are kept as they are; in mode "spans" only ``text_col`` changes.
    """
    tmp = W.fresh(docs, "hits")
    found = find_hits(docs, benchmark, n, text_col, tmp, block_bytes)
    if mode == "documents":
        return found.where(F.size(F.col(tmp)["spans"]) == 0).drop(tmp)
    return found.withColumn(text_col, _remover()(F.col(text_col), F.col(tmp)["spans"])).drop(tmp)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with its words, its hit words and the items behind them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = F.col("hits")
    ids = F.array_join(F.array_sort(F.transform(h["items"], lambda x: x.cast("string"))), ",")
    return find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", h["n_words"].alias("n_words"), n_hit(h).alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size(h["spans"]) > 0).alias("contaminated")
    )


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
hit AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
