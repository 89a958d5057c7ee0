"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-cased words of a text and the first ``STEM`` bytes of longer ones. From a bounded sample of labelled rows
(``POSITIVES`` and ``NEGATIVES`` rows are expected) four fifths become the examples; every term of theirs is indexed. Its
document frequency is counted over all documents, and its weight is TF-IDF times how far its odds among the examples are
from the label's own (the absolute log odds ratio, shrunk for rare terms), so that words which say nothing about the label weigh
next to nothing, yet none is left out. The unit vectors stand in an inverted index whose postings are cut into blocks of
example numbers, each with its largest weight. A query first bounds its cosine with every block, reads blocks from the highest
bound down and stops once no block left can reach the k-th best example: the neighbours are exact. Votes are weighted by
cosine. The last fifth of the sample isn't in the index: its votes calibrate the score, each row counting for the rows
of its label that it was drawn from. Neighbours are the evidence.

Defined results: a text without any indexed term (a null or empty one, too) has no neighbours and gets the calibrated
share of positives among such examples; with no labelled row of both kinds every score is 0. Ties between examples go to
the lower document id. Repeated rows each get their own score, and an id that stands on several rows gives examples of
each of its texts, within the bound; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import cut, ship
from . import words as W
from .language_id import held_out

#: Bounds of the labelled sample, as expected numbers; no more than LIMIT rows in all.
POSITIVES = 2000
NEGATIVES = 4000
LIMIT = 8000
#: Bytes of a word's beginning that are a term of their own.
STEM = 6
#: Examples that a term's odds are shrunk by.
SHRINK = 5.0
#: Weight against a vote, in squared cosines: far neighbours alone say little.
DOUBT = 0.02
#: Share of the examples from which on a term's weights stand in a row of all examples instead of postings.
COMMON = 1 / 32
#: Example numbers in a block, and blocks that are read together first (eight times as many each time after that).
BLOCK = 64
AT_ONCE = 8
NEIGHBOURS = 10


def terms(c: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of a chunk, and the text it is in."""
    w = W.split(c, W.ALNUM)
    long = np.flatnonzero(w.ends - w.starts > STEM)
    at = w.starts[long]
    stem = np.full(len(long), STEM, np.uint64)
    for j in range(STEM):
        stem = (stem << np.uint64(8)) | w.data[at + j]
    return np.concatenate([w.hashes, W.mix(stem)]), np.concatenate([w.doc, w.doc[long]])


def doc_terms(c: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, term hash and count of each distinct term of each text, in that order."""
    t, d = terms(c)
    o = np.lexsort((t, d))
    t, d = t[o], d[o]
    first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))) if len(t) else np.zeros(0, np.int64)
    return d[first], t[first], np.diff(np.append(first, len(t)))


@dataclass
class Index:
    """Unit vectors of examples as postings by term and block of examples; only blocks that a term is in have an entry.

    Terms of many examples have a row of weights over all examples instead; their part of a cosine is worked out whole.
    """

    keys: W.HashSet
    weight: np.ndarray  # per term, its factor
    doc_ids: np.ndarray
    labels: np.ndarray
    row: np.ndarray  # per term, its row of ``common``, or -1
    common: np.ndarray
    entries: np.ndarray  # per term, where its entries begin
    block: np.ndarray  # per entry, the block
    top: np.ndarray  # per entry, the largest weight
    postings: np.ndarray  # per entry, where its postings begin
    example: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: W.HashSet, weight: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], doc_ids: list[int], labels: list[int]) -> Index:
        """From (term numbers, counts) of each example."""
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        units = [unit(weight, t, n) for t, n in vectors]
        ex = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        term, value = cat([t for t, _ in vectors], np.int64), cat(units, np.float64)
        o = np.lexsort((ex, term))
        term, ex, value = term[o], ex[o], value[o]
        blocks, m = max(1, -(-len(vectors) // BLOCK)), len(keys.keys)
        many = np.flatnonzero(np.bincount(term, minlength=m) > max(BLOCK, COMMON * len(vectors)))
        row = np.full(m, -1, np.int32)
        row[many] = np.arange(len(many))
        common = np.zeros((len(many), len(vectors)), np.float32)
        wide = row[term] >= 0
        common[row[term[wide]], ex[wide]] = value[wide]
        term, ex, value = term[~wide], ex[~wide], value[~wide]
        place = term * blocks + ex // BLOCK
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(value.astype(np.float32), first) if len(first) else np.zeros(0)
        entries = np.searchsorted(term[first], np.arange(len(keys.keys) + 1))
        return Index(
            keys, weight.astype(np.float32), np.array(doc_ids, np.int64), np.array(labels, np.int8), row, common, entries.astype(np.int32), (ex[first] // BLOCK).astype(np.int32), top.astype(np.float32), np.append(first, len(place)).astype(np.int32), ex.astype(np.int32), value.astype(np.float32)
        )

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest positive cosine with a unit vector, and the cosines (to 7 places); ties by example number."""
        n, row = len(self.labels), self.row[term]
        wide = row >= 0
        base = np.einsum("t,te->e", weight[wide].astype(np.float32), self.common[row[wide]]) if wide.any() else np.zeros(n, np.float32)
        term, weight = term[~wide], weight[~wide]
        at, own = _runs(self.entries[term], self.entries[term + 1])
        block, w = self.block[at], weight[own]
        edges = np.arange(0, n, BLOCK)
        bound = (np.maximum.reduceat(base, edges) if n else base) + np.bincount(block, weights=w * self.top[at], minlength=len(edges))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rank = np.full(len(bound), len(bound), np.int32)
        rank[order] = np.arange(len(order))
        place = rank[block]
        by_rank = np.argsort(place, kind="stable")
        at, w, place = at[by_rank], w[by_rank], place[by_rank]
        best_e, best_s, done, step = np.zeros(0, np.int64), np.zeros(0), 0, AT_ONCE
        while done < len(order) and not (len(best_e) >= k and bound[order[done]] < best_s.min() - 1e-6):
            i, j = np.searchsorted(place, (done, done + step))
            begin = self.postings[at[i:j]]
            which = self.postings[at[i:j] + 1] - begin
            p = np.arange(which.sum()) + np.repeat(begin - np.cumsum(which) + which, which)
            score = np.bincount(self.example[p], weights=self.value[p] * np.repeat(w[i:j], which), minlength=n)
            e = (order[done : done + step, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            e = e[e < n]
            s = np.round(score[e] + base[e], 7)
            best_e, best_s = np.concatenate([best_e, e[s > 0]]), np.concatenate([best_s, s[s > 0]])
            if len(best_e) > k:
                near = np.flatnonzero(best_s >= np.partition(best_s, len(best_s) - k)[len(best_s) - k])
                near = near[np.lexsort((best_e[near], -best_s[near]))[:k]]
                best_e, best_s = best_e[near], best_s[near]
            done, step = done + step, 8 * step
        o = np.lexsort((best_e, -best_s))
        return best_e[o], best_s[o]

    def vote(self, e: np.ndarray, s: np.ndarray) -> tuple[float, float]:
        """Share of positives weighted by squared cosine (and ``DOUBT``, which speaks for none), and the largest cosine."""
        w = s * s
        return (float((w * self.labels[e]).sum() / (w.sum() + DOUBT)), float(s[0])) if len(e) else (0.0, 0.0)


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each begin up to its end, and which run each is of."""
    n = end - begin
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) + (begin - np.cumsum(n, dtype=np.int64) + n)[own], own


def unit(weight: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The unit vector of a text's terms."""
    w = (1.0 + np.log(count)) * weight[term].astype(float)
    return w / max(np.sqrt((w * w).sum()), 1e-12)


def term_weights(df: np.ndarray, rows: int, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Inverse document frequency times the absolute log of a term's odds over those of the label, shrunk.

    df: of all ``rows`` documents, those with each term; pos, neg: the examples of either label with it.
    """
    share = n_pos / (n_pos + n_neg)
    odds = np.log((pos + SHRINK * share) / (neg + SHRINK * (1 - share))) - np.log(share / (1 - share))
    return np.log((rows + 1) / (np.maximum(df, 1) + 0.5)).clip(1e-3) * np.abs(odds).clip(1e-3)


@dataclass
class Model:
    """An index with the weights that turn votes into probabilities, and the probability without any neighbour."""

    index: Index | None
    coef: np.ndarray
    bare: float

    def score(self, vote: float, top: float, any_: bool) -> float:
        if not any_:
            return self.bare
        z = self.coef @ np.array([1.0, vote, vote * top])
        return float(1 / (1 + np.exp(-z)))


def _calibrate(rows: list[tuple[float, float, int]], each: tuple[float, float]) -> np.ndarray:
    """Logistic weights of (1, vote, vote * top) by Newton steps with a small ridge; a row counts for ``each[label]`` rows."""
    start = coef = np.array([-2.0, 4.0, 0.0])
    if not rows:
        return coef
    x = np.array([[1.0, v, v * t] for v, t, _ in rows])
    y = np.array([r[2] for r in rows], float)
    w = np.where(y > 0, each[1], each[0])
    w = w * len(w) / w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        coef = coef - np.clip(np.linalg.solve(h, x.T @ (w * (p - y)) + 0.05 * (coef - start)), -2, 2)
    return coef


def _vectorizer():
    def vectors(text: pa.Array) -> pa.Array:
        ts, ns, sizes = [], [], []
        for c in W.chunks(text):
            d, t, n = doc_terms(c)
            ts.append(t.view(np.int64))
            ns.append(n)
            sizes.append(np.bincount(d, minlength=len(c)))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([W.lists(cat(ts), cat(sizes), pa.int64()), W.lists(cat(ns), cat(sizes), pa.int32())], ["t", "n"])

    return arrow_udf(W.bounded(vectors), returnType="struct<t:array<bigint>,n:array<int>>").asNondeterministic()


def document_frequencies(docs: DataFrame, keys: W.HashSet, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many there are; summed on the way."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(keys.keys), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for c in W.chunks(b.column(0)):
                t, d = terms(c)
                at, k = keys.find(t)
                total += np.bincount(np.unique(d[at] * len(total) + k) % max(len(total), 1), minlength=len(total))
            W.release()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["t", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    t, n = (got.column(k).to_numpy() for k in ("t", "n"))
    df = np.zeros(len(keys.keys), np.int64)
    df[t[t >= 0]] = n[t >= 0]
    return df, int(n[t < 0].sum())


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", where: Column | None = None) -> Model:
    """Build the index from a bounded sample of the labelled rows for which ``where`` (over the id) holds."""
    spark = docs.sparkSession
    ship(spark)
    empty = Model(None, np.zeros(3), 0.0)
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"), (where if where is not None else F.lit(True)).alias("ok"))
    own = own.where(F.col("ok") & F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return empty
    cutoff = 1 << 31
    share = F.when(F.col("y") == 1, int(cutoff * min(1.0, POSITIVES / sizes[1]))).otherwise(int(cutoff * min(1.0, NEGATIVES / sizes[0])))
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(cutoff))
    picked = own.where(draw < share).withColumn("draw", draw).orderBy("draw", "id").limit(LIMIT)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    texts = texts.orderBy("draw", "id", F.xxhash64("text")).limit(LIMIT)  # an id may stand on many rows
    sample = cut(texts.repartition(max(4, spark.sparkContext.defaultParallelism), "draw").select("id", "y", F.pmod("draw", F.lit(5)).alias("part"), "text"))
    got = sample.where("part > 0").select("id", "y", _vectorizer()(F.col("text")).alias("v")).toArrow()
    ids, y = got.column("id").to_numpy(), got.column("y").to_numpy()
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    if not n_pos or not n_neg:
        return empty
    t, n = (got.column("v").combine_chunks().field(k) for k in ("t", "n"))
    begin = np.append(0, np.cumsum(np.diff(t.offsets.to_numpy())))
    t, n = t.flatten().to_numpy().view(np.uint64), n.flatten().to_numpy()
    keys = W.HashSet(t)
    number = np.searchsorted(keys.keys, t)
    label = np.repeat(y, np.diff(begin))
    df, rows = document_frequencies(docs, keys, text_col)
    pos, neg = (np.bincount(number[label == k], minlength=len(keys.keys)) for k in (1, 0))
    weight = term_weights(df, rows, pos, neg, n_pos, n_neg)
    order = np.lexsort((np.diff(begin), y, ids)).tolist()
    index = Index.build(keys, weight, [(number[begin[i] : begin[i + 1]], n[begin[i] : begin[i + 1]]) for i in order], ids[order].tolist(), y[order].tolist())
    votes = calibration_votes(sample.where("part = 0"), index)
    drawn = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    each = (sizes[0] / max(drawn.get(0, 0), 1), sizes[1] / max(drawn.get(1, 0), 1))
    bare = [r for r in votes if r[1] <= 0]
    base = sizes[1] / (sizes[0] + sizes[1])
    total = sum(each[r[2]] for r in bare)
    return Model(index, _calibrate([r for r in votes if r[1] > 0], each), (sum(each[1] for r in bare if r[2]) + base) / (total + 1.0))


def calibration_votes(rows: DataFrame, index: Index) -> list[tuple[float, float, int]]:
    """vote, largest cosine (0 without a neighbour) and label of labelled rows that aren't in the index."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = [held.value.vote(e, s) for e, s in neighbours(b.column(0), held.value)]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in votes], pa.float64()), pa.array([v[1] for v in votes], pa.float64()), b.column(1)], ["vote", "top", "y"])

    got = rows.select("text", "y").mapInArrow(voted, "vote double, top double, y int").collect()  # LIMIT rows at most
    held.destroy()  # each task has its votes out; the same index goes out once more with the model
    return sorted((r["vote"], r["top"], r["y"]) for r in got)


def neighbours(text: pa.Array, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nearest examples of each text, and their cosines."""
    for c in W.chunks(text):
        d, t, n = doc_terms(c)
        at, k = index.keys.find(t)
        d, n = d[at], n[at]
        begin = np.searchsorted(d, np.arange(len(c) + 1))
        for i, j in zip(begin[:-1], begin[1:], strict=True):
            yield index.nearest(k[i:j], unit(index.weight, k[i:j], n[i:j]), NEIGHBOURS)


_KIND = "struct<score:double,evidence:array<struct<doc_id:long,cosine:double,label:int>>>"


def _scorer(get: Callable[[], Model]):
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))])

    def score(text: pa.Array) -> pa.Array:
        model = get()
        if model.index is None:
            return pa.array([{"score": 0.0, "evidence": []}] * len(text), kind)
        out, index = [], model.index
        for e, s in neighbours(text, index):
            vote, top = index.vote(e, s)
            evidence = [{"doc_id": int(index.doc_ids[x]), "cosine": float(y), "label": int(index.labels[x])} for x, y in zip(e, s, strict=True)]
            out.append({"score": model.score(vote, top, len(e) > 0), "evidence": evidence})
        return pa.array(out, kind)

    return score


def assess(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out`` (it replaces one of that name): score, and evidence (nearest examples with cosine and label)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the terms of LIMIT examples
    return docs.withColumn(out, arrow_udf(W.bounded(_scorer(lambda: held.value)), returnType=_KIND).asNondeterministic()(F.col(text_col)))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score and the examples that speak for it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    t = F.col("toxicity")
    return assess(docs, learn(docs, labels, where=~held_out())).select("doc_id", held_out().alias("held_out"), t["score"].alias("score"), (t["score"] >= 0.5).cast("int").alias("predicted"), t["evidence"]["doc_id"].alias("evidence"))
