"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text's features are the byte n-grams (2 to 4) of its lower-cased words with a space on either side, hashed into
``BUCKETS`` rows of an embedding table; their average goes through a linear softmax. Both are trained by stochastic
gradient descent in numpy on the driver, over a bounded sample of labelled rows (``PER_LANGUAGE`` rows of each language
are expected, ``SAMPLE_LIMIT`` rows at most in all; with too many languages for that, the larger ones give fewer rows). A part of the sample is held back to fit a temperature (so that scores
are probabilities) and the rejection threshold. For prediction the table and the softmax are multiplied out, which gives the same
logits; every text is read whole.

Defined results: a text that is null or has no letter gets ``und`` and score 0 and is rejected; with no labelled row at all
every text does. Rows without a language aren't learned from. Repeated rows each get their own result; ties go to the
language that is first in order.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship
from . import words as W

#: Bounds of the training sample.
PER_LANGUAGE = 700
SAMPLE_LIMIT = 14_000
BUCKETS = 1 << 14
DIM = 16
EPOCHS = 6
RATE = 0.5
#: n-grams whose weights are summed at a time.
PIECE = 1 << 16
#: Share of held-back documents that rejection may cost at most.
REJECT_SHARE = 0.001
NONE = "und"

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


@dataclass
class Model:
    """Learned languages, the product of embeddings and softmax weights, bias, temperature and rejection threshold."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each language for each text, from the sums of its n-grams' weights and their number."""
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def chunk_features(c: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of a chunk, and the text it is in. An n-gram may touch spaces only at its ends.

    Texts are in order within the n-grams of each length, which follow each other.
    """
    data = np.full(len(c.data) + 2 * len(c) + 2, 0x20, np.uint8)  # two spaces between texts, one before and after
    doc = np.repeat(np.arange(len(c)), np.diff(c.offsets))
    at = np.arange(len(c.data)) + 1 + 2 * doc
    data[at] = _LETTERS[c.data]
    owner = np.zeros(len(data), np.int64)
    owner[at] = doc
    m = len(data)
    x, inner = data.astype(np.uint32), data == 0x20
    buckets, owners = [], []
    for n in (2, 3, 4):
        k = m - n + 1
        if k <= 0:
            continue
        h, ok = np.full(k, 2166136261 + n, np.uint32), np.ones(k, bool)
        for j in range(n):
            h = (h ^ x[j : j + k]) * np.uint32(16777619)
        for j in range(1, n - 1):
            ok &= ~inner[j : j + k]
        ok &= ~(inner[:k] & inner[n - 1 :]) if n == 2 else True
        at = np.flatnonzero(ok)
        h = h[at]
        h ^= h >> np.uint32(15)
        buckets.append((h * np.uint32(2246822519)) >> np.uint32(32 - 14))
        owners.append(np.maximum(owner[at], owner[at + 1]))  # one of the two is in the text; spaces between texts have 0
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def chunk_sums(c: W.Chunk, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a chunk the sum of its n-grams' rows of ``weights``, and their number; in pieces of ``PIECE``."""
    b, d = chunk_features(c)
    out = np.zeros((len(c), weights.shape[1]))
    for i in range(0, len(b), PIECE):
        at, own = weights[b[i : i + PIECE]], d[i : i + PIECE]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        np.add.at(out, own[first], np.add.reduceat(at, first, axis=0))
    return out, np.bincount(d, minlength=len(c))


def train(examples: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7, sizes: dict[str, int] | None = None) -> Model:
    """Fit on (buckets, counts, language) examples; every fifth is held back for calibration.

    ``sizes`` are the rows of each language that the examples stand for; calibration gives each language its share of them.
    """
    langs = sorted({e[2] for e in examples})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    index = {v: i for i, v in enumerate(langs)}
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    fit = [e for i, e in enumerate(examples) if i % 5] or examples
    held = examples[::5]
    fit = [e for e in fit if len(e[0])]
    steps, step = EPOCHS * max(1, len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            b, n, lang = fit[i]
            f, y = (n / n.sum(dtype=np.float64)).astype(np.float32), index[lang]
            rate = RATE * (1 - step / steps)
            step += 1
            x = f @ emb[b]
            z = x @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = soft @ p
            soft -= rate * np.outer(x, p)
            bias -= rate * 0.1 * p
            emb[b] -= rate * len(b) * f[:, None] * back / max(1.0, len(b) ** 0.5)
    model = Model(langs, emb @ soft, bias, 1.0, 0.0)
    return _calibrate(model, [(b, n, index[y]) for b, n, y in held], [sizes[v] for v in langs] if sizes else None)


def _calibrate(model: Model, held: list[tuple[np.ndarray, np.ndarray, int]], sizes: list[int] | None = None) -> Model:
    """Temperature of least log loss on the held-back part, and the threshold that rejects REJECT_SHARE of it at most.

    Both are weighted by what the rows of a language stand for.
    """
    if not held:
        return model
    z = np.stack([n.astype(np.float32) @ model.weights[b] / max(n.sum(dtype=np.float64), 1.0) + model.bias for b, n, _ in held])
    y = np.array([e[2] for e in held])
    own = np.bincount(y, minlength=len(model.langs))
    w = (np.array(sizes, float) / np.maximum(own, 1))[y] if sizes else np.ones(len(y))
    w = w / w.sum()
    best = np.inf
    for t in np.geomspace(0.05, 20, 60):
        s = z / t
        s = s - s.max(1, keepdims=True)
        loss = float(w @ (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))
        if loss < best - 1e-9:
            best, model.temperature = loss, float(t)
    s = np.exp(z / model.temperature - (z / model.temperature).max(1, keepdims=True))
    top = (s / s.sum(1, keepdims=True)).max(1)
    order = np.argsort(top, kind="stable")
    at = np.searchsorted(np.cumsum(w[order]), REJECT_SHARE, side="right")  # what stands before it is REJECT_SHARE at most
    model.threshold = float(min(0.5, top[order[min(int(at), len(order) - 1)]]))
    return model


def _featurizer():
    def features(text: pa.Array) -> pa.Array:
        buckets, counts, sizes = [], [], []
        for c in W.chunks(text):
            b, d = chunk_features(c)
            key, n = np.unique(d * BUCKETS + b, return_counts=True)
            buckets.append(key % BUCKETS)
            counts.append(n)
            sizes.append(np.bincount(key // BUCKETS, minlength=len(c)))
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        n = cat(sizes)
        return pa.StructArray.from_arrays([W.lists(cat(buckets), n, pa.int16()), W.lists(cat(counts), n, pa.int32())], ["b", "n"])

    return arrow_udf(W.bounded(features), returnType="struct<b:array<smallint>,n:array<int>>").asNondeterministic()


def quota(sizes: Iterable[int]) -> float:
    """Rows expected of a language at most, so that all together are SAMPLE_LIMIT at most; smaller ones are taken whole."""
    left, sizes = float(SAMPLE_LIMIT), sorted(sizes)
    for i, n in enumerate(sizes):
        each = left / (len(sizes) - i)
        if n >= each:
            return min(each, PER_LANGUAGE)
        left -= min(n, PER_LANGUAGE)
    return PER_LANGUAGE


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", where: Column | None = None) -> Model:
    """Train on a bounded sample of the labelled rows of ``docs`` for which ``where`` holds."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (where if where is not None else F.lit(True)).alias("ok"))
    rows = rows.where(F.col("ok") & F.col("lang").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return train([])
    cut, each = 1 << 31, quota(sizes.values())
    shares = {lang: max(1, int(cut * min(1.0, each / n))) for lang, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for lang, n in shares.items() for x in (lang, n)])
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(11)), F.lit(cut))
    picked = rows.where((draw < share[F.col("lang")]) & F.col("text").rlike(r"\p{L}")).withColumn("draw", draw).repartition(max(4, docs.sparkSession.sparkContext.defaultParallelism), "draw")
    # in the order of the draw within its language's share, the limit cuts every language alike
    got = picked.select("draw", "lang", _featurizer()(F.col("text")).alias("f")).orderBy(F.col("draw") / share[F.col("lang")], "draw", "lang").limit(SAMPLE_LIMIT).toArrow()
    examples = []
    for batch in got.to_batches(max_chunksize=256):  # views of the table, no copies
        b, n = batch.column("f").flatten()
        for draw, lang, x, y in zip(batch.column("draw").to_pylist(), batch.column("lang").to_pylist(), b, n, strict=True):
            examples.append((draw, lang, x.values.to_numpy(), y.values.to_numpy()))
    examples.sort(key=lambda e: (e[0], e[1], len(e[2])))
    return train([(b, n, lang) for _, lang, b, n in examples], sizes=sizes)


def predictor(model: Model):
    """The prediction for one Arrow column of texts."""
    weights = model.weights.astype(np.float64)

    def predict(text: pa.Array) -> pa.Array:
        best, score = [], []
        for c in W.chunks(text, 1 << 18):
            p = model.probabilities(*chunk_sums(c, weights)) if model.langs else np.zeros((len(c), 1))
            best.append(p.argmax(1))
            score.append(p.max(1))
        k = np.concatenate(best) if best else np.zeros(0, np.int64)
        names = pa.array(model.langs or [NONE], pa.string())
        return pa.StructArray.from_arrays([names.take(pa.array(k)), pa.array(np.concatenate(score).astype(np.float64) if score else np.zeros(0))], ["lang", "score"])

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a column ``out`` (it replaces one of that name): lang, score, and rejected (no letter, or a score under the threshold)."""
    ship(docs.sparkSession)
    tmp = W.fresh(docs, out)
    guess = arrow_udf(W.bounded(predictor(model)), returnType="struct<lang:string,score:double>").asNondeterministic()
    has = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.langs))
    g = F.col(tmp)
    fields = F.struct(F.when(has, g["lang"]).otherwise(NONE).alias("lang"), F.when(has, g["score"]).otherwise(0.0).alias("score"), (~has | (g["score"] < model.threshold)).alias("rejected"))
    return docs.withColumn(tmp, guess(F.col(text_col))).withColumn(out, fields).drop(tmp)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves no remainder. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def filter_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns; learned from the labelled rows of ``docs``."""
    model = learn(docs, text_col, lang_col, id_col, ~held_out(id_col))
    out = W.fresh(docs, "language")
    return identify(docs, model, text_col, out).where(~F.col(out)["rejected"]).drop(out)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs, where=~held_out())
    g = F.col("language")
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), g["lang"].alias("lang_pred"), g["score"].alias("score"), g["rejected"].alias("rejected"))
