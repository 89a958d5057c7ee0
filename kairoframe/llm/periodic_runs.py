"""Periodic runs of words: an all-lag scan of word ids.

A run with smallest period q is a stretch of words in which words q apart are equal, that neither neighbour extends and that
is at least max(min_words, min_exp * q) long. At lag q such a run is a stretch of equal pairs (word i, word i + q) of at
least m = max(min_words - q, (min_exp - 1) * q) places. For every lag up to n / min_exp the word ids are compared with
themselves shifted by the lag, and the true stretches are run-length encoded.

* Whole texts are scanned together, in runs of about 1 MB, longest first: a word's id includes its text, so no stretch leaves
  a text, and the words still concerned at a lag are a prefix of the array.
* A stretch of m places holds four or more consecutive multiples of max(1, m // 4). A lag is compared at those places first;
  only where such neighbours are all equal is it compared at all places. No stretch is lost, and long lags cost little.
* Stretches found at a multiple of a run's period have the same ends as the run; the least lag of equal ends is the
  period (two periods that fit twice into a stretch have a common divisor that is one, too).
* A text of over ``long_chars`` characters is dealt out as ranges of lags, each with about the same number of lags and a row
  of its own; the ranges' stretches meet again by text, where the least lag of equal ends is chosen over all ranges.

Defined results: a null or empty text has no words and no runs, its collapsed text is empty; repeated rows each get
their own result; texts are scanned whole; other columns are kept, the one named ``out`` is replaced. Words are told apart by
64-bit hashes within a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship
from . import words as W

RUN = "struct<start:long,length:long,period:long>"


@dataclass(frozen=True)
class Periods:
    """What counts as a run, and how long texts are dealt out."""

    min_words: int = 12
    min_exp: int = 2
    #: Texts of more characters are dealt out by ranges of lags ...
    long_chars: int = 1 << 16
    #: ... of so many lags.
    lags: int = 1 << 13


def stretches(ids: np.ndarray, n: np.ndarray, p: Periods, lo: int = 1, hi: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and lag of all true stretches at the lags lo to hi - 1, for texts of n words each, longest first."""
    top = int(n[0]) // p.min_exp + 1 if len(n) else 0
    hi = top if hi is None else min(hi, top)
    ends = np.cumsum(n)
    out = []
    least_words = n[::-1]
    for q in range(lo, hi):
        m = max(p.min_words - q, (p.min_exp - 1) * q)
        # Texts with room for q words and a stretch of m more are a prefix.
        k = len(n) - int(np.searchsorted(least_words, q + m))
        if not k:
            continue
        end = int(ends[k - 1])
        step = max(1, m // 4)
        c = min(4, m // step)
        some = ids[0 : end - q : step] == ids[q:end:step]
        near = some[: len(some) - c + 1]
        for j in range(1, c):
            near = near & some[j : len(some) - c + 1 + j]
        if not near.any():
            continue
        same = np.zeros(end - q + 2, np.int8)
        np.equal(ids[: end - q], ids[q:end], out=same[1:-1].view(bool))
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, stop = edge[::2], edge[1::2]
        full = stop - begin >= m
        if full.any():
            out.append((begin[full], stop[full] - begin[full] + q, np.full(int(full.sum()), q)))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def least_lags(start: np.ndarray, length: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches with the same ends the one of the least lag, by start, then lag."""
    o = np.lexsort((lag, length, start))
    start, length, lag = start[o], length[o], lag[o]
    new = np.ones(len(o), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[new], length[new], lag[new]
    o = np.lexsort((lag, start))
    return start[o], length[o], lag[o]


def _scan(w: W.Words, p: Periods, lo: int = 1, hi: int | None = None) -> list[np.ndarray]:
    """For each text of a chunk its stretches (rows of start, length, lag), the least lag of equal ends only."""
    begin = w.first_of()
    n = np.diff(begin)
    order = np.argsort(-n, kind="stable")
    _, ids = np.unique(W.mix(w.hashes + w.doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_inverse=True)
    ids = ids.astype(np.int32)
    sizes = n[order]
    placed = np.concatenate([ids[begin[i] : begin[i + 1]] for i in order]) if len(ids) else ids
    first = np.cumsum(sizes) - sizes
    start, length, lag = least_lags(*stretches(placed, sizes, p, lo, hi))
    at = np.searchsorted(first, start, side="right") - 1  # texts without words come last
    bounds = np.searchsorted(at, np.arange(len(n) + 1))
    out = [np.zeros((0, 3), np.int64)] * len(n)
    for k in np.unique(at):
        part = slice(bounds[k], bounds[k + 1])
        out[order[k]] = np.stack([start[part] - first[k], length[part], lag[part]], axis=1)
    return out


def _collapsed(c: W.Chunk, w: W.Words, found: list[np.ndarray]) -> pa.Array:
    """Each text's words but for those that repeat a run's first period, joined by spaces."""
    begin = w.first_of()
    step = np.zeros(len(w.starts) + 1, np.int64)
    for i in (i for i, x in enumerate(found) if len(x)):
        x = found[i] + np.array([begin[i], 0, 0])
        np.add.at(step, x[:, 0] + x[:, 2], 1)
        np.add.at(step, x[:, 0] + x[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    edge = np.zeros(len(c.data) + 1, np.int8)
    edge[w.starts[kept]] += 1
    edge[w.ends[kept]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # The byte behind a word that another one follows is white space: it becomes the space between them.
    between = w.ends[kept[:-1][w.doc[kept[1:]] == w.doc[kept[:-1]]]]
    mask[between] = True
    data = c.data.copy()
    data[between] = 0x20
    offsets = np.concatenate([[0], np.cumsum(mask)])[c.offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(c), pa.py_buffer(offsets), pa.py_buffer(data[mask]))


def _structs(found: list[np.ndarray]) -> pa.Array:
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    off = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(3)], ["start", "length", "period"]))


def _reader(p: Periods):
    """Runs and collapsed text of each text; where stretches are given, these are taken."""

    def read(text: pa.Array, given: pa.Array) -> pa.Array:
        found, texts = [], []
        for c in W.chunks(text):
            w = W.split(c, W.SOLID, W.SAME)
            here = given[c.first : c.last].to_pylist()
            parts = _scan(w, p) if None in here else []
            for i, rows in enumerate(here):
                if rows is not None:  # stretches of all ranges of lags
                    rows = np.array([(r["start"], r["length"], r["period"]) for r in rows], np.int64).reshape(-1, 3)
                    parts[i : i + 1] = [np.stack(least_lags(*rows.T), axis=1)]
            found += parts
            texts.append(_collapsed(c, w, parts))
        collapsed = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
        return pa.StructArray.from_arrays([_structs(found), collapsed], ["runs", "collapsed"])

    return arrow_udf(W.bounded(read), returnType=f"struct<runs:array<{RUN}>,collapsed:string>").asNondeterministic()


def _ranges(p: Periods):
    """id, digest, text, lo, hi of one range each, to the stretches of that range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, lo, hi = (b.column(b.schema.get_field_index(c)) for c in ("text", "lo", "hi"))
            found = [_scan(W.words_of(t.as_py(), W.SOLID, W.SAME), p, x.as_py(), y.as_py())[0] for t, x, y in zip(text, lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("id", "digest")] + [_structs(found)], ["id", "digest", "runs"])
            W.release()

    return scan


def _long_texts(docs: DataFrame, p: Periods, id_col: str, text_col: str) -> DataFrame:
    """id, digest and all stretches of texts that are dealt out by ranges of lags."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    lags = F.ceil(F.length("text") / (2 * p.min_exp))  # a word and a space are two characters
    rows = rows.withColumn("lo", F.explode(F.sequence(F.lit(1).cast("long"), lags + 1, F.lit(p.lags).cast("long")))).withColumn("hi", F.col("lo") + p.lags)
    found = rows.repartition("id", "digest", "lo").mapInArrow(_ranges(p), f"id {kind}, digest long, runs array<{RUN}>")
    return found.groupBy("id", "digest").agg(F.flatten(F.collect_list("runs")).alias("given"))  # never null: an empty list at least


def find_runs(docs: DataFrame, periods: Periods = Periods(), id_col: str = "doc_id", text_col: str = "text", out: str = "periodic") -> DataFrame:  # noqa: B008
    """``docs`` with ``out``: runs (by start, then period) and collapsed, the words that repeat no run's first period."""
    ship(docs.sparkSession)
    p, read = periods, _reader(periods)
    long = F.coalesce(F.length(text_col) > p.long_chars, F.lit(False))
    id_, digest, given = (W.fresh(docs, c) for c in ("id", "digest", "given"))
    short = docs.where(~long).withColumn(given, F.lit(None).cast(f"array<{RUN}>"))
    rest = docs.where(long)
    known = _long_texts(rest, p, id_col, text_col).toDF(id_, digest, given)
    rest = rest.join(known, rest[id_col].eqNullSafe(known[id_]) & (F.xxhash64(rest[text_col]) == known[digest]), "left").drop(id_, digest)
    return short.unionByName(rest).withColumn(out, read(F.col(text_col), F.col(given))).drop(given)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a tail of period p from word a on, for ids whose crc32 is a multiple of ten; others unchanged."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1)).cast("long")  # arithmetic may run ahead of the test for words
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w))), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its runs: their number, the longest, and digests of all runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs, Periods(12, 2)).select("doc_id", "periodic.runs", "periodic.collapsed")
    # The least of (-length, start, period) is the longest run, of equal ones the first.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    out = found.withColumn("best", best)
    length, period = -F.col("best.less"), F.col("best.period")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


#: CRC-32 of a text of ASCII characters: each byte goes into the register, which then takes eight steps.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len({0}) + 1), lambda i: list_value(ascii({0}[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0)))), "
    "lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"
)
OP13_SQL = rf"""
WITH ids AS (SELECT doc_id, coalesce(text, '') AS text, {_CRC.format("(doc_id::VARCHAR)")} AS h FROM documents),
original AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM ids),
places AS (SELECT doc_id, h, w, len(w) AS n, g % len(w) AS a, 1 + (len(w) - g % len(w)) // (3 + g % 8) AS p FROM original, LATERAL (SELECT 1) WHERE len(w) > 0),
docs AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM places),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM docs),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
found AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isles GROUP BY doc_id, q, isle HAVING count(*) >= greatest(12 - q, q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM found GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
digest AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM ids d LEFT JOIN digest USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
