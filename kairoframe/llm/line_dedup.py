"""Repeated lines, by levelled sorted runs of line hashes; DataFrame functions only.

A run is a table of line keys (two 64-bit hashes), each with the number of documents that hold the line and the largest id
among them, bucketed and sorted by the hashes. A key is in one run only:

1. A batch's lines are counted by key and written in the runs' own order, which is the batch's one shuffle.
2. The batch is merge-anti-joined with every run, bucket by bucket and without a shuffle. Keys that no run has are the
   batch's own run; what the others add to their counts goes to a small table of repeats.
3. Two runs of one level are merged into one of the next, so n batches leave about log2(n) runs, and each key is rewritten
   as often at most.

A key's total is its row in the runs plus the repeats. Lines that occur in enough documents are then looked up again in the
documents: a scan gives places of long lines, a join by key those to drop, a second join brings the places to their text. A
line that stands everywhere is counted before it is shuffled, and is a key that adaptive execution splits in the join.

Defined results: every row counts as a document, also where ids repeat; a line counts once a document. Rows that share the
largest id holding a line all keep it; a null id is less than any other, and a line that only rows without an id hold stays.
A null text has no lines to count and stays null, an empty one is one empty line. A text that loses all its lines is
empty. Other columns are kept, whatever their names. Keys are told apart by 128 bits: n different lines share one with odds
of about n*n / 2**129.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Tables, shared_dir
from . import words as W

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: [\x20\x09-\x0D]
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]
#: Batches that a stored table is dealt out to, by its files.
BATCHES = 4


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(11), key).alias("h2")]


def count_keys(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keys of at least ``min_chars`` code points: h1, h2, documents that hold it (docs), the largest id of those (keeper)."""
    long = F.filter(F.transform(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(_SPACE))), lambda x: F.length(x) >= min_chars)
    keys = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(long, lambda x: F.translate(x, _UPPER, _UPPER.lower())))).alias("key"))
    return keys.select("id", *_hashed(F.col("key"))).groupBy(_KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))


class LineRuns:
    """Levelled sorted runs of line keys; ``add`` takes the next batch, ``totals`` gives every key's count so far.

    Runs are bucketed tables of the session's catalogue, their files lie in the shared folder; ``drop`` removes them. Batches
    are of one kind (as ``count_keys`` makes them) and hold different documents.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []
        self._merged: list[str] = []
        self._name, self._n = f"line_runs_{uuid.uuid4().hex}", 0
        self._folder = f"{shared_dir(spark)}/{self._name}"

    def _save(self, df: DataFrame) -> str:
        """A sorted, bucketed table of these rows; they are dealt out by key already."""
        name, self._n = f"{self._name}_{self._n}", self._n + 1
        df.write.format("parquet").bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self._folder}/{name}").saveAsTable(name)
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Take a batch of counted keys; returns those of them that no batch before had, a table that stands until the next one."""
        self._clear()
        batch = self._save(keys)
        rows = self.spark.table(batch)
        # Merge joins, since both sides come sorted and bucketed; broadcasting a run would not be bounded.
        own = self._save(reduce(lambda left, run: left.join(self.spark.table(run).select(_KEY).hint("merge"), _KEY, "left_anti"), self.runs(), rows))
        if self.runs():
            self.repeats.append(self._save(rows.join(self.spark.table(own).select(_KEY).hint("merge"), _KEY, "left_anti")))
        self._remove(batch)
        first = self.spark.table(own)
        self._push(own, 0)
        return first

    def _push(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            a, b = self.levels[level]
            self.levels[level] = []
            self._merged += [a, b]
            left, right = self.spark.table(a).alias("a"), self.spark.table(b).hint("merge").alias("b")
            same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
            cols = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in _KEY]
            # A key is in one of the two, so the outer join is their merge.
            here = F.col("a.docs").isNotNull()
            merged = left.join(right, same, "full").select(*cols, *[F.when(here, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("docs", "keeper")])
            self._push(self._save(merged), level + 1)

    def totals(self, min_docs: int = 1) -> DataFrame:
        """Keys of at least ``min_docs`` documents: h1, h2, docs, keeper."""
        tables = [self.spark.table(r) for r in self.runs()]
        if self.repeats:
            again = reduce(DataFrame.union, [self.spark.table(r) for r in self.repeats])
            again = again.groupBy(_KEY).agg(F.sum("docs").alias("more"), F.max("keeper").alias("later"))
            tables = [t.join(again, _KEY, "left").select(*_KEY, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("keeper", "later").alias("keeper")) for t in tables]
        return reduce(DataFrame.union, tables).where(F.col("docs") >= min_docs)

    def _clear(self) -> None:
        for name in self._merged:
            self._remove(name)
        self._merged = []

    def drop(self) -> None:
        """Remove all runs."""
        self._clear()
        for name in [*self.runs(), *self.repeats]:
            self._remove(name)
        self.levels, self.repeats = [], []
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def file_batches(docs: DataFrame, batches: int = BATCHES) -> Iterator[DataFrame]:
    """A stored table in batches of whole files; each file is read for its own batch only."""
    n = max(1, min(batches, len(docs.inputFiles())))
    for i in range(n):
        yield docs.where(F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(n)) == i) if n > 1 else docs


def frequent_lines(spark: SparkSession, batches: Iterator[DataFrame], min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keys found in at least ``min_docs`` documents of all batches, as a table: h1, h2, docs, keeper."""
    runs = LineRuns(spark)
    for batch in batches:
        runs.add(count_keys(batch, min_chars, id_col, text_col))
    found = Tables(spark).save(runs.totals(min_docs))
    runs.drop()
    return found


def _without(text: Column, places: Column) -> Column:
    """The text without the lines at these ascending places, in one pass over what lies between them."""

    def cut(lines: Column) -> Column:
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1) + 1)
        end = lambda i: F.when(i == F.size(places), F.size(lines)).otherwise(F.get(places, i))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i)))), "\n")

    return F.get(F.transform(F.array(_lines(text)), cut), F.lit(0))


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` without frequent lines, but for those in the keeper's row; optionally with the numbers of lines and of dropped ones.

    Columns named by ``n_lines`` and ``n_dropped`` replace columns of the same name.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.posexplode(_lines(F.col(text_col))).alias("place", "line"))
    rows = rows.where(F.length(F.btrim("line", F.lit(_SPACE))) >= min_chars)
    rows = rows.select("id", "digest", "place", *_hashed(line_key(F.col("line"))))
    hits = rows.join(frequent, _KEY).where(~F.col("id").eqNullSafe(F.col("keeper")))
    id_, digest, places = (W.fresh(docs, c) for c in ("id", "digest", "places"))
    hits = hits.groupBy(F.col("id").alias(id_), F.col("digest").alias(digest)).agg(F.sort_array(F.collect_set("place")).alias(places))
    text = F.col(text_col)
    out = docs.join(hits, docs[id_col].eqNullSafe(hits[id_]) & (F.xxhash64(docs[text_col]) == hits[digest]), "left")
    counts = {n_lines: F.size(_lines(F.coalesce(text, F.lit("")))), n_dropped: F.when(F.col(places).isNull(), 0).otherwise(F.size(places))}
    new = {k: v.cast("long") for k, v in counts.items() if k}
    return out.withColumns(new | {text_col: F.when(F.col(places).isNull(), text).otherwise(_without(text, F.col(places)))}).drop(id_, digest, places)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_lines(docs, frequent_lines(spark, file_batches(docs)), n_lines="n_lines", n_dropped="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (
  SELECT doc_id, place, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM places),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
