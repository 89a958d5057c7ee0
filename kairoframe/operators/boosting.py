"""Gradient-boosted trees for several classes, with missing values, over tables of any number of rows.

Features are put into at most 255 bins by quantiles; a missing value has a bin of its own. Every iteration grows one tree for
each class, best leaf first. A pass over the rows sums gradients by class, node, feature and bin: each task adds up its own rows
with numpy, Spark sums the tasks' histograms for each class, node and block of features, and the best split of each block is
what the driver sees. One pass serves all classes and all leaves that are waiting for a split. Missing values go to the side
that gains more, and where a node had none, to the side with more rows. Row scores are written every ``refresh`` iterations;
trees since then are applied on the way.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from ..session import Tables, ship
from .models import FEATURE_VERSION

MISSING = 255
_BLOCK = 16  # features in a block


@dataclass(frozen=True)
class Boost:
    """How trees are grown."""

    iterations: int = 300
    rate: float = 0.05
    leaves: int = 15
    least_rows: int = 20
    l2: float = 1.0
    bins: int = 255
    refresh: int = 10
    #: Each class weighs as much as the others.
    balanced: bool = True


@dataclass
class Tree:
    """Nodes as arrays; a leaf has no feature (-1)."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float = 0.0) -> int:
        for column, v in zip((self.feature, self.bin, self.missing_left, self.left, self.right, self.value), (-1, 0, False, -1, -1, value), strict=True):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, at: int, missing_left: bool) -> tuple[int, int]:
        left, right = self.leaf(), self.leaf()
        self.feature[node], self.bin[node], self.missing_left[node], self.left[node], self.right[node] = feature, at, missing_left, left, right
        return left, right

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, at, missing, left, right = (np.array(x) for x in (self.feature, self.bin, self.missing_left, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            open_ = feature[node] >= 0
            if not open_.any():
                return node
            n = node[open_]
            b = bins[rows[open_], feature[n]]
            to_left = np.where(b == MISSING, missing[n], b <= at[n])
            node[open_] = np.where(to_left, left[n], right[n])


@dataclass
class Model:
    """Classes, upper edges of the bins of each feature, and the trees of each iteration."""

    classes: list[str]
    edges: list[list[float]]
    start: list[float]
    trees: list[list[Tree]] = field(default_factory=list)
    version: int = FEATURE_VERSION

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return added(np.tile(np.array(self.start), (len(bins), 1)), bins, self.trees)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    """A saved model; one for another version of the features is refused."""
    d = json.loads(spark.read.text(path).first()["value"])
    if d["version"] != FEATURE_VERSION:
        raise ValueError(f"the model at {path} is for features of version {d['version']}, not {FEATURE_VERSION}")
    return Model(d["classes"], d["edges"], d["start"], [[Tree(**t) for t in step] for step in d["trees"]], d["version"])


def added(scores: np.ndarray, bins: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    for step in trees:
        for k, t in enumerate(step):
            scores[:, k] += np.array(t.value)[t.place(bins)]
    return scores


def shares(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of numbers as a matrix; nulls are NaN. Lists have one length, a null list is all missing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().drop_null().unique().to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"features have different lengths: {sorted(lengths)[:2]}")
    out = np.full((len(column), lengths[0] if lengths else 0), np.nan)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, out.shape[1])
    return out


def to_bins(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The number of edges below each value, or MISSING."""
    out = np.empty((len(values), len(edges)), np.uint8)
    for j, e in enumerate(edges):
        v = values[:, j] if j < values.shape[1] else np.full(len(values), np.nan)
        out[:, j] = np.where(np.isnan(v), MISSING, np.searchsorted(np.array(e), np.nan_to_num(v), side="left"))
    return out


def _edges(rows: DataFrame, features: str, n_bins: int) -> list[list[float]]:
    """Upper edges of all bins but the last, for each feature: quantiles that are values of the table."""
    v = rows.select(F.posexplode(features).alias("i", "v")).withColumn("v", F.nanvl(F.col("v").cast("double"), F.lit(None)))
    at = [j / n_bins for j in range(1, n_bins)]
    found = v.groupBy("i").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", at, 10_000))).alias("e"), F.max("v").alias("top")).orderBy("i").collect()
    return [[x for x in r["e"] or [] if x < r["top"]] for r in found]


def _binned(edges: list[list[float]]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = to_bins(matrix(b.column(2)), edges)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in bins], pa.binary())], ["y", "w", "bins"])

    return read


def _rows(b: pa.RecordBatch, d: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y, w = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    bins = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, d)
    scores = matrix(b.column(3)).copy() if b.num_columns > 3 else np.tile(start, (len(y), 1))
    return y, w, bins, scores


def _advance(d: int, start: np.ndarray, trees: list[list[Tree]]):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *_, bins, scores = _rows(b, d, start)
            scores = added(scores, bins, trees)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], ["y", "w", "bins", "scores"])

    return move


def _histograms(d: int, start: np.ndarray, trees: list[list[Tree]], growing: list[Tree], wanted: list[list[int]]):
    """class, node, block, and sums of gradient, curvature and rows by feature and bin of the task's rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(k, n): np.zeros((3, d * 256)) for k, nodes in enumerate(wanted) for n in nodes}
        for b in batches:
            y, w, bins, scores = _rows(b, d, start)
            p = shares(added(scores, bins, trees))
            cell = bins.astype(np.int64) + np.arange(d) * 256
            for k, nodes in enumerate(wanted):
                place = growing[k].place(bins) if nodes else None
                for n in nodes:
                    here = np.flatnonzero(place == n)
                    q, flat = p[here, k], cell[here].ravel()
                    for j, v in enumerate((w[here] * (q - (y[here] == k)), w[here] * q * (1 - q), np.ones(len(here)))):
                        sums[k, n][j] += np.bincount(flat, np.repeat(v, d), minlength=d * 256)
        rows = [(k, n, f // _BLOCK, s.reshape(3, d, 256)[:, f : f + _BLOCK].tobytes()) for (k, n), s in sums.items() for f in range(0, d, _BLOCK)]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["k", "node", "block", "sums"])

    return add


_SPLIT = "k int, node int, gain double, feature int, bin int, missing_left boolean, left array<double>, right array<double>, total array<double>"


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, least_rows: int) -> tuple | None:
    """gain, feature, bin, missing_left, and sums of either side, of the best split of a node by its histograms (features, 256).

    Of equal gains the first feature, then the least bin, then missing values to the right.
    """
    total = np.array([x[0].sum() for x in (g, h, n)])
    part = lambda a, b: a * a / (b + l2)
    best = None
    none = (n[:, MISSING] == 0)[:, None]
    below = [np.cumsum(x[:, :MISSING], axis=1)[:, :-1] for x in (g, h, n)]
    options = []
    for missing_left in (False, True):
        left = [a + x[:, MISSING :] if missing_left else a for a, x in zip(below, (g, h, n), strict=True)]
        right = [t - a for t, a in zip(total, left, strict=True)]
        gain = part(left[0], left[1]) + part(right[0], right[1]) - part(total[0], total[1])
        ok = (left[2] >= least_rows) & (right[2] >= least_rows) & (n[:, : MISSING - 1] > 0)
        options.append((np.where(ok & ~(none & missing_left), gain, -np.inf), left, right))
    gains = np.stack([o[0] for o in options], axis=-1)
    f, b, m = np.unravel_index(np.argmax(gains), gains.shape)
    if gains[f, b, m] > 0:
        left, right = ([x[f, b] for x in side] for side in options[m][1:])
        to_left = bool(m) if n[f, MISSING] else bool(left[2] > right[2])
        best = (float(gains[f, b, m]), int(f), int(b), to_left, [*map(float, left)], [*map(float, right)])
    return best


def _chooser(d: int, p: Boost):
    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        k, node, block = key
        sums = np.zeros((3, min(_BLOCK, d - block * _BLOCK), 256))
        for x in rows["sums"]:
            sums += np.frombuffer(x).reshape(sums.shape)
        found = best_split(*sums, p.l2, p.least_rows)
        total = [float(x[0].sum()) for x in sums]
        row = (k, node, *found[:1], found[1] + block * _BLOCK, *found[2:], total) if found else (k, node, None, None, None, None, None, None, total)
        return pd.DataFrame([row], columns=["k", "node", "gain", "feature", "bin", "missing_left", "left", "right", "total"]).astype({"feature": "Int32", "bin": "Int32", "missing_left": "boolean"})

    return choose


class _Growth:
    """One class's tree while it grows: the best split of every node that is known so far."""

    def __init__(self, p: Boost):
        self.p = p
        #: By path (sides from the root): the best split, or None where there is none.
        self.known: dict[tuple, tuple | None] = {}
        self.total: list[float] | None = None

    def draw(self) -> tuple[Tree, dict[int, tuple], bool]:
        """The tree as far as it is known, the leaves that wait for their split with their paths, and whether it is final.

        While a leaf waits, the leaves split besides may be too many; the tree is drawn again when more is known, and is final
        when every leaf that was offered is known, so that leaves were split in order of gain.
        """
        tree = Tree()
        tree.leaf()
        sums: dict[int, list[float]] = {0: self.total or [0.0, 0.0, 0.0]}
        waiting: dict[int, tuple] = {}
        heap: list[tuple] = []

        def offer(node: int, path: tuple) -> None:
            if path not in self.known:
                if self.total is not None and sums[node][2] < 2 * self.p.least_rows:
                    return
                waiting[node] = path
            elif self.known[path] is not None:
                heapq.heappush(heap, (-self.known[path][0], len(tree.feature), node, path))

        offer(0, ())
        leaves = 1
        while heap and leaves < self.p.leaves:
            _, _, node, path = heapq.heappop(heap)
            _, feature, at, missing_left, left, right = self.known[path]
            leaves += 1
            for side, child in enumerate(tree.split(node, feature, at, missing_left)):
                sums[child] = (left, right)[side]
                if leaves < self.p.leaves:
                    offer(child, (*path, side))
        for n, s in sums.items():
            if tree.feature[n] < 0:
                tree.value[n] = -self.p.rate * s[0] / (s[1] + self.p.l2)
        return tree, waiting, not waiting


def fit(rows: DataFrame, target: str, features: str = "features", boost: Boost = Boost()) -> Model:  # noqa: B008
    """A model of ``target``, from its non-null rows. features: an array of numbers of one length, null or NaN where missing."""
    spark, p = rows.sparkSession, boost
    ship(spark)
    tables = Tables(spark)
    rows = rows.where(F.col(target).isNotNull() & F.col(features).isNotNull()).select(F.col(target).cast("string").alias("c"), F.col(features).alias("x"))
    counts = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}  # one row a class
    classes = sorted(counts)
    if not classes:
        raise ValueError(f"no row has {target} and features")
    weight = {c: sum(counts.values()) / (len(classes) * counts[c]) if p.balanced else 1.0 for c in classes}
    mass = np.array([weight[c] * counts[c] for c in classes])
    edges = _edges(rows, "x", p.bins)
    d, start = len(edges), np.log(mass / mass.sum())
    start = start - start.mean()
    model = Model(classes, edges, start.tolist())
    names = spark.createDataFrame([(c, i, float(weight[c])) for i, c in enumerate(classes)], "c string, y int, w double")
    data = tables.save(rows.join(F.broadcast(names), "c").select("y", "w", "x").mapInArrow(_binned(edges), "y int, w double, bins binary"))
    recent: list[list[Tree]] = []
    for step in range(p.iterations):
        growths = [_Growth(p) for _ in classes]
        while True:
            drawn = [g.draw() for g in growths]
            wanted = [[] if done else sorted(waiting) for _, waiting, done in drawn]
            if not any(wanted):
                break
            parts = data.mapInArrow(_histograms(d, start, recent, [t for t, *_ in drawn], wanted), "k int, node int, block int, sums binary")
            found = parts.groupBy("k", "node", "block").applyInPandas(_chooser(d, p), _SPLIT)
            seen = Window.partitionBy("k", "node").orderBy(F.col("gain").desc_nulls_last(), "feature")
            for r in found.withColumn("_n", F.row_number().over(seen)).where("_n = 1").collect():  # one row a class and open leaf
                g, (_, waiting, _) = growths[r["k"]], drawn[r["k"]]
                path = waiting[r["node"]]
                g.known[path] = (r["gain"], r["feature"], r["bin"], r["missing_left"], r["left"], r["right"]) if r["gain"] is not None else None
                if not path:
                    g.total = r["total"]
        recent.append([t for t, *_ in drawn])
        model.trees.append(recent[-1])
        if len(recent) == p.refresh and step + 1 < p.iterations:
            moved = tables.save(data.mapInArrow(_advance(d, start, recent), "y int, w double, bins binary, scores array<double>"))
            tables.drop(data)
            data, recent = moved, []
    tables.drop(data)
    return model


def _predictor(model: Model):
    def predict(x: pa.Array) -> pa.Array:
        p = shares(model.scores(to_bins(matrix(x), model.edges)))
        best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(np.array(model.classes, object)[best], pa.string()), pa.array(p.max(axis=1) if len(p) else [], pa.float64())], ["label", "share"])

    return arrow_udf(predict, returnType="struct<label:string,share:double>").asNondeterministic()


def predict(model: Model, rows: DataFrame, target: str, features: str = "features") -> DataFrame:
    """rows with <target>_pred and <target>_conf (to 3 places)."""
    ship(rows.sparkSession)
    out = rows.withColumn("_boosted", _predictor(model)(F.col(features)))
    return out.select(*rows.columns, F.col("_boosted.label").alias(f"{target}_pred"), F.round("_boosted.share", 3).alias(f"{target}_conf"))
