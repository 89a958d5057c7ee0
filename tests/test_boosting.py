"""Boosting against a plain numpy version that keeps the rows of every leaf."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoframe.operators import boosting, models
from kairoframe.operators.boosting import Boost


def brute_split(x, g, h, edges, p):
    """Tries every feature, edge and side for missing values, row by row."""
    best, part = None, lambda a, b: a * a / (b + p.l2)
    for f, e in enumerate(edges):
        gone = np.isnan(x[:, f])
        for at, edge in enumerate([*e, np.inf] if gone.any() else e):  # the last one parts missing values from all others
            if not (np.searchsorted(e, x[~gone, f]) == at).any():
                continue
            for missing_left in (False, True) if gone.any() else (False,):
                left = np.where(gone, missing_left, x[:, f] <= edge)
                if min(left.sum(), (~left).sum()) < p.least_rows:
                    continue
                gain = part(g[left].sum(), h[left].sum()) + part(g[~left].sum(), h[~left].sum()) - part(g.sum(), h.sum())
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, edge, missing_left if gone.any() else left.sum() > (~left).sum(), left)
    return best


def brute_tree(x, g, h, edges, p):
    """A function from rows to values."""
    leaves = [(np.arange(len(x)), brute_split(x, g, h, edges, p), {})]
    root = leaves[0][2]
    while len(leaves) < p.leaves and any(b for _, b, _ in leaves):
        i = max((i for i, (_, b, _) in enumerate(leaves) if b), key=lambda i: leaves[i][1][0])
        rows, (_, f, edge, to_left, left), node = leaves.pop(i)
        node.update(f=f, edge=edge, to_left=to_left, kids=({}, {}))
        for part, kid in ((rows[left], node["kids"][0]), (rows[~left], node["kids"][1])):
            leaves.append((part, brute_split(x[part], g[part], h[part], edges, p), kid))
    for rows, _, node in leaves:
        node["value"] = -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)

    def value(r, node=root):
        while "kids" in node:
            v = r[node["f"]]
            node = node["kids"][0 if (node["to_left"] if np.isnan(v) else v <= node["edge"]) else 1]
        return node["value"]

    return value


def brute(x, y, classes, p, new):
    edges = []
    for f in range(x.shape[1]):
        v = np.sort(x[~np.isnan(x[:, f]), f])
        e = {v[max(int(np.ceil(j / p.bins * len(v))) - 1, 0)] for j in range(1, p.bins)} if len(v) else set()
        edges.append(sorted(z for z in e if z < v[-1]))
    w = np.array([len(y) / (len(classes) * (y == k).sum()) for k in y])
    scores, out = np.zeros((len(x), len(classes))), np.zeros((len(new), len(classes)))
    for _ in range(p.iterations):
        q = boosting.shares(scores)
        steps = [brute_tree(x, w * (q[:, k] - (y == c)), w * q[:, k] * (1 - q[:, k]), edges, p) for k, c in enumerate(classes)]
        for rows, s in ((x, scores), (new, out)):
            for k, tree in enumerate(steps):
                s[:, k] += [tree(r) for r in rows]
    return boosting.shares(out)


def data(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.choice("aabc")
        x = [rng.gauss("abc".index(c), 1.0), rng.choice([None, 1.0, 2.0, 3.0]), None if (c == "b") == (rng.random() < 0.7) else rng.random(), float("nan")]
        rows.append((i, c, "left" if i % 3 else "right", x))
    return rows


TYPES = "id long, hand string, side string, features array<double>"


def arrays(rows):
    return np.array([[np.nan if v is None else v for v in r[3]] for r in rows]), np.array([r[1] for r in rows])


@pytest.mark.parametrize("p", [Boost(iterations=3, leaves=4, least_rows=10, rate=0.3, refresh=2), Boost(iterations=1, leaves=7, least_rows=5, rate=0.3, bins=9)])
def test_equals_the_plain_version(spark, p):
    rows = data(2, 240)
    df = spark.createDataFrame(rows, TYPES).repartition(3)
    fit, held = df.where("id < 180"), df.where("id >= 180")
    model = boosting.fit(fit, "hand", boost=p)
    (x, y), (new, _) = arrays(rows[:180]), arrays(rows[180:])
    want = brute(x, y, ["a", "b", "c"], p, new)
    got = {r["id"]: r for r in boosting.predict(model, held, "hand").collect()}
    assert [got[180 + i]["hand_conf"] for i in range(60)] == pytest.approx(np.round(want.max(axis=1), 3).tolist(), abs=2e-3)
    clear = [i for i in range(60) if np.sort(want[i])[-1] - np.sort(want[i])[-2] > 1e-9]
    assert [got[180 + i]["hand_pred"] for i in clear] == ["abc"[want[i].argmax()] for i in clear]
    assert np.allclose(boosting.shares(model.scores(boosting.to_bins(new, model.edges))), want)


def test_report_by_side_saved_models_and_odd_tables(spark, tmp_path):
    rows = data(5, 200)
    df = spark.createDataFrame([*rows, (900, None, "left", [1.0, 1.0, 1.0, 1.0]), (901, "a", "left", None)], TYPES)
    model = boosting.fit(df.where("id < 150 or id >= 900"), "hand", boost=Boost(iterations=2, leaves=3, least_rows=10, rate=0.5))
    model.save(spark, str(tmp_path / "m"))
    again = boosting.load(spark, str(tmp_path / "m"))
    held = df.where("id >= 150")
    a, b = (sorted(map(str, boosting.predict(m, held, "hand").collect())) for m in (model, again))
    assert a == b and len(a) == 52
    report = models.side_report(boosting.predict(model, held, "hand").where("hand is not null"), "right", ("hand",)).first()
    assert report["n"] == sum(1 for r in rows[150:] if r[2] == "right") and report["accuracy"] > 0.4
    assert boosting.predict(model, held.limit(0), "hand").count() == 0
    old = boosting.Model(model.classes, model.edges, model.start, model.trees, 1)
    old.save(spark, str(tmp_path / "old"))
    with pytest.raises(ValueError, match="version 1"):
        boosting.load(spark, str(tmp_path / "old"))
    with pytest.raises(ValueError, match="no row"):
        boosting.fit(df.where(F.lit(False)), "hand")
