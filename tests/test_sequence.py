import random

import numpy as np
import pytest

from kairoframe.operators import sequence, signal


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def traj(spark, xs, ys=None, video=1):
    return frame(spark, [(video, i, x, (ys or xs)[i]) for i, x in enumerate(xs)], "video long, frame long, x double, y double")


def test_suppression_fixture(spark):
    c = frame(spark, list(zip([1] * 4, [10, 12, 40, 41], [9.0, 8.0, 7.0, 6.0], strict=True)), "video long, frame long, score double")
    assert sorted(r["frame"] for r in sequence.suppress(c, 4).collect()) == [10, 40]


def greedy(rows, radius):
    kept = []
    for s, f in sorted((-s, f) for f, s in rows):
        if all(abs(f - k) > radius for k in kept):
            kept.append(f)
    return sorted(kept)


def test_suppression_random(spark):
    rng = random.Random(4)
    rows = [(v, rng.randint(0, 120), float(rng.randint(0, 9))) for v in range(8) for _ in range(60)]
    got = sequence.suppress(frame(spark, rows, "video long, frame long, score double"), 3).collect()
    for v in range(8):
        frames = sorted(r["frame"] for r in got if r["video"] == v)
        assert frames == greedy([(f, s) for w, f, s in rows if w == v], 3)
        assert all(b - a > 3 for a, b in zip(frames, frames[1:], strict=False))


@pytest.mark.parametrize(("xs", "expected"), [([90.0, 110.0, 90.0], [1]), ([90.0, 100.0, 110.0], []), ([90.0, None, 110.0], []), ([], [])])
def test_net_crossings(spark, xs, expected):
    t = traj(spark, xs) if xs else traj(spark, [1.0]).limit(0)
    assert [r["frame"] for r in sequence.net_crossings(t, 100.0, 9).collect()] == expected


def test_net_crossings_debounce_from_last_emitted(spark):
    xs = [90.0 if i % 2 else 110.0 for i in range(40)]
    want, last = [], None
    for t in range(1, 40):
        if last is None or t - last > 3:
            want.append(t)
            last = t
    assert sorted(r["frame"] for r in sequence.net_crossings(traj(spark, xs), 100.0, 3).collect()) == want


def test_smoothing_and_gradient(spark):
    got = {r["frame"]: r for r in signal.smooth(traj(spark, [0.0, None, 6.0, 9.0])).collect()}
    assert [got[i]["sx"] for i in range(4)] == [0.0, None, 7.5, 7.5]


@pytest.mark.parametrize("bucket", [4, 1 << 16])
def test_windows_do_not_depend_on_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(signal, "with_margin", lambda df, reach, frame="frame", bucket=bucket, f=signal.with_margin: f(df, reach, frame, bucket))
    rng = np.random.default_rng(1)
    xs = [None if rng.random() < 0.2 else float(x) for x in rng.integers(0, 100, 60)]
    s = [None if xs[i] is None else float(np.mean([v for v in xs[max(i - 1, 0) : i + 2] if v is not None])) for i in range(60)]
    g = [None] * 60
    for i in range(60):
        a, b = (s[max(i - 1, 0)], s[min(i + 1, 59)])
        if a is not None and b is not None:
            g[i] = (b - a) / (2 if 0 < i < 59 else 1)
    got = {r["frame"]: r for r in signal.own(signal.motion(traj(spark, xs), "x", 2)).collect()}
    for i in range(60):
        assert (got[i]["v"] is None) == (g[i] is None) and (g[i] is None or abs(got[i]["v"] - g[i]) < 1e-9)
    assert len(got) == 60


@pytest.mark.parametrize(("xs", "gap", "expected"), [([0.0, None, None, 9.0], 8, [0, 3, 6, 9]), ([0.0] + [None] * 8 + [9.0], 8, [0.0] + [None] * 8 + [9.0]), ([None, 1.0, None], 8, [None, 1.0, None])])
def test_gap_filling(spark, xs, gap, expected):
    got = {r["frame"]: r["fx"] for r in signal.fill_gaps(traj(spark, xs), gap).collect()}
    assert [got[i] for i in range(len(xs))] == expected


def test_segments(spark):
    f = lambda xs: frame(spark, [(1, x) for x in xs], "video long, frame long")
    assert sorted((r["lo"], r["hi"]) for r in sequence.segments(f([100, 150, 400]), 60, 40).collect()) == [(40, 190), (340, 440)]
    assert [(r["lo"], r["hi"]) for r in sequence.segments(f([30]), 60, 40).collect()] == [(0, 70)]


HITS = "video long, frame long, side string, serve boolean, score double, rally long"


def test_alternation(spark):
    h = frame(spark, [(1, 0, "right", True, 1.0, 0), (1, 5, "right", False, 3.0, 0), (1, 9, "left", False, 2.0, 0)], HITS)
    assert sorted((r["side"], r["score"]) for r in sequence.alternate(h).collect()) == [("left", 2.0), ("right", 3.0)]


@pytest.mark.parametrize(
    ("hits", "bounces", "expected"),
    [
        ([(0, "right"), (60, "left"), (120, "right")], [(30, "left"), (150, "left")], (0, 150, "winner", "right")),
        ([(0, "right"), (60, "left"), (120, "right")], [(30, "left"), (150, "right")], (0, 150, "net", "left")),
        ([(0, "right"), (60, "left"), (120, "right")], [(30, "left")], (0, 120, "out", "left")),
        ([(0, "right")], [], None),
        ([(0, "right")], [(20, "left")], (0, 20, "winner", "right")),
    ],
)
def test_rally_outcomes(spark, hits, bounces, expected):
    h = frame(spark, [(1, f, s, i == 0, 1.0) for i, (f, s) in enumerate(hits)], "video long, frame long, side string, serve boolean, score double")
    b = frame(spark, [(1, f, s) for f, s in bounces], "video long, frame long, half string")
    r = sequence.rallies(sequence.alternate(sequence.rally_sessions(h, 300)), b, 180).collect()
    assert [(x["start"], x["end"], x["outcome"], x["point_winner"]) for x in r] == ([expected] if expected else [])


def test_sessions_partition_hits(spark):
    h = frame(spark, [(1, f, "left", f == 40, 1.0) for f in (0, 5, 30, 40, 41)], "video long, frame long, side string, serve boolean, score double")
    assert [r["rally"] for r in sequence.rally_sessions(h, 10).orderBy("frame").collect()] == [0, 0, 1, 2, 2]


def test_far_from_and_contexts(spark):
    a = frame(spark, [(1, f) for f in (0, 10, 20, 26)], "video long, frame long")
    b = frame(spark, [(1, 12), (1, 30), (2, 0)], "video long, frame long")
    assert sorted(r["frame"] for r in sequence.far_from(a, b, 2).collect()) == [0, 20, 26]
    h = frame(spark, [(1, 0, "left", False, 1.0), (1, 120, "right", False, 1.0), (1, 600, "left", False, 1.0)], "video long, frame long, side string, serve boolean, score double")
    got = sequence.contexts(h, 120.0).orderBy("frame").collect()
    assert [(r["first_of_rally"], r["since_prev_s"]) for r in got] == [(True, None), (False, 1.0), (True, None)]
