"""Players followed from frame to frame, and whole poses filled, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from kairoframe.operators import pose


def brute(rows, net, margin):
    """Frame by frame, with each side's last place carried on."""
    out, at, frames = [], {}, {}
    for v, f, i, x1, y1, x2, y2 in rows:
        frames.setdefault((v, f), []).append((i, (x1 + x2) / 2, y2 - y1))
    for v, f in sorted(frames):
        for side in ("left", "right"):
            best, top = None, float("-inf")
            for i, c, h in sorted(frames[v, f]):
                if (side == "right" and c < net(v) + margin) or (side == "left" and c > net(v) - margin):
                    continue
                score = h - (0.5 * abs(c - at[v, side]) if (v, side) in at else 0.0)
                if score > top:
                    best, top = (i, c, h), score
            if best:
                at[v, side] = best[1]
                out.append((v, f, side, *best))
    return sorted(out)


def people(seed, videos, frames):
    rng, rows = random.Random(seed), []
    for v in range(videos):
        for f in range(frames):
            if rng.random() < 0.15:
                continue  # nobody in this frame
            for i in range(rng.randint(0, 4)):
                x, y = float(rng.randint(0, 90)), float(rng.randint(0, 20))
                rows.append((v, f, i, x, y, x + 10.0, y + float(rng.choice([20, 20, 24, 30]))))
    return rows


TYPES = "video long, frame long, id long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("block", [1, 7, 256])
def test_random_people(spark, block):
    rows = people(block, 4, 60)
    got = pose.follow_players(spark.createDataFrame(rows, TYPES).repartition(4), 50.0, 4.0, block)
    assert sorted(map(tuple, got.select("video", "frame", "side", "id", "x", "height").collect())) == brute(rows, lambda v: 50.0, 4.0)


def test_net_by_video(spark):
    rows = people(9, 3, 30)
    df = spark.createDataFrame(rows, TYPES).withColumn("net", 30.0 + 10.0 * F.col("video"))
    got = pose.follow_players(df, F.col("net"), F.lit(2.0), 5)
    assert sorted(map(tuple, got.select("video", "frame", "side", "id", "x", "height").collect())) == brute(rows, lambda v: 30.0 + 10.0 * v, 2.0)


def test_one_long_video_is_many_blocks(spark):
    """Two people of about one height on one side, so that no frame decides by itself."""
    rng = random.Random(1)
    rows = [(7, f, i, 60.0 + 15 * i + rng.random(), 0.0, 70.0 + 15 * i + rng.random(), 20.0 + rng.random()) for f in range(3000) for i in range(2)]
    got = pose.follow_players(spark.createDataFrame(rows, TYPES), 50.0, 4.0, 64)
    assert sorted(map(tuple, got.select("video", "frame", "side", "id", "x", "height").collect())) == brute(rows, lambda v: 50.0, 4.0)
    assert "Window" in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_people(spark):
    assert pose.follow_players(spark.createDataFrame([], TYPES), 50.0, 4.0).count() == 0


def brute_fill(track, max_gap):
    known = [i for i, p in enumerate(track) if p is not None and p[0] is not None and p[0][0] is not None]
    out = list(track)
    for a, b in zip(known, known[1:], strict=False):
        for t in range(a + 1, b) if 1 < b - a <= max_gap else []:
            w = (t - a) / (b - a)
            out[t] = [None if p is None or q is None else tuple(None if m is None or n is None else m + w * (n - m) for m, n in zip(p, q, strict=True)) for p, q in zip(track[a], track[b], strict=True)]
    return out


def test_whole_poses_are_filled(spark):
    rng = random.Random(5)
    tracks = {}
    for v in range(3):
        tracks[v] = [None if rng.random() < 0.3 else [None if rng.random() < 0.2 else (rng.random(), None if rng.random() < 0.1 else rng.random(), rng.random()) for _ in range(17)] for _ in range(80)]
    rows = [(v, f, p) for v, t in tracks.items() for f, p in enumerate(t)]
    df = spark.createDataFrame(rows, "video long, frame long, pose array<struct<x:double,y:double,conf:double>>")
    for gap in (2, 5):
        got = {(r["video"], r["frame"]): r["pose"] for r in pose.fill_poses(df, gap).collect()}
        assert len(got) == len(rows)
        for v, t in tracks.items():
            for f, want in enumerate(brute_fill(t, gap)):
                p = got[v, f]
                assert (p is None) == (want is None)
                for a, b in zip(p or [], want or [], strict=True):
                    assert (a is None) == (b is None)
                    for m, n in zip(a or [], b or [], strict=True):
                        assert m == n or abs(m - n) < 1e-12
