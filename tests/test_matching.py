import random

from pyspark.sql import functions as F

from kairoframe.functions.metrics import prf
from kairoframe.operators import matching, report


def events(spark, frames, video=1):
    return spark.createDataFrame([(video, f) for f in frames], "video long, frame long")


def brute(pred, gt, tol):
    pairs, p_used, g_used = [], set(), set()
    for _, p, g in sorted((abs(p - g), p, g) for p in pred for g in gt if abs(p - g) <= tol):
        if p not in p_used and g not in g_used:
            p_used.add(p)
            g_used.add(g)
            pairs.append((p, g))
    return sorted(pairs)


def test_match_fixtures(spark):
    m = lambda p, g: sorted((r["p"], r["g"]) for r in matching.match_greedy(events(spark, p), events(spark, g), 4).collect())
    assert m([10, 20, 21], [12, 20, 40]) == [(10, 12), (20, 20)]
    assert m([0, 4], [3, 8]) == [(4, 3)]


def test_match_random_and_report(spark):
    rng = random.Random(2)
    pred, gt = (sorted(rng.sample(range(300), 80)) for _ in range(2))
    assert sorted((r["p"], r["g"]) for r in matching.match_greedy(events(spark, pred), events(spark, gt), 3).collect()) == brute(pred, gt, 3)
    rows = {r["video"]: r for r in matching.match_report(events(spark, pred), events(spark, gt), 3).collect()}
    for r in rows.values():
        assert r["tp"] + r["fp"] == 80 and r["tp"] + r["fn"] == 80
    assert set(rows) == {1, None}


def test_prf(spark):
    t = spark.createDataFrame([(2, 1, 1), (0, 0, 0), (203, 278, 8)], "tp long, fp long, fn long")
    got = t.select(*[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()]).collect()
    assert [tuple(r) for r in got] == [(0.6667, 0.6667, 0.6667), (0.0, 0.0, 0.0), (0.422, 0.9621, 0.5867)]


def test_classification(spark):
    t = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "t string, p string")
    assert tuple(matching.classification_report(t, "t", "p").first()) == (3, 0.6667, 0.8333)


def test_landings(spark):
    hits = spark.createDataFrame([(1, 0, "right"), (1, 10, "left"), (1, 20, "right")], "video long, frame long, side string")
    b = spark.createDataFrame([(1, 3, "left"), (1, 5, "left"), (1, 10, "right"), (1, 25, "left")], "video long, frame long, half string")
    assert [r["landing"] for r in matching.landings(hits, b).orderBy("frame").collect()] == [3, None, 25]


def test_endings_take_the_first_rally(spark):
    ends = spark.createDataFrame([(1, 10, "left"), (1, 99, "left")], "video long, frame long, winner string")
    r = spark.createDataFrame([(1, 1, 5, 20, "right"), (1, 0, 0, 9, "left")], "video long, rally long, start long, end long, point_winner string")
    assert [(x["rally"], x["predicted"]) for x in matching.endings_in_rallies(ends, r, 3).orderBy("frame").collect()] == [(0, "left"), (None, None)]


def _findings(spark, **over):
    base = {"strokes": 8, "forehand": 4, "backhand": 4, "lean": {"neutral": 8}, "feet": {"both_feet_planted": 8}, "technique": {"loop": 8}, "forehand_avg": None, "backhand_avg": None, "lost": 0, "lost_net": 0, "lost_out": 0} | over
    schema = "strokes long, forehand long, backhand long, lean map<string,long>, feet map<string,long>, technique map<string,long>, forehand_avg double, backhand_avg double, lost long, lost_net long, lost_out long"
    df = spark.createDataFrame([tuple(base.values())], schema)
    got = df.select(report.findings(df)).first()[0]
    assert all(t["evidence"] for t in got)
    return [t["title"] for t in got]


def test_findings(spark):
    assert _findings(spark, strokes=3) == ["Not enough strokes detected"]
    assert _findings(spark, forehand=7, backhand=1) == ["Backhand is under-used"]
    assert _findings(spark, strokes=10, lean={"back_heavy": 2, "neutral": 8}) == ["Solid, balanced session"]
    assert _findings(spark, forehand_avg=40.0, backhand_avg=20.0, lost=3, lost_out=2, lost_net=1) == ["Backhand lacks pace", "Errors long or wide"]


def test_speed_counts_a_gap_as_one_step(spark):
    t = spark.createDataFrame([(1, f, float(x), 0.0) for f, x in ((1, 0), (2, 10), (4, 20), (5, 30))] + [(1, 3, None, None)], "video long, frame long, x double, y double")
    h = spark.createDataFrame([(1, 0)], "video long, frame long")
    assert report.shot_speeds(h, t, 25.0, 0.01, 1, 7).first()["speed_kmh"] == 9.0
