import pytest
from pyspark.sql import functions as F

from kairoframe.functions import labels as L

CASES = [
    ("bounce", "bounce", None, None, None, None, None, None, None),
    ("net", "net_cross", None, None, None, None, None, None, None),
    ("empty_event", "empty", None, None, None, None, None, None, None),
    ("left_forehand_loop neutral both_feet_planted", "stroke", "left", "forehand", "loop", "neutral", "both_feet_planted", None, None),
    ("xright_backhand_chop back_heavyn", "stroke", "right", "backhand", "chop", "back_heavy", "unknown", None, None),
    ("right_forehand_push both", "stroke", "right", "forehand", "push", "unknown", "unknown", None, None),
    ("right_forehand_push neutral both", "stroke", "right", "forehand", "push", "neutral", "both_feet_planted", None, None),
    ("right_forehand_push right", "stroke", "right", "forehand", "push", "right_leaning", "unknown", None, None),
    ("right_out", "rally_end", "right", None, None, None, None, "out", "left"),
    ("right_net", "rally_end", "right", None, None, None, None, "net", "left"),
    ("left_double_bounce", "rally_end", "left", None, None, None, None, "double_bounce", "left"),
    ("left_winner", "rally_end", "left", None, None, None, None, "winner", "left"),
    ("left_miss_on_own_side", "rally_end", "left", None, None, None, None, "miss_on_own_side", "right"),
    ("point",) + (None,) * 8,
    ("",) + (None,) * 8,
    ("right_forehand_drive",) + (None,) * 8,
    (None,) + (None,) * 8,
]


def test_parse_label(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string").withColumn("e", L.parse_label(F.col("raw")))
    got = {r["i"]: r for r in rows.withColumn("w", L.point_winner(F.col("e.kind"), F.col("e.side"), F.col("e.outcome"))).collect()}
    for i, c in enumerate(CASES):
        e = got[i]["e"]
        assert (tuple(e) if e else (None,) * 7) + (got[i]["w"],) == c[1:], c[0]


@pytest.mark.parametrize(("label", "expected"), [("left", "right"), ("right_leaning", "left_leaning"), ("neutral", "neutral"), ("left_foot_lifted", "right_foot_lifted")])
def test_mirror(spark, label, expected):
    assert spark.createDataFrame([(label,)], "a string").select(L.mirrored(F.col("a"))).first()[0] == expected
