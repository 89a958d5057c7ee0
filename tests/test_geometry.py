import numpy as np
from pyspark.sql import functions as F

from kairoframe.functions import geometry as G

FLAT = [(0.0, 0.0), (274.0, 0.0), (274.0, 152.5), (0.0, 152.5)]
SKEW = [(20.0, 25.0), (80.0, 28.0), (95.0, 75.0), (5.0, 70.0)]


def test_flat_table(spark):
    t = G.TableShape(FLAT)
    assert abs(t.net_x - 137) < 1e-6 and abs(t.length_px - 274) < 1e-9 and abs(t.m_per_px - 0.01) < 1e-9
    u, v = G.to_table(F.col("x"), F.col("y"), t.h)
    rows = spark.createDataFrame([(136.0, 50.0), (137.5, 50.0)], "x double, y double").select(u.alias("u"), v.alias("v"), G.half(u).alias("half")).collect()
    assert [r["half"] for r in rows] == ["left", "right"] and abs(rows[0]["u"] - 1.36) < 1e-9 and abs(rows[0]["v"] - 0.5) < 1e-9


def test_perspective_corners_and_collinearity(spark):
    h = G.homography(SKEW)
    u, v = G.to_table(F.col("x"), F.col("y"), h)
    got = spark.createDataFrame(SKEW, "x double, y double").select(u, v).collect()
    np.testing.assert_allclose(np.array(got, float), [(0, 0), (2.74, 0), (2.74, 1.525), (0, 1.525)], atol=1e-9)
    assert abs(h[6]) + abs(h[7]) > 1e-4  # a real perspective


def test_order_corners():
    assert G.order_corners([SKEW[2], SKEW[0], SKEW[3], SKEW[1]]) == SKEW


def test_polygon_distance(spark):
    d = G.polygon_distance(F.col("x"), F.col("y"), FLAT)
    rows = spark.createDataFrame([(10.0, 20.0), (-3.0, 50.0), (-3.0, -4.0), (0.0, 5.0)], "x double, y double").select(d).collect()
    np.testing.assert_allclose([r[0] for r in rows], [10, -3, -5, 0], atol=1e-9)


def test_iou_and_angle(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), G.angle(*box(0, 1, 0, 0, 1, 0)), G.angle(*box(0, 0, 0, 0, 1, 0))).first()
    assert abs(row[0] - 1 / 7) < 1e-6 and abs(row[1] - 90) < 1e-9 and row[2] is None
