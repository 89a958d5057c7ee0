import pytest
from pyspark.sql import functions as F

from kairoframe.operators import models, pose


def test_forest_learns_with_missing_values(spark, tmp_path):
    rows = spark.range(240).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("hand"), F.array(F.when(F.col("id") % 5 != 0, (F.col("id") % 2).cast("double")), F.lit(float("nan")), (F.col("id") % 7).cast("double")).alias("features"))
    model = models.fit(rows.where("id < 160"), "hand", trees=10, depth=3)
    models.save(model, str(tmp_path))
    got = models.predict(models.load(str(tmp_path)), rows.where("id >= 160 and id % 5 <> 0"), "hand")
    assert got.where("hand = hand_pred").count() == got.count() == 64
    assert got.where("hand_conf < 0.5 or hand_conf > 1").count() == 0


def test_heuristic(spark):
    r = spark.range(1).select(models.heuristic(F.lit(True)).alias("a"), models.heuristic(F.lit(False)).alias("b")).first()
    assert r["a"]["technique"] == "serve" and r["b"]["technique"] == "unknown"


CONTACT = "video long, frame long, side string, racket string, first_of_rally boolean, since_prev_s double, slope double, level double"


def body(spark):
    pts = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct((i * 3 % 7 + F.col("frame")).cast("double").alias("x"), (i * 10).cast("double").alias("y")))
    return spark.range(60).select(F.lit(1).cast("long").alias("video"), F.col("id").alias("frame")).withColumn("pose", pts)


def test_features_have_their_size_and_are_mirrored(spark):
    ball = spark.range(60).select(F.lit(1).cast("long").alias("video"), F.col("id").alias("frame"), (F.col("id") * 3.0).alias("x"), F.when(F.col("id") != 25, F.col("id") * -2.0).alias("y"))
    rows = [(1, 20, "left", "R", True, None, 0.5, 4.0), (1, 20, "right", "R", False, 1.5, None, None), (1, 3, "right", "L", False, 0.5, 0.5, 4.0), (1, 25, "left", "L", True, None, 0.5, 4.0)]
    got = {(r["frame"], r["side"]): r["features"] for r in pose.stroke_features(spark.createDataFrame(rows, CONTACT), body(spark), ball).collect()}
    assert {len(v) for v in got.values()} == {263} and len(got) == 4
    left, right = got[20, "left"], got[20, "right"]
    assert left[0] == -right[0] and left[1] == right[1]
    assert got[3, "right"][0] is None  # before the first frame
    hip, sho = (11 * 3 % 7 + 12 * 3 % 7) / 2, (5 * 3 % 7 + 6 * 3 % 7) / 2
    size = ((sho - hip) ** 2 + 60**2) ** 0.5
    near = lambda a, b: abs(a - b) < 1e-9
    assert near(right[249], 3 / size) and near(right[250], -2 / size) and near(left[251], -3.5 / size) and near(left[252], -7 / 3 / size)  # ball in and out; a missing sample isn't a step
    assert near(right[253], (3.5**2 + (7 / 3) ** 2) ** 0.5 / size) and near(right[255], 7 / 6) and near(right[256], (60 - 20 - hip) / size)
    assert right[258] is None and near(left[258], (-40 - 4 - 30) / size) and got[25, "left"][256] is None
    assert left[259:] == [1.0, None, 1.0, 1.0] and right[259:] == [0.0, 1.5, 0.0, 0.0] and got[25, "left"][261] == 0.0


def test_missing_torsos_take_the_median_of_the_frames_around(spark):
    poses = body(spark).withColumn("pose", F.when(F.col("frame") == 20, F.transform("pose", lambda p: F.when(p["y"] < 100, p))).otherwise(F.col("pose")))
    rows = [(1, f, "right", "R", False, 0.5, None, None) for f in (19, 20)]
    none = spark.createDataFrame([], "video long, frame long, x double, y double")
    got = {r["frame"]: r["features"] for r in pose.stroke_features(spark.createDataFrame(rows, CONTACT), poses, none).collect()}
    # the hips of frames 0 to 39 but 20 have their middle at frame 19, at x = 3 + 19; the nose is at x = 18 two frames before
    assert abs(got[20][4 * 26] - (18 - 22) / (60**2 + 0.5**2) ** 0.5) < 1e-9 and got[20][5 * 26 + 14] is None and got[20][5 * 26] is not None


def test_players_stay_where_they_were(spark):
    people = spark.createDataFrame([(1, 0, 1, 80.0, 0.0, 90.0, 50.0), (1, 0, 2, 150.0, 0.0, 160.0, 60.0)], "video long, frame long, id long, x1 double, y1 double, x2 double, y2 double")
    before = spark.createDataFrame([(1, "right", 85.0)], "video long, side string, x double")
    assert pose.choose_players(people, 60.0, 8.0).first()["id"] == 2 and pose.choose_players(people, 60.0, 8.0, before).first()["id"] == 1


def test_all_targets_and_their_report_by_side(spark):
    y = F.when(F.col("id") % 2 == 0, "a").otherwise("b")
    rows = spark.range(120).select("id", *[y.alias(t) for t in models.TARGETS], F.when(F.col("id") % 3 == 0, "left").otherwise("right").alias("side"), F.array((F.col("id") % 2).cast("double")).alias("features"))
    said = models.predict_all(models.fit_all(rows.where("id < 80"), trees=5, depth=2), rows.where("id >= 80"))
    got = {r["target"]: (r["n"], r["accuracy"], r["macro_f1"]) for r in models.side_report(said).collect()}
    assert got == {t: (rows.where("id >= 80 and side = 'right'").count(), 1.0, 1.0) for t in models.TARGETS}
    assert models.side_report(said, None).first()["n"] == 40


def test_a_torso_without_length_gives_nothing_and_stops_nothing(spark):
    flat = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(F.lit(5.0).alias("x"), F.lit(6.0).alias("y")))
    poses = spark.range(60).select(F.lit(1).cast("long").alias("video"), F.col("id").alias("frame"), flat.alias("pose"))
    ball = spark.range(60).select(F.lit(1).cast("long").alias("video"), F.col("id").alias("frame"), (F.col("id") * 3.0).alias("x"), (F.col("id") * 2.0).alias("y"))
    got = pose.stroke_features(spark.createDataFrame([(1, 20, "left", "R", True, None, 0.5, 4.0)], CONTACT), poses, ball).first()["features"]
    assert len(got) == 263 and set(got[:259]) == {None} and got[259:] == [1.0, None, 1.0, 1.0]


def test_a_model_of_other_features_is_refused(spark, tmp_path):
    rows = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("hand"), F.array((F.col("id") % 2).cast("double")).alias("features"))
    model = models.fit(rows, "hand", trees=2, depth=2)
    model.write().save(f"{tmp_path}/v1")  # as the version before wrote it
    assert models.FEATURE_VERSION == 2
    with pytest.raises(Exception, match="v2"):
        models.load(str(tmp_path))
