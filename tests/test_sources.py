import json

from pyspark.sql import functions as F

from kairoframe.operators import dataset
from kairoframe.sources import labels, store


def test_json_readers(spark, tmp_path):
    (tmp_path / "game_1.json").write_text('{"7": "bounce", "3": "net", "7": "left_winner", "9": "point"}')
    got = labels.load_events(spark, str(tmp_path / "game_1.json")).orderBy("frame").collect()
    assert [(r["video"], r["frame"], r["kind"], r["point_winner"]) for r in got] == [("game_1", 3, "net_cross", None), ("game_1", 7, "rally_end", "left")]
    (tmp_path / "train_1.json").write_text(json.dumps({"2": {"x": -1, "y": -1}, "5": {"x": 4, "y": 6}}))
    ball = labels.load_ball(spark, str(tmp_path / "train_1.json"))
    assert [(r["frame"], r["x"], r["visible"]) for r in ball.orderBy("frame").collect()] == [(2, None, False), (5, 4.0, True)]
    dense = labels.densify(ball.select("video", "frame", "x"), 4, 3).orderBy("frame").collect()
    assert [(r["frame"], r["x"]) for r in dense] == [(4, None), (5, 4.0), (6, None)]


def test_resolve_keeps_order_and_duplicates(spark):
    n = spark.createDataFrame([("val, test_2,val",)], "names string")
    assert [r["video"] for r in labels.resolve(n).orderBy("at", "nth").collect()] == ["game_5", "test_2", "game_5"]
    hands = {(r["video"], r["side"]): r["hand"] for r in labels.racket_truth(spark.createDataFrame([("test_3",), ("game_1",)], "video string")).collect()}
    assert hands == {("test_3", "left"): "R", ("test_3", "right"): "L", ("game_1", "left"): "R", ("game_1", "right"): "R"}
    assert spark.range(1).select(labels.ball_file(F.lit("game_4"))).first()[0] == "ball_data/train/train_4.json"


def test_cache_is_kept_until_refreshed(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for refresh in (False, False, True):
        assert store.cached(spark, str(tmp_path), "abc", build, refresh).count() == 3
    assert len(made) == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "a long, b string")
    store.write_report(rows, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a":1,"b":null}'
    for _ in range(2):
        store.append_history(rows, str(tmp_path / "h"))
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).count() == 2
    line = store.detection_line(F.lit(960.0), F.lit(540.0), F.lit(19.2), F.lit(10.8), 1920.0, 1080.0)
    assert spark.range(1).select(line).first()[0] == "0 0.500000 0.500000 0.010000 0.010000"
    assert spark.range(1).select(store.detection_line(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0), 9.0, 9.0)).first()[0] == ""


def test_dataset_helpers(spark):
    c = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e")], "conv_id long, turn long, role string, text string")
    assert sorted((r["prompt"], r["answer"]) for r in dataset.turns(c).collect()) == [("a", "b"), ("d", "e")]
    s = spark.createDataFrame([(1, 5, "left", "right_leaning", "unknown")], "video long, frame long, side string, lean string, feet string")
    got = sorted((r["mirror"], r["jitter"], r["side"], r["lean"], r["at"]) for r in dataset.expand(s, (0, 2)).collect())
    assert got == [(False, 0, "left", "right_leaning", 5), (False, 2, "left", "right_leaning", 7), (True, 0, "right", "left_leaning", 5), (True, 2, "right", "left_leaning", 7)]
    assert dataset.seeded_sample(spark.range(50), 5, 1, "id").collect() == dataset.seeded_sample(spark.range(50).repartition(7), 5, 1, "id").collect()


def test_annotations_are_written_and_read_again(spark, tmp_path):
    rows = [("game_1", 10, "bounce"), ("game_1", 9, "left_forehand_loop neutral both_feet_planted"), ("game_1", 11, None), ("test_2", 0, "right_backhand_push")]
    labels.write_annotations(spark.createDataFrame(rows, "video string, frame long, value string"), str(tmp_path / "a"))
    events = labels.load_events(spark, str(tmp_path / "a"))
    assert sorted((r["video"], r["frame"], r["kind"]) for r in events.collect()) == [("game_1", 9, "stroke"), ("game_1", 10, "bounce"), ("test_2", 0, "stroke")]
    assert [r["frame"] for r in labels.strokes(events, "right").collect()] == [0] and labels.strokes(events).count() == 2
    paths = spark.range(1).select(labels.events_file(F.lit("game_4")).alias("e"), labels.video_file(F.lit("test_1")).alias("v")).first()
    assert tuple(paths) == ("game_data/train/game_4.json", "test/test_1.mp4")


def test_many_videos_share_annotation_files(spark, tmp_path):
    rows = [(v, f, None if f == 2 else ("bounce", "net")[f % 2]) for v in range(200) for f in range(3)]
    path = str(tmp_path / "a")
    labels.write_annotations(spark.createDataFrame(rows, "video long, frame long, value string"), path, packed=True)
    assert len(list((tmp_path / "a").rglob("part-*"))) <= 8
    events = labels.load_events(spark, path, packed=True)
    assert sorted((int(r["video"]), r["frame"], r["raw"]) for r in events.collect()) == [r for r in rows if r[2]]
    (tmp_path / "b.json").write_text('{"video": "game_1", "frames": {"7": {"x": -1, "y": -1}, "3": {"x": 4, "y": 6}, "7": {"x": 1, "y": 2}}}\n')
    ball = labels.load_ball(spark, str(tmp_path / "b.json"), packed=True)
    assert sorted(tuple(r) for r in ball.collect()) == [("game_1", 3, 4.0, 6.0, True), ("game_1", 7, 1.0, 2.0, True)]
