"""Readers and writers of annotation files, and the helpers that name and resolve datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import parse_label, point_winner

# Dataset groups, the left-handed players, and the video without bounce labels.
GROUPS = {
    "train": [f"game_{i}" for i in range(1, 6)],
    "test": [f"test_{i}" for i in range(1, 8)],
    "fit": [f"game_{i}" for i in range(1, 5)],
    "val": ["game_5"],
    "all": [f"game_{i}" for i in range(1, 6)] + [f"test_{i}" for i in range(1, 8)],
}
LEFT_HANDED = (("test_3", "right"), ("test_5", "left"), ("test_5", "right"), ("test_7", "right"))
NO_BOUNCE_LABELS = ("test_2",)


def _last_by_key(spark: SparkSession, path: str, kind: str, packed: bool) -> DataFrame:
    """video, frame, value of JSON objects by frame; of a key that occurs twice the last value holds."""
    if packed:
        objects = spark.read.schema(f"video string, frames map<string,{kind}>").json(path)
    else:
        named, stored = (F.regexp_extract(F.col("path"), p, 1) for p in (r"([^/]+)\.json$", r"/video=([^/]+)/[^/]*$"))
        objects = _files(spark, path).select(F.when(named != "", named).otherwise(stored).alias("video"), F.from_json("value", f"map<string,{kind}>").alias("frames"))
    pairs = objects.select("video", F.posexplode("frames").alias("at", "frame", "v"))
    return pairs.groupBy("video", F.col("frame").cast("long").alias("frame")).agg(F.max_by("v", "at").alias("v"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def load_events(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Annotations {frame: label}, one object per video: parsed, those that mean nothing left out, with point_winner."""
    e = _last_by_key(spark, path, "string", packed).withColumn("e", parse_label(F.col("v"))).where("e is not null")
    return e.select("video", "frame", F.col("v").alias("raw"), "e.*").withColumn("point_winner", point_winner(F.col("kind"), F.col("side"), F.col("outcome")))


def strokes(events: DataFrame, side: str | None = None) -> DataFrame:
    """The strokes among events, of one side or of both."""
    found = events.where("kind = 'stroke'")
    return found if side is None else found.where(F.col("side") == side)


def write_annotations(rows: DataFrame, path: str, value: str = "value", packed: bool = False) -> None:
    """One JSON object {frame: value} per video, in order of frames.

    Each is a file that the readers find by its folder's name. With ``packed`` it is a line {video, frames} of a file that
    many videos share: a file for each of very many videos takes far longer to make, list and open than what is in it.
    """
    entry = F.struct("frame", F.col(value).alias("v"))
    one = rows.where(F.col(value).isNotNull()).groupBy("video").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    by_frame = F.map_from_entries(F.transform("e", lambda x: F.struct(x["frame"].cast("string"), x["v"])))
    if packed:
        one.select(F.col("video").cast("string").alias("video"), by_frame.alias("frames")).write.mode("overwrite").json(path)
    else:
        one.select("video", F.to_json(by_frame).alias("value")).repartition("video").write.mode("overwrite").partitionBy("video").text(path)


def load_ball(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Ball positions {frame: {x, y}}: x below 0 means labelled as not visible; frames without a label have no row."""
    b = _last_by_key(spark, path, "struct<x:double,y:double>", packed)
    seen = F.col("v.x") >= 0
    return b.select("video", "frame", F.when(seen, F.col("v.x")).alias("x"), F.when(seen, F.col("v.y")).alias("y"), seen.alias("visible"))


def densify_all(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per frame of each video of ``lengths`` (video, n_frames), with nulls where there is no point."""
    grid = lengths.where("n_frames > 0").select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))
    return grid.join(points, ["video", "frame"], "left")


def densify(points: DataFrame, start: int, n: int) -> DataFrame:
    """One row per video and frame of [start, start + n), with nulls where there is no point."""
    grid = points.select("video").distinct().select("video", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(start + n - 1).cast("long"))).alias("frame")) if n > 0 else points.select("video", "frame").limit(0)
    return grid.join(points, ["video", "frame"], "left")


def resolve(names: DataFrame, column: str = "names", *keys: str) -> DataFrame:
    """``keys``, at, nth, video: comma-separated group or video names in order, duplicates kept."""
    parts = names.select(*keys, F.posexplode(F.split(column, ",")).alias("at", "name")).withColumn("name", F.trim("name"))
    groups = F.create_map(*[x for k, v in GROUPS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    videos = F.coalesce(F.try_element_at(groups, F.col("name")), F.array("name"))
    return parts.select(*keys, "at", F.posexplode(videos).alias("nth", "video"))


def split_of(video: Column) -> Column:
    return F.when(video.startswith("game_"), "train").otherwise("test")


def video_file(video: Column) -> Column:
    return F.concat_ws("/", split_of(video), F.concat(video, F.lit(".mp4")))


def events_file(video: Column) -> Column:
    return F.concat_ws("/", F.lit("game_data"), split_of(video), F.concat(video, F.lit(".json")))


def ball_file(video: Column) -> Column:
    """Ball files of training videos are numbered as train_<n>."""
    return F.concat_ws("/", F.lit("ball_data"), split_of(video), F.concat(F.regexp_replace(video, "^game_", "train_"), F.lit(".json")))


def racket_truth(videos: DataFrame) -> DataFrame:
    """video, side, hand: R but for the listed players."""
    left = videos.sparkSession.createDataFrame(list(LEFT_HANDED), "video string, side string").withColumn("hand", F.lit("L"))
    sides = videos.select("video", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))
    return sides.join(F.broadcast(left), ["video", "side"], "left").withColumn("hand", F.coalesce("hand", F.lit("R")))  # a fixed list of players
