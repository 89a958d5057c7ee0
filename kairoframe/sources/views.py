"""Stand-in views: the query catalogue's inputs, made from the shared test tables.

They are not ball trajectories. ``traj`` takes a user's events, in order of time, as the frames of a video; an event of
type error is a frame without a sample. Operators know nothing of this: they take columns and thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the tables, with only the named columns read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame (from 0), kind, k (0 to 99), value, secs (event time in seconds) of each event."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("video"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "value",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("secs"),
    )


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frame, x, y: missing samples are null, frames are dense."""
    seen = F.col("kind") != "error"
    return frames(spark, sf_dir).select("video", "frame", F.when(seen, F.col("k")).alias("x"), F.when(seen, F.col("value")).alias("y"))


FRAMES_SQL = """
frames AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS kind,
                  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value, floor(epoch_us(ts) / 1000000)::BIGINT AS secs FROM events)"""
TRAJ_SQL = FRAMES_SQL + """,
traj AS (SELECT video, frame, CASE WHEN kind <> 'error' THEN k END AS x, CASE WHEN kind <> 'error' THEN value END AS y FROM frames)"""
