"""Sinks and the versioned result store."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of every key: results of another version are never read.
VERSION = 1


def cache_key(*parts: Column | str | int) -> Column:
    """First 12 hexadecimal digits of the md5 of the parts and the version, joined by bars."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.md5(F.concat_ws("|", *cols, F.lit(f"v{VERSION}"))), 1, 12)


def cached(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table stored under a key, built and written first if it isn't there (or on ``refresh``)."""
    path = f"{root}/key={key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per row."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Append runs as CSV with a header."""
    rows.write.mode("append").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").partitionBy(*partitions).json(path)


def detection_line(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """Centre and size of a box as shares of the image, to 6 places; an empty line where there is no box."""
    line = F.format_string("0 %.6f %.6f %.6f %.6f", x / width, y / height, w / width, h / height)
    return F.when(x.isNotNull() & y.isNotNull(), line).otherwise("")


def read_jsonl(spark: SparkSession, path: str, schema: str, bad: str = "bad_line") -> DataFrame:
    """Rows of JSON lines by an explicit schema. A line that isn't JSON, or not of the schema's types, has nulls and itself in ``bad``."""
    lines = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).schema(f"{schema}, {bad} string")
    return lines.json(path)


def write_detections(rows: DataFrame, path: str, meta: dict[str, str | float]) -> None:
    """Label lines (split, video, frame, line) as a table partitioned by split and video, with how they were made beside it."""
    rows.select("split", "video", "frame", "line").repartition("split", "video").sortWithinPartitions("frame").write.mode("overwrite").partitionBy("split", "video").parquet(f"{path}/labels")
    rows.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """What ``write_detections`` has written."""
    schema = "frame long, line string, split string, video string"
    return spark.read.schema(schema).parquet(f"{path}/labels"), json.loads(spark.read.text(f"{path}/meta").first()["value"])
