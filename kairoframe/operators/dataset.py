"""Building training sets: label expansion, sampling, conversation pairs, splits, rejection of overlapping windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import mirrored
from .signal import own, with_margin


def expand(strokes: DataFrame, jitters: tuple[int, ...], labels: tuple[str, ...] = ("side", "lean", "feet")) -> DataFrame:
    """Every stroke with and without mirroring, at each jitter; mirrored rows swap left and right in their labels."""
    out = strokes.withColumn("mirror", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("jitter", F.explode(F.array(*[F.lit(j) for j in jitters])))
    return out.withColumns({c: F.when(F.col("mirror"), mirrored(F.col(c))).otherwise(F.col(c)) for c in labels}).withColumn("at", F.col("frame") + F.col("jitter"))


def every_nth(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % n == 0).drop("_n")


def with_neighbours(frames: DataFrame) -> DataFrame:
    """Frames and the ones right before and after each, once."""
    return frames.select("video", F.explode(F.array(F.col("frame") - 1, F.col("frame"), F.col("frame") + 1)).alias("frame")).where("frame >= 0").distinct()


def triplets(frames: DataFrame, value: str) -> DataFrame:
    """Each frame's value with the ones before and after; at the ends its own is repeated."""
    w = Window.partitionBy("video", "_bucket").orderBy("frame")
    near = with_margin(frames.select("video", "frame", F.col(value).alias("cur")), 1)
    return own(near.withColumns({"prev": F.coalesce(F.lag("cur").over(w), "cur"), "next": F.coalesce(F.lead("cur").over(w), "cur")})).select("video", "frame", "prev", "cur", "next")


def turns(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it directly."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = conversations.withColumns({"_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return c.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "answer")


def clear_of(windows: DataFrame, boxes: DataFrame, grow: float = 0.1, cell: float = 256.0) -> DataFrame:
    """Windows (video, x1, y1, x2, y2) that no box of their video, grown by a share of its size, touches.

    Windows and grown boxes meet in the cells of a grid that they both reach into, not in their whole video.
    """
    edges = ("x1", "y1", "x2", "y2")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    grown = boxes.select("video", (F.col("x1") - grow * w).alias("x1"), (F.col("y1") - grow * h).alias("y1"), (F.col("x2") + grow * w).alias("x2"), (F.col("y2") + grow * h).alias("y2"))

    def cells(df: DataFrame) -> DataFrame:
        along = lambda c: F.explode(F.sequence(F.floor(F.least(f"{c}1", f"{c}2") / cell), F.floor(F.greatest(f"{c}1", f"{c}2") / cell)))
        return df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in edges])).withColumn("_cx", along("x")).withColumn("_cy", along("y"))

    touch = (F.col("a.x1") < F.col("b.x2")) & (F.col("a.x2") > F.col("b.x1")) & (F.col("a.y1") < F.col("b.y2")) & (F.col("a.y2") > F.col("b.y1"))
    same = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("video", "_cx", "_cy")])
    touched = cells(windows.select("video", *edges)).alias("a").join(cells(grown).alias("b"), same & touch, "left_semi").select("video", *edges).distinct()
    return windows.join(touched, ["video", *edges], "left_anti").select(*windows.columns)


def seeded_sample(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in an order that depends on the seed and the keys alone."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
