"""Table-shaped parts of presentation: the ball's trail, the label on show, compact reports, prompts, request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .signal import own, with_margin


def trail(traj: DataFrame, reach: int, max_step: float) -> DataFrame:
    """video, frame, n: how many steps of the trail of each visible frame are drawn; a jump or a missing sample is left out."""
    w = Window.partitionBy("video", "_bucket").orderBy("frame")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) < max_step
    t = with_margin(traj, reach).withColumn("_ok", F.coalesce(step.cast("int"), F.lit(0)))
    return own(t.withColumn("n", F.sum("_ok").over(w.rowsBetween(-(reach - 1), 0)))).where("x is not null").select("video", "frame", "n")


def on_show(frames: DataFrame, shots: DataFrame, hold: int) -> DataFrame:
    """video, frame, shot: the last shot of at most ``hold`` frames ago, for each frame that has one."""
    w = Window.partitionBy("video", "_bucket").orderBy("frame").rangeBetween(-hold, 0)
    j = frames.select("video", "frame").join(shots.select("video", "frame", F.col("frame").alias("shot")), ["video", "frame"], "left")
    return own(with_margin(j, hold).withColumn("shot", F.last("shot", True).over(w))).where("shot is not null")


def compact(shots: DataFrame, key: str, order: str, fields: list[str], k: int = 40) -> DataFrame:
    """key, shots: the first k shots of each key as an array of structs of some fields."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = shots.withColumn("_n", n).where(F.col("_n") <= k)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("shots"))


def stroke_prompt(side: Column, racket: Column, vocabulary: dict[str, tuple[str, ...]]) -> Column:
    """A question about a stroke's labels, for models that are asked in words."""
    choices = "; ".join(f"{k} from {', '.join(v)}" for k, v in vocabulary.items())
    holds = F.when(racket == "L", " The racket is in the left hand.").when(racket == "R", " The racket is in the right hand.").otherwise("")
    return F.concat(F.lit("Label the stroke of the player on the "), side, F.lit(" side."), holds, F.lit(f" Choose {choices}. Reply as one JSON object."))


def request_error(name: Column, side: Column, racket: Column, corners: Column) -> Column:
    """What is wrong with a request, or null: file type, side, racket hand, corners (none, or four points as JSON)."""
    kind = F.lower(F.regexp_extract(name, r"\.[^./]*$", 0))
    points = F.from_json(corners, "array<array<double>>")
    four = (F.size(points) == 4) & F.forall(points, lambda p: F.size(p) == 2)
    return (
        F.when(~F.coalesce(kind, F.lit("")).isin(".mp4", ".mov", ".avi", ".mkv", ".webm"), "unsupported file type")
        .when(~F.coalesce(side, F.lit("")).isin("left", "right"), "side must be left or right")
        .when(~F.coalesce(racket, F.lit("")).isin("auto", "left", "right"), "racket must be auto, left or right")
        .when((F.coalesce(corners, F.lit("")) != "") & ~F.coalesce(four, F.lit(False)), "corners must be four points")
    )


def best_epoch(history: DataFrame, key: str, epoch: str, score: str) -> DataFrame:
    """The epoch of the highest score; the first of equal ones."""
    return history.groupBy(key).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(epoch)).alias("e"))).alias("b")).select(key, (-F.col("b.e")).alias(epoch), F.col("b.s").alias(score))
