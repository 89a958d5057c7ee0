"""Per-frame signal operators: smoothing, gradient, one-sided means, reversals, bounces, gap filling.

Missing samples are null (never NaN): built-in aggregates skip them, arithmetic keeps them missing. All windows have a
fixed reach, so a long video is cut into buckets of frames with a margin of that reach on either side and the windows
are partitioned by (video, bucket): one video of any length spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Frames in a bucket.
BUCKET = 1 << 16


def with_margin(df: DataFrame, reach: int | str, frame: str = "frame", bucket: int = BUCKET) -> DataFrame:
    """Rows with columns _bucket and _own: each row once in its own bucket and once in each that its reach touches.

    The reach may be a column.
    """
    at = lambda c: F.floor(c / bucket)
    f = F.col(frame)
    if isinstance(reach, str):
        buckets = F.sequence(at(f - F.col(reach)), at(f + F.col(reach)))
    else:
        bucket = max(bucket, reach + 1)  # so that a reach touches neighbouring buckets only
        buckets = F.array_distinct(F.array(at(f), at(f - reach), at(f + reach)))
    return df.withColumn("_bucket", F.explode(buckets)).withColumn("_own", F.col("_bucket") == at(f))


def _over(key: str = "video", frame: str = "frame") -> WindowSpec:
    return Window.partitionBy(key, "_bucket").orderBy(frame)


def own(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_bucket", "_own")


def smoothed(c: str, w: WindowSpec, k: int = 3) -> Column:
    """Centred moving average of the valid samples; a missing sample stays missing."""
    return F.when(F.col(c).isNotNull(), F.avg(c).over(w.rowsBetween(-(k // 2), k // 2)))


def gradient(c: str, w: WindowSpec) -> Column:
    """Central difference; one-sided at the first and last frame of a video; missing neighbours propagate."""
    here, before, after = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
    first, last = F.lag("frame").over(w).isNull(), F.lead("frame").over(w).isNull()
    return F.when(first & last, F.lit(0.0)).when(first, after - here).when(last, here - before).otherwise((after - before) / 2)


def mean_of(c: str, w: WindowSpec, lo: int, hi: int) -> Column:
    """Mean of rows lo to hi (inclusive offsets) if at least half of the requested width is valid."""
    span = w.rowsBetween(lo, hi)
    return F.when(F.count(c).over(span) >= max(1, (hi - lo + 1) // 2), F.avg(c).over(span))


def smooth(traj: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """traj with s<column>."""
    w = _over()
    return own(with_margin(traj, 1).withColumns({f"s{c}": smoothed(c, w) for c in columns}))


def motion(traj: DataFrame, c: str, w: int) -> DataFrame:
    """traj with s<c> (smoothed), v (its gradient), before and after (mean v of w frames on either side), inside."""
    over = _over()
    df = with_margin(traj, w + 3)
    df = df.withColumns({"sx": smoothed("x", over), "sy": smoothed("y", over)})
    df = df.withColumn("v", gradient(f"s{c}", over))
    return df.withColumns({
        "before": mean_of("v", over, -w, -1),
        "after": mean_of("v", over, 1, w),
        "inside": F.lag("frame", w).over(over).isNotNull() & F.lead("frame", w).over(over).isNotNull(),
    })


def reversal_candidates(traj: DataFrame, net_x: float, w: int, vmin: float, min_dx: float, serve_reach: int, max_y: float | None = None) -> DataFrame:
    """video, frame, side, serve, score of frames where the horizontal direction turns back on a player's side.

    Rally strokes move to the extreme position nearby (the first one on ties); a serve is the first strong motion after
    frames without a sample or on the server's own side.
    """
    over = _over()
    m = motion(traj, "x", w).withColumn("_reach", F.lit(0))
    df = m.withColumn("side", F.explode(F.array(F.struct(F.lit("right").alias("name"), F.lit(1.0).alias("sign")), F.struct(F.lit("left").alias("name"), F.lit(-1.0).alias("sign")))))
    sign = F.col("side.sign")
    sided = Window.partitionBy("video", "_bucket", "side").orderBy("frame")
    near = sided.rowsBetween(-w, w)
    top = F.max(F.when(F.col("sx").isNotNull(), F.struct((sign * F.col("sx")).alias("v"), (-F.col("frame")).alias("f")))).over(near)
    earlier = sided.rowsBetween(-serve_reach, -w - 1)
    own_side = F.col("x").isNull() | (sign * (F.col("x") - net_x) > 0)
    df = df.withColumns({"top": -top["f"], "waits": F.min(own_side.cast("int")).over(earlier), "n_waits": F.count("frame").over(earlier)})
    ok = F.col("inside") & F.col("sx").isNotNull() & F.col("after").isNotNull() & (sign * (F.col("sx") - net_x) >= min_dx) & (sign * F.col("after") < -vmin)
    if max_y is not None:
        ok &= F.col("sy") <= max_y
    rally = F.col("before").isNotNull() & (sign * F.col("before") > vmin)
    serve = ~rally & (F.col("before").isNull() | (F.abs("before") < vmin / 2)) & (F.col("n_waits") > 0) & (F.col("waits") == 1)
    df = df.where(F.col("_own") & ok & (rally | serve))
    return df.select(
        "video", F.when(rally, F.col("top")).otherwise(F.col("frame")).alias("frame"), F.col("side.name").alias("side"), (~rally).alias("serve"),
        F.when(rally, F.abs(F.col("before") - F.col("after"))).otherwise(F.abs("after") * 0.5).alias("score"),
    )


def bounce_candidates(traj: DataFrame, w: int, vmin: float, over_table: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """video, frame, x, y, score of frames where the vertical direction turns from down to up at a local lowest point.

    Image y grows downwards, so the lowest point is the first largest y within w frames. ``over_table`` says which smoothed
    points are candidates at all: one off the table must not suppress one on it.
    """
    over = _over()
    top = F.max(F.when(F.col("sy").isNotNull(), F.struct(F.col("sy").alias("v"), (-F.col("frame")).alias("f")))).over(over.rowsBetween(-w, w))
    df = motion(traj, "y", w).withColumn("top", -top["f"])
    ok = F.col("inside") & F.col("sy").isNotNull() & (F.col("before") >= vmin) & (F.col("after") <= -vmin) & (F.col("top") == F.col("frame"))
    if over_table is not None:
        ok &= over_table(F.col("sx"), F.col("sy"))
    return df.where(F.col("_own") & ok).select("video", "frame", F.coalesce("x", "sx").alias("x"), F.coalesce("y", "sy").alias("y"), (F.col("before") - F.col("after")).alias("score"))


def fill_gaps(traj: DataFrame, max_gap: int, columns: tuple[str, ...] = ("x", "y"), valid: str = "x") -> DataFrame:
    """Linear filling between valid frames 2 to max_gap apart; nothing is extrapolated."""
    over = _over()
    df = with_margin(traj, max_gap)
    known = F.when(F.col(valid).isNotNull(), F.struct(F.col("frame").alias("f"), *columns))
    back = F.last(known, True).over(over.rowsBetween(-max_gap, 0))
    on = F.first(known, True).over(over.rowsBetween(0, max_gap))
    df = df.withColumns({"_a": back, "_b": on})
    gap = F.col("_b.f") - F.col("_a.f")
    share = (F.col("frame") - F.col("_a.f")) / gap
    fill = F.col(valid).isNull() & (gap > 1) & (gap <= max_gap)
    return own(df.withColumns({f"f{c}": F.when(fill, F.col(f"_a.{c}") + share * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))).otherwise(F.col(c)) for c in columns})).drop("_a", "_b")
