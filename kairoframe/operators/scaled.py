"""Events of videos of different sizes and rates in one table: every limit is a column of the video.

Limits are set for 1920 pixels and 120 frames a second, and scaled by what each video has. A window that reaches w frames, with
a w of each video's own, is a range of an order in which w frames are always the same distance (``unit_order``), so that one
window serves all videos; sums over part of a window are differences of two such sums. Videos are cut into buckets of frames
with a margin of their own reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.geometry import half, over_table, to_table
from . import sequence
from .signal import gradient, own, smoothed, with_margin

#: The distance of w frames.
_UNIT = 1 << 30
# The width and rate that limits are set for.
REF_WIDTH, REF_FPS = 1920, 120.0


def limits(videos: DataFrame) -> DataFrame:
    """videos (video, width, fps and table, a struct of ``geometry.table_of`` or null) with the limits of every detector."""
    kx, kt = F.col("width") / REF_WIDTH, F.col("fps") / REF_FPS
    frames = lambda least, at_ref: F.greatest(F.lit(least), F.bround(at_ref * kt)).cast("long")
    whole = lambda seconds: F.floor(seconds * F.col("fps")).cast("long")
    t = F.col("table")
    return videos.withColumns({
        "net_x": F.coalesce(t["net_x"], F.col("width") / 2),
        "min_dx": F.coalesce(0.15 * t["length_px"], 0.05 * F.col("width")),
        "max_y": t["y1"] + 0.25 * t["length_px"],
        "hit_w": frames(2, 5), "hit_v": 3.5 * kx / kt, "hit_radius": frames(4, 18), "serve": whole(0.3),
        "bounce_w": frames(2, 4), "bounce_v": kx / kt, "bounce_radius": frames(3, 10), "guard": frames(3, 6),
        "refractory": whole(0.08), "rally_gap": 2.5 * F.col("fps"), "horizon": whole(1.5),
    })


def unit_order(w: str) -> Column:
    """An order of frames in which ``w`` frames, a column, are ``_UNIT`` apart (rounded down)."""
    return F.call_function("div", F.col("frame").cast("long") * _UNIT, F.col(w).cast("long"))


class Reach:
    """Windows of w frames around each row, where w is a column that is the same all over a partition."""

    def __init__(self, w: str, *parts: str):
        self.w = F.col(w)
        self._over: WindowSpec = Window.partitionBy("video", "_bucket", *parts).orderBy(unit_order(w))
        # Rounding moves a distance by less than one; one frame more or less moves it by _UNIT / w, which is more than two.
        self.before, self.after, self.around = self._over.rangeBetween(-_UNIT - 1, -2), self._over.rangeBetween(2, _UNIT + 1), self._over.rangeBetween(-_UNIT - 1, _UNIT + 1)

    def mean(self, c: str, side: WindowSpec) -> Column:
        """Mean over one side if at least half of its frames have a value."""
        return F.when(F.count(c).over(side) >= F.greatest(F.lit(1), F.floor(self.w / 2)), F.avg(c).over(side))

    def whole(self) -> Column:
        """Whether all w frames on either side are there."""
        return (F.count("frame").over(self.before) == self.w) & (F.count("frame").over(self.after) == self.w)


def _with_limits(traj: DataFrame, videos: DataFrame, *names: str) -> DataFrame:
    return traj.select("video", "frame", "x", "y").join(videos.select("video", *names), "video")


def _motion(traj: DataFrame, c: str, w: str, reach: Column) -> DataFrame:
    """traj with sx, sy, v (gradient of s<c>), and before and after (its means over w frames on either side)."""
    rows = Window.partitionBy("video", "_bucket").orderBy("frame")
    near = Reach(w)
    df = with_margin(traj.withColumn("_reach", reach), "_reach").drop("_reach")
    df = df.withColumns({"sx": smoothed("x", rows), "sy": smoothed("y", rows)}).withColumn("v", gradient(f"s{c}", rows))
    return df.withColumns({"before": near.mean("v", near.before), "after": near.mean("v", near.after), "inside": near.whole()})


def hit_candidates(traj: DataFrame, videos: DataFrame) -> DataFrame:
    """video, frame, side, serve, score, hit_radius: as ``signal.reversal_candidates``. traj: video, frame (dense), x, y."""
    df = _with_limits(traj, videos, "net_x", "min_dx", "max_y", "hit_w", "hit_v", "hit_radius", "serve")
    df = _motion(df, "x", "hit_w", F.greatest("hit_w", "serve") + 3)
    df = df.withColumn("_serve", F.greatest("serve", F.lit(1)))
    df = df.withColumn("side", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("sign")) for n, s in (("right", 1.0), ("left", -1.0))])))
    sign, near, far = F.col("side.sign"), Reach("hit_w", "side"), Reach("_serve", "side")
    top = F.max(F.when(F.col("sx").isNotNull(), F.struct((sign * F.col("sx")).alias("v"), (-F.col("frame")).alias("f")))).over(near.around)
    # The serve's frames are those of the longer reach without those of the shorter one.
    away = F.when(F.col("x").isNotNull() & (sign * (F.col("x") - F.col("net_x")) <= 0), 1)
    df = df.withColumn("_away", away)
    df = df.withColumns({"top": -top["f"], "waits": F.count("frame").over(far.before) - F.count("frame").over(near.before), "aways": F.count("_away").over(far.before) - F.count("_away").over(near.before)})
    ok = F.col("inside") & F.col("sx").isNotNull() & F.col("after").isNotNull() & (sign * (F.col("sx") - F.col("net_x")) >= F.col("min_dx")) & (sign * F.col("after") < -F.col("hit_v"))
    ok &= F.col("max_y").isNull() | (F.col("sy") <= F.col("max_y"))
    rally = F.col("before").isNotNull() & (sign * F.col("before") > F.col("hit_v"))
    serve = ~rally & (F.col("before").isNull() | (F.abs("before") < F.col("hit_v") / 2)) & (F.col("serve") > F.col("hit_w")) & (F.col("waits") > 0) & (F.col("aways") == 0)
    return df.where(F.col("_own") & ok & (rally | serve)).select(
        "video", F.when(rally, F.col("top")).otherwise(F.col("frame")).alias("frame"), F.col("side.name").alias("side"), (~rally).alias("serve"),
        F.when(rally, F.abs(F.col("before") - F.col("after"))).otherwise(F.abs("after") * 0.5).alias("score"), "hit_radius",
    )


def hits(candidates: DataFrame) -> DataFrame:
    """video, frame, side, serve, score of the candidates that suppression leaves."""
    return sequence.detect_hits(candidates, "hit_radius")


def bounce_candidates(traj: DataFrame, videos: DataFrame) -> DataFrame:
    """video, frame, x, y, score, half and limits: as ``signal.bounce_candidates``, over the table where the video has one.

    A frame off the table is no candidate, so it takes no other one's place.
    """
    df = _with_limits(traj, videos, "net_x", "bounce_w", "bounce_v", "bounce_radius", "guard", "table")
    df = _motion(df, "y", "bounce_w", F.col("bounce_w") + 3)
    near = Reach("bounce_w")
    top = F.max(F.when(F.col("sy").isNotNull(), F.struct(F.col("sy").alias("v"), (-F.col("frame")).alias("f")))).over(near.around)
    t = F.col("table")
    ok = F.col("inside") & F.col("sy").isNotNull() & (F.col("before") >= F.col("bounce_v")) & (F.col("after") <= -F.col("bounce_v")) & (F.col("top") == F.col("frame"))
    df = df.withColumn("top", -top["f"]).where(F.col("_own") & ok & (t.isNull() | over_table(t, F.col("sx"), F.col("sy"))))
    seen = F.col("x").isNotNull() & F.col("y").isNotNull()
    df = df.withColumns({c: F.when(seen, F.col(c)).otherwise(F.col(f"s{c}")) for c in ("x", "y")})
    u, _ = to_table(F.col("x"), F.col("y"), t["h"])
    plain = F.when(F.col("x") > F.col("net_x"), "right").otherwise("left")
    return df.select("video", "frame", "x", "y", (F.col("before") - F.col("after")).alias("score"), F.when(t.isNotNull(), half(u)).otherwise(plain).alias("half"), "bounce_radius", "guard")


def bounces(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """video, frame, x, y, half of candidates that no hit is near to, after suppression."""
    guards = candidates.select("video", "guard").distinct()
    c = sequence.far_from(candidates, found.select("video", "frame").join(guards, "video"), "guard")
    return sequence.suppress(c, "bounce_radius", carry=("x", "y", "half"))


def crossings(traj: DataFrame, videos: DataFrame) -> DataFrame:
    """video, frame of net crossings."""
    return sequence.net_crossings(_with_limits(traj, videos, "net_x", "refractory"), "net_x", "refractory")


def sessions(found: DataFrame, videos: DataFrame) -> DataFrame:
    """Hits with their rally and the video's limits."""
    return sequence.rally_sessions(found.join(videos.select("video", "rally_gap", "horizon", "fps"), "video"), "rally_gap")


def rallies(found: DataFrame, landed: DataFrame, videos: DataFrame) -> DataFrame:
    """Rallies with their outcome, as ``sequence.rallies``."""
    return sequence.rallies(sequence.alternate(sessions(found, videos)), landed, "horizon")


def contexts(found: DataFrame, videos: DataFrame) -> DataFrame:
    """Hits with first_of_rally and since_prev_s."""
    return sequence.contexts(found.join(videos.select("video", "fps"), "video"), "fps").drop("fps")
