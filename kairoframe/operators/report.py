"""Report building: shot speed, landing placement, totals, counts, key frames, rule-based findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import LENGTH_M
from ..functions.metrics import share_of


def shot_speeds(hits: DataFrame, traj: DataFrame, fps: float, m_per_px: float, lo: int, hi: int) -> DataFrame:
    """hits with speed_kmh: median step over valid frames [t + lo, t + hi), of three valid ones at least, in (3, 200) km/h.

    Missing frames are taken out before steps are formed, so a gap counts as one step. A hit's frames are joined by
    frame number (an equality join on the exploded window), so a long video is no single key.
    """
    window = hits.select("video", F.col("frame").alias("hit"), F.explode(F.sequence(F.col("frame") + lo, F.col("frame") + hi - 1)).alias("frame"))
    pts = window.join(traj.where("x is not null").select("video", "frame", "x", "y"), ["video", "frame"])
    w = Window.partitionBy("video", "hit").orderBy("frame")
    steps = pts.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    v = F.median("step") * fps * m_per_px * 3.6
    speed = steps.groupBy("video", "hit").agg(F.count("*").alias("n"), v.alias("v")).where("n >= 3 and v > 3 and v < 200")
    return hits.join(speed.select("video", F.col("hit").alias("frame"), F.round("v", 1).alias("speed_kmh")), ["video", "frame"], "left")


def metres_per_pixel(heights: DataFrame, key: str = "video", height: str = "height", stance_m: float = 1.55, least: int = 10) -> DataFrame:
    """Scale from a player's median height where more than ``least`` heights are known, else null."""
    return heights.groupBy(key).agg(F.when(F.count(height) > least, stance_m / F.median(height)).alias("m_per_px"))


def placement(side: Column, half: Column, u: Column, v: Column) -> Column:
    """u, v, depth of a landing on the other half, no more than 0.2 m beyond an end; depth 0 is the net, 1 the end line."""
    mid = LENGTH_M / 2
    depth = F.when(side == "right", (mid - u) / mid).otherwise((u - mid) / mid)
    ok = (half != side) & u.between(-0.2, LENGTH_M + 0.2)
    return F.when(ok, F.struct(F.round(u, 3).alias("u"), F.round(v, 3).alias("v"), F.round(depth, 3).alias("depth")))


def total_columns(hand: str = "hand", speed: str = "speed", places: int = 1) -> list[Column]:
    """Aggregates: strokes by hand and speeds; a speed of null or 0 is not known."""
    known = F.when(F.col(speed) > 0, F.col(speed))
    by = lambda h: F.round(F.avg(F.when(F.col(hand) == h, known)), places)
    return [
        F.count("*").alias("strokes"), F.count_if(F.col(hand) == "forehand").alias("forehand"), F.count_if(F.col(hand) == "backhand").alias("backhand"),
        F.round(F.avg(known), places).alias("avg_speed"), F.round(F.max(known), places).alias("peak_speed"), by("forehand").alias("forehand_avg"), by("backhand").alias("backhand_avg"),
    ]


def totals(shots: DataFrame, key: str, hand: str = "hand", speed: str = "speed", places: int = 1) -> DataFrame:
    """``total_columns`` of each key."""
    return shots.groupBy(key).agg(*total_columns(hand, speed, places))


def label_counts(column: str, labels: tuple[str, ...]) -> Column:
    """Aggregate: a map of how often each of a few labels occurs."""
    return F.create_map(*[x for v in labels for x in (F.lit(v), F.count_if(F.col(column) == v))]).alias(column)


def ranked_counts(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Counts of a label by rank: most first, ties by first appearance."""
    c = rows.groupBy(key, F.coalesce(F.col(value), F.lit("unknown")).alias(value)).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "_first")
    return c.withColumn("rank", F.row_number().over(w)).drop("_first")


def key_frames(shots: DataFrame, key: str, combo: list[str], order: str, k: int = 6) -> DataFrame:
    """k shots per key: the first of each combination, filled up in time order."""
    first = Window.partitionBy(key, *combo).orderBy(order)
    pick = Window.partitionBy(key).orderBy((F.col("_nth") > 1).cast("int"), order)
    return shots.withColumn("_nth", F.row_number().over(first)).withColumn("_pick", F.row_number().over(pick)).where(F.col("_pick") <= k).drop("_nth", "_pick")


def top_k(rows: DataFrame, key: list[str], score: str, tie: str, k: int = 8) -> DataFrame:
    """The k rows of each key with the largest score."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


#: What a player can do about a finding.
DETAILS = {
    "Not enough strokes detected": "Film a longer rally, from the side and with the table in full view, so that there is more to measure.",
    "Backhand is under-used": "Nearly all balls are taken with the forehand, which invites play into the other corner. Train backhand rallies and changes between both sides.",
    "Forehand is under-used": "Nearly all balls are taken with the backhand. Train the footwork that brings the forehand, mostly the stronger side, into play.",
    "Weight falling backwards at contact": "Body weight is often on the back foot when the ball is hit. Load that leg in the backswing and move through the ball.",
    "Balance at contact": "A foot is often in the air at contact. Power strokes allow for that; on others a low and wide stance gives control.",
    "Passive rallies": "Pushes are many and loops few. Use long or high balls to open with topspin.",
    "Backhand lacks pace": "Backhands are clearly slower than forehands. Meet the ball in front of the body, with more of the forearm and wrist.",
    "Errors into the net": "Own errors mostly end in the net. Brush upwards more, and meet the ball earlier and higher.",
    "Errors long or wide": "Own errors mostly miss the table. Close the racket a little, and put more of the swing into spin.",
    "Solid, balanced session": "Nothing stands out in what was measured. Keep working on steadiness and placement.",
}


def findings(r: DataFrame) -> Column:
    """Title, detail and evidence of the rules that a report row meets, in the rules' order.

    Columns: strokes, forehand, backhand, lean, feet, technique (maps of counts), forehand_avg, backhand_avg, lost_net,
    lost_out, lost (own errors). Fewer than four strokes give one finding, and no rule met gives the default one.
    """
    c = F.col
    n, fh, bh = c("strokes"), c("forehand"), c("backhand")
    share = F.when(fh + bh >= 6, bh / (fh + bh))
    back = share_of(c("lean"), ("back_heavy",), n)
    lifted = share_of(c("feet"), ("both_feet_lifted", "left_foot_lifted", "right_foot_lifted"), n)
    push, loop = share_of(c("technique"), ("push",), n), share_of(c("technique"), ("loop",), n)
    pct = lambda v: F.concat(F.bround(v * 100, 0).cast("int").cast("string"), F.lit("%"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n_of = lambda v: v.cast("string")
    sides = text(n_of(fh), " forehands, ", n_of(bh), " backhands")
    errors = text(n_of(c("lost_net")), " into the net, ", n_of(c("lost_out")), " out")
    # Thresholds and titles of the findings, in order.
    rules = [
        (share < 0.25, "Backhand is under-used", sides),
        (share > 0.75, "Forehand is under-used", sides),
        (back > 0.2, "Weight falling backwards at contact", text(pct(back), " of strokes")),
        (lifted > 0.45, "Balance at contact", text(pct(lifted), " of strokes with a foot lifted")),
        ((push > 0.35) & (loop < 0.25), "Passive rallies", text(pct(push), " pushes, ", pct(loop), " loops")),
        ((c("forehand_avg") > 0) & (c("backhand_avg") > 0) & (c("backhand_avg") < 0.75 * c("forehand_avg")), "Backhand lacks pace", text(n_of(c("forehand_avg")), " and ", n_of(c("backhand_avg")), " km/h")),
        ((c("lost") >= 3) & (c("lost_net") > c("lost_out")), "Errors into the net", errors),
        ((c("lost") >= 3) & (c("lost_out") > c("lost_net")), "Errors long or wide", errors),
    ]
    found = lambda title, evidence: F.struct(F.lit(title).alias("title"), F.lit(DETAILS[title]).alias("detail"), evidence.alias("evidence"))
    met = F.filter(F.array(*[F.when(cond, found(title, evidence)) for cond, title, evidence in rules]), lambda x: x.isNotNull())
    few, none = F.array(found("Not enough strokes detected", text(n_of(n), " strokes"))), F.array(found("Solid, balanced session", text(n_of(n), " strokes")))
    return F.when(n < 4, few).when(F.size(met) == 0, none).otherwise(met)


def shot_label(*parts: Column) -> Column:
    """Non-empty, known parts joined by two spaces."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "") & (p != "unknown")), "  ")


def number_shots(shots: DataFrame, rally_hits: DataFrame) -> DataFrame:
    """shots (video, frame, side) with n (from 1 per video and side) and the rally whose hit is in their frame, if one is.

    rally_hits: video, frame, rally; of several in a frame the last rally counts.
    """
    of = rally_hits.groupBy("video", "frame").agg(F.max("rally").alias("rally"))
    order = Window.partitionBy("video", "side").orderBy("frame")
    return shots.withColumn("n", F.row_number().over(order)).join(of, ["video", "frame"], "left")
