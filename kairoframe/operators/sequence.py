"""Operators over sparse events in order: suppression, debouncing, sessions, alternation, intervals.

Greedy rules are folds over a sorted array (JVM side). Before folding, events are cut into islands that cannot
influence each other, so that an array holds one island and not a whole video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .signal import own, with_margin


def _column(v: float | str) -> Column:
    """A number, or the column of that name: a limit that differs by video."""
    return F.col(v) if isinstance(v, str) else F.lit(v)


def islands(df: DataFrame, gap: float | str, key: str = "video", at: str = "frame", out: str = "island") -> DataFrame:
    """Number the runs of events that follow each other by at most ``gap``."""
    w = Window.partitionBy(key).orderBy(at)
    new = (F.col(at) - F.lag(at).over(w) > _column(gap)).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn(out, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def suppress(df: DataFrame, radius: int | str, key: str = "video", carry: tuple[str, ...] = ()) -> DataFrame:
    """Greedy non-maximum suppression: by score (then frame), keep what is more than ``radius`` from all kept frames.

    Returns key and frame of what is kept, and the columns of ``carry`` (of equal scores in a frame, those of the row that is
    least by them). Candidates further apart than the radius can't suppress each other, so each island is folded by itself. The
    radius may be a column, the same for all rows of a video.
    """
    row = F.struct((-F.col("score")).alias("s"), F.col("frame").cast("long").alias("f"), *carry, _column(radius).alias("r"))
    kind = df.select(row.alias("row")).schema["row"].dataType.simpleString()
    kept = F.aggregate(
        F.array_sort(F.collect_list(row)),
        F.array().cast(f"array<{kind}>"),
        lambda acc, x: F.when(F.forall(acc, lambda k: F.abs(x["f"] - k["f"]) > x["r"]), F.concat(acc, F.array(x))).otherwise(acc),
    )
    out = islands(df, radius, key).groupBy(key, "island").agg(kept.alias("kept")).select(key, F.explode("kept").alias("k"))
    return out.select(key, F.col("k.f").alias("frame"), *[F.col("k")[c].alias(c) for c in carry])


def detect_hits(candidates: DataFrame, radius: int | str) -> DataFrame:
    """Suppress candidates of both sides together; a kept frame takes side, serve and score of its best candidate.

    Of equal scores the right side's candidate is taken, which is looked at first, and a rally stroke before a serve.
    """
    c = candidates.withColumn("_left", F.col("side") != "right")
    return suppress(c, radius, carry=("_left", "serve", "side", "score")).select("video", "frame", "side", "serve", "score")


def far_from(events: DataFrame, others: DataFrame, guard: int | str) -> DataFrame:
    """Events with none of ``others`` (video, frame) within ``guard`` frames: an anti range join on buckets of the guard.

    The guard may be a column that both have, the same for all rows of a video.
    """
    size, guard = _column(guard) + 1, _column(guard)
    near = others.select(F.col("video").alias("_v"), F.col("frame").alias("_f"), size.alias("_g")).distinct().withColumn("_b", F.explode(F.array(*[F.floor(F.col("_f") / F.col("_g")) + d for d in (-1, 0, 1)])))
    e = events.withColumn("_bb", F.floor(F.col("frame") / size))
    return e.join(near, (e.video == near._v) & (F.col("_bb") == F.col("_b")) & (F.abs(F.col("frame") - F.col("_f")) <= guard), "left_anti").drop("_bb")


def net_crossings(traj: DataFrame, net_x: float | str, refractory: int | str) -> DataFrame:
    """video, frame of strict sign changes between valid samples of neighbouring frames, debounced against the last one emitted.

    Crossings more than the refractory time apart don't affect each other, so each island is folded by itself. Both limits may
    be columns of traj, the same for all rows of a video.
    """
    w = Window.partitionBy("video", "_bucket").orderBy("frame")
    net = _column(net_x)
    change = own(with_margin(traj, 1).withColumn("_x", F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.lag("x").over(w)))).where((F.col("_x") - net) * (F.col("x") - net) < 0)
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col("frame").cast("long").alias("f"), _column(refractory).alias("r")))),
        F.array().cast("array<bigint>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x["f"] - F.try_element_at(acc, F.lit(-1)) > x["r"]), F.concat(acc, F.array(x["f"]))).otherwise(acc),
    )
    return islands(change, refractory).groupBy("video", "island").agg(kept.alias("kept")).select("video", F.explode("kept").alias("frame"))


def rally_sessions(hits: DataFrame, max_gap: float | str, at: str = "frame") -> DataFrame:
    """hits with rally (from 0 per video): a new one after a longer gap, or at a serve."""
    w = Window.partitionBy("video").orderBy(at, "frame")
    new = F.col("serve") | (F.col(at) - F.lag(at).over(w) > _column(max_gap))
    return hits.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("_first", F.lag(at).over(w).isNull()).withColumn("rally", F.sum(F.when(F.col("_first"), 0).otherwise(F.col("_new"))).over(w)).drop("_new", "_first")


def alternate(hits: DataFrame) -> DataFrame:
    """Of consecutive hits of one side in a rally keep the strongest (the first on ties).

    Only a rally's first hit can be a serve, so runs of a side are plain islands.
    """
    w = Window.partitionBy("video", "rally").orderBy("frame")
    turn = F.coalesce((F.col("side") != F.lag("side").over(w)).cast("int"), F.lit(0))
    best = Window.partitionBy("video", "rally", "_run").orderBy(F.desc("score"), "frame")
    return hits.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w)).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_turn", "_run", "_n")


#: Frames in a span: the equality key of joins between intervals and events of a video.
SPAN = 1 << 10


def spans(intervals: DataFrame, lo: str, hi: Column) -> DataFrame:
    """intervals, once for each span of frames that [lo, hi] reaches into (``_span``); an event is in one span only."""
    return intervals.withColumn("_span", F.explode(F.sequence(F.floor(F.col(lo) / SPAN), F.floor(F.greatest(F.col(lo), hi) / SPAN))))


def span_of(frame: str) -> Column:
    return F.floor(F.col(frame) / SPAN)


def in_segments(events: DataFrame, merged: DataFrame) -> DataFrame:
    """events with the lo and hi of the segment that holds their frame, null where none does. merged: disjoint, as of ``segments``."""
    s = spans(merged.select(F.col("video").alias("_v"), "lo", "hi"), "lo", F.col("hi"))
    e = events.withColumn("_e", span_of("frame"))
    return e.join(s, (F.col("video") == F.col("_v")) & (F.col("_e") == F.col("_span")) & F.col("frame").between(F.col("lo"), F.col("hi")), "left").drop("_v", "_e", "_span")


def rallies(hits: DataFrame, bounces: DataFrame, horizon: int | str) -> DataFrame:
    """Outcome of each rally of alternating hits: from the first bounce after its last hit.

    On the other half the hitter wins; on the own half, or with no bounce before the horizon (cut by the next rally's
    start), the hitter loses. A rally of one hit and no bounce is dropped, after the horizons are set. The horizon may be a
    column of hits, the same for all rows of a video.
    """
    w = Window.partitionBy("video").orderBy("rally")
    r = hits.groupBy("video", "rally").agg(F.min("frame").alias("start"), F.max("frame").alias("last"), F.max_by("side", "frame").alias("last_hitter"), F.count("*").alias("n_strokes"), F.max(_column(horizon)).alias("_horizon"))
    r = r.withColumn("until", F.least(F.col("last") + F.col("_horizon"), F.lead("start").over(w)))
    b = bounces.select(F.col("video").alias("_v"), F.col("frame").alias("_f"), F.col("half").alias("_h"), span_of("frame").alias("_s"))
    j = spans(r, "start", F.col("until")).join(b, (F.col("video") == F.col("_v")) & (F.col("_span") == F.col("_s")) & F.col("_f").between(F.col("start"), F.col("until")), "left")
    later = F.col("_f") > F.col("last")
    g = j.groupBy("video", "rally", "start", "last", "last_hitter", "n_strokes").agg(
        F.count("_f").alias("n_bounces"), F.min_by(F.when(later, F.col("_h")), F.when(later, F.col("_f"))).alias("half"), F.max(F.when(later, F.col("_f"))).alias("last_bounce")
    )
    other = F.when(F.col("last_hitter") == "right", "left").otherwise("right")
    outcome = F.when(F.col("half") == other, "winner").when(F.col("half").isNotNull(), "net").otherwise("out")
    g = g.where((F.col("n_strokes") > 1) | (F.col("n_bounces") > 0))
    return g.select(
        "video", "rally", "start", F.greatest("last", F.coalesce("last_bounce", "last")).alias("end"), "n_strokes", "n_bounces", "last_hitter", outcome.alias("outcome"),
        F.when(outcome == "winner", F.col("last_hitter")).otherwise(other).alias("point_winner"),
    )


def contexts(hits: DataFrame, fps: float | str, max_gap_s: float = 2.5) -> DataFrame:
    """hits with first_of_rally and since_prev_s (null at a first one), over both sides."""
    w, fps = Window.partitionBy("video").orderBy("frame"), _column(fps)
    gap = F.col("frame") - F.lag("frame").over(w)
    first = F.col("serve") | gap.isNull() | (gap > max_gap_s * fps)
    return hits.withColumn("first_of_rally", first).withColumn("since_prev_s", F.when(~first, gap / fps))


def segments(events: DataFrame, before: int, after: int) -> DataFrame:
    """Merged intervals [frame - before, frame + after] per video, cut off at 0; touching ones merge."""
    w = Window.partitionBy("video").orderBy("lo", "hi")
    e = events.select("video", F.greatest(F.col("frame") - before, F.lit(0)).alias("lo"), (F.col("frame") + after).alias("hi"))
    far = F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_n", F.coalesce(far.cast("int"), F.lit(0))).withColumn("_seg", F.sum("_n").over(w))
    return e.groupBy("video", "_seg").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_seg")
