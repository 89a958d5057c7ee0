"""Queries of what surrounds detection and presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..operators import detection, pose, presentation, sequence
from ..sources.views import FRAMES_SQL, TRAJ_SQL, frames, table, trajectory
from . import poses as P
from . import reporting as R


def ball_trail(spark, d: str) -> DataFrame:
    return presentation.trail(trajectory(spark, d), 4, 40.0)


def active_label(spark, d: str) -> DataFrame:
    f = frames(spark, d)
    return presentation.on_show(f, f.where("kind = 'click'"), 3)


def _blobs(spark, d: str) -> DataFrame:
    f = frames(spark, d)
    return f.select("video", F.floor(F.col("frame") / 20).alias("frame"), F.col("frame").alias("id"), (F.col("k") % 17 + 1).cast("long").alias("w"), (F.col("frame") % 13 + 1).alias("h"), (F.col("k") * 2 + 3).cast("long").alias("area"), (F.col("secs") % 251 / 251).alias("bright"))


def blob_candidates(spark, d: str) -> DataFrame:
    return detection.blob_candidates(_blobs(spark, d), 1.0).select("video", "frame", "id", "rank", F.round("conf", 6).alias("conf"))


def contour_candidates(spark, d: str) -> DataFrame:
    f = frames(spark, d).withColumns({"w": F.col("k") + 20, "h": F.col("value") / 8, "y": F.col("value")})
    return f.where(detection.table_contour(F.col("k"), F.col("y"), F.col("w"), F.col("h"), F.col("w") * F.col("h"), 200.0, 120.0)).select("video", "frame")


def median_corners(spark, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("n_frames", F.count("*").over(Window.partitionBy("video"))).where("kind <> 'error'")
    pts = f.select("video", "frame", "n_frames", F.posexplode(F.array(F.struct(F.col("k").alias("x"), F.col("value").alias("y")), F.struct((F.col("k") + 10).alias("x"), (F.col("value") * 2).alias("y")))).alias("corner", "p"))
    return detection.median_corners(pts.select("video", "frame", "n_frames", "corner", "p.x", "p.y")).select("video", "corner", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


def compact_shots(spark, d: str) -> DataFrame:
    s = R.shots(spark, d).withColumn("at", R._at())
    c = presentation.compact(s, "player", "at", ["hand", "technique"], 5)
    return c.select("player", F.size("shots").alias("n"), F.array_join(F.transform("shots", lambda x: F.concat(x["hand"], F.lit("-"), x["technique"])), ",").alias("shots"))


def prompts(spark, d: str) -> DataFrame:
    f = frames(spark, d).where("kind = 'click'")
    side, racket = F.when(F.col("k") >= 50, "right").otherwise("left"), F.when(F.col("frame") % 3 == 0, "L").when(F.col("frame") % 3 == 1, "R")
    return f.select("video", "frame", F.md5(presentation.stroke_prompt(side, racket, _VOCAB)).alias("prompt"))


_VOCAB = {"hand": L.HANDS, "technique": L.TECHNIQUES}
_CHOICES = "; ".join(f"{k} from {', '.join(v)}" for k, v in _VOCAB.items())


def request_errors(spark, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_size")
    k = F.col("p_partkey")
    name = F.concat(F.lit("clip"), F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".MOV", ".txt", "")]), (k % 4 + 1).cast("int")))
    side, racket = F.when(k % 5 == 0, "up").otherwise("left"), F.when(k % 7 == 0, None).otherwise("auto")
    corners = F.when(k % 3 == 0, "[[1,2],[3,4],[5,6],[7,8]]").when(k % 11 == 0, "[[1,2]]").otherwise("")
    return p.select("p_partkey", presentation.request_error(name, side, racket, corners).alias("error"))


def best_epoch(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return presentation.best_epoch(o.select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 10000).alias("score")), "o_custkey", "o_orderkey", "score")


def _labelled(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Labelled contacts with the segment that holds them, and the poses."""
    p = P.poses(spark, d).drop("vec_id")
    hits = P.strokes(spark, d).select("video", "frame", "side", "slope", "level")
    return sequence.in_segments(hits, sequence.segments(hits, 6, 4)), p


def stroke_segments(spark, d: str) -> DataFrame:
    return _labelled(spark, d)[0].select("video", "frame", "lo", "hi")


def segment_handedness(spark, d: str) -> DataFrame:
    """The racket hand from wrist travel around contacts, summed over the segments of a video."""
    hits, p = _labelled(spark, d)
    return pose.handedness(pose.wrist_travel(p, hits, 12, 6)).select("video", F.round("right", 4).alias("right"), F.round("left", 4).alias("left"), "hand")


def stroke_training(spark, d: str) -> DataFrame:
    """The training matrix by place: labelled contacts in segments, context by timing alone, handedness over segments, and features."""
    hits, p = _labelled(spark, d)
    ctx = sequence.contexts(hits.where("lo is not null").withColumn("serve", F.lit(False)), 4.0)
    hand = pose.handedness(pose.wrist_travel(p, hits, 12, 6)).select("video", F.col("hand").alias("racket"))
    f = pose.stroke_features(ctx.join(hand, "video"), p, P.ball(spark, d))
    rows = f.select("video", "frame", "side", "racket", "first_of_rally", "since_prev_s", F.posexplode("features").alias("i", "value"))
    return rows.withColumn("value", F.round("value", 5))


_SEG = '''c AS (SELECT video, frame FROM pose WHERE frame % 9 = 4), e AS (SELECT video, greatest(frame - 6, 0) AS lo, frame + 4 AS hi FROM c),
q AS (SELECT *, sum(n) OVER (PARTITION BY video ORDER BY lo, hi) AS seg FROM (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY video ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM e) t),
g AS (SELECT video, min(lo) AS lo, max(hi) AS hi FROM q GROUP BY video, seg)'''

_TRAVEL = """j AS (SELECT c.video, c.frame AS hit, p.frame, x[11] AS rx, y[11] AS ry, x[10] AS lx, y[10] AS ly FROM c JOIN g ON g.video = c.video AND c.frame BETWEEN g.lo AND g.hi JOIN pose p ON p.video = c.video AND p.frame BETWEEN greatest(c.frame - 12, g.lo) AND least(c.frame + 5, g.hi)),
s AS (SELECT video, sqrt(pow(rx - lag(rx) OVER w, 2) + pow(ry - lag(ry) OVER w, 2)) AS r, sqrt(pow(lx - lag(lx) OVER w, 2) + pow(ly - lag(ly) OVER w, 2)) AS l FROM j WINDOW w AS (PARTITION BY video, hit ORDER BY frame)),
t AS (SELECT video, coalesce(sum(r), 0) AS r, coalesce(sum(l), 0) AS l FROM s GROUP BY video)"""

QUERIES = {f.__name__: f for f in (ball_trail, active_label, blob_candidates, contour_candidates, median_corners, compact_shots, prompts, request_errors, best_epoch, stroke_segments, segment_handedness, stroke_training)}
SQL = {
    "ball_trail": f"""WITH {TRAJ_SQL}, s AS (SELECT *, CASE WHEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) < 40 THEN 1 ELSE 0 END AS ok FROM traj WINDOW w AS (PARTITION BY video ORDER BY frame))
SELECT video, frame, n::BIGINT AS n FROM (SELECT *, sum(ok) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM s) t WHERE x IS NOT NULL""",
    "active_label": f"WITH {FRAMES_SQL} SELECT f.video, f.frame, max(s.frame) AS shot FROM frames f JOIN frames s ON s.video = f.video AND s.kind = 'click' AND f.frame - s.frame BETWEEN 0 AND 3 GROUP BY ALL",
    "blob_candidates": f"""WITH {FRAMES_SQL}, b AS (SELECT video, frame // 20 AS frame, frame AS id, (k % 17 + 1)::BIGINT AS w, frame % 13 + 1 AS h, (k * 2 + 3)::BIGINT AS area, (secs % 251) / 251 AS bright FROM frames),
c AS (SELECT *, 0.5::DOUBLE * (area / (w * h)) + 0.5::DOUBLE * bright AS conf FROM b WHERE area BETWEEN 12 AND 900 AND greatest(w, h) <= 4 * greatest(least(w, h), 1))
SELECT video, frame, id, rank::INTEGER AS rank, round(conf, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY conf DESC, id) AS rank FROM c) t WHERE rank <= 8""",
    "contour_candidates": f"WITH {FRAMES_SQL} SELECT video, frame FROM frames WHERE value > 2 AND k + 20 >= 24 AND k + 20 >= 2 * value / 8 AND (k + 20) * value / 8 >= 120 AND value + value / 16 >= 40",
    "median_corners": f"""WITH {FRAMES_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY video) AS n_frames FROM frames), p AS (SELECT video, 0 AS corner, k AS x, value AS y, frame, n_frames FROM c WHERE kind <> 'error' UNION ALL SELECT video, 1, k + 10, value * 2, frame, n_frames FROM c WHERE kind <> 'error')
SELECT video, corner, round(median(x), 6) AS x, round(median(y), 6) AS y, count(*) AS n FROM p WHERE list_contains(list_transform(range(8), lambda i: floor(i * ((n_frames - 1) / 7))::BIGINT), frame) GROUP BY video, corner""",
    "compact_shots": f"""WITH {R._SHOTS}, n AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY (rally * 10 + shots.n) * 1000000 + part) AS i FROM shots)
SELECT player, count(*)::INTEGER AS n, string_agg(hand || '-' || technique, ',' ORDER BY i) AS shots FROM n WHERE i <= 5 GROUP BY player""",
    "stroke_segments": f"""WITH {P._POSE}, {_SEG} SELECT c.video, c.frame, g.lo, g.hi FROM c LEFT JOIN g ON g.video = c.video AND c.frame BETWEEN g.lo AND g.hi""",
    "segment_handedness": f"""WITH {P._POSE}, {_SEG},
{_TRAVEL} SELECT video, round(r, 4) AS "right", round(l, 4) AS "left", CASE WHEN l > r THEN 'L' ELSE 'R' END AS hand FROM t""",
    "stroke_training": f"""{P._stroke_sql(f"""hit_travel AS (WITH {_SEG},
{_TRAVEL} SELECT video, CASE WHEN l > r THEN 'L' ELSE 'R' END AS racket FROM t),
c AS (SELECT p.*, CASE WHEN frame % 2 = 0 THEN -1.0::DOUBLE ELSE 1 END AS mirror, racket, CASE WHEN video % 3 <> 1 THEN 0.1::DOUBLE END AS slope, CASE WHEN video % 3 <> 1 THEN 5.0::DOUBLE END AS level,
 coalesce(frame - lag(frame) OVER w > 10, true) AS begins, CASE WHEN frame - lag(frame) OVER w <= 10 THEN (frame - lag(frame) OVER w) / 4 END AS since_s FROM p JOIN hit_travel USING (video) WHERE frame % 9 = 4 WINDOW w AS (PARTITION BY video ORDER BY frame))""")}
SELECT video, frame, CASE WHEN mirror < 0 THEN 'left' ELSE 'right' END AS side, racket, begins AS first_of_rally, since_s AS since_prev_s, i, value FROM vals JOIN c USING (video, frame)""",
    "prompts": f"""WITH {FRAMES_SQL} SELECT video, frame, md5('Label the stroke of the player on the ' || CASE WHEN k >= 50 THEN 'right' ELSE 'left' END || ' side.' || CASE frame % 3 WHEN 0 THEN ' The racket is in the left hand.' WHEN 1 THEN ' The racket is in the right hand.' ELSE '' END
 || ' Choose {_CHOICES}. Reply as one JSON object.') AS prompt FROM frames WHERE kind = 'click'""",
    "request_errors": """SELECT p_partkey, CASE WHEN p_partkey % 4 >= 2 THEN 'unsupported file type' WHEN p_partkey % 5 = 0 THEN 'side must be left or right' WHEN p_partkey % 7 = 0 THEN 'racket must be auto, left or right'
 WHEN p_partkey % 3 <> 0 AND p_partkey % 11 = 0 THEN 'corners must be four points' END AS error FROM part""",
    "best_epoch": "SELECT o_custkey, arg_min(o_orderkey, (-s, o_orderkey)) AS o_orderkey, max(s)::BIGINT AS score FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice / 10000) AS s FROM orders) t GROUP BY o_custkey",
}
